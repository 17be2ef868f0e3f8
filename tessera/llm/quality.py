"""Quality rules: counts of a text, and its divergence from language references.

Every text gets a histogram of Unicode character classes and a histogram of the common words of its
language. A language's reference is half a fixed expectation - the character classes of prose, and
Zipf's law for the common words - and, the more documents of the language pass the base rule, up to a
half their own histograms' sum, so that neither a rare language nor one whose documents are mostly bad
becomes its own standard.
A document is rejected when its Jensen-Shannon distance from either reference is too large; minimum
lengths keep a distance from judging texts too short for its histogram. Built from DataFrame
functions alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, Tables, words_of

# The common words that stand for each language, the most frequent ones first.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "auf", "für", "des", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "werden"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "are", "this", "at", "from", "he", "an", "or", "not"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por", "con", "no", "una", "para", "su", "es", "al", "lo", "como", "más", "o", "pero"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "par", "avec", "qui", "dans", "pas", "sur", "au", "il", "ou", "ce", "plus"],
}
N_COMMON = 24
CLASSES = ["n_upper", "n_lower", "n_digit", "n_mark", "n_symbols", "n_space", "n_other"]
#: Patterns of the counted classes; spaces are what is no word, others what is left.
PATTERNS = {"n_upper": r"\p{Lu}", "n_lower": r"\p{Ll}", "n_digit": r"\p{Nd}", "n_mark": r"[^\P{P}#*%&]", "n_symbols": "[#*$%&|<>]"}
BINS = [f"c{i}" for i in range(N_COMMON)] + ["c_rest"]
#: Expected shares of the classes in prose, and of the common words by rank. Their part in a reference is
#: PRIOR_SHARE at least; the sums' part has half its full size at PRIOR_COUNT characters or words.
CLASS_PRIOR = [0.03, 0.775, 0.005, 0.025, 0.002, 0.16, 0.003]
ZIPF = [0.06 / rank for rank in range(1, N_COMMON + 1)]
WORD_PRIOR = [*ZIPF, 1 - sum(ZIPF)]
PRIOR_SHARE, PRIOR_COUNT = 0.5, 100_000

#: Base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Verdict of the method: largest distances, and the shortest texts that they judge.
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.235
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 100
#: Up to so many different repeated windows, the windows are looked up in a list; beyond, sorted.
FEW_REPEATS = 24


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def common_forms() -> list[str]:
    """The common words of all languages as they stand in texts: small, with a capital, in capitals."""
    return sorted({form for words in COMMON_WORDS.values() for w in words for form in (w, w.capitalize(), w.upper())})


def text_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of each row's whole text beside the columns in ``keep``; names with _ are internal.

    A null text has no words, no lines and no characters: every count is 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    language = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(""))
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")

    step = docs.select(*keep, text.alias("_text"), language.alias("_language"), words_of(F.col("text")).alias("_w"))
    text = F.col("_text")
    # 64-bit hashes of the 3-word windows; most texts repeat none, which a set of the hashes shows at once
    step = step.withColumn("_h", F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> xxhash64(x, _w[i + 1], _w[i + 2]))"))
    step = step.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), cast(array() as array<bigint>), sort_array(_h))"))
    step = step.withColumn("_d", F.expr("array_distinct(filter(_s, (x, i) -> x = get(_s, i - 1)))"))
    few = "filter(transform(_h, (x, i) -> if(array_contains(_d, x), i, -1)), p -> p >= 0)"
    step = step.withColumn("_z", F.expr(f"if(size(_d) > {FEW_REPEATS}, array_sort(transform(_h, (x, i) -> struct(x as h, i as i))), null)"))
    many = "array_sort(transform(filter(_z, (x, i) -> x.h = get(_z, i - 1).h or x.h = get(_z, i + 1).h), x -> x.i))"
    step = step.withColumn("_p", F.expr(f"case when size(_d) = 0 then cast(array() as array<int>) when size(_d) <= {FEW_REPEATS} then {few} else {many} end"))
    step = step.withColumn("_lines", F.expr(r"filter(split(_text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    step = step.withColumn("_list", F.coalesce(lists[F.col("_language")], F.array().cast("array<string>")))
    step = step.withColumn("_c", F.transform(F.filter("_w", lambda x: x.isin(*common_forms())), F.lower))
    counted = step.select(
        *keep,
        "_language",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(text).cast("long").alias("n_chars_text"),
        *[count(pattern).alias(name) for name, pattern in PATTERNS.items()],
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("cast(aggregate(transform(_p, (x, i) -> least(3, coalesce(get(_p, i + 1) - x, 3))), 0, (a, x) -> a + x) as long)").alias("n_repeat_words"),
        *[F.expr(f"cast(size(_c) - size(coalesce(array_remove(_c, get(_list, {i})), _c)) as long)").alias(f"c{i}") for i in range(N_COMMON)],
    )
    counted = counted.withColumn("n_space", F.col("n_chars_text") - F.col("word_chars"))
    counted = counted.withColumn("n_other", F.col("n_chars_text") - F.col("n_space") - _sum([F.col(x) for x in PATTERNS]))
    counted = counted.withColumn("c_rest", F.col("n_words") - _sum([F.col(x) for x in BINS[:-1]]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def language_references(features: DataFrame) -> DataFrame:
    """One row per known language (and one for all others): summed histograms.

    Its size is bounded by ``COMMON_WORDS``: at most one row more than it has languages.
    """
    return (
        features.where(~F.col("base_failed"))
        .groupBy("_language")
        .agg(*[F.sum(x).alias(f"r_{x}") for x in CLASSES + BINS])
    )


def _add_distance(frame: DataFrame, bins: list[str], prior: list[float], name: str) -> DataFrame:
    """Adds the Jensen-Shannon distance (natural logarithm) of a row's counts from its reference.

    A known language's reference is the prior and its documents' sums in shares, or the prior alone
    where no document passes the base rule; documents of all other languages share their sums only.
    """
    own, ref = F.array(*bins), F.array(*[f"r_{x}" for x in bins])
    frame = frame.withColumn("_own", own).withColumn("_ref", ref)
    frame = frame.withColumn("_n", F.expr("aggregate(_own, 0L, (a, x) -> a + x)")).withColumn("_m", F.expr("aggregate(_ref, 0L, (a, x) -> a + x)"))
    frame = frame.withColumn("_prior", F.array(*map(F.lit, prior)))
    frame = frame.withColumn("_q", F.expr(f"""
        case when _language = '' then transform(_ref, x -> x / _m) when _m = 0 then _prior
             else zip_with(_ref, _prior, (x, y) -> y + {1 - PRIOR_SHARE}D * (_m / (_m + {PRIOR_COUNT})) * (x / _m - y)) end"""))
    terms = """zip_with(transform(_own, x -> x / _n), _q, (p, q) ->
        if(p > 0, p * ln(2 * p / (p + q)), 0D) + if(q > 0, q * ln(2 * q / (p + q)), 0D))"""
    distance = f"if(_n > 0 and (_m > 0 or _language <> ''), sqrt(greatest(aggregate({terms}, 0D, (a, x) -> a + x) / 2, 0D)), 0D)"
    return frame.withColumn(name, F.expr(distance)).drop("_own", "_ref", "_n", "_m", "_prior", "_q")


def judge(features: DataFrame, references: DataFrame) -> DataFrame:
    """Adds class_distance, word_distance and kept; either distance rejects. Words of unknown languages aren't judged."""
    scored = features.join(F.broadcast(references), "_language", "left").fillna(0, [f"r_{x}" for x in CLASSES + BINS])
    scored = _add_distance(_add_distance(scored, CLASSES, CLASS_PRIOR, "class_distance"), BINS, WORD_PRIOR, "word_distance")
    odd_classes = (F.col("n_chars_text") >= MIN_CHARS_FOR_CLASSES) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    odd_words = (F.col("_language") != "") & (F.col("n_words") >= MIN_WORDS_FOR_COMMON) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    return scored.withColumn("kept", ~(F.col("base_failed") | odd_classes | odd_words))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, counts, base_failed, distances and kept.

    The counts are made once, written to the shared folder, and read twice: for the references and
    for the verdicts. Null texts count as empty and fail the base rule; equal texts of one language
    get equal verdicts; an empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    tables = Tables(docs.sparkSession, "quality")
    features = tables.keep(text_features(docs, ["doc_id"]), "features")
    return judge(features, language_references(features)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that the rules keep.

    Null, empty and short texts go, as they fail the base rule; long texts are judged whole; repeated
    rows stay or go together; an empty table stays empty. The rows travel as one struct through the written table, so no column name can clash.
    """
    tables = Tables(docs.sparkSession, "quality")
    packed = docs.select("text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    features = tables.keep(text_features(packed, ["_row"]), "features")
    kept = judge(features, language_references(features)).where("kept")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
