"""Mixing sources to target weights: hash-threshold histograms.

Every document has a hash. Tokens are summed by source and hash bucket; the running sums show the
bucket in which a source's budget ends. Only that bucket is split again by the next bits of the
hash, until the threshold is a full hash. A filter on the hash then takes the documents below it:
nothing is sorted but the few bucket sums. Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, words_of

#: Weights of the sources in their order, repeating; total budget in shares of all tokens; most
#: times that a source's tokens may be taken.
WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
#: The hash has LEVELS x LEVEL_BITS bits; each level splits the boundary bucket by LEVEL_BITS more.
LEVELS, LEVEL_BITS = 5, 12


def hash_of(key: Column) -> Column:
    """60 bits of the MD5 of a key's text form (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, LEVELS * LEVEL_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = BUDGET_SHARE, most: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: ``share`` of all tokens dealt by weight, at most ``most`` times a source's size.

    The windows without a partition run over one row per source. Sorted by cap per weight, the capped
    sources come first; the first one below its cap fixes the rate of all the others.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", most * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "place": F.row_number().over(filling),
        "before": F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"),
        "rest": F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(every),
    })
    per = per.withColumn("rate", (share * F.col("all") - F.col("before")) / F.col("rest"))
    free = F.when(F.col("rate") * F.col("weight") < F.col("cap"), F.struct("place", "rate"))
    per = per.withColumn("first_free", F.min(free).over(every))
    capped = F.col("first_free").isNull() | (F.col("place") < F.col("first_free.place"))
    return per.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("first_free.rate") * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame, tables: Tables) -> DataFrame:
    """Per source: whole (times that every document is taken), rest (tokens still due), edge (the hash
    in which the rest ends), below (tokens of smaller hashes) and at_edge (tokens of that hash).

    ``wanted`` and each level's result are written tables of one row per source: Spark knows their size
    and moves them to the documents, whose rows stay where they are.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    found = wanted.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    found = found.withColumn("edge", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    columns = ["source_size", "target", "whole", "rest"]
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * LEVEL_BITS
        inside = F.shiftright("hash", shift + LEVEL_BITS) == F.col("edge")
        sums = (
            sizes.alias("d").join(found.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).where(inside)
            .groupBy("d.source", *columns, "below", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("tokens"))
        )
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("below") + F.sum("tokens").over(running))
        over = F.when(F.col("upto") > F.col("rest"), F.struct(F.col("bucket"), F.col("upto"), F.col("tokens")))
        found = sums.groupBy("source", *columns).agg(F.min(over).alias("x")).select(
            "source", *columns, F.col("x.bucket").alias("edge"), (F.col("x.upto") - F.col("x.tokens")).alias("below"), F.col("x.tokens").alias("at_edge")
        )
        found = tables.keep(found, f"level-{level}")
    # no bucket of a source without words exceeds its budget of 0: it keeps its row, and takes nothing
    ends = found.select(F.col("source").alias("_ends"), "edge", "below", "at_edge")
    every = wanted.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return every.join(ends, F.col("source").eqNullSafe(F.col("_ends")), "left").drop("_ends").fillna(0, ["edge", "below", "at_edge"])


def mix(docs: DataFrame, keep: list[str], **options) -> DataFrame:
    """The columns in ``keep`` with size, source_size, target and taken, one row per row of ``docs``.

    size is the number of words of the whole text (null: 0), taken the words that the mix takes of the
    document, repeats counted: a multiple of its size, 0, 1 or 2 times. Equal doc_ids share one fate;
    reruns agree, as the hash depends on doc_id only. Null sources form one source, the last. A
    source without words has the target 0. An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "mixing")
    measured = docs.select(*keep, F.col("source").alias("_source"), F.size(words_of(F.col("text"))).cast("long").alias("size"), hash_of(F.col("doc_id")).alias("_hash"))
    measured = tables.keep(measured, "sizes")
    sizes = measured.select(F.col("_source").alias("source"), "size", F.col("_hash").alias("hash"))
    edges = thresholds(sizes, tables.keep(targets(sizes, **options), "targets"), tables).withColumnRenamed("source", "_of")
    edges = tables.keep(edges, "edges")
    tables.drop("targets", *[f"level-{level}" for level in range(1, LEVELS + 1)])
    joined = measured.join(edges, F.col("_source").eqNullSafe(F.col("_of")), "left")
    nearer = F.col("below") + F.col("at_edge") - F.col("rest") < F.col("rest") - F.col("below")
    extra = (F.col("_hash") < F.col("edge")) | ((F.col("_hash") == F.col("edge")) & nearer)
    times = F.col("whole") + F.when(extra, 1).otherwise(0)
    return joined.select(*keep, "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.cast("int").alias("_times"))


def mixture_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs, ["doc_id"]).drop("_times")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0, 1 or 2 times), all columns as they were.

    Null and empty texts have no words: they count nothing, and go or stay with their hash. Long texts
    are counted whole; repeated rows share one fate; an empty table stays empty. Extra columns travel
    as one struct, so no name can clash.
    """
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    taken = mix(packed, ["_row"]).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return taken.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
