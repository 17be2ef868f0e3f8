"""Operators against brute force, SQL and round trips, with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, dealing, mixing, mpeg, neardup, pii, quality, queries, sentpiece, suffix, toxicity, urlfilter
from tessera.llm.shared import Tables

from .helpers import DOCS, frame, near_components, odd_rows, oracle, row, same, sentence, shingles


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_rows(random.Random(1))).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# 1 quality rules


def test_quality_equals_sql(docs, tmp_path):
    same(quality.quality_report(docs).collect(), oracle(docs, queries.quality_sql(), tmp_path))


def test_quality_many_repeats(spark):
    text = "a b c " * 50 + " ".join(f"w{i} w{i}x w{i}y" for i in range(40)) + " " + " ".join(f"w{i} w{i}x w{i}y" for i in range(40))
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    assert quality.quality_report(frame(spark, [row(1, text)])).first()["n_repeat_words"] == len(covered)


def test_quality_rejects_odd_characters_and_keeps_prose(spark):
    rng = random.Random(2)
    rest = [f"{a}{b}" for a in ("river", "stone", "light", "garden", "window", "paper", "music", "winter") for b in ("", "s", "ing", "ed", "ly", "ness")]
    prose = lambda: " ".join(rng.choice([*quality.COMMON_WORDS["en"], "The", "of"]) if rng.random() < 0.25 else rng.choice(rest) for _ in range(300)).capitalize()
    good = [row(i, prose()) for i in range(20)]
    odd = row(99, " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in prose().split()))
    wordless = row(98, " ".join(rng.choice(rest) for _ in range(300)))  # usual characters, no common word
    short = row(97, " ".join(rng.choice(rest) for _ in range(99)))
    unknown = row(96, " ".join(rng.choice(rest) for _ in range(300)), "xx")
    alone = row(95, " ".join(rng.choice(rest) for _ in range(300)), "fr")  # the only one of its language: no standard of its own
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(frame(spark, [*good, odd, wordless, short, unknown, alone])).select("doc_id", "kept").collect()}
    assert all(got[r[0]] for r in good) and not got[99] and not got[98] and got[97] and got[96] and not got[95]


def test_quality_filter_keeps_columns(docs, empty):
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    report = quality.quality_report(docs).where("kept").count()
    assert kept.count() == report and quality.filter_documents(empty).count() == 0 and quality.quality_report(empty).count() == 0


# 2 near-duplicates


def _near_rows():
    rng = random.Random(3)
    bases = [sentence(rng, n, [f"w{i}" for i in range(400)]).split() for n in (40, 80, 200, 6, 3)]
    rows = []
    for k, base in enumerate(bases):
        for copy in range(14):
            words = list(base)
            for _ in range(copy * len(base) // 160):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
            rows.append((len(rows) * 3 % 71, " ".join(words).upper() if copy % 2 else " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "one two"), (104, "ONE  two")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = _near_rows()
    expected = near_components(rows)
    got = neardup.near_duplicates(frame(spark, [row(i, t) for i, t in rows])).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingles(text)), expected[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_without_ids_and_repeated_rows(spark):
    rng = random.Random(4)
    text = sentence(rng, 50, [f"w{i}" for i in range(99)])
    docs = frame(spark, [row(None, text), row(5, text), row(5, text), row(3, text), row(3, sentence(rng, 50, [f"v{i}" for i in range(99)]))])
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [("3", 3, True), ("3", 3, True), ("5", 3, False), ("5", 3, False), ("None", None, True)]
    assert neardup.one_of_each(docs).columns == docs.columns and neardup.one_of_each(docs).count() == 3


def test_large_impure_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = _near_rows()
    expected = near_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, [row(i, t) for i, t in rows])).collect()}
    assert got == expected


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(dealing, "LEAST_HOT", 2)
    monkeypatch.setattr(neardup, "WEIGHT", 400)
    rows = _near_rows()
    rows += [(200 + i, rows[3][1]) for i in range(20)]
    expected = near_components(rows)
    got = neardup.near_duplicates(frame(spark, [row(i, t) for i, t in rows])).select("doc_id", "component_id").collect()
    assert len(got) == len(rows) and dict(map(tuple, got)) == expected


def test_bands_and_sketch_miss_no_link_at_the_threshold():
    rng = np.random.default_rng(75)
    most = neardup.SKETCH_BITS / 2 * (1 - np.exp(4.0 * neardup.SAMPLES / neardup.SKETCH_BITS * (neardup.LEAST_ESTIMATE - 1)))
    for size, share in [(n, s) for n in (8, 20, 100, 400, 1500) for s in (0.75, 0.77, 0.8)] * 100:
        both = -(-size * 3 // 4) if share == 0.75 else int(np.ceil(size * share))
        hashes = rng.integers(0, 2**64, size, dtype=np.uint64)
        a, b = np.unique(hashes[: both + (size - both) // 2]), np.unique(np.concatenate([hashes[:both], hashes[both + (size - both) // 2 :]]))
        assert neardup.similar(a, b)
        (one, first), (two, second) = neardup.signature(a), neardup.signature(b)
        assert (first == second).any() and int(np.bitwise_count((one ^ two).view(np.uint64)).sum()) <= most


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for share in (0.6, 0.75, 0.9):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
            rest = [rng.integers(0, 2**63, int(500 * (1 - share)), dtype=np.uint64) for _ in range(2)]
            a, b = (neardup.signature(np.unique(np.concatenate([both, r])))[0] for r in rest)
            ones = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
            errors.append(1 + neardup.SKETCH_BITS / (4 * neardup.SAMPLES) * np.log(max(1 - 2 * ones / neardup.SKETCH_BITS, 1e-9)) - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


# 3 chat


def test_chat_equals_sql(spark, tmp_path):
    t = "<|im_end|>"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", t + "<\\|x" + "y" * 2000), (1, 1, "assistant", t), (1, None, None, "first"), (None, 0, "assistant", "lost"), (2, 0, "a\n\\b<|", "x"), (2, 0, "a\n\\b<|", "x"), (3, 5, "assistant", "é🙂漢")]
    frame_ = spark.createDataFrame([(*r, "extra", "m") for r in rows], "conv_id long, turn long, role string, text string, message string, piece string")
    planted = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    more = frame_.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(planted, "conv_id long, turn long, role string, text string"))
    same(chat.conversation_digests(more).collect(), oracle(frame_, queries.CHAT_SQL, tmp_path, "conversations"))
    assert chat.conversation_digests(frame_).count() == 4
    assert chat.conversation_digests(frame_.where("false")).count() == 0


def test_fold_edits_and_regenerations(spark):
    log = [(1, 1, 0, "user", "open", None), (1, 1, 1, "user", "delta", "he"), (1, 1, 2, "user", "delta", "llo"), (1, 2, 3, "assistant", "open", None), (1, 2, 4, "assistant", "delta", "bad"), (1, 2, 5, None, "regenerate", None), (1, 2, 6, None, "delta", "go"), (1, 2, 7, None, "delta", "od"), (1, 1, 8, None, "edit", "bye"), (1, 1, 9, None, "delta", "!"), (1, 3, 10, "user", "open", None)]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, message long, seq int, role string, kind string, delta string"))
    assert sorted(tuple(r) for r in got.select("message", "role", "text").collect()) == [(1, "user", "bye!"), (2, "assistant", "good"), (3, "user", "")]


@given(st.text(alphabet="<|\\im_startend>ab\n"), st.text(alphabet="<|\\n\nab>"))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text, role):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and "<|" not in hidden
    assert chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)
    assert chat.read_back(f"{chat.START}{chat.escape_role(role)}\n{hidden}{chat.END}\n") == (role, text)


# 4 suffix doubling


def _without_repeats(rows):
    first = {}
    data = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in data:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "COMBINED", 500)
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("a", "é", "on", "ing")]
    base = [sentence(rng, 60, words) for _ in range(8)]
    passage = sentence(rng, 25, words)
    rows = []
    for i in range(60):
        t = rng.choice(base)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "x", passage, t[k : k + 40] * 3]) + t[k + rng.randrange(3) :]
        rows.append((i, t))
    rows += [(60, None), (61, ""), (62, "a" * 200), (63, "a" * 49), (64, "a" * 50), (65, "ab" * 100), (66, base[0]), (67, base[0])]
    got = suffix.repeat_report(frame(spark, [row(i, t) for i, t in rows]).repartition(4))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == _without_repeats(rows)


def test_repeats_in_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 300)
    rng = random.Random(7)
    long = sentence(rng, 400, [f"k{i}" for i in range(300)])
    rows = [(2, long), (1, long[500:900]), (3, long[:700] + "!" + long[700:])]
    got = suffix.repeat_report(frame(spark, [row(i, t) for i, t in rows]))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == _without_repeats(rows)


def test_repeats_odd_rows(docs, empty, spark):
    assert suffix.repeat_report(docs).count() == docs.count() and suffix.repeat_report(empty).count() == 0
    none = suffix.repeat_report(frame(spark, [row(None, "z" * 80), row(1, "z" * 80), row(1, "z" * 80)])).collect()
    assert all(r["n_removed"] == 0 for r in none)


def test_repeats_of_rows_that_share_a_doc_id(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 100)
    passage = sentence(random.Random(11), 20)[:80].ljust(80, "x")
    rows = [(1, passage), (2, "C" * 120), (2, passage + "tail of another kind"), (2, "C" * 120), (3, None), (3, "D" + passage)]
    got = suffix.remove_repeats(frame(spark, [row(i, t) for i, t in rows])).collect()
    assert sorted((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got) == sorted(
        [(1, 80, passage.encode()), (2, 120, b"C" * 120), (2, 100, b"tail of another kind"), (2, 120, b"C" * 120), (3, 0, b""), (3, 81, b"D")]
    )


class _Called:
    """Takes a worker's function in Spark's place."""

    def groupBy(self, *keys):
        return self

    def mapInArrow(self, function, schema):
        return function

    applyInArrow = mapInArrow


def _peak(call):
    tracemalloc.start()
    try:
        out = call()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_repeats_take_little_of_a_worker():
    rng = np.random.default_rng(5)
    texts = [bytes(x).decode() for x in rng.integers(97, 123, (2000, 4000), dtype=np.uint8)]
    texts[7] = texts[3][:2000] + texts[7]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([0] * 2000, pa.int64()), pa.array(texts)], names=["doc_id", "variant", "text"])
    dealt, peak = _peak(lambda: list(suffix.deal_anchors(_Called(), 2)(iter([batch]))))
    assert peak < 120, peak  # MB for 8 MB of text; 157 with pieces of 1 MB and rows that are copied when they are dealt
    groups = {}
    for whole in dealt:
        for k in range(whole.num_rows):
            groups.setdefault((whole.column("shard")[k].as_py(), whole.column("route")[k].as_py()), []).append(whole.slice(k, 1))
    found = []
    for parts in groups.values():
        out, peak = _peak(lambda parts=parts: list(suffix.decide(_Called())(iter(parts))))
        assert peak < 60 and all(x.num_rows <= suffix.RESULTS for x in out), peak
        found += [r for x in out for r in x.to_pylist()]
    covered = [(r["low"], r["low"] + r["more"]) for r in found if r["covered"] and r["doc_id"] == 7]
    assert {r["doc_id"] for r in found if r["covered"]} == {7} and max(high for _, high in covered) <= 1950


def test_repeats_leave_no_shuffle_behind(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}

    own, before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), shuffled()
    tables = Tables(spark, "left", suffix.WRITING)
    kept = tables.keep(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).agg(F.collect_list("id").alias("ids")), "groups")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and kept.count() == 50
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == own


# 5 media


def test_media_round_trip(docs, empty):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mpeg.media_report(docs).collect():
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert len(r["frame_offsets"]) == len(payload) // 576 and r["duration_us"] == 36_000 * len(payload) // 576
    assert mpeg.media_report(empty).count() == 0


def test_media_resynchronises_and_verifies():
    payload = bytes(range(256)) * 9
    media = mpeg.write(payload)
    whole = mpeg.read_media(media)
    assert whole["payload"] == payload and whole["table"] and whole["failed"] == 0 and whole["variable"] is not None
    cut = whole["offsets"][2]
    broken = media[:cut] + b"\xff\xfbjunk\xff" + media[cut:]
    found = mpeg.read_media(broken)
    assert found["payload"] == payload and found["skipped"] == 7 and found["resyncs"] == 1 and not found["table"]
    flipped = bytearray(media)
    flipped[cut + 7] ^= 1
    assert mpeg.read_media(bytes(flipped))["failed"] == 1
    assert mpeg.read_media(b"")["offsets"] == [] and mpeg.read_media(b"\xff" * 500)["offsets"] == []
    assert mpeg.header(bytes((255, 0xFB, 0x90, 0))) == (1, 3, 44100, 1152, 417, 32, False)


# 6 urls


def test_urls_equal_sql(spark, tmp_path):
    urls = [None, "", "no scheme", "http://net", "http://NET/", "https://a.b.net/en/x?y", "http://x.example.net/en/#f", "http://example.net/EN/", "ftp://example.com/de/a", "http://m.example.com/de", "http://q.org/fr/", "http://org/fr/1", "http://xnet/", "http://a.net?x/", "http://u@a.net:80/", "://net/", "http://é.net/ü", "http://" + "a." * 300 + "net/" + "p/" * 900]
    pages = spark.createDataFrame([(i % 15, u, "h", "p", "r") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, path string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    same(urlfilter.judge_urls(pages, rules).collect(), oracle(pages, queries.URL_SQL, tmp_path, "pages"))
    assert urlfilter.judge_urls(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, rules.where("false"), "block").collect()} == {"block"}
    long = spark.createDataFrame([("net", "/" + "p" * 5000, "block")], "host string, path string, action string")
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, long).collect()} == {"allow"}


def test_urls_meet_rules_on_the_short_hash_alone(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i % 7, f"https://s{i % 5}.example.net/{'en' if i % 2 else 'de'}/{i % 3}") for i in range(200)] + [(1, None)] * 3, "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    judged = urlfilter.judge_urls(pages, rules)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [short" in plan and "BroadcastHashJoin [digest" not in plan and "SortMergeJoin" not in plan
    expected = oracle(pages, queries.URL_SQL, tmp_path, "pages")
    same(judged.collect(), expected)
    monkeypatch.setattr(urlfilter, "MAX_BROADCAST_RULES", 0)
    same(urlfilter.judge_urls(pages, rules).collect(), expected)
    monkeypatch.setattr(urlfilter, "PREFIX_DIGITS", 0)  # all short hashes collide; digests decide
    same(urlfilter.judge_urls(pages, rules).collect(), expected)


# 7 personal data


def _base(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0:
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return [(s, e, k) for s, _, e, k in sorted(found)]


@given(st.text(alphabet="0123456789.@+- ()aZ_%é", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_patterns(text):
    got = [x for x in pii.spans_of(text, _ANCHORS) if x[2] in pii.BASE_KINDS]
    assert got == _base(text)


_ANCHORS = pii.automaton()


def test_method_adds_spans_and_leaves_prose_alone():
    text = 'mail a@b.co or see https://x.org/y?z=1. token = "9b0b3c6a43eb78aa" and 12 Baker Street; account: AB12345678'
    kinds = [(text[s:e], k) for s, e, k in pii.spans_of(text, _ANCHORS)]
    assert kinds == [("a@b.co", "email"), ("https://x.org/y?z=1", "url"), ("9b0b3c6a43eb78aa", "account"), ("12 Baker Street", "address"), ("AB12345678", "account")]
    assert pii.spans_of("The account of the street and a token of thanks: nothing here, no 42.", _ANCHORS) == []
    assert pii.spans_of("1" * 200_000, _ANCHORS) == []


def _account_brute(text):
    """Identifiers behind iban and ssn, from every start and to every end."""
    found = []
    for m in re.finditer(r"(?<![^\W_])(iban|ssn)[ :]{0,2}", text, re.I):
        for end in range(m.end() + 9, len(text) + 1):
            part = text[m.end() : end]
            plain = part.replace(" ", "").upper()
            if m[1].lower() == "iban":
                grouped = re.fullmatch(r"[A-Z0-9]{4}(?: ?[A-Z0-9]{4})* ?[A-Z0-9]{0,4}", part.upper()) and part[-1] != " "
                good = grouped and len(plain) == pii.IBAN_LENGTHS.get(plain[:2]) and plain[2:4].isdigit() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
                good = good and not text[end : end + 1].isalnum()
            else:
                s = re.fullmatch(r"(\d{3})-(\d\d)-(\d{4})|(\d{3})(\d\d)(\d{4})", part)
                area, group, serial = [x for x in s.groups() if x] if s else ("000", "00", "0000")
                good = s and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and text[end : end + 1] not in set("0123456789-")
            if good:
                found.append((m.end(), end, "account"))
                break
    return found


def test_validated_identifiers_equal_brute_force():
    rng = random.Random(13)
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "de89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE00000000000000000000", "DE89 3704 0044 0532 0130 01", "FR1420041010050500013M02606", "DE8937040044"]
    ssns = ["123-45-6789", "123456789", "666-45-6789", "900-12-3456", "123-00-6789", "123-45-0000", "12-345-6789", "123-45-67890"]
    for _ in range(400):
        text = " and ".join(rng.choice(["IBAN", "iban", "Iban", "xiban", "sSn", "SSN", "SSNs"]) + rng.choice([": ", " ", ":", ""]) + rng.choice(ibans + ssns) + rng.choice(["", ".", ",", "x", "7"]) for _ in range(3))
        assert [x for x in pii.spans_of(text, _ANCHORS) if x[2] == "account"] == _account_brute(text), text


def test_cues_in_any_case_and_long_names():
    found = lambda t: [(t[s:e], k) for s, e, k in pii.spans_of(t, _ANCHORS)]
    assert found("PaSsWoRd: hunter2hunter2") == [("hunter2hunter2", "account")] and found("my ssn is 123-45-6789") == [("123-45-6789", "account")]
    assert found("passport 12345678") == [("12345678", "account")] and found("passport: background2day") == []
    name = "A" + "b" * 300
    assert found(f"at 12 {name} Street") == [(f"12 {name} Street", "address")] and found("12 rue de la Paix") == [("12 rue de la Paix", "address")]
    assert found("İ" * 3 + " token: abcdefg1") == [("abcdefg1", "account")]


def test_personal_data_table(docs, empty, spark):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.find_personal_data(docs).collect():
        base = ",".join(f"{k}:{s}:{e}" for s, e, k in _base(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert pii.find_personal_data(empty).count() == 0
    cleaned = pii.redact_documents(frame(spark, [row(1, "write to a.b@c.de now"), row(2, None)]))
    assert [(r["text"], r["n_chars"]) for r in cleaned.orderBy("doc_id").collect()] == [("write to [EMAIL] now", 20), (None, 0)]


# 8 mixing


def test_mixing_equals_sql(docs, tmp_path, empty):
    same(mixing.mixture_report(docs).collect(), oracle(docs, queries.MIX_SQL, tmp_path))
    assert mixing.mixture_report(empty).count() == 0


def test_mixing_of_sources_without_words(spark, tmp_path):
    rows = [row(1, "a b c", source="words"), row(2, None, source="empty"), row(3, "", source="empty"), row(4, " \n", source=None), row(5, "one", source="single")]
    got = mixing.mixture_report(frame(spark, rows)).collect()
    same(got, oracle(frame(spark, rows), queries.MIX_SQL, tmp_path))
    assert all(v is not None for r in got for v in r)
    assert {(r["source_size"], r["target"], r["taken"]) for r in got if r["doc_id"] in (2, 3, 4)} == {(0, 0.0, 0)}
    assert {r["doc_id"] for r in mixing.mix_documents(frame(spark, rows)).collect()} <= {1, 5}
    only = mixing.mixture_report(frame(spark, rows[1:4])).collect()
    assert [(r["source_size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 3


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows = [row(i, "w " * rng.randrange(0, 60), source="hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    got = mixing.mixture_report(frame(spark, rows))
    for r in got.groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r["target"]) <= 60
    assert got.where("taken > 2 * size").count() == 0
    mixed = mixing.mix_documents(frame(spark, rows))
    assert mixed.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == got.agg({"taken": "sum"}).first()[0]


# 9 toxicity


def test_toxicity_held_out(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    model = toxicity.train(docs, half)
    assert model.thresholds[0] < model.thresholds[1] and all(w >= 0 for w in model.weights.values())
    judged = [(r["toxic"], model.chances(r["text"])[0] >= toxicity.TOXIC_FROM) for r in docs.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()]
    caught = [p for t, p in judged if t]
    assert sum(caught) / len(caught) > 0.7 and sum(p for t, p in judged if not t) / len(judged) < 0.02


def test_toxicity_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.severity(docs, labels).collect()
    assert len(got) == docs.count() and not any(r["toxic"] for r in got) and all(r["grade"] == 0 for r in got)
    some = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(30)] + [(None, 1, 1), (5, None, None), (6, 1, 1)], "doc_id long, quality int, toxic int")
    texts = frame(spark, [row(i, ("vile " if i % 3 == 0 else "fine ") + "word") for i in range(30)] + [row(30, None), row(31, "vile")])
    got = {r["doc_id"]: r for r in toxicity.severity(texts, some).collect()}
    assert got[31]["toxic"] and not got[30]["toxic"] and got[31]["expected_severity"] > got[30]["expected_severity"]
    assert toxicity.severity(empty, some).count() == 0


def test_toxicity_likelihood_and_gradient_equal_brute_force():
    rng = np.random.default_rng(12)
    n, m = 40, 6
    grades = rng.integers(0, 3, n)
    has = rng.random((n, m)) < 0.3
    row_, column = np.nonzero(has)
    at = np.concatenate([rng.random(m), [0.7, -0.2]])

    def brute(x):
        cuts = [x[m], x[m] + np.exp(x[m + 1])]
        below = lambda k, i: 0.0 if k < 0 else 1.0 if k > 1 else 1 / (1 + np.exp(-(cuts[k] - sum(x[j] for j in range(m) if has[i, j]))))
        chances = [below(int(g), i) - below(int(g) - 1, i) for i, g in enumerate(grades)]
        return -sum(np.log(c) for c in chances) / n + toxicity.L2 / 2 * sum(w * w for w in x[:m])

    loss, gradient = toxicity.loss_and_gradient(grades, row_, column, at[:m], at[m:])
    assert abs(loss - brute(at)) < 1e-9
    for k in range(m + 2):
        step = np.zeros(m + 2)
        step[k] = 1e-5
        assert abs(gradient[k] - (brute(at + step) - brute(at - step)) / 2e-5) < 1e-6


def test_toxicity_severity_equals_brute_force(spark):
    rows = [(i % 3, f"{'vile' if i % 3 else 'fine'} {'awful' if i % 3 == 2 else 'word'} common") for i in range(90)]
    docs = frame(spark, [row(i, t) for i, (_, t) in enumerate(rows)])
    labels = spark.createDataFrame([(i, int(g != 2), int(g > 0)) for i, (g, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    for r in toxicity.severity(docs, labels).collect():
        words = set(rows[r["doc_id"]][1].split())
        words |= {w[:k] + "*" for w in words for k in (4, 6, 8) if len(w) > k}
        score = sum(w for f, w in model.weights.items() if f in words)
        at_most = [1 / (1 + np.exp(-(t - score))) for t in model.thresholds]
        chances = [at_most[0], at_most[1] - at_most[0], 1 - at_most[1]]
        assert abs(r["expected_severity"] - (chances[1] + 2 * chances[2])) < 1e-5
        assert r["grade"] == int(np.argmax(chances)) and r["toxic"] == (1 - chances[0] >= toxicity.TOXIC_FROM)


# 10 SentencePiece


@pytest.fixture(scope="module")
def codec():
    return sentpiece.Codec(sentpiece.load_pieces())


def _best_score(codec, pieces, stretch):
    """Best score over all segmentations, position by position."""
    scores = {p: s for p, s, k in pieces if k == "normal"}
    best = [0.0]
    for end in range(1, len(stretch) + 1):
        options = [best[start] + scores[stretch[start:end]] for start in range(end) if stretch[start:end] in scores]
        if stretch[end - 1] not in scores:
            options.append(best[end - 1] + codec.fallback)
        best.append(max(options))
    return best[-1]


def test_viterbi_finds_the_best_score(codec):
    pieces = sentpiece.load_pieces()
    rng = random.Random(9)
    for _ in range(200):
        stretch = "▁" * rng.randrange(1, 4) + "".join(rng.choice("abcdeistnorlu éß漢🙂.,\x0b") for _ in range(rng.randrange(12))).replace(" ", "▁")
        ids = codec.solve(stretch)
        total = sum(pieces[i][1] if pieces[i][2] == "normal" else 0 for i in ids)
        lone = sum(c not in codec.covered for c in stretch)
        assert abs(total + lone * codec.fallback - _best_score(codec, pieces, stretch)) < 1e-6


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁\n\tab")), max_size=40))
@settings(max_examples=500, deadline=None)
def test_every_text_decodes_again(text):
    found = _CODEC.encode(text)
    assert _CODEC.decode(found.tolist()) == text
    if "▁" not in text and text:
        whole = _CODEC.solve(("▁" + text).replace(" ", "▁"))
        score = lambda ids: sum(_PIECES[i][1] for i in ids)
        assert len(found) and abs(score(found.tolist()) - score(whole)) < 1e-6


_PIECES = sentpiece.load_pieces()
_CODEC = sentpiece.Codec(_PIECES)


def test_encoding_table(docs, empty):
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    encoded = sentpiece.encode_documents(docs)
    assert all(r["round_trip"] for r in encoded.collect())
    assert sorted(tuple(r) for r in sentpiece.decode_tokens(encoded).collect()) == texts
    assert sentpiece.encode_documents(empty).count() == 0
