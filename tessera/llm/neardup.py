"""Near-duplicates: MinHash bands name candidates, odd sketches sift them, full sets confirm them.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Documents with equal sets are
one class with its smallest doc_id as representative; only representatives are compared. 240 MinHash
samples of a set are cut into 48 bands of 5, and the samples are folded into an odd sketch: a bitmap
of 512 parities. Representatives that share a band are candidates; the number of ones in the XOR of
two sketches estimates the similarity, and pairs far below the threshold are dropped. The others are
confirmed on the full sets of their whole texts.

No bucket is expanded into all of its pairs. Every member first meets the bucket's smallest one. Then
only members of different components are compared, in blocks of bounded size: where sketches look
alike, the document of the smaller component visits the larger one, whose members it meets in blocks
as well, on full sets. Keys that hold many rows - a bucket, a pivot, a component, a set - are dealt to
several tasks. The chance that a pair shares no band is about 2.3e-6 at
the threshold, and 5e-9 at a similarity of 0.8. The sketch drops a pair at the threshold with a chance of
1.1e-6, so a link is missed with about 3.3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .dealing import dealt_join, hot_keys
from .shared import Tables, ship

#: Words in a shingle, and the similarity in percent from which documents are linked.
SHINGLE, PERCENT = 5, 75
#: Bands and samples in a band; bits of the odd sketch.
BANDS, ROWS, SKETCH_BITS = 48, 5, 512
SAMPLES = BANDS * ROWS
#: Candidates below this estimate are dropped: 1.1e-6 of the pairs at the threshold (7e-9 at 0.5, 7e-5 at 0.6).
LEAST_ESTIMATE = 0.55
#: Buckets up to this size are joined with themselves; larger ones are compared in blocks of so many
#: sketches (of 64 bytes): a row is copied once for each block of its bucket.
SMALL_BUCKET, BLOCK = 16, 8192
#: Shingles (of 8 bytes) of a component's members, or of its visitors, that meet in a task.
WEIGHT = 1 << 20
#: Words that a worker remembers; shingles that are sampled at a time.
MAX_REMEMBERED, CHUNK = 300_000, 2048

_random = np.random.default_rng(20_240_229)
_FACTORS = (_random.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _random.integers(0, 2**32, SAMPLES, dtype=np.uint32)[:, None]
_PLACES = _random.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSET = _random.integers(0, 2**63, BANDS, dtype=np.uint64)
_SAMPLE = _random.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MAX_REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_words = _Words()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; one for a shorter sequence; none without words.

    Bytes are lower-cased and split as the rule asks: A-Z and ASCII white space only.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(len(found) - SHINGLE + 1, 1)
    total = np.full(n, min(len(found), SHINGLE), dtype=np.uint64)
    for i in range(min(len(found), SHINGLE)):
        total += mixed(hashes[i : i + n]) * _PLACES[i]
    return np.unique(mixed(total))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd sketch (8 numbers of 64 bits) and band hashes of a set that isn't empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(low), CHUNK):
        np.minimum(least, (low[i : i + CHUNK] * _FACTORS + _SHIFTS).min(axis=1), out=least)
    wide = least.astype(np.uint64)
    bits = (mixed(wide * _SAMPLE + _SAMPLE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    sketch = np.packbits((np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)
    bands = mixed((wide.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + _OFFSET).view(np.int64)
    return sketch, bands


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are linked: 100 * intersection >= 75 * union, neither of them empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), set_key (digest of the set), sketch and bands of each row."""
    import xxhash

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, keys, sketches, bands = [], [], [], []
                for text in batch.column("text").to_pylist():
                    hashes = shingle_set(text)
                    sizes.append(len(hashes))
                    keys.append(xxhash.xxh128_digest(hashes.tobytes()))
                    sketch, band = signature(hashes) if len(hashes) else (None, None)
                    sketches.append(sketch)
                    bands.append(band)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "set_key", "sketch", "bands"],
                )

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(signed, f"doc_id {kind}, n long, set_key binary, sketch array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity that two odd sketches suggest: SAMPLES differences in all would be none in common."""
    ones = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))
    rest = F.greatest(1 - 2 * ones / F.lit(float(SKETCH_BITS)), F.lit(1e-9))
    return 1 + SKETCH_BITS / (4.0 * SAMPLES) * F.log(rest)


def _sifted(pairs: DataFrame, sketches: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The pairs (a, b) whose sketches suggest a link, with the estimate."""
    pairs = tables.keep(pairs, f"{name}-pairs")
    one, other = (sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    return dealt_join(pairs, one, "a", "b", hot_keys(pairs, "a", tables, f"{name}-hot")).join(other, "b").select("a", "b", estimate(F.col("sa"), F.col("sb")).alias("estimate")).where(F.col("estimate") >= LEAST_ESTIMATE)


def _confirmed(pairs: DataFrame, docs: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The pairs (a, b) that are linked, decided on the sets of their whole texts.

    ``pairs`` is a written table. Rows that share a doc_id but not a text have a row per text and meet
    with all of them.
    """

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if text not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[text] = shingle_set(text)
            return sets[text]

        for batch in batches:
            good = [similar(of(x), shingle_set(y)) for x, y in zip(batch["text_a"], batch["text_b"], strict=True)]
            yield batch.loc[np.array(good, dtype=bool), ["a", "b"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    one, other = (docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    # the texts of b are the many ones: they move once to b and once to a
    moved = dealt_join(pairs.select("a", "b").join(other, "b"), one, "a", "b", hot_keys(pairs, "a", tables, f"{name}-hot"))
    return moved.select("a", "b", "text_a", "text_b").mapInPandas(confirm, f"a {kind}, b {kind}")


def _relabelled(labels: DataFrame, links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Labels after more links between nodes, known or not."""
    between = _labelled(_labelled(links, labels, "a", "a"), labels, "b", "b").select("a", "b")
    joined = tables.keep(components(between, tables, f"{name}-links").select(F.col("node").alias("old"), F.col("label").alias("new")), f"{name}-joined")
    moved = dealt_join(labels, joined.withColumnRenamed("old", "label"), "label", "node", hot_keys(labels, "label", tables, f"{name}-hot"), "left")
    moved = moved.select("node", F.coalesce("new", "label").alias("label"))
    fresh = joined.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return tables.keep(moved.unionByName(fresh), name)


def _labelled(frame: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Adds (or replaces) a column with the label of a node; a node without links is its own label."""
    found = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return frame.join(found, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", column)).drop("_node", "_label")


def _towards(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """visitor, label: of each pair (a, b, label_a, label_b), the document of the smaller component
    and the label of the larger one, each such visit once."""
    one, other = (sizes.select(F.col("label").alias(f"label_{x}"), F.col("members").alias(f"members_{x}")) for x in "ab")
    sized = pairs.join(one, "label_a", "left").join(other, "label_b", "left").fillna(1, ["members_a", "members_b"])
    onward = F.struct("members_a", "label_a") < F.struct("members_b", "label_b")
    return sized.select(F.when(onward, F.col("a")).otherwise(F.col("b")).alias("visitor"), F.when(onward, F.col("label_b")).otherwise(F.col("label_a")).alias("label")).distinct()


def _visits(shared: DataFrame, hot_buckets: DataFrame, labels: DataFrame, sketches: DataFrame, tables: Tables) -> DataFrame:
    """visitor, label: documents that share a bucket and an alike sketch with a member of another component.

    Buckets whose members all have one label are done. A larger one is dealt into blocks by hash; each
    task compares two blocks' sketches and emits visits, not pairs.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    sized = dealt_join(labels, sizes, "label", "node", hot_keys(labels, "label", tables, "visits-hot")).select(F.col("node").alias("doc_id"), "label", "members")
    known = shared.where("size > 2").join(sized, "doc_id", "left").withColumns({"label": F.coalesce("label", "doc_id"), "members": F.coalesce("members", F.lit(1))})
    mixed_buckets = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    open_rows = dealt_join(known.where("doc_id <> pivot"), mixed_buckets, "bucket", "doc_id", hot_buckets)
    open_rows = tables.keep(open_rows.select("bucket", "doc_id", "size", "label", "members"), "open")
    few, many = open_rows.where(F.col("size") <= SMALL_BUCKET), open_rows.where(F.col("size") > SMALL_BUCKET)
    one, other = (few.select("bucket", F.col("doc_id").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    pairs = tables.keep(one.join(other, "bucket").where("a < b and label_a <> label_b").select("a", "b", "label_a", "label_b").distinct(), "few")
    near = _towards(pairs.join(_sifted(pairs.select("a", "b"), sketches, tables, "few").select("a", "b"), ["a", "b"], "left_semi"), sizes)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] != 1], rows[rows["side"] != 0]
        found = []
        words, marks = np.array(right["sketch"].tolist(), dtype=np.int64).reshape(-1, SKETCH_BITS // 64).view(np.uint64), right["label"].to_numpy()
        ids, members = right["doc_id"].to_numpy(), right["members"].to_numpy()
        ones_most = SKETCH_BITS / 2 * (1 - np.exp(4.0 * SAMPLES / SKETCH_BITS * (LEAST_ESTIMATE - 1)))
        for sketch, label, doc_id, size in zip(left["sketch"], left["label"], left["doc_id"], left["members"], strict=True):
            ones = np.bitwise_count(words ^ np.asarray(sketch, dtype=np.int64).view(np.uint64)).sum(axis=1, dtype=np.int64)
            good = (ones <= ones_most) & (marks != label)
            onward = good & ((members > size) | ((members == size) & (marks > label)))
            found += [(doc_id, x) for x in np.unique(marks[onward])]
            found += [(x, label) for x in ids[good & ~onward]]
        return pd.DataFrame(found, columns=["visitor", "label"]).drop_duplicates()

    kind = shared.schema["doc_id"].dataType.simpleString()
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = many.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).join(sketches, "doc_id")
    dealt = dealt.select("bucket", "doc_id", "label", "members", "sketch", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    dealt = dealt.select("bucket", "doc_id", "label", "members", "sketch", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), F.when(F.col("block") == F.col("with"), 2).when(F.col("block") < F.col("with"), 0).otherwise(1).alias("side"))
    return near.unionByName(dealt.groupBy("bucket", "i", "j").applyInPandas(compare, f"visitor {kind}, label {kind}")).distinct()


def _met(visits: DataFrame, labels: DataFrame, docs: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) between visitors and members of the components that they visit, on full sets.

    Members and visitors of a component meet in blocks of bounded weight, as the sizes of their ``sets``
    (doc_id, n) give it; a block counts a visitor's common shingles with all of its members at once, and
    emits one link of it at most.
    """
    visits = tables.keep(visits.withColumnRenamed("visitor", "doc_id").join(sets, "doc_id"), "visits")
    blocks = F.greatest(F.ceil(F.sum("n") / WEIGHT), F.lit(1)).cast("int")
    visited = tables.keep(visits.groupBy("label").agg(blocks.alias("j_blocks")), "visited")
    hosts = labels.join(visited.select("label"), "label", "left_semi").select("label", F.col("node").alias("doc_id"))
    lone = visited.join(labels.select("label").distinct(), "label", "left_anti").select("label", F.col("label").alias("doc_id"))
    hosts = tables.keep(hosts.unionByName(lone).join(sets, "doc_id"), "hosts")
    counts = tables.keep(hosts.groupBy("label").agg(blocks.alias("i_blocks")).join(visited, "label"), "counts")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at_home = dealt_join(hosts, counts, "label", "doc_id", hot_keys(hosts, "label", tables, "hosts-hot"))
    at_home = at_home.select("label", "doc_id", block("i_blocks").alias("i"), "j_blocks").select("label", "doc_id", "i", every("j_blocks").alias("j"), F.lit(0).alias("side"))
    coming = dealt_join(visits, counts, "label", "doc_id", hot_keys(visits, "label", tables, "visitors-hot"))
    coming = coming.select("label", "doc_id", block("j_blocks").alias("j"), "i_blocks").select("label", "doc_id", every("i_blocks").alias("i"), "j", F.lit(1).alias("side"))
    rows = at_home.unionByName(coming.select("label", "doc_id", "i", "j", "side")).join(docs, "doc_id")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        hosts, guests = rows[rows["side"] == 0], rows[rows["side"] == 1]
        sets = [shingle_set(t) for t in hosts["text"]]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        hashes, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        found, ids = [], hosts["doc_id"].to_numpy()
        for doc_id, text in zip(guests["doc_id"], guests["text"], strict=True):
            own = shingle_set(text)
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            times = high - low
            at = np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            linked = np.flatnonzero((both > 0) & (100 * both >= PERCENT * (sizes + len(own) - both)))
            found += [(doc_id, ids[x]) for x in linked[:1]]
        return pd.DataFrame(found, columns=["a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("label", "i", "j", "side", "doc_id", "text").groupBy("label", "i", "j").applyInPandas(meet, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and empty texts have empty sets and are linked with nothing. Rows that share a doc_id are one
    document; rows without doc_id are linked with nothing and kept. Equal texts are always linked. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "neardup")
    docs = docs.select("doc_id", "text")
    signed = tables.keep(signatures(docs), "signatures")
    usable = signed.where("n > 0 and doc_id is not null")
    classes = tables.keep(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    hot = hot_keys(classes, "set_key", tables, "classes-hot", "n")
    classes = classes.drop("n")
    named = dealt_join(usable.select("doc_id", "n", "set_key"), classes, "set_key", "doc_id", hot).select("doc_id", "n", "rep")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", "n")
    members = tables.keep(named, "members")
    alone = tables.keep(alone, "alone")
    firsts = usable.join(classes.withColumnRenamed("set_key", "key"), (F.col("set_key") == F.col("key")) & (F.col("doc_id") == F.col("rep")), "left_semi")
    firsts = tables.keep(firsts.select("doc_id", "n", "sketch", "bands"), "firsts")
    tables.drop("signatures")
    sketches = firsts.select("doc_id", "sketch")

    banded = firsts.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = tables.keep(banded.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets")
    hot_buckets = hot_keys(buckets, "bucket", tables, "buckets-hot", "n")
    shared = tables.keep(dealt_join(banded, buckets.withColumnRenamed("n", "size"), "bucket", "doc_id", hot_buckets), "shared")
    pairs = shared.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = tables.keep(_sifted(pairs, sketches, tables, "stars"), "stars")
    # a document's likeliest pivot first: most documents need no other
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a"))
    best = tables.keep(best.select("a", "b"), "best")
    labels = tables.keep(components(_confirmed(best, docs, tables, "best"), tables, "first"), "labels-1")

    rest = stars.join(best, ["a", "b"], "left_anti")
    rest = tables.keep(_labelled(_labelled(rest, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b"), "rest")
    labels = _relabelled(labels, _confirmed(rest, docs, tables, "rest"), tables, "labels-2")
    visits = _visits(shared, hot_buckets, labels, sketches, tables)
    labels = _relabelled(labels, _met(visits, labels, docs, firsts.select("doc_id", "n"), tables), tables, "labels-3")

    # rows that share a doc_id but not a text may belong to several classes
    classes_of = members.where("doc_id <> rep").select(F.col("doc_id").alias("node"), F.col("rep")).distinct()
    doubled = classes_of.groupBy("node").agg(F.count("*").alias("times")).where("times > 1").select("node")
    own = members.where("rep = doc_id").select(F.col("doc_id").alias("node")).distinct()
    both = classes_of.join(own, "node", "left_semi").select("node").unionByName(doubled).distinct()
    extra = classes_of.join(both, "node").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    labels = _relabelled(labels, extra, tables, "labels-4")
    tables.drop("classes", "firsts", "buckets", "shared", "stars-pairs", "stars", "best", "rest", "open", "few", "few-pairs", "visits", "visited", "hosts", "counts")
    tables.drop("labels-1", "labels-2", "labels-2-joined", "labels-3", "labels-3-joined", "labels-4-joined")
    owned = labels.select(F.col("node").alias("rep"), F.col("label").alias("component_id"))
    named = dealt_join(members, owned, "rep", "doc_id", hot_keys(members, "rep", tables, "members-hot"), "left")
    named = named.select("doc_id", "n", F.least(F.coalesce("component_id", "rep"), "doc_id").alias("component_id"))
    named = named.unionByName(alone.withColumn("component_id", F.col("doc_id")))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is its component's smallest, all columns as they were.

    Rows without doc_id, text or words stay; long texts are compared whole; repeated rows of a kept
    document all stay; an empty table stays empty.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
