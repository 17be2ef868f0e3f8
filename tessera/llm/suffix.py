"""Removal of byte strings that repeat across documents, by distributed prefix doubling.

The rank of a 50-byte prefix is the pair of the 25-byte ranks at its first byte and 25 bytes on. A
rank is a 64-bit fingerprint of the bytes, so that equal prefixes have equal ranks in every task and
a pair has 128 bits.

Doubling every position would shuffle each byte of the corpus as a row. Positions that can't repeat
are left out first: of each 50-byte window the position with the least 25-byte rank is its anchor
(about one position in 13), equal windows have equal anchors. Spark deals the anchors by rank and
sorts them. An anchor whose rank is unique ends there. Anchors that agree on all bytes of all their
windows are decided at once: every document but the smallest loses them. Only where the surroundings
of equal anchors differ are the windows' rank pairs formed, dealt and sorted in turn, which decides
each window.

This departs from the plain form in three points, for the volume of its shuffles: the first ranks, of
25 bytes, are fingerprints and not places in a sorted list; one doubling follows; and most positions
are settled by their anchor's surroundings, without it. Rows travel packed into arrays, of which a
task sorts those of one shard in memory. Shards are as many as the bytes of all texts ask for, so a
shard's memory doesn't grow with the corpus. Texts, rows and results pass the workers in small
batches, as a long run leaves a worker and Arrow little beside a heap that is in full use.

Equal rows are combined in each task before they are dealt, and ranks with many different
surroundings are dealt by surroundings, so a passage that stands in many documents doesn't meet in
one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import mixed
from .shared import Tables, partitions, ship

#: Bytes of a repeat, and of the first ranks; a window has LENGTH - HALF + 1 of these.
LENGTH, HALF = 50, 25
#: Bytes that are ranked at a time, and rows that are combined before they are dealt.
PIECE, COMBINED = 1 << 18, 400_000
#: Bytes of text whose anchors fill a shard (one in 13, about 150 bytes each while they are sorted).
SHARD_BYTES = 8 << 20
#: Rows of texts that are Python objects at a time, and of results in a batch.
SLICE, RESULTS = 256, 1 << 16
#: While a table is written: batches of a bounded size, and shuffle files that go as soon as it stands,
#: not when the driver's JVM comes upon them (with many tasks that was after the next shuffles).
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

_random = np.random.default_rng(50_25)
_BYTES = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_random.integers(0, 2**62, dtype=np.uint64)) * 4 + 3
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for a worker's longest text."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Ranked:
    """Ranks of the substrings of some bytes."""

    def __init__(self, data: bytes) -> None:
        codes = np.frombuffer(data, dtype=np.uint8)
        powers, self.inverse = _powers_up_to(max(PIECE * 2, len(codes) + 1))
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[codes] * powers[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        """Ranks of all substrings of a length."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def anchors(data: bytes, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Anchors of the windows inside the bounds: rank, rank of all their windows' bytes, first window
    and number of windows more. ``data`` is shorter than 2**24 bytes."""
    if len(data) < LENGTH:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    ranked = Ranked(data)
    ranks = ranked.every(HALF)
    least = (ranks & ~_PLACE) | np.arange(len(ranks), dtype=np.uint64)
    width, wanted = 1, LENGTH - HALF + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    place = (least & _PLACE).astype(np.int64)
    valid = np.zeros(len(place) + 2, dtype=bool)
    for start, end in bounds:
        if end - start >= LENGTH:
            valid[start + 1 : end - LENGTH + 2] = True
    change = np.flatnonzero(place[1:] != place[:-1]) + 1
    begins = valid[1:-1] & ~valid[:-2]
    begins[change] |= valid[change + 1]
    ends = valid[1:-1] & ~valid[2:]
    ends[change - 1] |= valid[change]
    low, high = np.flatnonzero(begins), np.flatnonzero(ends)
    at = place[low]
    around = ranked.of(low, high + LENGTH) + (at - low).astype(np.uint64) * _SPREAD
    return ranks[at], mixed(around), low, high - low


def _pieces(docs: Iterator[tuple[int, int, str]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(doc_id, variant, offset, bytes) in lists of about PIECE bytes; longer texts are cut so that every
    window lies in one piece."""
    held, size = [], 0
    for doc_id, variant, text in docs:
        data = text.encode()
        for at in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
            part = data[at : at + PIECE + LENGTH - 1]
            held.append((doc_id, variant, at, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Whether a sorted row begins a new group of equal keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _settle(one: np.ndarray, two: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by both keys and document, where groups begin, and which rows have a smaller document in their group."""
    order = np.lexsort((docs, two, one))
    new = _groups(one[order], two[order])
    starts = np.flatnonzero(new)
    least = np.repeat(docs[order][starts], np.diff(np.append(starts, len(order))))
    return order, new, docs[order] > least


#: Columns of an anchor or window; a dealt row holds some of them as one array, byte by byte.
KINDS = {k: np.dtype(v) for k, v in {"one": "u8", "two": "u8", "doc": "i8", "variant": "i8", "low": "i4", "more": "u1", "mark": "u1"}.items()}
WIDTH = sum(kind.itemsize for kind in KINDS.values())
#: Routes: dealt by the first key, dealt by both, and rows that are decided already.
BY_ONE, BY_BOTH, DECIDED = 0, 1, 2
DEALT = "shard int, route int, held binary"


def _packed(rows: dict[str, np.ndarray], order: np.ndarray) -> np.ndarray:
    """The columns' first bytes, second ones and so on as WIDTH lines: the high ones compress to next to nothing."""
    out, at = np.empty((WIDTH, len(order)), np.uint8), 0
    for k, kind in KINDS.items():
        out[at : at + kind.itemsize] = rows[k][order].view(np.uint8).reshape(-1, kind.itemsize).T
        at += kind.itemsize
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[int, dict[str, np.ndarray]]:
    """The route and the columns of a group."""
    route, parts = DECIDED, []
    for batch in batches:
        route = batch.column("route")[0].as_py()
        parts += [np.frombuffer(x.as_buffer(), np.uint8).reshape(WIDTH, -1) for x in batch.column("held")]
    whole, at, rows = np.concatenate(parts, axis=1), 0, {}
    parts.clear()
    for k, kind in KINDS.items():
        rows[k] = np.ascontiguousarray(whole[at : at + kind.itemsize].T).view(kind).ravel()
        at += kind.itemsize
    return route, rows


def _deal(rows: dict[str, np.ndarray], chosen: np.ndarray, shard: np.ndarray, route: int) -> pa.RecordBatch:
    """The chosen rows as one array for each shard."""
    at = np.flatnonzero(chosen)
    shard = shard[at]
    order = np.argsort(shard, kind="stable")
    shard, held = shard[order], _packed(rows, at[order])
    cuts = np.append(np.flatnonzero(_groups(shard)), len(shard))
    flat = np.empty(held.size, np.uint8)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        flat[WIDTH * a : WIDTH * b].reshape(WIDTH, -1)[:] = held[:, a:b]
    arrays = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * WIDTH).astype(np.int32)), pa.py_buffer(flat)])
    return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]], pa.int32()), pa.array(np.full(len(cuts) - 1, route), pa.int32()), arrays], names=["shard", "route", "held"])


def _combined(rows: dict[str, np.ndarray], shards: int, by_first: bool) -> Iterator[pa.RecordBatch]:
    """Combines a task's rows and deals what is left."""
    order, new, covered = _settle(rows["one"], rows["two"], rows["doc"])
    for k in KINDS:
        rows[k] = rows[k][order]
    group = np.cumsum(new)
    if by_first:
        first = _groups(rows["one"])
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(first)) - 1
        many = np.repeat(group[starts] != group[ends], ends - starts + 1)  # this rank has several surroundings here
        leader = group == np.repeat(group[starts], ends - starts + 1)
        rows["mark"] = many.astype(np.uint8)
    else:
        leader = np.zeros(len(group), dtype=bool)
    deal = lambda chosen, key, route: _deal(rows, chosen, (key % np.uint64(shards)).astype(np.int32), route)
    if (~covered & leader).any():
        yield deal(~covered & leader, rows["one"], BY_ONE)
    if (~covered & ~leader).any():
        yield deal(~covered & ~leader, mixed(rows["one"] ^ rows["two"] * _SPREAD), BY_BOTH)
    if covered.any():
        yield deal(covered, mixed(rows["doc"].astype(np.uint64)), DECIDED)


def _gathered(parts: Iterator[dict[str, np.ndarray]], shards: int, by_first: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def taken() -> dict[str, np.ndarray]:
        rows = {k: np.concatenate([x.pop(k) for x in held]).astype(kind, copy=False) for k, kind in KINDS.items()}
        held.clear()
        return rows

    for part in parts:
        held.append(part)
        size += len(part["one"])
        if size >= COMBINED:
            yield from _combined(taken(), shards, by_first)
            size = 0
    if size:
        yield from _combined(taken(), shards, by_first)


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of some columns as Python objects, of which few exist at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def deal_anchors(docs: DataFrame, shards: int) -> DataFrame:
    """The anchors of all texts, combined in each task, dealt by rank."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for pieces in _pieces(_rows(batches, "doc_id", "variant", "text")):
            cuts = np.cumsum([0, *[len(p[-1]) for p in pieces]])
            rank, around, low, more = anchors(b"".join(p[-1] for p in pieces), list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)))
            which = np.searchsorted(cuts, low, side="right") - 1
            ids, variants, offsets = (np.array([p[k] for p in pieces], dtype=np.int64) for k in range(3))
            low = (low - cuts[which] + offsets[which]).astype(np.int32)
            yield {"one": rank, "two": around, "doc": ids[which], "variant": variants[which], "low": low, "more": more.astype(np.uint8), "mark": np.zeros(len(low), np.uint8)}

    return docs.mapInArrow(lambda batches: _gathered(parts(batches), shards, True), DEALT)


def deal_windows(docs: DataFrame, shards: int) -> DataFrame:
    """The rank pairs of the windows in ``open`` (low, more) of each text, combined in each task, dealt by pair."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for doc_id, variant, text, low, more in _rows(batches, "doc_id", "variant", "text", "low", "more"):
            data = text.encode()
            low, more = np.array(low, dtype=np.int64), np.array(more, dtype=np.int64)
            count = more + 1
            every = np.unique(np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum()))
            for start in range(0, len(data) - LENGTH + 1, PIECE):
                at = every[slice(*np.searchsorted(every, (start, start + PIECE)))]
                if not len(at):
                    continue
                ranked, place = Ranked(data[start : start + PIECE + LENGTH - 1]), at - start
                none = np.zeros(len(at), np.uint8)
                yield {"one": ranked.of(place, place + HALF), "two": ranked.of(place + HALF, place + LENGTH), "doc": np.full(len(at), doc_id, np.int64), "variant": np.full(len(at), variant, np.int64), "low": at.astype(np.int32), "more": none, "mark": none}

    return docs.mapInArrow(lambda batches: _gathered(parts(batches), shards, False), DEALT)


def decide(dealt: DataFrame) -> DataFrame:
    """doc_id, variant, covered, low, more: for dealt rows, whether a smaller document has the same bytes; rows
    that are still open only if their rank has other surroundings somewhere."""

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, x = _unpacked(batches)
        if route == DECIDED:
            order, covered = np.arange(len(x["doc"])), np.ones(len(x["doc"]), dtype=bool)
        else:
            order, new, covered = _settle(x["one"], x.pop("two"), x["doc"])
            if route == BY_ONE:
                first = _groups(x["one"][order])
                starts = np.flatnonzero(first)
                sizes = np.diff(np.append(starts, len(order)))
                several = np.add.reduceat(new.astype(np.int64), starts) > 1
                wanted = covered | np.repeat(several | (np.maximum.reduceat(x["mark"][order], starts) > 0), sizes)
                order, covered = order[wanted], covered[wanted]
        for at in range(0, len(order), RESULTS):
            k = order[at : at + RESULTS]
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"][k]), pa.array(x["variant"][k]), pa.array(covered[at : at + RESULTS]), pa.array(x["low"][k]), pa.array(x["more"][k].astype(np.int32))], names=["doc_id", "variant", "covered", "low", "more"])

    return dealt.groupBy("shard", "route").applyInArrow(decided, "doc_id long, variant long, covered boolean, low int, more int")


def with_variants(docs: DataFrame, tables: Tables) -> tuple[DataFrame, int]:
    """``docs`` with variant, which tells the texts of one doc_id apart, and the bytes of all texts.

    The variant is 0 where a doc_id has one text, as nearly all have, else a hash of the text.
    """
    each = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"), F.max(F.xxhash64("text")).alias("most"), F.sum(F.octet_length("text")).alias("bytes"))
    each = tables.keep(each, "sizes")
    several = tables.keep(each.where("doc_id is not null and least <> most").select(F.col("doc_id").alias("_several")), "several")
    if several.isEmpty():
        marked = docs.withColumn("variant", F.lit(0).cast("long"))
    else:
        marked = docs.join(several, F.col("doc_id") == F.col("_several"), "left")
        marked = marked.withColumn("variant", F.when(F.col("_several").isNull(), 0).otherwise(F.xxhash64("text"))).drop("_several")
    return marked, each.agg(F.sum("bytes")).first()[0] or 0


def find_repeats(docs: DataFrame, tables: Tables, n_bytes: int) -> DataFrame:
    """doc_id, variant, low, high: byte ranges of each document that also stand in a smaller one."""
    shards = max(partitions(docs.sparkSession), -(-n_bytes // SHARD_BYTES))
    key = ["doc_id", "variant"]
    long = docs.where(F.octet_length("text") >= LENGTH)
    anchored = tables.keep(decide(deal_anchors(long, shards)), "anchors")
    still = anchored.where(~F.col("covered")).groupBy(*key).agg(F.collect_list("low").alias("low"), F.collect_list("more").alias("more"))
    windows = tables.keep(decide(deal_windows(long.join(still, key).select(*key, "text", "low", "more"), shards)).where("covered").select(*key, "low"), "windows")
    return (
        anchored.where("covered").select(*key, "low", (F.col("low") + F.col("more") + LENGTH).alias("high"))
        .unionByName(windows.select(*key, "low", (F.col("low") + LENGTH).alias("high")))
    )


def _runs(low: list[int] | None, high: list[int] | None, n: int) -> list[tuple[int, int]]:
    """Maximal runs that ranges cover, in order, cut to n bytes."""
    if low is None:
        return []
    low, high = np.array(low, dtype=np.int64), np.minimum(np.array(high, dtype=np.int64), n)
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.append(True, low[1:] > reach[:-1])
    starts = np.flatnonzero(new)
    return list(zip(low[starts].tolist(), reach[np.append(starts[1:], len(low)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left).

    Null texts count as empty. Texts under 50 bytes lose nothing. Rows without doc_id are no document:
    nothing is removed from them or because of them. Rows that share a doc_id are one document: none of
    them loses what stands in another of them only, and each is judged by its own text. Texts are read
    whole, long ones in pieces that overlap. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = ship(docs.sparkSession)
    tables = Tables(spark, "suffix", WRITING)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs, n_bytes = with_variants(docs, tables)
    ranges = find_repeats(docs.where("doc_id is not null"), tables, n_bytes)
    by_doc = tables.keep(ranges.groupBy("doc_id", "variant").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")), "ranges")
    tables.drop("anchors", "windows", "sizes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = []
                for text, low, high in zip(*[batch.column(c).to_pylist() for c in ("text", "low", "high")], strict=True):
                    data = text.encode()
                    runs = _runs(low, high, len(data))
                    edges = [0, *[x for r in runs for x in r], len(data)]
                    rows.append((len(data), sum(b - a for a, b in runs), len(runs), b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.join(by_doc, ["doc_id", "variant"], "left").select("doc_id", "text", "low", "high").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes)."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
