"""Media columns: MPEG audio read and written inside Spark tasks.

The reader skips an ID3v2 and an ID3v1 tag, finds frame headers again wherever bytes between frames
break the chain, reads the variable-bitrate (Xing) table, verifies frame checksums, and keeps exact
durations and the byte offset of every frame for seeking. The writer stores any bytes losslessly in
the ancillary data at the end of silent Layer III frames, 576 bytes in each.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

# Fixed values of the format: bit rates in kbit/s by index, for MPEG-1 layers I to III and MPEG-2
# layer I and layers II/III; sample rates in Hz by version; samples in a frame.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

#: Payload bytes of a written frame.
UNIT = 576
FILL = 255
#: Bytes of the written tags.
ID3V1 = 128


@functools.lru_cache(maxsize=4096)
def header(four: bytes) -> tuple[int, int, int, int, int, int, bool] | None:
    """version (1 or 2), layer, rate, samples, length, side (bytes of side information), checked."""
    if len(four) < 4 or four[0] != 255 or four[1] & 0xE0 != 0xE0:
        return None
    bits, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if bits == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    version = 1 if bits == 3 else 2
    hz, samples, padding = RATES[bits][rate], SAMPLES[version, layer], four[2] >> 1 & 1
    slot = 4 if layer == 1 else 1
    length = (samples // 8 * 1000 * KBPS[version, layer][index] // hz // slot + padding) * slot
    mono = four[3] >> 6 == 3
    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return version, layer, hz, samples, length, side if layer == 3 else 0, not four[1] & 1


@functools.lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """Checksum of a frame: polynomial 0x8005, initial value 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _frame_head(kbps: int) -> bytes:
    """Header, checksum, empty side information and stuffing of a written frame: mono, 32 kHz."""
    head = bytes((255, 0xFA, KBPS[1, 3].index(kbps) << 4 | 2 << 2, 0xC0))
    side = bytes(17)
    length = header(head)[4]
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side + bytes(length - UNIT - 6 - 17)


def write(payload: bytes) -> bytes:
    """The payload, a multiple of 576 bytes, as an MPEG file with tags and a variable-bitrate table.

    Frames have 160 or 192 kbit/s, as the parity of their first payload byte asks.
    """
    heads = (_frame_head(160), _frame_head(192))
    chunks = [payload[i : i + UNIT] for i in range(0, len(payload), UNIT)]
    kinds = [c[0] & 1 for c in chunks]
    info = bytes((255, 0xFB, KBPS[1, 3].index(128) << 4 | 2 << 2, 0xC0))
    size = header(info)[4]
    ends = [size]
    for k in kinds:
        ends.append(ends[-1] + len(heads[k]) + UNIT)
    total, n = ends[-1], len(chunks)
    toc = bytes(min(255, ends[i * n // 100] * 256 // total) for i in range(100))
    xing = (info + bytes(17) + b"Xing" + struct.pack(">III", 7, n, total) + toc).ljust(size, b"\0")
    title = b"TIT2" + struct.pack(">IH", 9, 0) + b"\0document"
    tag = b"ID3\3\0\0" + bytes((0, 0, 0, len(title))) + title
    body = [x for k, c in zip(kinds, chunks, strict=True) for x in (heads[k], c)]
    return b"".join([tag, xing, *body, b"TAG" + b"document".ljust(ID3V1 - 3, b"\0")])


def checksum_holds(media: bytes, at: int, found: tuple) -> bool | None:
    """Whether a Layer III frame's checksum is right; None if it has none."""
    if not (found[6] and found[1] == 3):
        return None
    return crc16(media[at + 2 : at + 4] + media[at + 6 : at + 6 + found[5]]) == int.from_bytes(media[at + 4 : at + 6], "big")


def read_media(media: bytes) -> dict:
    """What the reader finds: payload (the last 576 bytes of each large enough frame), offsets of the
    frames, samples and rate, microseconds, resyncs, skipped bytes, failed checksums, tags and table."""
    start, stop = 0, len(media)
    tags = []
    if media[:3] == b"ID3" and len(media) >= 10:
        start = 10 + sum((b & 127) << s for b, s in zip(media[6:10], (21, 14, 7, 0), strict=True))
        tags.append("ID3v2")
    if stop - start >= ID3V1 and media[stop - ID3V1 : stop - ID3V1 + 3] == b"TAG":
        stop -= ID3V1
        tags.append("ID3v1")
    at, offsets, parts = start, [], []
    samples = resyncs = skipped = failed = checked = 0
    rate, table, bits, kinds = 0, None, 0, set()
    follows = False  # the last frame ended right here
    while at + 4 <= stop:
        found = header(media[at : at + 4])
        end = at + found[4] if found else 0
        good = found is not None and end <= stop
        if good and end + 4 <= stop:  # the next header vouches for a frame, or else its own checksum does, right behind another
            after = header(media[end : end + 4])
            vouched = after is not None and after[:3] == found[:3]
            good = vouched or follows and checksum_holds(media, at, found) is True
        if good and rate and found[2] != rate:
            good = False
        if not good:
            after = media.find(b"\xff", at + 1, stop)
            after = after if after >= 0 else stop
            skipped += after - at
            resyncs += follows or not offsets and at == start
            at, follows = after, False
            continue
        _, layer, rate, in_frame, length, side, _ = found
        follows = True
        if not offsets and table is None and layer == 3:
            mark = at + 4 + side
            if media[mark : mark + 4] in (b"Xing", b"Info"):
                flags, n, size = struct.unpack(">III", media[mark + 4 : mark + 16])
                table = (n, size, media[mark + 16 : mark + 116], at) if flags & 7 == 7 else (0, 0, b"", at)
                at = end
                continue
        if (holds := checksum_holds(media, at, found)) is not None:
            checked += 1
            failed += not holds
        offsets.append(at)
        samples += in_frame
        bits += length * 8
        kinds.add(length)
        if length >= UNIT + 6 + side:
            parts.append(media[end - UNIT : end])
        at = end
    right = table is not None and table[0] == len(offsets) and table[1] == stop - table[3] and list(table[2]) == sorted(table[2])
    return {
        "payload": b"".join(parts), "offsets": offsets, "samples": samples, "rate": rate, "microseconds": samples * 1_000_000 // rate if rate else 0,
        "bits": bits, "variable": len(kinds) > 1, "resyncs": resyncs, "skipped": skipped, "checked": checked, "failed": failed, "tags": tags, "table": right,
    }


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the UTF-8 form, and that form filled up to a positive multiple of 576 bytes."""
    data = (text or "").encode()
    return len(data), data + bytes([FILL]) * (-len(data) % UNIT if data else UNIT)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) stored as an MPEG file."""

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[at : at + SLICE] for b in batches for at in range(0, len(b), SLICE)):
            pairs = [payload_of(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [n for n, _ in pairs], "media": [write(p) for _, p in pairs]})

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string"), "text")
    out = rows.mapInPandas(stored, "doc_id string, n_bytes long, media binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


COLUMNS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frame_offsets array<long>, duration_us long"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
ARROW = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()]
#: Rows that a worker holds as texts and media at a time.
SLICE = 256


def probe(stored: DataFrame) -> DataFrame:
    """Reads media back: the input's columns but media, then the payload's size, digest and the CRC-32
    of its last 32 bytes, the media's size and digest, feature, frame_offsets and duration_us."""
    ship(stored.sparkSession)
    rest = [c for c in stored.columns if c != "media"]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            found = [probed_one(m) for m in batch.column("media").to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *columns], names=[*rest, *NAMES])

    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name != "media"], COLUMNS])
    return stored.mapInArrow(probed, out)


def probed_one(media: bytes | None) -> tuple:
    """What ``probe`` adds for one file; null media are read as an empty file."""
    media = media or b""
    x = read_media(media)
    p, n, us = x["payload"], len(x["offsets"]), x["microseconds"]
    feature = (
        f"frames={n};hz={x['rate']};samples={x['samples']};us={us};kbps={x['bits'] * 1000 // us if us else 0};vbr={int(x['variable'])};table={int(x['table'])};"
        f"crc={x['checked'] - x['failed']}/{x['checked']};resyncs={x['resyncs']};skipped={x['skipped']};tags={'+'.join(x['tags'])};"
        f"first={x['offsets'][0] if n else -1};last={x['offsets'][-1] if n else -1}"
    )
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, x["offsets"], us


def media_report(docs: DataFrame) -> DataFrame:
    """Stores every text and reads it back: doc_id, n_bytes, and what ``probe`` finds.

    Null and empty texts are one frame of fill bytes; equal texts get equal values; an empty table
    gives an empty result; other columns of ``docs`` are ignored.
    """
    return probe(store(docs))
