"""Token ids on disk as directly addressable codes.

An id is split into chunks of bits, lowest first. Level 0 holds the first chunk of every id, level 1 the second chunk of those that have
more, and so on; a bitmap at each level says which ids continue, and a rank directory how many do before every 512th place. An id is then read
from its place alone: its chunk at level 0, and while its bit is set, the chunk at the next level whose place is the rank of that bit. No block is decoded for it.

A table of documents becomes segments of about ``SEGMENT_IDS`` ids in ascending order of document, dealt to shards by ranges of ids; a segment holds the codes, the ids of its documents and
where they end. Where a shard begins follows from the shards' sums, so the global place of every id is known without a pass over the codes.

Segment bytes: the number of levels as one byte; then for each level the width of its chunks in bits as one byte and the number of chunks as 8 bytes; then for each level
the chunks, packed with the high bit first, and for all levels but the last the bitmap with the low bit first and the directory as 4 bytes an entry. Whole numbers are little-endian.

Defined results: a null text counts as empty and yields the end id alone; rows with a null id come first; rows that repeat an id follow one another in
order of a hash of their texts, then the texts; a text longer than a segment is a segment of its own; an empty table gives an empty
result; further columns play no part, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stage, text_or_empty
from .tokens import VOCABULARY, batch_ids

WIDTHS = (10, 6, 16)
SEGMENT_IDS = 1 << 18
RANK_EVERY = 512
VALUES_AT_ONCE = 1 << 16  # a multiple of 8, so that packed parts end with whole bytes


def _packed(values: np.ndarray, width: int) -> bytes:
    out = []
    for k in range(0, len(values), VALUES_AT_ONCE):
        bits = np.unpackbits(values[k : k + VALUES_AT_ONCE].astype(">u4").view(np.uint8)).reshape(-1, 32)
        out.append(np.packbits(bits[:, 32 - width :]).tobytes())
    return b"".join(out)


def _unpacked(data: memoryview, width: int, begin: int, end: int) -> np.ndarray:
    """Chunks from ``begin`` to ``end``, read from the bytes that hold them."""
    first = begin * width // 8
    bits = np.unpackbits(np.frombuffer(data[first : (end * width + 7) // 8], np.uint8))[begin * width - first * 8 :][: (end - begin) * width]
    whole = np.zeros((end - begin, 32), np.uint8)
    whole[:, 32 - width :] = bits.reshape(-1, width)
    return np.packbits(whole).view(">u4").astype(np.uint32)


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The codes of ids below 2 to the power of the sum of ``widths``. Only levels that some id reaches are written."""
    rest, heads, parts = ids.astype(np.uint32), [], []
    for level, width in enumerate(widths):
        more = rest >> width if width < 32 else np.zeros_like(rest)
        goes_on = more > 0
        last = not goes_on.any()
        if not last and level + 1 == len(widths):
            raise ValueError(f"an id has more than {sum(widths)} bits")
        heads.append(struct.pack("<BQ", width, len(rest)))
        parts.append(_packed(rest & np.uint32((1 << width) - 1), width))
        if last:
            break
        parts += [np.packbits(goes_on, bitorder="little").tobytes(), np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_EVERY)).cumsum().astype("<u4").tobytes()]
        rest = more[goes_on]
    return bytes([len(heads)]) + b"".join(heads) + b"".join(parts)


class Codes:
    """Random access to encoded ids."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        count = view[0]
        self.levels, at = [], 1 + 9 * count
        for level in range(count):
            width, n = struct.unpack_from("<BQ", view, 1 + 9 * level)
            sizes = [(n * width + 7) // 8, (n + 7) // 8, -(-n // RANK_EVERY) * 4] if level + 1 < count else [(n * width + 7) // 8]
            pieces = []
            for size in sizes:
                pieces.append(view[at : at + size])
                at += size
            self.levels.append((width, n, *pieces))
        self.size = self.levels[0][1] if count else 0

    def __len__(self) -> int:
        return self.size

    def rank(self, level: int, place: int) -> int:
        """How many of the chunks before ``place`` go on at the next level."""
        _, _, _, bitmap, directory = self.levels[level]
        block = place // RANK_EVERY
        before = int.from_bytes(directory[4 * block - 4 : 4 * block], "little") if block else 0
        first = block * RANK_EVERY // 8
        bits = int.from_bytes(bitmap[first : (place + 7) // 8], "little") & ((1 << (place - first * 8)) - 1)
        return before + bits.bit_count()

    def id_at(self, place: int) -> int:
        """One id, from its own chunks and at most one entry of the directory and one block of the bitmap at each level."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        out = shift = 0
        for level, (width, _, chunks, *more) in enumerate(self.levels):
            first, last = place * width // 8, (place * width + width + 7) // 8
            raw = int.from_bytes(chunks[first:last], "big") >> (last * 8 - (place + 1) * width)
            out |= (raw & ((1 << width) - 1)) << shift
            if not more or not more[0][place >> 3] >> (place & 7) & 1:
                break
            place, shift = self.rank(level, place), shift + width
        return out

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to ``end``; what lies outside is not read."""
        out, shift, at = np.zeros(end - begin, np.uint32), 0, slice(None)
        for level, (width, _, chunks, *more) in enumerate(self.levels):
            if begin >= end:
                break
            out[at] |= _unpacked(chunks, width, begin, end) << np.uint32(shift)
            if not more:
                break
            first = begin // 8
            goes_on = np.unpackbits(np.frombuffer(more[0][first : (end + 7) // 8], np.uint8), bitorder="little")[begin - first * 8 :][: end - begin].astype(bool)
            at = np.flatnonzero(goes_on) if level == 0 else at[goes_on]
            begin = self.rank(level, begin)
            end, shift = begin + int(goes_on.sum()), shift + width
        return out


def _bounded(names: list, texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows with a bounded number of characters, a longer row alone or last."""
    first = size = 0
    for k, text in enumerate(texts):
        if size > chars:
            yield names[first:k], texts[first:k]
            first, size = k, 0
        size += len(text)
    if texts:
        yield names[first:], texts[first:]


def token_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, vocabulary: str = VOCABULARY, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """shard, first (ids before it in its shard), n, doc_ids, ends and codes, in ascending order of document by shard and first.

    To be written before it is read: shards are partitions of this very table. Texts move once, by ranges; ids don't move.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    end = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done, held, names, parts, sizes = TaskContext.get().partitionId(), 0, 0, [], [], []

        def segment(kind: pa.DataType) -> pa.RecordBatch:
            ids, ends = np.concatenate(parts), np.cumsum(sizes).astype("<i8")
            row = (shard, done, len(ids), names, ends.tobytes(), encode(ids, widths))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(kind), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], columns)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for some, texts in _bounded(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for name, own in zip(some, batch_ids(texts, vocabulary), strict=True):
                    if held and held + len(own) > SEGMENT_IDS:
                        yield segment(kind)
                        done, held, names, parts, sizes = done + held, 0, [], [], []
                    names.append(name)
                    parts += [own.astype(np.uint32), end]
                    sizes.append(len(own) + len(end))
                    held += sizes[-1]
        if names:
            yield segment(kind)

    columns = ["shard", "first", "n", "doc_ids", "ends", "codes"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return ordered.mapInArrow(write, f"shard long, first long, n long, doc_ids array<{id_type}>, ends binary, codes binary")


def with_starts(segments: DataFrame) -> DataFrame:
    """Written segments with ``start``, the ids of all documents before each. One row for each shard passes one task."""
    sums = segments.groupBy("shard").agg(F.sum("n").alias("sum"))
    base = F.coalesce(F.sum("sum").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.join(sums.select("shard", base.alias("base")), "shard").withColumn("start", F.col("base") + F.col("first"))


def read_documents(segments: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from its own part of the codes, and its ids (little-endian, 4 bytes each) if kept."""
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, start, raw_ends, data = (batch.column(c)[k] for c in ("doc_ids", "start", "ends", "codes"))
                codes, ends = Codes(data.as_py()), np.frombuffer(raw_ends.as_py(), "<i8")
                begins = np.append(0, ends[:-1])
                own = [codes.ids(b, e).astype("<u4").tobytes() for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = [names.values, pa.array(start.as_py() + begins), pa.array(ends - begins), pa.array(list(map(zlib.crc32, own)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(own, pa.binary())] if keep_ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids])

    placed = with_starts(segments).select("doc_ids", "start", "ends", "codes")
    return placed.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def ids_at(segments: DataFrame, positions: DataFrame, position_col: str = "position") -> DataFrame:
    """position and id for a table of global positions; those that hold no id are left out. Positions join the segments that their stretch of the stream lies in."""
    spread = F.explode(F.sequence(F.floor(F.col("start") / SEGMENT_IDS), F.floor((F.col("start") + F.col("n") - 1) / SEGMENT_IDS)))
    placed = with_starts(segments).where("n > 0").select("start", "n", "codes", spread.alias("stretch"))
    asked = positions.select(F.col(position_col).cast("long").alias("position")).withColumn("stretch", F.floor(F.col("position") / SEGMENT_IDS))
    # which segment holds each position is settled without the codes; each segment then gets its positions in parts of bounded size
    found = asked.join(placed.select("stretch", "start", "n"), "stretch").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n")))
    parts = found.groupBy("start", F.pmod(F.xxhash64("position"), F.lit(64)).alias("part")).agg(F.collect_set("position").alias("asked"))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, asked, data in zip(batch["start"], batch["asked"], batch["codes"], strict=True):
                codes = Codes(data)
                yield pd.DataFrame({"position": asked, "id": [codes.id_at(int(p) - start) for p in asked]})

    read = parts.join(with_starts(segments).where("n > 0").select("start", "codes"), "start").select("start", "asked", "codes")
    return asked.select("position").join(read.mapInPandas(look_up, "position long, id long"), "position")


def op12_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(stage(token_segments(docs), "token-codes"))


QUERIES = {"op12_direct_codes": op12_direct_codes}
ORACLES: dict[str, str] = {}
