"""Lines that repeat across documents, found with two Bloom filters and confirmed exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.bitmap import bitmap_of, bits_for, marked
from cuelake.staging import written

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BITS = 1 << 16
BLOOM_SCHEMA = "slice int, once binary, twice binary"


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    h = hashes.view(np.uint64)
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(33)) & np.uint64(bits - 1)).astype(np.int64)


def _bits_at(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1


def _packed(bits: np.ndarray) -> bytes:
    """Positions (uint16) where that is shorter, else the bitmap."""
    at = np.flatnonzero(bits).astype(np.uint16).tobytes()
    return b"p" + at if len(at) < SLICE_BITS // 8 else b"b" + np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"b":
        return np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).view(bool)
    out = np.zeros(SLICE_BITS, bool)
    out[np.frombuffer(data, np.uint16, offset=1)] = True
    return out


def _bloom_rows(filters: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for k, once, twice in filters:
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "once": [_packed(once)], "twice": [_packed(twice)]})


def fill(bits: int):
    """Per task: bits of hashes seen once and of those seen twice, as one row per slice that is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            a, b = _places(hashes, bits)
            again = (counts > 1) | (_bits_at(once, a) & _bits_at(once, b)).astype(bool)
            for places, bitmap in ((a[again], twice), (b[again], twice), (a, once), (b, once)):
                np.bitwise_or.at(bitmap, places >> 3, (128 >> (places & 7)).astype(np.uint8))
        parts = once.reshape(-1, SLICE_BITS // 8), twice.reshape(-1, SLICE_BITS // 8)
        slices = np.flatnonzero(parts[0].any(axis=1)).tolist()
        yield from _bloom_rows((k, *(np.unpackbits(p[k]).view(bool) for p in parts)) for k in slices)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of many tasks to one each. A bit that two tasks have set once counts as set twice."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for k, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = _unpacked(once), _unpacked(twice)
            if k in held:
                seen, again = held[k]
                again |= y | (seen & x)
                seen |= x
            else:
                held[k] = x.copy(), y.copy()
    yield from _bloom_rows((k, *v) for k, v in held.items())


def repeat_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of hashes that may occur twice, packed: bits / 8 bytes whatever the input."""
    return merged_filter(hashes.mapInArrow(fill(bits), BLOOM_SCHEMA), bits)


def merged_filter(filters: DataFrame, bits: int) -> np.ndarray:
    """The filter of what tasks have seen twice, or two of them once.

    Bloom filters of the tasks travel as slices, so merging is spread over the cluster and each
    merging task holds its slices only; the merged filter is the only thing sent to the driver.
    """
    merged = filters.repartition("slice").mapInArrow(_merge, BLOOM_SCHEMA)
    full = np.zeros((bits // SLICE_BITS, SLICE_BITS // 8), np.uint8)
    for row in merged.select("slice", "twice").toLocalIterator():
        full[row["slice"]] = np.packbits(_unpacked(bytes(row["twice"])))
    return full.reshape(-1)


def suspected(shared: Broadcast, bits: int):
    """A function of a column of hashes: whether the broadcast filter says that they may repeat."""

    return F.pandas_udf(lambda hashes: pd.Series(may_repeat(shared.value, hashes.to_numpy(), bits)), "boolean")


def may_repeat(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    a, b = _places(hashes, bits)
    return (_bits_at(bitmap, a) & _bits_at(bitmap, b)).astype(bool)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, filter_bits: int = 1 << 26) -> DataFrame:
    """One row per id that loses lines: id, drop_keys (xxhash64 of the keys of its dropped lines)."""
    lines = docs.select(F.col(id_col).alias("_id"), F.explode(lines_of(F.col(text_col))).alias("_line"))
    trimmed = lines.select("_id", F.btrim("_line", F.lit(WHITE)).alias("_line")).where(F.length("_line") >= min_chars)
    # the filters see full lower-casing, which is cheaper and only ever makes more lines alike
    keys = trimmed.withColumn("_rough", F.xxhash64(F.lower("_line")))

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(repeat_filter(keys.select("_rough"), filter_bits))

    suspects = keys.where(suspected(shared, filter_bits)("_rough")).withColumn("_key", line_key(F.col("_line")))
    suspects = suspects.select("_id", F.xxhash64("_key").alias("_hash"), F.unhex(F.sha2("_key", 256)).alias("_sha")).distinct()
    suspects = written(suspects, "lines-suspects")
    confirmed = suspects.groupBy("_sha").agg(F.count("*").alias("n"), F.max("_id").alias("_keep")).where(F.col("n") >= min_docs)
    confirmed = written(confirmed.select("_sha", "_keep"), "lines-confirmed")
    drops = suspects.join(confirmed, "_sha").where(~F.col("_id").eqNullSafe(F.col("_keep")))
    return drops.groupBy("_id").agg(F.collect_set("_hash").alias("drop_keys")).withColumnRenamed("_id", id_col)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, filter_bits: int = 1 << 26) -> DataFrame:
    """One row per input row: id, kept_text, n_lines, n_dropped.

    Keys (`line_key`) of at least `min_chars` code points found in at least `min_docs` documents lose
    all their lines except in the document with the largest id. A first pass sets Bloom filters of
    once-seen and twice-seen keys; a second shuffles only keys that may repeat, as SHA-256, to count
    their documents exactly. A key of a third of all documents is counted by (key, document), then by
    key with partial sums. Texts stay where they are but for those that lose lines, which meet their
    keys by id. Bounds: `filter_bits` / 8 bytes are broadcast, one document's dropped
    keys are gathered at a time. More bits mean fewer false suspects, never another result.

    Null or empty text is one empty line. Rows that share an id count as one document. A null id
    counts as one document, never the largest. An empty table gives no rows.
    """
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs, filter_bits).withColumnRenamed(id_col, "_id")
    drops = written(drops, "lines-drops")
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    bits = bits_for(drops.count())
    rows = marked(rows, F.xxhash64("_doc"), bitmap_of(drops, F.xxhash64("_id"), bits), bits)
    # a shuffle at every size: broadcast, the keys to drop would reach every executor and grow with the corpus
    losing = rows.where("_marked").join(drops.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")), "left").drop("_marked", "_id")
    joined = losing.unionByName(rows.where("NOT _marked").drop("_marked").withColumn("drop_keys", F.lit(None).cast("array<long>")))
    lines = lines_of(F.col("_text"))

    def stays(line: Column) -> Column:
        key = line_key(line)
        return ~((F.length(key) >= min_chars) & F.array_contains("drop_keys", F.xxhash64(key)))

    kept = joined.withColumns({"_n": F.size(lines).cast("long"), "_kept": F.when(F.col("drop_keys").isNotNull(), F.filter(lines, stays))})
    n_dropped = F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.col("_n") - F.size("_kept")).cast("long")
    kept_text = F.coalesce(F.array_join("_kept", "\n"), F.col("_text"), F.lit(""))
    return kept.select(F.col("_doc").alias(id_col), kept_text.alias("kept_text"), F.col("_n").alias("n_lines"), n_dropped.alias("n_dropped"))
