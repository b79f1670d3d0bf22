"""Benchmark items inside documents: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.contexts import small_batches
from cuelake.llm.words import Words, ranges, shingles, split_by, words_of


def needed(n: int, percent: int) -> int:
    """Shingles of n that a document must hold."""
    return -(-percent * n // 100)


@dataclass
class Partition:
    """Items of like size (2 ** k to 2 ** (k + 1) - 1 distinct shingles) with their MinHash sketches.

    A document that holds an item lacks n - `needed` of its n shingles at most, so of the item's smallest
    2 * (n - needed) + 1 hashes, its sketch, it has all but that many: `least`. `limit` is the largest hash
    of the partition's sketches; a document's sketch for the partition is its hashes up to there, however
    many these are. So no item is lost, and the larger a partition's items are, the fewer hashes it takes.
    """

    items: np.ndarray
    least: np.ndarray
    limit: np.uint64
    keys: np.ndarray
    first: np.ndarray
    times: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, items: np.ndarray, sets: list[np.ndarray], percent: int) -> Partition:
        spare = [len(sets[i]) - needed(len(sets[i]), percent) for i in items.tolist()]
        sketches = [sets[i][: 2 * k + 1] for i, k in zip(items.tolist(), spare, strict=True)]
        flat, owner = np.concatenate(sketches), np.repeat(np.arange(len(items)), [len(s) for s in sketches])
        order = np.argsort(flat, kind="stable")
        keys, first, times = np.unique(flat[order], return_index=True, return_counts=True)
        least = np.array([len(s) - k for s, k in zip(sketches, spare, strict=True)])
        return cls(items, least, keys[-1], keys, first, times, owner[order])

    def candidates(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the batch) and items whose sketches share enough hashes."""
        sketch = hashes <= self.limit
        key = found_in(self.keys, hashes[sketch])
        hit = key >= 0
        docs, key = np.divmod(np.unique(owner[sketch][hit] * len(self.keys) + key[hit]), len(self.keys))
        items = self.owner[ranges(self.first[key], self.times[key])]
        pairs, shared = np.unique(np.repeat(docs, self.times[key]) * len(self.items) + items, return_counts=True)
        docs, items = np.divmod(pairs, len(self.items))
        enough = shared >= self.least[items]
        return docs[enough], self.items[items[enough]]


class Index:
    """Items by their distinct shingle hashes, in partitions by size."""

    def __init__(self, texts: list[str], width: int, percent: int):
        self.words, self.width = words_of(pa.array(texts, pa.string())), width
        hashes, lengths = shingles(self.words, width)
        self.sets = [np.unique(hashes[a:b]) for a, b in split_by(lengths)]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.need = np.array([needed(n, percent) for n in self.sizes.tolist()], np.int64)
        classes = np.frexp(self.sizes)[1]
        self.partitions = [Partition.of(np.flatnonzero(classes == c), self.sets, percent) for c in np.unique(classes[self.sizes > 0]).tolist()]
        self.held: dict[int, set[bytes]] = {}

    def exact(self, item: int) -> set[bytes]:
        if item not in self.held:
            self.held[item] = exact_shingles(self.words, item, self.width)
        return self.held[item]


def exact_shingles(words: Words, k: int, width: int) -> set[bytes]:
    own = words.of(k)
    return {b" ".join(own[i : i + width]) for i in range(len(own) - width + 1)}


def found_in(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in sorted keys, -1 if it isn't there."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def _search(model, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        if "ready" not in held:
            held["ready"] = Index(held["texts"], width, percent)
        items, index = held["items"], held["ready"]
        for batch in small_batches(batches, "_text"):
            words = words_of(batch.column("_text"))
            hashes, lengths = shingles(words, width)
            ends = np.cumsum(lengths)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            found: dict[int, list[int]] = {}
            for p in index.partitions:
                for k, i in zip(*(x.tolist() for x in p.candidates(hashes, owner)), strict=True):
                    found.setdefault(k, []).append(i)
            docs, which, shared = [], [], []
            for k, likely in sorted(found.items()):
                all_ = np.unique(hashes[ends[k] - lengths[k] : ends[k]])
                likely = [i for i in likely if (found_in(all_, index.sets[i]) >= 0).sum() >= index.need[i]]
                own = exact_shingles(words, k, width) if likely else set()
                for i in likely:
                    if (same := len(own & index.exact(i))) >= index.need[i]:
                        docs.append(k), which.append(i), shared.append(same)
            if docs:
                sizes = index.sizes[which]
                yield pa.RecordBatch.from_pydict(
                    {
                        "_id": batch.column("_id").take(pa.array(docs)),
                        "item_id": pa.array([items[i] for i in which]),
                        "n_shingles": pa.array(sizes),
                        "n_shared": pa.array(shared, pa.int64()),
                        "containment": pa.array(np.array(shared) / sizes),
                    }
                )

    return run


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, percent: int = 80, block_chars: int = 16 << 20
) -> DataFrame:
    """One row per (document, item) where the document holds `percent` of the item's distinct shingles:
    id, item_id, n_shingles (of the item), n_shared, containment.

    Items are partitioned by size, and both sides have MinHash sketches for each partition: of an item its
    smallest hashes, of a document all its hashes up to the partition's limit (a sketch of a fixed size
    would lose a short item in a document thousands of words long). Sketches must share as many hashes as
    an item that is contained can't but share, so none is missed; what does is verified by all hashes, then
    by the shingles' words. Documents are scanned once for each block of
    `block_chars` characters of items (at least one item), which bounds what is broadcast however
    large the benchmark; nothing is shuffled, so copies and hot sources cost what other rows cost.

    Items with fewer than `width` words, or null text, have no shingle and are in nothing; so have
    documents. Items that repeat give a row each. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kinds = dict(rows.dtypes)["_id"], dict(items.dtypes)[item_col]
    schema = f"_id {kinds[0]}, item_id {kinds[1]}, n_shingles long, n_shared long, containment double"
    out = None
    for ids, texts in _blocks(items.select(item_col, item_text_col), block_chars):
        shared = spark.sparkContext.broadcast({"items": ids, "texts": texts})
        found = rows.mapInArrow(_search(shared, width, percent), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("_id", id_col)


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for item, text in items.toLocalIterator(prefetchPartitions=True):
        if ids and size + len(text or "") > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(item), texts.append(text or "")
        size += len(text or "")
    if ids:
        yield ids, texts
