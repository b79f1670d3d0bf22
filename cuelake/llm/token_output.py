"""Token ids of documents as files: tokenized, entropy-coded in blocks, and read back."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm.contexts import small_batches
from cuelake.llm.rans import Table
from cuelake.llm.words import ranges
from cuelake.staging import shared_dir, written

LANES, EVERY = 1024, 128
#: How tokens of a vocabulary with word ends are marked, and the steps of tokenizers that
#: lower-case, drop white space and then merge each word, number and run of marks apart.
WORD_END = "</w>"
NORMALISED = ["NFC", "Replace", "Lowercase"]
CUT_AT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLOCK_IDS = 1 << 18
BLOCKS = (
    "shard int, block int, start long, n_ids long, doc_ids array<{kind}>, lengths array<long>, lanes int, every int, "
    "words binary, checkpoints binary, marks array<long>, crcs array<long>"
)


def merges_words(tokenizer: str) -> bool:
    """Whether a tokenizer (its JSON) lower-cases, drops white space and merges nothing across it."""
    given = json.loads(tokenizer)
    steps = lambda x, many: (x or {}).get(many) or [x or {}]
    before, cuts = steps(given.get("normalizer"), "normalizers"), steps(given.get("pre_tokenizer"), "pretokenizers")
    return (
        [x.get("type") for x in before] == NORMALISED and [x.get("type") for x in cuts] == ["Split", "ByteLevel"]
        and (before[1]["pattern"], before[1]["content"]) == ({"Regex": r"\s+"}, " ") and cuts[0]["pattern"] == {"Regex": CUT_AT} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        and not cuts[1]["add_prefix_space"] and given["model"].get("end_of_word_suffix") == WORD_END and all(t["special"] and "<|" in t["content"] for t in given["added_tokens"])
    )


class PieceIds:
    """Ids of texts, made from those of their pieces between ASCII white space, each encoded once while held.

    The tokenizers of word vocabularies drop white space before merging, so a text's ids are those of
    its pieces in order; that is what makes one dictionary for all texts of a task possible. A tokenizer
    whose steps are others than `merges_words` knows gets whole texts.
    """

    def __init__(self, tokenizer: str, most: int = 250_000, chunk: int = 10_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.chunk = Tokenizer.from_str(tokenizer), most, chunk
        self.by_words = merges_words(tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.hits = np.zeros(0, bool)

    def _make_room(self) -> None:
        """Holds on to pieces that a later batch had again, if these are few; most pieces never are."""
        kept = np.flatnonzero(self.hits)
        if len(kept) > self.most // 2:
            return self.clear()
        names = np.array(list(self.place), object)[kept]
        self.flat, self.lengths = self.flat[ranges(self.starts[kept], self.lengths[kept])], self.lengths[kept]
        self.starts, self.hits = np.cumsum(self.lengths) - self.lengths, np.zeros(len(kept), bool)
        self.place = dict(zip(names.tolist(), range(len(kept)), strict=True))

    def _encoded(self, pieces: list[str], simple: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of pieces and how many each has. The first `simple` ones are single words, which are encoded
        many to a text, as each call costs more than a word does; word ends tell them apart again."""
        step = 500
        groups = [pieces[a : min(a + step, simple)] for a in range(0, simple, step)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            at = np.flatnonzero(self.ends[ids])
            if len(at) == len(group) and at[-1] == len(ids) - 1:
                yield ids, np.diff(at, prepend=-1)
            else:
                yield self._one_by_one(group)
        if simple < len(pieces):
            yield self._one_by_one(pieces[simple:])

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(x) for x in ids], np.int64)

    def _places(self, pieces: list[str]) -> np.ndarray:
        if len(self.place) > self.most:
            self._make_room()
        before = len(self.place)
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        blank = np.flatnonzero(at < 0)
        if len(blank):
            new = [pieces[i] for i in blank.tolist()]
            simple = pc.match_substring_regex(pa.array(new), r"^\p{L}+$").to_numpy(zero_copy_only=False)
            order = np.argsort(~simple, kind="stable")
            new = [new[i] for i in order.tolist()]
            at[blank[order]] = np.arange(before, before + len(new))
            parts, sizes = [self.flat], []
            for a in range(0, len(new), self.chunk):
                for flat, lengths in self._encoded(new[a : a + self.chunk], min(self.chunk, max(0, int(simple.sum()) - a))):
                    parts.append(flat), sizes.append(lengths)
            lengths = np.concatenate(sizes)
            self.place.update(zip(new, range(before, before + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate(parts)
            self.hits = np.concatenate((self.hits, np.zeros(len(new), bool)))
        self.hits[at[at < before]] = True
        return at

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, `end` after each, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            ids, counts = self._one_by_one(texts.to_pylist())
            return np.insert(ids, np.cumsum(counts), end), counts + 1
        # lower-casing and setting a lone mark apart change no id, but make more pieces alike
        easy = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])(\s)", r"\1 \2\3")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, easy)
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        there = pc.greater(pc.binary_length(flat), 0)
        owner = pc.list_parent_indices(lists).filter(there).to_numpy()
        coded = flat.filter(there).dictionary_encode()
        at = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        ids = self.flat[ranges(self.starts[at], lengths)]
        counts = np.bincount(owner, lengths, len(texts)).astype(np.int64)
        return np.insert(ids, np.cumsum(counts), end), counts + 1


def _tokenize(shared, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "ready" not in held:  # a worker's next task finds the pieces of this one
            held["ready"] = PieceIds(held["tokenizer"])
        pieces = held["ready"]
        for batch in small_batches(batches, "_text", 4 << 20):
            ids, counts = pieces.encode(batch.column("_text"), end)
            data, ends = ids.astype("<u4") if ids.max() > 0xFFFF else ids.astype("<u2"), np.cumsum(counts)
            rows = [data[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "n": pa.array(counts), "ids": pa.array(rows, pa.binary())})

    return run


def unpacked(data: bytes, n: int) -> np.ndarray:
    """Ids stored with two bytes each, or with four where one of them needs it."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            rows = zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True)
            found = np.bincount(np.concatenate([unpacked(data, n) for data, n in rows]))
            total = np.pad(total, (0, max(0, len(found) - len(total))))
            total[: len(found)] += found
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"token": pa.array(some), "n": pa.array(total[some])})


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        table, shard = Table(tokens, counts), TaskContext.get().partitionId()
        block, start, held, size = 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            lanes = 1 << max(0, min(LANES, len(ids) // 64).bit_length() - 1)
            words, checkpoints, marks, crcs = table.encode(ids, lanes, EVERY)
            doc_ids = pa.array([[d for d, _ in held]], pa.list_(kind))
            row = {"lengths": [[len(x) for _, x in held]], "words": [words], "checkpoints": [checkpoints], "marks": [marks], "crcs": [crcs], "start": [start], "n_ids": [len(ids)]}
            numbers = {k: pa.array([v], pa.int32()) for k, v in (("shard", shard), ("block", block), ("lanes", lanes), ("every", EVERY))}
            columns = row | numbers | {"doc_ids": doc_ids}
            names = ["shard", "block", "start", "n_ids", "doc_ids", "lengths", "lanes", "every", "words", "checkpoints", "marks", "crcs"]
            return pa.RecordBatch.from_pydict({k: columns[k] for k in names})

        for batch in batches:
            kind = batch.column("_id").type
            for doc, n, data in zip(batch.column("_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and size + n > BLOCK_IDS:
                    yield flush()
                    block, start, held, size = block + 1, start + size, [], 0
                held.append((doc, unpacked(data, n)))
                size += n
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 23) -> None:
    """Encode every whole text and write its ids, `end` after each text, to `path`.

    The file format, both parts as Parquet: `frequencies` (token, n) is the shared static table.
    `blocks` has rows (shard, block): whole documents in ascending order of id, about BLOCK_IDS ids
    or one document, coded by `rans` in interleaved lanes, independent of other blocks; checkpoints
    every `every` rounds with the place of their first word and the CRC-32 of the ids that follow,
    so that parts of a block can be decoded apart and damage is found. `start` counts the ids before
    within the shard; shards are in order too.

    Ids are made where the texts are, written once, counted (the vocabulary bounds that), and sorted
    by id into shards of about `shard_ids` ids. Null text counts as empty; a null id comes first, and
    rows that repeat an id stay next to each other, each with its own ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    given = spark.sparkContext.broadcast({"tokenizer": tokenizer})
    tokens = written(rows.mapInArrow(_tokenize(given, end), f"_id {kind}, n long, ids binary"), "token-ids")
    counts = tokens.select("n", "ids").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts.write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(frequencies(spark, path))
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, min(-(-total // shard_ids), 1 << 20))
    ordered = tokens.repartitionByRange(shards, "_id").sortWithinPartitions("_id", "n", "ids")
    ordered.mapInArrow(_encode(shared), BLOCKS.format(kind=kind)).write.parquet(f"{path}/blocks")


def frequencies(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    got = spark.read.parquet(f"{path}/frequencies").toArrow()
    return got["token"].to_numpy(), got["n"].to_numpy()


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "doc_ids"}
                step = row["lanes"] * row["every"]
                parts = [
                    table.decode(min(step, row["n_ids"] - i * step), row["lanes"], row["words"][4 * mark : 4 * end], row["checkpoints"][8 * i * row["lanes"] : 8 * (i + 1) * row["lanes"]], crc)
                    for i, (mark, end, crc) in enumerate(zip(row["marks"], [*row["marks"][1:], len(row["words"]) // 4], row["crcs"], strict=True))
                ]
                ids, lengths = np.concatenate(parts), np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                data = [ids[a:b].astype("<u4").tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"_id": batch.column("doc_ids")[k].values, "start": pa.array(row["base"] + row["start"] + ends - lengths), "n_tokens": pa.array(lengths), "ids": pa.array(data, pa.binary())}
                )

    return run


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of `write_tokens`: id, start (ids of all documents before it), n_tokens, ids
    (little-endian, four bytes each). Checksums that don't match raise."""
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    bases = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    shared = spark.sparkContext.broadcast(frequencies(spark, path))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    out = blocks.join(bases, "shard").mapInArrow(_decode(shared), f"_id {kind}, start long, n_tokens long, ids binary")
    return out.withColumnRenamed("_id", id_col)


def token_folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
