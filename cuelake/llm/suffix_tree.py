"""Language-model scoring with a probabilistic suffix tree over bytes, beside a unigram base over words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.contexts import Automaton, grams, small_batches, stream, tallied
from cuelake.llm.words import words_of
from cuelake.staging import written

#: The end of a text as a token of the base model; no word hashes are compared with texts.
END_TOKEN = -1
ROWS = "block long, id {kind}, train boolean, n_tokens long, score double, codes binary, counts binary, word long, code int, n long"


def plain(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased, words joined by single spaces; null as empty."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    return pc.ascii_trim_whitespace(pc.replace_substring_regex(lowered, r"[\x20\x09-\x0D]+", " "))


def smoothed(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Next-symbol probabilities of a context: its counts, and as many more as it has kinds of next
    symbol, spread as in its suffix (Witten and Bell)."""
    kinds = (counts > 0).sum(axis=1, keepdims=True)
    return (counts + kinds * below) / (counts.sum(axis=1, keepdims=True) + kinds)


def _count(depth: int, most: int = 3_000_000, rows: int = 1 << 18):
    """Counts of grams, merged over as many batches as have `most` of them together, in batches of `rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            codes, times = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            codes, times = tallied(codes, times)
            for a in range(0, len(codes), rows):
                yield pa.RecordBatch.from_pydict({"gram": codes[a : a + rows].view(np.int64), "n": times[a : a + rows].astype(np.int64)})

        for batch in small_batches(batches, "_text", 1 << 20):
            held.append(tallied(grams(stream(plain(batch.column("_text")))[0], depth)))
            if sum(len(codes) for codes, _ in held) > most:
                yield from flush()
        if held:
            yield from flush()

    return run


def learn_tree(texts: DataFrame, depth: int, p_min: float, divergence: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of the kept contexts per depth, from all rows of `texts` (one column, _text).

    A context is kept if it makes up `p_min` of all contexts and its next symbols differ from those of
    its suffix by `divergence` nats in all (count x Kullback-Leibler divergence). So a depth has
    1 / p_min contexts at most, which bounds what is collected and broadcast.
    """
    found = texts.mapInArrow(_count(depth), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    full = written(found, "tree-grams")
    levels = None
    for d in range(depth + 1):
        # a full-depth gram has bytes above the context of depth d, and byte d is 0 where the text began later
        rows = full if d == 0 else full.where(F.expr(f"(shiftrightunsigned(gram, {8 * d}) & 255) > 0"))
        one = rows.groupBy(F.expr(f"gram & {(1 << 8 * (d + 1)) - 1}L").alias("gram")).agg(F.sum("n").alias("n")).withColumn("d", F.lit(d))
        levels = one if levels is None else levels.unionByName(one)
    rows = levels.select("d", F.expr("shiftrightunsigned(gram, 8)").alias("context"), F.expr("gram & 255").alias("symbol"), "n")
    total = full.agg(F.sum("n")).first()[0] or 0
    least = max(2, math.ceil(p_min * total))
    rows = rows.withColumn("total", F.sum("n").over(Window.partitionBy("d", "context"))).where(F.col("total") >= least)
    rows = written(rows, "tree-levels")
    above = rows.select(F.col("d") + 1, "context", "symbol", "n", "total").toDF("d", "suffix", "symbol", "n_above", "total_above")
    child = rows.where("d > 0").withColumn("suffix", F.expr("context & (shiftleft(1L, 8 * (d - 1)) - 1)"))
    gain = F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("n_above") / F.col("total_above")))
    kept = child.join(above, ["d", "suffix", "symbol"]).groupBy("d", "context").agg(F.sum(gain).alias("gain")).where(F.col("gain") >= divergence)
    model = rows.join(kept.select("d", "context"), ["d", "context"], "left_semi").unionByName(rows.where("d = 0"))
    got = model.select("d", "context", "symbol", "n").sort("d", "context", "symbol").toArrow()
    out = []
    for d in range(depth + 1):
        one = got.filter(pc.equal(got["d"], d))
        out.append((one["context"].to_numpy().view(np.uint64), one["symbol"].to_numpy(), one["n"].to_numpy()))
    return out


def _score(model, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        if "levels" in held:  # given up for the tree, which a worker's next task finds
            levels = held.pop("levels")
            held["ready"] = Automaton(levels, smoothed) if len(levels[0][0]) else None
            del levels
        tree = held["ready"]
        block = TaskContext.get().partitionId() << 32
        for batch in small_batches(batches, "_text", 32 << 20):
            hashes, sizes, scores = [], [], []
            for part in small_batches(iter([batch]), "_text", 1 << 20):
                words = words_of(part.column("_text"))
                hashes.append(words.hashes), sizes.append(words.counts)
                symbols, starts = stream(plain(part.column("_text")))
                scores.append(tree.text_scores(symbols, starts) if tree else np.log2(1 / 257) * np.diff(np.append(starts, len(symbols))))
            size, train = np.concatenate(sizes), batch.column("_train").to_numpy(zero_copy_only=False)
            vocabulary, code = np.unique(np.concatenate(hashes), return_inverse=True)
            owner = np.repeat(np.arange(len(size)), size)
            learned = np.bincount(code, train[owner], len(vocabulary)).astype(np.int64)
            pairs, times = np.unique(owner * len(vocabulary) + code, return_counts=True)
            of, code = np.divmod(pairs, max(1, len(vocabulary)))
            cuts = np.searchsorted(of, np.arange(len(size) + 1))
            n, m = len(size), len(vocabulary)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block)), batch.column("_id").cast(id_type), pa.array(train), pa.array(size + 1), pa.array(np.concatenate(scores) * math.log10(2)),
                    pa.array([np.diff(code[a:b], prepend=0).astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    pa.array([times[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
                ],
                ["block", "id", "train", "n_tokens", "score", "codes", "counts", "word", "code", "n"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(m, block)), pa.nulls(m, id_type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()),
                    pa.array(vocabulary.view(np.int64)), pa.array(np.arange(m, dtype=np.int32)), pa.array(learned),
                ],
                ["block", "id", "train", "n_tokens", "score", "codes", "counts", "word", "code", "n"],
            )
            block += 1

    return run


def _base(ends: int, total: int, kinds: int):
    floor = math.log10(total + 0.5 * (kinds + 1)) if total else 0.0

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        decoded = [np.cumsum(np.frombuffer(x, np.int32)) for x in docs["codes"].to_pylist()]
        codes = words["code"].to_numpy()
        known = np.zeros(1 + max([-1, *(int(x[-1]) for x in decoded if len(x)), int(codes.max(initial=-1))]))
        known[codes] = words["c"].to_numpy()
        base, n_known = [], []
        for code, times in zip(decoded, docs["counts"].to_pylist(), strict=True):
            c, n = known[code], np.frombuffer(times, np.int32)
            base.append(float((n * np.log10(c + 0.5)).sum() + math.log10(ends + 0.5) - (n.sum() + 1) * floor) if total else 0.0)
            n_known.append(int(n[c > 0].sum()) + (ends > 0))
        return pa.table({"id": docs["id"], "train": docs["train"], "n_tokens": docs["n_tokens"], "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": docs["score"]})

    return run


def lm_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 6, p_min: float = 4e-6, divergence: float = 12.0) -> DataFrame:
    """One row per input row: id, train, n_tokens, n_known, train_tokens, base_score, score.

    Learned from all rows where `train` holds. `score` is the log10 probability of the text's words,
    joined by single spaces, and its end, under a probabilistic suffix tree over bytes: the longest
    kept context (`learn_tree`) predicts each byte, smoothed down its suffixes to all 257 symbols, so
    the probabilities of all texts add up to 1. `base_score` is that of a unigram over words with
    0.5 added to each count, one more kind of word standing for all unknown ones.

    The tree is bounded by `p_min` and broadcast. Word counts are not bounded, so they are joined: a
    block of texts has each of its words once, words are counted over blocks, and a block meets only
    the counts of its own words. A word of a third of all rows is one row a block.

    Words are told apart by 64-bit hashes. Null or empty text is its end alone. A null `train` is
    false. With nothing to learn from, every byte has probability 1/257 and base_score is 0. Rows that
    repeat are scored alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    levels = learn_tree(rows.where("_train").select("_text"), depth, p_min, divergence)
    shared = spark.sparkContext.broadcast({"levels": levels})
    kind = dict(rows.dtypes)["_id"]
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    both = written(rows.mapInArrow(_score(shared, id_type), ROWS.format(kind=kind)), "tree-scores")
    texts = both.where("codes IS NOT NULL").select("block", "id", "train", "n_tokens", "score", "codes", "counts")
    words = both.where("codes IS NULL").select("block", "word", "code", "n")
    counts = words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
    counts = written(counts, "tree-words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = texts.where("train").count()
    total, distinct = sums[0] + ends, sums[1] + (ends > 0)
    mine = words.join(counts, "word").select(F.col("block").alias("of"), "code", "c")
    out = texts.groupBy("block").cogroup(mine.groupBy("of")).applyInArrow(
        _base(ends, total, distinct), f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.withColumn("train_tokens", F.lit(total).cast("long")).withColumnRenamed("id", id_col)
