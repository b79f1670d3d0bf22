"""Quality scores: random Fourier features, ridge regression by normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.contexts import small_batches
from cuelake.llm.words import mixed, split_by, text_bytes, words_of
from cuelake.staging import written

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "white": (32, 9, 10, 11, 12, 13), "line": (10,), "stop": (46,), "comma": (44,),
    "loud": (33, 63), "symbol": b"#$%&*@<>=+^~\\{}[]_/", "bar": (124,), "quote": b"\"'()`:;-", "other": range(128, 256), "lead": range(192, 256),
}
NAMES = [*_CLASSES, "bytes", "words", "word_mean", "word_deviation", "long_words", "distinct_words", "distinct_pairs", "top_word", "distinct_lines", "line_mean", "number_words", "caps_words"]


#: Folds of labelled rows for calibration.
FOLDS = 5


def _share(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])


def features(texts: pa.Array) -> np.ndarray:
    """Statistics of whole texts, one row each: shares of kinds of characters, lengths, repetition. All 0 for an empty text."""
    data, at = text_bytes(texts)
    size = np.maximum(np.diff(at), 1)
    out = np.zeros((len(texts), len(NAMES)))
    lut = np.zeros(256, bool)
    for j, kinds in enumerate(_CLASSES.values()):
        lut[:] = False
        lut[list(kinds)] = True
        out[:, j] = _share(lut[data], at) / size
    words = words_of(texts)
    n, j = words.counts, len(_CLASSES)
    some = np.maximum(n, 1)
    word_at = np.concatenate(([0], np.cumsum(n)))
    length = (words.ends - words.begins).astype(np.float64)
    mean = np.diff(np.concatenate(([0], np.cumsum(length)))[word_at]) / some
    square = np.diff(np.concatenate(([0], np.cumsum(length**2)))[word_at]) / some
    lut[:] = False
    lut[48:58] = True
    first = data[words.begins] if len(words.begins) else np.zeros(0, np.uint8)
    last = data[words.ends - 2] if len(words.begins) else first
    out[:, j : j + 5] = np.stack([np.log1p(np.diff(at)), np.log1p(n), mean, np.sqrt(np.maximum(square - mean**2, 0)), _share(length > 14, word_at) / some], axis=1)
    pairs = mixed(words.hashes[:-1] * np.uint64(3) + words.hashes[1:]) if len(words.hashes) > 1 else words.hashes
    lines = data == 10
    for i, (a, b) in enumerate(split_by(n)):
        if b > a:
            _, times = np.unique(words.hashes[a:b], return_counts=True)
            out[i, j + 5] = len(times) / (b - a)
            out[i, j + 6] = len(np.unique(pairs[a : b - 1])) / (b - a - 1) if b > a + 1 else 1
            out[i, j + 7] = times.max() / (b - a)
        own = [x for x in data[at[i] : at[i + 1]].tobytes().split(b"\n") if x.strip()] if lines[at[i] : at[i + 1]].any() else []
        out[i, j + 8] = len(set(own)) / len(own) if own else float(b > a)
    out[:, j + 9] = np.log1p(size / (1 + _share(lines, at))) * (np.diff(at) > 0)
    out[:, j + 10] = _share(lut[first], word_at) / some
    out[:, j + 11] = _share((first >= 65) & (first <= 90) & (last >= 65) & (last <= 90) & (length > 1), word_at) / some
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "_text"):
        values = pa.array(features(batch.column("_text")).astype(np.float32).reshape(-1))
        at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.ListArray.from_arrays(at, values)], ["_id", "_f"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


class Kernel:
    """Random Fourier features of a Gaussian kernel on standardised statistics; drawn from `seed`, so the same everywhere."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.standard_normal((len(mean), size)) / (width * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8) @ self.w + self.b
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z), np.ones((len(x), 1))])


def _equations(arguments: tuple):
    """Per task: rows of the normal equations' sums, those of each fold after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, total = Kernel(*arguments), {}
        for batch in batches:
            z, y, fold = kernel(_matrix(batch.column("_f"))), batch.column("_y").to_numpy().astype(np.float64), batch.column("_fold").to_numpy()
            for k in np.unique(fold).tolist():
                own = z[fold == k]
                total[k] = total.get(k, 0.0) + own.T @ np.hstack([own, y[fold == k, None]])
        for k, sums in total.items():
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(len(sums), dtype=np.int32) + k * len(sums)), "sums": pa.array([r.tobytes() for r in sums], pa.binary())})

    return run


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column("row").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            held[k] = held.get(k, 0.0) + np.frombuffer(data)
    if held:
        yield pa.RecordBatch.from_pydict({"row": pa.array(list(held), pa.int32()), "sums": pa.array([v.tobytes() for v in held.values()], pa.binary())})


def _raw(arguments: tuple, weights: np.ndarray):
    """Raw scores of labelled rows, each by the weights that its fold had no part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(*arguments)
        for batch in batches:
            own = weights[batch.column("_fold").to_numpy()]
            yield pa.RecordBatch.from_pydict({"_y": batch.column("_y"), "_raw": pa.array((kernel(_matrix(batch.column("_f"))) * own).sum(axis=1))})

    return run


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: means of x (ascending) and rising shares of pools."""
    pools: list[list[float]] = []
    for a, b, c in zip(x.tolist(), n.tolist(), positive.tolist(), strict=True):
        pools.append([a * b, b, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def quality_score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", size: int = 256, width: float = 1.0, ridge: float = 1e-4, bins: int = 4096, seed: int = 7
) -> DataFrame:
    """One row per row of docs: id, score (0 to 1; higher: label 1 likelier).

    Learned from all rows of `labels` with label 0 or 1 whose id is in docs. Statistics of whole texts
    are computed once and written; tasks sum their part of the (size + 1)-square normal equations,
    rows of which are added up over the cluster, so the driver solves a system whose size doesn't
    depend on the data. Raw scores of the labelled rows, each from the equations without its fold of the rows
    (by a hash of the id) and counted in `bins` bins, give an isotonic
    calibration with straight lines between pools; a thousandth of the score follows the raw score
    throughout, so that pools don't tie texts that differ.

    Null text counts as empty and gets a score too. Null labels teach nothing, repeated ones count each.
    Without labels of both kinds the score is that kind's value, or 0.5 with none at all. Rows that
    repeat score alike; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    stats = written(rows.mapInArrow(_features, f"_id {kind}, _f array<float>"), "quality-features")
    taught = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    fold = F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(FOLDS)).cast("int").alias("_fold")
    known = written(taught.join(stats, "_id").select("_f", "_y", fold), "quality-labelled")
    each = [F.col("_f")[i].cast("double") for i in range(len(NAMES))]
    sums = known.agg(F.count("*"), F.avg("_y"), *(F.avg(c) for c in each), *(F.stddev_pop(c) for c in each)).first()
    n, share = sums[0], sums[1]
    if not n or share in (0.0, 1.0):
        return stats.select(F.col("_id").alias(id_col), F.lit(share if n else 0.5).cast("double").alias("score"))
    moments = np.array(sums[2:], np.float64).reshape(2, -1)
    arguments = (moments[0], moments[1], size, width, seed)
    parts = known.mapInArrow(_equations(arguments), "row int, sums binary").repartition("row").mapInArrow(_add_rows, "row int, sums binary")
    sums = np.zeros((FOLDS * (size + 1), size + 2))
    for r in parts.collect():  # FOLDS x (size + 1) rows whatever the data
        sums[r["row"]] = np.frombuffer(bytes(r["sums"]))
    sums = sums.reshape(FOLDS, size + 1, size + 2)
    solved = lambda t: np.linalg.solve(t[:, :-1] + ridge * t[-1, -2] * np.eye(size + 1), t[:, -1])  # noqa: E731  the last feature is 1, so its square counts rows
    total = sums.sum(axis=0)
    weights = solved(total)
    apart = np.array([solved(total - t) if t[-1, -2] < total[-1, -2] else weights for t in sums])
    scored = known.mapInArrow(_raw(arguments, apart), "_y double, _raw double")
    low, high = -0.5, 1.5
    place = F.floor((F.least(F.greatest("_raw", F.lit(low)), F.lit(high)) - low) * (bins / (high - low)))
    counted = scored.groupBy(place.alias("bin")).agg(F.avg("_raw").alias("x"), F.count("*").alias("n"), F.sum("_y").alias("p")).sort("bin").toArrow()
    x, y = isotonic(*(counted[c].to_numpy() for c in ("x", "n", "p")))
    out = stats.mapInArrow(_calibrated(arguments, weights, x, y, (low, high)), f"_id {kind}, score double")
    return out.withColumnRenamed("_id", id_col)


def _calibrated(arguments: tuple, weights: np.ndarray, x: np.ndarray, y: np.ndarray, limits: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(*arguments)
        for batch in batches:
            raw = kernel(_matrix(batch.column("_f"))) @ weights
            straight = np.clip((raw - limits[0]) / (limits[1] - limits[0]), 0, 1)
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "score": pa.array(np.clip(0.999 * np.interp(raw, x, y) + 0.001 * straight, 0, 1))})

    return run
