"""Arithmetic on embedding columns, similarity search, scores and centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """F13."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Of unit length; null for the zero vector. The length stands in an array of one, so that it is taken once and not for each number."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))), F.lit(0))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def halved(a: Column) -> Column:
    """a vector as it comes back from two-byte floats."""

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))

    return F.pandas_udf(run, "array<float>")(a)


def search(rows: DataFrame, query: list[float], n: int, key: str, column: str = "embedding") -> DataFrame:
    """The n rows most similar to a query vector; ties by key. No sort of everything: each task keeps n rows."""
    return rows.select(key, dot(F.col(column), vector(query)).alias("score")).orderBy(F.desc("score"), key).limit(n)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scores(rows: DataFrame, coefs: dict[str, tuple[list[float], float]], key: str, column: str = "embedding") -> DataFrame:
    """V8 (V2 in bulk): probability of every tag for every row, one matrix product per batch: rows (key, tag, prob).

    coefs: tag -> (coefficients, intercept); as few as there are tags, so they travel with the task.
    """
    tags = sorted(coefs)
    weights, bias = np.array([coefs[t][0] for t in tags]).T, np.array([coefs[t][1] for t in tags])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = 1 / (1 + np.exp(-(_matrix(batch.column(1)) @ weights + bias)))
                at = pa.array(np.repeat(np.arange(batch.num_rows), len(tags)))
                yield pa.RecordBatch.from_pydict({key: batch.column(0).take(at), "tag": pa.array(tags * batch.num_rows), "prob": pa.array(p.reshape(-1))})

    return rows.where(F.col(column).isNotNull()).select(key, column).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, tag string, prob double")


def centres(rows: DataFrame, group: str, column: str = "embedding", most: int = 4096) -> DataFrame:
    """The mean vector of each group, of unit length (null for a mean of zero). Null vectors count for nothing.

    Each task sums whole vectors, so that a group has a row for each task (or for each `most` groups that a task
    meets), however many vectors it has; these rows are all that is shuffled.
    """
    kind = dict(rows.dtypes)[group]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def out() -> pa.RecordBatch:
            rows = [{"g": g, "n": n, "sums": x} for g, (n, x) in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_pylist(rows, pa.schema([("g", group_type), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))]))

        for batch in batches:
            if not batch.num_rows:
                continue
            group_type = batch.schema.field(0).type
            encoded = batch.column(0).dictionary_encode(null_encoding="encode")
            codes, v = encoded.indices.to_numpy(), _matrix(batch.column(1))
            part, n = np.zeros((len(encoded.dictionary), v.shape[1])), np.bincount(codes, minlength=len(encoded.dictionary))
            np.add.at(part, codes, v)
            for k, g in enumerate(encoded.dictionary.to_pylist()):
                before = sums.get(g, (0, 0.0))
                sums[g] = (before[0] + int(n[k]), before[1] + part[k])
            if len(sums) >= most:
                yield out()
        if sums:
            yield out()

    parts = rows.where(F.col(column).isNotNull()).select(group, column).mapInArrow(summed, f"g {kind}, n long, sums array<double>")
    gathered = parts.groupBy("g").agg(F.sum("n").alias("n"), F.collect_list("sums").alias("s"))
    total = F.aggregate("s", F.transform(F.get("s", F.lit(0)), lambda x: x * 0), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return gathered.select(F.col("g").alias(group), normalised(F.transform(total, lambda x: x / F.col("n"))).alias("centre"))


def nearest(rows: DataFrame, named: list[tuple[str, list[float]]], key: str, least: float, column: str = "embedding", refused: DataFrame | None = None) -> DataFrame:
    """Each row's most similar centre, ties to the first name, if similar enough.

    named: (name, centre), a person each, so the matrix is small; refused: rows (key, name) that a row must
    not get. Matrix products per batch, and no shuffle but for the refusals.
    """
    names = sorted(n for n, _ in named)
    matrix = np.array([dict(named)[n] for n in names]).T if names else np.zeros((0, 0))
    gathered = rows.select(key, column).withColumn("_no", F.array().cast("array<string>"))
    if refused is not None:
        no = refused.groupBy(key).agg(F.collect_set("name").alias("_no"))
        gathered = rows.select(key, column).join(no, key, "left").withColumn("_no", F.coalesce("_no", F.array().cast("array<string>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {n: i for i, n in enumerate(names)}
        for batch in batches:
            if batch.num_rows and names:
                s = _matrix(batch.column(1)) @ matrix
                for i, no in enumerate(batch.column(2).to_pylist()):
                    s[i, [place[n] for n in no if n in place]] = -np.inf
                best = s.argmax(axis=1)
                top = s[np.arange(len(s)), best]
                ok = pa.array(top >= least)
                yield pa.RecordBatch.from_pydict({key: batch.column(0), "name": pa.array(np.array(names, object)[best], pa.string()), "score": pa.array(top)}).filter(ok)

    return gathered.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, name string, score double")
