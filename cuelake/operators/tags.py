"""Tags trained from marked examples: marks, weak negatives, training, members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuelake.operators.shots import seeded
from cuelake.staging import written


def latest_labels(edits: DataFrame) -> DataFrame:
    """M6: the last edit (tag, path, at, label) of each pair; a null label clears it."""
    return edits.groupBy("tag", "path").agg(F.max(F.struct("at", "label")).alias("m")).select("tag", "path", F.col("m.label").alias("label")).where("label IS NOT NULL")


def summary(labels: DataFrame, members: DataFrame) -> DataFrame:
    """A5: marks of either kind and members of each tag."""
    marks = labels.groupBy("tag").agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no"))
    held = members.groupBy("tag").agg(F.count("*").alias("members"))
    return marks.join(held, "tag", "full_outer").select("tag", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("yes", "no", "members")))


def tag_summary(defs: DataFrame, labels: DataFrame, members: DataFrame) -> DataFrame:
    """A5: rows of `summary` for all tags that are defined or marked, with whether each is trained and its accuracy (null if unknown).

    defs: tag, coef (null: not trained), accuracy."""
    known = defs.select("tag", F.col("coef").isNotNull().alias("trained"), "accuracy")
    j = summary(labels, members).join(known, "tag", "full_outer")
    return j.select("tag", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("yes", "no", "members")), F.coalesce("trained", F.lit(False)).alias("trained"), "accuracy")


def without_tag(tables: list[DataFrame], tag: str) -> list[DataFrame]:
    """M6: tables with a column `tag` (definitions, marks, members) without any row of a tag."""
    return [t.where(~F.col("tag").eqNullSafe(F.lit(tag))) for t in tables]


def members(scored: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """M7: scored rows (tag, path, prob) that are marked yes, or not marked and likely enough."""
    j = scored.join(labels.select("tag", "path", "label"), ["tag", "path"], "left")
    return j.where(F.coalesce(F.col("label") == 1, F.col("prob") >= least)).select("tag", "path", "prob")


def lists_per_shot(shots: DataFrame, rows: DataFrame, value: str, key: str = "path") -> DataFrame:
    """Sorted distinct values of each shot as JSON, null for shots without."""
    lists = rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_set(value))).alias("list"))
    return shots.select(key).join(lists, key, "left")


def weak_negatives(shots: DataFrame, labelled: DataFrame, n: int, seed: str, key: str = "path") -> DataFrame:
    """U4: n shots drawn in a seeded order, without those marked (the draw comes first)."""
    return shots.select(key).orderBy(seeded(seed, key), key).limit(n).join(labelled.select(key), key, "left_anti")


def candidates(scored: DataFrame, labels: DataFrame, mode: str, key: str = "path") -> DataFrame:
    """T4: what to mark next, with its rank value, in order: `suggest` (likeness), `unsure`, `tagged`; only shots not marked. `marked`
    has those that are, with a yes first. `shots.page` gives a page and the total."""
    if mode == "marked":
        return labels.select(key, (-F.col("label")).cast("double").alias("rank")).join(scored.select(key, "prob"), key, "left").orderBy("rank", key)
    rest = scored.join(labels.select(key), key, "left_anti")
    if mode == "unsure":
        return rest.withColumn("rank", F.abs(F.col("prob") - 0.5)).orderBy("rank", key)
    rows = rest.where(F.col("prob") >= 0.5) if mode == "tagged" else rest
    return rows.withColumn("rank", -F.col("prob")).orderBy("rank", key)


def training_set(labels: DataFrame, weak: DataFrame, vectors: DataFrame, weak_weight: float = 0.1, key: str = "path") -> DataFrame:
    """Marked rows with weight 1 and weak negatives with less, each times n / (2 x rows of its class)."""
    rows = labels.select(key, F.col("label").cast("double").alias("label"), F.lit(1.0).alias("w"))
    return balanced(rows.unionByName(weak.select(key, F.lit(0.0).alias("label"), F.lit(weak_weight).alias("w"))).join(vectors, key))


def balanced(rows: DataFrame) -> DataFrame:
    """Rows (label, w, ...) whose weights are times n / (2 x rows of their class)."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("_c"))
    total = rows.agg(F.count("*").alias("_n"))
    both = rows.join(F.broadcast(sizes), "label").crossJoin(F.broadcast(total))  # two rows and one
    return both.withColumn("w", F.col("w") * F.col("_n") / (F.col("_c") * 2)).drop("_c", "_n")


def train(labels: DataFrame, weak: DataFrame, vectors: DataFrame, c: float = 2.0, least: int = 5, column: str = "embedding", key: str = "path"):
    """V7: coefficients, intercept and cross-validated accuracy (None with fewer than `least` marks of no) of a logistic
    regression with an L2 penalty; None with fewer than `least` marks of yes.

    Accuracy comes from folds stratified by class over the marked rows only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    yes, no = counts.get(1, 0), counts.get(0, 0)
    if yes < least:
        return None

    def fit(rows: DataFrame):
        total = rows.agg(F.sum("w")).first()[0]
        return LogisticRegression(weightCol="w", elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * total), maxIter=200, tol=1e-9).fit(rows)

    vectors = vectors.select(key, column)
    rows = written(training_set(labels, weak, vectors, key=key), "training-set")  # read by every iteration
    model = fit(rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))))
    accuracy = None
    if no >= least:
        folds = min(5, yes, no)
        k = F.row_number().over(W.partitionBy("label").orderBy(seeded("fold", key), key))
        held = written(labels.select(key, F.col("label").cast("double").alias("label"), (k % folds).alias("fold")).join(vectors, key), "training-folds")
        held = held.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))
        right = n = 0
        for i in range(folds):
            part = fit(balanced(held.where(F.col("fold") != i).withColumn("w", F.lit(1.0))))
            got = part.transform(held.where(F.col("fold") == i)).agg(F.count_if(F.col("prediction") == F.col("label")), F.count("*")).first()
            right, n = right + got[0], n + got[1]
        accuracy = right / n
    return model.coefficients.toArray().tolist(), float(model.intercept), accuracy


def replace_members(found: DataFrame, tags: list[str], path: str) -> None:
    """M7: puts the members (tag, path, prob) of `tags` in place of those that are stored below `path`, and leaves other tags' files as they are.

    A tag is a folder, and only the folders of `tags` are written anew; a tag that has no members any more keeps an
    empty row. Running it again does the same again. Rows of other tags are not taken.
    """
    kind = dict(found.dtypes)
    rows = found.where(F.col("tag").isin(tags)).select("tag", "path", "prob")
    empty = found.sparkSession.createDataFrame([(t, None, None) for t in tags], f"tag string, path {kind['path']}, prob {kind['prob']}")
    placed = rows.unionByName(empty).repartition("tag", F.when(F.col("path").isNotNull(), F.pmod(F.xxhash64("path"), F.lit(16))))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag").option("compression", "zstd").parquet(path)


def stored_members(like: DataFrame, path: str) -> DataFrame:
    """M7: members that replace_members stored, with the columns of `like`."""
    schema = like.select("path", "prob", F.col("tag").cast("string").alias("tag")).schema
    return like.sparkSession.read.schema(schema).parquet(path).where("path IS NOT NULL").select("tag", "path", "prob")
