"""Faces: which are clear, how they group, whose they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuelake.operators import vectors
from cuelake.operators.density import density_groups
from cuelake.operators.shots import numbered_rows, seeded
from cuelake.operators.vectors import centres
from cuelake.staging import written


def clear(score: float = 0.6, height: float = 0.03) -> Column:
    """P15."""
    return (F.col("score") >= score) & (F.col("h") >= height)


def per_shot(shots: DataFrame, faces: DataFrame, key: str = "path") -> DataFrame:
    """A10: clear faces of each shot and the largest one's share of the frame; 0 without any."""
    some = faces.groupBy(key).agg(F.count_if(clear()).alias("faces"), F.max(F.when(clear(), F.col("w") * F.col("h"))).alias("largest"))
    return shots.select(key).join(some, key, "left").select(key, F.coalesce("faces", F.lit(0)).cast("long").alias("faces"), F.coalesce("largest", F.lit(0.0)).alias("largest"))


def box(x: str, y: str, w: str, h: str, width: int, height: int, padding: float = 0.25) -> dict[str, Column]:
    """the pixels of a padded crop of a face given in fractions of the frame, inside the frame."""
    px, py = F.col(w) * padding, F.col(h) * padding
    at = lambda v, most: F.least(F.greatest(F.rint(v * most), F.lit(0.0)), F.lit(float(most))).cast("int")
    return {"left": at(F.col(x) - px, width), "top": at(F.col(y) - py, height), "right": at(F.col(x) + F.col(w) + px, width), "bottom": at(F.col(y) + F.col(h) + py, height)}


def numbered_groups(faces: DataFrame, group: str = "cluster", least: int = 25) -> DataFrame:
    """Groups of enough faces numbered by size, the largest first, smaller labels first on ties."""
    sizes = faces.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("faces")).where(F.col("faces") >= least)
    return numbered_rows(sizes, [F.desc("faces"), F.col(group)], "number")


def sampled(faces: DataFrame, seed: str, offset: int, limit: int, key: str = "id") -> DataFrame:
    """One face of each episode, then a second of each, and so on, in seeded orders; a page of that."""
    turn = F.row_number().over(W.partitionBy("episode").orderBy(seeded(seed, key), key))
    return faces.withColumn("turn", turn.cast("long")).orderBy("turn", seeded(seed, "episode"), key).offset(offset).limit(limit)


def label_results(faces: DataFrame) -> DataFrame:
    """Rows (person, null for all, level 1) with named faces and the shots that show them."""
    named = faces.where(F.col("person").isNotNull())
    return named.rollup("person").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("faces"), F.countDistinct("path").alias("shots"))


def progress(shots: DataFrame, faces: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """A3: rows (step, done, total): shots of which each step is done, faces with a name, and shots with a face."""
    done = shots.agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in steps.items()))
    found = faces.agg(F.count("*").alias("n"), F.count("person").alias("named"), F.countDistinct("path").alias("shown"))
    rows = ", ".join([*(f"'{k}', `{k}`, total" for k in steps), "'named faces', named, n", "'shots with a face', shown, total"])
    return done.crossJoin(found).select(F.expr(f"stack({len(steps) + 2}, {rows}) AS (step, done, total)"))  # one row each


def majority_names(faces: DataFrame) -> DataFrame:
    """The name that at least half of a group's faces have; the most frequent, then the smallest one."""
    sizes = faces.groupBy("cluster").agg(F.count("*").alias("size"))
    named = faces.where("person IS NOT NULL").groupBy("cluster", "person").agg(F.count("*").alias("n"))
    best = named.join(sizes, "cluster").where(F.col("n") * 2 >= F.col("size")).groupBy("cluster")
    return best.agg(F.min_by("person", F.struct(-F.col("n"), F.col("person"))).alias("person"))


def summary(faces: DataFrame, top: int = 3) -> DataFrame:
    """Faces and episodes of each group, and the places with most of its faces."""
    where = faces.groupBy("cluster", "place").agg(F.count("*").alias("n"))
    k = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "place"))
    tops = where.withColumn("k", k).where(F.col("k") <= top).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "place"))), lambda r: r["place"]), "; ").alias("places"))
    return faces.groupBy("cluster").agg(F.count("*").alias("faces"), F.countDistinct("episode").alias("episodes")).join(tops, "cluster")


def named_marks(faces: DataFrame, marks: DataFrame, cluster: int, name: str) -> DataFrame:
    """M4: marks after naming a group: all its faces get the name but those marked wrong. An empty name takes
    marks away, and leaves those that say who a face is not."""
    name = " ".join(name.split())
    own = faces.where(F.col("cluster") == cluster).select(F.col("id").alias("face_id"), F.lit(True).alias("_own"))
    j = marks.join(own, "face_id", "full_outer").withColumn("_own", F.coalesce("_own", F.lit(False)))
    if name:
        person = F.when(F.col("_own") & F.col("not_person").isNull(), F.lit(name)).otherwise(F.col("person"))
        return j.select("face_id", person.alias("person"), "not_person")
    kept = j.where(~F.col("_own") | F.col("not_person").isNotNull())
    return kept.select("face_id", F.when(F.col("_own"), F.lit(None)).otherwise(F.col("person")).alias("person"), "not_person")


def people(faces: DataFrame, labelled: DataFrame) -> DataFrame:
    """How many faces are marked with each name and how many were labelled with it."""
    a, b = (x.groupBy("person").agg(F.count("*").alias(n)) for x, n in ((faces, "named"), (labelled, "found")))
    return a.join(b, "person", "left").select("person", "named", F.coalesce("found", F.lit(0)).cast("long").alias("found"))


def grouped(faces: DataFrame, within: int = 5, across: int = 3, least: int = 25, column: str = "embedding") -> DataFrame:
    """V9: clear faces (id, episode, vector) to (id, cluster): density groups inside each episode of `within` faces
    or more, then of their centres (`across` at least) over all episodes, both chosen from the tree of all radii; groups
    of fewer than `least` faces go, the others are numbered from the largest. Rows without a vector, or with a zero one, have no group.
    """
    unit = lambda v: vectors.normalised(F.transform(v, lambda x: x.cast("double")))
    rows = written(faces.select(F.col("episode").alias("key"), "id", unit(F.col(column)).alias("vec")).where("vec IS NOT NULL"), "face-rows")
    enough = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= within).select("key")
    parts = density_groups(rows.join(enough, "key"), within)
    parts = written(parts.join(rows.select("id", "vec"), "id").select("id", "group", "vec"), "face-parts")
    middle = written(centres(parts, "group", "vec").select(F.lit(0).alias("key"), F.col("group").alias("id"), F.col("centre").alias("vec")), "face-centres")
    clusters = density_groups(middle, across).select(F.col("id").alias("group"), F.col("group").alias("cluster"))
    found = written(parts.join(clusters, "group").select("id", "cluster"), "face-clusters")
    numbers = numbered_groups(found, "cluster", least)
    return found.join(numbers, "cluster").select("id", F.col("number").alias("cluster"))


def wrong_marks(edits: DataFrame, names: DataFrame) -> DataFrame:
    """M5: edits (face_id, cluster, at, wrong) folded to marks: the last edit of a face counts. Marked as wrong, a face has no
    person and not_person is the group's name, empty for a group without; unmarked, it has the group's name again."""
    last = edits.groupBy("face_id").agg(F.max(F.struct("at", "cluster", "wrong")).alias("e")).select("face_id", "e.cluster", "e.wrong")
    j = last.join(names.select("cluster", F.col("person").alias("_name")), "cluster", "left")
    marks = j.select("face_id", F.when(~F.col("wrong"), F.col("_name")).alias("person"), F.when(F.col("wrong"), F.coalesce("_name", F.lit(""))).alias("not_person"))
    return marks.where("person IS NOT NULL OR not_person IS NOT NULL")
