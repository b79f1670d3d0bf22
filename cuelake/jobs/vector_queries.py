"""Queries over embeddings: search, scores, centres, faces, with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators import faces, tags, vectors
from cuelake.staging import table

DIM = 64
QUERY = [math.sin(i + 1) / 8 for i in range(DIM)]
COEFS = {"indoors": ([math.cos(i) for i in range(DIM)], -0.5), "night": ([math.sin(2 * i) for i in range(DIM)], 0.25)}


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def search(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(_emb(spark, d), QUERY, 100, "vec_id").withColumn("score", F.round("score", 6))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return vectors.scores(_emb(spark, d), COEFS, "vec_id").withColumn("prob", F.round("prob", 6))


def centres(spark: SparkSession, d: str) -> DataFrame:
    return vectors.centres(_emb(spark, d), "label").select("label", F.posexplode("centre").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    """J15 with centres of all but every third face, people being the labels (few, so collected)."""
    known = _emb(spark, d).where("vec_id % 3 <> 0").withColumn("person", F.concat(F.lit("p"), F.col("label").cast("string")))
    named = [(r["person"], r["centre"]) for r in vectors.centres(known, "person").collect()]
    refused = _emb(spark, d).where("vec_id % 10 = 0").select("vec_id", F.concat(F.lit("p"), F.col("label").cast("string")).alias("name"))
    return vectors.nearest(_emb(spark, d), named, "vec_id", 0.2, refused=refused).select("vec_id", "name", F.round("score", 6).alias("score"))


def norms(spark: SparkSession, d: str) -> DataFrame:
    """length, length after normalising, and the logistic of a dot product."""
    e = F.col("embedding")
    return _emb(spark, d).select("vec_id", F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.norm(vectors.normalised(e)), 6).alias("unit"), F.round(vectors.logistic(vectors.dot(e, vectors.vector(QUERY))), 6).alias("p"))


def _faces(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 20).alias("episode"), (F.col("vec_id") % 150).alias("path"), F.when(F.col("vec_id") % 6 > 0, F.concat(F.lit("p"), F.col("label").cast("string"))).alias("person"),
        (F.col("label") % 4).cast("int").alias("cluster"), (0.5 + (F.col("vec_id") % 50) / 100).alias("score"), (F.col("vec_id") % 10 / 100).alias("w"), (0.02 + (F.col("vec_id") % 10) / 100).alias("h"), "embedding",
    )


FACES = """
WITH f AS (SELECT vec_id AS id, vec_id % 20 AS episode, vec_id % 150 AS path, CASE WHEN vec_id % 6 > 0 THEN 'p' || label END AS person, CAST(label % 4 AS INT) AS cluster,
                  0.5::DOUBLE + (vec_id % 50) / 100 AS score, vec_id % 10 / 100 AS w, 0.02::DOUBLE + (vec_id % 10) / 100 AS h FROM embeddings)
"""


def clear_faces(spark: SparkSession, d: str) -> DataFrame:
    return _faces(spark, d).where(faces.clear()).select("id")


def faces_per_shot(spark: SparkSession, d: str) -> DataFrame:
    shots = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("path")).distinct()
    return faces.per_shot(shots, _faces(spark, d)).select("path", "faces", F.round("largest", 6).alias("largest"))


def face_boxes(spark: SparkSession, d: str) -> DataFrame:
    f = _faces(spark, d).withColumns({"x": F.col("id") % 90 / 100, "y": F.col("id") % 70 / 100})
    return f.select("id", *(c.cast("long").alias(k) for k, c in faces.box("x", "y", "w", "h", 640, 480).items()))


def numbered_groups(spark: SparkSession, d: str) -> DataFrame:
    return faces.numbered_groups(_faces(spark, d), "cluster", 25)


def sampled(spark: SparkSession, d: str) -> DataFrame:
    return faces.sampled(_faces(spark, d), "5", 10, 50).select("turn", "id", "episode")


def majority_names(spark: SparkSession, d: str) -> DataFrame:
    f = _faces(spark, d).withColumns({"cluster": F.col("id") % 120, "person": F.when(F.col("id") % 6 > 0, F.concat(F.lit("p"), (F.col("id") % 120 % 5 * (F.col("id") % 7 % 2)).cast("string")))})
    return faces.majority_names(f)


def group_summary(spark: SparkSession, d: str) -> DataFrame:
    return faces.summary(_faces(spark, d).withColumn("place", F.concat(F.lit("e"), (F.col("id") % 7).cast("string"))))


def people(spark: SparkSession, d: str) -> DataFrame:
    f = _faces(spark, d).where("person IS NOT NULL")
    return faces.people(f, f.where("score >= 0.6 AND person <> 'p3'"))


def named_marks(spark: SparkSession, d: str) -> DataFrame:
    f = _faces(spark, d)
    marks = f.where("id % 7 = 0").select(F.col("id").alias("face_id"), F.when(F.col("id") % 14 > 0, F.lit("old")).alias("person"), F.when(F.col("id") % 14 == 0, F.lit("")).alias("not_person"))
    return faces.named_marks(f, marks, 2, "  Ann   B ")


def label_results(spark: SparkSession, d: str) -> DataFrame:
    """A14."""
    f = _faces(spark, d).where("person IS NOT NULL")
    return f.groupBy("person").agg(F.count("*").alias("faces"), F.countDistinct("path").alias("shots"))


def progress(spark: SparkSession, d: str) -> DataFrame:
    """A3: done and all, per step."""
    one = _faces(spark, d).agg(F.count("*").alias("total"), F.count("person").alias("named"), F.count_if(faces.clear()).alias("clear"))
    return one.select(F.expr("stack(2, 'named', named, total, 'clear', clear, total) AS (step, done, total)"))


def wrong_marks(spark: SparkSession, d: str) -> DataFrame:
    """Faces of a group with whether they are marked as not in it; an empty name is a mark."""
    f = _faces(spark, d)
    marks = f.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, F.lit("")).alias("not_person"))
    return f.where("cluster = 1").join(marks, "id", "left").select("id", F.col("not_person").isNotNull().alias("wrong"))


def grouped(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with two groups planted in them, by the parity of their label."""
    planted = F.transform("embedding", lambda x, i: x * 0.5 + F.when(i == F.col("label") % 2, 1.0).otherwise(0.0))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), planted.alias("embedding"))
    return faces.grouped(_faces(spark, d).where(faces.clear()).select("id", "episode").join(e, "id"))


def unlike(spark: SparkSession, d: str) -> DataFrame:
    """Three groups of unlike tightness in each episode of 150 vectors: around one axis a twentieth as wide as around another."""
    width = F.element_at(F.array(F.lit(0.05), F.lit(0.3), F.lit(1.0)), (F.col("vec_id") % 3 + 1).cast("int"))
    planted = F.transform("embedding", lambda x, i: x.cast("double") * width + F.when(i == F.col("vec_id") % 3, 3.0).otherwise(0.0))
    e = _emb(spark, d).select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 150).alias("episode"), planted.alias("embedding"))
    return faces.grouped(e)


def trained(spark: SparkSession, d: str) -> DataFrame:
    """V7 + V8: a tag trained from marks, then every vector scored."""
    emb = _emb(spark, d).select(F.col("vec_id").alias("path"), "embedding")
    marks = _emb(spark, d).where("vec_id % 5 = 0").select(F.col("vec_id").alias("path"), (F.col("label") < 3).cast("int").alias("label"))
    weak = tags.weak_negatives(emb.select("path"), marks, 100, "0")
    coef, intercept, _ = tags.train(marks, weak, emb)
    return vectors.scores(emb, {"few": (coef, intercept)}, "path").select("path", "tag", F.round("prob", 4).alias("prob"))


QUERIES = {
    "t2_search": search, "v8_scores": scores, "a6_centres": centres, "j15_nearest": nearest, "f13_vectors": norms, "p15_clear_faces": clear_faces, "a10_faces_per_shot": faces_per_shot, "f12_face_boxes": face_boxes,
    "w12_numbered_groups": numbered_groups, "w13_sampled": sampled, "a12_majority_names": majority_names, "a16_group_summary": group_summary, "j18_people": people, "m4_named_marks": named_marks,
    "a14_label_results": label_results, "a3_progress": progress, "j17_wrong_marks": wrong_marks, "v9_grouped": grouped, "v9_unlike": unlike, "v7_trained": trained,
}


def _sql(v: list[float]) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in v) + "]"


_CENTRES = """
WITH u AS (SELECT {key} AS g, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings {where}),
m AS (SELECT g, pos, avg(x) AS m FROM u GROUP BY ALL),
n AS (SELECT g, sqrt(sum(m * m)) AS n FROM m GROUP BY g),
c AS (SELECT g, pos, m / n AS x FROM m JOIN n USING (g))
"""

SQL = {
    "t2_search": f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_sql(QUERY)}), 6) AS score FROM embeddings ORDER BY list_dot_product(embedding::DOUBLE[], {_sql(QUERY)}) DESC, vec_id LIMIT 100",
    "v8_scores": " UNION ALL ".join(f"SELECT vec_id, '{t}' AS tag, round(1 / (1 + exp(-(list_dot_product(embedding::DOUBLE[], {_sql(c)}) + {b}::DOUBLE))), 6) AS prob FROM embeddings" for t, (c, b) in COEFS.items()),
    "a6_centres": _CENTRES.format(key="label", where="") + "SELECT g AS label, pos, round(x, 6) AS x FROM c",
    "j15_nearest": _CENTRES.format(key="'p' || label", where="WHERE vec_id % 3 <> 0") + """
        , l AS (SELECT g, list(x ORDER BY pos) AS v FROM c GROUP BY g),
        s AS (SELECT vec_id, g AS name, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, l WHERE NOT (vec_id % 10 = 0 AND g = 'p' || label))
        SELECT vec_id, name, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name) = 1 AND score >= 0.2""",
    "f13_vectors": f"SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit, round(1 / (1 + exp(-list_dot_product(embedding::DOUBLE[], {_sql(QUERY)}))), 6) AS p FROM embeddings",
    "p15_clear_faces": FACES + "SELECT id FROM f WHERE score >= 0.6 AND h >= 0.03",
    "v9_grouped": FACES + """, c AS (SELECT f.id, e.label % 2 AS g FROM f JOIN embeddings e ON e.vec_id = f.id WHERE score >= 0.6 AND h >= 0.03),
        r AS (SELECT g, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS cluster FROM c GROUP BY 1 HAVING count(*) >= 25) SELECT id, cluster FROM c JOIN r USING (g)""",
    "v9_unlike": "WITH r AS (SELECT vec_id % 3 AS g, row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) AS cluster FROM embeddings GROUP BY 1) SELECT vec_id AS id, cluster FROM embeddings JOIN r ON g = vec_id % 3",
    "a10_faces_per_shot": FACES + "SELECT d.doc_id AS path, count(f.id) FILTER (score >= 0.6 AND h >= 0.03) AS faces, round(coalesce(max(w * h) FILTER (score >= 0.6 AND h >= 0.03), 0), 6) AS largest FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN f ON f.path = d.doc_id GROUP BY 1",
    "f12_face_boxes": FACES + """, b AS (SELECT id, id % 90 / 100 AS x, id % 70 / 100 AS y, w, h FROM f)
        SELECT id, CAST(least(greatest(round_even((x - w * 0.25::DOUBLE) * 640, 0), 0), 640) AS BIGINT) AS "left", CAST(least(greatest(round_even((y - h * 0.25::DOUBLE) * 480, 0), 0), 480) AS BIGINT) AS top,
               CAST(least(greatest(round_even((x + w + w * 0.25::DOUBLE) * 640, 0), 0), 640) AS BIGINT) AS "right", CAST(least(greatest(round_even((y + h + h * 0.25::DOUBLE) * 480, 0), 0), 480) AS BIGINT) AS bottom FROM b""",
    "w12_numbered_groups": FACES + "SELECT cluster, count(*) AS faces, row_number() OVER (ORDER BY count(*) DESC, cluster) AS number FROM f GROUP BY cluster HAVING count(*) >= 25",
    "w13_sampled": FACES + ", t AS (SELECT id, episode, row_number() OVER (PARTITION BY episode ORDER BY md5('5|' || id), id) AS turn FROM f) SELECT turn, id, episode FROM t ORDER BY turn, md5('5|' || episode), id LIMIT 50 OFFSET 10",
    "a12_majority_names": """WITH f AS (SELECT vec_id % 120 AS cluster, CASE WHEN vec_id % 6 > 0 THEN 'p' || (vec_id % 120 % 5 * (vec_id % 7 % 2)) END AS person FROM embeddings),
        s AS (SELECT cluster, count(*) AS size FROM f GROUP BY 1), n AS (SELECT cluster, person, count(*) AS n FROM f WHERE person IS NOT NULL GROUP BY ALL)
        SELECT cluster, person FROM n JOIN s USING (cluster) WHERE n * 2 >= size QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, person) = 1""",
    "a16_group_summary": FACES + """, w AS (SELECT cluster, 'e' || (id % 7) AS place, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT cluster, place, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, place) AS k FROM w),
        p AS (SELECT cluster, string_agg(place, '; ' ORDER BY k) AS places FROM t WHERE k <= 3 GROUP BY 1) SELECT cluster, count(*) AS faces, count(DISTINCT episode) AS episodes, any_value(places) AS places FROM f JOIN p USING (cluster) GROUP BY 1""",
    "j18_people": FACES + "SELECT person, count(*) AS named, count(*) FILTER (score >= 0.6 AND person <> 'p3') AS found FROM f WHERE person IS NOT NULL GROUP BY 1",
    "m4_named_marks": FACES + """, m AS (SELECT id AS face_id, CASE WHEN id % 14 > 0 THEN 'old' END AS person, CASE WHEN id % 14 = 0 THEN '' END AS not_person FROM f WHERE id % 7 = 0), o AS (SELECT id AS face_id FROM f WHERE cluster = 2)
        SELECT coalesce(m.face_id, o.face_id) AS face_id, CASE WHEN o.face_id IS NOT NULL AND not_person IS NULL THEN 'Ann B' ELSE person END AS person, not_person FROM m FULL JOIN o ON o.face_id = m.face_id""",
    "a14_label_results": FACES + "SELECT person, count(*) AS faces, count(DISTINCT path) AS shots FROM f WHERE person IS NOT NULL GROUP BY 1",
    "a3_progress": FACES + "SELECT 'named' AS step, count(person) AS done, count(*) AS total FROM f UNION ALL SELECT 'clear', count(*) FILTER (score >= 0.6 AND h >= 0.03), count(*) FROM f",
    "j17_wrong_marks": FACES + "SELECT id, id % 10 = 0 AS wrong FROM f WHERE cluster = 1",
}
