"""More queries over the catalogue, faces and files, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake import sources
from cuelake.operators import catalogue, cues, faces
from cuelake.staging import table


def missing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("serial"), F.col("p_size").alias("part"))
    return catalogue.with_missing(p, {"Brand#11": [1, 2, 30], "Brand#22": [5]}).select("p_partkey", "missing")


def placed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    form = F.when(k % 5 == 0, F.concat(F.lit("x S02E"), (k % 9).cast("string"))).when(k % 5 == 1, F.concat(F.lit("x Part "), F.col("p_size").cast("string"))).when(k % 5 == 2, F.concat(F.lit("Episode "), (k % 4).cast("string"))).otherwise("plain")
    folder = F.when(k % 3 == 0, F.concat(F.lit("serial "), (k % 7).cast("string"))).when(k % 3 == 1, F.lit("X 9-12")).otherwise(F.lit(None))
    path = F.concat_ws("/", F.concat(F.lit("Season "), (k % 8).cast("string")), folder, F.concat(form, F.lit(".mkv")))
    single = spark.range(0, 8).select(F.col("id").cast("int").alias("season"), F.lit("serial 3").alias("serial"))
    return catalogue.placed_files(table(spark, d, "part").select("p_partkey", path.alias("path")), single).select("p_partkey", "season", "serial", "part", "reason")


def listed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Part "), F.col("p_size").cast("string"), F.lit(" (Reconstruction)"))).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.lit("nothing"))
    rows = p.select("p_partkey", (F.col("p_partkey") % 40).alias("season"), F.col("p_brand").alias("story"), label.alias("label"))
    episodes = p.where("p_partkey % 2 = 0").groupBy((F.col("p_partkey") % 40).alias("season"), F.col("p_brand").alias("story"), F.col("p_size").alias("part")).agg(F.min("p_partkey").alias("episode"))
    titles = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("episode"), F.col("p_name").alias("title"))
    return catalogue.listed_matches(rows, episodes.join(titles, "episode")).groupBy("p_partkey").agg(F.min("episode").alias("episode"))


def eligible(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    e = o.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("serial"), F.when(F.col("o_orderkey") % 4 == 0, "animation").otherwise("original").alias("kind"), F.when(F.col("o_orderstatus") != "P", "f").alias("file"),
                 F.when(F.col("o_totalprice") > 60000, "yes").otherwise("no").alias("has_subs"), (F.col("o_orderkey") % 11 == 0).alias("animated_story"))
    return catalogue.eligible(e, ["1", "2"]).select("o_orderkey", "reason")


def assembled(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode"), F.substring("o_orderpriority", 1, 1).alias("serial"), (F.col("o_orderkey") % 5).cast("int").alias("part"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("rank")).agg(F.min("l_partkey").cast("string").alias("label"), F.min("l_returnflag").alias("r"))
    files = li.select("episode", "rank", "label", F.when(F.col("r") == "N", F.array().cast("array<string>")).otherwise(F.array("r")).alias("tracks"))
    notes = spark.createDataFrame([("1", None, "all of 1"), ("1", 2, "only 1.2"), ("3", 4, "3.4")], "serial string, part int, note string")
    return catalogue.catalogue_rows(o, files, notes)


def wrong(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("face_id"), (F.col("label") % 4).cast("int").alias("cluster"))
    edits = e.withColumns({"at": F.lit(1), "wrong": F.col("face_id") % 2 == 0}).unionByName(e.where("face_id % 3 = 0").withColumns({"at": F.lit(2), "wrong": F.col("face_id") % 4 == 0}))
    names = spark.createDataFrame([(0, "Ann"), (1, "Bob")], "cluster int, person string")
    return faces.wrong_marks(edits, names)


def srt(spark: SparkSession, d: str) -> DataFrame:
    ev = cues.events_as_subtitles(table(spark, d, "events"))
    return sources.srt_blocks(ev.withColumns({"start": F.col("start") / 40, "end": F.col("end") / 40}))


QUERIES = {
    "p3_missing": missing, "p7_placed_files": placed, "j4_listed_matches": listed, "p10_eligible": eligible, "p16_catalogue_rows": assembled, "m5_wrong_marks": wrong, "s3_srt_blocks": srt,
}

_T = lambda c: f"CAST(round_even({c} / 40 * 1000.0, 0) AS BIGINT)"
_CLOCK = lambda c: f"printf('%02d:%02d:%02d,%03d', {_T(c)} // 3600000, {_T(c)} // 60000 % 60, {_T(c)} // 1000 % 60, {_T(c)} % 1000)"

SQL = {
    "p3_missing": "SELECT p_partkey, (p_brand = 'Brand#11' AND p_size IN (1, 2, 30)) OR (p_brand = 'Brand#22' AND p_size = 5) AS missing FROM part",
    "p7_placed_files": """
        WITH p AS (SELECT p_partkey AS k, p_size AS n, CASE p_partkey % 3 WHEN 0 THEN 'serial ' || (p_partkey % 7) WHEN 1 THEN 'X 9-12' END AS serial, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE p_partkey % 8 END AS season FROM part),
        q AS (SELECT *, CASE WHEN k % 5 = 1 AND n <> 0 THEN n WHEN k % 5 = 2 AND k % 4 <> 0 THEN k % 4 WHEN serial = 'serial 3' THEN 1 END AS c FROM p),
        r AS (SELECT k, season, serial, CASE WHEN k % 5 = 0 THEN k % 9 WHEN serial = 'X 9-12' AND c < 9 THEN c + 8 ELSE c END AS part FROM q)
        SELECT k AS p_partkey, CAST(season AS INT) AS season, serial, CAST(part AS INT) AS part,
               CASE WHEN serial IS NULL THEN 'not in a serial''s folder' WHEN part IS NULL THEN 'no part number' END AS reason FROM r""",
    "j4_listed_matches": """
        WITH e AS (SELECT p_partkey % 40 AS season, p_brand AS story, p_size AS part, min(p_partkey) AS episode FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
        t AS (SELECT e.*, p.p_name AS title FROM e JOIN part p ON p.p_partkey = e.episode)
        SELECT p.p_partkey, CASE p.p_partkey % 3 WHEN 0 THEN min(a.episode) WHEN 1 THEN min(b.episode) END AS episode
        FROM part p LEFT JOIN t a ON a.season = p.p_partkey % 40 AND a.story = p.p_brand AND a.part = p.p_size LEFT JOIN t b ON b.season = p.p_partkey % 40 AND b.story = p.p_brand AND lower(b.title) = lower(p.p_name) GROUP BY p.p_partkey""",
    "p10_eligible": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'story is animated' WHEN o_orderkey % 4 = 0 AND o_orderpriority[1] NOT IN ('1', '2') THEN 'animation' WHEN o_orderstatus = 'P' THEN 'no file' WHEN o_totalprice <= 60000 THEN 'no subtitles' END AS reason FROM orders",
    "p16_catalogue_rows": """
        WITH f AS (SELECT l_orderkey AS episode, l_linenumber AS rank, CAST(min(l_partkey) AS VARCHAR) AS label, min(l_returnflag) AS r FROM lineitem GROUP BY ALL),
        g AS (SELECT episode, arg_min(label, rank) AS version, CASE WHEN arg_min(r, rank) = 'N' THEN '' ELSE arg_min(r, rank) END AS tracks, min(rank) AS best FROM f GROUP BY 1),
        o AS (SELECT f.episode, string_agg(label, '; ' ORDER BY rank) AS others FROM f JOIN g ON g.episode = f.episode AND f.rank > g.best GROUP BY 1)
        SELECT o_orderkey AS episode, o_orderpriority[1] AS serial, CAST(o_orderkey % 5 AS INT) AS part, coalesce(version, '') AS version, CASE WHEN version IS NULL THEN '' WHEN tracks = '' THEN 'no' ELSE 'yes' END AS has_subs,
               coalesce(tracks, '') AS subtitle_tracks, coalesce(others, '') AS other_versions,
               CASE WHEN o_orderpriority LIKE '1%' AND o_orderkey % 5 = 2 THEN 'only 1.2' WHEN o_orderpriority LIKE '1%' THEN 'all of 1' WHEN o_orderpriority LIKE '3%' AND o_orderkey % 5 = 4 THEN '3.4' ELSE '' END AS notes
        FROM orders LEFT JOIN g ON g.episode = o_orderkey LEFT JOIN o ON o.episode = o_orderkey""",
    "m5_wrong_marks": """
        WITH l AS (SELECT vec_id AS face_id, CASE label % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' END AS name, CASE WHEN vec_id % 3 = 0 THEN vec_id % 4 = 0 ELSE vec_id % 2 = 0 END AS wrong FROM embeddings)
        SELECT face_id, CASE WHEN NOT wrong THEN name END AS person, CASE WHEN wrong THEN coalesce(name, '') END AS not_person FROM l WHERE wrong OR name IS NOT NULL""",
    "s3_srt_blocks": f"""
        WITH ev AS (SELECT user_id AS ep, event_id AS ord, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS start, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE + value * 3600.0::DOUBLE AS stop, event_type AS text FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY start, ord) AS number FROM ev)
        SELECT ep, number, number || chr(10) || {_CLOCK("start")} || ' --> ' || {_CLOCK("stop")} || chr(10) || text AS block FROM n""",
}
