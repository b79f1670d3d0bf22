"""Queries over files, overlays, frames, loading and browsing, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake import sources, streaming
from cuelake.functions import text as tx
from cuelake.jobs import shot_queries
from cuelake.operators import catalogue, cues, faces, frames, overlay, shots, tags, vectors
from cuelake.sources import ttml
from cuelake.staging import at_rest, shared_dir, small_batches, table, written


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _seasons(spark: SparkSession, d: str) -> DataFrame:
    """Orders as episodes of ten seasons; every fourth is a range of parts."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    part = F.when(k % 4 == 0, F.concat_ws("-", ((k + 1) % 50).cast("string"), ((k + 2) % 50).cast("string"))).otherwise((k % 50).cast("string"))
    return o.select(k.alias("path"), (F.col("o_custkey") % 10).alias("season"), F.col("o_orderpriority").alias("serial"), part.alias("part"), (k % 17 > 0).alias("regular"))


SEASONS = """
WITH e AS (SELECT o_orderkey AS path, o_custkey % 10 AS season, o_orderpriority AS serial, o_orderkey % 4 > 0 AS single, o_orderkey % 17 > 0 AS regular,
                  CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey + 1) % 50 || '-' || (o_orderkey + 2) % 50 ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS part FROM orders)
"""


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.numbered(_seasons(spark, d), ["season"], "serial", "part", ["path"]).select("path", "first", "last")


def ordinals(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.with_ordinals(_seasons(spark, d), "season", ["path"], F.col("regular")).select("path", "ordinal")


def matched(spark: SparkSession, d: str) -> DataFrame:
    e = _seasons(spark, d).where(F.col("part").rlike("^[0-9]+$")).groupBy("season", "serial", F.col("part").cast("long").alias("part")).agg(F.min("path").alias("episode"))
    e = catalogue.with_ordinals(e, "season", ["episode"], F.col("episode") % 17 > 0)
    k = F.col("o_orderkey")
    files = table(spark, d, "orders").select(
        k.alias("file"), (k % 10).alias("season"), F.when(k % 7 > 0, F.col("o_orderpriority")).alias("serial"), (k * 3 % 50).alias("part"), F.when(k % 5 == 0, k % 90).alias("ordinal")
    )
    return catalogue.matched(files, e).select("file", "episode", "reason")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("ep"), ((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0)).alias("failed"))


def gated(spark: SparkSession, d: str) -> DataFrame:
    kept, rejected = catalogue.gated(_frames(spark, d), F.col("failed"))
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False)))


def overlays(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_partkey", "l_suppkey"])
    n = lambda c: F.col(c).cast("double")
    frame, video, canvas = (F.lit(1024.0), F.lit(576.0)), (F.lit(720.0), F.lit(576.0)), (n("l_partkey") % 300 + 700, n("l_suppkey") % 100 + 500)
    left, top = F.when(F.col("l_partkey") % 9 > 0, n("l_quantity")), n("l_quantity") * 3
    placed = overlay.placed_overlay(frame, video, canvas, (left, top, left + n("l_suppkey") % 40, top + 21))
    li = li.withColumn("p", placed).withColumn("c", overlay.cropped(F.lit(1024), F.lit(576), F.when(F.col("l_partkey") % 2 == 0, 4 / 3)))
    up = overlay.uploaded((F.col("c.width"), F.lit(576)), (F.col("p.x") - F.col("c.left"), F.col("p.y"), F.col("p.width"), F.col("p.height")), 1920)
    return li.withColumn("u", up).select("l_orderkey", "l_partkey", "l_suppkey", F.col("c.left").alias("cut"), *(F.col(f"u.{k}").alias(k) for k in ("x", "y", "width", "height")))


def work_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 50 == 0).alias("started"))
    ways = [shots.work_order(o, way, 60).select(F.lit(way).alias("way"), "ord") for way in ("given", "reversed", "shuffled")]
    return ways[0].unionByName(ways[1]).unionByName(ways[2])


def _faces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select((F.col("vec_id") % 350).alias("path"), F.col("label").cast("string").alias("person"), F.col("label").alias("cluster"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("quality = 1").select(F.lit("quality").alias("tag"), F.col("doc_id").alias("path"))


def filters(spark: SparkSession, d: str) -> DataFrame:
    s = shot_queries._shots(spark, d).select(F.col("doc_id").alias("id"), F.col("path").alias("p"), "size")
    f, m = (x.join(s.select("id", "p"), x["path"] == s["id"]).drop("path", "id").withColumnRenamed("p", "path") for x in (_faces(spark, d), _members(spark, d)))
    s = s.select(F.col("p").alias("path"), "size")
    asked = {"some": {"n_faces": "some", "programme": "lib/src0"}, "none": {"n_faces": "none", "tag": "quality"}, "who": {"n_faces": "any", "person": "3", "done": [F.col("size") > 500, F.col("size") < 100]}, "cluster": {"cluster": 4}}
    found = [shots.browsed(s, f, m, **given).select(F.lit(name).alias("asked"), "path") for name, given in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    s = shot_queries._shots(spark, d).select(F.col("source").alias("programme"))
    return shots.facet_counts(s, _faces(spark, d), _members(spark, d), _faces(spark, d))


def detailed_stats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        k.alias("path"), F.col("o_orderpriority").alias("tag"), (k % 4).alias("post_count"), (k % 13 == 0).alias("skip"), F.when(k % 3 == 0, "[]").alias("segments"), F.when(k % 2 == 0, "{}").alias("overlay"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("last_posted"),
    )
    return shots.detailed_stats(o)


def with_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    faces = e.select((F.col("vec_id") * 2).alias("id"), F.col("label").alias("cluster"))
    return frames.with_vectors(faces, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))).groupBy("cluster").agg(F.count("*").alias("faces"), F.sum(F.size("vec").cast("long")).alias("numbers"))


def frame_quality(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a grey picture of eight by eight."""
    level = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 400 + 128))).cast("long")), 2, "0")
    e = table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", level), "")).alias("data"))
    q = frames.frame_quality(F.lit(8), F.lit(8), F.lit(1), F.col("data"))
    return e.withColumn("q", q).select("vec_id", *(F.round(f"q.{k}", 6).alias(k) for k in ("brightness", "contrast", "sharpness")))


def _picture(width: int, height: int, v: list[float]) -> bytes:
    """A vector as a picture: its numbers as levels along both sides, mixed."""
    level = np.clip(np.asarray(v, np.float64) * 400 + 128, 0, 255)
    x, y = (np.interp(np.linspace(0, len(v) - 1, n), np.arange(len(v)), level) for n in (width, height))
    return np.rint((x[None] + y[:, None]) / 2).astype(np.uint8).tobytes()


def block_means() -> Callable[[np.ndarray], np.ndarray]:
    """A model for want of a large one: mean levels of four by four parts of a frame."""

    def predict(batch: np.ndarray) -> np.ndarray:
        n, side, _ = batch.shape
        return batch.reshape(n, 4, side // 4, 4, side // 4).mean(axis=(2, 4)).reshape(n, 16)

    return predict


def frame_files(spark: SparkSession, d: str) -> DataFrame:
    """S9, J9, V5 and V6 as one job: PNG files of many sizes written from vectors, every ninth of them done before; the others read, reduced, measured and given to a model."""
    k = F.col("vec_id")
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (k % 61 * 7 + 200).cast("int").alias("width"), (k % 53 * 9 + 150).cast("int").alias("height"))

    def data(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([sources.png(_picture(w, h, v), w, h) for w, h, v in zip(rows["width"], rows["height"], rows["embedding"], strict=True)])

    folder = _folder(spark, "frames")
    name = F.concat(F.lit("e"), F.col("vec_id") % 10, F.lit("/"), F.col("vec_id").cast("string"), F.lit(".png"))
    spread = e.repartition(e.count() // (16 * frames.FRAMES) + 1)  # a file of vectors may be few tasks
    with small_batches(spark, frames.FRAMES):
        names = written(sources.write_files(spread.select(name.alias("name"), F.pandas_udf(data, "binary")(F.struct("width", "height", "embedding")).alias("data")), folder), "frame-names")
    path = lambda at: F.regexp_extract(at, "(e[0-9]/[0-9]+[.]png)$", 1)
    done = e.where("vec_id % 9 = 0").select(name.alias("path"))
    rows = frames.measured(spark, names.select(F.concat(F.lit(f"{folder}/"), "name").alias("path")), done, block_means, path)
    numbers = {c: F.round(c, 6) for c in ("brightness", "contrast", "sharpness")}
    return rows.withColumns(numbers).withColumn("vec", F.transform("vec", lambda x: F.round(x.cast("double"), 5)))


def _cues(spark: SparkSession, d: str) -> DataFrame:
    ev = cues.events_as_subtitles(table(spark, d, "events"))
    text = F.concat(F.lit('said "'), F.col("text"), F.lit('",\nshot,'), F.col("ord").cast("string"))
    return ev.select("ep", "ord", F.concat(F.lit("c"), F.col("ord").cast("string"), F.lit(".jpg")).alias("shot"), (F.col("start") / 40).alias("start"), (F.col("end") / 40).alias("end"), text.alias("text"))


def csv_files(spark: SparkSession, d: str) -> DataFrame:
    """S1 + S2: cues to CSV files of two kinds and back."""
    c, folder = _cues(spark, d), _folder(spark, "subtitle-csv")
    sources.write_subtitle_csv(c.where("ord % 2 = 0"), f"{folder}/plain")
    runs = F.array(F.array(F.struct(F.col("text").alias("text"), F.lit("#ffffff").alias("colour"))))
    sources.write_subtitle_csv(c.where("ord % 2 = 1").withColumn("segments", runs), f"{folder}/coloured")
    return sources.read_subtitle_csv(spark, f"{folder}/*/*.csv").select("shot", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text", F.col("segments").isNotNull().alias("coloured"), F.col("sub_image").isNull().alias("drawn"))


def srt_files(spark: SparkSession, d: str) -> DataFrame:
    """S3: cues to SRT files and back."""
    folder = _folder(spark, "srt")
    with small_batches(spark, 500):
        sources.write_srt(_cues(spark, d), folder)
    got = sources.read_srt(spark, folder)
    ep = F.nullif(F.regexp_extract("path", r"/ep=(-?[0-9]+)[.]srt$", 1), F.lit("")).cast("long")
    return got.select(ep.alias("ep"), F.col("number").cast("long").alias("number"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """Parts in lists of a hundred."""
    p = table(spark, d, "part").withColumn("list", F.expr("p_partkey div 100"))
    item = F.struct("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("season"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("type"), F.lit("2024-01-01").alias("airdate"))
    return sources.catalogue_json(p.groupBy("list").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("value"))).select("list", "ord", "name", "season", "type", "airdate")


def catalogue_csv(spark: SparkSession, d: str) -> DataFrame:
    """Nulls and empty texts to CSV and back."""
    p = table(spark, d, "part")
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit('", \n'))).alias("notes"), F.when(F.col("p_size") > 9, F.col("p_size")).alias("size"))
    path = _folder(spark, "catalogue-csv")
    sources.write_catalogue_csv(rows, path)
    return sources.read_catalogue_csv(spark, path, "p_partkey long, notes string, size int")


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Saved pages with a state that holds the names of some slices and items."""
    k = F.col("page_id")
    titles = F.when(k % 3 == 0, F.array(F.lit("More"), F.lit("First"), F.lit("Second"))).when(k % 3 == 1, F.array(F.lit("More"))).otherwise(F.array().cast("array<string>"))
    slices = F.transform(titles, lambda t, i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("id"), t.alias("title")))
    items = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.struct(F.when(i % 3 != 1, F.struct(F.concat_ws("-", k.cast("string"), i.cast("string")).alias("id"), F.col("url").alias("title"), F.lit('say "so"').alias("subtitle"))).alias("episode")))
    state = F.to_json(F.struct(F.struct(slices.alias("slices")).alias("header"), items.alias("results")))
    page = F.concat(F.lit("<html><script>window.STATE = "), state, F.lit(";</script>"), F.lit("</html>"))
    return sources.page_state(table(spark, d, "pages").withColumn("html", F.when(k % 10 > 0, page).otherwise(F.col("html"))), r"window\.STATE = (\{.*?\});</script>")


def slices(spark: SparkSession, d: str) -> DataFrame:
    return sources.page_slices(_states(spark, d), "page_id", ["More"])


def items(spark: SparkSession, d: str) -> DataFrame:
    return sources.page_items(_states(spark, d), "page_id")


def _xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def ttml_files(spark: SparkSession, d: str) -> DataFrame:
    """S7 + V10: each conversation as a file, with a paragraph a turn: a coloured run, a line break, and what follows it."""
    c = table(spark, d, "conversations")
    said = _xml(F.regexp_replace("text", r"\s+", " "))
    run = F.concat(F.when(F.col("role") == "user", '<span style="you">').otherwise('<span tts:color="#00FF00ff">'), said, F.lit("<br/>turn</span> "), F.col("turn").cast("string"))
    at = F.concat(F.lit('<p begin="'), F.col("turn").cast("string"), F.lit('s" region="'), F.when(F.col("turn") % 2 == 0, "top").otherwise("none"), F.lit('">'), run, F.lit("</p>"))
    rows = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", at.alias("p")))), lambda x: x["p"]), "").alias("ps"))
    head = '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="http://www.w3.org/ns/ttml#styling"><head><styling><style xml:id="base" tts:color="yellow"/><style xml:id="you" style="base"/></styling><layout><region xml:id="top" tts:origin="10% 10%" tts:extent="80% 30%" tts:displayAlign="before"/></layout></head><body><div>'
    files = rows.select("conv_id", F.concat(F.lit(head), F.col("ps"), F.lit("</div></body></tt>")).alias("xml"))
    return ttml.exploded(files).groupBy("conv_id", "para", "begin", "anchor", F.round("place", 6).alias("place")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "run", "text", "colour"))), lambda r: F.concat_ws("|", r["line"].cast("string"), r["run"].cast("string"), r["text"], r["colour"])), "/").alias("runs"))


def _editions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    old, new = (x.dropDuplicates(["path"]).select("path", "dir", "start", "price", "title", "post_count", "last_posted") for x in shot_queries._halves(spark, d))
    listings = [x.groupBy("dir").agg(F.max("last_posted").alias("mtime"), F.count("*").alias("size")) for x in (old, new)]
    return old, new.select("path", "dir", "start", "price", "title"), *listings


def loaded(spark: SparkSession, d: str) -> DataFrame:
    """M2: shots after the new half of the orders has been loaded."""
    old, new, manifest, listing = _editions(spark, d)
    return shots.loaded(old, manifest, listing, new, ["price", "title"], 120.0)[0].select("path", "dir", "price", "post_count", "last_posted")


def load_counts(spark: SparkSession, d: str) -> DataFrame:
    old, new, manifest, listing = _editions(spark, d)
    return shots.loaded(old, manifest, listing, new, ["price", "title"], 120.0)[2]


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """ST1: the same by a stream of manifests, which then sees the same folders again in a second file."""
    old, new, manifest, listing = _editions(spark, d)
    folder = _folder(spark, "loading")
    streaming.begun(old, manifest, folder)
    schemas = {"shots": old.schema, "manifest": manifest.schema}
    for _ in range(2):
        listing.coalesce(1).write.mode("append").parquet(f"{folder}/incoming")
        stream = spark.readStream.schema(listing.schema).parquet(f"{folder}/incoming")
        streaming.load_continuously(stream, folder, lambda batch: new.join(batch.select("dir").distinct(), "dir", "left_semi").select(*new.columns), ["price", "title"], schemas, 120.0)
    return streaming.stored(spark, folder, "shots", old.schema).select("path", "dir", "price", "post_count", "last_posted")


def replaced_members(spark: SparkSession, d: str) -> DataFrame:
    """M7: members of all tags stored, then those of one tag again by other scores, the others left as they are."""
    lab, prob = shot_queries._labels(spark, d), shot_queries._probabilities(spark, d)
    folder = f"{_folder(spark, 'members')}/members"
    tags.replace_members(tags.members(prob, lab), ["quality", "toxic"], folder)
    tags.replace_members(tags.members(prob.withColumn("prob", 1 - F.col("prob")), lab), ["toxic"], folder)
    return tags.stored_members(prob, folder).withColumn("prob", F.round("prob", 6))


def known_repairs(spark: SparkSession, d: str) -> DataFrame:
    """lines with every misreading that is repaired, made of the names and numbers of parts."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    read = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("| say "), name, F.lit(", It is "), k, F.lit("Q,0@@ or 6-Q")))
    read = read.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("-\\What "), name, F.lit(" -Wwhy, Into "), k, F.lit("@")))
    read = read.otherwise(F.concat(F.lit("“Ves "), name, F.lit(" Isn't It's 3@-Q")))
    return table(spark, d, "part").select("p_partkey", tx.ocr_repaired(read).alias("text"))


def trained_gradient(spark: SparkSession, d: str) -> DataFrame:
    """V7: whether the penalised loss is flat at the trained coefficients (pos -1: the intercept), which it is nowhere else."""
    e = table(spark, d, "embeddings")
    emb = e.select(F.col("vec_id").alias("path"), "embedding")
    marks = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("path"), (F.col("label") < 3).cast("int").alias("label"))
    weak = tags.weak_negatives(emb.select("path"), marks, 100, "0")
    coef, intercept, _ = tags.train(marks, weak, emb)
    rows = written(tags.training_set(marks, weak, emb), "gradient-rows")
    off = vectors.logistic(vectors.dot(F.col("embedding"), vectors.vector(coef)) + intercept) - F.col("label")
    total = rows.agg(F.sum("w")).first()[0]
    each = rows.select((F.col("w") * off / total).alias("g"), F.posexplode(F.concat(F.array(F.lit(1.0).cast("float")), "embedding")).alias("at", "x"))
    pull = F.element_at(vectors.vector([0.0, *coef]), F.col("at") + 1) / (2.0 * total)  # the penalty's share, none for the intercept
    sums = each.groupBy("at").agg(F.sum(F.col("g") * F.col("x")).alias("g"))
    return sums.select((F.col("at") - 1).cast("long").alias("pos"), (F.abs(F.col("g") + pull) < 1e-5).alias("flat"))


def joined_at_rest(spark: SparkSession, d: str) -> DataFrame:
    """J12 and J9 over tables in buckets of the face: faces with vectors, without those that are done."""
    e = table(spark, d, "embeddings")
    held = at_rest(e.select((F.col("vec_id") * 2).alias("id"), F.col("label").alias("cluster")), "faces", "id", 16)
    vecs = at_rest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "vectors", "id", 16)
    done = at_rest(e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id")), "done", "id", 16)
    rows = frames.with_vectors(held, vecs).join(done, "id", "left_anti")
    return rows.groupBy("cluster").agg(F.count("*").alias("faces"), F.sum(F.size("vec").cast("long")).alias("numbers"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (tag, label)")).select("tag", F.col("doc_id").alias("path"), "label")


def tag_summary(spark: SparkSession, d: str) -> DataFrame:
    """A5 and M6: a tag deleted everywhere, the others summed up."""
    lab, held = _labels(spark, d), _labels(spark, d).where("label = 1 AND path % 3 > 0").select("tag", "path")
    defs = table(spark, d, "region").select(F.element_at(F.array(F.lit("quality"), F.lit("gone"), F.lit("a"), F.lit("b"), F.lit("c")), F.col("r_regionkey") + 1).alias("tag"), F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit(0.5))).alias("coef"), (F.col("r_regionkey") / 10).alias("accuracy"))
    return tags.tag_summary(*tags.without_tag([defs, lab, held], "gone"))


def marked_page(spark: SparkSession, d: str) -> DataFrame:
    """T4: a page of what is marked, with the total."""
    lab = _labels(spark, d).where("tag = 'quality'")
    scored = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("path"), (F.col("doc_id") * 37 % 100 / 100).alias("prob"))
    return shots.page(tags.candidates(scored, lab, "marked"), ["rank", "path"], 5, 40)


def halves(spark: SparkSession, d: str) -> DataFrame:
    """how far two-byte floats take each vector from itself."""
    e = table(spark, d, "embeddings").withColumn("h", vectors.halved(F.col("embedding")))
    off = F.array_max(F.zip_with("h", "embedding", lambda a, b: F.abs(a - b)))
    return e.select("vec_id", F.size("h").alias("n"), (off <= 0.0005).alias("close"), F.exists(F.zip_with("h", "embedding", lambda a, b: a != b), lambda x: x).alias("changed"))


def regular_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 > 0, "regular").when(F.col("p_partkey") % 2 > 0, "special").alias("type"))
    return catalogue.regular_names(p, ["blue gizmo", "red widget"]).select("p_partkey")


def presumed(spark: SparkSession, d: str) -> DataFrame:
    p = shot_queries.classified(spark, d)
    return catalogue.presumed(p, F.col("p_partkey") % 3 == 0, "animation", 100, "presumed").select("p_partkey", "kind", F.col("score").cast("long").alias("score"), "labels")


def summed_catalogue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", "f").alias("file"), F.when(F.col("o_totalprice") > 60000, "yes").otherwise("").alias("has_subs"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderpriority")).alias("reason"))
    return catalogue.catalogue_summary(o, o.where("file IS NULL"))


def label_results(spark: SparkSession, d: str) -> DataFrame:
    return faces.label_results(_faces(spark, d))


def progress(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", "n_chars")
    f = _faces(spark, d).withColumn("person", F.when(F.col("cluster") < 7, F.col("person")))
    return faces.progress(s, f, {"quality": F.col("n_chars") > 500, "clip": F.col("doc_id") % 7 == 0})


def tidy_lines(spark: SparkSession, d: str) -> DataFrame:
    """F8: words of a turn as runs in two colours, tidied."""
    c = table(spark, d, "conversations")
    runs = F.transform(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w, i: F.struct(F.concat(F.lit("  "), w, F.lit(" ")).alias("text"), F.when(F.floor(i / 3) % 2 == 0, "W").otherwise("Y").alias("colour")))
    return c.select("conv_id", "turn", F.array_join(F.transform(tx.tidy_runs(runs), lambda r: F.concat(r["colour"], F.lit(":"), r["text"])), "|").alias("runs"))


QUERIES = {
    "a5_tag_summary": tag_summary, "t4_marked_page": marked_page, "f13_halves": halves, "p2_regular_names": regular_names, "p5_presumed": presumed, "a18_summed_catalogue": summed_catalogue, "a14_label_totals": label_results,
    "a3_step_progress": progress, "f8_tidy_lines": tidy_lines,
    "w1_part_numbers": numbered, "w3_ordinals": ordinals, "j5_matched": matched, "a19_gated": gated, "f11_overlays": overlays, "t7_work_order": work_order, "p11_filters": filters, "a4_facet_counts": facet_counts,
    "a2_detailed_stats": detailed_stats, "j12_with_vectors": with_vectors, "j12_at_rest": joined_at_rest, "f7_known": known_repairs, "v7_gradient": trained_gradient, "m7_replaced": replaced_members, "s9_frame_files": frame_files, "v5_frame_quality": frame_quality, "s1_csv_files": csv_files, "s3_srt_files": srt_files, "s4_json_lists": json_lists, "s10_catalogue_csv": catalogue_csv,
    "s5_slices": slices, "s5_items": items, "s7_ttml_runs": ttml_files, "m2_loaded": loaded, "m2_load_counts": load_counts, "st1_streamed": streamed,
}

_FILES = """
WITH ev AS (SELECT user_id AS ep, event_id AS ord, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE / 40 AS s, ((epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE + value * 3600.0::DOUBLE) / 40 AS e,
                   'said "' || event_type || '",' || chr(10) || 'shot,' || event_id AS text FROM events)
"""
_CROP = "CASE WHEN l_partkey % 2 = 0 THEN 768 ELSE 1024 END"
_LOADED = shot_queries.ORDERS + """,
    m AS (SELECT dir, max(last_posted) AS mtime, count(*) AS size FROM old GROUP BY 1), n AS (SELECT dir, max(last_posted) AS mtime, count(*) AS size FROM new GROUP BY 1),
    todo AS (SELECT n.dir FROM n LEFT JOIN m USING (dir) WHERE m.dir IS NULL OR m.mtime <> n.mtime OR m.size <> n.size),
    fresh AS (SELECT * FROM new WHERE dir IN (FROM todo)), gone AS (SELECT * FROM old WHERE dir IN (FROM todo) AND path NOT IN (SELECT path FROM fresh)),
    carried AS (SELECT f.path, max(g.post_count) AS c, max(g.last_posted) AS l FROM fresh f JOIN gone g ON g.dir = f.dir AND g.post_count > 0 AND abs(f.start - g.start) < 120 GROUP BY 1),
    merged AS (SELECT coalesce(f.path, o.path) AS path, coalesce(f.dir, o.dir) AS dir, coalesce(f.price, o.price) AS price, o.post_count AS c, o.last_posted AS l
               FROM old o FULL JOIN fresh f ON f.path = o.path WHERE coalesce(f.path, o.path) NOT IN (SELECT path FROM gone)),
    done AS (SELECT path, dir, price, greatest(coalesce(m.c, 0), coalesce(k.c, 0)) AS post_count, CASE WHEN m.l IS NULL THEN k.l WHEN k.l IS NULL THEN m.l ELSE greatest(m.l, k.l) END AS last_posted FROM merged m LEFT JOIN carried k USING (path))
"""

_LAB = "WITH lab AS (SELECT 'quality' AS tag, doc_id AS path, quality AS label FROM labels UNION ALL SELECT 'toxic', doc_id, toxic FROM labels)"

SQL = {
    "a5_tag_summary": _LAB + """, m AS (SELECT tag, count(*) FILTER (label = 1) AS yes, count(*) FILTER (label = 0) AS no, count(*) FILTER (label = 1 AND path % 3 > 0) AS members FROM lab GROUP BY 1),
        d AS (SELECT ['quality', 'gone', 'a', 'b', 'c'][r_regionkey + 1] AS tag, r_regionkey % 2 = 0 AS trained, r_regionkey / 10.0::DOUBLE AS accuracy FROM region WHERE r_regionkey <> 1)
        SELECT coalesce(m.tag, d.tag) AS tag, coalesce(yes, 0) AS yes, coalesce(no, 0) AS no, coalesce(members, 0) AS members, coalesce(trained, false) AS trained, accuracy FROM m FULL JOIN d ON d.tag = m.tag""",
    "t4_marked_page": """
        SELECT l.doc_id AS path, CAST(-quality AS DOUBLE) AS rank, CASE WHEN l.doc_id % 2 = 0 AND d.doc_id IS NOT NULL THEN l.doc_id * 37 % 100 / 100.0::DOUBLE END AS prob, (SELECT count(*) FROM labels WHERE quality IS NOT NULL) AS total
        FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = l.doc_id ORDER BY 2, 1 LIMIT 40 OFFSET 5""",
    "f13_halves": "SELECT vec_id, CAST(len(embedding) AS INT) AS n, true AS close, true AS changed FROM embeddings",
    "p2_regular_names": "SELECT p_partkey FROM part WHERE p_partkey % 3 > 0 OR p_name IN ('blue gizmo', 'red widget')",
    "p5_presumed": f"WITH c AS ({shot_queries.SQL['p5_classified']}), o AS (SELECT *, p_partkey % 3 = 0 AND labels = '' AS odd FROM c) SELECT p_partkey, CASE WHEN odd THEN 'animation' ELSE kind END AS kind, CASE WHEN odd THEN 100 ELSE score END AS score, CASE WHEN odd THEN 'presumed' ELSE labels END AS labels FROM o",
    "a18_summed_catalogue": """
        SELECT 'rows' AS what, count(*) AS n FROM orders UNION ALL SELECT 'with a file', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'with subtitles', count(*) FROM orders WHERE o_totalprice > 60000
        UNION ALL SELECT CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority ELSE 'unknown' END, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""",
    "a14_label_totals": "SELECT CAST(label AS VARCHAR) AS person, CAST(grouping(label) AS INT) AS level, count(*) AS faces, count(DISTINCT vec_id % 350) AS shots FROM embeddings GROUP BY ROLLUP (label)",
    "a3_step_progress": """
        WITH t AS (SELECT count(*) AS total, count(*) FILTER (n_chars > 500) AS q, count(*) FILTER (doc_id % 7 = 0) AS c FROM documents), f AS (SELECT count(*) AS n, count(*) FILTER (label < 7) AS named, count(DISTINCT vec_id % 350) AS shown FROM embeddings)
        SELECT 'quality' AS step, q AS done, total FROM t UNION ALL SELECT 'clip', c, total FROM t UNION ALL SELECT 'named faces', named, n FROM f UNION ALL SELECT 'shots with a face', shown, total FROM t, f""",
    "f8_tidy_lines": """
        WITH w AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x, i: {'w': x, 'g': (i - 1) // 3}), lambda y: true) AS ws FROM conversations),
        u AS (SELECT conv_id, turn, unnest(range(len(ws))) AS i, unnest(ws) AS x FROM w),
        g AS (SELECT conv_id, turn, x.g AS g, ' ' || string_agg(CASE WHEN x.w = '' THEN '' ELSE x.w || ' ' END, '' ORDER BY i) AS t FROM u GROUP BY ALL),
        b AS (SELECT *, max(g) OVER (PARTITION BY conv_id, turn) AS last FROM g),
        e AS (SELECT conv_id, turn, g, CASE WHEN g = 0 AND g = last THEN trim(t) WHEN g = 0 THEN ltrim(t) WHEN g = last THEN rtrim(t) ELSE t END AS t FROM b)
        SELECT conv_id, turn, coalesce(string_agg(CASE WHEN g % 2 = 0 THEN 'W:' ELSE 'Y:' END || t, '|' ORDER BY g) FILTER (t <> ''), '') AS runs FROM e GROUP BY 1, 2""",
    "w1_part_numbers": SEASONS + """,
        n AS (SELECT *, CASE WHEN single THEN CAST(sum(CAST(single AS INT)) OVER (PARTITION BY season ORDER BY path) AS BIGINT) END AS n FROM e),
        k AS (SELECT season, serial, part, max(n) AS n FROM n WHERE single GROUP BY ALL)
        SELECT n.path, CASE WHEN single THEN n.n ELSE a.n END AS first, CASE WHEN single THEN n.n ELSE b.n END AS last
        FROM n LEFT JOIN k a ON a.season = n.season AND a.serial = n.serial AND a.part = split_part(n.part, '-', 1) LEFT JOIN k b ON b.season = n.season AND b.serial = n.serial AND b.part = split_part(n.part, '-', 2)""",
    "w3_ordinals": SEASONS + "SELECT path, CASE WHEN regular THEN CAST(sum(CAST(regular AS INT)) OVER (PARTITION BY season ORDER BY path) AS BIGINT) END AS ordinal FROM e",
    "j5_matched": SEASONS + """,
        p AS (SELECT season, serial, CAST(part AS BIGINT) AS part, min(path) AS episode FROM e WHERE single GROUP BY ALL),
        q AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY episode) AS ordinal FROM p WHERE episode % 17 > 0),
        f AS (SELECT o_orderkey AS file, o_orderkey % 10 AS season, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS serial, o_orderkey * 3 % 50 AS part, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 90 END AS ordinal FROM orders)
        SELECT f.file, coalesce(p.episode, q.episode) AS episode, CASE WHEN p.episode IS NULL AND q.episode IS NULL THEN CASE WHEN f.serial IS NULL THEN 'no serial' ELSE 'no such part' END END AS reason
        FROM f LEFT JOIN p ON p.season = f.season AND p.serial = f.serial AND p.part = f.part LEFT JOIN q ON q.season = f.season AND q.ordinal = f.ordinal""",
    "a19_gated": """
        SELECT user_id AS ep, count(*) AS frames, count(*) FILTER (event_type = 'error' AND event_id % 4 = 0) AS failed, count(*) FILTER (event_type = 'error' AND event_id % 4 = 0) <= count(*) // 20 AS kept FROM events GROUP BY 1""",
    "f11_overlays": f"""
        WITH l AS (SELECT DISTINCT ON (l_orderkey, l_partkey, l_suppkey) l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem),
        b AS (SELECT *, l_partkey % 300 + 700.0::DOUBLE AS cw, l_suppkey % 100 + 500.0::DOUBLE AS ch, {_CROP} AS fw, (1024 - {_CROP}) // 2 AS cut, l_partkey % 9 > 0 AS seen FROM l),
        p AS (SELECT *, CAST(round_even(((720.0::DOUBLE - cw) / 2 + l_quantity) * (1024.0::DOUBLE / 720.0::DOUBLE), 0) AS BIGINT) - cut AS px, CAST(round_even(((576.0::DOUBLE - ch) / 2 + l_quantity * 3), 0) AS BIGINT) AS py,
                     greatest(1, CAST(round_even((l_suppkey % 40) * (1024.0::DOUBLE / 720.0::DOUBLE), 0) AS BIGINT)) AS pw, 21 AS ph, 1920.0::DOUBLE / fw AS s FROM b),
        u AS (SELECT *, CAST(round_even(fw * s, 0) AS BIGINT) AS uw, CAST(round_even(576 * s, 0) AS BIGINT) AS uh, CAST(round_even(pw * s, 0) AS BIGINT) AS w, CAST(round_even(ph * s, 0) AS BIGINT) AS h FROM p)
        SELECT l_orderkey, l_partkey, l_suppkey, CAST(cut AS BIGINT) AS cut, CASE WHEN seen THEN least(greatest(CAST(round_even(px * s, 0) AS BIGINT), 0), greatest(uw - w, 0)) END AS x,
               CASE WHEN seen THEN least(greatest(CAST(round_even(py * s, 0) AS BIGINT), 0), greatest(uh - h, 0)) END AS y, CASE WHEN seen THEN w END AS width, CASE WHEN seen THEN h END AS height FROM u""",
    "t7_work_order": """
        (SELECT 'given' AS way, o_orderkey AS ord FROM orders ORDER BY 2 LIMIT 60) UNION ALL (SELECT 'reversed', o_orderkey FROM orders ORDER BY 2 DESC LIMIT 60)
        UNION ALL (SELECT 'shuffled', o_orderkey FROM orders ORDER BY o_orderkey % 50 = 0 DESC, md5('0|' || o_orderkey), o_orderkey LIMIT 60)""",
    "p11_filters": shot_queries.SHOTS + """, f AS (SELECT vec_id % 350 AS doc_id, label FROM embeddings), n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1), q AS (SELECT doc_id FROM labels WHERE quality = 1)
        SELECT 'some' AS asked, path FROM shots WHERE path LIKE 'lib/src0/%' AND doc_id IN (SELECT doc_id FROM n WHERE n > 1)
        UNION ALL SELECT 'none', path FROM shots WHERE doc_id NOT IN (SELECT doc_id FROM n) AND doc_id IN (FROM q)
        UNION ALL SELECT 'who', path FROM shots WHERE doc_id IN (SELECT doc_id FROM f WHERE label = 3) AND (size > 500 OR size < 100)
        UNION ALL SELECT 'cluster', path FROM shots WHERE doc_id IN (SELECT doc_id FROM f WHERE label = 4)""",
    "a4_facet_counts": """
        SELECT 'programme' AS facet, source AS value, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'person', CAST(label AS VARCHAR), count(DISTINCT vec_id % 350) FROM embeddings GROUP BY 2
        UNION ALL SELECT 'tag', 'quality', count(*) FROM labels WHERE quality = 1 HAVING count(*) > 0 UNION ALL SELECT 'cluster', CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY 2""",
    "a2_detailed_stats": """
        WITH o AS (SELECT o_orderkey AS path, o_orderpriority AS tag, o_orderkey % 4 AS post_count, o_orderkey % 13 = 0 AS skip, o_orderkey % 3 = 0 AS drawn, o_orderkey % 2 = 0 AS over, epoch_us(o_orderdate) AS last_posted FROM orders)
        SELECT tag, CAST(grouping(tag) AS INT) AS level, count(*) AS shots, count(*) FILTER (post_count > 0) AS posted, min(post_count) FILTER (NOT skip) AS least_posted, count(*) FILTER (drawn) AS drawn,
               count(*) FILTER (NOT drawn AND over) AS pasted, count(*) FILTER (NOT drawn AND NOT over) AS burned_in, count(*) FILTER (skip) AS skipped, arg_max(path, (last_posted, path)) AS latest FROM o GROUP BY ROLLUP (tag)""",
    "f7_known": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'I say ' || p_name || ', it is ' || p_partkey || '0,000 or 6-0' WHEN 1 THEN '-What ' || p_name || ' -Why, into ' || p_partkey || '0'
        ELSE '-Yes ' || p_name || ' Isn''t it''s 30-0' END AS text FROM part""",
    "v7_gradient": "SELECT DISTINCT unnest(range(-1, len(embedding)))::BIGINT AS pos, true AS flat FROM embeddings",
    "j12_at_rest": "SELECT a.label AS cluster, count(*) AS faces, CAST(sum(len(b.embedding)) AS BIGINT) AS numbers FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id * 2 WHERE b.vec_id % 5 <> 0 GROUP BY 1",
    "m7_replaced": shot_queries.PROBS + """SELECT p.tag, p.path, round(CASE WHEN p.tag = 'toxic' THEN 1 - p.prob ELSE p.prob END, 6) AS prob FROM probs p LEFT JOIN lab l ON l.tag = p.tag AND l.path = p.path
        WHERE coalesce(l.label = 1, CASE WHEN p.tag = 'toxic' THEN 1 - p.prob ELSE p.prob END >= 0.5)""",
    "j12_with_vectors": "SELECT a.label AS cluster, count(*) AS faces, CAST(sum(len(b.embedding)) AS BIGINT) AS numbers FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id * 2 GROUP BY 1",
    "v5_frame_quality": """
        WITH u AS (SELECT vec_id, unnest(range(64)) AS i, greatest(0, least(255, floor(CAST(unnest(embedding) AS DOUBLE) * 400 + 128))) AS v FROM embeddings), g AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, v FROM u),
        a AS (SELECT g.vec_id, g.r, g.c, g.v, sum(h.v) AS block FROM g JOIN g h ON h.vec_id = g.vec_id AND abs(h.r - g.r) <= 1 AND abs(h.c - g.c) <= 1 GROUP BY ALL),
        e AS (SELECT vec_id, v, CASE WHEN r IN (0, 7) OR c IN (0, 7) THEN v ELSE greatest(0, least(255, 9 * v - block)) END AS edge FROM a)
        SELECT vec_id, round(avg(v), 6) AS brightness, round(stddev_pop(v), 6) AS contrast, round(var_pop(edge), 6) AS sharpness FROM e GROUP BY 1""",
    "s1_csv_files": _FILES + """SELECT 'c' || ord || '.jpg' AS shot, CAST(printf('%.3f', s) AS DOUBLE) AS start, CAST(printf('%.3f', e) AS DOUBLE) AS "end", text, ord % 2 = 1 AS coloured, true AS drawn FROM ev""",
    "s3_srt_files": _FILES + """SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY s, ord) AS number, round_even(s * 1000.0, 0) / 1000 AS start, round_even(e * 1000.0, 0) / 1000 AS "end", text FROM ev""",
    "s4_json_lists": "SELECT p_partkey // 100 AS list, CAST(row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS INT) AS ord, p_name AS name, p_size AS season, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS type, '2024-01-01' AS airdate FROM part",
    "s10_catalogue_csv": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_name || '\", ' || chr(10) END AS notes, CASE WHEN p_size > 9 THEN p_size END AS size FROM part",
    "s5_slices": """
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 's' || i END AS slice, CASE WHEN page_id % 3 > 0 THEN '' WHEN i = 1 THEN 'First' ELSE 'Second' END AS title FROM pages, (SELECT unnest([1, 2]) AS i) WHERE page_id % 10 > 0 AND (i = 1 OR page_id % 3 = 0)""",
    "s5_items": """
        SELECT page_id, CAST(i AS INT) AS ord, page_id || '-' || i AS id, url AS title, 'say "so"' AS subtitle FROM pages, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE page_id % 10 > 0 AND i <= page_id % 4 AND i % 3 <> 1""",
    "s7_ttml_runs": """
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS para, regexp_replace(text, '\\s+', ' ', 'g') AS said, CASE WHEN role = 'user' THEN '#yellow' ELSE '#00ff00' END AS colour FROM conversations)
        SELECT conv_id, CAST(para AS INT) AS para, turn || 's' AS begin, CASE WHEN turn % 2 = 0 THEN 'top' ELSE 'bottom' END AS anchor, CASE WHEN turn % 2 = 0 THEN 0.1::DOUBLE ELSE 0.95::DOUBLE END AS place,
               CASE WHEN said = '' THEN '' ELSE '0|0|' || said || '|' || colour || '/' END || '1|0|turn|' || colour || '/1|1| ' || turn || '|#ffffff' AS runs FROM t""",
    "m2_loaded": _LOADED + "SELECT * FROM done",
    "m2_load_counts": _LOADED + """SELECT (SELECT count(*) FROM todo WHERE dir NOT IN (SELECT dir FROM old)) AS new_episodes, (SELECT count(*) FROM done) - (SELECT count(*) FROM old) + (SELECT count(*) FROM gone) AS added,
        (SELECT count(*) FROM gone) AS removed, (SELECT count(*) FROM done) AS total""",
    "st1_streamed": _LOADED + "SELECT * FROM done",
}
