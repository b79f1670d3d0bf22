"""Queries over shots, catalogues and labels, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuelake.functions import text as tx
from cuelake.jobs import sql
from cuelake.operators import catalogue, shots, tags
from cuelake.staging import table


def _shots(spark: SparkSession, d: str) -> DataFrame:
    """Documents as shots: source/lang/'NN - id'/cID.jpg."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    folder = F.concat_ws("/", F.lit("lib"), "source", "lang", F.concat(F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"), F.lit(" - "), (F.col("doc_id") % 7).cast("string")))
    return docs.select("doc_id", "source", "lang", folder.alias("dir"), F.concat(folder, F.lit("/c"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), F.col("n_chars").alias("size"))


SHOTS = """
WITH shots AS (SELECT doc_id, source, lang, n_chars AS size, 'lib/' || source || '/' || lang || '/' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || ' - ' || (doc_id % 7) AS dir,
                      'lib/' || source || '/' || lang || '/' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || ' - ' || (doc_id % 7) || '/c' || doc_id || '.jpg' AS path FROM documents WHERE doc_id IS NOT NULL)
"""


def episode_fields(spark: SparkSession, d: str) -> DataFrame:
    return shots.episode_fields(_shots(spark, d)).select("path", "programme", "series", "episode", "title")


def programme_counts(spark: SparkSession, d: str) -> DataFrame:
    return shots.programme_counts(_shots(spark, d).withColumnRenamed("source", "programme"))


def count_levels(spark: SparkSession, d: str) -> DataFrame:
    return shots.count_levels(_shots(spark, d).withColumnsRenamed({"source": "programme", "lang": "series"}))


def facets(spark: SparkSession, d: str) -> DataFrame:
    """A4: counts of every value that a browser can choose, in one pass."""
    s = _shots(spark, d).select(F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), F.col(c).alias("value")) for k, c in (("programme", "source"), ("series", "lang"))))).alias("x"))
    return s.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def stratified(spark: SparkSession, d: str) -> DataFrame:
    return shots.stratified(_shots(spark, d), F.when(F.col("source") == "src0", "classic").otherwise("rest"), 25, "7").select("class", "path")


def paged(spark: SparkSession, d: str) -> DataFrame:
    return shots.page(_shots(spark, d).select("path", "size"), [F.desc("size"), "path"], 20, 30)


def sorted_by(spark: SparkSession, d: str) -> DataFrame:
    """The first of each way of sorting; no value counts as 0, ties by path."""
    s = _shots(spark, d).withColumn("bright", F.when(F.col("doc_id") % 3 > 0, F.col("size")))
    ways = {"bright": F.desc(F.coalesce("bright", F.lit(0))), "dark": F.coalesce("bright", F.lit(0)), "shuffle": shots.seeded("3", "path")}
    out = None
    for way, order in ways.items():
        one = s.orderBy(order, "path").limit(50).select(F.lit(way).alias("way"), "path")
        out = one if out is None else out.unionByName(one)
    return out


def _labels(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    both = lab.select("doc_id", F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (tag, label)"))
    return both.select("tag", F.col("doc_id").alias("path"), "label")


LABELS = "WITH lab AS (SELECT 'quality' AS tag, doc_id AS path, quality AS label FROM labels UNION ALL SELECT 'toxic', doc_id, toxic FROM labels)"


def browse(spark: SparkSession, d: str) -> DataFrame:
    """P11 + J8: shots of a programme that have a tag, through a semi join."""
    yes = _labels(spark, d).where("tag = 'quality' AND label = 1").select(F.col("path").alias("doc_id"))
    return _shots(spark, d).where(F.startswith("path", F.lit("lib/src1/"))).join(yes, "doc_id", "left_semi").select("path")


def to_do(spark: SparkSession, d: str) -> DataFrame:
    return shots.not_yet(_shots(spark, d), table(spark, d, "labels"), "doc_id").select("path")


def run_selection(spark: SparkSession, d: str) -> DataFrame:
    """Paths that match, then the first of them."""
    return _shots(spark, d).where(F.col("path").rlike("(?i)SRC1[0-9]/.*/c[0-9]*5\\.JPG")).orderBy("path").limit(40).select("path")


def label_summary(spark: SparkSession, d: str) -> DataFrame:
    lab = _labels(spark, d)
    members = tags.members(_probabilities(spark, d), lab)
    return tags.summary(lab, members)


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("path"), ((F.col("doc_id") * 37 % 100) / 100).alias("prob"))
    return docs.withColumn("tag", F.explode(F.array(F.lit("quality"), F.lit("toxic"))))


PROBS = LABELS + ", probs AS (SELECT doc_id AS path, doc_id * 37 % 100 / 100.0::DOUBLE AS prob, unnest(['quality', 'toxic']) AS tag FROM documents WHERE doc_id IS NOT NULL)"


def members(spark: SparkSession, d: str) -> DataFrame:
    return tags.members(_probabilities(spark, d), _labels(spark, d))


def tag_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = members(spark, d)
    return tags.lists_per_shot(table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("path")), rows, "tag")


def weak_negatives(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("path"))
    return tags.weak_negatives(paths, _labels(spark, d).where("tag = 'quality'"), 300, "0")


def latest_labels(spark: SparkSession, d: str) -> DataFrame:
    lab = _labels(spark, d)
    edits = lab.withColumn("at", F.lit(1)).unionByName(lab.where(F.col("path") % 3 == 0).select("tag", "path", F.when(F.col("path") % 2 == 0, 1 - F.col("label")).alias("label"), F.lit(2).alias("at")))
    return tags.latest_labels(edits)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    scored = _probabilities(spark, d).where("tag = 'quality'").select("path", "prob")
    return tags.candidates(scored, _labels(spark, d).where("tag = 'quality'"), "unsure").limit(60).select("path", F.round("rank", 6).alias("rank"))


def cards(spark: SparkSession, d: str) -> DataFrame:
    base = _shots(spark, d).select(F.col("doc_id").alias("path"), "dir")
    emb = table(spark, d, "embeddings").select((F.col("vec_id") % 900).alias("path"), F.col("vec_id").alias("face"), F.col("label").cast("string").alias("person"))
    out = shots.cards(base, emb, members(spark, d))
    faces = F.array_join(F.transform("faces", lambda f: F.concat_ws(":", f["face"].cast("string"), f["person"])), ",")
    return out.select("path", "dir", faces.alias("faces"), F.array_join(F.map_keys("tags"), ",").alias("tags"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("dir"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 4).alias("post_count"),
        (F.col("o_orderkey") % 13 == 0).alias("skip"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400000000).cast("double").alias("start"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("last_posted"),
    )


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _orders(spark, d)
    new = o.where(F.col("path") % 3 != 1).withColumn("price", F.when(F.col("path") % 10 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return o.where(F.col("path") % 3 != 0), new


ORDERS = """
WITH o AS (SELECT o_orderkey AS path, o_custkey AS dir, o_totalprice AS price, o_orderpriority AS title, o_orderkey % 4 AS post_count, o_orderkey % 13 = 0 AS skip,
                  epoch_us(o_orderdate) / 86400000000.0::DOUBLE AS start, epoch_us(o_orderdate) AS last_posted FROM orders),
old AS (SELECT * FROM o WHERE path % 3 <> 0),
new AS (SELECT * REPLACE (CASE WHEN path % 10 = 0 THEN price + 1 ELSE price END AS price) FROM o WHERE path % 3 <> 1)
"""


def upserted(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    out = shots.upserted(old.dropDuplicates(["path"]), new.dropDuplicates(["path"]), "path", ["price", "title"], ["post_count"])
    return out


def changed_dirs(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.groupBy("dir").agg(F.max("last_posted").alias("mtime"), F.count("*").alias("size")) for x in _halves(spark, d))
    return shots.changed_dirs(new, old)


def retired(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return shots.retired(old, new, new.where(F.col("dir") % 2 == 0).select("dir")).select("path", "dir")


def carried_over(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return shots.carried_over(old, new, 120.0).select("dir", "path", "post_count", "last_posted", "from_path")


def next_to_post(spark: SparkSession, d: str) -> DataFrame:
    return shots.next_to_post(_orders(spark, d), 50, "11").select("path", "post_count")


def posting_stats(spark: SparkSession, d: str) -> DataFrame:
    return shots.posting_stats(_orders(spark, d))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    titles = o.select("title").distinct().withColumns({"tag": F.when(F.substring("title", 1, 1) <= "2", "urgent").otherwise("later"), "rank": F.lit(1)}).where("title NOT LIKE '5%'")
    return shots.tagged(o.select("path", "title"), titles)


def titles_absent(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 50).cast("string")).alias("title"), "p_partkey")
    return shots.titles_absent(p, p.where(F.col("p_partkey") % 4 > 0))


def unused_images(spark: SparkSession, d: str) -> DataFrame:
    s = _shots(spark, d).withColumn("overlay", F.when(F.col("doc_id") % 5 == 0, F.to_json(F.struct(F.concat("dir", F.lit("/o"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image")))))
    listing = s.select("dir", F.explode(F.array(F.struct(F.col("path").alias("image"), F.col("size").alias("bytes")), F.struct(F.concat("dir", F.lit("/o"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"), F.lit(7).cast("long").alias("bytes")))).alias("x"))
    return shots.unused_images(listing.select("dir", "x.*"), s)


def post_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    text = tx.rendered("{role} said ({turn}):\\n{text}\\n", {"role": F.col("role"), "turn": F.col("turn"), "text": F.col("text")})
    return c.select("conv_id", "turn", text.alias("post"))


def folder_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    name = F.concat(F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lit(" - "), tx.safe_name(F.col("url")))
    return p.select("page_id", name.alias("folder"))


def page_values(spark: SparkSession, d: str) -> DataFrame:
    """Values taken out of saved pages."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r"var t=(\w+)", 1).alias("script"), F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


def url_list(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a list without comments, their ids, and what can't be read."""
    p = table(spark, d, "pages").select("page_id", F.btrim(F.regexp_replace(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("# "), F.col("url"))).otherwise(F.concat("url", F.lit("  # kept"))), "#.*$", "")).alias("line"))
    pid = F.regexp_extract("line", r"([0-9]+)[^0-9]*$", 1)
    return p.where("line <> ''").select("page_id", pid.alias("pid"), (pid == "").alias("rejected"))


def file_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("lib/"), F.when(F.col("page_id") % 6 == 0, "Extras/").otherwise("x/"), F.when(F.col("page_id") % 7 == 0, "._").otherwise(""), F.lit("f"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 0, ".MKV").when(F.col("page_id") % 4 == 1, ".mp4").otherwise(".txt")).alias("path"))
    return catalogue.episode_files(p, ["mkv", "mp4"], "^(extras|trailers)$")


def parsed_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    size = F.col("p_size") % 10
    word = F.element_at(F.array(*(F.lit(w) for w in tx.NUMBER_WORDS[:10])), size + 1)
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(", Part "), word, F.lit(" ("), F.col("p_brand"), F.lit(")"))).when(F.col("p_partkey") % 4 == 1, F.concat("p_brand", F.lit(" ("), F.col("p_name"), F.lit(", Part "), size.cast("string"), F.lit(")"))).when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit(", Part "), size.cast("string"))).otherwise(F.col("p_name"))
    return catalogue.parsed_names(p.select("p_partkey", name.alias("name"))).select("p_partkey", "story", F.col("part").cast("long").alias("part"), "title")


def in_seasons(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.seasons("1,3,7-9", table(spark, d, "nation"), "n_nationkey").select("n_nationkey", "n_name")


_RULES = [("BRASS", "brass", 5), ("PROMO", "promo", -10), ("LARGE", "large", 2)]
_KINDS = [("STEEL", "recon", 200), ("COPPER", "animation", 100)]


def classified(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.classified(table(spark, d, "part").select("p_partkey", "p_type"), _RULES, _KINDS, F.col("p_type")).select("p_partkey", "kind", F.col("score").cast("long").alias("score"), "labels")


def _tie(*first: Column) -> list[Column]:
    return [*first, *(F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_linestatus"))]


def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return catalogue.best_candidates(li, "l_orderkey", _tie(F.desc("l_quantity"), F.desc(F.col("l_returnflag") != "N")), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))


def dialogue(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    key = F.struct(*_tie(), F.col("l_quantity"), F.col("l_returnflag"))
    subs = F.transform(F.array_sort(F.collect_list(key)), lambda s, i: F.struct(i.alias("idx"), F.when(s["l_returnflag"] == "N", "Info track").otherwise("Full").alias("title")))
    return li.groupBy("l_orderkey").agg(subs.alias("subs")).select("l_orderkey", catalogue.dialogue_track(F.col("subs")).cast("long").alias("track"))


def numbered(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    o = o.withColumn("part", F.when(F.col("path") % 4 != 0, "1").otherwise("1-2"))
    return catalogue.numbered(o, ["dir"], "title", "part", ["path", "start", "price"]).where("part = '1'").select("dir", "path", F.col("first").alias("number"))


def numbered_on(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("click", "view"), F.col("event_id") % 50).alias("n"))
    return catalogue.numbered_on(e, ["user_id"], "event_id").select("user_id", "event_id", "number")


def animated_only(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return catalogue.animated_only(o, ["o_custkey"], F.col("o_orderstatus") != "P", F.col("o_totalprice") > 60000)


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).select((F.col("dir") % 400).alias("pid"), F.col("path"))
    return catalogue.first_seen([o.where(F.col("path") % 2 == 1), o.where(F.col("path") % 2 == 0)], "pid", "path").select("pid", "path")


def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """J6; seasons grow in number with the table, so that each keeps some four folders and serials."""
    p = table(spark, d, "part")
    words = tx.name_words(F.col("p_name"))
    season = F.col("p_partkey") % max(500, -(-p.count() // 4))
    folder = F.concat(F.lpad((F.col("p_partkey") % 30).cast("string"), 2, "0"), F.lit(" - "), "p_type", F.lit(" "), "p_name", F.lit(" 19"), F.col("p_partkey") % 70 + 10)
    folders = p.select(season.alias("season"), F.col("p_type").alias("folder"), catalogue.folder_words(folder).alias("words"))
    serials = p.select(season.alias("season"), F.col("p_name").alias("serial"), words.alias("words"))
    return catalogue.fuzzy_matched(folders, serials, 0.4).select("season", "folder", "serial", F.round("ratio", 6).alias("ratio"))


def catalogue_summary(spark: SparkSession, d: str) -> DataFrame:
    """A18 + P10: episodes by the reason for leaving them out, in one pass."""
    o = table(spark, d, "orders")
    reason = F.when(F.col("o_orderstatus") == "P", "no file").when(F.col("o_totalprice") < 50000, "no subtitles").when(F.col("o_orderpriority").startswith("5"), "animation")
    return o.groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


def folded_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", tx.folded(F.concat(F.lit("  "), F.col("p_name"), F.lit("’s   "), F.col("p_type"))).alias("folded"), F.array_join(tx.name_words(F.concat(F.lit("The Éa & "), F.col("p_name"), F.lit("_of"))), " ").alias("words"))


def overlay_json(spark: SparkSession, d: str) -> DataFrame:
    """F10 + F11: the overlay as JSON, scaled to a frame and kept inside it."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    image = F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("d/"), F.col("l_partkey").cast("string")))
    place = F.least(F.greatest(F.rint(F.col("y") / F.lit(54.0)), F.lit(0.0)), F.lit(1000.0)).cast("long")
    js = F.when(image.isNotNull(), F.to_json(F.struct(image.alias("image"), F.col("x").cast("long").alias("x"), place.alias("y"))))
    return li.groupBy("l_orderkey").agg(F.sum(F.get_json_object(js, "$.x").cast("long") + F.get_json_object(js, "$.y").cast("long")).alias("total"), F.count(js).alias("overlays"))


def record_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", tx.record_key(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id") % 1024).alias("rkey"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """text to runs and back."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.plain_text(tx.segments(F.col("text"))).alias("text"))


QUERIES = {
    "p1_episode_fields": episode_fields, "a1_programme_counts": programme_counts, "a17_count_levels": count_levels, "a4_facets": facets, "t5_stratified": stratified, "t6_page": paged, "t3_sort_modes": sorted_by,
    "p11_browse": browse, "j9_to_do": to_do, "p12_selection": run_selection, "a5_tag_summary": label_summary, "m7_members": members, "a13_tag_lists": tag_lists, "u4_weak_negatives": weak_negatives,
    "m6_label_edits": latest_labels, "t4_candidates": candidates, "j7_cards": cards, "m1_upsert": upserted, "j11_changed_dirs": changed_dirs, "u3_retired": retired, "j3_carry_over": carried_over,
    "t1_next_to_post": next_to_post, "a2_posting_stats": posting_stats, "m3_tagged": tagged, "j14_titles_absent": titles_absent, "j10_unused_images": unused_images, "p13_post_text": post_text,
    "p14_folder_names": folder_names, "s5_page_values": page_values, "s6_url_list": url_list, "p4_episode_files": file_filter, "p2_parsed_names": parsed_names, "p8_seasons": in_seasons, "p5_classified": classified,
    "w6_best_candidates": best_candidates, "p6_dialogue_track": dialogue, "w1_numbered": numbered, "w2_numbered_on": numbered_on, "a9_animated_only": animated_only, "a11_first_seen": first_seen,
    "j6_fuzzy_match": fuzzy, "a18_catalogue_summary": catalogue_summary, "f4_folded_names": folded_names, "f10_overlays": overlay_json, "f14_record_keys": record_keys, "f9_segments": segments,
}

_FIRST = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate, l_linestatus"

SQL = {
    "p1_episode_fields": SHOTS + "SELECT path, source AS programme, lang AS series, CAST(doc_id % 40 AS INT) AS episode, CAST(doc_id % 7 AS VARCHAR) AS title FROM shots",
    "a1_programme_counts": SHOTS + "SELECT source AS programme, count(DISTINCT dir) AS episodes, count(*) AS shots FROM shots GROUP BY 1",
    "a17_count_levels": SHOTS + "SELECT source AS programme, lang AS series, dir, count(*) AS shots, CAST(grouping(source, lang, dir) AS INT) AS level FROM shots GROUP BY ROLLUP (source, lang, dir)",
    "a4_facets": SHOTS + "SELECT 'programme' AS facet, source AS value, count(*) AS n FROM shots GROUP BY 2 UNION ALL SELECT 'series', lang, count(*) FROM shots GROUP BY 2",
    "t5_stratified": SHOTS + "SELECT CASE WHEN source = 'src0' THEN 'classic' ELSE 'rest' END AS class, path FROM shots QUALIFY row_number() OVER (PARTITION BY class ORDER BY md5('7|' || path), path) <= 25",
    "t6_page": SHOTS + "SELECT path, size, (SELECT count(*) FROM shots) AS total FROM shots ORDER BY size DESC, path LIMIT 30 OFFSET 20",
    "t3_sort_modes": SHOTS + """, b AS (SELECT path, coalesce(CASE WHEN doc_id % 3 > 0 THEN size END, 0) AS bright FROM shots)
        (SELECT 'bright' AS way, path FROM b ORDER BY bright DESC, path LIMIT 50) UNION ALL (SELECT 'dark', path FROM b ORDER BY bright, path LIMIT 50)
        UNION ALL (SELECT 'shuffle', path FROM b ORDER BY md5('3|' || path), path LIMIT 50)""",
    "p11_browse": SHOTS + "SELECT path FROM shots WHERE path LIKE 'lib/src1/%' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "j9_to_do": SHOTS + "SELECT path FROM shots WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "p12_selection": SHOTS + r"SELECT path FROM shots WHERE regexp_matches(path, '(?i)SRC1[0-9]/.*/c[0-9]*5\.JPG') ORDER BY path LIMIT 40",
    "a5_tag_summary": PROBS + """, m AS (SELECT p.tag, count(*) AS members FROM probs p LEFT JOIN lab l ON l.tag = p.tag AND l.path = p.path WHERE coalesce(l.label = 1, p.prob >= 0.5) GROUP BY 1),
        k AS (SELECT tag, count(*) FILTER (label = 1) AS yes, count(*) FILTER (label = 0) AS no FROM lab GROUP BY 1) SELECT tag, yes, no, members FROM k JOIN m USING (tag)""",
    "m7_members": PROBS + "SELECT p.tag, p.path, p.prob FROM probs p LEFT JOIN lab l ON l.tag = p.tag AND l.path = p.path WHERE coalesce(l.label = 1, p.prob >= 0.5)",
    "a13_tag_lists": PROBS + """, m AS (SELECT DISTINCT p.tag, p.path FROM probs p LEFT JOIN lab l ON l.tag = p.tag AND l.path = p.path WHERE coalesce(l.label = 1, p.prob >= 0.5))
        SELECT d.doc_id AS path, '["' || string_agg(m.tag, '","' ORDER BY m.tag) || '"]' AS list FROM documents d LEFT JOIN m ON m.path = d.doc_id WHERE d.doc_id IS NOT NULL GROUP BY 1""",
    "u4_weak_negatives": "WITH w AS (SELECT doc_id AS path FROM documents WHERE doc_id IS NOT NULL ORDER BY md5('0|' || doc_id), doc_id LIMIT 300) SELECT path FROM w WHERE path NOT IN (SELECT doc_id FROM labels)",
    "m6_label_edits": LABELS + ", e AS (SELECT *, 1 AS seq FROM lab UNION ALL SELECT tag, path, CASE WHEN path % 2 = 0 THEN 1 - label END, 2 FROM lab WHERE path % 3 = 0) SELECT tag, path, label FROM (SELECT *, row_number() OVER (PARTITION BY tag, path ORDER BY seq DESC) AS k FROM e) WHERE k = 1 AND label IS NOT NULL",
    "t4_candidates": PROBS + "SELECT path, round(abs(prob - 0.5), 6) AS rank FROM probs WHERE tag = 'quality' AND path NOT IN (SELECT doc_id FROM labels) ORDER BY abs(prob - 0.5), path LIMIT 60",
    "j6_fuzzy_match": r"""
        WITH RECURSIVE p AS (SELECT *, p_partkey % greatest(500, CAST(ceil(count(*) OVER () / 4) AS BIGINT)) AS season FROM part),
        texts AS (SELECT season, p_type AS folder, NULL::VARCHAR AS serial, regexp_replace(lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') || ' - ' || p_type || ' ' || p_name || ' 19' || (p_partkey % 70 + 10), '^([0-9]+ - |S[0-9]+ [0-9]+ )', '') AS t FROM p
                  UNION ALL SELECT season, NULL, p_name, p_name FROM p),
        split AS (SELECT season, folder, serial, list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9 ]', '', 'g'), ' '), lambda w: w NOT IN ('', 'the', 'a', 'an', 'of', 'and')) AS ws FROM texts),
        folders AS (SELECT DISTINCT season, folder, CASE WHEN len(list_filter(ws, lambda w: NOT regexp_full_match(w, '[0-9]+'))) > 0 THEN list_filter(ws, lambda w: NOT regexp_full_match(w, '[0-9]+')) ELSE ws END AS ws FROM split WHERE folder IS NOT NULL),
        serials AS (SELECT DISTINCT season, serial, ws FROM split WHERE serial IS NOT NULL),
        both_sides AS (SELECT row_number() OVER () AS ep, season, folder, serial, s.ws AS sw, f.ws AS fw FROM folders f JOIN serials s USING (season)),
        a AS (SELECT ep, unnest(sw) AS key, unnest(range(len(sw))) AS x FROM both_sides),
        b AS (SELECT ep, unnest(fw) AS key, unnest(range(len(fw))) AS y FROM both_sides),""" + sql.LONGEST_BLOCKS + """,
        shared AS (SELECT ep, sum(-best.neg) AS n FROM blocks GROUP BY ep),
        scored AS (SELECT season, folder, serial, CASE WHEN len(sw) + len(fw) = 0 THEN 1 ELSE 2 * coalesce(n, 0)::DOUBLE / (len(sw) + len(fw)) END AS ratio FROM both_sides LEFT JOIN shared USING (ep))
        SELECT season, folder, serial, round(ratio, 6) AS ratio FROM scored WHERE ratio >= 0.4 QUALIFY row_number() OVER (PARTITION BY season, folder ORDER BY ratio DESC, serial) = 1""",
    "j7_cards": PROBS + """, m AS (SELECT p.tag, p.path FROM probs p LEFT JOIN lab l ON l.tag = p.tag AND l.path = p.path WHERE coalesce(l.label = 1, p.prob >= 0.5)),
        t AS (SELECT path, string_agg(tag, ',' ORDER BY tag) AS tags FROM m GROUP BY 1), f AS (SELECT vec_id % 900 AS path, string_agg(vec_id || ':' || label, ',' ORDER BY vec_id) AS faces FROM embeddings GROUP BY 1),
        s AS (SELECT doc_id AS path, 'lib/' || source || '/' || lang || '/' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || ' - ' || (doc_id % 7) AS dir FROM documents WHERE doc_id IS NOT NULL)
        SELECT path, dir, faces, tags FROM s LEFT JOIN f USING (path) LEFT JOIN t USING (path)""",
    "m1_upsert": ORDERS + """SELECT coalesce(o1.path, n1.path) AS path, coalesce(n1.price, o1.price) AS price, coalesce(n1.title, o1.title) AS title, o1.post_count,
        CASE WHEN o1.path IS NULL THEN 'inserted' WHEN n1.path IS NOT NULL AND (n1.price <> o1.price OR n1.title <> o1.title) THEN 'updated' ELSE 'same' END AS change FROM old o1 FULL JOIN new n1 ON n1.path = o1.path""",
    "j11_changed_dirs": ORDERS + ", a AS (SELECT dir, max(last_posted) AS mtime, count(*) AS size FROM old GROUP BY 1), b AS (SELECT dir, max(last_posted) AS mtime, count(*) AS size FROM new GROUP BY 1) SELECT b.* FROM b LEFT JOIN a USING (dir) WHERE a.dir IS NULL OR a.mtime <> b.mtime OR a.size <> b.size",
    "u3_retired": ORDERS + "SELECT path, dir FROM old WHERE dir IN (SELECT dir FROM new WHERE dir % 2 = 0) AND path NOT IN (SELECT path FROM new)",
    "j3_carry_over": ORDERS + """SELECT n.dir, n.path, max(g.post_count) AS post_count, max(g.last_posted) AS last_posted, arg_max(g.path, (g.last_posted, g.path)) AS from_path
        FROM new n JOIN old g ON g.dir = n.dir AND g.post_count > 0 AND abs(n.start - g.start) < 120 GROUP BY n.dir, n.path""",
    "t1_next_to_post": ORDERS + "SELECT path, post_count FROM o WHERE NOT skip ORDER BY post_count, md5('11|' || path), path LIMIT 50",
    "a2_posting_stats": ORDERS + "SELECT count(*) AS shots, count(*) FILTER (post_count > 0) AS posted, min(post_count) FILTER (NOT skip) AS least_posted, count(*) FILTER (skip) AS skipped, max(last_posted) AS latest FROM o",
    "m3_tagged": ORDERS + "SELECT path, title, CASE WHEN title LIKE '5%' THEN NULL WHEN title[1] <= '2' THEN 'urgent' ELSE 'later' END AS tag FROM o",
    "j14_titles_absent": "WITH t AS (SELECT p_name || ' ' || p_partkey % 50 AS title, p_partkey AS k FROM part) SELECT DISTINCT title FROM t WHERE title NOT IN (SELECT title FROM t WHERE k % 4 > 0)",
    "j10_unused_images": SHOTS + "SELECT dir, count(*) AS images, CAST(7 * count(*) AS BIGINT) AS bytes FROM shots WHERE doc_id % 5 <> 0 GROUP BY dir",
    "p13_post_text": "SELECT conv_id, turn, trim(role || ' said (' || turn || '):' || chr(10) || text, ' ' || chr(9) || chr(10) || chr(13)) AS post FROM conversations",
    "p14_folder_names": """SELECT page_id, lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || ' - ' || regexp_replace(url, '[/\\\\:*?"<>|]', '-', 'g') AS folder FROM pages""",
    "s5_page_values": r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'var t=(\w+)', 1) AS script, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links FROM pages""",
    "s6_url_list": r"SELECT page_id, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS pid, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) = '' AS rejected FROM pages WHERE page_id % 5 <> 0",
    "p4_episode_files": """SELECT page_id, 'lib/x/f' || page_id || CASE page_id % 4 WHEN 0 THEN '.MKV' ELSE '.mp4' END AS path FROM pages WHERE page_id % 6 <> 0 AND page_id % 7 <> 0 AND page_id % 4 < 2""",
    "p2_parsed_names": """SELECT p_partkey, p_name AS story, CAST(CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE p_size % 10 END AS BIGINT) AS part, CASE WHEN p_partkey % 4 < 2 THEN p_brand END AS title FROM part""",
    "p8_seasons": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 7, 8, 9)",
    "p5_classified": """SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'recon' WHEN p_type LIKE '%COPPER%' THEN 'animation' ELSE 'original' END AS kind,
        CASE WHEN p_type LIKE '%STEEL%' THEN 200 WHEN p_type LIKE '%COPPER%' THEN 100 ELSE 300 END + CASE WHEN p_type LIKE '%BRASS%' THEN 5 ELSE 0 END + CASE WHEN p_type LIKE '%PROMO%' THEN -10 ELSE 0 END + CASE WHEN p_type LIKE '%LARGE%' THEN 2 ELSE 0 END + 0::BIGINT AS score,
        array_to_string(list_filter([CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' END, CASE WHEN p_type LIKE '%PROMO%' THEN 'promo' END, CASE WHEN p_type LIKE '%LARGE%' THEN 'large' END], lambda x: x IS NOT NULL), '; ') AS labels FROM part""",
    "w6_best_candidates": f"""WITH r AS (SELECT l_orderkey, l_partkey || '-' || l_suppkey AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_returnflag <> 'N' DESC, {_FIRST}) AS k FROM lineitem)
        SELECT l_orderkey, max(f) FILTER (k = 1) AS best, coalesce(string_agg(f, '; ' ORDER BY k) FILTER (k > 1), '') AS others FROM r GROUP BY 1""",
    "p6_dialogue_track": f"WITH r AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_FIRST}, l_quantity, l_returnflag) - 1 AS k FROM lineitem) SELECT l_orderkey, min(k) FILTER (l_returnflag <> 'N') AS track FROM r GROUP BY 1",
    "w1_numbered": ORDERS + "SELECT dir, path, row_number() OVER (PARTITION BY dir ORDER BY path, start, price) AS number FROM o WHERE path % 4 <> 0",
    "w2_numbered_on": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN event_id % 50 END AS n FROM events),
        r AS (SELECT *, count(n) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
        SELECT user_id, event_id, coalesce(max(n) OVER (PARTITION BY user_id, run), 0) + row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - CASE WHEN run > 0 THEN 1 ELSE 0 END AS number FROM r""",
    "a9_animated_only": "SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING bool_and(o_totalprice > 60000)",
    "a11_first_seen": ORDERS + "SELECT dir % 400 AS pid, path FROM o QUALIFY row_number() OVER (PARTITION BY dir % 400 ORDER BY path % 2 = 0, path) = 1",
    "a18_catalogue_summary": "SELECT CASE WHEN o_orderstatus = 'P' THEN 'no file' WHEN o_totalprice < 50000 THEN 'no subtitles' WHEN o_orderpriority LIKE '5%' THEN 'animation' ELSE 'eligible' END AS reason, count(*) AS n FROM orders GROUP BY 1",
    "f4_folded_names": r"""SELECT p_partkey, lower(p_name || '''s ' || p_type) AS folded, array_to_string(list_filter(string_split(regexp_replace(lower('ea  and  ' || p_name || ' of'), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x NOT IN ('', 'the', 'a', 'an', 'of', 'and')), ' ') AS words FROM part""",
    "f10_overlays": "SELECT l_orderkey, sum(CAST(trunc(l_quantity) AS BIGINT) + CAST(least(greatest(round_even(l_extendedprice / 54.0::DOUBLE, 0), 0), 1000) AS BIGINT)) FILTER (l_partkey % 3 > 0)::BIGINT AS total, count(*) FILTER (l_partkey % 3 > 0) AS overlays FROM lineitem GROUP BY 1",
    "f14_record_keys": """WITH v AS (SELECT event_id, epoch_us(ts) * 1024 + event_id % 1024 AS v FROM events)
        SELECT event_id, array_to_string([substr('234567abcdefghijklmnopqrstuvwxyz', CAST((v >> (5 * i)) & 31 AS INT) + 1, 1) for i in range(12, -1, -1)], '') AS rkey FROM v""",
    "f9_segments": """SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)) AS text FROM conversations""",
}
