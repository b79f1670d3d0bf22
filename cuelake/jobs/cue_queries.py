"""Queries over subtitle events, transcripts and streams, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake import streaming
from cuelake.functions import text as tx
from cuelake.jobs import sql
from cuelake.operators import cues, transcript
from cuelake.staging import table

#: The driver's events as subtitle events.
EV = """
WITH ev AS (SELECT user_id AS ep, event_id AS ord, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS start,
                   (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE + value * 3600.0::DOUBLE AS "end", event_type AS text, value FROM events)
"""
HOLES = EV + """, holes AS (SELECT ep, ord, start, CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 11 = 0 THEN start - 5 ELSE "end" END AS "end", text FROM ev)"""


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return cues.events_as_subtitles(table(spark, d, "events"))


def _holes(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("ord") % 7 == 0, F.lit(None)).when(F.col("ord") % 11 == 0, F.col("start") - 5).otherwise(F.col("end"))
    return _ev(spark, d).withColumn("end", end)


#: Seconds of a time bucket for the test's events, which last hours where cues last seconds.
LONG = 36_000.0


def visible_text(spark: SparkSession, d: str) -> DataFrame:
    return cues.visible_text(_ev(spark, d), LONG)


def timed(spark: SparkSession, d: str) -> DataFrame:
    return cues.timed(_holes(spark, d))


def trimmed(spark: SparkSession, d: str) -> DataFrame:
    return cues.trimmed(_ev(spark, d), 2_000_000.0)


def repaired(spark: SparkSession, d: str) -> DataFrame:
    return cues.repaired_ends(_holes(spark, d), 30_000.0).select("ep", "ord", "start", "end")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    ms = F.when(F.col("event_id") % 5 == 0, F.lit(0.0)).otherwise(F.col("value") * 1000)
    e = cues.events_as_subtitles(table(spark, d, "events")).select("ord", "start")
    raw = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("ep"), ms.alias("ms"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("num_rects"))
    return raw.join(e, "ord").select("ep", F.col("start").alias("pts"), "ms", "num_rects")


def image_spans(spark: SparkSession, d: str) -> DataFrame:
    return cues.image_spans(_frames(spark, d))


def image_at(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    images = ev.where(F.col("ord") % 2 == 1).select("ep", F.col("start").alias("t"), F.col("ord").alias("image"))
    return cues.image_at(ev.where(F.col("ord") % 2 == 0), images, bucket=LONG).select("ep", "ord", "image")


def sharpest(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    frames = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("value").alias("sharpness")).join(ev, "ord").select("ep", F.col("start").alias("t"), "sharpness")
    return cues.sharpest_times(ev, frames, 50_000.0, bucket=LONG)


def cue_lines(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d).withColumn("lines", F.when(F.col("ord") % 2 == 0, F.array("text")).otherwise(F.array(F.col("text"), F.col("ord").cast("string"))))
    out = cues.cue_lines(ev, LONG)
    return out.select("ep", "start", "end", F.array_join("lines", "|").alias("lines"), F.array_join(F.transform("placement", lambda x: x.cast("string")), ",").alias("placement"))


def rederived(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    return cues.rederived(ev.where(F.col("ord") % 3 != 0), ev.where(F.col("ord") % 150 != 1))


def clocks(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    s = F.col("start") / 40
    return ev.select("ord", tx.clock_dashes(s).alias("dashes"), tx.clock_colons(s).alias("colons"), tx.clock_short(s).alias("short"), tx.clock_units(s).alias("units"))


def clock_parse(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d).withColumn("t", tx.clock_colons(F.col("start") / 40))
    return ev.select("ord", F.round(tx.parse_clock(F.col("t")), 3).alias("seconds"), tx.parse_offset(F.concat((F.col("ord") % 100).cast("string"), F.lit("m"))).alias("offset"), tx.parse_clock(F.lit("1:x")).alias("bad"))


def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    return transcript.gap_clusters(_ev(spark, d).select("ep", F.col("start").alias("t")), 28_800.0)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of which one in four is timed; a line's place is its order in time."""
    return _ev(spark, d).select("ep", F.row_number().over(cues.W.partitionBy("ep").orderBy("start")).cast("long").alias("ord"), (F.col("ord") % 90).alias("size"), F.col("ord").alias("k"), "start", "end")


def filled(spark: SparkSession, d: str) -> DataFrame:
    timed_ = F.col("k") % 4 == 0
    lines = _lines(spark, d).select("ep", "ord", "size", F.when(timed_, F.col("start")).alias("start"), F.when(timed_, F.col("start") + 1).alias("end"))
    return transcript.filled_gaps(lines).select("ep", "ord", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def tidied(spark: SparkSession, d: str) -> DataFrame:
    return transcript.tidied(_lines(spark, d).select("ep", "ord", "start", "end"))


def word_ends(spark: SparkSession, d: str) -> DataFrame:
    return transcript.word_ends(_lines(spark, d).select("ep", "ord", (F.col("start") / 20000).alias("start")))


def match_share(spark: SparkSession, d: str) -> DataFrame:
    rows = _ev(spark, d).select("ep", "ord", (F.col("ord") % 9).alias("words"), (F.col("ord") % 9 - F.col("ord") % 5 % 3).alias("matched"))
    return transcript.match_share(rows.where("matched >= 0"))


def _transcript(spark: SparkSession, d: str) -> DataFrame:
    """Lines of conversations, the speaker before each turn's first, some turned into directions."""
    c = table(spark, d, "conversations")
    lines = c.select(F.col("conv_id").alias("ep"), "turn", "role", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    number = F.col("turn") * 1000 + F.col("pos")
    said = F.when((number + F.col("ep")) % 9 == 7, F.concat(F.lit("("), F.col("line"))).when((number + F.col("ep")) % 9 == 2, F.concat(F.col("line"), F.lit(" sighs)"))).otherwise(F.col("line"))
    named = F.when(F.col("pos") == 0, F.concat(F.upper("role"), F.lit(": "), said)).otherwise(said)
    return lines.select("ep", number.cast("long").alias("ord"), named.alias("line"))


#: Numbered lines are headings.
HEADINGS = r"^[0-9]+\.\s"


def spoken(spark: SparkSession, d: str) -> DataFrame:
    return transcript.spoken_lines(_transcript(spark, d), HEADINGS)


def caption_words(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    segs = F.transform(F.split("text", r"\. "), lambda s, i: F.struct(s.alias("text"), F.when(i % 2 == 1, i * 100).alias("offset_ms")))
    return transcript.caption_words(c.select(F.col("conv_id").alias("ep"), F.col("turn").alias("ord"), (F.col("turn") * 5000).alias("start_ms"), segs.alias("segs")))


def word_keys(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    keys = words.select(tx.word_key(F.col("w")).alias("word"), "k").where("word <> ''")  # each word is looked up once
    return keys.groupBy("word").agg(F.sum("k").alias("n"))


def chunked(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return transcript.chunked(c.select(F.col("conv_id").alias("ep"), F.col("turn").alias("ord"), F.regexp_replace("text", r"\s+", " ").alias("text")))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """Words of each conversation's user turns laid over those of all its turns."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("ep"), "turn", "role", F.posexplode(F.split("text", r"\s+")).alias("pos", "w"))
    rows = c.select("ep", "role", (F.col("turn") * 100000 + F.col("pos")).cast("long").alias("i"), tx.word_key(F.col("w")).alias("key")).where("key <> ''")
    return transcript.aligned(rows.where("role = 'user'"), rows.withColumnRenamed("i", "j"))


def ocr(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.ocr_repaired(F.col("text")).alias("text"))


def _outcomes(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "posted").when(F.col("event_type") == "error", "refused").otherwise("transient")
    return events.select(F.col("event_id").cast("string").alias("rkey"), F.col("user_id").cast("string").alias("path"), kind.alias("outcome"), F.col("ts").cast("timestamp").alias("ts"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    reports = streaming.drained(streaming.first_reports(_outcomes(_source(spark, d))), "st2_outcomes", "append")
    out = streaming.outcomes_folded(reports)
    return out.select("path", "posts", F.unix_micros("last_posted").alias("last_posted"), "skip")


def _source(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; a file source watches folders, so a table that is one file is found by its name in its folder."""
    batch = table(spark, d, "events")
    return spark.readStream.schema(batch.schema).parquet(f"{d}/events.parquet*")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.drained(streaming.hourly(_source(spark, d).select(F.col("ts").cast("timestamp").alias("ts"))), "st3_hourly")
    return out.select(F.unix_micros("hour").alias("hour"), "n")


def sliding(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.drained(streaming.sliding_days(_source(spark, d).select(F.col("ts").cast("timestamp").alias("ts"))), "st3_sliding")
    return out.select(F.unix_micros("day_from").alias("day_from"), "n")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = _source(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = streaming.drained(streaming.sessions(rows, "8 hours", "user_id"), "st3_sessions")
    return out.select("user_id", F.unix_micros("first").alias("first"), "n")


QUERIES = {
    "j1_visible_text": visible_text,
    "p17_timed": timed,
    "p9_trimmed": trimmed,
    "w5_repaired_ends": repaired,
    "w4_image_spans": image_spans,
    "j2_image_at": image_at,
    "w14_sharpest_frame": sharpest,
    "a8_cue_lines": cue_lines,
    "j13_rederived": rederived,
    "f1_clocks": clocks,
    "f2_clock_parse": clock_parse,
    "w8_gap_clusters": gap_clusters,
    "w9_filled_gaps": filled,
    "w10_tidied": tidied,
    "w11_word_ends": word_ends,
    "a15_match_share": match_share,
    "w7_spoken_lines": spoken,
    "s8_caption_words": caption_words,
    "f5_word_keys": word_keys,
    "f6_chunks": chunked,
    "j16_aligned": aligned,
    "f7_ocr_repair": ocr,
    "st2_outcomes": outcomes,
    "st3_hourly": hourly,
    "st3_sliding_days": sliding,
    "st3_sessions": sessions,
}

_LINES = EV + """, lines AS (SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY start) AS ord, ord % 90 AS size, ord AS k, start, "end" FROM ev)"""
_MS = "CAST(round_even(start / 40 * 1000.0, 0) AS BIGINT)"
_S = "CAST(floor(start / 40) AS BIGINT)"

_PACK = lambda parts, rule: f"list_reduce({parts}, lambda a, x: a || CASE WHEN {rule} THEN ' ' ELSE chr(10) END || x)"
_LAST = "split_part(a, chr(10), -1)"

SQL = {
    "f6_chunks": f"""
        WITH c AS (SELECT conv_id AS ep, turn AS ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations),
        s AS (SELECT ep, ord, string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM c),
        w AS (SELECT ep, ord, list_transform(ss, lambda s: {{'s': s, 'cl': string_split(regexp_replace(s, '([,;]) ', '\\1' || chr(1), 'g'), chr(1)),
                     'w': string_split({_PACK("string_split(s, ' ')", f"length({_LAST}) + length(x) < 48")}, chr(10))}}) AS ws FROM s),
        p AS (SELECT ep, ord, flatten(list_transform(ws, lambda v: CASE WHEN length(v.s) <= 80 THEN [v.s] WHEN len(list_filter(v.cl, lambda y: length(y) > 80)) = 0 THEN v.cl ELSE v.w END)) AS parts FROM w),
        r AS (SELECT ep, ord, list_filter(string_split({_PACK("parts", f"length({_LAST}) + length(x) < 80 AND NOT regexp_matches({_LAST}, '[?!]$')")}, chr(10)), lambda y: y <> '') AS pieces FROM p)
        SELECT ep, ord, CAST(unnest(range(len(pieces))) AS INT) AS piece, unnest(pieces) AS text FROM r""",
    "j16_aligned": r"""
WITH RECURSIVE n AS (SELECT unnest(['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']) AS w, unnest(range(20)) AS v),
t AS (SELECT unnest(['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']) AS w, unnest(range(2, 10)) * 10 AS v),
num AS (SELECT * FROM n UNION ALL SELECT * FROM t UNION ALL SELECT t.w || n.w, t.v + n.v FROM t, n WHERE n.v BETWEEN 1 AND 9),
parts AS (SELECT conv_id AS ep, turn, role, regexp_split_to_array(text, '\s+') AS ws FROM conversations),
plain AS (SELECT ep, role, turn * 100000 + pos AS place, regexp_replace(lower(w), '[^a-z0-9]', '', 'g') AS w FROM (SELECT ep, turn, role, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM parts)),
words AS (SELECT ep, role, place, coalesce(CAST(num.v AS VARCHAR), plain.w) AS key FROM plain LEFT JOIN num USING (w) WHERE plain.w <> ''),
a AS (SELECT ep, place AS i, key, row_number() OVER (PARTITION BY ep ORDER BY place) - 1 AS x FROM words WHERE role = 'user'),
b AS (SELECT ep, place AS j, key, row_number() OVER (PARTITION BY ep ORDER BY place) - 1 AS y FROM words),
""" + sql.LONGEST_BLOCKS + """,
found AS (SELECT ep, best.x + k AS x, best.y + k AS y FROM (SELECT *, unnest(range(0, -best.neg)) AS k FROM blocks))
SELECT ep, i, j FROM found JOIN a USING (ep, x) JOIN b USING (ep, y)""",
    "w7_spoken_lines": r"""
        WITH s AS (SELECT conv_id AS ep, turn, role, string_split(text, chr(10)) AS ls FROM conversations),
        u AS (SELECT ep, turn, role, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM s),
        t AS (SELECT ep, turn * 1000 + pos AS ord, CASE WHEN pos = 0 THEN upper(role) || ': ' ELSE '' END || CASE (turn * 1000 + pos + ep) % 9 WHEN 7 THEN '(' || line WHEN 2 THEN line || ' sighs)' ELSE line END AS line FROM u),
        m AS (SELECT ep, ord, trim(line) AS line, CASE WHEN starts_with(trim(line), '(') AND NOT contains(line, ')') THEN 1 WHEN contains(line, ')') THEN 0 END AS event FROM t),
        i AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY ep ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM m),
        k AS (SELECT ep, ord, trim(regexp_replace(line, '\([^)]*\)\.?', '', 'g')) AS bare FROM i WHERE inside = 0 AND line <> '' AND coalesce(event, 0) <> 1 AND NOT regexp_matches(line, '^[0-9]+\.\s')),
        n AS (SELECT ep, ord, bare, nullif(regexp_extract(bare, '^((?:[0-9]+(?:st|nd|rd|th) )?[A-Z][A-Z0-9 '']*):\s*(.*)$', 1), '') AS name, regexp_extract(bare, '^((?:[0-9]+(?:st|nd|rd|th) )?[A-Z][A-Z0-9 '']*):\s*(.*)$', 2) AS rest FROM k),
        o AS (SELECT ep, ord, last_value(name IGNORE NULLS) OVER (PARTITION BY ep ORDER BY ord) AS speaker, trim(regexp_replace(CASE WHEN name IS NULL THEN bare ELSE rest END, '\s+', ' ', 'g')) AS text FROM n)
        SELECT ep, ord, speaker, text FROM o WHERE text <> '' AND speaker IS NOT NULL""".replace("\\\\", "\\"),
    "j1_visible_text": EV + """
        , spans AS (SELECT DISTINCT ep, start, "end", (start + "end") / 2 AS mid FROM ev),
        hits AS (SELECT s.ep, s.start, s."end", e.text, min(e.ord) AS first
                 FROM spans s JOIN ev e ON e.ep = s.ep AND e.start <= s.mid AND s.mid < e."end" GROUP BY ALL)
        SELECT ep, start, "end", string_agg(text, chr(10) ORDER BY first) AS text FROM hits GROUP BY ep, start, "end\"""",
    "p17_timed": HOLES + """SELECT ep, ord, start, "end", text FROM holes WHERE trim(text) <> '' AND "end" > start""",
    "p9_trimmed": EV + """SELECT ep, ord, start, least("end", 2000000.0::DOUBLE - 0.1::DOUBLE) AS "end", text FROM ev WHERE start < 2000000.0::DOUBLE - 0.1::DOUBLE""",
    "w5_repaired_ends": HOLES + """
        , s AS (SELECT ep, start, lead(start) OVER (PARTITION BY ep ORDER BY start) AS nxt FROM (SELECT DISTINCT ep, start FROM holes))
        SELECT ep, ord, start, CASE WHEN "end" IS NULL OR "end" <= start THEN least(nxt, start + 30000.0::DOUBLE) ELSE "end" END AS "end" FROM holes JOIN s USING (ep, start)""",
    "w4_image_spans": EV + """
        , f AS (SELECT ep, start AS pts, CASE WHEN ord % 5 = 0 THEN 0 ELSE value * 1000 END AS ms, text <> 'error' AS shown, lead(start) OVER (PARTITION BY ep ORDER BY start) AS nxt FROM ev),
        s AS (SELECT ep, pts AS start, coalesce(CASE WHEN ms > 0 AND ms < 60000 THEN least(pts + ms / 1000.0::DOUBLE, nxt) END, nxt, pts + 2.0::DOUBLE) AS "end" FROM f WHERE shown)
        SELECT * FROM s WHERE "end" > start""",
    "j2_image_at": EV + """
        , c AS (SELECT *, (start + "end") / 2.0::DOUBLE AS mid FROM ev WHERE ord % 2 = 0),
        h AS (SELECT c.ep, c.ord, arg_max(i.ord, i.start) AS image FROM c JOIN ev i ON i.ep = c.ep AND i.ord % 2 = 1 AND i.start >= c.start - 0.01::DOUBLE AND i.start <= c.mid GROUP BY ALL)
        SELECT ep, ord, image FROM c LEFT JOIN h USING (ep, ord)""",
    "w14_sharpest_frame": EV + """
        , c AS (SELECT ep, ord, (start + "end") / 2.0::DOUBLE AS mid, greatest(start + 0.05::DOUBLE, (start + "end") / 2.0::DOUBLE - 50000) AS lo,
                       least("end" - 0.05::DOUBLE, (start + "end") / 2.0::DOUBLE + 50000) AS hi FROM ev),
        h AS (SELECT c.ep, c.ord, f.start AS t, row_number() OVER (PARTITION BY c.ep, c.ord ORDER BY f.value DESC, f.start) AS k
              FROM c JOIN ev f ON f.ep = c.ep AND f.start >= c.lo AND f.start <= c.hi WHERE c.hi - c.lo >= 0.1::DOUBLE)
        SELECT c.ep, c.ord, coalesce(h.t, c.mid) AS frame_time FROM c LEFT JOIN h ON h.ep = c.ep AND h.ord = c.ord AND h.k = 1""",
    "a8_cue_lines": EV + """
        , p AS (SELECT *, CASE WHEN ord % 2 = 0 THEN text ELSE text || '|' || ord END AS lines, CASE WHEN ord % 2 = 0 THEN '1' ELSE '2' END AS n FROM ev),
        s AS (SELECT DISTINCT ep, start, "end", (start + "end") / 2.0::DOUBLE AS mid FROM ev)
        SELECT s.ep, s.start, s."end", string_agg(p.lines, '|' ORDER BY p.ord) AS lines, string_agg(p.n, ',' ORDER BY p.ord) AS placement
        FROM s JOIN p ON p.ep = s.ep AND p.start <= s.mid AND s.mid < p."end" GROUP BY s.ep, s.start, s."end\"""",
    "j13_rederived": EV + """
        , new AS (SELECT ep, printf('%.3f', start) AS k, arg_max(text, ord) AS text FROM ev WHERE ord % 150 <> 1 GROUP BY ALL),
        j AS (SELECT o.ep, o.ord, o.start, o."end", n.text, n.k IS NOT NULL AS hit FROM ev o LEFT JOIN new n ON n.ep = o.ep AND n.k = printf('%.3f', o.start) WHERE o.ord % 3 <> 0)
        SELECT ep, ord, start, "end", text FROM (SELECT *, bool_and(hit) OVER (PARTITION BY ep) AS complete FROM j) WHERE complete""",
    "f1_clocks": EV + f"""
        SELECT ord, printf('%02d-%02d-%02d.%03d', {_MS} // 3600000, {_MS} // 60000 % 60, {_MS} // 1000 % 60, {_MS} % 1000) AS dashes,
               printf('%d:%02d:%02d.%03d', {_MS} // 3600000, {_MS} // 60000 % 60, {_MS} // 1000 % 60, {_MS} % 1000) AS colons,
               CASE WHEN {_S} < 3600 THEN printf('%d:%02d', {_S} // 60, {_S} % 60) ELSE printf('%d:%02d:%02d', {_S} // 3600, {_S} // 60 % 60, {_S} % 60) END AS short,
               CASE WHEN {_S} >= 3600 THEN printf('%dh%02dm', {_S} // 3600, {_S} // 60 % 60) WHEN {_S} >= 60 THEN printf('%dm%02ds', {_S} // 60, {_S} % 60) ELSE printf('%ds', {_S}) END AS units
        FROM ev""",
    "f2_clock_parse": EV + f"""SELECT ord, {_MS} / 1000.0::DOUBLE AS seconds, (ord % 100) * 60.0::DOUBLE AS "offset", NULL::DOUBLE AS bad FROM ev""",
    "w8_gap_clusters": EV + """
        , m AS (SELECT ep, start, CASE WHEN start - lag(start) OVER (PARTITION BY ep ORDER BY start) > 28800 THEN 1 ELSE 0 END AS new FROM ev),
        r AS (SELECT ep, start, sum(new) OVER (PARTITION BY ep ORDER BY start) AS run FROM m),
        g AS (SELECT ep, run, count(*) AS n, min(start) AS first, max(start) AS last FROM r GROUP BY ALL)
        SELECT ep, n, first, last FROM g QUALIFY row_number() OVER (PARTITION BY ep ORDER BY n DESC, run) = 1""",
    "w9_filled_gaps": _LINES + """
        , l AS (SELECT ep, ord, size, CASE WHEN k % 4 = 0 THEN start END AS s, CASE WHEN k % 4 = 0 THEN start + 1 END AS e FROM lines),
        a AS (SELECT *, coalesce(sum(CASE WHEN s IS NOT NULL THEN 1 ELSE 0 END) OVER w, 0) AS island,
                     coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY ep ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
                     first_value(s IGNORE NULLS) OVER (PARTITION BY ep ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
                     least(greatest(0.7::DOUBLE + 0.065::DOUBLE * size, 1), 5) AS want FROM l WINDOW w AS (PARTITION BY ep ORDER BY ord)),
        b AS (SELECT *, count(*) OVER i AS n, sum(want) OVER i AS total, sum(want) OVER (PARTITION BY ep, island, s IS NOT NULL ORDER BY ord) AS run FROM a WINDOW i AS (PARTITION BY ep, island, s IS NOT NULL)),
        c AS (SELECT *, coalesce(nxt - 0.04::DOUBLE, lo + 3 * n) AS hi FROM b),
        x AS (SELECT *, least(1, (hi - lo) / total) AS scale FROM c)
        SELECT ep, ord, round(coalesce(s, hi - (total - run + want) * scale), 6) AS start, round(coalesce(e, hi - (total - run) * scale), 6) AS "end" FROM x""",
    "w10_tidied": _LINES + """
        , n AS (SELECT ep, ord, start, greatest("end", start + 1) AS e, lead(start) OVER (PARTITION BY ep ORDER BY ord) AS nxt FROM lines)
        SELECT ep, ord, start, CASE WHEN nxt IS NULL THEN e ELSE least(e, greatest(nxt - 0.04::DOUBLE, start + 0.3::DOUBLE)) END AS "end" FROM n""",
    "w11_word_ends": _LINES + """
        , w AS (SELECT ep, ord, start / 20000 AS start, lead(start / 20000) OVER (PARTITION BY ep ORDER BY ord) AS nxt FROM lines)
        SELECT ep, ord, start, CASE WHEN nxt IS NULL THEN start + 0.6::DOUBLE ELSE least(nxt, start + 1.0::DOUBLE) END AS "end" FROM w""",
    "a15_match_share": EV + """
        , r AS (SELECT ep, ord, ord % 9 AS words, ord % 9 - ord % 5 % 3 AS matched FROM ev)
        SELECT ep, ord, CASE WHEN words = 0 THEN 0 ELSE CAST(round_even(matched / words * 100, 0) AS BIGINT) END AS percent,
               CASE WHEN words = 0 THEN true ELSE matched / words < 0.6 END AS to_check FROM r WHERE matched >= 0""",
    "s8_caption_words": r"""
        WITH segs AS (SELECT conv_id AS ep, turn AS ord, turn * 5000 AS start_ms, string_split(text, '. ') AS s FROM conversations),
        one AS (SELECT ep, ord, start_ms, i AS seg, s[i + 1] AS t FROM (SELECT *, unnest(range(len(s))) AS i FROM segs)),
        w AS (SELECT ep, ord, seg, (start_ms + CASE WHEN seg % 2 = 1 THEN seg * 100 ELSE 0 END) / 1000.0::DOUBLE AS start, regexp_split_to_array(t, '\s+') AS words FROM one),
        x AS (SELECT ep, ord, seg, start, i AS place, words[i + 1] AS word FROM (SELECT *, unnest(range(len(words))) AS i FROM w))
        SELECT ep, ord, CAST(seg AS INT) AS seg, start, CAST(place AS INT) AS place, word FROM x WHERE regexp_replace(lower(word), '[^a-z0-9]', '', 'g') <> ''""",
    "f5_word_keys": """
        WITH n AS (SELECT unnest(['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']) AS w,
                          unnest(range(20)) AS v),
        t AS (SELECT unnest(['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']) AS w, unnest(range(2, 10)) * 10 AS v),
        num AS (SELECT * FROM n UNION ALL SELECT * FROM t UNION ALL SELECT t.w || n.w, t.v + n.v FROM t, n WHERE n.v BETWEEN 1 AND 9),
        words AS (SELECT regexp_replace(lower(unnest(string_split(text, ' '))), '[^a-z0-9]', '', 'g') AS w FROM documents)
        SELECT coalesce(CAST(num.v AS VARCHAR), words.w) AS word, count(*) AS n FROM words LEFT JOIN num USING (w) WHERE words.w <> '' GROUP BY 1""",
    "st2_outcomes": """
        SELECT CAST(user_id AS VARCHAR) AS path, count(*) FILTER (event_type = 'purchase') AS posts, max(epoch_us(ts)) FILTER (event_type = 'purchase') AS last_posted,
               bool_or(event_type = 'error') AS skip FROM events GROUP BY user_id""",
    "st3_hourly": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour, count(*) AS n FROM events GROUP BY 1",
    "st3_sliding_days": """
        WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h FROM events)
        SELECT epoch_us(h - INTERVAL 1 HOUR * k) AS day_from, count(*) AS n FROM h, range(24) r(k) GROUP BY 1""",
    "st3_sessions": """
        WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 8 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM m)
        SELECT user_id, epoch_us(min(ts)) AS first, count(*) AS n FROM r GROUP BY user_id, run""",
}
