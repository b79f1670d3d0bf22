"""Timed subtitle events to cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01


def events_as_subtitles(events: DataFrame) -> DataFrame:
    """The driver's events as subtitle events: ep, ord, start, end (s), text."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(1e6)
    return events.select(
        F.col("user_id").alias("ep"),
        F.col("event_id").alias("ord"),
        start.alias("start"),
        (start + F.col("value") * F.lit(3600.0)).alias("end"),
        F.col("event_type").alias("text"),
    )


def midpoint() -> Column:
    return (F.col("start") + F.col("end")) / F.lit(2.0)


def _buckets(df: DataFrame, bucket: float) -> DataFrame:
    """One row per time bucket that [start, end) touches."""
    span = F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))
    return df.where(F.col("start") < F.col("end")).withColumn("_b", F.explode(span))


def _spans(events: DataFrame, bucket: float) -> DataFrame:
    """Every distinct (ep, start, end) with its midpoint and the bucket of that, dealt by episode and bucket: as these follow
    from the span, one shuffle does for telling spans apart, for their join and for what is gathered by span after it."""
    spans = events.select("ep", "start", "end").withColumn("mid", midpoint()).withColumn("_b", F.floor(F.col("mid") / bucket))
    return spans.repartition("ep", "_b").distinct().hint("merge")  # as a broadcast they would grow with the table


def spans_with_events(events: DataFrame, bucket: float) -> DataFrame:
    """Every distinct (ep, start, end), with its bucket _b, with each event visible at its midpoint.

    A span has one bucket, that of its midpoint, and an event has all buckets it touches, so each
    match is found once and a very long episode is spread over many (ep, bucket) keys.
    """
    spans = _spans(events, bucket)
    e = _buckets(events.select("ep", "ord", "text", "start", "end"), bucket).select("ep", "_b", "ord", "text", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    return spans.join(e, ["ep", "_b"]).where((F.col("e_start") <= F.col("mid")) & (F.col("mid") < F.col("e_end")))


def visible_text(events: DataFrame, bucket: float = 10.0) -> DataFrame:
    """J1 + A7: one cue per distinct (ep, start, end) with the distinct texts visible at its midpoint."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    joined = spans_with_events(events, bucket)
    return joined.groupBy("ep", "_b", "start", "end").agg(F.array_join(F.array_distinct(texts), "\n").alias("text")).drop("_b")


def timed(events: DataFrame) -> DataFrame:
    """Events with text and a positive length."""
    return events.where((F.btrim("text") != "") & (F.col("end") > F.col("start")))


def trimmed(events: DataFrame, length: float, margin: float = 0.1) -> DataFrame:
    """Nothing starts or ends within `margin` of the video's end."""
    limit = F.lit(length - margin)
    return events.where(F.col("start") < limit).withColumn("end", F.least("end", limit))


def repaired_ends(events: DataFrame, most: float = 3.0) -> DataFrame:
    """An end that is null or not after its start becomes the next later start of the episode, `most` seconds away at most."""
    starts = events.select("ep", "start").distinct()
    later = starts.withColumn("_next", F.lead("start").over(W.partitionBy("ep").orderBy("start")))
    fix = F.least(F.col("_next"), F.col("start") + F.lit(most))
    broken = F.col("end").isNull() | (F.col("end") <= F.col("start"))
    return events.join(later, ["ep", "start"]).withColumn("end", F.when(broken, fix).otherwise(F.col("end"))).drop("_next")


def image_spans(frames: DataFrame, longest_ms: float = 60_000, fallback: float = 2.0) -> DataFrame:
    """Bitmap frames (ep, pts, ms, num_rects) to spans. Frames without rectangles only end the one before."""
    nxt = F.lead("pts").over(W.partitionBy("ep").orderBy("pts"))
    timed_end = F.when((F.col("ms") > 0) & (F.col("ms") < longest_ms), F.col("pts") + F.col("ms") / F.lit(1000.0))
    end = F.coalesce(F.least(timed_end, "_next"), F.col("_next"), F.col("pts") + F.lit(fallback))
    spans = frames.withColumn("_next", nxt).where(F.col("num_rects") > 0).select("ep", F.col("pts").alias("start"), end.alias("end"))
    return spans.where(F.col("end") > F.col("start"))


def image_at(cues: DataFrame, images: DataFrame, slack: float = 0.01, bucket: float = 10.0) -> DataFrame:
    """For each cue the last image change from `slack` before its start up to its midpoint; null if there is none."""
    c = cues.select("ep", "ord", "start", "end").withColumn("mid", midpoint())
    ranged = c.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start") - slack) / bucket), F.floor(F.greatest("mid", F.col("start") - slack) / bucket))))
    i = images.select("ep", F.col("t"), "image").withColumn("_b", F.floor(F.col("t") / bucket))
    hit = ranged.join(i, ["ep", "_b"]).where((F.col("t") >= F.col("start") - slack) & (F.col("t") <= F.col("mid")))
    best = hit.groupBy("ep", "ord").agg(F.max(F.struct("t", "image")).alias("m")).select("ep", "ord", F.col("m.image").alias("image"))
    return cues.join(best, ["ep", "ord"], "left")


def sharpest_times(cues: DataFrame, frames: DataFrame, window: float, inset: float = 0.05, least: float = 0.1, bucket: float = 10.0) -> DataFrame:
    """Per cue the sharpest frame within `window` of its midpoint, earliest on ties; the midpoint without one."""
    c = cues.select("ep", "ord", "start", "end").withColumn("mid", midpoint())
    c = c.withColumns({"lo": F.greatest(F.col("start") + inset, F.col("mid") - window), "hi": F.least(F.col("end") - inset, F.col("mid") + window)})
    usable = c.where((F.lit(window) > 0) & (F.col("hi") - F.col("lo") >= least))
    ranged = usable.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    f = frames.select("ep", "t", "sharpness").withColumn("_b", F.floor(F.col("t") / bucket))
    hit = ranged.join(f, ["ep", "_b"]).where((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")))
    best = hit.groupBy("ep", "ord").agg(F.max(F.struct("sharpness", (-F.col("t")).alias("minus"), "t")).alias("m"))
    return c.join(best, ["ep", "ord"], "left").select("ep", "ord", F.coalesce("m.t", "mid").alias("frame_time"))


def cue_lines(paragraphs: DataFrame, bucket: float = 10.0) -> DataFrame:
    """Per distinct span all lines visible at its midpoint, in order, and how many each paragraph gives.

    paragraphs: ep, ord, start, end, lines (array of string)."""
    spans = _spans(paragraphs, bucket)
    e = _buckets(paragraphs, bucket).select("ep", "_b", "ord", "lines", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    hit = spans.join(e, ["ep", "_b"]).where((F.col("e_start") <= F.col("mid")) & (F.col("mid") < F.col("e_end")))
    rows = F.array_sort(F.collect_list(F.struct("ord", "lines")))
    grouped = hit.groupBy("ep", "_b", "start", "end").agg(rows.alias("r"))
    return grouped.select("ep", "start", "end", F.flatten("r.lines").alias("lines"), F.transform("r.lines", lambda x: F.size(x)).alias("placement"))


def rederived(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows (ep, start, end) take the text of the re-parsed cue with the same start to the millisecond, all
    of an episode or none; the old end stays, and of cues with equal starts the later counts."""
    key = F.format_string("%.3f", F.col("start"))
    latest = new.withColumn("_k", key).groupBy("ep", "_k").agg(F.max(F.struct("ord", "text")).alias("m")).select("ep", "_k", F.col("m.text").alias("new_text"), F.lit(True).alias("_hit"))
    joined = old.withColumn("_k", key).join(latest, ["ep", "_k"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return joined.withColumn("complete", F.expr("bool_and(_hit) OVER (PARTITION BY ep)")).where("complete").select("ep", "ord", "start", "end", F.col("new_text").alias("text"))
