"""Episodes of a catalogue, the files of a library, and which belongs to which."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuelake.functions.text import name_words, number_map
from cuelake.operators.alignment import matches
from cuelake.staging import written


def _part(text: Column) -> Column:
    """Digits or a number word up to fourteen."""
    return F.coalesce(F.try_element_at(number_map(14), F.lower(text)), text).try_cast("int")


def parsed_names(episodes: DataFrame, name: str = "name") -> DataFrame:
    """Story, part and title of an episode name: `X, Part N (T)`, `T (X, Part N)`, `X, Part N`, else all of it as part 1."""
    n = F.col(name)
    forms = [(r"^(.+), Part (\w+) \((.+)\)$", (1, 2, 3)), (r"^(.+) \((.+), Part (\w+)\)$", (2, 3, 1)), (r"^(.+), Part (\w+)$", (1, 2, None))]
    story, part, title = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for pattern, (s, p, t) in forms:
        number = _part(F.regexp_extract(n, pattern, p))
        take = number.isNotNull() & story.isNull()
        story, part, title = (
            F.when(take, F.regexp_extract(n, pattern, s)).otherwise(story),
            F.when(take, number).otherwise(part),
            F.when(take, F.regexp_extract(n, pattern, t) if t else F.lit(None)).otherwise(title),
        )
    return episodes.withColumns({"story": F.coalesce(story, n), "part": F.coalesce(part, F.lit(1)), "title": title})


def episode_files(files: DataFrame, kinds: list[str], extras: str, path: str = "path") -> DataFrame:
    """Files of the wanted kinds, no hidden ones, none below a folder of extras."""
    parts = F.split(F.col(path), "/")
    name = F.element_at(parts, -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return files.where(kind.isin(kinds) & ~F.startswith(name, F.lit("._")) & ~F.exists(folders, lambda f: f.rlike(f"(?i){extras}")))


def seasons(spec: str, rows: DataFrame, column: str) -> DataFrame:
    """Rows whose season is in a list such as 1,3,7-9."""
    one = rows.sparkSession.createDataFrame([(spec,)], "spec string").select(F.explode(F.split("spec", ",")).alias("r"))
    ends = F.split("r", "-")
    wanted = one.select(F.explode(F.sequence(F.btrim(ends[0]).cast("int"), F.btrim(F.element_at(ends, -1)).cast("int"))).alias(column))
    return rows.join(F.broadcast(wanted.distinct()), column, "left_semi")


def regular_names(episodes: DataFrame, specials: list[str], kind: str = "type", name: str = "name") -> DataFrame:
    """Regular episodes, and of the others only the specials that are listed by name."""
    return episodes.where((F.coalesce(kind, F.lit("")) == "regular") | F.coalesce(F.col(name).isin(specials), F.lit(False)))


def presumed(files: DataFrame, missing: Column, kind: str, points: int, label: str) -> DataFrame:
    """P5: of `classified` files of missing episodes, those without any label are presumed to be of a kind, with its points, and say so."""
    odd = F.coalesce(missing, F.lit(False)) & (F.col("labels") == "")
    return files.withColumns({"kind": F.when(odd, kind).otherwise(F.col("kind")), "score": F.when(odd, points).otherwise(F.col("score")), "labels": F.when(odd, label).otherwise(F.col("labels"))})


def catalogue_summary(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """Rows (what, n): all rows, those with a file, those with subtitles, and rejects by reason. rows: file, has_subs; rejects: reason."""
    one = rows.agg(F.count("*").alias("a"), F.count_if(F.coalesce("file", F.lit("")) != "").alias("b"), F.count_if(F.col("has_subs") == "yes").alias("c"))
    counts = one.select(F.expr("stack(3, 'rows', a, 'with a file', b, 'with subtitles', c) AS (what, n)"))
    return counts.unionByName(rejects.groupBy(F.coalesce("reason", F.lit("unknown")).alias("what")).agg(F.count("*").alias("n")))


def classified(files: DataFrame, rules: list[tuple[str, str, int]], kinds: list[tuple[str, str, int]], text: Column) -> DataFrame:
    """P5: the first kind whose pattern fits gives kind and points; every version rule that fits adds its points and label, in order."""
    kind, points = F.lit("original"), F.lit(300)
    for pattern, name, worth in reversed(kinds):
        kind, points = F.when(text.rlike(pattern), name).otherwise(kind), F.when(text.rlike(pattern), worth).otherwise(points)
    extra, labels = F.lit(0), []
    for pattern, label, worth in rules:
        extra = extra + F.when(text.rlike(pattern), worth).otherwise(0)
        labels.append(F.when(text.rlike(pattern), F.lit(label)))
    return files.withColumns({"kind": kind, "score": points + extra, "labels": F.array_join(F.array_compact(F.array(*labels)), "; ")})


def dialogue_track(subs: Column) -> Column:
    """Index of the first subtitle track (idx, title) whose title doesn't say info."""
    return F.try_element_at(F.filter(subs, lambda s: ~F.contains(F.lower(F.coalesce(s["title"], F.lit(""))), F.lit("info"))), F.lit(1))["idx"]


def numbered(rows: DataFrame, season: list[str], serial: str, part: str, order: list[str]) -> DataFrame:
    """Rows with `first` and `last`, their numbers within the season in order, where only rows of a single part count.

    A row whose part is a range (`lo-hi`) has the numbers of its end parts of the same serial; of parts that
    stand twice, the later row's. Null where an end part isn't there, or part is neither a number nor a range.
    """
    single = F.col(part).rlike("^[0-9]+$")
    number = F.sum(single.cast("int")).over(W.partitionBy(*season).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)).cast("long")
    counted = rows.withColumn("_n", F.when(single, number))
    ends = [F.regexp_extract(part, r"^([0-9]+)-([0-9]+)$", k).try_cast("int") for k in (1, 2)]
    ranges = counted.where(~single).withColumns({"_lo": ends[0], "_hi": ends[1]})
    known = counted.where(single).groupBy(*season, serial, F.col(part).cast("int").alias("_p")).agg(F.max("_n").alias("_e"))
    lo, hi = (known.withColumnsRenamed({"_p": f"_{k}", "_e": name}) for k, name in (("lo", "first"), ("hi", "last")))
    of_ranges = ranges.join(lo, [*season, serial, "_lo"], "left").join(hi, [*season, serial, "_hi"], "left")
    columns = [*rows.columns, "first", "last"]
    return counted.where(single).withColumns({"first": F.col("_n"), "last": F.col("_n")}).select(*columns).unionByName(of_ranges.select(*columns))


def with_ordinals(episodes: DataFrame, season: str, order: list[str], regular: Column) -> DataFrame:
    """The ordinal of regular episodes within their season; null for specials, which don't count."""
    count = F.sum(regular.cast("int")).over(W.partitionBy(season).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return episodes.withColumn("ordinal", F.when(regular, count).cast("long"))


def gated(frames: DataFrame, failed: Column, share: int = 20) -> tuple[DataFrame, DataFrame]:
    """Episodes (ep, frames, failed) that are kept, and those of which more than a `share`-th of the frames, rounded down, failed."""
    counts = frames.groupBy("ep").agg(F.count("*").alias("frames"), F.count_if(failed).alias("failed"))
    bad = F.col("failed") > F.floor(F.col("frames") / share)
    return counts.where(~bad), counts.where(bad)


def seq_ratio(a: Column, b: Column) -> Column:
    """V1: how alike two arrays are, 2 x the elements of their longest common blocks of all elements; 1 for two empty ones, null for a null."""

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        known = (xs.notna() & ys.notna()).to_numpy()
        x, y = ([list(v) for v in side[known]] for side in (xs, ys))
        sizes = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
        out = np.full(len(xs), np.nan)
        out[known] = np.where(sizes > 0, 2 * matches(x, y) / np.maximum(sizes, 1), 1.0)
        return pd.Series(out).where(known, None)

    return F.pandas_udf(run, "double")(a, b)


def multi_part_row(rows: DataFrame, files: DataFrame, serial: str, part: str) -> DataFrame:
    """The rows and one more for a file of several parts (part as `1-7`), if files (serial, label, tracks) have one of the serial: its best by rank."""
    best = files.where(F.col("serial") == serial).groupBy("serial").agg(F.min_by(F.struct("label", "tracks"), "rank").alias("f"))
    has = F.when(F.size("f.tracks") > 0, "yes").otherwise("no")
    more = best.select("serial", F.lit(part).alias("part"), F.col("f.label").alias("version"), has.alias("has_subs"), F.array_join("f.tracks", "; ").alias("subtitle_tracks"))
    return rows.withColumn("part", F.col("part").cast("string")).unionByName(more, allowMissingColumns=True)


def numbered_on(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """A given number n, or the number before plus one; 0 before the first. In closed form, per run after a given number."""
    by = W.partitionBy(*group).orderBy(order)
    runs = rows.withColumn("_run", F.sum(F.col("n").isNotNull().cast("int")).over(by))
    inside = W.partitionBy(*group, "_run")
    k = F.row_number().over(inside.orderBy(order))
    number = F.coalesce(F.max("n").over(inside), F.lit(0)) + k - F.when(F.col("_run") > 0, 1).otherwise(0)
    return runs.withColumn("number", number.cast("long")).drop("_run")


def best_candidates(files: DataFrame, group: str, order: list[Column], label: Column) -> DataFrame:
    """The best file of each episode, and the others in order."""
    k = F.row_number().over(W.partitionBy(group).orderBy(*order))
    ranked = files.select(group, label.alias("_label"), k.alias("_k")).groupBy(group)
    rows = F.array_sort(F.collect_list(F.struct("_k", "_label")))
    return ranked.agg(F.transform(rows, lambda r: r["_label"]).alias("r")).select(group, F.get("r", F.lit(0)).alias("best"), F.array_join(F.expr("slice(r, 2, size(r))"), "; ").alias("others"))


def animated_only(rows: DataFrame, keys: list[str], has_file: Column, animated: Column) -> DataFrame:
    """Stories whose every row with a file is an animation."""
    return rows.where(has_file).groupBy(*keys).agg(F.bool_and(animated).alias("_all")).where("_all").select(*keys)


def matched(files: DataFrame, episodes: DataFrame) -> DataFrame:
    """Files (season, serial, part, ordinal) to episodes by serial and part, else by ordinal; reason where neither is there."""
    by_part = episodes.select("season", "serial", "part", F.col("episode").alias("_a"))
    by_number = episodes.select("season", "ordinal", F.col("episode").alias("_b"))
    j = files.join(by_part, ["season", "serial", "part"], "left").join(by_number, ["season", "ordinal"], "left")
    reason = F.when(F.coalesce("_a", "_b").isNull(), F.when(F.col("serial").isNull(), "no serial").otherwise("no such part"))
    return j.withColumns({"episode": F.coalesce("_a", "_b"), "reason": reason}).drop("_a", "_b")


def folder_words(folder: Column, prefix: str = "") -> Column:
    """The words of a serial's folder: without a leading number (`01 - `, `S1 02 `) and without words of digits, if any others are left."""
    words = name_words(F.regexp_replace(folder, r"^([0-9]+ - |S[0-9]+ [0-9]+ )", ""), prefix)
    others = F.filter(words, lambda w: ~w.rlike("^[0-9]+$"))
    return F.when(F.size(others) > 0, others).otherwise(words)


def _indexed(side: DataFrame, name: str, counts: DataFrame, least: float) -> DataFrame:
    """(season, name, words, tokens) to a row for each of its first tokens, rarest first. Of two lists that are alike enough, these have one in common."""
    # counts have a row for each token and season: as files they are small, as a broadcast they grow with the table
    tokens = side.select("season", name, "words", F.explode("tokens").alias("token")).join(counts.hint("merge"), ["season", "token"])
    rows = tokens.groupBy("season", name, "words").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    n = F.size("t")
    first = F.slice("t", F.lit(1), (n - F.ceil(n * (least / (2 - least)) - 1e-9) + 1).cast("int"))
    return rows.select("season", name, "words", F.explode(first).alias("f")).select("season", name, "words", F.col("f.token").alias("token"))


def fuzzy_candidates(folders: DataFrame, serials: DataFrame, least: float) -> DataFrame:
    """Pairs (season, folder, words, serial, _w) of distinct rows whose ratio may reach `least`: an index of rare words brings them
    together, and they have enough words in common, repeated ones counted. What is not here can't reach it."""
    if not 0 < least <= 1:
        raise ValueError("least is a ratio above 0")
    again = lambda words: F.transform(words, lambda w, i: F.concat(w, F.lit("#"), F.size(F.filter(F.slice(words, F.lit(1), i), lambda x: x == w)).cast("string")))
    tokens = F.when(F.size("words") > 0, again(F.col("words"))).otherwise(F.array(F.lit("")))
    sides = [written(x.where("words IS NOT NULL").select("season", name, "words").distinct().withColumn("tokens", tokens), "names") for x, name in ((folders, "folder"), (serials, "serial"))]
    each = [x.select("season", F.explode("tokens").alias("token")) for x in sides]
    counts = written(each[0].unionByName(each[1]).groupBy("season", "token").agg(F.count("*").alias("n")), "word-counts")
    a, b = (_indexed(x, name, counts, least) for x, name in zip(sides, ("folder", "serial"), strict=True))
    met = a.join(b.withColumnRenamed("words", "_w").hint("merge"), ["season", "token"]).select("season", "folder", "words", "serial", "_w")
    la, lb = F.size("words"), F.size("_w")
    enough = lambda n: 2 * n >= least * (la + lb) - 1e-9
    met = met.where(enough(F.least(la, lb))).distinct()
    return met.where(enough(F.size(F.array_intersect(again(F.col("words")), again(F.col("_w"))))))


def fuzzy_matched(folders: DataFrame, serials: DataFrame, least: float = 0.6) -> DataFrame:
    """For each distinct (season, folder) the serial of the season with the most alike words, the first by name on ties.

    folders: season, folder, words; serials: season, serial, words (arrays of words; rows without are left out).
    Only pairs that can reach `least` are compared."""
    scored = fuzzy_candidates(folders, serials, least).withColumn("ratio", seq_ratio(F.col("_w"), F.col("words"))).where(F.col("ratio") >= least)
    best = scored.groupBy("season", "folder").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "serial")).alias("b"))
    return best.select("season", "folder", "b.serial", (-F.col("b.r")).alias("ratio"))


def first_seen(listings: list[DataFrame], key: str, order: str) -> DataFrame:
    """U2 + A11: listings one after the other, the first row of each key kept."""
    all_rows = None
    for i, x in enumerate(listings):
        x = x.withColumn("_source", F.lit(i))
        all_rows = x if all_rows is None else all_rows.unionByName(x)
    k = F.row_number().over(W.partitionBy(key).orderBy("_source", order))
    return all_rows.withColumn("_k", k).where("_k = 1").drop("_k", "_source")


def with_missing(episodes: DataFrame, missing: dict[str, list[int]]) -> DataFrame:
    """Whether (serial, part) is in a lookup of missing parts. The lookup is part of the job's text, so it is broadcast."""
    rows = [(serial, part) for serial, parts in missing.items() for part in parts]
    lookup = episodes.sparkSession.createDataFrame(rows, "serial string, part int").distinct().withColumn("_m", F.lit(True))
    return episodes.join(F.broadcast(lookup), ["serial", "part"], "left").withColumn("missing", F.col("_m").isNotNull()).drop("_m")


def placed_files(files: DataFrame, single: DataFrame) -> DataFrame:
    """Season, serial folder and part of a file's path, or the reason why it has none.

    `S01E02` in the name counts first (not season 0), then `Part <word>`, `Episode <n>` and ` - <n> - `, a
    number that is 0 or can't be read passing on to the next; a serial of a single part (single: season, serial)
    is part 1; in a folder that ends in `lo-hi` parts below lo count from lo.
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    season = F.regexp_extract(F.element_at(parts, 1), r"^Season ([0-9]+)$", 1).try_cast("int")
    folder = F.when(F.size(parts) >= 3, F.element_at(parts, 2))
    coded = F.regexp_extract(name, r"(?i)S([0-9]+)E([0-9]+)", 1).try_cast("int")
    number = F.regexp_extract(name, r"(?i)S([0-9]+)E([0-9]+)", 2).try_cast("int")
    found = [_part(F.regexp_extract(name, p, 1)) for p in (r"(?i)\bPart ([A-Za-z0-9]+)", r"(?i)\bEpisode ([0-9]+)", r" - ([0-9]+) - ")]
    part = F.coalesce(*(F.when(p != 0, p) for p in found))
    rows = files.withColumns({"season": F.when(coded > 0, coded).otherwise(season), "serial": folder, "_coded": F.when(coded > 0, number), "_part": part})
    one = single.select("season", "serial", F.lit(True).alias("_one"))
    rows = rows.join(one, ["season", "serial"], "left")
    low = F.regexp_extract("serial", r"([0-9]+)-[0-9]+$", 1).try_cast("int")
    counted = F.coalesce("_part", F.when(F.col("_one"), F.lit(1)))
    counted = F.when((low > 0) & (counted < low), counted + low - 1).otherwise(counted)
    final = F.coalesce("_coded", counted)
    reason = F.when(F.col("serial").isNull(), "not in a serial's folder").when(F.col("season").isNull(), "no season").when(final.isNull(), "no part number")
    return rows.withColumns({"part": final, "reason": reason}).drop("_coded", "_part", "_one")


def listed_matches(labels: DataFrame, episodes: DataFrame) -> DataFrame:
    """Labels (season, story, label) to episodes by part number where the label is `part n` or `episode n`, else by title."""
    bare = F.regexp_replace(F.lower("label"), r"\s*\(reconstruction\)$", "")
    number = F.regexp_extract(bare, r"^(?:part|episode) ([0-9]+)$", 1).try_cast("int")
    rows = labels.withColumns({"_n": number, "_t": F.when(number.isNull(), bare)})
    by_part = episodes.select("season", "story", F.col("part").alias("_n"), F.col("episode").alias("_a"))
    by_title = episodes.select("season", "story", F.lower("title").alias("_t"), F.col("episode").alias("_b")).where("_t IS NOT NULL")
    j = rows.join(by_part, ["season", "story", "_n"], "left").join(by_title, ["season", "story", "_t"], "left")
    return j.withColumn("episode", F.coalesce("_a", "_b")).drop("_n", "_t", "_a", "_b")


def eligible(episodes: DataFrame, allowed: list[str]) -> DataFrame:
    """P10: (serial, kind, file, has_subs, animated_story) with the first reason to skip an episode, null for none."""
    drawn = (F.col("kind") == "animation") & ~F.col("serial").isin(allowed)
    reason = F.when(F.col("animated_story"), "story is animated").when(drawn, "animation").when(F.coalesce("file", F.lit("")) == "", "no file").when(F.col("has_subs") != "yes", "no subtitles")
    return episodes.withColumn("reason", reason)


def catalogue_rows(episodes: DataFrame, files: DataFrame, notes: DataFrame) -> DataFrame:
    """An episode's row: its best file's subtitle state (yes, no or empty), descriptions joined, the episode's note or the serial's.

    files: episode, rank, label, tracks (array of string); notes: serial, part (null: of the serial), note."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "label", "tracks")))
    gathered = files.groupBy("episode").agg(rows.alias("_f"))
    own = notes.where("part IS NOT NULL").select("serial", "part", F.col("note").alias("_own"))
    general = notes.where("part IS NULL").select("serial", F.col("note").alias("_general"))
    j = episodes.join(gathered, "episode", "left").join(own, ["serial", "part"], "left").join(general, "serial", "left")
    best = F.get("_f", F.lit(0))
    has = F.when(F.col("_f").isNull(), "").when(F.size(best["tracks"]) > 0, "yes").otherwise("no")
    others = F.array_join(F.transform(F.filter("_f", lambda f: f["rank"] > best["rank"]), lambda f: f["label"]), "; ")
    return j.select(
        "episode", "serial", "part", F.coalesce(best["label"], F.lit("")).alias("version"), has.alias("has_subs"), F.coalesce(F.array_join(best["tracks"], "; "), F.lit("")).alias("subtitle_tracks"),
        F.coalesce(others, F.lit("")).alias("other_versions"), F.coalesce("_own", "_general", F.lit("")).alias("notes"),
    )
