"""The table of shots: one screenshot per cue, kept up to date, posted from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuelake.staging import written


def seeded(seed: str, *keys: str) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def episode_fields(shots: DataFrame, path: str = "path") -> DataFrame:
    """Programme, series, episode number and title from the last three folders of a path."""
    parts = F.split(F.col(path), "/")
    folder = F.element_at(parts, -2)
    unpadded = lambda c: F.regexp_replace(c, r"\b0+([0-9])", "$1")
    head = F.when(F.contains(folder, F.lit(" - ")), F.substring_index(folder, " - ", 1)).otherwise(F.lit(""))
    number = F.regexp_extract(head, r"^([0-9]+)(?:-[0-9]+)?$", 1).try_cast("int")
    title = F.when(number.isNotNull(), F.substring(folder, F.length(head) + 4, F.length(folder))).otherwise(folder)
    return shots.withColumns({"programme": F.element_at(parts, -4), "series": unpadded(F.element_at(parts, -3)), "episode": number, "title": title})


def changed_dirs(listing: DataFrame, manifest: DataFrame, full: bool = False) -> DataFrame:
    """Folders whose (mtime, size) isn't in the manifest, or all."""
    old = manifest.select("dir", F.struct("mtime", "size").alias("_old"))
    joined = listing.join(old, "dir", "left")
    return joined.where(F.lit(full) | ~F.struct("mtime", "size").eqNullSafe(F.col("_old"))).drop("_old")


def upserted(old: DataFrame, new: DataFrame, key: str, described: list[str], kept: list[str]) -> DataFrame:
    """M1: new rows inserted, described columns of known rows taken from the new ones, kept columns left alone.
    `change` says inserted, updated, or same; rows that are only old are same."""
    o = old.select(key, F.struct(*described).alias("_o"), *kept, F.lit(True).alias("_old"))
    n = new.select(key, F.struct(*described).alias("_n"), F.lit(True).alias("_new"))
    j = o.join(n, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNotNull() & ~F.col("_o").eqNullSafe(F.col("_n")), "updated").otherwise("same")
    columns = [F.when(F.col("_new").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in described]
    return j.select(key, *columns, *kept, change.alias("change"))


def retired(stored: DataFrame, listed: DataFrame, dirs: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows of reloaded folders that are listed no more; other folders are not touched."""
    return stored.join(dirs.select("dir").distinct(), "dir", "left_semi").join(listed.select(key), key, "left_anti")


def carried_over(gone: DataFrame, present: DataFrame, within: float = 0.05) -> DataFrame:
    """Posting history of retired shots (dir, path, start, post_count, last_posted) to present ones (dir, path, start)
    less than `within` away: the larger count, and the latest posting, then the first path."""
    step = F.lit(within)
    g = gone.where("post_count > 0").select("dir", F.col("path").alias("old_path"), F.col("start").alias("old_start"), "post_count", "last_posted")
    g = g.withColumn("_b", F.floor(F.col("old_start") / step))
    p = present.select("dir", "path", "start").withColumn("_b", F.explode(F.array(*(F.floor(F.col("start") / step) + k for k in (-1, 0, 1)))))
    hit = p.join(g, ["dir", "_b"]).where(F.abs(F.col("start") - F.col("old_start")) < step)
    newest = F.max_by("old_path", F.struct(F.col("last_posted"), F.col("old_path")))
    return hit.groupBy("dir", "path").agg(F.max("post_count").alias("post_count"), F.max("last_posted").alias("last_posted"), newest.alias("from_path"))


def used_images(shots: DataFrame) -> DataFrame:
    """Paths of shots and of their overlay images."""
    overlays = shots.select(F.get_json_object("overlay", "$.image").alias("image")).where("image IS NOT NULL")
    return shots.select(F.col("path").alias("image")).union(overlays).distinct()


def unused_images(listing: DataFrame, shots: DataFrame) -> DataFrame:
    """Per known folder, images that no shot uses: how many and their bytes."""
    known = shots.select("dir").distinct()
    spare = listing.join(known, "dir", "left_semi").join(used_images(shots), "image", "left_anti")
    return spare.groupBy("dir").agg(F.count("*").alias("images"), F.sum("bytes").alias("bytes"))


def tagged(shots: DataFrame, titles: DataFrame) -> DataFrame:
    """M3: the first tag (by rank) that lists a shot's title, else null."""
    first = titles.groupBy("title").agg(F.min_by("tag", "rank").alias("tag"))
    return shots.join(first, "title", "left")


def next_to_post(shots: DataFrame, n: int, seed: str, key: str = "path") -> DataFrame:
    """Of those not skipped the least posted, in a seeded order among equals."""
    return shots.where("NOT skip").orderBy("post_count", seeded(seed, key), key).limit(n)


def posting_stats(shots: DataFrame) -> DataFrame:
    """A2."""
    live = F.when(~F.col("skip"), F.col("post_count"))
    return shots.agg(
        F.count("*").alias("shots"), F.count_if(F.col("post_count") > 0).alias("posted"), F.min(live).alias("least_posted"), F.count_if("skip").alias("skipped"), F.max("last_posted").alias("latest")
    )


def programme_counts(shots: DataFrame) -> DataFrame:
    """A1: distinct episodes and shots of each programme."""
    return shots.groupBy("programme").agg(F.countDistinct("dir").alias("episodes"), F.count("*").alias("shots"))


def count_levels(shots: DataFrame) -> DataFrame:
    """Counts by programme, series and folder, and their totals, in one pass."""
    return shots.rollup("programme", "series", "dir").agg(F.count("*").alias("shots"), F.grouping_id().cast("int").alias("level"))


def stratified(shots: DataFrame, group: Column, n: int, seed: str, key: str = "path") -> DataFrame:
    """T5: n of each class in a seeded order."""
    k = F.row_number().over(W.partitionBy("class").orderBy(seeded(seed, key), key))
    return shots.withColumn("class", group).withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """A page of a defined order, with the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def cards(shots: DataFrame, faces: DataFrame, tags: DataFrame, key: str = "path") -> DataFrame:
    """Shots with their faces and tags; each side is gathered by shot first, so nothing multiplies."""
    f = faces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("face", "person"))).alias("faces"))
    t = tags.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "prob")))).alias("tags"))
    return shots.join(f, key, "left").join(t, key, "left")


def numbered_rows(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in an order, which is sorted over all tasks: a place is that in a task and the rows that earlier tasks have."""
    sorted_rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each task
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return sorted_rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, at.cast("long")).drop("_at", "_part", "_before")


def carried_counts(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows (path, post_count, last_posted, ...) with the larger of their own and the carried history."""
    more = carried.select("path", F.col("post_count").alias("_c"), F.col("last_posted").alias("_l"))
    j = rows.join(more, "path", "left")
    return j.withColumns({"post_count": F.greatest(F.coalesce("post_count", F.lit(0)), F.coalesce("_c", F.lit(0))), "last_posted": F.greatest("last_posted", "_l")}).drop("_c", "_l")


def loaded(stored: DataFrame, manifest: DataFrame, listing: DataFrame, rows: DataFrame, described: list[str], within: float = 0.05, full: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M2: the shots, the manifest, and counters after the folders that are new or changed have been loaded.

    stored: path, dir, start, `described`, post_count, last_posted; manifest and listing: dir, mtime, size;
    rows: path, dir, start and `described` of all that is listed. Rows of changed folders are inserted or
    described anew (M1), their shots that are listed no more go (U3), and what these had been posted passes to
    shots at their place (J3). Counters (new_episodes, added, removed, total) are one row. Loading the same
    listing again changes nothing.
    """
    todo = changed_dirs(listing, manifest, full)
    fresh = rows.join(todo.select("dir"), "dir", "left_semi")
    columns = ["dir", "start", *described]
    kept = ["post_count", "last_posted"]
    gone = retired(stored, fresh, todo)
    merged = upserted(stored, fresh, "path", columns, kept).drop("change").join(gone.select("path"), "path", "left_anti")
    shots = carried_counts(merged, carried_over(gone, fresh, within)).select("path", *columns, *kept)
    new_manifest = manifest.join(todo.select("dir"), "dir", "left_anti").unionByName(todo.select(*manifest.columns))
    before, removed, total = (x.agg(F.count("*").alias(n)) for x, n in ((stored, "before"), (gone, "removed"), (shots, "total")))
    new_episodes = todo.select("dir").join(stored.select("dir").distinct(), "dir", "left_anti").agg(F.count("*").alias("new_episodes"))
    counts = before.crossJoin(removed).crossJoin(total).crossJoin(new_episodes)  # one row each
    return shots, new_manifest, counts.select("new_episodes", (F.col("total") - F.col("before") + F.col("removed")).alias("added"), "removed", "total")


def browsed(
    shots: DataFrame, faces: DataFrame, members: DataFrame, done: list[Column] | None = None, programme: str | None = None, n_faces: str | None = None, tag: str | None = None, person: str | None = None, cluster: int | None = None
) -> DataFrame:
    """Shots that meet all filters given: any of `done` holds; path below a programme; `none`, `any` or `some` (two
    or more) faces; a tag; a person; a face cluster. faces: path, person, cluster; members: tag, path."""
    out = shots
    if done:
        out = out.where(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in done]))
    if programme is not None:
        out = out.where(F.startswith("path", F.lit(programme.rstrip("/") + "/")))
    if n_faces == "none":
        out = out.join(faces.select("path").distinct(), "path", "left_anti")
    elif n_faces == "any":
        out = out.join(faces.select("path").distinct(), "path", "left_semi")
    elif n_faces == "some":
        out = out.join(faces.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "path", "left_semi")
    wanted = [(members, "tag", tag), (faces, "person", person), (faces, "cluster", cluster)]
    for rows, column, value in wanted:
        if value is not None:
            out = out.join(rows.where(F.col(column) == value).select("path").distinct(), "path", "left_semi")
    return out


#: The column and direction of each way of sorting.
SORTS = {"sharp": ("sharpness", True), "blurry": ("sharpness", False), "bright": ("brightness", True), "dark": ("brightness", False), "face": ("face", True)}


def sorted_shots(shots: DataFrame, way: str, seed: str = "0", scores: DataFrame | None = None) -> DataFrame:
    """Shots by a way of SORTS (no value counts as 0), `shuffle` (seeded) or `search` (by scores (path, score), shots without one left out); ties by path."""
    if way == "search":
        return shots.join(scores.select("path", "score"), "path").orderBy(F.desc("score"), "path")
    if way == "shuffle":
        return shots.orderBy(seeded(seed, "path"), "path")
    column, down = SORTS[way]
    value = F.coalesce(F.col(column), F.lit(0))
    return shots.orderBy(value.desc() if down else value.asc(), "path")


def facet_counts(shots: DataFrame, people: DataFrame, members: DataFrame, faces: DataFrame) -> DataFrame:
    """A4: rows (facet, value, n) of all that a browser can choose: programmes and people's and tags' shots, clusters' faces.

    shots: programme; people: path, person; members: tag, path; faces: cluster. Each is counted in its own pass; nulls don't count."""
    of = lambda rows, name, column: rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
    sources = [(shots, "programme", "programme"), (people.select("path", "person").distinct(), "person", "person"), (members, "tag", "tag"), (faces, "cluster", "cluster")]
    return reduce(DataFrame.unionByName, [of(*x) for x in sources])


def work_order(rows: DataFrame, way: str, limit: int | None = None, order: str = "ord", seed: str = "0") -> DataFrame:
    """Rows (`order`, started, ...) as `given`, `reversed` or `shuffled` - then those already started first - and the first `limit`."""
    by = {"given": [F.col(order)], "reversed": [F.col(order).desc()], "shuffled": [F.coalesce("started", F.lit(False)).desc(), seeded(seed, order), F.col(order)]}[way]
    out = rows.orderBy(*by)
    return out if limit is None else out.limit(limit)


def not_yet(shots: DataFrame, finished: DataFrame, key: str = "path") -> DataFrame:
    """Shots without a finished step."""
    return shots.join(finished.select(key), key, "left_anti")


def titles_absent(titles: DataFrame, shots: DataFrame) -> DataFrame:
    """Titles of a list that no shot has."""
    return titles.select("title").distinct().join(shots.select("title"), "title", "left_anti")


def unused_report(listing: DataFrame, shots: DataFrame, current: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row (images, bytes, episodes) of `unused_images`. Raises if a folder of `current` isn't in the manifest as it is, as its shots may be out of date."""
    if not changed_dirs(current, manifest).isEmpty():
        raise ValueError("folders have changed since they were loaded")
    found = unused_images(listing, shots)
    return found.agg(F.coalesce(F.sum("images"), F.lit(0)).alias("images"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("episodes"))


def detailed_stats(shots: DataFrame) -> DataFrame:
    """A2: rows (tag, null for all) with shots, posted, the fewest posts of those not skipped, how many are drawn (segments), pasted
    (overlay) or burned in (neither), skipped, and the latest posting's path."""
    live = F.when(~F.col("skip"), F.col("post_count"))
    drawn = F.col("segments").isNotNull()
    pasted = ~drawn & F.col("overlay").isNotNull()
    return shots.rollup("tag").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("shots"), F.count_if(F.col("post_count") > 0).alias("posted"), F.min(live).alias("least_posted"), F.count_if(drawn).alias("drawn"),
        F.count_if(pasted).alias("pasted"), F.count_if(~drawn & ~pasted).alias("burned_in"), F.count_if("skip").alias("skipped"), F.max_by("path", F.struct("last_posted", "path")).alias("latest"),
    )
