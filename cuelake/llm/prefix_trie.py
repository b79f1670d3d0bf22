"""A trie of conversations: which beginnings they share, built level by level and rolled up from the leaves.

A node is told by its smallest member and its depth: the nodes that a conversation is the smallest
member of are one stretch of its path, down to its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.staging import written

#: Turns that one row holds; so a conversation of any length is in rows of bounded size.
BLOCK = 64
#: Ids that are joined in one row before their digest is made.
CHUNK = 1024
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, pos from 1, key, bytes) of all turns in order, and (conv_id, n).

    Rows are sorted over all tasks by range, so a conversation with very many turns is in several; a
    row's place is that in its task and the turns that the conversation has in earlier ones.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    plain = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    by = ["conv_id", "turn", "key"]
    ranked = written(written(plain, "turns").repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("_at", 33)
    parts = ranked.groupBy("conv_id", part.alias("_part")).agg(F.min("_at").alias("_lo"), F.count("*").alias("_n"))
    parts = written(parts, "parts")
    counts = parts.groupBy("conv_id").agg(F.sum("_n").alias("n"), F.count("*").alias("_parts"))
    # of conversations in several tasks, whose number is that of the tasks at most
    split = parts.join(counts.where("_parts > 1").select("conv_id"), "conv_id", "left_semi")
    earlier = split.alias("a").join(split.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b._part") < F.col("a._part")))
    before = earlier.groupBy("a.conv_id", "a._part").agg(F.sum("b._n").alias("_before"))
    starts = parts.join(before, ["conv_id", "_part"], "left").select("conv_id", "_part", "_lo", F.coalesce("_before", F.lit(0)).alias("_before"))
    placed = ranked.withColumn("_part", part).join(starts, ["conv_id", "_part"])
    return placed.select("conv_id", (F.col("_at") - F.col("_lo") + F.col("_before") + 1).alias("pos"), "key", "bytes"), counts.select("conv_id", "n")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their beginning from the first of their family.

    Conversation c has the first h turns of c - c % family (h is the CRC-32 of c in decimal, modulo
    `most`; all turns if they are fewer, none if there is no such conversation), then its own turns
    after its first h. Returns rows (conv_id, block, m, turns), turns being an array of at most BLOCK
    (key, bytes), m its length, and rows (conv_id, len), one for each conversation.
    """
    rows, counts = numbered(turns)
    rows, counts = written(rows, "placed"), written(counts, "counts")
    head = F.col("conv_id") - F.col("conv_id") % family
    h = F.when(head == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % most)
    heads = counts.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head"))
    convs = counts.select("conv_id", "n", head.alias("head"), h.alias("h")).join(heads, "head", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("n_head", F.lit(0))))
    convs = written(convs.select("conv_id", "head", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    own = rows.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "key", "bytes")
    first = rows.where((F.col("pos") < most) & (head == F.col("conv_id"))).select(F.col("conv_id").alias("head"), "pos", "key", "bytes")
    taken = first.join(convs.where("k > 0"), "head").where("pos <= k").select("conv_id", F.col("pos").alias("depth"), "key", "bytes")
    block = F.expr(f"(depth - 1) div {BLOCK}").alias("block")
    packed = own.unionByName(taken).groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("depth", "key", "bytes"))).alias("t"))
    packed = packed.select("conv_id", "block", F.size("t").alias("m"), F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes"))).alias("turns"))
    return written(packed, "blocks"), convs.select("conv_id", "len")


def _alike(lo: Column, hi: Column) -> Column:
    """How many turns two arrays have in common at their beginning. Of the smallest and the largest array of a group, all arrays have these."""
    differ = F.array_position(F.zip_with(lo, hi, lambda a, b: a["key"].eqNullSafe(b["key"])), F.lit(False))
    return F.coalesce(F.nullif(differ, F.lit(0)) - 1, F.size(lo)).cast("int")


def _levels(blocks: DataFrame, convs: DataFrame, root: int) -> tuple[list[tuple[int, DataFrame]], list[DataFrame]]:
    """Levels from the root down, as (block, nodes), and the conversations that end in shared nodes.

    A level groups live conversations by (parent node, next turn); the group's smallest id names the
    child. With the child go at once the children below it that have the same members (`run` in all,
    within the block). A conversation that is alone in its node is no longer live: its path has no
    other members.
    """
    levels: list[tuple[int, DataFrame]] = []
    ended: list[DataFrame] = []
    live = convs.where("len > 0").select("conv_id", "len", F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"))
    block = 0
    while True:
        live = live.join(blocks.where(F.col("block") == block).select("conv_id", "turns"), "conv_id")
        waiting = []
        while True:
            live = live.withColumn("next", F.col("turns")[0]["key"])
            kids = live.groupBy("node", "depth", "next").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.min("len").alias("len"), F.min("turns").alias("lo"), F.max("turns").alias("hi"))
            kids = kids.withColumn("run", F.when(F.col("n") > 1, _alike(F.col("lo"), F.col("hi"))).otherwise(0))
            kids = kids.withColumn("sizes", F.transform(F.slice("lo", 1, F.col("run")), lambda x: x["bytes"]))
            level = written(kids.select("node", "depth", "next", "rep", "n", "len", "run", "sizes"), "level")
            levels.append((block, level))
            below = live.join(level.where("n > 1").select("node", "next", "rep", "run"), ["node", "next"])
            turns = F.slice("turns", F.col("run") + 1, F.greatest(F.size("turns"), F.lit(1)))
            moved = written(below.select("conv_id", "len", F.col("rep").alias("node"), (F.col("depth") + F.col("run")).alias("depth"), turns.alias("turns")), "live")
            ended.append(moved.where("len = depth").select("conv_id", "node", "depth"))
            on, wait = moved.agg(F.count_if(F.expr("size(turns) > 0")), F.count_if(F.expr("size(turns) = 0 AND len > depth"))).first()
            if wait:
                waiting.append(moved.where("size(turns) = 0 AND len > depth").drop("turns"))
            if not on:
                break
            live = moved.where("size(turns) > 0")
        if not waiting:
            return levels, ended
        live, block = reduce(DataFrame.unionByName, waiting), block + 1


def _rolled_up(levels: list[tuple[int, DataFrame]]) -> list[DataFrame]:
    """Levels from the leaves up, with children, leaves and savings of what stands at the end of each run. The last is the root's."""
    done: list[tuple[int, int, DataFrame]] = []  # block, number within the block, contributions to parents
    number = {i: sum(b == levels[i][0] for b, _ in levels[:i]) for i in range(len(levels))}
    out = []
    for i in range(len(levels) - 1, -1, -1):
        block, level = levels[i]
        below = [x for b, j, x in done if (b, j) in ((block, number[i] + 1), (block + 1, 0))]
        if below:
            given = reduce(DataFrame.unionByName, below).groupBy(F.col("node").alias("rep"), F.col("depth").alias("end")).agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
            level = level.withColumn("end", F.col("depth") + F.col("run")).join(given, ["rep", "end"], "left")
        else:
            level = level.withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
        level = level.withColumns({"children": F.coalesce("children", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0))})
        level = written(level.select("node", "depth", "rep", "n", "len", "run", "sizes", "children", "leaves", "saved"), "rolled")
        up = F.col("saved") + (F.col("n") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        gifts = level.select("node", "depth", "leaves", up.alias("saved")).groupBy("node", "depth").agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        done.append((block, number[i], gifts))
        out.append(level)
    return [*out, done[-1][2]]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, from rows sorted by node and chunk. Text passes through, none is kept."""
    kind = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    at, digest = None, None
    for batch in batches:
        rows = []
        for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
            if (node, depth) == at:
                digest.update(b"," + ids.encode())
            else:
                if at is not None:
                    rows.append((*at, digest.hexdigest()))
                at, digest = (node, depth), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)
    if at is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (*at, digest.hexdigest()), strict=True))], kind)


def _ends(ended: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256). Ids are put together in chunks of numbers, so that a node with very many copies is many rows of one task."""
    chunk = F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("chunk")
    chunks = ended.groupBy("node", "depth", chunk).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    placed = chunks.repartition("node", "depth").sortWithinPartitions("node", "depth", "chunk")
    return placed.select("node", "depth", "ids").mapInArrow(_digests, "node long, depth long, ends_sha256 string")


def conversation_trie(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations of `turns` (conv_id, turn, role, text).

    conv_id: the smallest member; depth; parent_conv_id; n_convs: members; n_children; n_leaves and
    saved_tokens of the subtree; ends_sha256: digest of the ids of the members that end here.

    Turns are ordered by `turn`, null first, then by a digest of role and text; rows that repeat are
    turns of their own. Null role and text are empty. Rows without a conv_id belong to no conversation.
    An empty table has no nodes, not even a root. Other columns are not looked at.
    """
    spark = turns.sparkSession
    blocks, convs = rebuilt(turns.select("conv_id", "turn", "role", "text"), family, most)
    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).first()
    if not total["n"]:
        return spark.createDataFrame([], NODES)
    levels, ended = [], []
    if not blocks.isEmpty():
        levels, ended = _levels(blocks, convs, total["rep"])
    *rolled, top = _rolled_up(levels) if levels else [spark.createDataFrame([], "node long, depth long, children long, leaves long, saved long")]
    ended.append(convs.where("len = 0").select("conv_id", F.lit(total["rep"]).cast("long").alias("node"), F.lit(0).cast("long").alias("depth")))
    ends = _ends(reduce(DataFrame.unionByName, ended))

    root = spark.range(1).select(F.lit(total["rep"]).cast("long").alias("node"), F.lit(0).cast("long").alias("depth")).join(top, ["node", "depth"], "left")
    shared = root.select(
        "node", "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).cast("long").alias("n_convs"),
        *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("children", 0), ("leaves", 1), ("saved", 0))),
    )
    for level in rolled:
        i, last = F.col("i"), F.col("i") == F.col("run")
        saved = F.col("saved") + (F.col("n") - 1) * F.aggregate(F.slice("sizes", i, F.col("run")), F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = level.where("n > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("run")))).select(
            F.col("rep").alias("node"), (F.col("depth") + i).alias("depth"), F.when(i == 1, F.col("node")).otherwise(F.col("rep")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).alias("children"), "leaves", saved.alias("saved"),
        )
        shared = shared.unionByName(nodes)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = shared.join(ends, ["node", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
    out = shared.select("node", "depth", "parent_conv_id", "n_convs", "children", "leaves", "saved", "ends_sha256").toDF(*names)
    if not levels:
        return out
    lone = reduce(DataFrame.unionByName, (x.where("n = 1").select("rep", "node", F.col("depth").alias("above"), "len") for _, x in levels))
    paths = lone.join(blocks.select(F.col("conv_id").alias("rep"), "block", "m"), "rep").where(F.col("block") * BLOCK + F.col("m") > F.col("above"))
    depths = F.sequence(F.greatest(F.col("above"), F.col("block") * BLOCK) + 1, F.col("block") * BLOCK + F.col("m"))
    paths = paths.withColumn("at", F.explode(depths))
    end, own = F.col("at") == F.col("len"), F.sha2(F.col("rep").cast("string"), 256)
    lone_rows = paths.select(
        "rep", "at", F.when(F.col("at") == F.col("above") + 1, F.col("node")).otherwise(F.col("rep")), F.lit(1).cast("long"),
        F.when(end, 0).otherwise(1).cast("long"), F.lit(1).cast("long"), F.lit(0).cast("long"), F.when(end, own).otherwise(F.lit(EMPTY_SHA256)),
    ).toDF(*names)
    return out.unionByName(lone_rows)
