"""Groups of vectors by density at all radii, within keys: neighbours by an index of pivots, spanning edges of pairs of
blocks, and a condensed tree of groups of which the most lasting are taken.

Vectors are dealt to blocks around pivots. By the triangle inequality a pair of blocks need not be compared where all
its distances are too large to matter. A block, a pair of blocks and a slice of the sorted edges are what a task
holds; only the list of a key's blocks (not its vectors) is looked at in one piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cuelake.staging import written

#: Edges that one task joins at once.
SLICE = 1 << 18
#: Distances below count as this in 1 / distance.
NEAREST = 1e-9
_SUBS = 1 << 24


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices. Small ones are taken from differences, so that copies are 0 apart."""
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    i, j = np.nonzero(d < 1e-6)
    d[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(d, 0))


def spanning(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree of a full graph: the order in which its nodes are reached, from which, and how far each is."""
    n = len(w)
    order, source, length = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    best, via = w[0].copy(), np.zeros(n, np.int64)
    best[0] = np.inf
    done = np.zeros(n, bool)
    done[0] = True
    for t in range(1, n):
        v = int(np.argmin(best))
        order[t], source[t], length[t] = v, via[v], best[v]
        done[v] = True
        best[v] = np.inf
        closer = ~done & (w[v] < best)
        best[closer], via[closer] = w[v][closer], v
    return order, source, length


def _plain(v: pa.Scalar) -> object:
    """A list of lists of numbers as a matrix, a list of numbers as an array, others as Python has them."""
    if not v.is_valid or not pa.types.is_list(v.type):
        return v.as_py()
    inner = v.type.value_type
    if pa.types.is_list(inner) and not pa.types.is_struct(inner.value_type):
        return v.values.flatten().to_numpy(zero_copy_only=False).reshape(len(v.values), -1)
    return v.as_py() if pa.types.is_struct(inner) or pa.types.is_list(inner) or pa.types.is_string(inner) else v.values.to_numpy(zero_copy_only=False)


def _mapped(df: DataFrame, run: Callable[[SimpleNamespace], Iterable[dict]], schema: str) -> DataFrame:
    """A function of one row to some; a task holds one row at a time beside the batch it came in."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    most = 1 << 12

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[dict] = []
                for x in run(SimpleNamespace(**{c: _plain(batch.column(c)[i]) for c in batch.schema.names})):
                    rows.append(x)
                    if len(rows) == most:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return df.mapInArrow(over, schema)


def blocks(rows: DataFrame, size: int = 512) -> DataFrame:
    """Rows (key, id, vec, n) in blocks (key, blk, id, vec, n: arrays), each of vectors that have the same nearest pivot.

    Every size-th row or so, drawn by hash, is a pivot of its key. Blocks of more than 2 * size rows are split.
    """
    by = F.xxhash64("id")
    drawn = rows.where(F.pmod(by, F.lit(size)) == 0).select("key", F.struct("id", "vec").alias("p"))
    first = rows.groupBy("key").agg(F.min_by(F.struct("id", "vec"), by).alias("p"))
    pivots = drawn.unionByName(first).groupBy("key").agg(F.sort_array(F.collect_set("p")).alias("p")).select("key", F.col("p.vec").alias("pivots"))
    packets = rows.groupBy("key").agg(F.ceil(F.count("*") / size).alias("packets"))
    packet = rows.join(packets, "key").groupBy("key", F.pmod(F.xxhash64("id", F.lit(1)), F.col("packets")).alias("packet")).agg(F.collect_list(F.struct("id", "vec", "n")).alias("r"))
    wide = packet.select("key", F.col("r.id").alias("id"), F.col("r.vec").alias("vec"), F.col("r.n").alias("n")).join(pivots, "key")

    def dealt(r) -> list[dict]:
        pivot = apart(r.vec, r.pivots).argmin(axis=1)
        return [{"key": r.key, "id": i, "vec": v, "n": n, "pivot": p} for i, v, n, p in zip(r.id, r.vec, r.n, pivot, strict=True)]

    kinds = dict(rows.dtypes)
    placed = written(_mapped(wide, dealt, f"key {kinds['key']}, id {kinds['id']}, vec array<double>, n long, pivot long"), "dealt")
    subs = placed.groupBy("key", "pivot").agg(F.ceil(F.count("*") / (2 * size)).alias("subs"))
    blk = F.col("pivot") * _SUBS + F.pmod(F.xxhash64("id", F.lit(2)), F.col("subs"))
    held = placed.join(subs, ["key", "pivot"]).groupBy("key", blk.alias("blk")).agg(F.sort_array(F.collect_list(F.struct("id", "vec", "n"))).alias("r"))
    return written(held.select("key", "blk", F.col("r.id").alias("id"), F.col("r.vec").alias("vec"), F.col("r.n").alias("n")), "blocks")


def _least(d: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of distances: the columns of the k smallest in order, and the distance within which k vectors are, counting copies (inf: fewer)."""
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    total = np.cumsum(n[near], axis=1)
    at = np.take_along_axis(d, near, axis=1)
    enough = total >= k
    return near, np.where(enough.any(axis=1), at[np.arange(len(d)), enough.argmax(axis=1)], np.inf)


def _sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (key, a, b) of blocks with the columns of either block, named column_a and column_b."""
    side = lambda s: table.select("key", F.col("blk").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    return pairs.join(side("a"), ["key", "a"]).join(side("b"), ["key", "b"])


def _listed(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each key with arrays of what its blocks have: as many entries as blocks."""
    row = F.sort_array(F.collect_list(F.struct("blk", *columns)))
    return table.groupBy("key").agg(row.alias("r")).select("key", *(F.col(f"r.{c}").alias(c) for c in ["blk", *columns]))


def reaches(held: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """For each block of `held` (blocks()) an array `core`: how far from each vector the `few` nearest are, itself and copies
    counted; and the compared pairs of blocks (key, a, b). Exact: a vector is not compared with a block only if the whole
    block lies beyond the vectors that its own block has. A key of fewer vectors has its farthest ones.
    """
    kinds = dict(held.dtypes)

    def own(r) -> list[dict]:
        x, n = r.vec, r.n
        d = apart(x, x)
        near, reach = _least(d, n, few)
        middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        return [{
            "key": r.key, "blk": r.blk, "mid": middle, "middle": x[middle], "radius": d[middle].max(), "total": int(n.sum()), "reach": reach,
            "near": [[{"d": d[i, j], "n": n[j]} for j in row] for i, row in enumerate(near)],
        }]

    schema = f"key {kinds['key']}, blk long, mid int, middle array<double>, radius double, total long, reach array<double>, near array<array<struct<d:double,n:long>>>"
    alone = written(_mapped(held, own, schema), "own-reach")

    def close(r) -> Iterator[dict]:
        middle = apart(r.vec, r.middle)
        reach = np.array(r.reach)
        short = np.isinf(reach)
        if short.any():  # too few in the block itself: those of the blocks that surely have enough
            far = middle[short] + r.radius
            order = np.argsort(far, axis=1)
            enough = np.cumsum(r.total[order], axis=1) >= few
            reach[short] = np.where(enough.any(axis=1), np.take_along_axis(far, order, axis=1)[np.arange(len(far)), enough.argmax(axis=1)], np.inf)
        for b in r.others[(middle - r.radius <= reach[:, None] * (1 + 1e-9) + 1e-12).any(axis=0)]:
            if b != r.blk:
                yield {"key": r.key, "a": min(r.blk, b), "b": max(r.blk, b)}

    listed = _listed(alone, ["middle", "radius", "total"]).withColumnRenamed("blk", "others")
    wide = written(held.join(alone.select("key", "blk", "reach", F.col("middle").alias("mid"), F.col("radius").alias("within")), ["key", "blk"]), "reach-rows")
    pairs = written(_mapped(wide.select("key", "blk", "vec", "reach").join(listed, "key"), close, f"key {kinds['key']}, a long, b long").distinct(), "pairs")

    def other(r) -> Iterator[dict]:
        sides = (r.a, r.vec_a, r.reach_a, r.vec_b, r.n_b, r.mid_b, r.within_b), (r.b, r.vec_b, r.reach_b, r.vec_a, r.n_a, r.mid_a, r.within_a)
        for blk, x, reach, y, n, middle, radius in sides:
            rows = np.flatnonzero(apart(x, middle[None])[:, 0] - radius <= reach * (1 + 1e-9) + 1e-12)
            m = apart(x[rows], y)
            for i, d in zip(rows, m, strict=True):
                near = np.flatnonzero(d < reach[i])
                if len(near):
                    near = near[np.argsort(d[near], kind="stable")[:few]]
                    yield {"key": r.key, "blk": blk, "i": i, "near": [{"d": d[j], "n": n[j]} for j in near]}

    sides = _sides(pairs, wide, ["vec", "n", "reach", "mid", "within"])
    found = _mapped(sides, other, f"key {kinds['key']}, blk long, i int, near array<struct<d:double,n:long>>")
    merged = found.groupBy("key", "blk", "i").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, few).alias("near"))
    extra = merged.groupBy("key", "blk").agg(F.collect_list(F.struct("i", "near")).alias("e")).select("key", "blk", F.col("e.i").alias("i"), F.col("e.near").alias("more"))

    def final(r) -> list[dict]:
        core = np.array(r.reach, np.float64)
        lists = [list(x) for x in r.near]
        for i, more in zip(r.i if r.i is not None else [], r.more or [], strict=True):
            lists[i] += list(more)
        for i, x in enumerate(lists):
            total = 0
            x.sort(key=lambda e: e["d"])
            for e in x:
                total += e["n"]
                core[i] = e["d"]
                if total >= few:
                    break
        return [{"key": r.key, "blk": r.blk, "mid": r.mid, "middle": r.middle, "radius": r.radius, "core": core}]

    schema = f"key {kinds['key']}, blk long, mid int, middle array<double>, radius double, core array<double>"
    cores = _mapped(alone.join(extra, ["key", "blk"], "left"), final, schema)
    return written(cores, "cores"), pairs


def spanning_edges(held: DataFrame, cores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (key, a, b, w) among which is a minimum spanning tree of each key, and the pairs of blocks that were compared.

    An edge weighs as much as the distance of its ends or the core of either, if that is more. A spanning tree
    of the whole is one of the union of its parts' spanning trees, the parts being blocks and pairs of blocks. A
    pair is left out if its blocks are joined by lighter edges on a way through blocks and their middles.
    """
    kinds = dict(held.dtypes)
    wide = written(held.select("key", "blk", "id", "vec").join(cores, ["key", "blk"]), "wide")
    weight = lambda d, p, q: np.maximum(d, np.maximum(p[:, None], q[None]))

    def inner(r) -> list[dict]:
        x, core = r.vec, r.core
        order, source, length = spanning(weight(apart(x, x), core, core))
        edges = [{"a": r.id[order[t]], "b": r.id[source[t]], "w": length[t]} for t in range(1, len(x))]
        return [{"key": r.key, "blk": r.blk, "edges": edges, "longest": length.max(), "least": core.min(), "core": core[r.mid], "id": r.id[r.mid], "middle": r.middle, "radius": r.radius}]

    edge = f"struct<a:{kinds['id'][6:-1]},b:{kinds['id'][6:-1]},w:double>"
    schema = f"key {kinds['key']}, blk long, edges array<{edge}>, longest double, least double, core double, id {kinds['id'][6:-1]}, middle array<double>, radius double"
    inside = written(_mapped(wide, inner, schema), "inner-edges")

    def close(r) -> Iterator[dict]:
        x, radius, core, longest, least = r.middle, r.radius, r.core, r.longest, r.least
        d = lambda a, b: apart(x[a], x[b])
        n = len(x)
        # Prim's order of blocks: between two of them, the heaviest step of the lightest way is the largest length between their places.
        best, via, done = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
        order, steps = [0], [0.0]
        done[0] = True
        while True:
            v = order[-1]
            direct = np.maximum(d(slice(v, v + 1), slice(None))[0], np.maximum(core[v], core))
            step = np.maximum(direct, np.maximum(longest[v], longest))
            closer = ~done & (step < best)
            best[closer], via[closer] = step[closer], v
            if done.all():
                break
            nxt = int(np.argmin(np.where(done, np.inf, best)))
            far = np.maximum(d(slice(nxt, nxt + 1), slice(via[nxt], via[nxt] + 1))[0, 0], max(core[nxt], core[via[nxt]]))
            yield {"key": r.key, "a": None, "b": None, "way": None, "edge": {"a": r.id[nxt], "b": r.id[via[nxt]], "w": far}}
            order.append(nxt), steps.append(best[nxt])
            done[nxt] = True
        steps, order = np.array(steps), np.array(order)
        for s in range(n - 1):
            a, others = order[s], order[s + 1 :]
            way = np.maximum.accumulate(steps[s + 1 :])
            lower = np.maximum(d(slice(a, a + 1), others)[0] - radius[a] - radius[others], np.maximum(least[a], least[others]))
            for b, most in zip(others[lower < way], way[lower < way], strict=True):
                yield {"key": r.key, "a": r.blk[a], "b": r.blk[b], "way": most, "edge": None}

    listed = _listed(inside, ["middle", "radius", "core", "longest", "least", "id"])
    chosen = written(_mapped(listed, close, f"key {kinds['key']}, a long, b long, way double, edge {edge}"), "edge-pairs")
    pairs = chosen.where("a IS NOT NULL").select("key", "a", "b", "way")

    def across(r) -> Iterator[dict]:
        x, y, p, q = r.vec_a, r.vec_b, r.core_a, r.core_b
        if max(apart(x, r.middle_b[None]).min() - r.radius_b, apart(y, r.middle_a[None]).min() - r.radius_a) >= r.way:
            return
        v, core = np.concatenate([x, y]), np.concatenate([p, q])
        order, source, length = spanning(weight(apart(v, v), core, core))
        ids, n = [*r.id_a, *r.id_b], len(x)
        for t in range(1, len(v)):
            if (order[t] < n) != (source[t] < n):
                yield {"key": r.key, "a": ids[order[t]], "b": ids[source[t]], "w": float(length[t])}

    kind = kinds["id"][6:-1]
    crossing = _mapped(_sides(pairs, wide, ["id", "vec", "core", "middle", "radius"]), across, f"key {kinds['key']}, a {kind}, b {kind}, w double")
    flat = lambda df, c: df.select("key", c.alias("e")).select("key", "e.a", "e.b", "e.w")
    edges = flat(inside, F.explode("edges")).unionByName(flat(chosen.where("edge IS NOT NULL"), F.col("edge"))).unionByName(crossing)
    return written(edges.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w"), "edges"), pairs.select("key", "a", "b")


class Joining:
    """Components of a graph whose edges come by weight, and the groups that they are from `few` vectors on.

    A group gains what smaller components bring, and ends when it meets another group; a new one then begins.
    Its worth is the sum over its vectors of 1 / (the weight at which they came) less that of its end; it is
    chosen if that is no less than what the chosen groups within it are worth.
    """

    def __init__(self, few: int, first: int):
        self.few, self.next = few, first
        self.up: dict = {}
        self.size, self.group, self.came, self.kids = {}, {}, {}, {}
        self.loose: dict = {}  # components that were given and have no group yet
        self.ended: list[tuple] = []
        self.members: list[tuple] = []

    def give(self, root, size: int, group: int | None, came: float, kids: float) -> None:
        self.up[root], self.size[root], self.group[root], self.came[root], self.kids[root] = root, size, group, came, kids
        self.loose[root] = [] if group is not None else [root]
        if group is None and size >= self.few:  # copies
            self._begin(root, 1 / NEAREST)

    def _begin(self, root, closeness: float) -> None:
        self.group[root], self.came[root], self.kids[root] = self.next, self.size[root] * closeness, 0.0
        self.next += 1

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def settle(self, root) -> None:
        self.members += [(x, self.group[root]) for x in self.loose[root]]
        self.loose[root] = []

    def join(self, a, b, w: float) -> None:
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        closeness = 1 / max(w, NEAREST)
        if self.size[a] < self.size[b] or (self.size[a] == self.size[b] and b < a):
            a, b = b, a
        self.up[b] = a
        for x in (a, b):
            if self.group[x] is not None:
                self.settle(x)
        if self.group[a] is not None and self.group[b] is not None:
            worth = 0.0
            for x in (a, b):
                own = self.came[x] - self.size[x] * closeness
                self.ended.append((self.group[x], self.next, own >= self.kids[x]))
                worth += max(own, self.kids[x])
            self.size[a] += self.size[b]
            self._begin(a, closeness)
            self.kids[a] = worth
            return
        grown = self.group[a] is not None
        self.came[a] += self.size[b] * closeness if grown else 0.0
        self.size[a] += self.size[b]
        self.loose[a] += self.loose[b]
        if not grown and self.size[a] >= self.few:
            self._begin(a, closeness)
        if self.group[a] is not None:
            self.settle(a)


_JOINED = "kind string, key {key}, root {kind}, into {kind}, size long, group long, parent long, chosen boolean, came double, kids double"


def _joined(few: int, number: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """One slice of a key: components given and edges to what becomes of them (rows told by `kind`)."""

    def run(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        j = Joining(few, number << 32)
        for r in one.itertuples(index=False):
            j.give(r.root, int(r.size), None if pd.isna(r.group) else int(r.group), float(r.came), float(r.kids))
        for root in list(j.up):
            if j.group[root] is not None:
                j.settle(root)
        for r in many.sort_values(["w", "a", "b"]).itertuples(index=False):
            j.join(r.a, r.b, float(r.w))
        names = [x.split()[0] for x in _JOINED.split(", ")]
        blank = dict.fromkeys(names) | {"key": one["key"].iloc[0]}
        out = []
        for x in j.up:
            root = j.find(x)
            out.append(blank | {"kind": "root", "root": x, "into": root})
            if x == root:
                out.append(blank | {"kind": "component", "root": x, "size": j.size[x], "group": j.group[x], "came": j.came[x], "kids": j.kids[x]})
        out += [blank | {"kind": "group", "group": g, "parent": p, "chosen": c} for g, p, c in j.ended]
        out += [blank | {"kind": "member", "root": x, "group": g} for x, g in j.members]
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"size": "Int64", "group": "Int64", "parent": "Int64", "chosen": "boolean", "came": "float64", "kids": "float64"})

    return run


def condensed(edges: DataFrame, nodes: DataFrame, few: int, most: int = SLICE) -> DataFrame:
    """Edges (key, a, b, w) over nodes (key, id, n) to (key, id, group number): groups chosen from the tree of all radii. What is in none is left out.

    Edges are sorted over all tasks and joined in slices of about `most`: a slice of a key is a task, which gets the
    components that it touches; the next slice of the key follows with what that gave.
    """
    kinds = dict(nodes.dtypes)
    key, kind = kinds["key"], kinds["id"]
    n = -(-edges.count() // most)
    ranked, slices = edges.withColumn("_slice", F.lit(0)), 0
    if n > 1:
        ranked = written(edges.repartitionByRange(n, "key", "w", "a", "b").withColumn("_part", F.spark_partition_id()), "ranked")
        firsts = ranked.groupBy("key").agg(F.min("_part").alias("_first"))
        ranked = written(ranked.join(firsts, "key").withColumn("_slice", F.col("_part") - F.col("_first")).drop("_part", "_first"), "slices")
        slices = ranked.agg(F.max("_slice")).first()[0]
    # root: the component of each node; a component has a size, and from `few` on a group
    state = nodes.select("key", "id", F.col("id").alias("root"))
    plain = nodes.select("key", F.col("id").alias("root"), F.col("n").alias("size"), F.lit(None).cast("long").alias("group"), F.lit(0.0).alias("came"), F.lit(0.0).alias("kids"))
    parts, ended, members = plain, [], []
    for i in range(slices + 1):
        now = ranked.where(F.col("_slice") == i)
        if i:
            a, b = (state.select("key", F.col("id").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b"))
            now = now.join(a, ["key", "a"]).join(b, ["key", "b"]).where("_a <> _b").select("key", F.col("_a").alias("a"), F.col("_b").alias("b"), "w")
            now = written(now, "slice")
        now = now.select("key", "a", "b", "w")
        touched = now.select("key", F.explode(F.array("a", "b")).alias("root")).distinct()
        if not i:  # nodes without edges are components too
            touched = touched.union(parts.where(F.col("size") >= few).select("key", "root")).distinct()
        given = parts.join(touched, ["key", "root"])

        made = written(given.groupBy("key").cogroup(now.groupBy("key")).applyInPandas(_joined(few, i), _JOINED.format(key=key, kind=kind)), "joined")
        ended.append(made.where("kind = 'group'").select("key", "group", "parent", "chosen"))
        members.append(written(state.join(made.where("kind = 'member'").select("key", "root", "group"), ["key", "root"]).select("key", "id", "group"), "members"))
        moved = made.where("kind = 'root'").select("key", "root", "into")
        if i < slices:
            state = written(state.join(moved, ["key", "root"], "left").select("key", "id", F.coalesce("into", "root").alias("root")), "roots")
            rest = parts.join(moved.select("key", "root"), ["key", "root"], "left_anti")
            parts = written(rest.unionByName(made.where("kind = 'component'").select("key", "root", "size", "group", "came", "kids")), "components")
    tops = topmost(reduce(DataFrame.unionByName, ended))
    return written(reduce(DataFrame.unionByName, members).join(tops, ["key", "group"]).select("key", "id", F.col("top").alias("group")), "chosen")


def topmost(groups: DataFrame) -> DataFrame:
    """Groups (key, group, parent, chosen) of trees to (key, group, top): the chosen group nearest the root that a group is in. Each round goes twice as far up."""
    way = written(groups.select("key", "group", F.col("parent").alias("above"), F.when(F.col("chosen"), F.col("group")).alias("top")), "ways")
    while True:
        up = way.select("key", F.col("group").alias("above"), F.col("above").alias("_above"), F.col("top").alias("_top"), F.lit(True).alias("_is"))
        way = written(way.join(up, ["key", "above"], "left").select("key", "group", F.when(F.col("_is"), F.col("_above")).alias("above"), F.coalesce("_top", "top").alias("top")), "ways")
        if way.where("above IS NOT NULL").isEmpty():
            return way.where("top IS NOT NULL").select("key", "group", "top")


def density_groups(rows: DataFrame, few: int, size: int = 512, most: int = SLICE) -> DataFrame:
    """Rows (key, id, vec) to (id, group): density groups of `few` vectors or more within each key, named after their smallest id.

    Vectors are as near as their Euclidean distance. Their density is taken at all radii: of the tree of groups
    those are chosen that last longest, never a key's only one. What is in none is left out. Copies are
    put together first, so a vector that a third of all rows have is one row with a number. Null vectors are
    left out; ids are unique.
    """
    plain = rows.where("vec IS NOT NULL").select("key", "id", "vec")
    copies = written(plain.groupBy("key", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "copies")
    reps = copies.select("key", F.col("rep").alias("id"), "vec", "n")
    held = blocks(reps, size)
    cores, _ = reaches(held, few)
    edges, _ = spanning_edges(held, cores)
    found = condensed(edges, reps.select("key", "id", "n"), few, most)
    same = plain.join(copies.select("key", "vec", "rep"), ["key", "vec"]).select("key", "id", "rep")
    all_of = written(same.join(found.select("key", F.col("id").alias("rep"), "group"), ["key", "rep"]).select("key", "id", "group"), "density-groups")
    names = all_of.groupBy("key", "group").agg(F.min("id").alias("name"))
    return all_of.join(names, ["key", "group"]).select("id", F.col("name").alias("group"))
