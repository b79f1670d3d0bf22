"""Density groups: neighbours, spanning edges and chosen groups against plain computations in memory; mean vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.operators import density, faces, vectors
from cuelake.staging import written


def reference(x: np.ndarray, few: int) -> set[frozenset[int]]:
    """All distances, all edges by weight, then the tree from the root down."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=-1))
    core = np.sort(d, axis=1)[:, few - 1]
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    up, top, size, tree = list(range(n)), list(range(n)), [1] * n, [None] * n

    def find(a: int) -> int:
        while up[a] != a:
            a = up[a]
        return a

    for w, i, j in sorted((m[i, j], j, i) for i in range(n) for j in range(i)):
        a, b = find(i), find(j)
        if a != b:
            up[a] = b
            size.append(size[top[a]] + size[top[b]])
            tree.append((top[a], top[b], w))
            top[b] = len(tree) - 1

    def points(t: int) -> frozenset[int]:
        out, todo = [], [t]
        while todo:
            t = todo.pop()
            out += [t] if tree[t] is None else []
            todo += [] if tree[t] is None else tree[t][:2]
        return frozenset(out)

    def choose(t: int, birth: float, root: bool = False) -> tuple[float, list]:
        begin, worth, kids = t, 0.0, []
        while True:
            a, b, w = tree[t]
            close = 1 / max(w, density.NEAREST)
            large = [q for q in (a, b) if size[q] >= few]
            worth += sum(size[q] * (close - birth) for q in (a, b) if len(large) == 2 or size[q] < few)
            if len(large) == 2:
                kids = [choose(q, close) for q in large]
            if len(large) != 1:
                break
            t = large[0]
        inner = sum(k for k, _ in kids)
        return (worth, [points(begin)]) if not root and worth >= inner else (inner, [c for _, some in kids for c in some])

    return set(choose(len(tree) - 1, 0.0, True)[1]) if n >= few else set()


def planted(seed: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    groups = [rng.normal(size=dim) * 3 + rng.normal(size=(rng.integers(20, 60), dim)) * rng.choice([0.02, 0.2, 0.6]) for _ in range(5)]
    return np.concatenate([*groups, rng.normal(size=(25, dim)) * 4])


def frame(spark, x: np.ndarray, keys: np.ndarray):
    rows = [(int(k), i, [float(c) for c in v]) for i, (k, v) in enumerate(zip(keys, x, strict=True))]
    return spark.createDataFrame(rows, "key long, id long, vec array<double>").repartition(4)


def found(df, few: int, size: int, most: int) -> set[frozenset[int]]:
    groups: dict[int, set[int]] = {}
    for r in density.density_groups(df, few, size, most).collect():
        groups.setdefault(r["group"], set()).add(r["id"])
    assert all(min(v) == k for k, v in groups.items())
    return {frozenset(v) for v in groups.values()}


@pytest.mark.parametrize(("seed", "dim", "size", "most"), [(0, 3, 16, 1 << 18), (1, 3, 40, 90), (2, 8, 512, 1 << 18)])
def test_groups_of_unlike_tightness_equal_a_computation_in_memory(spark, seed, dim, size, most):
    """Many small blocks, many slices of edges, and one block and slice."""
    x = planted(seed, dim)
    keys = np.random.default_rng(seed).integers(0, 2, len(x))
    want = set()
    for k in (0, 1):
        ids = np.flatnonzero(keys == k)
        want |= {frozenset(int(ids[i]) for i in c) for c in reference(x[ids], 5)}
    assert len(want) > 4
    assert found(frame(spark, x, keys), 5, size, most) == want


def test_copies_are_one_vector_with_a_number(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(30, 4)) * 0.1, 5 + rng.normal(size=(30, 4)) * 0.1])
    many = np.concatenate([x, np.repeat(x[:1], 40, axis=0), np.repeat(x[40:41], 3, axis=0)])
    got = found(frame(spark, many, np.zeros(len(many))), 5, 8, 1 << 18)
    assert got == reference(many, 5)
    assert any({0, *range(60, 100)} <= g for g in got) and any({40, 100, 101, 102} <= g for g in got)
    assert found(frame(spark, x[:4], np.zeros(4)), 5, 8, 1 << 18) == set()
    assert density.density_groups(frame(spark, x, np.zeros(60)).limit(0), 5).count() == 0


def test_neighbours_are_exact_and_few_blocks_are_compared(spark):
    compared = []
    for n in (400, 1600):
        x = np.random.default_rng(n).random((n, 3))
        rows = frame(spark, x, np.zeros(n)).withColumn("n", F.lit(1).cast("long"))
        held = density.blocks(rows, 16)
        cores, pairs = density.reaches(held, 6)
        got = {}
        for r in held.join(cores, ["key", "blk"]).select("id", "core").collect():
            got |= dict(zip(r["id"], r["core"], strict=True))
        want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=-1)), axis=1)[:, 5]
        assert np.allclose([got[i] for i in range(n)], want)
        sizes = held.select("blk", F.size("id").alias("n"))
        size_a, size_b = (sizes.select(F.col("blk").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
        across = pairs.join(size_a, "a").join(size_b, "b").agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0]
        edges, wider = density.spanning_edges(held, cores)
        compared.append(across)
        assert wider.count() <= held.count() * (held.count() - 1) / 2
        assert n < 1000 or across < n * n / 4
        # the lightest edges that join all are among those given
        up = list(range(n))

        def find(a, up=up):
            while up[a] != a:
                a = up[a]
            return a

        total = 0.0
        for r in sorted(edges.collect(), key=lambda r: r["w"]):
            a, b = find(r["a"]), find(r["b"])
            if a != b:
                up[a], total = b, total + r["w"]
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=-1))
        whole = np.maximum(d, np.maximum(want[:, None], want[None]))
        assert np.isclose(total, density.spanning(whole)[2].sum())
    assert compared[1] < 8 * compared[0]


def test_faces_of_a_key_with_a_third_of_all_rows(spark):
    """One episode has most faces; rows without a vector, with a zero vector and with other columns."""
    rng = np.random.default_rng(4)
    middles = np.eye(6)[:3]
    rows = []
    for i in range(240):
        v = middles[i % 3] + rng.normal(size=6) * (0.02, 0.05, 0.1)[i % 3]
        rows.append((i, 0 if i < 120 else 1 + i % 4, v.tolist()))
    rows += [(900, 0, None), (901, 1, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, episode long, embedding array<double>").withColumns({"key": F.lit("x"), "group": F.lit("x"), "vec": F.lit("x"), "n": F.lit("x")})
    got = {}
    for r in faces.grouped(df, least=20).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(len, got.values()), reverse=True) == [len(got[k]) for k in sorted(got)]
    assert all(len({i % 3 for i in g}) == 1 for g in got.values()) and len(got) == 3 and sum(map(len, got.values())) > 230


def test_mean_vectors_are_summed_in_tasks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    rows = [(None if i % 50 == 0 else f"g{i % 7}", x[i].tolist()) for i in range(300)] + [("g1", None), ("zero", [0.0] * 5)]
    df = spark.createDataFrame(rows, "name string, embedding array<double>").repartition(6)
    for most in (2, 4096):
        out = {r["name"]: r["centre"] for r in vectors.centres(df, "name", most=most).collect()}
        for g in {r[0] for r in rows} - {"zero"}:
            mean = np.mean([v for n, v in rows if n == g and v is not None], axis=0)
            assert np.allclose(out[g], mean / np.linalg.norm(mean))
        assert out["zero"] is None
    counted = written(vectors.centres(df, "name"), "centres")
    assert counted.count() == 9
    assert vectors.centres(df.limit(0), "name").count() == 0
