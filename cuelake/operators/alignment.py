"""Words of two texts laid over each other by their longest common blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cuelake.staging import written

#: Words of a stretch (of both sides) that a task aligns in one go.
STRETCH = 1 << 16


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


class Blocks:
    """The longest common blocks of two word sequences, then those of what is left of it and right of it, and so on.

    Of blocks of one length the one that begins first in the first sequence counts, then first in the second. All
    stretches of a level are looked at together. names[k] numbers the runs of 2^k words (equal runs, equal
    numbers), so a run of any length is told by a few numbers, and the longest common one is found in as many steps.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.n = len(a)
        words = _dense(np.concatenate([a, b]))
        self.total = len(words)
        names = words + 1
        self.names = [names]
        while True:
            k = len(self.names) - 1
            if not len(np.intersect1d(self.names[k][: self.n], self.names[k][self.n :])) or 2 << k > min(self.n, self.total - self.n):
                break
            ahead = np.zeros(self.total, np.int64)
            ahead[: -(1 << k)] = self.names[k][1 << k :]
            self.names.append(_dense(self.names[k] * (self.total + 1) + ahead) + 1)

    def level(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches (begin and end in the first, begin and end in the second sequence) to their longest blocks (i, j, n), and the stretches left."""
        spans = np.concatenate([stretches[:, :2], stretches[:, 2:] + self.n])
        lengths = spans[:, 1] - spans[:, 0]
        owner = np.repeat(np.arange(len(spans)), lengths)
        at = np.repeat(spans[:, 0] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        end, second = spans[owner, 1], owner >= len(stretches)
        of = owner % len(stretches)
        run, name = np.zeros(len(stretches), np.int64), of.copy()
        for k in range(len(self.names) - 1, -1, -1):
            fits = at + run[of] + (1 << k) <= end
            if not fits.any():
                continue
            some = np.flatnonzero(fits)
            longer = _dense(name[some] * (self.total + 2) + self.names[k][at[some] + run[of[some]]])
            both = np.zeros(longer.max() + 1, np.int8)
            both[longer[~second[some]]] |= 1
            both[longer[second[some]]] |= 2
            common = both[longer] == 3
            if not common.any():
                continue
            grown = np.zeros(len(stretches), bool)
            grown[of[some[common]]] = True
            # a stretch with a longer common run goes on with the places of that run, others as they were
            stay = np.flatnonzero(~grown[of])
            kept = np.concatenate([some[common], stay])
            fresh = np.concatenate([longer[common], name[stay] + longer.max() + 1])
            run[grown] += 1 << k
            at, end, second, of, name = (x[kept] for x in (at, end, second, of, name))
            name = _dense(fresh)
        found = np.flatnonzero(run > 0)
        if not len(found):
            return np.zeros((0, 3), np.int64), np.zeros((0, 4), np.int64)
        first = np.full(len(stretches), self.total)
        np.minimum.at(first, of[~second], at[~second])
        which = np.zeros(len(stretches), np.int64)
        chosen = ~second & (at == first[of])
        which[of[chosen]] = name[chosen]
        other = np.full(len(stretches), self.total)
        mine = second & (name == which[of])
        np.minimum.at(other, of[mine], at[mine])
        i, j, n = first[found], other[found] - self.n, run[found]
        s = stretches[found]
        rest = np.concatenate([np.stack([s[:, 0], i, s[:, 2], j], axis=1), np.stack([i + n, s[:, 1], j + n, s[:, 3]], axis=1)])
        return np.stack([i, j, n], axis=1), rest[(rest[:, 0] < rest[:, 1]) & (rest[:, 2] < rest[:, 3])]

    def all(self, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All blocks. With `most`: those down to where each stretch has no more than so many words, and the stretches."""
        live = np.array([[0, self.n, 0, self.total - self.n]])
        live = live[(live[:, 1] > 0) & (live[:, 3] > 0)]
        blocks = [np.zeros((0, 3), np.int64)]
        while len(live) and (most is None or (live[:, 1] - live[:, 0] + live[:, 3] - live[:, 2]).max() > most):
            some, live = self.level(live)
            blocks.append(some)
        return np.concatenate(blocks), live


def matches(xs: list[list], ys: list[list]) -> np.ndarray:
    """For each pair of lists how many elements their longest common blocks hold, all pairs at once."""
    la, lb = (np.array([len(v) for v in side], np.int64) for side in (xs, ys))
    ids = pd.factorize(np.array([w for side in (xs, ys) for v in side for w in v], object), use_na_sentinel=False)[0]
    blocks, total = Blocks(ids[: la.sum()], ids[la.sum() :]), np.zeros(len(la), np.int64)
    ends = np.cumsum(la)
    live = np.stack([ends - la, ends, np.cumsum(lb) - lb, np.cumsum(lb)], axis=1)
    live = live[(la > 0) & (lb > 0)]
    while len(live):
        some, live = blocks.level(live)
        np.add.at(total, np.searchsorted(ends, some[:, 0], side="right"), some[:, 2])
    return total


def aligned(script: DataFrame, words: DataFrame, most: int = STRETCH) -> DataFrame:
    """Script words (ep, i, key) with the caption words (ep, j, key) that match them in order, longest blocks first.

    An episode of more than `most` words is cut by its longest blocks until its stretches are smaller, which then
    are tasks of their own. What a task holds of an episode is its words. Rows without a place or a word are left out, as are
    episodes that one side lacks.
    """
    kind = dict(script.dtypes)["ep"]
    place = {"a": "i", "b": "j"}

    def side(df: DataFrame, s: str) -> DataFrame:
        rows = df.where(F.col(place[s]).isNotNull() & F.col("key").isNotNull()).select("ep", F.struct(F.col(place[s]).cast("long").alias("at"), "key").alias("w"))
        return rows.groupBy("ep").agg(F.sort_array(F.collect_list("w")).alias("w")).select("ep", F.col("w.at").alias(f"{s}_at"), F.col("w.key").alias(f"{s}_key"))

    schema = f"ep {kind}, i long, j long, a_at array<long>, a_key array<string>, b_at array<long>, b_key array<string>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    empty = arrow.empty_table().to_batches() or []

    def run(whole: bool):
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from empty
            for batch in batches:
                for r in range(batch.num_rows):
                    ep = batch.column("ep").slice(r, 1)
                    a_at, a_key, b_at, b_key = (batch.column(c)[r].values for c in ("a_at", "a_key", "b_at", "b_key"))
                    ids = pa.concat_arrays([a_key, b_key]).dictionary_encode().indices.to_numpy()
                    blocks, left = Blocks(ids[: len(a_key)], ids[len(a_key) :]).all(None if whole else most)
                    offset = np.arange(int(blocks[:, 2].sum())) - np.repeat(np.cumsum(blocks[:, 2]) - blocks[:, 2], blocks[:, 2])
                    i, j = (a_at.take(pa.array(np.repeat(blocks[:, 0], blocks[:, 2]) + offset)), b_at.take(pa.array(np.repeat(blocks[:, 1], blocks[:, 2]) + offset)))
                    none = [pa.nulls(len(i), arrow.field(c).type) for c in arrow.names[3:]]
                    yield pa.RecordBatch.from_arrays([ep.take(pa.array(np.zeros(len(i), np.int64))), i, j, *none], schema=arrow)
                    for x, y, p, q in left.tolist():
                        row = [ep[0].as_py(), None, None, a_at[x:y].to_pylist(), a_key[x:y].to_pylist(), b_at[p:q].to_pylist(), b_key[p:q].to_pylist()]
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row, strict=True))], arrow)

        return over

    columns = ["ep", "a_at", "a_key", "b_at", "b_key"]
    first = written(side(script, "a").join(side(words, "b"), "ep").mapInArrow(run(False), schema), "aligned")
    stretches = first.where("i IS NULL").select(*columns)
    spread = stretches.repartition("ep", F.xxhash64("a_at")).mapInArrow(run(True), schema)
    return first.where("i IS NOT NULL").select("ep", "i", "j").unionByName(spread.select("ep", "i", "j"))
