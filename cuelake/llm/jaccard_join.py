"""Near duplicates by the Jaccard similarity of word shingles, counted in fragments of a global shingle order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.bitmap import bitmap_of, bits_for, marked
from cuelake.operators.components import components
from cuelake.llm.contexts import small_batches
from cuelake.llm.line_dedup import BLOOM_SCHEMA, fill, may_repeat, merged_filter
from cuelake.llm.words import ranges, shingles, split_by, words_of
from cuelake.staging import written

#: The order's fragments are ranges of shingle hashes.
FRAGMENTS = 4
HOT_BITS = 1 << 26
#: Tokens with more rows of which each may be the smaller one of a pair go by differences from a hub.
CROWD = 16


def prefix_length(n: int, percent: int) -> int:
    """Of the first so many shingles of sets that are alike, at least one is shared."""
    return n - -(-percent * n // 100) + 1


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    hashes, lengths = shingles(words_of(texts), width, short=True)
    return [np.unique(hashes[a:b]) for a, b in split_by(lengths)]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _hot(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """1 for shingles that the hot filter has, few of them by collision alone."""
    bit = (s & np.uint64(HOT_BITS - 1)).astype(np.int64)
    return (hot[bit >> 3] >> (bit & 7)) & 1


def _ordered(s: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    """A sorted set in the global order: shingles of the hot filter last, by hash otherwise."""
    return s if hot is None else s[np.argsort(_hot(s, hot), kind="stable")]


def _with_hot(batches: Iterator[pa.RecordBatch], shared, has: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose prefix has a shingle of the hot filter, or the others."""
    for batch in batches:
        if batch.num_rows:
            prefix = batch.column("prefix")
            at = prefix.offsets.to_numpy().astype(np.int64)
            marks = _hot(prefix.values.to_numpy()[at[0] : at[-1]].view(np.uint64), shared.value)
            upto = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[at - at[0]]
            yield batch.filter(pa.array((np.diff(upto) > 0) == has))


def _ids_with_hot(shared):
    return lambda batches: (batch.select(["_id"]) for batch in _with_hot(batches, shared, True))


def _fill_with(bits: int, but_hot):
    """Filters of the shingles of prefixes, those with a hot shingle left out if a hot filter is given."""
    return lambda batches: fill(bits)(pa.RecordBatch.from_arrays([b.column("prefix").flatten()], ["token"]) for b in (_with_hot(batches, but_hot, False) if but_hot else batches))


def _tokens(bloom, bits: int, but_hot):
    """Prefixes to rows (pos, token, _id, n) of shingles that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _with_hot(batches, but_hot, False) if but_hot else batches:
            prefix = batch.column("prefix")
            token = prefix.flatten()
            lengths = np.diff(prefix.offsets.to_numpy()).astype(np.int64)
            kept = pa.array(np.flatnonzero(may_repeat(bloom.value, token.to_numpy(zero_copy_only=False), bits)))
            owner = pa.array(np.repeat(np.arange(len(lengths)), lengths)).take(kept)
            pos = pa.array(ranges(np.zeros(len(lengths), np.int64), lengths).astype(np.int32)).take(kept)
            yield pa.RecordBatch.from_pydict({"pos": pos, "token": token.take(kept), "_id": batch.column("_id").take(owner), "n": batch.column("n").take(owner)})

    return run


def _prefixes(width: int, percent: int, shared):
    """Sets and the first of their shingles; with a hot filter, those alone whose first shingles by hash have a hot one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value if shared else None
        for batch in small_batches(batches, "_text", 2 << 20):
            sets, ids = _sets(batch.column("_text"), width), batch.column("_id")
            cuts = [prefix_length(len(s), percent) if len(s) else 0 for s in sets]
            if hot is not None:
                kept = [i for i, (s, k) in enumerate(zip(sets, cuts, strict=True)) if _hot(s[:k], hot).any()]
                sets, cuts, ids = [sets[i] for i in kept], [cuts[i] for i in kept], ids.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_pydict(
                {
                    "_id": ids,
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "sig": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    "prefix": _longs([_ordered(s, hot)[:k] for s, k in zip(sets, cuts, strict=True)]),
                }
            )

    return run


def _fragments(width: int):
    """Whole sets, cut into the fragments of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", 2 << 20):
            sets = _sets(batch.column("_text"), width)
            cuts = [[0, *np.searchsorted(s, np.array([k << 62 for k in range(1, FRAGMENTS)], np.uint64)).tolist(), len(s)] for s in sets]
            ids = batch.column("_id").take(pa.array(np.repeat(np.arange(len(sets)), FRAGMENTS)))
            parts = [x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True) for k in range(FRAGMENTS)]
            yield pa.RecordBatch.from_pydict({"_id": ids, "fragment": pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(sets))), "part": _longs(parts)})

    return run


def _packed_bits(bitmap: DataFrame) -> np.ndarray:
    """A bitmap's rows as one array of HOT_BITS bits."""
    out = np.zeros((max(1, HOT_BITS // 32768), 4096), np.uint8)
    for r in bitmap.collect():
        out[r["_bucket"] - 1] = np.frombuffer(bytes(r["_bitmap"]), np.uint8)
    return out.reshape(-1)


class Join:
    """The steps of a join. Rows of tokens are (token, _id, n, pos, hi, df): a prefix shingle, its
    document, the size of its set, its place in the order, and the largest set that can still link with
    this one if this is the first shingle they share."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, hot_docs: int, filter_bits: int | None):
        self.rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        self.kind = dict(self.rows.dtypes)["_id"]
        self.width, self.percent, self.hot_docs, self.bits = width, percent, hot_docs, filter_bits
        self.spark = docs.sparkSession

    def of(self, ids: DataFrame) -> DataFrame:
        """The texts of ids (and few others), found beside the scan."""
        key, bits = F.xxhash64("_id"), bits_for(ids.count())
        return marked(self.rows, key, bitmap_of(ids, key, bits), bits).where("_marked AND _id IS NOT NULL").select("_id", "_text")

    def repeated(self) -> DataFrame:
        """Rows of tokens that two documents have; others are dropped beside the scan, nearly all. So are rows
        whose place is too far back for even the smallest set that has the token. Of `sources`, prefixes with a
        shingle of a source's hot filter don't count: the next source has them anew."""
        sources = self.sources
        if not self.bits:
            total = sources[0][0].agg(F.coalesce(F.sum(F.size("prefix").cast("long")), F.lit(0))).first()[0]
            self.bits = 1 << min(28, max(22, (16 * total).bit_length()))
        filters = [rows.mapInArrow(_fill_with(self.bits, but), BLOOM_SCHEMA) for rows, but in sources]
        bloom = self.spark.sparkContext.broadcast(merged_filter(reduce(DataFrame.unionByName, filters), self.bits))
        found = [rows.mapInArrow(_tokens(bloom, self.bits, but), f"pos int, token long, _id {self.kind}, n long") for rows, but in sources]
        likely = written(reduce(DataFrame.unionByName, found), "jaccard-likely")
        counts = likely.groupBy("token").agg(F.count("*").alias("df"), F.min("n").alias("least")).where("df > 1")
        hi = F.expr(f"(n - pos) * {100 + self.percent} div {self.percent} - n")
        kept = likely.join(written(counts, "jaccard-counts"), "token").withColumn("hi", hi).where("hi >= least")
        return written(kept.select("token", "_id", "n", "pos", "hi", "df", "least"), "jaccard-tokens")

    def representatives(self, sets: DataFrame, classes: DataFrame) -> DataFrame:
        """One row (_id, n, prefix) for each class. Where a set has one row only, which a bitmap of the others says beside the scan, that is it."""
        several = classes.where("members > 1")
        key, bits = F.xxhash64("sig"), bits_for(several.count())
        rows = marked(sets.where("n > 0 AND _id IS NOT NULL").select("_id", "n", "sig", "prefix"), key, bitmap_of(several, key, bits), bits)
        reps = classes.where("rep IS NOT NULL").select(F.col("rep").alias("_id"))
        shared = rows.where("_marked").join(reps, "_id", "left_semi")
        return written(rows.where("NOT _marked").unionByName(shared).select("_id", "n", "prefix"), "jaccard-prefixes")

    def postings(self, current: DataFrame) -> DataFrame:
        """Prefix shingles that several classes share, under an order in which common shingles come last.

        Common are those that several have of a few documents picked for each hot prefix shingle: near
        copies have most shingles of any of their group, and what a document has alone then stands in front,
        where it takes up the place that a link leaves for differences. The order is a function of the shingle, so
        any choice gives right results. The same filter that orders, collisions and all, tells whose prefix changes: all that have a shingle in it."""
        prefixes = f"_id {self.kind}, n long, sig binary, prefix array<long>"
        self.sources = [(current, None)]
        tokens = self.repeated()
        often = tokens.where(F.col("df") > self.hot_docs).groupBy("token")
        some = [F.min_by("_id", F.struct(F.col("n") > 3 * F.col("least"), F.xxhash64("_id", F.lit(k)))) for k in range(5)]  # no very long ones
        picked = often.agg(F.array(*some).alias("ids"))
        picked = written(picked.select(F.explode("ids").alias("_id")).distinct(), "jaccard-picked")
        if picked.isEmpty():
            return tokens
        sets_ = self.of(picked).mapInArrow(_fragments(self.width), f"_id {self.kind}, fragment int, part array<long>")
        common = sets_.select(F.explode("part").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
        shared = self.spark.sparkContext.broadcast(_packed_bits(bitmap_of(common, F.col("token"), HOT_BITS)))
        moved = written(current.mapInArrow(_ids_with_hot(shared), f"_id {self.kind}").distinct(), "jaccard-moved")
        # what the scan's filter lets through besides has no hot shingle, or is an equal set, which changes nothing
        new = self.of(moved).mapInArrow(_prefixes(self.width, self.percent, shared), prefixes)
        new = written(new.select("_id", "n", "prefix"), "jaccard-moved-prefixes")
        self.sources = [(current, shared), (new, None)]
        return self.repeated()

    def needed(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows of the documents of pairs (and few others)."""
        key, bits = F.xxhash64("_id"), bits_for((ids := self.ids(pairs)).count())
        return marked(rows, key, bitmap_of(ids, key, bits), bits).where("_marked").drop("_marked")

    def beside(self, pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) with the parts of both sets, a row for each fragment of the order."""
        parts = self.needed(parts, pairs)
        return pairs.join(parts.toDF("b", "fragment", "part_b"), "b").join(parts.toDF("a", "fragment", "part_a"), ["a", "fragment"])

    def alike_first(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose prefixes, the order's first fragment, share enough for a link: what stands behind the
        prefix that ends first, in either set, can't make up for more."""
        keep = lambda hot: lambda batches: _with_hot(batches, hot, False)
        own = f"_id {self.kind}, n long, prefix array<long>"
        found = [self.needed(rows, pairs) if hot is None else self.needed(rows, pairs).mapInArrow(keep(hot), own) for rows, hot in self.sources]
        prefixes = written(reduce(DataFrame.unionByName, found).select("_id", "prefix"), "jaccard-needed-prefixes")
        both = pairs.join(prefixes.toDF("b", "prefix_b"), "b").join(prefixes.toDF("a", "prefix_a"), "a")
        most = F.size(F.array_intersect("prefix_a", "prefix_b")) + F.greatest(F.col("n_a") - F.size("prefix_a"), F.col("n_b") - F.size("prefix_b"))
        return written(both.where(self.enough(most)).select("a", "b", "n_a", "n_b").distinct(), "jaccard-alike")

    def enough(self, shared: Column) -> Column:
        return shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * self.percent

    def links(self, pairs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b, n_a, n_b) that link: partial overlaps of each fragment of the order are counted apart and added up per pair."""
        pairs = self.alike_first(pairs)
        same = F.size(F.array_intersect("part_a", "part_b")).cast("long")
        each = [F.max(F.when(F.col("fragment") == k, same)).alias(f"s{k}") for k in range(FRAGMENTS)]  # ids that repeat give parts that do
        summed = self.beside(pairs, self.parts(pairs) if parts is None else parts).groupBy("a", "b", "n_a", "n_b").agg(*each)
        whole = sum((F.coalesce(f"s{k}", F.lit(0)) for k in range(FRAGMENTS)), F.lit(0).cast("long"))
        return written(summed.where(self.enough(whole)).select("a", "b", "n_a", "n_b"), "jaccard-links")

    def star(self, tokens: DataFrame, central: Column, fits: Column, sides: list[str]) -> DataFrame:
        """For each token its most central row, against the rows of other components that it can link with;
        of a document's pairs the one that most tokens have. No more pairs than documents."""
        of_a = [f"{c}_a" for c in sides]
        hubs = tokens.groupBy("token").agg(F.min_by(F.struct(*sides), central).alias("hub"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        hubs = hubs.select("token", *(F.col(f"hub.{c}").alias(d) for c, d in zip(sides, of_a, strict=True)))
        other = tokens.select("token", *(F.col(c).alias(f"{c}_b") for c in sides))
        met = other.join(written(hubs, "jaccard-hubs"), "token").where((F.col("comp_a") != F.col("comp_b")) & fits)
        pairs = met.groupBy("_id_a", "_id_b", "n_a", "n_b").agg(F.count("*").alias("k"))
        best = pairs.groupBy("_id_b").agg(F.max(F.struct("k", -F.col("n_a"), F.col("_id_a").alias("a"), "n_a", "n_b")).alias("x"))
        return written(best.select("x.a", F.col("_id_b").alias("b"), "x.n_a", "x.n_b"), "jaccard-star")

    def met(self, tokens: DataFrame, fits: Column, sides: list[str]) -> DataFrame:
        """All pairs (a, b, n_a, n_b) of a token's rows that are in different components and can link."""
        x, y = (tokens.select("token", *(F.col(c).alias(f"{c}_{k}") for c in sides)) for k in "ab")
        pairs = x.join(y, "token").where((F.col("_id_a") < F.col("_id_b")) & (F.col("comp_a") != F.col("comp_b")) & fits)
        return pairs.select(F.col("_id_a").alias("a"), F.col("_id_b").alias("b"), "n_a", "n_b").distinct()

    def labelled(self, tokens: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Tokens with the component of their document, where they have more than one."""
        tokens = tokens.drop("comp")
        if labels is None:
            return tokens.withColumn("comp", F.col("_id"))
        mine = labels.select(F.col("node").alias("_id"), F.col("label"))
        return tokens.join(mine, "_id", "left").withColumn("comp", F.coalesce("label", "_id")).drop("label")

    def deltas(self, pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs (a: a hub, b, n_a, n_b) with e, in how many shingles their sets differ, and the first of these:
        those that the hub lacks before those that it has alone.

        How two documents differ from the same hub tells how they differ from each other: if they link they
        share so many of these differences that one of the first is shared.
        """
        new, gone = F.array_except("part_b", "part_a"), F.array_except("part_a", "part_b")
        each = self.beside(pairs, parts).select("a", "b", "n_a", "n_b", new.alias("new"), gone.alias("gone"))
        whole = each.groupBy("a", "b", "n_a", "n_b").agg(F.flatten(F.collect_list("new")).alias("new"), F.flatten(F.collect_list("gone")).alias("gone"))
        mark = lambda k: lambda x: F.xxhash64(F.col("a"), F.lit(k), x)
        every = F.concat(F.transform(F.array_sort("new"), mark(0)), F.transform(F.array_sort("gone"), mark(1)))
        most = F.expr(f"n_b * {100 - self.percent} div {self.percent} + 1").cast("int")
        return written(whole.select("a", "b", "n_a", "n_b", F.size(every).cast("long").alias("e"), F.slice(every, 1, most).alias("first")), "jaccard-deltas")

    def hub_pairs(self, left: DataFrame) -> DataFrame:
        """Each token's most central document (a) with all others (b)."""
        hubs = left.groupBy("token").agg(F.min_by(F.struct("_id", "n"), F.struct("pos", "_id")).alias("hub"))
        pairs = left.join(written(hubs, "jaccard-hubs"), "token")
        pairs = pairs.select(F.col("hub._id").alias("a"), F.col("_id").alias("b"), F.col("hub.n").alias("n_a"), F.col("n").alias("n_b"))
        return pairs.where("a <> b").distinct()

    def crowded(self, crowd: DataFrame, parts: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For hubs and their documents: (links with those found, pairs that are still to be checked).

        Documents that differ from the hub in the same way are compared, first stars of them.
        """
        deltas = self.deltas(crowd, parts)
        up, down = 100 + self.percent, 100 - self.percent
        bound = down * (F.col("n_a") + F.col("n_b"))
        linked = linked.unionByName(deltas.where(F.col("e") * up <= bound).select("a", "b", "n_a", "n_b"))
        rows = deltas.select(F.posexplode("first").alias("pos", "token"), F.col("b").alias("_id"), F.col("n_b").alias("n"), "e")
        sides, gap = ["_id", "n", "e", "pos", "comp"], F.col("e_b") - F.col("e_a")
        fits = ((gap + 2 * F.col("pos_a")) * up <= bound) & ((2 * F.col("pos_b") - gap) * up <= bound)
        rows = self.several(self.labelled(rows, components(linked)))
        pairs = self.star(rows, F.struct("e", "_id"), fits, sides)
        if not pairs.isEmpty():
            linked = linked.unionByName(self.links(pairs, parts))
            rows = self.several(self.labelled(rows, components(linked)))
        return linked, self.met(rows, fits, sides)

    def several(self, rows: DataFrame) -> DataFrame:
        """Rows of tokens whose rows are in several components."""
        counts = rows.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        return written(rows.join(written(counts.select("token"), "jaccard-several"), "token"), "jaccard-left")

    def parts(self, pairs: DataFrame) -> DataFrame:
        """Fragments of the sets that pairs (a, b) need, and of few others."""
        return written(self.of(self.ids(pairs)).mapInArrow(_fragments(self.width), f"_id {self.kind}, fragment int, part array<long>"), "jaccard-parts")

    def ids(self, pairs: DataFrame) -> DataFrame:
        return written(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "jaccard-ids")

    def run(self) -> tuple[DataFrame, DataFrame]:
        sets = written(self.rows.mapInArrow(_prefixes(self.width, self.percent, None), f"_id {self.kind}, n long, sig binary, prefix array<long>"), "jaccard-sets")
        classes = written(sets.where("n > 0").groupBy("sig").agg(F.min("_id").alias("rep"), F.count("*").alias("members")), "jaccard-classes")
        left = self.several(self.labelled(self.postings(self.representatives(sets, classes)), None))
        sides, fits = ["_id", "n", "pos", "hi", "comp"], (F.col("n_a") <= F.col("hi_b")) & (F.col("n_b") <= F.col("hi_a"))
        seen = self.star(left, F.struct("pos", "_id"), fits, sides)
        linked = self.links(seen)
        left = self.several(self.labelled(left, components(linked)))

        # of two rows that fit, the smaller one fits its own size, so few such rows mean few pairs
        strong = left.groupBy("token").agg(F.count_if(F.col("hi") >= F.col("n")).alias("strong")).where(F.col("strong") > CROWD).select("token")
        strong = written(strong, "jaccard-strong")
        seen = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = self.met(left.join(strong, "token", "left_anti"), fits, sides).join(seen, ["a", "b"], "left_anti")
        pairs = written(pairs, "jaccard-rest")
        crowd = written(self.hub_pairs(left.join(strong, "token", "left_semi")), "jaccard-crowd")
        if not crowd.isEmpty():
            linked, more = self.crowded(crowd, self.parts(crowd), linked)
            pairs = written(pairs.unionByName(more).distinct(), "jaccard-rest")
        linked = linked.unionByName(self.links(pairs))
        return sets.select("_id", "n", "sig").join(classes.drop("members"), "sig", "left"), components(linked)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, hot_docs: int = 16, filter_bits: int | None = None
) -> DataFrame:
    """One row per input row: id, n_shingles, class_id, component_id.

    Words are runs of non-white characters with A-Z lower-cased; a text's set is its distinct shingles of
    `width` words, a text with fewer words has its whole sequence as one. Sets link when
    100 * intersection >= percent * union. class_id is the smallest id with the same set,
    component_id the smallest id that links reach.

    Equal sets become one class first. Of classes that are alike, one of the first shingles (by the
    global order) is shared, so only classes that meet there are compared, by fragments of the order
    whose partial overlaps are added up per pair; a shared shingle that stands too far back in either
    set to leave room for a link (by the sets' sizes) doesn't count. Groups of very many near copies
    aren't compared all with all: first each shingle's most central document is compared with the others
    and components are merged; where more than CROWD documents are still left of a shingle that could
    link with a larger one, they meet by their differences from its central document, as links share
    most of these; what is left then is compared. No pair that could link two components is left out.

    Only prefix shingles are shuffled, and of those only ones that a filter of `filter_bits` bits says
    occur twice (by default some 16 for each, 2 ** 28 at most, which is what is broadcast); texts are never shuffled. Shingles are told apart by 64-bit hashes, sets by 128-bit
    ones. Null or empty texts, and those without words, have no shingle, class and component themselves.
    Rows that repeat an id and a text are in one class; ids should be unique otherwise. Rows with a null
    id get their class's ids, null if it has none. An empty table gives no rows.
    """
    members, labels = Join(docs, id_col, text_col, width, percent, hot_docs, filter_bits).run()
    members = written(members, "jaccard-members")
    out = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    own = F.coalesce("rep", "_id")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("class_id"), F.coalesce("label", own).alias("component_id"))
