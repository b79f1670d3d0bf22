"""The training-data operators against SQL twins, brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuelake.llm import queries as q
from cuelake.llm.bpe import Bpe, bpe_encode
from cuelake.operators.components import components
from cuelake.llm.contexts import Automaton, counted, grams, levels_of, stream
from cuelake.llm.decontaminate import contained_items
from cuelake.llm.exact_dedup import exact_dedup
from cuelake.llm.jaccard_join import near_duplicates
from cuelake.llm.language_id import identify, ppm, train
from cuelake.llm.line_dedup import line_dedup
from cuelake.llm.pii import sanitise
from cuelake.llm.quality import Kernel, features, isotonic, quality_score
from cuelake.llm.rans import Table
from cuelake.llm.suffix_tree import learn_tree, lm_score, smoothed
from cuelake.llm.token_output import PieceIds, read_tokens, token_folder, write_tokens
from cuelake.llm.words import shingles, words_of

from ..conftest import DATA

WORD = r"[^\x20\x09-\x0D]+"
#: Columns that operators make themselves, with other types.
CLASH = {"_id": "x", "_text": "x", "n": "x", "kept": "x", "score": "x", "token": "x", "label": "x", "_hash": "x", "rep": "x", "spans": "x", "ids": "x", "block": "x"}


def lowered(t: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def words(t: str | None) -> list[str]:
    return re.findall(WORD, lowered(t))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioubcdst") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = make(120)
    texts = [None, "", " \n\t", "a", "One two three", "one  two three", base, base, base.replace(" ", "\n", 3), make(30_000), "é" * 3000, "x" * 9000, "1234 5678", "<|endoftext|> it's  a b　c\x00d"]
    near = base.split()
    for _ in range(60):
        other = list(near)
        for _ in range(rng.randrange(0, 4)):
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
        texts.append(" ".join(other))
    passage = make(60)
    texts += [make(40) + "\n" + passage + "\n" + make(rng.randrange(5, 40)) for _ in range(12)]
    texts += [make(rng.randrange(0, 9)) for _ in range(30)]
    rows = [(i, t, rng.choice(["aa", "bb", None]), "s") for i, t in enumerate(texts)]
    rows += [rows[6], (None, base, "aa", None), (None, "only here and nowhere else", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(5)


def rows_of(docs) -> list:
    return docs.select("doc_id", "text").collect()


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_agrees_with_sql(name, agree):
    agree(q.queries()[name], q.oracle_sql()[name])


def test_line_dedup_joins_alike_at_every_size(docs):
    """Texts meet the keys they lose by a shuffle on small tables too, so that what is measured there grows in proportion."""
    plan = line_dedup(docs, filter_bits=1 << 18)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftOuter" in plan.partition("SortMergeJoin")[2].partition("\n")[0]


def test_line_dedup(docs):
    holders: dict[str, set] = {}
    for d, t in rows_of(docs):
        for line in (t or "").split("\n"):
            holders.setdefault(lowered(line.strip(" \t\n\x0b\x0c\r")), set()).add(d)
    often = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    want = Counter()
    for d, t in rows_of(docs):
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := lowered(x.strip(" \t\n\x0b\x0c\r"))) not in often or often[k] == d]
        want[(d, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    assert Counter(tuple(r) for r in line_dedup(docs, filter_bits=1 << 18).collect()) == want
    assert any(n for _, _, _, n in want)
    assert line_dedup(docs.limit(0), filter_bits=1 << 18).count() == 0


def test_exact_dedup(docs):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for d, t in rows_of(docs):
        groups.setdefault(key(t), []).append(d)
    want = Counter()
    for g in groups.values():
        keep = min((d for d in g if d is not None), default=None)
        for d in g:
            want[(d, keep, len(g), d == keep)] += 1
    assert Counter(tuple(r) for r in exact_dedup(docs, filter_bits=1 << 16).collect()) == want
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_query_keeps_rows_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a  b"), (1, "a b"), (1, "c"), (1, "c"), (2, "d"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ["a b", "c", "d", ""]}
    want = [
        (None, 1, 2, False, digest["a b"]), (1, 1, 2, True, digest["a b"]), (1, 1, 2, True, digest["c"]), (1, 1, 2, True, digest["c"]),
        (2, 2, 1, True, digest["d"]), (None, None, 1, True, digest[""]),
    ]
    assert Counter(tuple(r) for r in q.op6_exact_dedup(spark, str(tmp_path)).collect()) == Counter(want)


def brute_components(rows, width: int, percent: int) -> dict:
    sets = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            sets[d] = frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("width", "percent", "hot"), [(4, 85, 32), (5, 80, 3)])
def test_jaccard_join(docs, width, percent, hot):
    want = brute_components(rows_of(docs), width, percent)
    got = near_duplicates(docs, width=width, percent=percent, hot_docs=hot, filter_bits=1 << 18).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_join_where_the_hot_filter_collides(spark, monkeypatch):
    monkeypatch.setattr("cuelake.llm.jaccard_join.HOT_BITS", 8)
    rng = random.Random(5)
    rows = []
    for i in range(150):
        text = [f"w{rng.randrange(10**9)}" for _ in range(6)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text, "often"]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=85, hot_docs=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d - d % 2 for d, _ in rows}


def test_jaccard_join_without_rows_or_links(spark, docs):
    assert near_duplicates(docs.limit(0), filter_bits=1 << 18).count() == 0
    alone = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(alone, filter_bits=1 << 18).select("doc_id", "n_shingles", "component_id").collect()} == {(1, 2, 1), (2, 0, 2)}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 103), (101, 103), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}


def test_context_trees_equal_brute_force():
    texts = pa.array(["abracadabra alakazam", "", "abc\0abc abra", None] * 3)
    symbols, starts = stream(texts)
    counts = counted(grams(symbols, 3))
    levels = levels_of(counts.index.to_numpy(), counts.to_numpy(), 3, 2)
    for blend in (ppm, smoothed):
        tables = [{} for _ in levels]
        for table, (contexts, seen, n) in zip(tables, levels, strict=True):
            for c, s, k in zip(contexts.tolist(), seen.tolist(), n.tolist(), strict=True):
                table.setdefault(c, {})[s] = k
        alphabet = sorted(set(levels[0][1].tolist()))

        def dist(ctx):
            below = np.array([[1 / 257] * len(alphabet) + [(257 - len(alphabet)) / 257]]) if ctx is None else dist(ctx[1:] if ctx else None)
            table = {} if ctx is None else tables[len(ctx)].get(int.from_bytes(bytes(ctx), "big"), {})
            return blend(np.array([[table.get(s, 0) for s in alphabet] + [0.0]]), below) if table else below

        want, history = [], (255,)
        for b in symbols.tolist():
            p = dist(history[-3:])[0]
            assert p.sum() == pytest.approx(1)
            want.append(math.log2(p[alphabet.index(b)] if b in alphabet else p[-1] / (257 - len(alphabet))))
            history = (255,) if b == 255 else (*history, b)
        tree = Automaton(levels, blend)
        assert tree.scores(symbols) == pytest.approx(np.array(want), abs=1e-5)
        assert tree.text_scores(symbols, starts) == pytest.approx([sum(want[a:b]) for a, b in zip(starts, [*starts[1:], len(want)], strict=True)], abs=1e-4)


def test_language_id(spark, docs):
    rows = {r["doc_id"]: r for r in q.op2_language_id(spark, DATA).collect()}
    truth = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    held = [rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in truth if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(held) / len(held) > 0.95
    got = identify(docs, train(docs)).collect()
    assert len(got) == docs.count()
    for r, t in ((r, dict(rows_of(docs)).get(r["doc_id"])) for r in got if r["doc_id"] is not None):
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or "")) and 0 <= r["score"] <= 1
    assert identify(docs.limit(0), train(docs)).count() == 0
    assert {r["lang_pred"] for r in identify(docs, train(docs.limit(0))).collect()} == {"und"}


def brute_levels(texts: list[bytes], depth: int, least: int) -> list[dict]:
    """Next-byte counts of the contexts of each depth that occur `least` times."""
    tables: list[dict] = [{} for _ in range(depth + 1)]
    for text in texts:
        whole = bytes([255]) + text.replace(b"\0", b"\xfe") + bytes([255])
        for i in range(1, len(whole)):
            for d in range(min(depth, i) + 1):
                tables[d].setdefault(whole[i - d : i], Counter())[whole[i]] += 1
    return [{c: n for c, n in table.items() if sum(n.values()) >= least} for table in tables]


def as_tables(levels) -> list[dict]:
    out = []
    for d, (contexts, symbols, counts) in enumerate(levels):
        table: dict = {}
        for c, b, n in zip(contexts.tolist(), symbols.tolist(), counts.tolist(), strict=True):
            table.setdefault(c.to_bytes(8, "big")[8 - d :], Counter())[b] += n
        out.append(table)
    return out


def test_language_trees_and_choice_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(v) for _ in range(rng.randrange(0, 30))), lang) for i, (lang, v) in enumerate([("x", ["ab", "Ba", "b\0c"]), ("y", ["ba", "cc", "éa"]), (None, ["zz"])] * 20)]
    rows += [(100, None, "x"), (101, "1 2", None), (102, "ab cc", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df, depth=3, least=2)
    assert list(model) == ["w", "x", "y"]
    for lang, levels in model.items():
        assert as_tables(levels) == brute_levels([t.lower().encode() for _, t, k in rows if k == lang and t is not None], 3, 2)
    same = model | {"v": model["y"]}  # a tie goes to the first by name
    trees = {k: Automaton(v, ppm) for k, v in same.items()}
    for r in identify(df, dict(sorted(same.items()))).collect():
        text = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        bits = {k: -float(t.text_scores(*stream(pa.array([(text or "").lower()])))[0]) for k, t in trees.items()}
        if re.search(r"[^\W\d_]", text or ""):
            best = min(sorted(bits), key=bits.get)
            assert r["lang_pred"] == best != "y" and r["code_bits"] == pytest.approx(bits[best])
            assert r["score"] == pytest.approx(1 / sum(2.0 ** (bits[best] - b) for b in bits.values()))
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0)


def test_quality_equals_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["good", "words", "here", "12", "BUY!!", "x" * 20]) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    marks = [(i, int("good" in texts[i].split()[:2])) for i in range(60)]
    got = {r["doc_id"]: r["score"] for r in quality_score(df, spark.createDataFrame(marks, "doc_id long, quality int").withColumn("_f", F.lit("x")), size=8, ridge=1e-3).collect()}
    x, y = features(pa.array(texts)).astype(np.float32).astype(np.float64), np.array([k for _, k in marks], float)
    kernel = Kernel(x[:60].mean(axis=0), x[:60].std(axis=0), 8, 1.0, 7)
    z = kernel(x)
    solved = lambda rows: np.linalg.solve(z[rows].T @ z[rows] + 1e-3 * len(rows) * np.eye(9), z[rows].T @ y[rows])
    raw, fold = z @ solved(np.arange(60)), np.array([r[0] for r in spark.range(60).select(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5))).collect()])
    apart = np.array([z[i] @ solved(np.flatnonzero(fold != fold[i])) for i in range(60)])
    bins = np.floor((np.clip(apart, -0.5, 1.5) + 0.5) * 2048)
    kinds = np.unique(bins)
    means, n, p = (np.array([f(bins == k) for k in kinds]) for f in (lambda m: apart[m].mean(), lambda m: m.sum(), lambda m: y[m].sum()))
    a, b = isotonic(means, n.astype(float), p)
    want = 0.999 * np.interp(raw, a, b) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1)
    assert [got[i] for i in range(80)] == pytest.approx(want.tolist(), abs=1e-5)


def test_quality_of_labels_held_out(spark):
    rows = {r["doc_id"]: r for r in q.op3_quality(spark, DATA).collect()}
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["doc_id"] in rows and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = ([s for s, k in held if k == one] for one in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9


def test_suffix_tree_equals_brute_force(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 80))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(3)
    plain = [re.sub(" +", " ", t).strip().encode() for t in texts]
    total = sum(len(t) + 1 for t in plain)
    got = as_tables(learn_tree(df, 3, 0.004, 1.5))
    tables = brute_levels(plain, 3, max(2, math.ceil(0.004 * total)))
    want = [tables[0]]
    for d in (1, 2, 3):
        keep = {}
        for c, n in tables[d].items():
            above = tables[d - 1][c[1:]]
            gain = sum(k * math.log((k / sum(n.values())) / (above[b] / sum(above.values()))) for b, k in n.items())
            if gain >= 1.5:
                keep[c] = n
        want.append(keep)
    assert got == want and all(want) and len(want[3]) < len(tables[3])


def test_queries_of_the_edge_fixture(spark, tmp_path, docs):
    """op5, op7, op8 and op9 as registered, on rows with nulls, ties and clashing columns."""
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    texts, by_id = dict(rows_of(rows)), lambda df: {r["doc_id"]: r for r in df.collect()}
    components_ = brute_components(list(texts.items()), 4, 85)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in by_id(q.op5_jaccard_join(spark, str(tmp_path))).items()} == components_
    pii = by_id(q.op8_pii(spark, str(tmp_path)))
    assert {d: r["base_sha256"] for d, r in pii.items()} == {d: hashlib.sha256(base_spans(t).encode()).hexdigest() for d, t in texts.items()}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = Bpe(f.read(), public_tokenizers.PATTERN).ranks
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {d: np.array(encoding.encode_ordinary(t or ""), "<u4") for d, t in texts.items()}
    bpe = {d: tuple(r)[1:] for d, r in by_id(q.op9_bpe(spark, str(tmp_path))).items()}
    assert bpe == {d: (len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((texts[d] or "").encode()).hexdigest()) for d, x in ids.items()}
    scores, c = by_id(q.op7_lm_score(spark, str(tmp_path))), Counter()
    learned = lambda d: zlib.crc32(str(d).encode()) % 5 != 1
    for d, t in texts.items():
        if learned(d):
            c.update([*words(t), None])
    for d, t in texts.items():
        tokens = [*words(t), None]
        base = sum(math.log10((c[w] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1))) for w in tokens)
        assert (scores[d]["held_out"], scores[d]["n_tokens"], scores[d]["n_known"], scores[d]["train_tokens"]) == (not learned(d), len(tokens), sum(c[w] > 0 for w in tokens), sum(c.values()))
        assert scores[d]["base_score"] == pytest.approx(base) and scores[d]["score"] < 0


def test_near_copies_meet_in_few_pairs(spark, monkeypatch):
    """Pairs that are compared grow with a group of near copies, not with its square."""
    from cuelake.llm.jaccard_join import Join

    seen = []
    links = Join.links
    monkeypatch.setattr(Join, "links", lambda self, pairs, parts=None: (seen.append(pairs.count()), links(self, pairs, parts))[1])
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(400):
        other = list(base)
        for _ in range(rng.randrange(1, 5)):
            other[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((i, " ".join(other)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 4, 85)
    assert sum(seen) < 10 * len(rows)


def test_bpe_of_very_long_pieces():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        bpe = Bpe(f.read(), public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("a", 5000), ("-=", 700), ("é漢", 400), (" ", 900), ("aeiouthnsr", 60))] * 2
    ids, counts = bpe.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == encoding.encode_ordinary(t)


def test_quality(spark, docs):
    rows = {r["doc_id"]: r for r in q.op3_quality(spark, DATA).collect()}
    labels = [(rows[r["doc_id"]]["score"], r["quality"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["doc_id"] in rows]
    good, bad = ([s for s, y in labels if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = quality_score(docs, marks, size=16).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_score(docs, marks.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality_score(docs, marks.where("quality = 1")).collect()} == {1.0}
    assert quality_score(docs.limit(0), marks).count() == 0


def test_isotonic():
    x, y = isotonic(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1.0]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3.5]


def test_rans_round_trip():
    rng = np.random.default_rng(0)
    for n, lanes in ((0, 1), (1, 1), (1000, 4), (5000, 64)):
        ids = np.minimum(rng.geometric(0.01, n), 700)
        table = Table(*np.unique(np.append(ids, 3), return_counts=True))
        words_, states, marks, crcs = table.encode(ids, lanes, 16)
        step, out = lanes * 16, []
        for i in reversed(range(len(crcs))):  # parts decode apart and in any order
            out.insert(0, table.decode(min(step, n - i * step), lanes, words_[4 * marks[i] :], states[8 * i * lanes : 8 * (i + 1) * lanes], crcs[i]))
        assert np.concatenate([*out, np.zeros(0)]).tolist() == ids.tolist()
    with pytest.raises(ValueError, match="checksum"):
        table.decode(min(step, n), lanes, words_[4 * marks[0] :], states[: 8 * lanes], crcs[0] ^ 1)


def test_token_output(spark, docs):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        raw = f.read()
    path = token_folder(spark)
    write_tokens(docs, path, raw, end=2, shard_ids=20_000)
    tokenizer, at = Tokenizer.from_str(raw), 0
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows_of(docs)), key=lambda d: (d is not None, d or 0))
    texts = {d: t for d, t in rows_of(docs) if d is not None}
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids
    path = token_folder(spark)
    write_tokens(docs.limit(0), path, raw, end=2)
    assert read_tokens(spark, path).count() == 0


def test_token_output_query(spark, tmp_path, docs):
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: tuple(r)[1:] for r in q.op4_token_output(spark, str(tmp_path)).collect()}
    for d, t in sorted(rows_of(rows)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pieces_are_used_only_where_the_tokenizer_merges_words():
    texts = ["It's  A Test.", "a b", "Ünï 12 ab cd. ab", None, "x" * 50, "<|endoftext|> It's"]
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            raw = f.read()
        tokenizer, pieces = Tokenizer.from_str(raw), PieceIds(raw, most=4)
        assert pieces.by_words == by_words
        for _ in range(3):  # pieces are dropped and made again
            ids, counts = pieces.encode(pa.array(texts), 2)
            assert ids.tolist() == [i for t in texts for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]
            assert counts.sum() == len(ids)


def test_lm_score(docs):
    train_on = F.col("doc_id") % 3 > 0
    c = Counter()
    for d, t in rows_of(docs):
        if d is not None and d % 3 > 0:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    texts = {d: t for d, t in rows_of(docs) if d is not None}
    got = lm_score(docs, train_on).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            tokens = [*words(texts[r["doc_id"]]), None]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
            assert r["score"] < 0
    assert lm_score(docs.limit(0), train_on).count() == 0
    assert {r["base_score"] for r in lm_score(docs, F.lit(False)).collect()} == {0.0}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(int(c) for c in reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> str:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_pii_base(spark, docs):
    edge = ["x@y.com_z@w.org a@b.c.d", "a@b..c é@é.f é😀 q@r.st", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111-", "4111-1111-1111-1111 4111  1111", "+1 (555) 123-4567. +12"]
    edge += ["+1+15551234567", "@a.b", "4" * 30, "9 " * 3000 + "x", "a." * 5000 + "@b.c", "4111111111111111@b.com 10.0.0.1@x.yz", None, ""]
    df = docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    df = df.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(edge)], "doc_id long, text string"))
    texts = dict(rows_of(df))
    got = sanitise(df).collect()
    assert len(got) == df.count()
    assert {r["doc_id"]: r["base"] for r in got} == {d: base_spans(t) for d, t in texts.items()}
    assert sanitise(docs).count() == docs.count() and sanitise(docs.limit(0)).count() == 0


def test_pii_terms(spark):
    rows = [(i, f"Ask quillmark about it at q.mark@firm.example, entry {i}") for i in range(5)] + [(i, f"ask somebody about entry {i} or call") for i in range(10, 60)]
    got = {r["doc_id"]: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(5):
        assert got[i]["spans"] == "term:4:13,email:26:45"
        assert got[i]["sanitised"] == f"Ask [term] about it at [email], entry {i}"
    assert all(got[i]["spans"] == "" and got[i]["sanitised"] == f"ask somebody about entry {i} or call" for i in range(10, 60))


def test_pii_terms_of_whole_documents(spark):
    far = "plain words that say little " * 20
    rows = [(i, f"Quillmark wrote. {far} to q.mark@firm.example; QUILLMARK again, no {i}") for i in range(5)]
    rows += [(5, f"nothing but quillmark, {far}"), (6, f"x{far} abc+1 555 123 4567"), (7, None), (0, rows[0][1])] + [(i, f"{far} other wrote again {i}") for i in range(10, 100)]
    got = sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer("quillmark", text, re.I)]
        assert [x for x in r["spans"].split(",") if x.startswith("term")] == terms
        assert r["sanitised"].lower().count("[term]") == len(terms) and "quillmark" not in r["sanitised"].lower()


@pytest.mark.parametrize("alpha", [0.9, 0.5])
def test_pii_terms_equal_brute_force(spark, docs, alpha):
    df = docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    mail = [(2000 + i, f"user{i % 7}@host.example +1 (555) 123-456{i % 3} wren{i % 7}+1 555 987 6543, Finch{i % 7}_ {'and so on ' * 30} lark{i % 5} x@y.com_z") for i in range(40)]
    df = df.unionByName(spark.createDataFrame(mail, "doc_id long, text string"))
    texts, got = dict(rows_of(df)), {r["doc_id"]: r["spans"] for r in sanitise(df, alpha=alpha, with_text=False).collect()}
    shown, held, free = {}, {}, {}
    for d, t in texts.items():
        spans = [x.split(":") for x in base_spans(t).split(",") if x]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        shown[d] = {(k, (t or "")[a:b].lower()) for k, a, b in spans}
        found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\w{3,}", t or "")]
        free[d] = [w for w in found if not any(a < w[1] and w[0] < b for _, a, b in spans)]
        held[d] = {w for _, _, w in free[d]}
    n_entity, n_term, n_both = Counter(e for x in shown.values() for e in x), Counter(w for x in held.values() for w in x), Counter()
    for d in texts:
        n_both.update((e, w) for e in shown[d] if n_entity[e] >= 3 for w in held[d])
    p = {e: n / len(texts) for e, n in n_entity.items()}
    terms = {w for (e, w), n in n_both.items() if n >= 3 and math.log(n / n_term[w] / p[e]) >= -alpha * math.log(p[e]) - 1e-12}
    assert len(terms) > 5
    assert {d: [x for x in s.split(",") if x.startswith("term")] for d, s in got.items()} == {d: [f"term:{a}:{b}" for a, b, w in free[d] if w in terms] for d in texts}


def test_bpe(docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        raw = f.read()
    ranks = Bpe(raw, public_tokenizers.PATTERN).ranks
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {d: t for d, t in rows_of(docs) if d is not None}
    got = bpe_encode(docs, raw, public_tokenizers.PATTERN, decode=True).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["n_tokens"] == len(ids)
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]] or ""
            assert ids == encoding.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert bpe_encode(docs.limit(0), raw, public_tokenizers.PATTERN).count() == 0


def test_decontamination(spark, docs):
    texts = [(d, t) for d, t in rows_of(docs)]
    long = next(t for _, t in texts if t and len(t) > 50_000).split()
    items = [(1, " ".join(long[20_000:20_040])), (2, "no such words are here at all"), (3, None), (4, "a b"), (5, " ".join(long[:30] + ["zz"] * 3)), (5, " ".join(long[:30] + ["zz"] * 60)), (None, "q r s t u v")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams_ = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    want = Counter()
    for d, t in texts:
        for i, x in items:
            if (g := grams_(x)) and 100 * len(g & grams_(t)) >= 80 * len(g):
                want[(d, i, len(g), len(g & grams_(t)))] += 1
    for block in (1, 1 << 20):
        assert Counter(tuple(r)[:4] for r in contained_items(docs, bench, block_chars=block).collect()) == want
    assert {i for _, i, _, _ in want} == {1, 5}
    assert contained_items(docs.limit(0), bench).count() == 0 and contained_items(docs, bench.limit(0)).count() == 0


def test_shingles_are_alike_exactly_when_words_are():
    texts = pa.array(["A b c d", "a B\tc d", "a b c", "ab c d", None, "x", "b a c d"])
    hashes, lengths = shingles(words_of(texts), 4, short=True)
    assert lengths.tolist() == [1, 1, 1, 1, 0, 1, 1]
    assert hashes[0] == hashes[1] and len(set(hashes.tolist())) == 5


def test_pipeline(spark, tmp_path, docs):
    """With rows that repeat, which stay or go together, null ids, which only the first stage drops, and clashing columns."""
    import corpus_pipeline

    items = [(1, next(t for _, t in rows_of(docs) if t and len(t) > 50_000)[1000:1300])]
    docs.withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    all_rows = [(d, t) for d, t in rows_of(docs) if re.search(r"[^\W\d_]", t or "")]
    left = {d: t for d, t in all_rows if d is not None}
    first: dict[str, int] = {}
    for d in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[d]), d)
    left = {d: left[d] for d in first.values()}
    components_ = brute_components(list(left.items()), 5, 80)
    left = {d: t for d, t in left.items() if components_[d][1] == d}
    grams_ = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    held = grams_(items[0][1])
    left = {d: t for d, t in left.items() if len(held & grams_(t)) < 0.8 * len(held)}
    want = Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in all_rows if d in left or d is None)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got.collect()) == want
    assert len(left) < len(all_rows) and sum(d is None for d, _ in want) == 2 and max(want.values()) == 2
    stage = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, str(tmp_path))
        assert set(stage.columns) == set(docs.columns)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
