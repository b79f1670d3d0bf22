"""The conversation trie, the licence scan and the centroid clustering against brute force and in edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.llm import ball_tree, license_scan as scan, prefix_trie
from cuelake.llm.ball_tree import Tree, assigned, clustered, nearest
from cuelake.llm.license_scan import Scanner, license_scan
from cuelake.llm.license_texts import PHRASES, TEMPLATES
from cuelake.llm.prefix_trie import conversation_trie

CLASH = {"node": "x", "depth": "x", "next": "x", "rep": "x", "n": "x", "block": "x", "key": "x", "labels": "x", "score": "x", "cluster": "x", "v": "x"}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def brute_trie(rows) -> list[tuple]:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turn = (role or "", text or "")
            digest = hashlib.sha256(f"{len(turn[0].encode())}:{turn[0]}{turn[1]}".encode()).digest()
            own[c].append(((t is not None, t or 0), digest, turn))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h, head = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(head, [])[:h] + v[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        n = len(members[path])
        leaves[path] = sum(leaves[x] for x in kids[path]) or 1
        saved[path] = (n - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[x] for x in kids[path])
        ends = ",".join(str(c) for c in sorted(members[path]) if len(built[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), up, n, len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def turns(spark):
    """Nulls in any column, ties, repeated rows, conversations without a head, with few and with very many turns, copies."""
    rng = random.Random(1)
    rows = []
    for c in [*range(-12, 60), None]:
        for t in range(rng.randrange(0, 6)):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["u", "a", None]), rng.choice(["x", "y", "", None, "é"])))
    for c in (200, 201, 205, 206, 210):
        rows += [(c, t, "u", f"w{t}" if t < 75 or c < 205 else f"z{t}{c}") for t in range(90)]
    rows += [(c, 0, "u", "the same") for c in range(300, 400)] + rows[5:9]
    return clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))


def given(turns) -> list[tuple]:
    return [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]


@pytest.mark.parametrize(("block", "chunk"), [(64, 1024), (3, 7)])
def test_trie_equals_brute_force(turns, monkeypatch, block, chunk):
    if block != 64:  # blocks and chunks end within the fixture's conversations
        turns = turns.where("conv_id < 200 OR conv_id >= 300 OR turn < 10")
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    assert Counter(map(tuple, conversation_trie(turns).collect())) == Counter(brute_trie(given(turns)))


def test_trie_of_one_conversation_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 50)
    rows = [(5, t // 3, "u", str(t % 7)) for t in range(600)] + [(6, t, "u", "a") for t in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert Counter(map(tuple, conversation_trie(turns).collect())) == Counter(brute_trie(rows))


def test_trie_without_turns_or_rows(spark, turns):
    assert conversation_trie(turns.limit(0)).count() == 0
    short = [(c, 0, "u", "a") for c in range(6, 10)]  # no head, so those with h > 0 have no turns
    frame = spark.createDataFrame(short, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, conversation_trie(frame).collect())) == Counter(brute_trie(short))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base_of(text: str | None) -> tuple:
    w = words(text)
    hits = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


@pytest.fixture(scope="module")
def notices() -> list[str | None]:
    rng = random.Random(0)
    some = ["the", "MIT", "license", "License,", "apache", "general", "public", "of", "software", "GNU", "é", "x", "under", "is", "to", "and", ""]
    mix = lambda n: " ".join(rng.choice(some) for _ in range(n))
    texts = [None, "", " \n", "mit license", "MIT\x00LICENSE", "mitlicense", "mit é license"] + [mix(rng.randrange(0, 60)) for _ in range(200)]
    for _ in range(40):
        told = [x if rng.random() > 0.05 else rng.choice(some) for x in rng.choice(TEMPLATES)[1].split() if rng.random() > 0.05]
        texts.append(f"{mix(20)} {' '.join(told)} {mix(9)}")
    return texts + [mix(4000), " ".join(t for _, t in TEMPLATES * 3)]


@pytest.fixture(scope="module")
def scanner() -> Scanner:
    return Scanner(tuple(TEMPLATES), tuple(PHRASES), 4, 12, 0.6)


def test_matching_statistics_equal_brute_force(scanner, notices):
    parts = {tuple(w[i:j]) for t, _ in [(x, 0) for _, x in TEMPLATES] + [(p, 0) for p, _ in PHRASES] for w in [words(t)] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    want = []
    for t in notices:
        w, m = words(t), 0
        for i in range(len(w)):
            m += 1
            while m and tuple(w[i - m + 1 : i + 1]) not in parts:
                m -= 1
            want.append(m)
    ids, counts = scanner.ids(pa.array(notices))
    assert scanner.automaton.matched(ids, counts)[1].tolist() == want


def test_phrases_and_templates(spark, scanner, notices):
    docs = clashing(spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(notices)], "doc_id long, text string").repartition(3))
    out = license_scan(docs)
    want = Counter((i if i % 50 else None, *base_of(t)) for i, t in enumerate(notices))
    assert Counter(tuple(r) for r in out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == want
    assert license_scan(docs.limit(0)).count() == 0
    full = scanner.scan(pa.array([f"one two {t} three" for _, t in TEMPLATES]))
    for (label, text), row in zip(TEMPLATES, full, strict=True):
        assert row[7] == f"{label}:2:{len(words(text)) + 1}:{len(words(text))}" and label in row[5].split(",") and row[6] == 1.0
    half = scanner.scan(pa.array([" ".join(t.split()[: len(t.split()) // 3]) for _, t in TEMPLATES if len(t.split()) > 60]))
    assert all(r[5] == r[4] for r in half)  # a third of a template is none


def test_changed_notices_are_found(scanner):
    rng = random.Random(4)
    for label, text in TEMPLATES:
        if len(text.split()) > 60:
            changed = [w for w in text.split() if rng.random() > 0.03]
            assert label.split("-")[0] in scanner.scan(pa.array([" ".join(changed)]))[0][5]


def test_long_texts_are_read_in_pieces(scanner, monkeypatch):
    monkeypatch.setattr(scan, "PIECE", 1 << 10)
    text = "MIT License " + "a bé, The Software\n" * 3000 + "x" * 5000 + " Zażółć general public license"
    assert scanner.scan(pa.array([text]))[0][:5] == base_of(text)


def brute_clusters(rows, k: int = 16, rounds: int = 3) -> list[tuple]:
    kept = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]
    near = lambda v: min((int(((v - np.array(x)) ** 2).sum()), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[int(x) // len(own[j]) for x in np.sum(own[j], axis=0)] if own[j] else x for j, x in enumerate(c)]
    at = [(i, near(v)) for i, v in kept]
    inertia = Counter()
    for _, (d, j) in at:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in at]


def test_clusters_equal_brute_force(spark, monkeypatch):
    """Nulls, other lengths, non-finite components, copies, ties, repeated and null ids, clusters that lie close and far."""
    monkeypatch.setattr(ball_tree, "ROWS", 100)
    monkeypatch.setattr(ball_tree, "LEAF", 4)
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(9, 64)) * 3
    rows = [(i, (middles[i % 9] + rng.normal(size=64) * rng.choice([0.01, 0.3])).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(120)] + [rows[7], (None, rows[8][1]), (None, None), (7000, None)]
    rows += [(7001, [0.5] * 63), (7002, [0.5] * 65), (7003, [float("nan")] * 64), (7004, [float("inf")] + [0.0] * 63), (7005, [None] + [0.0] * 63), (7006, [-0.0] * 64)]
    rows += [(8000 + i, [float(i % 2)] * 32 + [float((i + 1) % 2)] * 32) for i in range(40)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    assert Counter(map(tuple, clustered(frame).collect())) == Counter(brute_clusters(rows))
    assert clustered(frame.limit(0)).count() == 0
    few = frame.where("vec_id < 5")
    assert Counter(map(tuple, clustered(few).collect())) == Counter(brute_clusters([r for r in rows if r[0] is not None and r[0] < 5]))


def test_whole_balls_are_assigned_without_a_look_at_their_rows():
    rng = np.random.default_rng(2)
    middles = rng.integers(-4000, 4000, size=(16, 64))
    v = middles[rng.integers(0, 16, 5000)] + rng.integers(-20, 20, size=(5000, 64))
    tree = Tree(v)
    ordered = v[tree.order]
    balls, ball_of, rows, row_of = assigned(ordered, tree.centres, tree.radii, tree.bounds, tree.childs, middles)
    got = np.full(5000, -1)
    for (a, b), c in zip(tree.bounds[balls], ball_of, strict=True):
        assert (got[a:b] == -1).all() and (tree.sums[balls] is not None)
        got[a:b] = c
    got[rows] = row_of
    assert (got == nearest(ordered, middles, np.ones((5000, 16), bool))[0]).all()
    assert len(rows) < 500


def test_grams_leave_a_task_in_small_batches():
    """All places are counted, however often the counts are merged, and no batch has more than `rows` grams."""
    from collections import Counter

    import pyarrow as pa

    from cuelake.llm import suffix_tree
    from cuelake.llm.contexts import grams, stream

    texts = pa.array([None, "", *("".join(chr(97 + i * k % 23) for i in range(200)) for k in range(60))])
    batches = [pa.RecordBatch.from_arrays([texts.slice(a, 10)], ["_text"]) for a in range(0, len(texts), 10)]
    got, sizes = Counter(), []
    for batch in suffix_tree._count(4, most=500, rows=64)(iter(batches)):
        sizes.append(batch.num_rows)
        for gram, n in zip(batch["gram"].to_pylist(), batch["n"].to_pylist(), strict=True):
            got[gram] += n
    assert max(sizes) == 64
    assert got == Counter(grams(stream(suffix_tree.plain(texts))[0], 4).view(np.int64).tolist())


def test_bpe_in_many_parts_and_little_memory(monkeypatch):
    """Pieces and ids go to DuckDB in parts, whose limit of memory is small, with the results of one part."""
    import public_tokenizers

    from cuelake.llm import bpe as module

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        bpe = module.Bpe(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh\u00e9\u4e2d") for _ in range(rng.randint(1, 16)))
    texts = pa.array([None, "", *(" ".join(word() for _ in range(rng.randint(1, 400))) for _ in range(60))])
    limit = lambda: bpe.db.sql("SELECT value FROM duckdb_settings() WHERE name = 'memory_limit'").fetchall()[0][0]
    ids, counts = bpe.encode(texts)
    assert limit().endswith("MiB") and float(limit().split()[0]) < 150
    whole = [(t or "").encode() for t in texts.to_pylist()]
    assert bpe.decode(ids, counts) == whole
    monkeypatch.setattr(module, "ROWS", 3000), monkeypatch.setattr(module, "IDS", 700)
    bpe.clear()
    again, sizes = bpe.encode(texts)
    assert again.tolist() == ids.tolist() and sizes.tolist() == counts.tolist()
    assert bpe.decode(ids, counts) == whole
    assert bpe.decode(ids[:0], counts[:0]) == []


def test_pieces_are_looked_up_once():
    """Known and new pieces of one batch, each looked for once, are those that each has alone."""
    import public_tokenizers

    from cuelake.llm.token_output import PieceIds

    class Counted(dict):
        asked = 0

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def get(self, key, *default):
            Counted.asked += 1
            return super().get(key, *default)

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        pieces = PieceIds(f.read())
    pieces.place = Counted()
    alone = lambda x: pieces.tokenizer.encode(x, add_special_tokens=False).ids
    for words in (["house", "a1-b", "\u00e9t\u00e9"], ["tree", "house", "x.y", "a1-b", "zebra"]):
        Counted.asked = 0
        at = pieces._places(words)
        assert Counted.asked == len(words)
        assert [pieces.flat[a : a + n].tolist() for a, n in zip(pieces.starts[at], pieces.lengths[at], strict=True)] == [alone(w) for w in words]
