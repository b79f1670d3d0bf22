"""Worked examples and properties of single operators."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake import streaming
from cuelake.functions import text as tx
from cuelake.jobs import shot_queries
from cuelake.operators import cues, faces, shots, tags, transcript, vectors

EVENTS = "ep string, ord long, start double, end double, text string"


def test_visible_text_equals_the_double_loop(spark):
    rng = random.Random(1)
    rows = [(f"e{rng.randrange(3)}", i, s := float(rng.randrange(60)), s + rng.randrange(0, 9), rng.choice("abc")) for i in range(120)]
    df = spark.createDataFrame(rows, EVENTS)
    want = set()
    for ep, _, s, e, _ in rows:
        mid = (s + e) / 2
        seen = [t for p, _, a, b, t in rows if p == ep and a <= mid < b]
        if seen:
            want.add((ep, s, e, "\n".join(dict.fromkeys(seen))))
    for bucket in (5.0, 1e6):
        assert {tuple(r) for r in cues.visible_text(df, bucket).collect()} == want
    assert cues.visible_text(df.limit(0)).count() == 0


def test_same_span_twice_is_one_cue(spark):
    df = spark.createDataFrame([("e", 1, 1.0, 2.0, "a"), ("e", 2, 1.0, 2.0, "a")], EVENTS)
    assert [r["text"] for r in cues.visible_text(df).collect()] == ["a"]


def test_ends(spark):
    df = spark.createDataFrame([("e", 1, 1201.28, 1185.2, "x"), ("e", 2, 1210.0, None, "y"), ("e", 3, 1202.0, 1203.0, "z")], EVENTS)
    got = {r["ord"]: r["end"] for r in cues.repaired_ends(df).collect()}
    assert got == {1: 1202.0, 2: 1213.0, 3: 1203.0}
    past = spark.createDataFrame([("e", 1, 99.95, 100.5, "x"), ("e", 2, 99.0, 101.0, "y")], EVENTS)
    assert [(r["ord"], r["end"]) for r in cues.trimmed(past, 100.0).collect()] == [(2, 99.9)]


def test_short_cue_takes_its_midpoint(spark):
    df = spark.createDataFrame([("e", 1, 1.0, 1.15, "x")], EVENTS)
    frames = spark.createDataFrame([("e", 1.1, 9.0)], "ep string, t double, sharpness double")
    assert cues.sharpest_times(df, frames, 0.4).first()["frame_time"] == pytest.approx(1.075)


def test_clock_halves_go_to_even(spark):
    df = spark.createDataFrame([(0.0005,), (0.0015,), (3725.25,)], "s double")
    assert [r[0] for r in df.select(tx.clock_dashes(F.col("s"))).collect()] == ["00-00-00.000", "00-00-00.002", "01-02-05.250"]
    assert [r[0] for r in df.select(tx.clock_units(F.col("s"))).collect()] == ["0s", "0s", "1h02m"]


@pytest.mark.parametrize(
    ("read", "meant"),
    [("198Qs", "1980s"), ("1@", "10"), ("10,0@@", "10,000"), ("6-Q", "6-0"), ("a | b", "a I b"), ("-Wwhat", "-What"), ('"Ves', "-Yes"), ("so, It is", "so, it is"), ("Q and A", "Q and A")],
)
def test_ocr(spark, read, meant):
    assert spark.createDataFrame([(read,)], "t string").select(tx.ocr_repaired(F.col("t"))).first()[0] == meant


@pytest.mark.parametrize("job", ["cue_lines", "visible_text"])
def test_cues_are_shuffled_once_a_side(spark, job):
    """Spans are told apart, joined and gathered where their episode and bucket were dealt to; what was found is not shuffled again."""
    df = spark.createDataFrame([("e", i, float(i), i + 2.0, "t", ["a"]) for i in range(9)], EVENTS + ", lines array<string>").hint("merge")
    out = getattr(cues, job)(df, 4.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan and out.count() == 9


def test_tidy_runs(spark):
    runs = [("a ", "W"), ("", "W"), ("b", "W"), (" c", "Y")]
    df = spark.createDataFrame([(runs,)], "r array<struct<text:string,colour:string>>")
    assert [tuple(x) for x in df.select(tx.tidy_runs(F.col("r"))).first()[0]] == [("a b", "W"), (" c", "Y")]


def test_tidy_runs_of_a_long_line(spark):
    """Thousands of runs in two colours, some empty, some without a colour (which are never merged), against a plain loop; what a line costs follows its length."""
    rng = random.Random(5)
    rows = [[(rng.choice(["a ", " b", "", " ", "c  d"]), rng.choice(["W", "W", "Y", None])) for _ in range(n)] for n in (0, 1, 2, 7, 3000)]

    def plain(runs):
        out = []
        for t, c in ((re.sub(r"\s+", " ", t), c) for t, c in runs):
            if t and out and c is not None and out[-1][1] == c:
                out[-1] = (re.sub(r"\s+", " ", out[-1][0] + t), c)
            elif t:
                out.append((t, c))
        ends = [(t.strip(" ") if len(out) == 1 else t.lstrip(" ") if i == 0 else t.rstrip(" ") if i == len(out) - 1 else t, c) for i, (t, c) in enumerate(out)]
        return [x for x in ends if x[0]]

    df = spark.createDataFrame(list(enumerate([*rows, None])), "k int, r array<struct<text:string,colour:string>>").coalesce(1)
    began = time.time()
    got = {r["k"]: r["t"] for r in df.select("k", tx.tidy_runs(F.col("r")).alias("t")).collect()}
    assert [[tuple(x) for x in got[k]] for k in range(len(rows))] == [plain(r) for r in rows] and got[len(rows)] is None
    assert time.time() - began < 30


def test_chunks(spark):
    long, clauses = "word " * 40, "one clause that is some thirty, " * 4
    df = spark.createDataFrame([("One. Two? Three.",), (long,), (clauses,), ("",), (None,), ("x" * 100 + " y",)], "t string")
    got = [r["p"] for r in df.select("t", transcript.chunks(F.col("t")).alias("p")).collect()]
    assert got[0] == ["One. Two?", "Three."]
    assert [len(x) for x in got[1]] == [44, 44, 44, 64] and " ".join(got[1]).split() == long.split()
    assert got[2] == ["one clause that is some thirty, one clause that is some thirty,"] * 2
    assert got[3:] == [[], None, ["x" * 100, "y"]]


def test_spoken_lines(spark):
    text = ["(He", "walks in)", "ANN: Hello (waves) there.", "", "still Ann", "(door) BOB: Hi", "2. Scene", "C"]
    df = spark.createDataFrame([("e", i, t) for i, t in enumerate(text)], "ep string, ord long, line string")
    assert [(r["speaker"], r["text"]) for r in transcript.spoken_lines(df, r"^[0-9]+\.\s").orderBy("ord").collect()] == [("ANN", "Hello there."), ("ANN", "still Ann"), ("BOB", "Hi"), ("BOB", "C")]


def test_filled_gaps_equal_a_loop(spark):
    rng = random.Random(4)
    lines = [("e", i, rng.randrange(5, 90), *((20.0 * i, 20.0 * i + 2) if rng.random() < 0.3 else (None, None))) for i in range(40)]
    got = {r["ord"]: (r["start"], r["end"]) for r in transcript.filled_gaps(spark.createDataFrame(lines, "ep string, ord long, size long, start double, end double")).collect()}
    i = 0
    while i < len(lines):
        if lines[i][3] is not None:
            assert got[i] == lines[i][3:]
            i += 1
            continue
        j = i
        while j < len(lines) and lines[j][3] is None:
            j += 1
        lo = lines[i - 1][4] if i else 0.0
        hi = lines[j][3] - 0.04 if j < len(lines) else lo + 3 * (j - i)
        want = [min(max(0.7 + 0.065 * x[2], 1), 5) for x in lines[i:j]]
        scale = min(1, (hi - lo) / sum(want))
        at = hi - sum(want) * scale
        for k, w in zip(range(i, j), want, strict=True):
            assert got[k] == (pytest.approx(at), pytest.approx(at + w * scale))
            at += w * scale
        i = j


def test_alignment(spark):
    a = spark.createDataFrame([("e", i, w) for i, w in enumerate("the cat sat on a mat".split())], "ep string, i long, key string")
    b = spark.createDataFrame([("e", i, w) for i, w in enumerate("so the cat sat down on mat".split())], "ep string, j long, key string")
    assert sorted((r["i"], r["j"]) for r in transcript.aligned(a, b).collect()) == [(0, 1), (1, 2), (2, 3), (3, 5), (5, 6)]


def test_carry_over_is_strict(spark):
    gone = spark.createDataFrame([("d", "old", 10.0, 3, 7)], "dir string, path string, start double, post_count long, last_posted long")
    here = spark.createDataFrame([("d", "a", 10.04), ("d", "b", 10.06)], "dir string, path string, start double")
    assert [(r["path"], r["post_count"]) for r in shots.carried_over(gone, here).collect()] == [("a", 3)]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "path long, title string, post_count long")
    new = spark.createDataFrame([(2, "c"), (3, None)], "path long, title string")
    once = shots.upserted(old, new, "path", ["title"], ["post_count"])
    assert {(r["path"], r["title"], r["post_count"], r["change"]) for r in once.collect()} == {(1, "a", 5, "same"), (2, "c", 6, "updated"), (3, None, None, "inserted")}
    assert {r["change"] for r in shots.upserted(once.drop("change"), new, "path", ["title"], ["post_count"]).collect()} == {"same"}


def test_episode_fields(spark):
    df = spark.createDataFrame([("P/Series 01/14-20 - X/c.jpg",), ("P/Series 2/Special/c.jpg",)], "path string")
    assert [(r["series"], r["episode"], r["title"]) for r in shots.episode_fields(df).collect()] == [("Series 1", 14, "X"), ("Series 2", None, "Special")]


def test_bulk_scores_equal_column_functions(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.standard_normal(8)]) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, embedding array<float>")
    coef = [float(v) for v in rng.standard_normal(8)]
    bulk = {r["k"]: r["prob"] for r in vectors.scores(df, {"t": (coef, 0.3)}, "k").collect()}
    for r in df.select("k", vectors.logistic(vectors.dot(F.col("embedding"), vectors.vector(coef)) + 0.3).alias("p")).collect():
        assert bulk[r["k"]] == pytest.approx(r["p"])
    assert vectors.scores(df.limit(0), {"t": (coef, 0.3)}, "k").count() == 0


def test_planted_groups_are_found(spark):
    rng = np.random.default_rng(2)
    centres = [c / np.linalg.norm(c) for c in rng.standard_normal((3, 16))]
    rows = []
    for ep in range(4):
        for g, c in enumerate(centres):
            for _ in range(8):
                v = c + 0.03 * rng.standard_normal(16)
                rows.append((len(rows), ep, g, [float(x) for x in v / np.linalg.norm(v)]))
    df = spark.createDataFrame(rows, "id long, episode long, truth long, embedding array<float>")
    found = {r["id"]: r["cluster"] for r in faces.grouped(df.drop("truth"), within=5, across=3, least=5).collect()}
    pairs = {(truth, found[i]) for i, _, truth, _ in rows if i in found}
    assert len(found) > 0.9 * len(rows) and len(pairs) == 3


def test_too_few_marks_train_nothing(spark):
    marks = spark.createDataFrame([(i, 1) for i in range(4)], "path long, label int")
    assert tags.train(marks, marks.select("path").limit(0), marks.select("path")) is None


def test_empty_name_keeps_not_person(spark):
    f = spark.createDataFrame([(1, 2), (2, 2)], "id long, cluster int")
    marks = spark.createDataFrame([(1, "x", None), (2, None, "")], "face_id long, person string, not_person string")
    assert {(r["face_id"], r["not_person"]) for r in faces.named_marks(f, marks, 2, " ").collect()} == {(2, "")}


def test_streams_drain_to_files(spark, tmp_path):
    rows = spark.createDataFrame([("u", 0), ("u", 60), ("u", 9000), ("v", 30)], "user string, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(f"{tmp_path}/events")
    source = lambda folder: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{folder}")
    got = streaming.drained(streaming.sessions(source("events"), "1 hour", "user"), "drain_test")
    assert {(r["user"], r["n"]) for r in got.collect()} == {("u", 2), ("u", 1), ("v", 1)}
    assert got.inputFiles() and not spark.catalog.tableExists("drain_test")
    rows.limit(0).write.parquet(f"{tmp_path}/none")
    assert streaming.drained(streaming.sessions(source("none"), "1 hour", "user"), "drain_none").count() == 0


def test_fuzzy_takes_serials_of_the_whole_table(spark, tmp_path):
    parts = [(i, f"name{i} blue", f"type{i}") for i in range(1, 2501)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["folder"], r["serial"]) for r in shot_queries.fuzzy(spark, str(tmp_path)).collect()}
    assert ("type2500", "name2500 blue") in got
