"""Files, overlays, frames, loading and browsing: worked examples and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake import sources, streaming
from cuelake.operators import catalogue, frames, overlay, shots
from cuelake.sources import ttml


def test_csv_files_with_several_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text('shot,start,end,text\na.jpg,1.5,2,"line\nshot,x,""q"""\n,3,4,no shot\nb.jpg,5,6,\n')
    (tmp_path / "a" / "two.csv").write_text('shot,start,end,text,segments,sub_image\nc.jpg,7,8, kept ,"[[[""a"", ""#fff""]]]",i.png\n')
    (tmp_path / "a" / "empty.csv").write_text("shot,start,end,text\n")
    got = {r["shot"]: r for r in sources.read_subtitle_csv(spark, f"{tmp_path}/*/*.csv").collect()}
    assert {k: (r["start"], r["end"], r["text"], r["segments"], r["sub_image"], r["placement"]) for k, r in got.items()} == {
        "a.jpg": (1.5, 2.0, 'line\nshot,x,"q"', None, None, None), "b.jpg": (5.0, 6.0, None, None, None, None), "c.jpg": (7.0, 8.0, " kept ", '[[["a", "#fff"]]]', "i.png", None),
    }


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_srt_line_ends_and_empty_lines(spark, tmp_path, end):
    text = "﻿1\n00:00:01,000 --> 00:00:02,500\nOne\ntwo\n\n\n\n2\n01:00:00,001 --> 01:00:01,000 \nThree\n\n"
    (tmp_path / "x.srt").write_bytes(text.replace("\n", end).encode())
    got = sources.read_srt(spark, f"{tmp_path}/x.srt").orderBy("number").collect()
    assert [(r["number"], round(r["start"], 3), round(r["end"], 3), r["text"]) for r in got] == [(1, 1.0, 2.5, "One\ntwo"), (2, 3600.001, 3601.0, "Three")]


def test_srt_files_of_many_episodes(spark, tmp_path):
    """Folders don't grow in number with the episodes; each episode is one file, in order, and no cues give no files."""
    cues = spark.createDataFrame([(e, k, float(9 - k), 10.0, f"{e} at {k}" if k else " ") for e in [None, -1, *range(300)] for k in range(3)], "ep long, ord long, start double, end double, text string")
    sources.write_srt(cues, f"file://{tmp_path}/all", folders=4)
    assert len([x for x in (tmp_path / "all").iterdir() if x.name != "_files"]) == 4
    assert len(list((tmp_path / "all").rglob("*.srt"))) == 302
    got = sources.read_srt(spark, f"{tmp_path}/all").withColumn("path", F.regexp_extract("path", "/ep=([^/]*)[.]srt$", 1)).orderBy("number").collect()
    names = {str(e): e for e in [-1, *range(300)]} | {"__HIVE_DEFAULT_PARTITION__": None}
    assert len(got) == 604
    assert {(names[r["path"]], r["number"], r["start"], r["text"]) for r in got} == {(e, n, float(n + 6), f"{e} at {3 - n}") for e in names.values() for n in (1, 2)}
    sources.write_srt(cues.where("ep > 300"), f"file://{tmp_path}/none")
    assert sources.read_srt(spark, f"{tmp_path}/none").count() == 0


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"name": "A", "season": 1, "type": "regular", "airdate": "1963-11-23"}, {"name": "B", "season": null}]')
    got = sources.read_catalogue_json(spark, f"{tmp_path}/c.json").orderBy("ord").collect()
    assert [(r["ord"], r["name"], r["season"], r["type"]) for r in got] == [(0, "A", 1, "regular"), (1, "B", None, None)]
    rows = [(1, "", None), (2, None, 'a "b",\n c '), (3, "yes", "")]
    sources.write_catalogue_csv(spark.createDataFrame(rows, "n int, has_subs string, notes string"), f"{tmp_path}/csv")
    assert sorted(tuple(r) for r in sources.read_catalogue_csv(spark, f"{tmp_path}/csv", "n int, has_subs string, notes string").collect()) == rows


TTML = """<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="http://www.w3.org/ns/ttml#styling"><head><styling>
<style xml:id="a" tts:color="#FFFF00FF"/><style xml:id="b" style="a"/><style xml:id="c" style="d"/><style xml:id="d" style="c"/></styling>
<layout><region xml:id="mid" tts:origin="10% 20%" tts:extent="80% 40%" tts:displayAlign="center"/><region xml:id="px" tts:origin="1px 2px"/></layout></head>
<body><div><p begin="1s" end="2s" region="mid">Hi <span style="b">you<br/>there</span> too</p>
<p style="b" region="px"><span begin="3s" style="c">sung</span><span begin="4s" tts:color="cyan">lines</span>untimed</p><p>never</p></div></body></tt>"""


def test_ttml_runs(spark):
    df = spark.createDataFrame([("f", TTML), ("broken", "<tt"), ("none", None)], "name string, xml string")
    got = [tuple(r) for r in ttml.exploded(df).orderBy("para", "line", "run").collect()]
    assert [(r[1], r[2], r[3], r[4], round(r[5], 3), *r[6:]) for r in got] == [
        (0, "1s", "2s", "center", 0.4, 0, 0, "Hi ", "#ffffff"), (0, "1s", "2s", "center", 0.4, 0, 1, "you", "#ffff00"), (0, "1s", "2s", "center", 0.4, 1, 0, "there", "#ffff00"), (0, "1s", "2s", "center", 0.4, 1, 1, " too", "#ffffff"),
        (1, "3s", None, "bottom", 0.95, 0, 0, "sung", "#ffff00"), (2, "4s", None, "bottom", 0.95, 0, 0, "lines", "#cyan"),
    ]


def test_overlays(spark):
    one = lambda *x: tuple(F.lit(v) for v in x)
    row = spark.range(1).select(
        overlay.placed_overlay(one(640, 480), one(1432, 1070), one(1920, 1080), one(900, 1000, 1000, 1040)).alias("a"), overlay.placed_overlay(one(1, 1), one(1, 1), one(1, 1), tuple([F.lit(None).cast("int")] * 4)).alias("b"),
        overlay.cropped(F.lit(1024), F.lit(576), F.lit(4 / 3)).alias("c"), overlay.cropped(F.lit(768), F.lit(576), F.lit(4 / 3)).alias("d"), overlay.uploaded(one(768, 576), one(-5, 570, 100, 20), 1920).alias("e"),
        overlay.uploaded(one(2000, 100), one(1990, 0, 100, 20), 1920).alias("f"),
    ).first()
    assert tuple(row["a"]) == (round((-244 + 900) * 640 / 1432), round((-5 + 1000) * 480 / 1070), round(100 * 640 / 1432), round(40 * 480 / 1070)) and row["b"] is None
    assert tuple(row["c"]) == (768, 128) and tuple(row["d"]) == (768, 0)
    assert tuple(row["e"]) == (0, 1440 - 50, 250, 50) and tuple(row["f"]) == (1900, 0, 100, 20)


def test_frame_quality(spark):
    rng = np.random.default_rng(1)
    big = rng.integers(0, 256, (700, 10, 3), np.uint8)
    rows = [(1, 2, 1, bytes([0, 255])), (700, 10, 3, big.tobytes()), (2, 2, 1, b"x"), (None, 1, 1, b"x"), (1, 1, 1, None)]
    got = spark.createDataFrame(rows, "h int, w int, c int, d binary").select(frames.frame_quality(*(F.col(c) for c in "hwcd")).alias("q")).collect()
    assert tuple(got[0]["q"]) == (127.5, 127.5, 127.5**2)
    small = frames.reduced(frames.grey(big.tobytes(), 700, 10, 3), 320)
    assert small.shape == (320, 5) and abs(small.mean() - (big @ np.array([0.114, 0.587, 0.299])).mean()) < 1
    assert got[1]["q"]["brightness"] == pytest.approx(small.mean()) and got[1]["q"]["contrast"] == pytest.approx(small.std())
    assert all(r["q"]["brightness"] is None for r in got[2:])


def test_models_in_batches(spark):
    def make():
        return lambda x: np.stack([x, 2 * x], axis=1)

    df = spark.createDataFrame([("a", 3.0), ("b", 0.0), ("c", None), ("d", -1.0)], "path string, x double")
    got = {r["path"]: r["vec"] for r in frames.embedded(df, "x", make, size=2).collect()}
    assert got == {"a": pytest.approx([5**-0.5, 2 * 5**-0.5]), "b": [0.0, 0.0], "d": pytest.approx([-(5**-0.5), -2 * 5**-0.5])}
    images = spark.createDataFrame([("a", b"xx"), ("b", b""), ("c", None)], "path string, d binary")
    found = frames.detected(images, "d", lambda d: [(1.0 * i, 0.0, 1.0, 1.0, 0.5, [1.0]) for i in range(len(d))]).collect()
    assert sorted((r["path"], r["x"]) for r in found) == [("a", 0.0), ("a", 1.0)]


def test_numbers_of_ranges(spark):
    rows = [(1, 1, "x", "1"), (1, 2, "x", "2"), (1, 3, "x", "1-2"), (1, 4, "x", "7-9"), (1, 5, "y", "1"), (1, 6, "y", None), (2, 7, "x", "1")]
    df = spark.createDataFrame(rows, "season int, ord int, serial string, part string")
    got = {r["ord"]: (r["first"], r["last"]) for r in catalogue.numbered(df, ["season"], "serial", "part", ["ord"]).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 2), 4: (None, None), 5: (3, 3), 7: (1, 1)}


def test_ratio(spark):
    rows = [([], []), (["a", "b"], ["b", "c"]), (None, ["a"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(catalogue.seq_ratio(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1.0, 0.5, None]


STORED = "path string, dir string, start double, text string, post_count long, last_posted long"


def test_loading_twice_changes_nothing(spark, tmp_path):
    stored = spark.createDataFrame([("d/1", "d", 1.0, "a", 3, 9), ("d/2", "d", 2.0, "b", 0, None), ("e/1", "e", 1.0, "c", 1, 5)], STORED)
    manifest = spark.createDataFrame([("d", 1, 2), ("e", 1, 1)], "dir string, mtime long, size long")
    listing = spark.createDataFrame([("d", 2, 2), ("e", 1, 1), ("f", 1, 1)], "dir string, mtime long, size long")
    rows = spark.createDataFrame([("d/2", "d", 2.0, "B"), ("d/3", "d", 1.04, "a"), ("e/1", "e", 1.0, "other"), ("f/1", "f", 0.0, "new")], "path string, dir string, start double, text string")
    want = {("d/2", "B", 0, None), ("d/3", "a", 3, 9), ("e/1", "c", 1, 5), ("f/1", "new", 0, None)}
    plain = lambda x: {(r["path"], r["text"], r["post_count"], r["last_posted"]) for r in x.collect()}
    one, seen, counts = shots.loaded(stored, manifest, listing, rows, ["text"])
    assert plain(one) == want and tuple(counts.first()) == (1, 2, 1, 4)
    two, seen, counts = shots.loaded(one, seen, listing, rows, ["text"])
    assert plain(two) == want and tuple(counts.first()) == (0, 0, 0, 4)
    assert {tuple(r) for r in seen.collect()} == {("d", 2, 2), ("e", 1, 1), ("f", 1, 1)}

    folder = f"{tmp_path}/editions"
    streaming.begun(stored, manifest, folder)
    schemas = {"shots": stored.schema, "manifest": manifest.schema}
    for _ in range(2):
        listing.coalesce(1).write.mode("append").parquet(f"{folder}/incoming")
        streaming.load_continuously(spark.readStream.schema(listing.schema).parquet(f"{folder}/incoming"), folder, lambda batch: rows.join(batch.select("dir"), "dir", "left_semi").select(*rows.columns), ["text"], schemas)
        assert plain(streaming.stored(spark, folder, "shots", stored.schema)) == want


def test_work_order(spark):
    df = spark.createDataFrame([(i, i in (4, 7)) for i in range(9)], "ord long, started boolean")
    order = lambda *a: [r["ord"] for r in shots.work_order(df, *a).collect()]
    assert order("given", 3) == [0, 1, 2] and order("reversed", 2) == [8, 7]
    assert set(order("shuffled")[:2]) == {4, 7} and sorted(order("shuffled")) == list(range(9)) and order("shuffled", 0) == []


def test_browsing(spark):
    s = spark.createDataFrame([("p/a/1", True), ("p/a/2", None), ("q/1", True)], "path string, q boolean")
    f = spark.createDataFrame([("p/a/1", "Ann", 1), ("p/a/1", "Ann", 2), ("q/1", None, 1)], "path string, person string, cluster int")
    m = spark.createDataFrame([("t", "q/1")], "tag string, path string")
    ask = lambda **k: sorted(r["path"] for r in shots.browsed(s, f, m, **k).collect())
    assert ask() == ["p/a/1", "p/a/2", "q/1"] and ask(n_faces="none") == ["p/a/2"] and ask(n_faces="some") == ["p/a/1"] and ask(n_faces="any", programme="q") == ["q/1"]
    assert ask(done=[F.col("q")]) == ["p/a/1", "q/1"] and ask(tag="t") == ["q/1"] and ask(person="Ann") == ["p/a/1"] and ask(cluster=1, person="Ann") == ["p/a/1"] and ask(cluster=9) == []
    measured = s.withColumns({"sharpness": F.when(F.col("path") == "q/1", 2.0), "brightness": F.lit(1.0), "face": F.lit(None).cast("double")})
    assert [r["path"] for r in shots.sorted_shots(measured, "sharp").collect()] == ["q/1", "p/a/1", "p/a/2"]
    assert [r["path"] for r in shots.sorted_shots(measured, "face").collect()] == ["p/a/1", "p/a/2", "q/1"]
    scores = spark.createDataFrame([("q/1", 0.1), ("p/a/2", 0.4)], "path string, score double")
    assert [r["path"] for r in shots.sorted_shots(s, "search", scores=scores).collect()] == ["p/a/2", "q/1"]
    assert sorted(r["path"] for r in shots.sorted_shots(s, "shuffle").collect()) == ["p/a/1", "p/a/2", "q/1"]


def test_unused_report_refuses_stale_folders(spark):
    s = spark.createDataFrame([("d/1.jpg", "d", None)], "path string, dir string, overlay string")
    listing = spark.createDataFrame([("d", "d/1.jpg", 5), ("d", "d/2.png", 7), ("e", "e/1.jpg", 1)], "dir string, image string, bytes long")
    manifest = spark.createDataFrame([("d", 1, 1)], "dir string, mtime long, size long")
    assert tuple(shots.unused_report(listing, s, manifest, manifest).first()) == (1, 7, 1)
    with pytest.raises(ValueError, match="changed"):
        shots.unused_report(listing, s, manifest.withColumn("mtime", F.lit(2).cast("long")), manifest)
