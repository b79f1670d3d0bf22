"""Mechanisms of storage, streams and frames: what is written, shuffled and kept, and levels of reduced frames."""

from __future__ import annotations

import datetime as dt
import math
import os
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelake import sources, streaming
from cuelake.operators import frames, tags
from cuelake.staging import at_rest


def sizes(folder: Path) -> dict[str, tuple[int, int]]:
    return {str(p.relative_to(folder)): (p.stat().st_size, p.stat().st_mtime_ns) for p in folder.rglob("*.parquet")}


def test_bytes_written_follow_the_changed_folders(spark, tmp_path):
    folder = f"{tmp_path}/shots"
    rows = [(f"d{i}/{j}.jpg", f"d{i}", float(j), f"text {i} {j} " * 5, 0, None) for i in range(120) for j in range(40)]
    stored = spark.createDataFrame(rows, "path string, dir string, start double, text string, post_count long, last_posted long").repartition(2)
    manifest = spark.createDataFrame([(f"d{i}", 1, 1) for i in range(120)], "dir string, mtime long, size long")
    streaming.begun(stored, manifest, folder, buckets=32)
    schemas = {"shots": stored.schema, "manifest": manifest.schema}
    new = stored.withColumn("text", F.concat("text", F.lit("!"))).select("path", "dir", "start", "text")
    rows_of = lambda batch: new.join(batch.select("dir").distinct(), "dir", "left_semi").select(*new.columns)

    def flow(changed: list[tuple]) -> None:
        spark.createDataFrame(changed, manifest.schema).coalesce(1).write.mode("append").parquet(f"{folder}/incoming")
        streaming.load_continuously(spark.readStream.schema(manifest.schema).parquet(f"{folder}/incoming"), folder, rows_of, ["text"], schemas)

    flow([("d7", 2, 1), *((f"d{i}", 1, 1) for i in range(20, 60))])
    flow([(f"d{i}", 2 if i == 7 else 1, 1) for i in range(120)])  # nothing is new
    flow([("d8", 3, 3), ("d7", 3, 3), ("d7", 2, 1)])
    total, one, none, two = (sum(n for n, _ in sizes(Path(folder) / "shots" / f"edition={k}").values()) for k in (-1, 0, 1, 2))
    assert one < total / 8 and none == 0 and two < total / 4
    got = {r["path"]: r["text"] for r in streaming.stored(spark, folder, "shots", stored.schema).collect()}
    assert got == {p: t + ("!" if d in ("d7", "d8") else "") for p, d, _, t, _, _ in rows}
    assert {tuple(r) for r in streaming.stored(spark, folder, "manifest", manifest.schema).where("mtime > 1").collect()} == {("d7", 3, 3), ("d8", 3, 3)}
    counts = [tuple(spark.read.parquet(streaming.edition(folder, "counts", k)).first()) for k in range(3)]
    assert counts == [(0, 0, 0, 4800)] * 3


def test_an_edition_has_one_file_a_bucket(spark, tmp_path):
    """However many tasks have rows of a bucket, so that files follow the buckets, not buckets times tasks."""
    rows = [(f"d{i}/{j}", f"d{i}", float(j), "a", 0, None) for i in range(40) for j in range(5)]
    stored = spark.createDataFrame(rows, "path string, dir string, start double, text string, post_count long, last_posted long").repartition(6)
    streaming.begun(stored, spark.createDataFrame([(f"d{i}", 1, 1) for i in range(40)], "dir string, mtime long, size long"), f"{tmp_path}/shots", buckets=4)
    for name in ("shots", "manifest"):
        folders = [list(p.glob("*.parquet")) for p in Path(f"{tmp_path}/shots/{name}/edition=-1").glob("bucket=*")]
        assert [len(files) for files in folders] == [1] * 4


def test_a_folder_that_loses_all_shots_leaves_no_bucket_behind(spark, tmp_path):
    folder = f"{tmp_path}/shots"
    stored = spark.createDataFrame([("d/1", "d", 1.0, "a", 0, None)], "path string, dir string, start double, text string, post_count long, last_posted long")
    manifest = spark.createDataFrame([("d", 1, 1)], "dir string, mtime long, size long")
    streaming.begun(stored, manifest, folder, buckets=4)
    spark.createDataFrame([("d", 2, 0)], manifest.schema).write.parquet(f"{folder}/incoming")
    nothing = stored.limit(0).select("path", "dir", "start", "text")
    streaming.load_continuously(spark.readStream.schema(manifest.schema).parquet(f"{folder}/incoming"), folder, lambda batch: nothing, ["text"], {"shots": stored.schema, "manifest": manifest.schema})
    assert streaming.stored(spark, folder, "shots", stored.schema).count() == 0
    assert [tuple(r) for r in streaming.stored(spark, folder, "manifest", manifest.schema).collect()] == [("d", 2, 0)]


def test_frames_go_to_python_a_few_at_a_time(spark, tmp_path, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), {}
    kept = frames.written
    monkeypatch.setattr(frames, "written", lambda df, what: seen.__setitem__(what, int(spark.conf.get(name))) or kept(df, what))
    files = [(f"e0/{i}.png", bytearray(sources.png(bytes(64), 8, 8))) for i in range(3)]
    sources.write_files(spark.createDataFrame(files, "name string, data binary"), f"file://{tmp_path}/frames").collect()
    none = spark.createDataFrame([], "path string")
    rows = frames.measured(spark, f"{tmp_path}/frames/e*/*.png", none, lambda: lambda batch: batch.reshape(len(batch), -1)[:, :2], lambda at: F.regexp_extract(at, "(e[0-9]/[0-9]+[.]png)$", 1), side=4)
    assert rows.count() == 3 and seen["frames"] == 32 and spark.conf.get(name) == before


def test_image_files_are_read_a_bounded_number_at_a_time(spark, tmp_path, monkeypatch):
    """So that the driver, which lists and plans a scan whole, never holds all files; files done before are not read, odd names and repeated ones are."""
    scans, kept = [], frames.read_images
    monkeypatch.setattr(frames, "FILES", 4)
    monkeypatch.setattr(frames, "read_images", lambda s, files: scans.append((len(files), kept(s, files))) or scans[-1][1])
    before = {k: spark.conf.get(k) for k in frames.SCAN}
    names = [*(f"e0/{i}.png" for i in range(40)), "e1/a+b%20 [1-9]{x}*?.png", "e1/a+b%20 [1-9]1.png"]
    rows = [(k, bytearray(sources.png(bytes([n] * 64), 8, 8))) for n, k in enumerate(names)]
    folder = f"file://{tmp_path}/frames"
    written = sources.write_files(spark.createDataFrame([*rows, rows[3]], "name string, data binary"), folder).collect()
    files = spark.createDataFrame([*((f"{folder}/{r['name']}",) for r in written), (None,)], "path string")
    done = spark.createDataFrame([(k,) for k in names[:10]], "path string")
    got = frames.measured(spark, files, done, lambda: lambda batch: batch.reshape(len(batch), -1)[:, :2], lambda at: F.regexp_extract(at, "(e[01]/.*)$", 1), side=4)
    assert sorted((r["path"], r["brightness"]) for r in got.collect()) == sorted((k, float(n)) for n, k in enumerate(names) if n >= 10)
    assert sum(n for n, _ in scans) == 32 == sum(df.count() for _, df in scans) and max(n for n, _ in scans) < 16
    assert {k: spark.conf.get(k) for k in frames.SCAN} == before


def test_data_of_files_are_made_once(spark, tmp_path):
    """A row without data is left out, and no filter has Python make the data of the others once more to find it."""
    (tmp_path / "calls").mkdir()
    calls = str(tmp_path / "calls")

    def data(ids: pd.Series) -> pd.Series:
        for i in ids:
            open(f"{calls}/{i}-{uuid.uuid4().hex}", "w").close()
        return pd.Series([b"x" * i if i else None for i in ids])

    rows = spark.range(5).select(F.when(F.col("id") != 4, F.format_string("a/%d.png", "id")).alias("name"), F.pandas_udf(data, "binary")("id").alias("data"))
    got = sources.write_files(rows, f"file://{tmp_path}/files").collect()
    assert {tuple(r) for r in got} == {(f"a/{i}.png", i) for i in (1, 2, 3)} and sorted(os.listdir(tmp_path / "files" / "a")) == ["1.png", "2.png", "3.png"]
    assert sorted(name.partition("-")[0] for name in os.listdir(calls)) == list("01234")


def test_first_reports_of_many_keys_in_one_call():
    """A part's keys come in one call, each with its earliest row; its state is read and appended to once. Keys that were seen have no row again."""
    held, calls = [], []

    class Seen:
        exists = staticmethod(lambda: bool(held))
        get = staticmethod(lambda: iter(held))

        def appendList(self, rows):  # noqa: N802
            calls.append(len(rows))
            held.extend(rows)

    processor = streaming._FirstReport(None)
    processor.init(type("Handle", (), {"getListState": lambda self, name, schema, keep: Seen()})())
    at = lambda h: pd.Timestamp(2024, 1, 1) + pd.Timedelta(hours=h)
    frame = lambda keys, h: pd.DataFrame({"rkey": keys, "path": "p", "outcome": "posted", "ts": [at(h + i % 3) for i in range(len(keys))], "_part": 0})
    keys = [f"k{i % 500}" for i in range(2000)]
    got = pd.concat(processor.handleInputRows((0,), iter([frame(keys, 9), frame(keys, 2)]), None))
    assert sorted(got["rkey"]) == sorted(set(keys)) and set(got["ts"]) <= {at(2), at(3), at(4)} and list(got) == ["rkey", "path", "outcome", "ts"]
    assert [r for x in processor.handleInputRows((0,), iter([frame([*keys, "new"], 0)]), None) for r in x["rkey"]] == ["new"] and calls == [500, 1]


def test_stream_of_late_repeats_equals_batch(spark, tmp_path):
    """Keys come again days after the watermark of any other event, in later files; null keys and times count for nothing."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    files = [
        [("a", "p", "posted", at(0)), ("b", "p", "posted", at(1)), ("c", "q", "refused", at(1)), (None, "q", "posted", at(2)), ("n", "q", "posted", None), ("a", "p", "posted", at(0))],
        [("d", "q", "posted", at(500)), ("a", "p", "posted", at(600))],
        [("a", "p", "posted", at(900)), ("c", "q", "refused", at(901)), ("e", "r", "transient", at(902))],
    ]
    schema = "rkey string, path string, outcome string, ts timestamp"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streaming.drained(streaming.first_reports(stream), "late", "append")
    fold = lambda x: {(r["path"], r["posts"], r["last_posted"], r["skip"]) for r in streaming.outcomes_folded(x).collect()}
    assert fold(got) == fold(streaming.first_reports(table)) == {("p", 2, at(1), False), ("q", 1, at(500), True), ("r", 0, None, False)}
    assert got.count() == 5 and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_replacing_a_tag_leaves_other_files(spark, tmp_path):
    path = f"{tmp_path}/members"
    rows = [(t, i, i / 100) for t in ("day", "night", "in/out") for i in range(50)]
    found = spark.createDataFrame(rows, "tag string, path long, prob double")
    tags.replace_members(found, ["day", "night", "in/out"], path)
    before = sizes(Path(path))
    for _ in range(2):
        tags.replace_members(found.where("tag <> 'night' AND path < 3"), ["day", "night"], path)
        after = sizes(Path(path))
        assert {k: v for k, v in after.items() if "tag=in" in k} == {k: v for k, v in before.items() if "tag=in" in k}
        got = {(r["tag"], r["path"]) for r in tags.stored_members(found, path).collect()}
        assert got == {("in/out", i) for i in range(50)} | {("day", i) for i in range(3)}
    assert tags.stored_members(found, path).columns == ["tag", "path", "prob"]


def test_tables_at_rest_are_joined_without_a_shuffle(spark, tmp_path):
    faces = at_rest(spark.range(500).select("id", (F.col("id") % 7).alias("cluster")), "faces", "id", 8)
    vectors = at_rest(spark.range(0, 500, 2).select("id", F.array(F.col("id").cast("float")).alias("vec")), "vectors", "id", 8)
    done = at_rest(spark.range(0, 500, 5).select("id"), "done", "id", 8)
    joined = frames.with_vectors(faces, vectors).join(done, "id", "left_anti")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert {r["id"] for r in joined.collect()} == {i for i in range(500) if i % 2 == 0 and i % 5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def cubic(x: float) -> float:
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def plainly_resampled(rows: list[list[float]], width: int, span: float) -> list[list[float]]:
    """Each row to `width` numbers, pixel by pixel."""
    out, n, scale = [], len(rows[0]), span / width
    for row in rows:
        line = []
        for i in range(width):
            middle, wide = (i + 0.5) * scale, max(scale, 1.0)
            lo, hi = max(0, int(middle - 2 * wide + 0.5)), min(n, int(middle + 2 * wide + 0.5))
            w = [cubic((k - middle + 0.5) / wide) for k in range(lo, hi)]
            line.append(min(255, max(0, math.floor(sum(a * row[k] for a, k in zip(w, range(lo, hi), strict=True)) / sum(w) + 0.5))))
        out.append(line)
    return out


@pytest.mark.parametrize(("height", "width", "most", "want"), [(50, 40, 32, (32, 26)), (40, 50, 32, (26, 32)), (33, 100, 32, (11, 32)), (30, 30, 32, (30, 30)), (200, 3, 32, (32, 1)), (130, 131, 32, (32, 32))])
def test_frames_are_reduced_by_resampling(height, width, most, want):
    pixels = np.random.default_rng(height).integers(0, 256, (height, width)).astype(float)
    got = frames.reduced(pixels, most)
    assert got.shape == want
    if want == (height, width):
        assert (got == pixels).all()
        return
    by_x, by_y = max(1, int(width / want[1] / 2)), max(1, int(height / want[0] / 2))
    parts = [[math.floor(np.mean(pixels[y : y + by_y, x : x + by_x]) + 0.5) for x in range(0, width, by_x)] for y in range(0, height, by_y)]
    across = plainly_resampled(parts, want[1], width / by_x)
    down = np.array(plainly_resampled([list(c) for c in zip(*across, strict=True)], want[0], height / by_y)).T
    assert np.abs(got - down).max() <= 1


def test_image_files_are_measured_and_given_to_a_model(spark, tmp_path):
    rng = np.random.default_rng(6)
    pictures = {f"e{i % 3}/f{i}.png": rng.integers(0, 256, (rng.integers(20, 400), rng.integers(20, 400))).astype(np.uint8) for i in range(12)}
    rows = [(k, bytearray(sources.png(v.tobytes(), v.shape[1], v.shape[0]))) for k, v in pictures.items()] + [("e0/broken.png", bytearray(b"no picture")), (None, bytearray(b"x")), ("e1/none.png", None)]
    written = sources.write_files(spark.createDataFrame(rows, "name string, data binary"), f"file://{tmp_path}/frames").collect()
    assert {r["name"]: r["bytes"] for r in written} == {k: os.path.getsize(tmp_path / "frames" / k) for k in [*pictures, "e0/broken.png"]}
    done = spark.createDataFrame([(k,) for k in pictures if k.startswith("e2")] + [("e0/f0.png",)], "path string")

    def make():
        return lambda batch: batch.reshape(len(batch), -1).mean(axis=1, keepdims=True) * [[3.0, 4.0]]

    key = lambda at: F.regexp_extract(at, "(e[0-9]/[a-z0-9]+[.]png)$", 1)
    got = {r["path"]: r for r in frames.measured(spark, f"{tmp_path}/frames/e*/*.png", done, make, key, most=64, side=8).collect()}
    assert set(got) == {k for k in pictures if not k.startswith("e2") and k != "e0/f0.png"}
    for k, r in got.items():
        g = frames.reduced(pictures[k].astype(float), 64)
        assert (r["height"], r["width"]) == pictures[k].shape
        assert (r["brightness"], r["contrast"], r["sharpness"]) == pytest.approx((g.mean(), g.std(), frames.edges(g).var()))
        assert r["vec"] == pytest.approx([0.6, 0.8])
    assert frames.measured(spark, f"{tmp_path}/frames/e*/*.png", spark.createDataFrame([(k,) for k in [*pictures, "e0/broken.png"]], "path string"), make, key).count() == 0
