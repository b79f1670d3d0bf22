
"""Files that hold cues: readers and writers."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: White space at the ends of a value is part of it.
EXACT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
#: Columns of subtitle CSV files; each file has the first four and some of the others.
CSV_COLUMNS = {"shot": "string", "start": "double", "end": "double", "text": "string", "sub_image": "string", "sub_pos": "string", "segments": "string", "placement": "string"}


def _stamp(column: str) -> Column:
    ms = F.rint(F.col(column) * F.lit(1000.0)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_blocks(cues: DataFrame) -> DataFrame:
    """S3: cues (ep, ord, start, end, text) as numbered blocks (ep, number, block); blank texts dropped, numbered by start."""
    some = cues.where(F.btrim("text") != "")
    number = F.row_number().over(W.partitionBy("ep").orderBy("start", "ord")).cast("long")
    rows = some.withColumn("number", number)
    block = F.concat_ws("\n", F.col("number").cast("string"), F.concat(_stamp("start"), F.lit(" --> "), _stamp("end")), F.btrim("text"))
    return rows.select("ep", "number", block.alias("block"))


def read_srt(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S3: blocks of SRT files, or of all below a folder: path, number, start, end, text. Line ends of any kind; blocks stand one or more empty lines apart."""
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    raw = files.select("path", F.explode(F.split("v", r"\n[ \t]*\n\s*(?=[0-9]+[ \t]*\n)")).alias("b")).withColumn("b", F.btrim("b", F.lit("\ufeff \n")))
    clock = r"([0-9]+):([0-9]+):([0-9]+),([0-9]+)"
    seconds = lambda g: sum(F.regexp_extract("b", rf"^[0-9]+[ \t]*\n{clock} --> {clock}", g + i).try_cast("double") * w for i, w in enumerate((3600.0, 60.0, 1.0, 0.001)))
    rows = raw.select("path", F.regexp_extract("b", r"^([0-9]+)", 1).try_cast("int").alias("number"), seconds(1).alias("start"), seconds(5).alias("end"), F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)$", 1).alias("text"))
    return rows.where("start IS NOT NULL")


def write_srt(cues: DataFrame, path: str, folders: int = 64) -> None:
    """S3: an SRT file `ep=....srt` for each episode, whose blocks stay together and in order, in `folders` folders; `_files` lists them.

    A folder of its own for each episode would be made, moved and listed apart, which costs many times what its file does. An episode is a row,
    as it is for who reads it."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))), lambda x: F.concat(x["block"], F.lit("\n\n")))
    name = F.concat(F.lit("ep="), F.coalesce(F.url_encode(F.col("ep").cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(".srt"))
    files = srt_blocks(cues).groupBy("ep").agg(F.array_join(blocks, "").cast("binary").alias("data"))
    folder = F.format_string("%02d/", F.pmod(F.xxhash64("ep"), F.lit(folders)))
    write_files(files.select(F.concat(folder, name).alias("name"), "data"), path).write.parquet(f"{path}/_files")


def read_subtitle_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """All subtitle CSV files under a path with wildcards, whichever columns each has, rows with a shot only.

    A file's first line names its columns, so all columns are read as text, by place, and then put under
    their names; columns that a file lacks are null."""
    places = [f"_{i}" for i in range(len(CSV_COLUMNS))]
    raw = spark.read.options(multiLine=True, **EXACT).schema(", ".join(f"{p} string" for p in places)).csv(pattern)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.array(*places).alias("v"))
    headers = lines.groupBy("path").agg(F.min("at").alias("first"), F.min_by("v", "at").alias("names"))
    rows = lines.join(headers, "path").where("at > first")
    value = lambda c: F.try_element_at("v", F.nullif(F.array_position("names", c), F.lit(0)).cast("int"))
    return rows.select("path", *(value(c).try_cast(t).alias(c) for c, t in CSV_COLUMNS.items())).where("shot <> ''")


def write_subtitle_csv(cues: DataFrame, path: str) -> None:
    """Shot, start and end to the millisecond, text, and segments and placement as JSON if they are there."""
    nested = [c for c in ("segments", "placement") if c in cues.columns]
    columns = ["shot", *(F.format_string("%.3f", F.col(c)).alias(c) for c in ("start", "end")), "text", *(F.to_json(c).alias(c) for c in nested)]
    cues.select(*columns).write.options(header=True, **EXACT).csv(path)


EPISODES = "array<struct<name:string,season:int,type:string,airdate:string>>"


def catalogue_json(texts: DataFrame, text: str = "value") -> DataFrame:
    """JSON lists of episodes, one a row, to a row for each: place in its list from 0 (ord), name, season, type, airdate.
    Other columns stay; texts that aren't such lists have no rows."""
    others = [c for c in texts.columns if c != text]
    rows = texts.select(*others, F.posexplode(F.from_json(text, EPISODES)).alias("ord", "e"))
    return rows.select(*others, "ord", "e.*")


def read_catalogue_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files that hold one list each."""
    return catalogue_json(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def write_catalogue_csv(rows: DataFrame, path: str) -> None:
    """CSV has no nulls: they become empty text, and empty text in quotes stays apart from nothing in a column of its own (`_empty`)."""
    empty = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).cast("string") == "", F.lit(c)) for c in rows.columns))), " ")
    rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns), empty.alias("_empty")).write.options(header=True, emptyValue="", **EXACT).csv(path)


def read_catalogue_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of `write_catalogue_csv`, or of any CSV with these columns: empty is null, but for the columns named in `_empty`."""
    names = spark.createDataFrame([], schema).schema
    raw = spark.read.options(header=True, multiLine=True, enforceSchema=False, **EXACT).csv(path)
    raw = raw if "_empty" in raw.columns else raw.withColumn("_empty", F.lit(""))
    kept = F.split(F.coalesce("_empty", F.lit("")), " ")
    value = lambda f: F.when(F.array_contains(kept, f.name), F.lit("")).otherwise(F.nullif(F.col(f.name), F.lit("")))
    return raw.select(*(value(f).cast(f.dataType).alias(f.name) for f in names))


STATE = "header struct<slices:array<struct<id:string,title:string>>>, results array<struct<episode:struct<id:string,title:string,subtitle:string>>>"


def page_state(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """Pages with the JSON state that `pattern` (one group) finds in them as a struct `state`, null if there is none."""
    return pages.withColumn("state", F.from_json(F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")), f"struct<{', '.join(x.replace(' ', ':', 1) for x in STATE.split(', '))}>"))


def page_slices(states: DataFrame, key: str, skip: list[str]) -> DataFrame:
    """(key, slice, title) of the slices that aren't skipped; a page without any has one, null and without title."""
    left = F.filter(F.coalesce("state.header.slices", F.array()), lambda x: ~x["title"].isin(skip))
    alone = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("").alias("title")))
    return states.where("state IS NOT NULL").select(key, F.explode(F.when(F.size(left) > 0, left).otherwise(alone)).alias("s")).select(key, F.col("s.id").alias("slice"), "s.title")


def page_items(states: DataFrame, key: str) -> DataFrame:
    """(key, ord, id, title, subtitle) of the items that are episodes, in the page's order."""
    rows = states.select(key, F.posexplode("state.results").alias("ord", "r")).where("r.episode IS NOT NULL")
    return rows.select(key, "ord", "r.episode.*")


def png(levels: bytes, width: int, height: int) -> bytes:
    """Grey levels row by row as a PNG file."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + levels[i * width : (i + 1) * width] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Rows (name, data) as files below `folder`, each written by the task that has its row; the names and sizes written.

    A file gets its name when it is whole, so that a task that runs twice, or is lost, leaves no part of one. Rows without a name
    or data are left out; of rows with one name one stays. They are left out by the task that writes: a filter before it would have data
    that Python makes made twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            batch = batch.filter(pa.compute.and_(batch.column("name").is_valid(), batch.column("data").is_valid()))
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data"), strict=True):
                path, part = f"{base}/{name}", f"{base}/_{uuid.uuid4().hex}"
                place.create_dir(path.rpartition("/")[0], recursive=True)
                with place.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                place.move(part, path)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.compute.binary_length(batch.column("data")).cast(pa.int64())], ["name", "bytes"])

    return files.select("name", "data").mapInArrow(write, "name string, bytes long")
