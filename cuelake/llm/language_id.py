"""Language identification by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cuelake.llm.contexts import Automaton, counted, grams, levels_of, small_batches, stream

UNKNOWN = "und"


def ppm(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Escape by method C: a context seen n times with t different symbols escapes with t / (n + t);
    what escapes is shared by the symbols not seen, as the shorter context has them."""
    n, kinds, unseen = counts.sum(axis=1), (counts > 0).sum(axis=1), np.where(counts > 0, 0.0, below)
    escape = kinds / (n + kinds)
    return counts / (n + kinds)[:, None] + unseen * (escape / np.maximum(unseen.sum(axis=1), 1e-300))[:, None]


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            langs = batch.column("_lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("_text").filter(pc.equal(langs.indices, k))
                found = counted(grams(stream(_lowered(texts))[0], depth))
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "gram": found.index.to_numpy().view(np.int64), "n": found.to_numpy().astype(np.int64)})

    return run


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", depth: int = 4, least: int = 8, sample_bytes: int = 6_000_000) -> dict[str, list]:
    """Counts of the context trees, per language.

    Each language is learned from whole texts drawn by a hash of their id, in expectation
    `sample_bytes` code points (all texts where there are fewer). So trees, and what is broadcast, are
    bounded by the number of languages x depth x sample_bytes / least contexts, whatever the input.
    Rows with null text or language teach nothing.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    sizes = rows.groupBy("_lang").agg(F.sum(F.length("_text")).alias("n")).collect()
    if not sizes:
        return {}
    drawn = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("language")), F.lit(1 << 30))
    share = F.lit(0)
    for r in sizes:
        share = F.when(F.col("_lang") == r["_lang"], F.lit(int((1 << 30) * min(1.0, sample_bytes / max(1, r["n"]))) + 1)).otherwise(share)
    found = rows.where(drawn < share).select("_text", "_lang").mapInArrow(_count(depth), "lang string, gram long, n long")
    total = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    out = {}
    for lang in sorted(pc.unique(total["lang"]).to_pylist()):
        one = total.filter(pc.equal(total["lang"], lang))
        out[lang] = levels_of(one["gram"].to_numpy().view(np.uint64), one["n"].to_numpy(), depth, least)
    return out


def _predict(model: Broadcast, keep: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        if "ready" not in held:
            held["ready"] = {k: Automaton(v, ppm) for k, v in held["levels"].items()}
        langs, trees = list(held["ready"]), list(held["ready"].values())
        for batch in small_batches(batches, "_text"):
            texts = batch.column("_text")
            symbols, starts = stream(_lowered(texts))
            known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if langs:
                bits = -np.stack([t.text_scores(symbols, starts) for t in trees])
                best = bits.argmin(axis=0)
                score = 1 / np.exp2(np.maximum(bits.min(axis=0) - bits, -1000)).sum(axis=0)
                length = bits.min(axis=0)
            else:
                known[:] = False
                best, score, length = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            names = np.array([*langs, UNKNOWN], object)[np.where(known, best, -1)]
            cols = {name: batch.column(k) for name, k in keep.items()}
            yield pa.RecordBatch.from_pydict(
                cols | {"lang_pred": pa.array(names, pa.string()), "score": np.where(known, score, 0.0), "code_bits": np.where(known, length, 0.0)}
            )

    return run


def identify(docs: DataFrame, model: dict[str, list], id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: id, the columns named in `carry`, lang_pred, score (0 to 1), code_bits.

    Every whole text is scored under each language's context tree with frozen statistics: code_bits is
    the exact code length under the best tree, score that language's share of the probability, with
    equal priors; equal code lengths go to the first language by name. A text that is null or has no
    letter, and any text where nothing was learned, is `und` with score 0. No shuffle. An empty
    table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"levels": model})
    others = [k for k in carry or [] if k != text_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *others)
    keep = {"_id": "_id"} | {k: "_text" if k == text_col else k for k in carry or []}  # a text goes to Python once and back once
    schema = StructType([StructField(name, rows.schema[k].dataType) for name, k in keep.items()] + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("code_bits", DoubleType())])
    return rows.mapInArrow(_predict(shared, keep), schema).withColumnRenamed("_id", id_col)


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % parts == part
