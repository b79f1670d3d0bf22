"""A corpus pipeline: documents to token ids, in stages that are written and read again.

Every stage works on all that its predecessor kept. Documents are told apart by doc_id: rows that
repeat one stay or go together, and rows whose doc_id is null are never matched by another's, so only
the language stage can drop them. Empty tables go through every stage; further columns of documents
are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bitmap import bitmap_of, bits_for, marked
from cuelake.llm.bpe import bpe_encode
from cuelake.llm.decontaminate import contained_items
from cuelake.llm.exact_dedup import exact_dedup
from cuelake.llm.jaccard_join import near_duplicates
from cuelake.llm.language_id import UNKNOWN, identify, train
from cuelake.llm.queries import job
from cuelake.staging import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the ids of `gone` (one column, doc_id). Beside the scan a bitmap says which rows may go; these alone meet the ids."""
    gone = written(gone.distinct(), "gone")
    key, bits = F.xxhash64("doc_id"), bits_for(gone.count())
    rows = marked(docs.withColumn("_row", F.struct(*docs.columns)).select("doc_id", "_row"), key, bitmap_of(gone, key, bits), bits)
    kept = rows.where("_marked").join(gone, "doc_id", "left_anti").select("_row")
    return rows.where("NOT _marked").select("_row").unionByName(kept).select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those whose text is null or has no letter go.

    Trees are learned from the documents whose language is known. With no such document nothing can
    be told, and all texts with a letter stay.
    """
    model = train(docs)
    if not model:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = F.struct(*(c for c in docs.columns if c != "text"))
    out = identify(docs.select("doc_id", "text", others.alias("_row")), model, carry=["_row", "text"])
    return out.where(F.col("lang_pred") != UNKNOWN).select(*("text" if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document with the smallest id."""
    return _without(docs, exact_dedup(docs).where("NOT kept").select("doc_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links reach (five-word shingles, similarity 0.8), the one with the smallest id."""
    return _without(docs, near_duplicates(docs).where("component_id <> doc_id").select("doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (80 % of its five-word shingles)."""
    return _without(docs, contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, four bytes each) and digests of the ids and of what they decode to."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        out = bpe_encode(docs, f.read(), public_tokenizers.PATTERN, decode=True, batch_bytes=1 << 20, pieces=100_000)  # other stages' memory is there too
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _stage(run_stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: run_stage(job(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _stage(language)),
    ("exact_dedup", _stage(exact)),
    ("near_duplicates", _stage(near)),
    ("decontamination", _stage(decontaminated)),
    ("bpe", _stage(encoded)),
]

#: SQL has no PPM code lengths and no BPE merges; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
