"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.bitmap import bitmap_of, bits_for, marked
from cuelake.staging import written

def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, filter_bits: int | None = None, digest_col: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept; and SHA-256 of the text in hex as `digest_col`, if named.

    Texts are equal when identical after `normalised`; of equal texts the row with the smallest id
    stays. Lengths come first, then a 64-bit hash of the first `prefix` characters within lengths
    that repeat, then SHA-256 of whole texts of the (length, prefix hash) groups that still have
    several rows. Which rows are hashed is decided beside the scan by a bitmap of `filter_bits` bits
    (by default sixteen for each group, 32 MB broadcast at most); a false hit costs one hash more.

    Only narrow rows are shuffled, each step counts before the exchange, and the joins back are
    sort-merge joins between written tables, whose hot keys adaptive execution can split.

    Null text counts as empty; empty texts are equal to each other. Rows with a null id group like
    others, but stay only if all ids of their group are null. Rows that repeat an id with an equal
    text are one document: they share its decision and all count in group_size. An empty table gives
    no rows. Other columns are ignored. With `digest_col` all texts are hashed, in the first scan.
    """
    text = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    keyed = text.withColumns({"_len": F.length("_text"), "_prefix": F.xxhash64(F.substring("_text", 1, prefix))})
    sha = F.unhex(F.sha2("_text", 256)).alias("_sha")
    keys = written(keyed.select("_id", "_len", "_prefix", *([sha] if digest_col else [])), "dedup-keys")

    lengths = keys.groupBy("_len").agg(F.count("*").alias("n")).where("n > 1")
    same_length = keys.join(written(lengths, "dedup-lengths").select("_len"), "_len", "left_semi")
    suspects = written(same_length.groupBy("_len", "_prefix").agg(F.count("*").alias("n")).where("n > 1"), "dedup-suspects")
    filter_bits = filter_bits or bits_for(suspects.count())
    key = F.xxhash64("_len", "_prefix")
    bitmap = bitmap_of(suspects, key, filter_bits)

    hashed = marked(keys if digest_col else keyed, key, bitmap, filter_bits).where("_marked")
    hashed = written(hashed.select("_id", "_len", "_sha" if digest_col else sha), "dedup-hashes")
    groups = hashed.groupBy("_len", "_sha").agg(F.count("*").alias("group_size"), F.min("_id").alias("keep_id")).where("group_size > 1")
    groups = written(groups, "dedup-groups")

    alone = marked(keys, key, bitmap, filter_bits).where(~F.col("_marked"))
    digest = [F.lower(F.hex("_sha")).alias(digest_col)] if digest_col else []
    alone = alone.select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *digest)
    found = hashed.join(groups, ["_len", "_sha"], "left").select(
        "_id",
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        *digest,
    )
    out = alone.unionByName(found)
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), *([digest_col] if digest_col else []))
