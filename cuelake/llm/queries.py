"""The registered queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.ball_tree import clustered
from cuelake.llm.bpe import bpe_encode
from cuelake.llm.decontaminate import contained_items
from cuelake.llm.exact_dedup import exact_dedup
from cuelake.llm.jaccard_join import near_duplicates
from cuelake.llm.language_id import held_out, identify
from cuelake.llm.language_id import train as train_languages
from cuelake.llm.license_scan import license_scan
from cuelake.llm.line_dedup import line_dedup
from cuelake.llm.pii import sanitise
from cuelake.llm.prefix_trie import conversation_trie
from cuelake.llm.quality import quality_score
from cuelake.llm.suffix_tree import lm_score
from cuelake.llm.token_output import read_tokens, token_folder, write_tokens
from cuelake.staging import table

Query = Callable[[SparkSession, str], DataFrame]


def job(spark: SparkSession) -> SparkSession:
    """These queries' own setting of the session: texts go to Python some two thousand rows at a time, as ten thousand whole ones are too much for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def op1_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = line_dedup(table(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = train_languages(docs.where(~held_out("doc_id", 4, 2)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "code_bits")


def op3_quality(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").where(~held_out("doc_id", 5, 0))
    out = quality_score(table(spark, d, "documents").select("doc_id", "text"), labels)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_output(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    path = token_folder(spark)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        write_tokens(table(spark, d, "documents"), path, f.read(), end=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    out = near_duplicates(table(spark, d, "documents"), width=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "class_id")


def op6_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup(table(spark, d, "documents"), digest_col="text_sha256")


def op7_lm_score(spark: SparkSession, d: str) -> DataFrame:
    out = lm_score(table(spark, d, "documents"), ~held_out("doc_id", 5, 1))
    return out.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_pii(spark: SparkSession, d: str) -> DataFrame:
    out = sanitise(table(spark, d, "documents"), with_text=False)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        out = bpe_encode(table(spark, d, "documents"), f.read(), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return contained_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return conversation_trie(table(spark, d, "conversations"))


def op12_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan(table(spark, d, "documents"))


def op13_ball_tree(spark: SparkSession, d: str) -> DataFrame:
    return clustered(table(spark, d, "embeddings"))


OP1_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, i, lines[i] AS line,
                 translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
often AS (SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, line, coalesce(keep <> doc_id, false) AS gone FROM lines LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM grams JOIN items USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles::DOUBLE AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared * 100 >= 80 * n_shingles
"""

OP6_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

#: CRC-32 by its bitwise rule, as DuckDB has no such function.
OP11_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, strlen(text) AS bytes, sha256(strlen(role) || ':' || role || text) AS key FROM t),
o AS (SELECT conv_id, list({'key': key, 'bytes': bytes} ORDER BY turn NULLS FIRST, key) AS own FROM k GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 5 AS head,
             xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                             lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h FROM o),
r AS (SELECT a.conv_id, coalesce(b.own[1:a.h], []) || a.own[a.h + 1:] AS turns FROM h a LEFT JOIN o b ON b.conv_id = a.head),
p AS (SELECT conv_id, d AS depth, list_transform(turns[1:d], lambda x: x.key) AS path, turns[d].bytes AS bytes, len(turns) = d AS ends
      FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(bytes), 0) AS bytes,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
sums AS (SELECT path[1:d] AS path, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
         FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path AND s.depth = n.depth
LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.path = n.path[1:n.depth - 1]
"""

_NEAREST = """
a{i} AS (SELECT vec_id, v, arg_min(k, d * 16 + k) AS k, min(d)::BIGINT AS distance
         FROM (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{i}) GROUP BY vec_id, v),"""
_MOVED = """
s{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY k, j),
m{i} AS (SELECT k, list((CASE WHEN s < 0 THEN -((n - 1 - s) // n) ELSE s // n END)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY k),
c{j} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k)),"""
OP13_SQL = (
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16)),"""
    + "".join(_NEAREST.format(i=i) + _MOVED.format(i=i, j=i + 1) for i in range(3))
    + _NEAREST.format(i=3).rstrip(",")
    + """
SELECT vec_id, a3.k::INTEGER AS "cluster", distance, sum(distance) OVER (PARTITION BY a3.k)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (k)
"""
)


def queries() -> dict[str, Query]:
    return {name: lambda spark, d, query=query: query(job(spark), d) for name, query in _QUERIES.items()}


_QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_token_output": op4_token_output,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_pii": op8_pii,
    "op9_bpe": op9_bpe,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_license_scan": op12_license_scan,
    "op13_ball_tree": op13_ball_tree,
}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op10_decontamination": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_ball_tree": OP13_SQL}
