"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cuelake.llm.contexts import small_batches, trimmed
from cuelake.llm.words import ranges

#: For short pieces (positions fit in 16 bits). One token-position row per byte at first, each with the next
#: row's place and token; each round joins these with the merges and contracts the leftmost pair of the lowest
#: rank of each piece, until none has a pair. A piece's last round is its result.
ENCODE = """
WITH RECURSIVE step(round, piece, pos, nxt, token, other) AS MATERIALIZED (
    SELECT 0, piece, pos, nxt, token, lead(token) OVER (PARTITION BY piece ORDER BY pos) FROM bytes_of_pieces
  UNION ALL
    (WITH lowest AS (SELECT s.piece, min((m.rank::BIGINT << 32) + (s.pos << 16) + s.nxt) AS turn
                     FROM step s JOIN pairs m ON m.both = (s.token::BIGINT << 32) + s.other GROUP BY s.piece),
     chosen AS (SELECT l.piece, CAST((l.turn >> 16) & 65535 AS INT) AS pos, CAST(l.turn >> 32 AS INT) AS rank, q.pos AS gone, q.nxt AS after, q.other
                FROM lowest l JOIN step q ON q.piece = l.piece AND q.pos = l.turn & 65535)
     SELECT round + 1, s.piece, s.pos, CASE WHEN s.pos = c.pos THEN c.after ELSE s.nxt END, CASE WHEN s.pos = c.pos THEN c.rank ELSE s.token END,
            CASE WHEN s.pos = c.pos THEN c.other WHEN s.nxt = c.pos THEN c.rank ELSE s.other END
     FROM step s JOIN chosen c ON c.piece = s.piece WHERE s.pos <> c.gone)
)
SELECT piece, token FROM step JOIN (SELECT piece, max(round) AS round FROM step GROUP BY piece) USING (piece, round) ORDER BY piece, pos
"""
#: For long pieces, where keeping every round would take too much memory: rows are updated by key, and
#: only changes are kept. A pair is contracted as soon as no other within {reach} bytes ranks lower: what
#: merges before it can only come near it as one growing token, and no token that the piece has is half as long as {reach}. So a
#: round contracts pairs all along a piece. Of pairs of the same rank that overlap one after the other
#: (a run) every second one is, once the whole run may. Where a merge with the new token ranks lower than
#: that token itself (lone), only the first of its rank nearby is. Rows that a contraction takes away get
#: token -1.
ENCODE_LONG = """
WITH RECURSIVE step(piece, pos, nxt, token) USING KEY (piece, pos) AS (
    SELECT piece, pos, nxt, token FROM bytes_of_pieces
  UNION
    (WITH now AS (SELECT r.* FROM recurring.step r SEMI JOIN step s ON s.piece = r.piece WHERE r.token >= 0),
     pairs AS (SELECT a.piece, a.pos, b.pos AS gone, b.nxt AS after, m.rank
               FROM now a JOIN now b ON b.piece = a.piece AND b.pos = a.nxt JOIN merges m ON m.lhs = a.token AND m.rhs = b.token),
     near AS (SELECT *, min(rank) OVER (PARTITION BY piece ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS low,
                     coalesce(lag(gone) OVER w = pos AND lag(rank) OVER w = rank, false) AS chained,
                     coalesce(pos - lag(pos) OVER (PARTITION BY piece, rank ORDER BY pos) > {reach}, true) AS alone
              FROM pairs WINDOW w AS (PARTITION BY piece ORDER BY pos)),
     runs AS (SELECT *, sum(CASE WHEN chained THEN 0 ELSE 1 END) OVER (PARTITION BY piece ORDER BY pos) AS run FROM near),
     ready AS (SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY pos) AS k, min(low) OVER (PARTITION BY piece, run) AS lowest FROM runs),
     chosen AS (SELECT piece, pos, gone, after, rank FROM ready WHERE lowest = rank AND k % 2 = 1 AND (alone OR rank NOT IN (SELECT token FROM lone)))
     SELECT s.piece, s.pos, coalesce(c.after, s.nxt), CASE WHEN g.gone IS NOT NULL THEN -1 ELSE coalesce(c.rank, s.token) END
     FROM now s LEFT JOIN chosen c ON c.piece = s.piece AND c.pos = s.pos LEFT JOIN chosen g ON g.piece = s.piece AND g.gone = s.pos
     WHERE c.pos IS NOT NULL OR g.gone IS NOT NULL)
)
SELECT piece, token FROM step WHERE token >= 0 ORDER BY piece, pos
"""
LONG, SHORT = 48, 12
#: Of DuckDB; pieces and texts are given more by the rows that they make, so one of very many bytes as much as it needs.
MEMORY_MB = 64
#: Rows of all rounds that pieces given to `ENCODE` together may make, and ids given to `DECODE` together (one text at least).
ROWS, IDS = 1_200_000, 500_000
#: A space after other white space. Without one, a text can be cut before each of its spaces, as no
#: piece goes on across it: pieces hold white space only, or one space and then none.
SPACED = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
#: Bytes stand as the characters of the same number.
DECODE = "SELECT doc, string_agg(text, '' ORDER BY pos) AS text FROM ids JOIN tokens USING (token) GROUP BY doc ORDER BY doc"


def _cuts(sizes: np.ndarray, most: int) -> np.ndarray:
    """Where to cut a list so that the sizes of each part add up to about `most`, or to that of one element."""
    part = (np.cumsum(sizes) - sizes // 2) // most
    return np.flatnonzero(np.diff(part)) + 1


class Bpe:
    """Ranks and merges in a DuckDB database of the task, with pieces already encoded at hand."""

    def __init__(self, ranks: bytes, pattern: str, most: int = 300_000):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.find, self.most = regex.compile(pattern).findall, most
        self.rare = sorted((t for t in self.ranks if len(t) > SHORT), key=len, reverse=True)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        rows = ((self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks)
        lhs, rhs, rank = np.fromiter((x for row in rows for x in row), np.int32).reshape(-1, 3).T
        self._table("merges", lhs=lhs, rhs=rhs, rank=rank)
        self._table("pairs", both=(lhs.astype(np.int64) << 32) + rhs, rank=rank)
        self._table("lone", token=np.unique(np.concatenate((lhs[rank < lhs], rhs[rank < rhs]))))
        names = [t.decode("latin-1") for t in self.ranks]
        self.db.register("given", pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "text": pa.array(names)}))
        self.db.execute("CREATE TABLE tokens AS FROM given")
        self.clear()

    def _table(self, name: str, **columns: np.ndarray) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM given")

    def _allow(self, more: int) -> None:
        self.db.execute(f"SET memory_limit = '{MEMORY_MB + more}MB'")

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.hits = np.zeros(0, bool)

    def make_room(self) -> None:
        """Holds on to what a later batch had again, if that is little; most of the pieces never are."""
        kept = np.flatnonzero(self.hits)
        if len(kept) > self.most // 2 or self.lengths[kept].sum() > 6 * self.most:
            return self.clear()
        names = np.array(list(self.place), object)[kept]
        self.flat, self.lengths = self.flat[ranges(self.starts[kept], self.lengths[kept])], self.lengths[kept]
        self.starts, self.hits = np.cumsum(self.lengths) - self.lengths, np.zeros(len(kept), bool)
        self.place = dict(zip(names.tolist(), range(len(kept)), strict=True))

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, and how many each has. A piece that is a token is that token."""
        data = [p.encode() for p in pieces]
        whole = np.array([self.ranks.get(d, -1) for d in data], np.int32)
        sizes = np.array([len(d) for d in data], np.int64)
        counts = np.ones(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        groups = {ENCODE: np.flatnonzero((whole < 0) & (sizes <= LONG))}
        for i in np.flatnonzero((whole < 0) & (sizes > LONG)).tolist():  # pieces that have no very long token reach less far
            longest = next((len(t) for t in self.rare if t in data[i]), SHORT)
            groups.setdefault(ENCODE_LONG.format(reach=2 * longest + 1), []).append(i)
        for query, rest in ((k, np.array(v, np.int64)) for k, v in groups.items()):
            rows = sizes[rest] * (sizes[rest] + 1) // 2 if query is ENCODE else np.full(len(rest), ROWS // 100)
            for some in np.split(rest, _cuts(rows, ROWS)):
                pos = ranges(np.zeros(len(some), np.int64), sizes[some]).astype(np.int32)
                token = self.bytes[np.frombuffer(b"".join(data[i] for i in some), np.uint8)]
                self._table("bytes_of_pieces", piece=np.repeat(some, sizes[some]).astype(np.int32), pos=pos, nxt=pos + np.int32(1), token=token)
                made = int((sizes[some] * (sizes[some] + 1)).sum()) // 50_000 if query is ENCODE else 136 + int(sizes[some].sum()) // 500
                self._allow(made)
                got = self.db.sql(query).to_arrow_table()
                counts[some] = np.bincount(got["piece"].to_numpy(), minlength=len(pieces))[some]
                parts.append((some, got["token"].to_numpy()))
        flat = np.empty(int(counts.sum()), np.int32)
        starts = np.cumsum(counts) - counts
        flat[starts[whole >= 0]] = whole[whole >= 0]
        for some, tokens in parts:
            flat[ranges(starts[some], counts[some])] = tokens
        return flat, counts

    def _hold(self, strings: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.place.update(zip(strings, range(len(self.lengths), len(self.lengths) + len(strings)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.lengths, self.flat = np.concatenate((self.lengths, lengths)), np.concatenate((self.flat, flat))
        self.hits = np.concatenate((self.hits, np.zeros(len(strings), bool)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        texts = pc.fill_null(texts, "")
        apart = pc.match_substring_regex(texts, SPACED)
        whole = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
        lists = pc.if_else(apart, whole, pc.split_pattern(texts, " "))
        owner, coded = pc.list_parent_indices(lists).to_numpy(), lists.flatten().dictionary_encode()
        inner = np.concatenate(([False], owner[1:] == owner[:-1])) if len(owner) else np.zeros(0, bool)
        keys, back = np.unique(coded.indices.to_numpy().astype(np.int64) * 2 + inner, return_inverse=True)
        words = coded.dictionary.take(pa.array(keys >> 1))
        chunks = pc.if_else(pa.array(keys & 1 == 1), pc.binary_join_element_wise("", words, " "), words).to_numpy(zero_copy_only=False).tolist()
        if len(self.place) > self.most or len(self.flat) > 12 * self.most:
            self.make_room()
        before = len(self.lengths)
        at = list(map(self.place.get, chunks))
        blank = [i for i, x in enumerate(at) if x is None]
        if blank:
            new = [chunks[i] for i in blank]
            found = [self.find(c) for c in new]
            pieces = list(dict.fromkeys(p for x in found for p in x if p not in self.place))
            self._hold(pieces, *self.merged(pieces))
            several = [i for i, x in enumerate(found) if len(x) != 1]
            inside = np.array([self.place[p] for i in several for p in found[i]], np.int64)
            sizes = np.bincount(np.repeat(np.arange(len(several)), [len(found[i]) for i in several]), self.lengths[inside], len(several)).astype(np.int64)
            self._hold([new[i] for i in several], self.flat[ranges(self.starts[inside], self.lengths[inside])], sizes)
            for i, c in zip(blank, new, strict=True):
                at[i] = self.place[c]
        at = np.array(at, np.int64)
        self.hits[at[at < before]] = True
        at = at[back]
        lengths = self.lengths[at]
        return self.flat[ranges(self.starts[at], lengths)], np.bincount(owner, lengths, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, from its ids alone."""
        out = [b""] * len(counts)
        ends = np.cumsum(counts)
        for docs in np.split(np.arange(len(counts), dtype=np.int32), _cuts(counts, IDS)):
            own = ids[ends[docs[0]] - counts[docs[0]] : ends[docs[-1]]] if len(docs) else ids[:0]
            self._table("ids", doc=np.repeat(docs, counts[docs]), pos=np.arange(len(own), dtype=np.int32), token=own.astype(np.int32))
            self._allow(len(own) // 5_000)
            for d, text in self.db.sql(DECODE).fetchall():
                out[d] = text.encode("latin-1")
        return out


def _run(shared, decode: bool, batch_bytes: int = 2 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "ready" not in held:
            held["ready"] = Bpe(held["ranks"], held["pattern"], held["most"])
        bpe = held["ready"]
        for batch in small_batches(batches, "_text", batch_bytes):
            ids, counts = bpe.encode(batch.column("_text"))
            data, ends = ids.astype("<u4"), np.cumsum(counts)
            columns = {"_id": batch.column("_id"), "n_tokens": pa.array(counts)}
            columns["ids"] = pa.array([data[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)], pa.binary())
            if decode:
                columns["decoded"] = pa.array(bpe.decode(ids, counts), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
            del ids, counts, data, ends, columns
            trimmed()

    return run


def bpe_encode(
    docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, batch_bytes: int = 2 << 20, pieces: int = 300_000
) -> DataFrame:
    """One row per input row: id, n_tokens, ids (little-endian, four bytes each) and, if asked, decoded
    (the bytes that the ids stand for).

    ranks: the content of a rank file (base64 of a token, its rank); pattern: what cuts a text into
    pieces that are merged apart. `batch_bytes` of text at a time and `pieces` held at hand bound a worker's
    memory, for some more time if they are smaller. Whole texts are encoded where they are, nothing is shuffled. Pieces
    are encoded once while a worker holds them; DuckDB sees those that are new, some ten thousand at
    a time, and has one thread and a memory limit, which grows with a very long piece.

    Null text counts as empty and has no ids. A piece of a megabyte takes some two gigabytes.
    Rows that repeat are encoded alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks, "pattern": pattern, "most": pieces})
    rows = docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text")
    schema = f"_id {dict(rows.dtypes)['_id']}, n_tokens long, ids binary" + ", decoded binary" * decode
    return rows.mapInArrow(_run(shared, decode, batch_bytes), schema).withColumnRenamed("_id", id_col)
