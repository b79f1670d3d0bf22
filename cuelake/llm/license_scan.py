"""Licence notices in texts: matching statistics from a generalised suffix automaton, chained to template spans."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuelake.llm.contexts import small_batches
from cuelake.llm.license_texts import PHRASES, TEMPLATES
from cuelake.llm.words import ranges, text_bytes, words_of

#: Bytes that stand between words: all of ASCII but digits and letters.
BREAKS = np.ones(256, bool)
BREAKS[128:] = False
BREAKS[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
#: Bytes at which a text that isn't lower-cased yet can be cut.
CUTS = BREAKS.copy()
CUTS[0x41:0x5B] = False
#: Bytes of a text whose words are sought at once.
PIECE = 1 << 21
OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, license_spans string"

Texts = tuple[tuple[str, str], ...]


class Automaton:
    """The suffix automaton of several word sequences: a state stands for words that end at the same places of them.

    `goto` and `limit` have a row for each state and a column for each known word. After words that
    match m back to their beginning, word w leads to goto[state, w] with min(m, limit[state, w]) + 1
    words matched; that is the longest end of the text so far that stands in some sequence.
    """

    def __init__(self, sequences: list[list[str]]):
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        self.size, self.link, self.next = [0], [-1], [{}]
        self.places: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._add(last, self.vocabulary[w])
                self.places[last].add((k, i))
        self.longest = max(self.size)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for v in reversed(order):
            if self.link[v]:
                self.places[self.link[v]] |= self.places[v]
        unknown = len(self.vocabulary)
        self.goto = np.zeros((len(self.size), unknown + 1), np.int32)
        self.limit = np.full((len(self.size), unknown + 1), -1, np.int32)
        for v in [0, *order]:
            if v:
                self.goto[v], self.limit[v] = self.goto[self.link[v]], self.limit[self.link[v]]
            for w, to in self.next[v].items():
                self.goto[v, w], self.limit[v, w] = to, self.size[v]

    def _add(self, last: int, w: int) -> int:
        """The state of the sequence so far and w."""
        if w in self.next[last]:
            to = self.next[last][w]
            return to if self.size[to] == self.size[last] + 1 else self._split(last, w, to)
        new = self._state(self.size[last] + 1, 0, {})
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last >= 0:
            to = self.next[last][w]
            self.link[new] = to if self.size[to] == self.size[last] + 1 else self._split(last, w, to)
        return new

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(following)
        self.places.append(set())
        return len(self.size) - 1

    def _split(self, last: int, w: int, to: int) -> int:
        """A state for the shorter words of `to`, which now end at more places than its longer ones."""
        new = self._state(self.size[last] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = new
        while last >= 0 and self.next[last].get(w) == to:
            self.next[last][w] = new
            last = self.link[last]
        return new

    def ends(self, words: list[str]) -> tuple[int, np.ndarray]:
        """The state in which `words` are, and for every state whether all its words end in them."""
        v = 0
        for w in words:
            v = self.next[v][self.vocabulary[w]]
        below = np.zeros(len(self.size), bool)
        for u in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            below[u] = self.link[u] == v or below[self.link[u]]
        return v, below

    def matched(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of texts with `counts` words: for each word the state and how many words match back from it.

        Unknown words end all matches, so runs of known words are read beside each other. A long run is
        read in parts, each from `longest` words before: no match goes further back.
        """
        states, lengths = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
        known = ids < len(self.vocabulary)
        first = known.copy()
        first[1:] &= ~known[:-1]
        starts = (np.cumsum(counts) - counts)[counts > 0]
        first[starts] = known[starts]
        begins = np.flatnonzero(first)
        if not len(begins):
            return states, lengths
        stops = np.flatnonzero(known & np.append(~known[1:] | first[1:], True)) + 1
        step = 4 * self.longest
        parts = -(-(stops - begins) // step)
        begin = np.repeat(begins, parts)
        own = begin + step * ranges(np.zeros(len(parts), np.int64), parts)
        stop = np.minimum(own + step, np.repeat(stops, parts))
        begin = np.maximum(begin, own - self.longest)
        order = np.argsort(begin - stop, kind="stable")
        begin, own, stop = begin[order], own[order], stop[order]
        span = stop - begin
        state, length = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        for t in range(int(span[0])):
            n = int(np.searchsorted(-span, -t))  # those that have more words than t
            at = begin[:n] + t
            w = ids[at]
            length[:n] = np.minimum(length[:n], self.limit[state[:n], w]) + 1
            state[:n] = self.goto[state[:n], w]
            mine = at >= own[:n]
            states[at[mine]], lengths[at[mine]] = state[:n][mine], length[:n][mine]
        return states, lengths


@dataclass
class Span:
    """Words first to last (from 0) of a text that chained matches cover as `label` for `share` of its template."""

    first: int
    last: int
    label: str
    covered: int
    share: float


class Scanner:
    def __init__(self, templates: Texts, phrases: Texts, least: int, gap: int, share: float):
        self.least, self.gap, self.share = least, gap, share
        self.labels, self.phrase_labels = [x for x, _ in templates], [x for _, x in phrases]
        texts = [t for _, t in templates] + [p for p, _ in phrases]
        split = words_of(pa.array(texts), BREAKS)
        sequences = [[w.decode() for w in split.of(k)] for k in range(len(texts))]
        self.automaton = Automaton(sequences)
        self.lengths = [len(x) for x in sequences]
        self.phrases = [(len(x), *self.automaton.ends(x)) for x in sequences[len(templates) :]]
        hashes = words_of(pa.array(list(self.automaton.vocabulary)), BREAKS).hashes
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Known words' numbers in order (others: one past the last), and how many words each text has."""
        data, at = text_bytes(texts)
        if len(data) > 2 * PIECE and len(texts) == 1:
            cuts = [0]
            while len(data) - cuts[-1] > PIECE:
                cut = next((a + int(np.argmax(x)) for a in range(cuts[-1] + PIECE, len(data), PIECE) if (x := CUTS[data[a : a + PIECE]]).any()), None)
                if cut is None:
                    break
                cuts.append(cut)
            if len(cuts) > 1:
                parts = [self.ids(pa.array([data[a:b].tobytes().decode("utf-8")])) for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
                return np.concatenate([x for x, _ in parts]), np.array([sum(int(n[0]) for _, n in parts)])
        words = words_of(texts, BREAKS)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hashes, self.order[at], len(self.hashes)).astype(np.int32), words.counts

    def chains(self, ends: np.ndarray, states: np.ndarray, lengths: np.ndarray) -> list[Span]:
        """Spans of one text from its long matches: their last words, states and lengths, in order.

        A match may follow another of the same template where both text and template go on, with
        `gap` words or fewer between them in either. Of the chains the one that covers most is taken,
        then the next one that stands beside it, and so on.
        """
        anchors: list[tuple[float, int, int, int, int]] = []  # covered, first word, last word, template, number of the one before
        recent: dict[int, list[tuple[int, int, int]]] = {}
        for i, v, m in zip(ends.tolist(), states.tolist(), lengths.tolist(), strict=True):
            for k, e in sorted(self.automaton.places[v]):
                if k >= len(self.labels):
                    continue
                near = recent[k] = [x for x in recent.get(k, []) if x[0] >= i - m - self.gap]
                best = (m, i - m + 1, i, k, -1)
                for last, place, number in near:
                    if last < i and place < e and e - m - place <= self.gap:
                        covered = anchors[number][0] + min(m, i - last, e - place)
                        if covered > best[0]:
                            best = (covered, anchors[number][1], i, k, number)
                near.append((i, e, len(anchors)))
                anchors.append(best)
        found: list[Span] = []
        for covered, first, last, k, _ in sorted(anchors, key=lambda x: (-x[0], -x[0] / self.lengths[x[3]], x[1], x[3])):
            at = bisect_left(found, first, key=lambda s: s.first)
            if (not at or found[at - 1].last < first) and (at == len(found) or last < found[at].first):
                found.insert(at, Span(first, last, self.labels[k], covered, min(1.0, covered / self.lengths[k])))
        return found

    def scan(self, texts: pa.Array) -> list[tuple]:
        ids, counts = self.ids(texts)
        states, lengths = self.automaton.matched(ids, counts)
        starts = np.cumsum(counts) - counts
        hits = [np.flatnonzero(below[states] | ((states == own) & (lengths >= n))) - n + 1 for n, own, below in self.phrases]
        long = lengths >= self.least
        long[:-1] &= lengths[1:] != lengths[:-1] + 1  # a match that goes on is part of the longer one
        places = np.flatnonzero(long)
        text_of = lambda at: np.searchsorted(starts + counts, at, side="right")
        base: dict[int, list[tuple[int, str]]] = {}
        for at, label in zip(hits, self.phrase_labels, strict=True):
            for d, x in zip(text_of(at).tolist(), at.tolist(), strict=True):
                base.setdefault(d, []).append((x - int(starts[d]), label))
        of = text_of(places)
        bounds = np.searchsorted(of, np.arange(len(counts) + 1))
        out = []
        for d, n in enumerate(counts.tolist()):
            mine = places[bounds[d] : bounds[d + 1]]
            spans = self.chains(mine - starts[d], states[mine], lengths[mine]) if len(mine) else []
            own = base.get(d, [])
            score = 1.0 if own else max((s.share for s in spans), default=0.0)
            spans = [s for s in spans if s.share >= self.share]
            labels = {x for _, x in own}
            out.append((
                n, len(own), min(own)[0] if own else None, max(own)[0] if own else None, ",".join(sorted(labels)),
                ",".join(sorted(labels | {s.label for s in spans})), score, ",".join(f"{s.label}:{s.first}:{s.last}:{s.covered}" for s in spans),
            ))
        return out


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, least: int = 4, gap: int = 12, share: float = 0.6) -> DataFrame:
    """doc_id and what each whole text of `docs` (doc_id, text) says about its licence.

    n_words; n_base, first_word, last_word, base_labels: places of `phrases`; license_spans: parts that
    are a template for `share` of its words, as label:first:last:covered words; labels: of both;
    score: the largest share of a template, 1 where a phrase stands.

    Words are runs of letters and digits, A-Z lower-cased; characters beyond ASCII are letters. Matches
    of `least` words count. One row for each row of docs, also where doc_id is null or repeated; null
    and empty texts have no words and score 0. No shuffle; a text of any length is read in pieces, of
    which only the words' numbers are kept. Other columns are not looked at.
    """
    given = tuple(map(tuple, templates)), tuple(map(tuple, phrases)), least, gap, share
    names = [x.split()[0] for x in OUT.split(", ")]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*given)  # some hundredths of a second
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        for batch in small_batches(batches, "text"):
            rows = scanner.scan(batch.column("text"))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, {OUT}")
