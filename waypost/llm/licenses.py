"""Licence wordings in documents: which, where, and how much of them.

All templates are put into one generalised suffix automaton over word ids. A
document streams through it; at every word the automaton's state says how long
a piece of some template ends there (the matching statistics). A piece that
cannot go on is a match, and from ``MIN_MATCH`` words on an anchor at each place
of a template that holds it. Anchors that follow each other in document and
template, at most ``MAX_GAP`` words apart, are chained; a chain that covers
``MIN_SHARE`` of its template is a span. Where spans of several templates lie
over each other the one with most covered words counts, then the one that covers
most of its template.

Words are runs of digits, letters a to z in either case, and all characters
outside ASCII. Only stretches of words that follow each other in this way in
some template are put through the automaton: no match can lie elsewhere. Work is
done where the documents are, without a shuffle, in batches of bounded size; a
text is taken whole, whatever its length.

Null and empty texts have no words and no labels. Repeated rows and equal ids
give a row each, a null id stays null, an empty table gives none, and columns of
the input other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import pieces
from .license_texts import PHRASES, TEMPLATES

#: Words of a match that counts, words that may lie between two, share of a template that makes a span.
MIN_MATCH, MAX_GAP, MIN_SHARE = 5, 40, 0.5
#: With so many matched words a document's score is one half.
HALF_WORDS = 10

_OTHER = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_CUT = bytes.maketrans(_OTHER, b" " * len(_OTHER))
#: No byte of UTF-8; stands between the documents of a batch.
_END = b"\xff"

SPAN = "struct<label: string, template: string, first_word: long, last_word: long, covered: long, share: double>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("template", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])))]
)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_CUT).split()


class Automaton:
    """The generalised suffix automaton of sequences of word ids.

    ``places(state)`` are all (sequence, end) at which the pieces of a state end.
    """

    def __init__(self, sequences: Sequence[Sequence[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self._ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self._ends[last].add((k, at))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self._ends[self.link[state]] |= self._ends[state]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self._ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the pieces that come from ``state`` and shorter ones."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _fitting(self, state: int, word: int) -> int:
        """The state of exactly the pieces of ``state`` with ``word`` behind them."""
        target = self.next[state][word]
        return target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._fitting(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._fitting(last, word)
        return new

    def places(self, state: int) -> set[tuple[int, int]]:
        return self._ends[state]

    def statistics(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For every word the length of the longest piece that ends there, and its state."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield length, state

    def matches(self, words: Sequence[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, state) of the matches of ``least`` words or more that the next word does not prolong."""
        before = (0, 0)
        for at, (length, state) in enumerate(self.statistics(words)):
            if before[0] >= least and length != before[0] + 1:
                yield at - before[0], *before
            before = length, state
        if before[0] >= least:
            yield len(words) - before[0], *before


class Anchor(NamedTuple):
    start: int
    at: int  # in the template
    length: int


class Span(NamedTuple):
    template: int
    first: int
    last: int
    covered: int


def chains(anchors: list[Anchor]) -> list[tuple[int, int, int]]:
    """(first word, last word, covered template words) of chains of one template's anchors, best first, no anchor in two.

    A chain goes on with an anchor that ends later in document and template than
    the one before and starts at most ``MAX_GAP`` words behind its end in both;
    what overlaps counts once.
    """
    anchors = sorted(anchors)
    best: list[tuple[int, int]] = []  # covered words of the best chain up to here, and the anchor before
    low = 0
    reach = max((a.length for a in anchors), default=0) + MAX_GAP
    for k, a in enumerate(anchors):
        while anchors[low].start + reach < a.start:
            low += 1
        value, before = a.length, -1
        for j in range(low, k):
            b = anchors[j]
            gap, jump = a.start - (b.start + b.length), a.at - (b.at + b.length)
            new = a.length - max(0, -gap, -jump)
            if gap <= MAX_GAP and jump <= MAX_GAP and a.at > b.at and a.start > b.start and new > 0 and best[j][0] + new > value:
                value, before = best[j][0] + new, j
        best.append((value, before))
    used, out = [False] * len(anchors), []
    for k in sorted(range(len(anchors)), key=lambda k: (-best[k][0], anchors[k].start)):
        if used[k]:
            continue
        at, first = k, k
        while at >= 0 and not used[at]:
            used[at], first, at = True, at, best[at][1]
        covered = best[k][0] - (best[at][0] if at >= 0 else 0)
        out.append((anchors[first].start, anchors[k].start + anchors[k].length - 1, covered))
    return out


class Scanner:
    """Templates and phrases as word ids, ready to scan documents."""

    def __init__(self, templates: Sequence[tuple[str, str, str]], phrases: Sequence[tuple[str, str]]) -> None:
        self.templates, self.labels = templates, [label for _, label in phrases]
        texts = [words_of(t.encode()) for *_, t in templates]
        wanted = [words_of(p.encode()) for p, _ in phrases]
        self.ids: dict[bytes, int] = {}
        for words in [*texts, *wanted]:
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.ids[_END] = 0
        self.sequences = [[self.ids[w] for w in words] for words in texts]
        self.phrases = [[self.ids[w] for w in words] for words in wanted]
        self.automaton = Automaton(self.sequences)
        self._n = n = len(self.ids) + 1  # ids, the end, and one more for all other words
        self._pairs = np.zeros(n * n, dtype=bool)
        for s in self.sequences:
            self._pairs[np.array(s[:-1]) * n + np.array(s[1:])] = True

    def word_ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, documents parted by 0, and where each document ends."""
        get, other = self.ids.get, self._n - 1
        blob = b"".join(t.lower().translate(_CUT) + b" " + _END + b" " for t in texts)
        words = blob.split()
        ids = np.fromiter((get(w, other) for w in words), dtype=np.int64, count=len(words))
        return ids, np.flatnonzero(ids == 0)

    def phrase_places(self, ids: np.ndarray) -> list[np.ndarray]:
        out = []
        for phrase in self.phrases:
            n = max(len(ids) - len(phrase) + 1, 0)
            hit = np.ones(n, dtype=bool)
            for k, w in enumerate(phrase):
                hit &= ids[k : k + n] == w
            out.append(np.flatnonzero(hit))
        return out

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words in which every pair of neighbours stands in a template, ``MIN_MATCH`` words or more."""
        known = self._pairs[ids[:-1] * self._n + ids[1:]].astype(np.int8)
        edge = np.diff(known, prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        long = ends - starts >= MIN_MATCH
        return zip(starts[long].tolist(), ends[long].tolist(), strict=True)

    def spans(self, ids: np.ndarray, stretches: list[tuple[int, int]]) -> list[Span]:
        """Covered template spans of one document, in order; none overlaps another."""
        anchors: dict[int, list[Anchor]] = defaultdict(list)
        for start, end in stretches:
            for at, length, state in self.automaton.matches(ids[start:end].tolist(), MIN_MATCH):
                for template, last in self.automaton.places(state):
                    anchors[template].append(Anchor(start + at, last - length + 1, length))
        size = [len(s) for s in self.sequences]
        found = [Span(t, first, last, covered) for t, own in anchors.items() for first, last, covered in chains(own) if covered >= MIN_SHARE * size[t]]
        found.sort(key=lambda s: (-s.covered, -s.covered / size[s.template], s.first, s.template))
        taken = np.zeros(len(ids), dtype=bool) if found else None
        out = []
        for s in found:
            if not taken[s.first : s.last + 1].any():
                taken[s.first : s.last + 1] = True
                out.append(s)
        return sorted(out, key=lambda s: s.first)

    def scan(self, texts: list[bytes]) -> Iterator[tuple]:
        """A row for each text: all columns but doc_id."""
        ids, ends = self.word_ids(texts)
        begins = np.concatenate([[0], ends[:-1] + 1])
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if len(ids) > 1:
            for s, e in self.stretches(ids):
                own[int(np.searchsorted(ends, s))].append((s, e))
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, at in enumerate(self.phrase_places(ids)):
            for d, p in zip(np.searchsorted(ends, at).tolist(), at.tolist(), strict=True):
                places[d].append((p - int(begins[d]), k))
        for d, n in enumerate((ends - begins).tolist()):
            at = int(begins[d])
            spans = self.spans(ids[at : at + n], [(s - at, e - at) for s, e in own[d]]) if d in own else []
            yield self._row(n, sorted(places.get(d, ())), spans)

    def _row(self, n: int, places: list[tuple[int, int]], spans: list[Span]) -> tuple:
        base = {self.labels[k] for _, k in places}
        labels = base | {self.templates[s.template][0] for s in spans}
        matched, upto = sum(s.covered for s in spans), -1
        held = [(s.first, s.last) for s in spans]
        k = 0
        for start, phrase in places:  # words of phrases outside spans, each once
            for w in range(max(start, upto + 1), start + len(self.phrases[phrase])):
                while k < len(held) and held[k][1] < w:
                    k += 1
                matched += not (k < len(held) and held[k][0] <= w)
                upto = w
        listed = [
            {"label": self.templates[s.template][0], "template": self.templates[s.template][1], "first_word": s.first, "last_word": s.last, "covered": s.covered, "share": s.covered / len(self.sequences[s.template])}
            for s in spans
        ]
        first, last = (places[0][0], places[-1][0]) if places else (None, None)
        return n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), matched / (matched + HALF_WORDS), listed


@lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(templates, phrases)


def scan_licenses(documents: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """A row per document: word count, places of the phrases, labels, a score and the covered spans.

    ``templates`` are (label, name, text); they are sent to every task, so they
    are meant to be some hundreds of texts. The score is m / (m + ``HALF_WORDS``)
    for m words matched by spans and phrases.
    """
    templates, phrases = tuple(templates), tuple(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, phrases)
        for batch in batches:
            for part in pieces(batch, 1):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                columns = zip(*scanner.scan([t or b"" for t in texts]), strict=True)
                rest = [pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *rest], schema=_ARROW)

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
