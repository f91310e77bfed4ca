"""Language of whole texts: script ranges, per-word scores, Viterbi over words.

A word is a run of letters. Its script, by code point range, narrows the
languages to those that use the script in the training texts. Its score for a
language is the naive Bayes log likelihood of the word and its character
n-grams, relative to the best language and bounded, so that one odd word cannot
outweigh its surroundings. A Viterbi pass over all words of the text, with a
penalty for every change of language, labels each word; runs of one label are
the spans. The text's language has most letters in its spans, and its score is
their share of all letters, counting only words whose script some language uses.

Counts for the model come from a Spark aggregation over the labelled rows whose
hash falls into a fraction that bounds them at about ``SAMPLE_ROWS``. Each
language has a fraction of its own: one with few rows is learnt from all of
them, and no bound is below ``LEAST_ROWS``, so that every language is learnt
whatever the size of the corpus. The model has a fixed number of hashed features
and is what is sent to the tasks.

Defined cases: a null text or one without letters is ``und`` with score 0 and
no spans. Letters of scripts that no language uses score 0; a text with nothing
else gets the first language in code order with score 0. Ties go to the first
language. Without labelled rows every text is ``und``. Rows with a null doc_id
are never used for training and count as not held out. Very long texts are
labelled whole, by windows of words; repeated rows give a row each; an empty
table gives an empty result; columns of the input are kept, and those that the
operator adds can be named by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import pieces
from .words import mix64

#: Labelled rows that the model is fitted on, about.
SAMPLE_ROWS = 20_000
#: Rows of a language that are used in any case, about, if it has as many.
LEAST_ROWS = 200
_HASHES = 1 << 48
FEATURES = 1 << 17
GRAMS = (1, 2, 3, 4)
SWITCH = 12.0
FLOOR = -6.0
#: A language uses a script if it has this share of the language's letters.
SCRIPT_SHARE = 0.001
#: Words that one Viterbi window holds.
WINDOW = 256
_SLICE_BYTES, _SLICE_TEXTS = 2 << 20, 1000

# First code points of script ranges, in order, with their script.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x323B0, "other"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_FIRSTS = np.array([at for at, _ in SCRIPT_RANGES])
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@dataclass
class Words:
    """The words of a batch: which distinct word each is, and the distinct words' features."""

    distinct: np.ndarray  # of each word
    sizes: np.ndarray  # letters of each word
    counts: np.ndarray  # words of each text
    script: np.ndarray  # of each distinct word
    features: np.ndarray  # of all distinct words, one after another
    widths: np.ndarray  # features of each distinct word


def words_of(texts: list[str]) -> Words:
    joined = "\n".join(texts).lower() + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    edge = np.diff(letter.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.concatenate([[-1], np.flatnonzero(points == 10)])  # texts hold line ends themselves
    own = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    counts = np.diff(np.searchsorted(starts, breaks[np.concatenate([[0], np.cumsum(own)])], side="right"))
    sizes = ends - starts
    coded = mix64(points.astype(np.uint64) + np.uint64(1))
    # a word's hash is position-weighted from its start; equal words have equal hashes
    within = np.arange(len(points)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(points)]])))
    weighted = np.where(letter, mix64(coded + within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
    hashes = mix64(total[ends] - total[starts])
    kinds, first, distinct = np.unique(hashes, return_index=True, return_inverse=True)
    begin, size = starts[first], sizes[first]
    # the distinct words' letters, each word between two boundaries
    spread = size + 2
    offset = np.concatenate([[0], np.cumsum(spread)])
    place = np.arange(offset[-1]) - np.repeat(offset[:-1], spread)
    source = np.repeat(begin, spread) + place - 1
    inside = (place > 0) & (place < np.repeat(spread, spread) - 1)
    symbols = np.where(inside, coded[np.clip(source, 0, len(points) - 1)], np.uint64(0x51ED270B7A3C4F29))
    feature = [np.where(place == 0, kinds.repeat(spread), np.uint64(0))]  # the whole word
    valid = [place == 0]
    gram = np.zeros(len(symbols), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        earlier = np.concatenate([np.zeros(n - 1, np.uint64), symbols[: len(symbols) - n + 1]]) if n <= len(symbols) else np.zeros_like(symbols)
        gram = gram * np.uint64(0xD1342543DE82EF95) + earlier
        if n in GRAMS:
            feature.append(mix64(gram + np.uint64(n)))
            valid.append(place >= n - 1 if n > 1 else inside)
    feature, valid = np.stack(feature, 1), np.stack(valid, 1)
    widths = np.add.reduceat(valid.sum(1), offset[:-1]) if len(kinds) else np.zeros(0, np.int64)
    script = _SCRIPT_OF[np.searchsorted(_FIRSTS, points[begin], side="right") - 1]
    return Words(distinct, sizes, counts, script, (feature[valid] % np.uint64(FEATURES)).astype(np.int64), widths)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # features x languages
    uses: np.ndarray  # scripts x languages


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> per language the counts of features, and of scripts as features -1, -2, .."""
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for own in pieces(batch, 1, _SLICE_BYTES, _SLICE_TEXTS):
            by: dict[str, list[str]] = {}
            for lang, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text or "")
            for lang, texts in by.items():
                seen, scripts = found.setdefault(lang, (np.zeros(FEATURES), np.zeros(len(SCRIPTS))))
                w = words_of(texts)
                times = np.bincount(w.distinct, minlength=len(w.widths)).astype(float)
                seen += np.bincount(w.features, weights=np.repeat(times, w.widths), minlength=FEATURES)
                letters = np.bincount(w.distinct, weights=w.sizes, minlength=len(w.widths))
                scripts += np.bincount(w.script, weights=letters, minlength=len(SCRIPTS))
    for lang, (seen, scripts) in found.items():
        for values, ids in ((seen, np.arange(FEATURES)), (scripts, -1 - np.arange(len(SCRIPTS)))):
            full = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(full), pa.string()), pa.array(ids[full]), pa.array(values[full].astype(np.int64))], names=["lang", "feature", "n"]
            )


def rows_per_language(counts: list[int], sample_rows: int) -> int:
    """The bound of every language's rows under which they make ``sample_rows`` in all; at least LEAST_ROWS."""
    left, most = sample_rows, max(counts, default=0)
    for k, n in enumerate(sorted(counts)):
        fair = left // (len(counts) - k)
        if n > fair:
            most = fair
            break
        left -= n
    return max(LEAST_ROWS, most)


def fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``documents`` (lang, text and doc_id, to sample by): only rows with a language count."""
    labelled = documents.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    most = rows_per_language(list(sizes.values()), sample_rows)
    sample = labelled
    bounds = [F.lit(x) for lang, n in sorted(sizes.items()) if n > most for x in (lang, most * _HASHES // n)]
    if bounds:
        bound = F.coalesce(F.element_at(F.create_map(*bounds), F.col("lang")), F.lit(_HASHES))
        sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_HASHES)) < bound)
    counted = sample.select("lang", "text").mapInArrow(_count, "lang string, feature long, n long")
    table = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    seen, scripts = np.zeros((FEATURES, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    which = np.array([languages.index(x) for x in table.column("lang").to_pylist()], dtype=np.int64)
    feature, n = table.column("feature").to_numpy(), table.column("n").to_numpy()
    seen[feature[feature >= 0], which[feature >= 0]] = n[feature >= 0]
    scripts[-1 - feature[feature < 0], which[feature < 0]] = n[feature < 0]
    seen += 0.1
    uses = scripts > SCRIPT_SHARE * scripts.sum(0) if languages else scripts > 0
    return Model(languages, np.log(seen / seen.sum(0)).astype(np.float32), uses)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Of each distinct word for each language, 0 for the best and at least FLOOR."""
    starts = np.concatenate([[0], np.cumsum(words.widths)])[:-1].astype(np.int64)
    out = np.empty((len(starts), len(model.languages)), dtype=np.float32)
    for lang in range(len(model.languages)):
        out[:, lang] = np.add.reduceat(model.scores[words.features, lang], starts)
    allowed = model.uses[words.script]
    out = np.where(allowed, out, -np.inf)
    best = out.max(1, keepdims=True)
    known = np.isfinite(best)
    return np.where(known, np.maximum(np.where(allowed, out, -1e9) - np.where(known, best, 0), np.where(allowed, FLOOR, 2 * FLOOR)), 0).astype(np.float32)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH, window: int = WINDOW) -> np.ndarray:
    """The best language of every word, given all words' scores and the words of each text.

    Exact for any length: windows of words run side by side from every entry
    state, a text's windows are chained by their best totals, and the paths are
    read back inside the windows.
    """
    langs = scores.shape[1]
    pieces = -(-counts // window)
    owner = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(counts) - counts)[owner] + number * window
    length = np.minimum(window, counts[owner] - number * window)
    rows = len(owner)
    steps = int(length.max(initial=0))
    padded = np.zeros((steps, rows, langs), dtype=np.float32)
    t = np.arange(len(scores)) - np.repeat(begin, length)
    w = np.repeat(np.arange(rows), length)
    padded[t, w] = scores
    f = np.full((rows, langs, langs), -switch, dtype=np.float32)  # entry state, state
    f[:, np.arange(langs), np.arange(langs)] = 0
    f += padded[0][:, None, :] if steps else 0
    moved = np.zeros((steps, rows, langs, langs), dtype=bool)
    origin = np.zeros((steps, rows, langs), dtype=np.uint8 if langs < 256 else np.uint16)
    for k in range(1, steps):
        origin[k] = f.argmax(2)
        jump = f.max(2)[:, :, None] - switch
        np.greater(jump, f, out=moved[k])
        f = np.maximum(f, jump) + padded[k][:, None, :]
    entry, leave = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    firsts = np.cumsum(pieces) - pieces
    came = np.zeros((rows, langs), dtype=np.int64)
    value = np.zeros((len(counts), langs), dtype=np.float64)
    deepest = int(pieces.max(initial=0))
    for k in range(deepest):
        docs = np.flatnonzero(pieces > k)
        here = firsts[docs] + k
        paths = value[docs][:, :, None] + f[here]
        came[here] = paths.argmax(1)
        value[docs] = paths.max(1)
    state = value.argmax(1)
    for k in range(deepest - 1, -1, -1):
        docs = np.flatnonzero(pieces > k)
        here = firsts[docs] + k
        leave[here] = state[docs]
        entry[here] = came[here, state[docs]]
        state[docs] = entry[here]
    path = np.zeros((steps, rows), dtype=np.int64)
    now, all_rows = leave, np.arange(rows)
    for k in range(steps - 1, -1, -1):
        path[k] = now
        now = np.where(moved[k, all_rows, entry, now], origin[k, all_rows, entry], now)
    return path[t, w]


def label_texts(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """The language, score and spans of each text."""
    w = words_of(texts)
    if not model.languages or not len(w.distinct):
        return ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    path = viterbi(word_scores(w, model)[w.distinct], w.counts)
    known = model.uses[w.script].any(1)[w.distinct]
    doc = np.repeat(np.arange(len(texts)), w.counts)
    letters = np.zeros((len(texts), len(model.languages)))
    np.add.at(letters, (doc, path), w.sizes * known)
    total = np.bincount(doc, weights=w.sizes, minlength=len(texts))
    best = letters.argmax(1)
    score = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
    names = [model.languages[b] if n else "und" for b, n in zip(best.tolist(), total.tolist(), strict=True)]
    change = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])]))
    lengths = np.diff(np.concatenate([change, [len(path)]]))
    base = np.cumsum(w.counts) - w.counts
    every, some = (np.concatenate([[0], np.cumsum(x)]) for x in (w.sizes, w.sizes * known))
    spans: list[list[dict]] = [[] for _ in texts]
    for at, n in zip(change.tolist(), lengths.tolist(), strict=True):
        d = int(doc[at])
        first = at - int(base[d])
        spans[d].append({"lang": model.languages[path[at]], "first_word": first, "words": n, "letters": int(every[at + n] - every[at]), "known_letters": int(some[at + n] - some[at])})
    return names, score, spans


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("letters", pa.int64()), ("known_letters", pa.int64())]))


ADDED = ("lang_pred", "lang_score", "lang_spans")


def identify(documents: DataFrame, model: Model, text: str = "text", added: tuple[str, str, str] = ADDED) -> DataFrame:
    """Adds lang_pred, lang_score and lang_spans (lang, first_word, words, letters, known_letters) to ``documents``, or three other names.

    A span's known letters are those of words whose script some language uses.
    Columns of the added names in the input are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.drop(*added)
    at = rows.columns.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in pieces(batch, at, _SLICE_BYTES, _SLICE_TEXTS):
                names, score, spans = label_texts([t or "" for t in own.column(at).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(names, pa.string()), pa.array(score), pa.array(spans, _SPANS)], names=[*own.schema.names, *added]
                )

    spans = "array<struct<lang:string,first_word:bigint,words:bigint,letters:bigint,known_letters:bigint>>"
    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"`{c}` {k}" for c, k in zip(added, ("string", "double", spans), strict=True))]
    return rows.mapInArrow(label, ", ".join(kinds))


def predict_languages(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the rows that are not held out and label all: doc_id, held_out, lang_pred, score, lang_spans."""
    trusted = documents.where(F.col("doc_id").isNotNull() & ~is_held_out()).select("doc_id", "lang", "text")
    model = fit(trusted, sample_rows)
    labelled = identify(documents.select("doc_id", "text"), model)
    return labelled.select("doc_id", is_held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_spans")
