import random
import re

import pytest

from waypost.llm import licenses, license_texts, queries
from waypost.llm.licenses import Automaton, Scanner, scan_licenses

SCANNER = Scanner(license_texts.TEMPLATES, license_texts.PHRASES)
NOISE = "lorem of the software dolor in no event sit amet provided by copyright holders ipsum and any".split()


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_base(text):
    words = brute_words(text)
    found = []
    for phrase, label in license_texts.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def longest_before(words, at, sequences):
    """The longest piece of a sequence that ends at a word."""
    n = 0
    while n <= at and any(words[at - n : at + 1] == s[k : k + n + 1] for s in sequences for k in range(len(s) - n)):
        n += 1
    return n


def test_matching_statistics_and_places():
    rng = random.Random(3)
    for _ in range(60):
        sequences = [[rng.randint(1, 3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 4))]
        automaton = Automaton(sequences)
        words = [rng.randint(1, 4) for _ in range(40)]
        for at, (length, state) in enumerate(automaton.statistics(words)):
            assert length == longest_before(words, at, sequences)
            piece = words[at - length + 1 : at + 1]
            if length:
                assert automaton.places(state) == {(k, e) for k, s in enumerate(sequences) for e in range(len(s)) if e + 1 >= length and s[e - length + 1 : e + 1] == piece}


def test_chains_cover_what_brute_force_covers():
    rng = random.Random(5)
    for _ in range(80):
        anchors = [licenses.Anchor(rng.randint(0, 90), rng.randint(0, 60), rng.randint(5, 20)) for _ in range(rng.randint(1, 9))]
        anchors = list(dict.fromkeys(anchors))

        def most(a):  # the best chain that ends with an anchor
            best = a.length
            for b in anchors:
                gap, jump = a.start - b.start - b.length, a.at - b.at - b.length
                new = a.length - max(0, -gap, -jump)
                if b.start < a.start and b.at < a.at and new > 0 and gap <= licenses.MAX_GAP and jump <= licenses.MAX_GAP:
                    best = max(best, most(b) + new)
            return best

        assert licenses.chains(anchors)[0][2] == max(map(most, anchors))


@pytest.mark.parametrize("k", range(len(license_texts.TEMPLATES)))
def test_every_template_is_found_where_it_stands(k):
    label, name, text = license_texts.TEMPLATES[k]
    rng = random.Random(k)
    before, after = [rng.choice(NOISE) for _ in range(rng.randint(0, 300))], [rng.choice(NOISE) for _ in range(200)]
    whole = f"{' '.join(before)} zzz {text.upper()} zzz {' '.join(after)}"
    (row,) = SCANNER.scan([whole.encode()])
    spans = row[-1]
    assert [(s["label"], s["template"]) for s in spans] == [(label, name)] and label in row[5].split(",")
    assert spans[0]["first_word"] == len(before) + 1 and spans[0]["share"] == 1
    # a word in twelve is another one, and some words are missing
    words = text.split()
    bent = " ".join("xx" if i % 12 == 5 else w for i, w in enumerate(words))
    (row,) = SCANNER.scan([f"{' '.join(before)} zzz {bent} zzz".encode()])
    assert label in row[5].split(",") or len(words) < 40
    # words in another order are none
    rng.shuffle(words)
    (row,) = SCANNER.scan([" ".join(words).encode()])
    assert not row[-1]


def test_copies_and_neighbours_are_spans_of_their_own():
    texts = [license_texts.TEMPLATES[k][2] for k in (0, 0, 4, 2, 1, 0)]
    (row,) = SCANNER.scan([" zzz ".join(texts).encode()])
    assert [s["label"] for s in row[-1]] == ["mit", "mit", "apache-2.0", "bsd-3-clause", "bsd-2-clause", "mit"]
    assert row[5] == "apache-2.0,bsd-2-clause,bsd-3-clause,mit" and row[6] > 0.98


def test_batches_equal_single_documents():
    rng = random.Random(8)
    parts = [*NOISE, "CC-BY 4.0", "General Public License", "all rights\nreserved", "All rights reserved. all-rights reserved", *(t for *_, t in license_texts.TEMPLATES[:5])]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))).encode() for _ in range(60)] + [b"", b"cc", b"by"]
    rows = list(SCANNER.scan(texts))
    assert rows == [r for t in texts for r in SCANNER.scan([t])]
    for text, row in zip(texts, rows, strict=True):
        assert row[:5] == brute_base(text.decode())
        assert set(filter(None, row[4].split(","))) <= set(row[5].split(",")) and 0 <= row[6] < 1


def test_documents(spark, small, documents):
    got = {r.doc_id: r for r in queries.op13_license_scan(spark, small).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute_base(r.text)


def test_odd_rows(odd, none):
    rows = scan_licenses(odd).collect()
    assert len(rows) == odd.count() and scan_licenses(none).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].labels == "" and by[3].first_word is None
    assert by[6].n_words == 30_000 and by[7].n_words == len(brute_words("été \U0001f600 日本語 Ünïcödé ŝ")) and by[8].score == 0
    assert sorted(r.n_words for r in rows if r.doc_id is None) == [0, 8]
