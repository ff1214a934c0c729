from __future__ import annotations

import random
import re

import pytest

from tarn.llm import passages

FIELDS = "doc_id long, text string"


def expected(rows, length):
    """(words, removed, spans, kept) of each row, by the rule."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    place = [(d is None, d or 0) for d, _ in rows]
    for order, words in zip(place, split, strict=True):
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            first[window] = min(first.get(window, order), order)
    out = []
    for order, words in zip(place, split, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < order:
                gone[i : i + length] = [True] * length
        edges = [i for i in range(len(words) + 1) if (i < len(words) and gone[i]) != (i > 0 and gone[i - 1])]
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        out.append((len(words), sum(gone), spans, " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def check(spark, rows, length=13, gram=5, schema=FIELDS):
    found = passages.remove_passages(spark.createDataFrame(rows, schema).repartition(4), length, gram).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, [(s.start, s.end) for s in r.spans], r.kept) for r in found), key=str)
    want = sorted(((r[0] is None, r[0] or 0, *e) for r, e in zip(rows, expected([r[:2] for r in rows], length), strict=True)), key=str)
    assert got == want
    return found


def corpus(seed, few=6):
    """Texts that share passages, lines and a gram in many surroundings."""
    rng = random.Random(seed)
    word = lambda: rng.choice(("an", "The", "é", "x.", "re-on", "12", "the", "aa"))
    shared = [[word() for _ in range(rng.randint(10, 40))] for _ in range(few)]
    anchor = "of course it is so".split()
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            piece = rng.choice(shared) if rng.random() < 0.5 else [word() + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 20))]
            cut = rng.randint(0, 6)
            words += piece[cut : len(piece) - rng.randint(0, 6)] + (anchor if rng.random() < 0.3 else [])
        rows.append((rng.choice((i, i, 1000 - i)), "".join(w + rng.choice((" ", " ", "  ", "\n", "\t\v ")) for w in words)))
    return list({r[0]: r for r in rows}.values())


@pytest.mark.parametrize(("length", "gram"), [(13, 5), (13, 13), (5, 1), (8, 4)])
def test_equal_to_brute_force(spark, length, gram):
    rows = corpus(length * gram)
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "ab " * 3000), (2004, "ab " * 12), (2005, "ab " * 14)]
    found = check(spark, rows, length, gram)
    assert sum(r.n_removed for r in found) > 500


def test_repeated_and_missing_ids_and_other_columns(spark):
    rows = corpus(3)[:40]
    rows = [(*r, "w", 1, "k") for r in rows]
    rows += [rows[0], rows[5], (None, rows[3][1], "", 0, ""), (None, rows[3][1], None, None, None), (rows[2][0], rows[9][1], "", 0, "")]
    check(spark, rows, schema=FIELDS + ", key string, doc long, rest string")


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(passages, "HEAVY_LEAST", 3)
    monkeypatch.setattr(passages, "HEAVY_SHARE", 0.0)
    check(spark, corpus(4, few=2))
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(4 + i % 9)) + " of course it is so " + " ".join(f"v{i % 30}-{j}" for j in range(20))) for i in range(300)]
    check(spark, rows)


def test_same_anchor_in_other_surroundings(spark):
    # The first document shares the anchor alone, the second and third the whole window.
    same = " ".join(f"s{i}" for i in range(20))
    check(spark, [(1, "a b s7 s8 s9 s10 s11 c d"), (2, same), (3, same), (4, f"{same} more")])


def test_empty_table(spark):
    assert passages.remove_passages(spark.createDataFrame([], FIELDS)).count() == 0
