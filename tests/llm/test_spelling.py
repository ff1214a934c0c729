from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import spelling

FIELDS = "doc_id long, text string"


def apart(a, b):
    """Whether two words are exactly one inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, slip=97, shortest=5, least=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    rows = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return rows


def check(spark, rows, slip=97, schema=FIELDS):
    found = spelling.group_variants(spark.createDataFrame(rows, schema).repartition(3), slip=slip).collect()
    assert len({r.word for r in found}) == len(found)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == expected([r[:2] for r in rows], slip)
    return found


def test_equal_to_brute_force(spark):
    rng, rows = random.Random(1), []
    parts = ["an", "the", "re", "on", "é", "À", "ß", "ba", "ab", "aa"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(250)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    for i in range(150):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 120))
        words = [w.upper() if rng.random() < 0.1 else w for w in words]
        rows.append((i, rng.choice((" ", "-", "1", "Ā", "\U0001f600")).join(words)))
    rows += [(None, "therean " * 5), (7, None), (8, ""), (9, "12 ., \n"), (10, rows[0][1]), (10, rows[0][1]), (11, "abab" * 3000 + " " + "ababa " * 4)]
    for slip in (97, 3, None):
        found = check(spark, rows, slip)
        assert sum(r.form is not None for r in found) > 5


def test_repeated_letters_and_every_edit(spark):
    base = ["ababababab", "aaaaaaa", "aaaaab", "abcdefgh", "bcdefgha"]
    words = set(base)
    for w in base:
        words |= {w[:i] + w[i + 1 :] for i in range(len(w))}
        words |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abé"}
        words |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abé"}
    rng, rows = random.Random(2), []
    for w in sorted(words):
        rows += [(1, f"{w} " * rng.randint(2, 60))]
    check(spark, rows, None)


def test_empty_table_and_other_columns(spark):
    assert spelling.group_variants(spark.createDataFrame([], FIELDS)).count() == 0
    rows = [(1, "house house house hous hous hous", "x", 1, "y"), (2, "house house house", None, None, None)]
    check(spark, rows, None, FIELDS + ", word string, n long, form string")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 40)), min_size=3, max_size=9, unique_by=lambda x: x[1]))
def test_pivots_are_the_rarest_disjoint_two(grams):
    grams = sorted((place, rank) for rank, place in grams)
    ranks, places = [r for _, r in grams], [p for p, _ in grams]
    pairs = [(ranks[i] + ranks[j]) for i in range(len(grams)) for j in range(len(grams)) if places[i] + 2 <= places[j]]
    if pairs:
        i, j = spelling.pivots(ranks, places)
        assert places[i] + 2 <= places[j] and ranks[i] + ranks[j] == min(pairs)


def test_crc_of_slices():
    rng = random.Random(4)
    data = np.frombuffer(rng.randbytes(5000), np.uint8)
    start = np.array([rng.randrange(4000) for _ in range(300)])
    size = np.array([rng.choice((0, 1, 5, 30, 255, 256, 257, 900)) for _ in range(300)])
    prefix = np.array([zlib.crc32(str(i).encode()) for i in range(300)], np.uint32)
    found = spelling.crc_states(prefix, data, start, size)
    assert [int(x) for x in found] == [zlib.crc32(data[s : s + n].tobytes(), int(p)) for s, n, p in zip(start, size, prefix, strict=True)]


def test_no_join_broadcasts_words(spark):
    words = spark.createDataFrame([("water", 9), ("wader", 3), ("waters", 4)], "word string, n long")
    plans = [spelling.near_pairs(words), spelling.group_variants(spark.createDataFrame([("1", "water water water waters waters waters")], "doc_id string, text string"))]
    assert not any("Broadcast" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
