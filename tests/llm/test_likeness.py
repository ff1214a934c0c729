from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tarn.llm import likeness


def jaccard_groups(rows, k=5, least=0.8):
    """Smallest id of each group of texts alike in k-word shingles, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {" ".join(words[j : j + k]) for j in range(len(words) - k + 1)} or ({" ".join(words)} if words else {text or ""})
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] < root[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                    root[b] = root[a]
                    changed = True
    return root


def test_similar_documents_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5)))
    rows = []
    for base in range(25):
        text = [word() for _ in range(rng.randint(60, 160))]
        rows.append((base * 10, " ".join(text)))
        for copy in range(1, 5):
            changed = list(text)
            for _ in range(rng.choice([0, 1, 2, 8])):
                changed[rng.randrange(len(changed))] = word()
            rows.append((base * 10 + copy, " ".join(changed)))
    rows += [(900, ""), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1))
    assert {r.doc_id: r.component_id for r in likeness.similar_documents(df).collect()} == jaccard_groups(rows)


def test_similar_documents_equal_brute_force_for_added_and_cut_parts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = []
    for base in range(40):
        text = [word() for _ in range(rng.randint(60, 600))]
        part = [word() for _ in range(int(len(text) * rng.uniform(0.15, 0.24)))]
        copies = [text, text + part, part + text, text[: -len(part)], text[len(part) :]]
        rows += [(base * 10 + i, " ".join(copy)) for i, copy in enumerate(copies)]
    found = likeness.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == jaccard_groups(rows)


def test_prefixes_and_parity_lose_no_pair_at_the_bound():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 9, 90, 900):
        whole = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
        common, near = np.sort(whole[rng.random(size) < 0.5]), likeness.may_be_alike(0.8, 0)
        part = np.sort(rng.choice(whole, int(np.ceil(0.8 * size)), replace=False))
        heads = [likeness.prefix(x, 0.8, common, np.arange(len(common))) for x in (whole, part)]
        marks = [np.concatenate([[len(x)], np.zeros(len(likeness.MARK), np.int64), likeness.parity(x)]).view(np.uint64) for x in (whole, part)]
        assert set(heads[0].tolist()) & set(heads[1].tolist()) and near(*marks)


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.985), (0.85, 0.995), (0.9, 0.999)])
def test_recall_of_the_index_at_a_similarity(similarity, least):
    """Pairs of random sets at that very similarity: a common group of bytes, and the tally reached."""
    rng = np.random.default_rng(8)
    near, found, pairs = likeness.may_be_alike(0.8, likeness.LEAST_SHARED), 0, 3000
    for _ in range(pairs):
        union = rng.integers(-(2**63), 2**63 - 1, 100)
        same = round(100 * similarity)
        half = (100 - same) // 2
        a, b = np.unique(union[: same + half]), np.unique(np.concatenate([union[:same], union[same + half :]]))
        mark = likeness.positional_bytes([a, b])
        group = mark.view(np.uint32).reshape(2, -1)
        marks = np.concatenate([[[len(a)], [len(b)]], mark.reshape(2, -1), [likeness.parity(a), likeness.parity(b)]], axis=1).view(np.uint64)
        found += bool((group[0] == group[1]).any() and near(marks[0], marks[1]))
    assert found / pairs >= least


def test_unlike_sets_share_few_bytes():
    rng = np.random.default_rng(2)
    mark = likeness.positional_bytes([np.unique(rng.integers(-(2**63), 2**63 - 1, 200)) for _ in range(200)] + [np.zeros(0, np.int64)])
    data = mark.view(np.uint8).reshape(201, -1)[:200]
    shared = (data[:, None] == data[None, :]).sum(-1)[~np.eye(200, dtype=bool)]
    assert shared.max() < likeness.LEAST_SHARED and 0.5 < 256 * shared.mean() / likeness.POSITIONS < 2 and not mark.reshape(201, -1)[200].any()


def test_long_lists_give_partners_in_rounds():
    near = lambda a, b: np.bitwise_count(a[..., 1] ^ b[..., 1]) <= 12
    fps = np.array([1 << 3, 0, 1, 3, 7] * 8, np.uint64) + (np.arange(40, dtype=np.uint64) << np.uint64(56))
    ids, key, size = np.arange(40), np.zeros(40, np.int64), np.full(40, 9)
    marks = np.stack([size.view(np.uint64), fps], axis=1)
    every = {(a, b) for a in range(40) for b in range(a + 1, 40) if near(marks[a], marks[b])}
    found = likeness.candidate_pairs(3, near)(key, size, ids, ids, fps.view(np.int64)).to_pylist()
    pairs = {(r["a"], r["b"]) for r in found if r["key"] is None}
    assert pairs < every and {b for _, b in pairs} == {b for _, b in every}
    assert [r["a"] for r in found if r["key"] is not None] == ids.tolist()
    found = likeness.candidate_pairs(40, near)(key, size, ids, ids % 2, fps.view(np.int64)).to_pylist()
    assert {(r["a"], r["b"]) for r in found} == {(a, b) for a, b in every if (a - b) % 2}
    assert not likeness.candidate_pairs(3, near)(key, size, ids, ids * 0, fps.view(np.int64)).num_rows


def test_rounds_lose_no_link_in_large_groups(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(9999)}" for _ in range(400)]
    rows = []
    for i in range(120):  # near one another, but alike only along a chain
        text = list(base)
        for j in range(i % 40):
            text[10 * j] = f"x{j}"
        text[399] = f"y{i % 3}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(likeness, "PARTNERS", 1)
    monkeypatch.setattr(likeness, "MORE_PARTNERS", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (0.8, 0.97):
        wanted = jaccard_groups(rows, least=least)
        found = {r.doc_id: r.component_id for r in likeness.similar_documents(df, similarity=least).collect()}
        assert found == wanted


def test_without_exact_the_index_alone_finds_scattered_and_moved_copies(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = []
    for base in range(60):
        text = [word() for _ in range(200)]
        cut = [w for i, w in enumerate(text) if i % 100 != 50]
        rows += [(base * 10, " ".join(text)), (base * 10 + 1, " ".join(text[:190])), (base * 10 + 2, " ".join(cut))]
    found = {r.doc_id: r.component_id for r in likeness.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), exact=False).collect()}
    wanted = jaccard_groups(rows)
    assert sum(found[i] == wanted[i] for i in wanted) >= 0.99 * len(wanted)


def test_kept_rows(docs, no_docs):
    kept = [r.doc_id for r in likeness.keep_one(docs).collect()]
    assert len(kept) == len(set(kept))
    assert 110 in kept and not {111, 112, 113, 114} & set(kept)
    assert likeness.keep_one(no_docs).count() == 0


def test_text_ids_and_an_id_of_two_texts(spark):
    long_text = " ".join(f"w{i}" for i in range(60))
    rows = [("a", long_text), ("b", long_text + " more"), ("b", "another text of its own, quite unlike the rest"), ("c", long_text), (None, long_text), (None, None), ("d", None), ("e", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("_hash", F.lit(1)).withColumn("group", F.lit("x"))
    kept = sorted(((r.doc_id, r.text) for r in likeness.keep_one(df).collect()), key=str)
    wanted = [("a", long_text), ("b", rows[2][1]), ("d", None), (None, long_text), (None, None)]
    assert kept == sorted(wanted, key=str)


def boilerplate_rows(n, seed=10):
    """Texts that share 60 % of their words in one passage, every twentieth with a copy changed in a few words."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(n):
        text = common + [f"{i}-{rng.randrange(9**9)}" for _ in range(80)]
        rows.append((2 * i, " ".join(text)))
        if i % 20 == 0:
            text[rng.randrange(200)] = "changed"
            rows.append((2 * i + 1, " ".join(text)))
    return rows


def test_split_lists_lose_no_link_between_texts_of_one_boilerplate(spark, monkeypatch):
    rows = boilerplate_rows(400)
    monkeypatch.setattr(likeness, "LONG_LIST", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in likeness.similar_documents(df, exact=False).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}


def met_until_settled(sets, most):
    """Pairs found by all rounds over the lists of ``sets``, and how many pairs of marks were compared; links are not told to later rounds."""
    compared = 0
    alike = likeness.may_be_alike(0.8, likeness.LEAST_SHARED)

    def near(a, b):
        nonlocal compared
        compared += int(np.prod(np.broadcast_shapes(a.shape, b.shape)[:-1]))
        return alike(a, b)

    marks = likeness.positional_bytes(sets).reshape(len(sets), -1)
    rest = np.concatenate([[[len(x)] for x in sets], marks, [likeness.parity(x) for x in sets]], axis=1)
    node = np.tile(np.arange(len(sets)), 10)
    group = np.repeat(np.arange(10), len(sets))
    key = marks.view(np.uint32).reshape(len(sets), -1).T.ravel().astype(np.int64) + (group << 32)
    state, pairs = group, set()
    while len(key):
        order = np.lexsort((node, key))
        key, state, node = key[order], state[order], node[order]
        columns = [key, state, rest[node, 0], node, node, *rest[node, 1:].T]
        table = pa.table([np.ascontiguousarray(c) for c in columns], names=[str(i) for i in range(len(columns))])
        made = pa.concat_tables(pa.table(b) for b in likeness.met_lists(10**6, near, most, iter(table.to_batches(max_chunksize=700))))
        pairs |= {(r["a"], r["b"]) for r in made.select(["a", "b"]).to_pylist() if r["b"] is not None}
        long = made.filter(pc.and_(pc.is_valid(made["key"]), pc.is_null(made["size"])))
        node, key, state = (long[c].to_numpy() for c in ("a", "key", "state"))
        if len(key):
            at, key, state = likeness.split_lists(key, state, marks[node])
            node = node[at]
    return pairs, compared


def test_work_of_hot_lists_grows_far_less_than_with_the_square():
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(-(2**63), 2**63 - 1, n)
    common, work = draw(60), []
    for n in (2000, 8000):  # four times the texts: 16 times the pairs
        work.append(met_until_settled([np.unique(np.concatenate([common, draw(40)])) for _ in range(n)], 128)[1])
    assert work[1] < 9 * work[0]


@pytest.mark.parametrize("boilerplate", [30, 50, 60, 70, 75])
def test_recall_where_lists_of_boilerplate_are_split(boilerplate):
    """Pairs at 0.8 among texts of one passage: lists of its bytes alone are split each time, others once at most."""
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(-(2**63), 2**63 - 1, n)
    found = tried = 0
    for _ in range(8):
        common, a, b = draw(boilerplate), [], []
        for _ in range(250):
            union = np.concatenate([common, draw(100 - boilerplate)])
            a.append(np.unique(union[:90]))
            b.append(np.unique(np.concatenate([union[:80], union[90:]])))
        x, y, passage = (likeness.positional_bytes(s).view(np.uint8).reshape(-1, likeness.POSITIONS) for s in (a, b, [common]))
        same, rare = x == y, x != passage
        listed = same.reshape(len(x), -1, likeness.GROUP).all(2)
        once = listed & rare.reshape(len(x), -1, likeness.GROUP).any(2)
        parts = same[:, likeness.FURTHER].all(3)
        once |= listed & (parts & rare[:, likeness.FURTHER].any(3)).any(2)
        found += int(((once | listed & (parts.sum(2) >= likeness.SPLITS)).any(1) & (same.sum(1) >= likeness.LEAST_SHARED)).sum())
        tried += len(x)
    assert found / tried >= 0.985


def test_streamed_lists_give_every_row_once():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.choice([1, 2, 3, 4, 5, 6, 7, 8], 4000, p=[0.6, 0.2, 0.1, 0.05, 0.02, 0.02, 0.005, 0.005]))
    table = pa.table([keys, np.arange(4000)], names=["key", "n"])
    whole, passed = [], []
    for size in (1, 37, 900, 5000):
        whole.clear(), passed.clear()
        list(likeness.streamed_lists(lambda *x: whole.append(x), passed.append, lambda rows: rows[0][0] != 2, 100, iter(table.to_batches(max_chunksize=size))))
        seen = np.concatenate([x[1] for x in [*whole, *passed]])
        assert np.array_equal(np.sort(seen), np.arange(4000))
        ends = [set(x[0].tolist()) for x in whole]
        assert sum(len(x) for x in ends) == len(set().union(*ends))  # no list in two calls
        assert {int(k) for x in passed for k in x[0]} == {int(k) for k in np.unique(keys) if (keys == k).sum() > 100 and k != 2}


def test_counts_keep_pairs_at_the_bound_and_rule_out_unlike_long_texts():
    rng = np.random.default_rng(5)
    near = likeness.counts_allow(0.8)
    mark = lambda x: np.concatenate([[len(x)], likeness.counts(x)]).view(np.uint64)
    for size in (1, 3, 40, 400, 1500, 3000, 9000):
        union = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
        ends = (len(union) - int(np.ceil(0.8 * len(union)))) // 2
        a, b = union[: len(union) - ends], union[ends:]
        assert near(mark(a)[None, None], mark(b)[None, None]).all() and near(mark(a)[None], mark(union)[None]).all()
        assert likeness.apart_by_counts(mark(a)[1:], mark(b)[1:]) <= 2 * ends
        assert (likeness.counts(a)[: len(likeness.PARITY)] == likeness.parity(a)).all()
    for size in (1200, 3500, 6500):
        marks = np.stack([mark(np.unique(rng.integers(-(2**63), 2**63 - 1, size))) for _ in range(40)])
        unlike = ~np.eye(40, dtype=bool)
        assert not near(marks[:, None], marks[None, :])[unlike].any()
    few, many = np.arange(7), np.arange(9000) ** 2
    held = [np.bincount((x.view(np.uint64) % np.uint64(512)).astype(int), minlength=512) for x in (few, many)]
    gap = (held[1] - held[0]) % 2**likeness.PLANES
    assert likeness.apart_by_counts(mark(few)[1:], mark(many)[1:]) == np.minimum(gap, 2**likeness.PLANES - gap).sum()
