from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import language, quality
from tarn.llm.wordhash import ngrams, tokens

SYLLABLES = {"en": ["the", "ing", "and", "ou"], "de": ["sch", "ung", "der", "ü"], "el": ["και", "το", "ης", "ου"]}


def text_of(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, lang, rng.randint(5, 80)), lang) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !!", "en"), (903, text_of(rng, "en", 30), None), (904, "Зшщ" * 400, None)]
    return spark.createDataFrame(rows + [rows[0]], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("n", F.lit(1))


def test_language_held_out_accuracy_and_edges(tongues):
    found = language.identify(tongues).collect()
    truth = {r.doc_id: r.lang for r in tongues.collect()}
    held = [r for r in found if r.held_out and r.doc_id < 300]
    assert len(found) == tongues.count() and held
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred == "en" and all(by[i].rejected for i in (900, 901, 902, 904))
    assert not any(r.rejected for r in found if r.doc_id < 300)
    kept = {r.doc_id: r.lang for r in language.keep_identified(tongues).collect()}
    assert set(kept) == {r.doc_id for r in found if not r.rejected} and kept[903] == "en"


def test_signs_beyond_the_basic_plane_are_no_letters(tongues):
    texts = [(950, "\U0001f600\U0001f680 \U0001f44d"), (951, "\U0001f600 12 !! \U0001f3fd"), (952, "\U00020000\U00020001")]
    more = tongues.select("doc_id", "text", "lang").unionByName(tongues.sparkSession.createDataFrame([(*x, None) for x in texts], "doc_id long, text string, lang string"))
    by = {r.doc_id: r for r in language.identify(more).filter("doc_id >= 950").collect()}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (950, 951))
    column = pa.array([x for _, x in texts])
    assert language.characters(*language.utf8(column))[2].tolist() == [0, 0, 2]


def test_probabilities_sum_to_one():
    rng = random.Random(4)
    column = pa.array([text_of(rng, "en", 50), text_of(rng, "en", 40)])
    data, offsets = language.utf8(column)
    code, size, _ = language.characters(data, offsets)
    full = language.grams(code, size, language.ORDER)[-1]
    keys, counts = np.unique(full, return_counts=True)
    model = language.build({"en": language._sequences(keys, counts)})
    context = int(keys[7] >> np.uint64(16))
    alphabet = np.unique(np.concatenate([k & np.uint64(0xFFFF) for k in [keys]]))
    packed = [np.array([((context << 16) | int(c)) & ((1 << (16 * n)) - 1) for c in alphabet], np.uint64) for n in range(1, 5)]
    total = np.exp(model.log_probability(packed, 4)[:, 0]).sum()
    assert 0.9 < total <= 1.0 + 1e-6  # the rest is for characters never seen


def test_nothing_to_learn_from(spark, no_docs):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(df).collect()] == [("und", 0.0)]
    assert language.identify(no_docs).count() == 0


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        rows.append((i, text_of(rng, "en", 40) if good else " ".join(f"{w}{rng.choice(['###', '$$$'])}" for w in text_of(rng, "en", 40).split())))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), rows[0]]
    labels += [(3, None), (None, 1), (5000, 0), labels[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(0)).withColumn("quality", F.lit(1)).withColumn("dealt", F.lit(1))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("x"))


def test_quality_held_out_accuracy_and_edges(graded):
    docs, labels = graded
    found = quality.score_quality(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [r for r in found if r.held_out and r.doc_id in truth and r.doc_id < 400]
    assert len(found) == docs.count() and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    by = {r.doc_id: r.score for r in found}
    assert by[900] == by[901]


def test_quality_without_labels_or_rows(graded, no_docs):
    docs, labels = graded
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(no_docs, labels).count() == 0
    assert quality.score_quality(docs, labels, sample=10).count() == docs.count()


def test_leader_follows_the_published_rule():
    model = quality.Leader(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    at, value = np.array([1, 4]), np.array([2.0, 1.0])
    model.update(at, value, 1.0)
    g = -0.5 * value
    assert np.allclose(model.n[at], g * g) and np.allclose(model.z[at], g)  # the first weights are zero
    w = -(g - np.sign(g) * 0.1) / ((1 + np.abs(g)) / 0.5 + 0.2)
    assert np.allclose(model.weights(at), w)


def test_ngrams_stay_inside_rows():
    data = np.frombuffer(b"a b###c d", np.uint8)
    token, count = tokens(data, np.array([0, 3, 3, 9]))
    assert list(count) == [2, 0, 3]  # a b | | ### c d
    bucket, row = ngrams(token, count, 2, 18)
    assert sorted(np.bincount(row, minlength=3).tolist()) == [0, 3, 5]


def plain_ngrams(text, orders=2, bits=18):
    """Bucket counts by the rule in words: runs of bytes of one class, hashed, and neighbours hashed together."""
    full, step = 2**64, 0x9E3779B97F4A7C15

    def finish(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % full
        return x ^ (x >> 31)

    def kind(b):
        return 0 if b < 33 or b == 127 else 2 if 48 <= b < 58 else 1 if 65 <= b < 91 or 97 <= b < 123 or b > 127 else 3

    runs = []
    for b in (text or "").encode():
        if runs and kind(runs[-1][-1]) == kind(b):
            runs[-1].append(b)
        else:
            runs.append([b])
    hashes = [finish((sum((b + 1) * pow(step, i + 1, full) for i, b in enumerate(run)) + len(run)) % full) for run in runs if kind(run[0])]
    rolled, out = [finish(h) for h in hashes], {}
    for n in range(orders):
        if n:
            rolled = [finish((rolled[i] * step + hashes[i + n]) % full) for i in range(len(hashes) - n)]
        for h in rolled:
            out[h >> (64 - bits)] = out.get(h >> (64 - bits), 0) + 1
    return out


def test_quality_scores_equal_brute_force(graded):
    docs, labels = graded
    known = labels.filter("quality is not null and doc_id is not null").filter(quality.crc_remainder(F.col("doc_id"), 3) != 1)
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("label")).withColumn("dealt", F.xxhash64("doc_id"))
    weights = quality.train(docs.select("doc_id", "text").join(chosen, "doc_id").select("dealt", "text", "label")).astype(float)
    for r in quality.score_quality(docs, labels).join(docs.select("doc_id", "text").distinct(), "doc_id").orderBy("doc_id").limit(60).collect():
        counts = plain_ngrams(r.text)
        norm = sum(counts.values()) ** 0.5  # values are square roots of counts
        raw = sum(weights[b] * n**0.5 for b, n in counts.items()) / (norm or 1) + weights[-1]
        assert abs(r.score - 1 / (1 + np.exp(-raw))) < 1e-5


def plain_kneser_ney(texts_by_language, order=4):
    """For each language a function from (context, letter) to its probability, by the textbook recursion over dictionaries."""
    tables, letters = {}, set()
    for lang, texts in texts_by_language.items():
        counts = [{} for _ in range(order + 1)]
        for text in texts:
            code = " " + "".join(c if c.isalpha() else " " for c in text.lower())
            while "  " in code:
                code = code.replace("  ", " ")
            code = code if code.endswith(" ") or not text else code
            for i in range(1, len(code)):
                gram = code[max(0, i - order + 1) : i + 1].rjust(order)
                counts[order][gram] = counts[order].get(gram, 0) + 1
        for n in range(order - 1, 0, -1):
            for gram in counts[n + 1]:
                counts[n][gram[1:]] = counts[n].get(gram[1:], 0) + 1
        letters |= set(counts[1])
        tables[lang] = counts

    def probability(lang, context, letter):
        if not context and letter is None:
            return 1 / (len(letters) + 1)
        gram, counts = context + letter, tables[lang][len(context) + 1]
        values = list(counts.values())
        once, twice = values.count(1), values.count(2)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        lower = probability(lang, context[1:], letter) if context else probability(lang, "", None)
        same = [n for g, n in counts.items() if g[:-1] == context]
        if not same:
            return lower
        return max(counts.get(gram, 0) - discount, 0) / sum(same) * (gram in counts) + discount * len(same) / sum(same) * lower

    return probability


def test_entropies_equal_brute_force():
    rng = random.Random(11)
    texts = {lang: [text_of(rng, lang, rng.randint(2, 12)) for _ in range(4)] for lang in SYLLABLES}
    tables = {}
    for lang, own in texts.items():
        code, size, _ = language.characters(*language.utf8(pa.array(own)))
        tables[lang] = language._sequences(*np.unique(language.grams(code, size, language.ORDER)[-1], return_counts=True))
    model = language.build(tables)
    probability = plain_kneser_ney(texts)
    asked = [text_of(rng, lang, 3) for lang in SYLLABLES] + ["thesch unging", "ÜBER 12 και!"]
    found, _ = model.entropies(pa.array(asked))
    for text, row in zip(asked, found, strict=True):
        code, size, _ = language.characters(*language.utf8(pa.array([text])))
        letters = [" " if c == 0 else chr(c) for c in code.tolist()]
        for j, lang in enumerate(model.languages):
            logs = [np.log(probability(lang, "".join(letters[max(0, i - 3) : i]).rjust(3), letters[i])) for i in range(1, len(letters))]
            assert abs(-np.mean(logs) - row[j]) < 1e-4
