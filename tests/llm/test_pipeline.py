from __future__ import annotations

import random

import corpus_pipeline
from tarn.llm import likeness
from tarn.llm.scratch import write_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_columns_and_decisions_take_effect(spark, docs, rows):
    table, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = write_table(stage(spark, table, ""), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(out.columns) == sorted(docs.columns)
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        table = out
    assert not {100, 101, 102} & kept["language"] and len(kept["language"]) > 60
    assert not {111, 112, 113, 114} & kept["near_duplicates"] and 110 in kept["near_duplicates"]
    assert kept["packing"] == kept["mixing"] <= kept["repeated_passages"] <= kept["near_duplicates"] <= kept["language"]


def test_empty_documents(spark, no_docs):
    table = no_docs
    for _, stage in corpus_pipeline.STAGES:
        table = write_table(stage(spark, table, ""), "test")
    assert table.count() == 0


def test_no_pair_at_the_similarity_is_left_out(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    shingles = lambda text: {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
    made = []
    while len(made) < 1200:
        text = [word() for _ in range(rng.randint(60, 160))]
        other = list(text)
        while True:
            changed = list(other)
            changed[rng.randrange(len(changed))] = word()
            if 5 * len(shingles(text) & shingles(changed)) < 4 * len(shingles(text) | shingles(changed)):
                break
            other = changed
        made += [" ".join(text), " ".join(other)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(made)], DOCS)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 1200, 2))
    # The index alone leaves some of them out.
    assert likeness.keep_one(docs, exact=False).count() > 600
