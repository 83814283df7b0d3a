import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.llm.lang_id import FLOOR, Scorer, count_grams, count_words, fit, grams_of, predict


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(larger):
    rows = predict(larger, fit(larger)).join(larger.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == larger.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)


def test_words_and_grams_are_counted_whole(spark):
    texts = [("a", "It's ÉTÉ été, 42 naïve—word"), ("a", "x" * 300 + " word ½"), ("b", "word\nWORD <b>")]
    df = spark.createDataFrame(texts * 40, "lang string, text string").repartition(3)
    words = count_words(df, buffer_bytes=200)
    want = Counter({("a", "it"): 40, ("a", "s"): 40, ("a", "été"): 80, ("a", "naïve"): 40, ("a", "word"): 80,
                    ("a", "x" * 300): 40, ("b", "word"): 80, ("b", "b"): 40})
    assert {(r.lang, r.word): r.c for r in words.collect()} == want
    grams = Counter()
    for (lang, word), c in want.items():
        for n in range(1, 5):
            if len(word) + 2 >= n:
                for g in grams_of(word, n):
                    grams[lang, g] += c
    assert {(r.lang, r.gram): r.c for r in count_grams(words).collect()} == grams


def test_backoff(make_docs):
    docs = make_docs([(i, "alpha alpha beta", "s") for i in range(30)]).withColumn("lang", F.lit("aa"))
    docs = docs.union(make_docs([(i + 100, "gamma delta", "s") for i in range(30)]).withColumn("lang", F.lit("gg")))
    model = fit(docs)
    scorer = Scorer(model)
    assert model.languages == ["aa", "gg"] and set(model.words) == {"alpha", "beta", "gamma", "delta"}
    assert scorer.word("alpha") == pytest.approx([np.log(2 / 3), FLOOR])
    assert "lphx" not in model.grams  # unseen: the mean of the two shorter ones, and so on
    assert scorer.gram("lphx") == pytest.approx((scorer.gram("lph") + scorer.gram("phx")) / 2)
    assert scorer.gram("phx") == pytest.approx((scorer.gram("ph") + scorer.gram("hx")) / 2)
    assert list(scorer.gram("x")) == [0, 0]
    assert scorer.word("alphas") == pytest.approx(np.mean([scorer.gram(g) for g in grams_of("alphas", 4)], axis=0))
    got = {r.doc_id: r for r in predict(make_docs([(1, "alphas", "s"), (2, "deltas!", "s"), (3, "xxxx", "s")]), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["aa", "gg", "aa"] and got[3].score == pytest.approx(0.5, abs=0.01)


def test_bounds_hold_and_keep_the_most_frequent(make_docs):
    docs = make_docs([(i, " ".join(f"{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(i % 60)), "s") for i in range(200)])
    model = fit(docs, max_words=20, max_grams=15)
    assert 0 < len(model.words) <= 20 and "aa" in model.words
    assert max(Counter(map(len, model.grams)).values()) <= 15


def test_held_out_labels_and_other_columns_do_not_matter(documents):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = documents.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    answers = lambda df: {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in predict(df, fit(df)).collect()}
    assert answers(changed) == answers(documents)


def test_edges(edge_docs, make_docs):
    for c in ("word", "gram", "c", "kind", "held_out", "lang_pred"):
        edge_docs = edge_docs.withColumn(c, edge_docs["text"])
    model = fit(edge_docs)
    rows = predict(edge_docs, model, buffer_bytes=100).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in edge_docs.select("doc_id").collect())
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in range(6)] == ["und"] * 4 + ["en"] * 2 and by_id[0].score == 0
    assert not by_id[None].held_out and by_id[None].lang_pred == "en"
    assert predict(edge_docs.limit(0), model).count() == 0
    nothing = fit(edge_docs.limit(0))  # nothing learned: no language to tell
    assert {r.lang_pred for r in predict(edge_docs, nothing).collect()} == {"und"}
    assert predict(make_docs([(1, "½ 42 --", "s"), (2, "日本", "s")]), model).where("lang_pred = 'und'").count() == 1
