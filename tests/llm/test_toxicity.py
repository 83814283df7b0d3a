import zlib

import pytest
from pyspark.sql import functions as F

from airlake.llm import toxicity


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    return docs, labels, model, out


def test_scores(scored):
    docs, _, _, out = scored
    assert len(out) == docs.count()
    for r in out.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_held_out_accuracy(scored):
    """About a thousand held-out rows, 120 of them toxic."""
    _, labels, _, out = scored
    counts = {}
    for r in labels.collect():
        if out[r.doc_id].held_out:
            pair = r.toxic, out[r.doc_id].predicted
            counts[pair] = counts.get(pair, 0) + 1
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) > 0.85, counts
    assert counts[0, 0] / (counts[0, 0] + counts.get((0, 1), 0)) > 0.99, counts


def test_held_out_labels_are_never_read(spark, scored):
    docs, labels, model, _ = scored
    from pyspark.sql import functions as F
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 2, 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    assert toxicity.lexicon(toxicity.labelled(docs, flipped).where("part in ('first', 'second')")) == (model.strong, model.weak)


def test_edges(edge_docs, scored):
    _, labels, model, _ = scored
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert not [(r.doc_id, r.score) for r in rows if r.predicted]
    assert toxicity.score(edge_docs.limit(0), model).count() == 0
    kept = toxicity.keep_clean(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def test_no_labels(edge_docs, scored):
    _, labels, _, _ = scored
    model = toxicity.fit(edge_docs, labels.limit(0))
    assert {r.score for r in toxicity.score(edge_docs, model).collect()} == {0.0}
    assert toxicity.keep_clean(edge_docs, model).count() == edge_docs.count()


def test_obfuscation_and_proximity():
    known = toxicity.Features({"idiot$": 5.0, "veju": 5.0}, {"dumb$": 2.0})
    names = dict(zip(toxicity.FEATURES, known(["you are an 1d10t and an i-d-i-o-t"])[0]))
    assert names["strong_count"] == 2 and names["hidden"] > 0 and names["near_you"] == 0.5
    assert toxicity.plain("iiidi0ttt") == "idiot"
    assert list(map(known._value, ["vejuais", "vej", "dumb", "idiots", ""])) == [-1.0, 0.0, 2.0, 0.0, 0.0]


def slow_features(text, strong, weak):
    """The features of one text, by patterns over its whole."""
    def value(w):
        found = toxicity.entries_of(w)
        return -1 if set(found) & set(strong) else max((weak.get(e, 0) for e in found), default=0)

    words = toxicity.words_of(text)
    n, size = len(words) + toxicity.FEW_WORDS, len(text) + toxicity.FEW_CHARS
    hits = [i for i, w in enumerate(words) if value(w) < 0]
    hidden = [i for i, w in enumerate(words) if i not in hits and (not w.isalpha() or toxicity.REPEAT.search(w))
              and value(toxicity.plain(w)) < 0]
    you = [w in toxicity.SECOND_PERSON for w in words]
    found = len(hits + hidden)
    near = sum(any(you[max(0, i - 3):i + 4]) for i in hits + hidden)
    return [100 * found / n, found, 100 * sum(max(0, value(w)) for w in words) / n, near / max(1, found),
            100 * sum(you) / n, sum("A" <= c <= "Z" for c in text) / size,
            100 * len(toxicity.SHOUT.findall(text)) / n, 100 * text.count("!") / n,
            sum(c in ".,;:?!*#$%&" for c in text) / size, 100 * len(toxicity.MIXED.findall(text)) / n,
            100 * len(hidden) / n, 100 * len(toxicity.REPEAT.findall(text)) / n, min(len(words), 5000)]


def test_features_by_token_equal_those_of_whole_texts(monkeypatch):
    strong, weak = {"idiot$": 5.0, "stup": 4.0}, {"dumb$": 2.5, "hate$": 1.25}
    parts = ["you", "YOU", "idiot", "IDIOT!!!", "st*pid", "5tup1d", "stuuupid", "dumb", "hate", "a", "b@b", "x9y9z", "...",
             "the", "They", "AAA", "no-one", "w" * 90, "w" * 90 + "!", "eé", "(", ";", "\n", "\u00a0", "12,345.6", "u"]
    state, texts = 7, ["", " ", "idiot", "you", "... idiot", "x" * 3000 + " you idiot"]
    for i in range(300):
        words = []
        for _ in range(i % 23):
            state = (state * 1103515245 + 12345) % 2**31
            words.append(parts[(state >> 8) % len(parts)])
        texts.append((" ", "", ",")[i % 3 and i % 7 % 3].join(words))
    want = [slow_features(t, strong, weak) for t in texts]
    for memo, group in ((400_000, 1 << 19), (5, 40)):
        monkeypatch.setattr(toxicity, "MEMO", memo)
        monkeypatch.setattr(toxicity, "GROUP_CHARS", group)
        features = toxicity.Features(strong, weak)
        got = features(texts)
        assert len(got) == len(want) and max(map(len, features.known), default=0) <= toxicity.LONGEST
        for g, w in zip(got, want):
            assert g == pytest.approx(w, abs=1e-9)
    assert toxicity.Features({}, {})([]) == []


def test_copies_of_one_document_make_no_lexicon(spark):
    """A word is as strong as the different words it stands behind."""
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = [("lexicon", 1, f"{filler[i]} grumbold {filler[-i - 1]} copied sentence of tenfold length") for i in range(9)]
    rows += [("lexicon", 0, " ".join(filler[i:i + 9])) for i in range(100)]
    strong, weak = toxicity.lexicon(spark.createDataFrame(rows, "part string, toxic int, text string"))
    assert "grumbold$" in strong and not {"sentence$", "tenfold$", "length$"} & (set(strong) | set(weak))


def test_one_class_labels_drop_nothing(documents):
    for toxic in (0, 1):
        labels = documents.select("doc_id", F.lit(toxic).alias("toxic"))
        assert toxicity.keep_clean(documents, toxicity.fit(documents, labels)).count() == documents.count()
    assert toxicity.keep_clean(documents, toxicity.fit(documents, labels.limit(0))).count() == documents.count()
