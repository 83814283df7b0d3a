"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

The labelled rows are split by crc32(doc_id): remainders 0 and 1 modulo 4
induce the lexicon, and each shows the trees what the lexicon of the other one
finds in it; remainder 3 trains the trees with the whole lexicon and calibrates
their scores (half each, by the next bit); 2 is held out and never seen. The
lexicon holds
words and word stems, so that inflected forms are found, and a word counts as
often as it stands behind different words, so that copies of one toxic
document do not make a lexicon of its words. Features are densities of lexicon
words, second-person words near them, capitals, punctuation and obfuscation; a
model of bounded size is sent to the tasks, which read each text once.

At most ``MAX_ROWS`` labelled rows of each part are used (by hash of doc_id),
the bound of the fit; scoring covers all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from airlake.session import cut_lineage

MAX_ROWS = 20_000
CANDIDATES = 20_000     # lexicon entries whose clean documents are counted
LEXICON_WORDS = 512
MIN_SUPPORT = 3         # different words before an entry, in toxic documents
STRONG_SHARE = 0.03     # of the toxic documents hold a strong entry
STRONG_ODDS = 3.0
STEMS = (4, 5, 6, 7, 8)  # letters of a stem
BIN_ROWS = 30           # calibration rows behind one step
FEW_WORDS, FEW_CHARS = 20, 100   # added where rates are taken
MEMO = 400_000          # tokens a worker remembers
LONGEST = 64            # characters of a token that is remembered
GROUP_CHARS = 1 << 19   # texts counted together
THRESHOLD = 0.3

SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi vous votre "
                          "ton ta tes usted ustedes vos".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i",
                      "*": None, ".": None, "-": None, "_": None})
TOKEN = re.compile(r"[^\s,;:?\"()\[\]{}<>]+")
EDGE = ".!*-_'#$%&@"
REPEAT = re.compile(r"(\w)\1{2,}")
SHOUT = re.compile(r"\b[A-Z]{3,}\b")
MIXED = re.compile(r"[a-z][0-9@$!*][a-z]", re.I)
CAPITALS = re.compile(r"[A-Z]")
STOP = re.compile(r"[.!*#$%&]")
FEATURES = ("strong", "strong_count", "weak", "near_you", "you", "capitals", "shouts", "exclamations",
            "punctuation", "mixed", "hidden", "repeats", "words")


def words_of(text: str) -> list[str]:
    """Lower-cased words without the marks at their ends."""
    return [w.strip(EDGE) for w in TOKEN.findall(text.lower())]


def plain(word: str) -> str:
    """The word behind an obfuscated spelling: look-alike characters replaced,
    dividing marks and letter repetitions taken out."""
    return REPEAT.sub(r"\1", word.translate(LEET))


def entries_of(word: str) -> list[str]:
    """What the lexicon may know a word by: itself (closed by $) and its stems."""
    return [word + "$", *(word[:k] for k in STEMS if len(word) >= k)]


class Features:
    """Features of many texts at once, by a lexicon of strong and weak entries.

    All that a feature counts lies within a token, so every distinct token is
    looked at once and known by the number of its row of counts (0: a row of
    zeros, as most have); sums over a text's rows are its counts. ``MEMO`` tokens
    of up to ``LONGEST`` characters are remembered.
    """

    def __init__(self, strong: dict[str, float], weak: dict[str, float]):
        self.strong, self.weak = strong, weak
        self.heads = {e[:4] for e in [*strong, *weak]}  # every entry of a word begins as the word does
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = {(0,) * 10: 0}

    def _value(self, word: str) -> float:
        """Below 0 for a strong word, the weight of a weak one, or 0."""
        if (word + "$")[:4] not in self.heads:
            return 0.0
        found = entries_of(word)
        if any(e in self.strong for e in found):
            return -1.0
        return max((self.weak.get(e, 0.0) for e in found), default=0.0)

    def _row(self, token: str) -> int:
        small, word = token.islower(), token
        letters = token.isalpha()
        if not (small and letters):
            word = token.lower().strip(EDGE)
        value, repeated, you = self._value(word), REPEAT.search(word), word in SECOND_PERSON
        if small and letters and not (value or repeated or you):
            return 0
        odd = repeated or not word.isalpha()  # patterns are asked only where they may match
        hidden = bool(odd and value >= 0 and self._value(plain(word)) < 0)
        capitals = 0 if small else len(CAPITALS.findall(token))
        shouts = len(SHOUT.findall(token)) if capitals > 2 else 0
        marks = 0 if letters else token.count("!")
        stops = 0 if letters else len(STOP.findall(token))
        mixed = len(MIXED.findall(token)) if odd else 0
        repeats = len(REPEAT.findall(token)) if odd or "___" in token else 0
        # weights in steps of 2**-20 add up exactly, in any order
        row = value < 0, hidden, round(max(0.0, value) * 2**20), you, capitals, shouts, marks, stops, mixed, repeats
        return self.rows.setdefault(row, len(self.rows))

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        """The row of each token."""
        if len(self.known) > MEMO or len(self.rows) > MEMO:
            self._forget()
        new = set(tokens).difference(self.known)
        self.known.update((t, self._row(t)) for t in new)
        out = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        for t in new:
            if len(t) > LONGEST:
                del self.known[t]
        return out

    def __call__(self, texts: list[str]) -> list[list[float]]:
        """The features of each text; texts of a group are counted together."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                out += self._counted(group)
                group, size = [], 0
        return out + self._counted(group)

    def _counted(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        tokens, ends = [], []
        for text in texts:
            tokens += TOKEN.findall(text)
            ends.append(len(tokens))
        numbers = self._numbers(tokens)
        ends = np.array(ends)
        starts = np.concatenate(([0], ends[:-1]))
        places = np.flatnonzero(numbers)  # tokens that count for something, and their texts
        of = np.searchsorted(ends, places, side="right")
        rows = np.array(list(self.rows), np.float64)[numbers[places]]
        strong, hidden, weak, you, capitals, shouts, marks, stops, mixed, repeats = (
            np.bincount(of, weights=rows[:, k], minlength=len(texts)) for k in range(10))
        # found words with a second person up to three words before or behind them in their text
        yous, hit = places[rows[:, 3] > 0], rows[:, 0] + rows[:, 1] > 0
        low = np.maximum(starts[of[hit]], places[hit] - 3)
        high = np.minimum(ends[of[hit]], places[hit] + 4)
        close = np.searchsorted(yous, high) > np.searchsorted(yous, low)
        near = np.bincount(of[hit][close], minlength=len(texts))
        count, found = ends - starts, strong + hidden
        n = count + FEW_WORDS  # a rate in a few words says little
        size = np.array([len(t) for t in texts]) + FEW_CHARS
        between = np.array([sum(map(t.count, ",;:?")) for t in texts])
        return np.column_stack([
            100.0 * found / n, found, 100.0 * weak / 2**20 / n, near / np.maximum(1, found), 100.0 * you / n, capitals / size,
            100.0 * shouts / n, 100.0 * marks / n, (stops + between) / size, 100.0 * mixed / n, 100.0 * hidden / n,
            100.0 * repeats / n, np.minimum(count, 5000)]).tolist()


class Model(NamedTuple):
    """What scoring needs; trees and calibration are None where the labelled
    rows hold one class only, and every score is ``base`` then."""

    strong: dict[str, float]
    weak: dict[str, float]
    trees: object
    calibration: object
    base: float


def remainder(doc_id):
    return F.crc32(doc_id.cast("string")) % 4


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """part (first, second, trees, calibration), toxic, text of the rows the fit
    may use: ``max_rows`` of each part at most. Null labels and held-out rows
    are left out."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    part = F.when(crc % 4 == 0, "first").when(crc % 4 == 1, "second").when(crc % 8 == 3, "trees").when(crc % 8 == 7, "calibration")
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
             .where("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("part", part)
             .where("part is not null"))
    picked = None
    for name in ("first", "second", "trees", "calibration"):
        some = known.where(F.col("part") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = some if picked is None else picked.union(some)
    # at most four times max_rows pairs of numbers
    return cut_lineage(_texts(docs).join(F.broadcast(picked), "doc_id").select("part", "toxic", "text"))


def lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(strong, weak) entries with their log-odds, by documents that hold them;
    ``CANDIDATES`` entries at most reach the driver, ``LEXICON_WORDS`` stay."""
    def behind(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            pairs = set()
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                for before, w in zip(["", *words], words):
                    if w.isalpha():
                        pairs.update((e, before) for e in entries_of(w))
            entry, before = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), pa.array(before, pa.string())],
                                             ["entry", "before"])

    support = (rows.where("toxic = 1").select("text").mapInArrow(behind, "entry string, before string").distinct()
               .groupBy("entry").count().where(F.col("count") >= MIN_SUPPORT)
               .orderBy(F.desc("count"), "entry").limit(CANDIDATES).collect())
    shared = rows.sparkSession.sparkContext.broadcast({r.entry for r in support})

    def held(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            entry, toxic = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {e for w in set(words_of(text)) if w.isalpha() for e in entries_of(w)} & shared.value
                entry += found
                toxic += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), pa.array(toxic, pa.int32())],
                                             ["entry", "toxic"])

    total = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    counts = {r.entry: (r.bad, r.good) for r in rows.select("toxic", "text").mapInArrow(
        held, "entry string, toxic int").groupBy("entry").agg(
            F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).collect()}
    # a stem says no more than its longer entry if nearly the same documents hold both
    longer: dict[str, int] = {}
    for e, (b, _) in counts.items():
        for k in STEMS:
            if len(e) > k and e[:k] in counts:
                longer[e[:k]] = max(longer.get(e[:k], 0), b)
    before = {r.entry: r["count"] for r in support}
    odds = {}
    for e, (b, g) in counts.items():
        b = min(b, before[e])
        if longer.get(e, 0) < 0.9 * b:
            odds[e] = math.log((b + 0.5) * (good + 1.0) / ((g + 0.5) * (bad + 1.0))), b
    top = sorted((e for e in odds if odds[e][0] > 1), key=lambda e: (-odds[e][0] * odds[e][1], e))[:LEXICON_WORDS]
    strong = {e: odds[e][0] for e in top if odds[e][0] > STRONG_ODDS and odds[e][1] >= STRONG_SHARE * bad}
    return strong, {e: odds[e][0] for e in top if e not in strong}


def _featured(rows: DataFrame, keep: str, kind: str, strong: dict, weak: dict) -> DataFrame:
    """``keep`` and the features of ``text`` as a vector."""
    from pyspark.ml.functions import array_to_vector

    shared = rows.sparkSession.sparkContext.broadcast((strong, weak))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features(*shared.value)
        for batch in batches:
            got = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], [keep, "x"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, x array<double>").withColumn(
        "features", array_to_vector("x")).drop("x")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, trees: int = 12, depth: int = 3) -> Model:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import IsotonicRegression

    rows = labelled(docs, labels, max_rows)
    parts = {p: rows.where(F.col("part") == p) for p in ("first", "second", "trees", "calibration")}
    first, second, whole = map(lexicon, (parts["first"], parts["second"], parts["first"].union(parts["second"])))
    sums = rows.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()
    count, toxic = sum(r.n for r in sums), sum(r.toxic for r in sums)
    checked = {r.part: (r.toxic, r.n) for r in sums}.get("calibration", (0, 0))
    base = toxic / count if count else 0.0
    if not 0 < checked[0] < checked[1] or not 0 < toxic - checked[0] < count - checked[1]:
        return Model(*whole, None, None, base)
    label = F.col("toxic").cast("double").alias("label")
    train = _featured(parts["first"], "toxic", "int", *second)
    for part, known in (("second", first), ("trees", whole)):
        train = train.union(_featured(parts[part], "toxic", "int", *known))
    train = cut_lineage(train.select(label, "features")).coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=3).fit(train)
    raw = _raw(model, _featured(parts["calibration"], "toxic", "int", *whole)).select(label, F.col("raw"))
    # a step of the calibration rests on a bin of rows, not on two or three
    size = max(5, min(BIN_ROWS, checked[1] // 12))
    order = Window.orderBy("raw")  # max_rows rows at most
    bins = (raw.withColumn("bin", F.ntile(max(1, checked[1] // size)).over(order)).groupBy("bin")
            .agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count("*").cast("double").alias("n")))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="n").fit(bins)
    return Model(*whole, model, calibration, base)


def _raw(model, featured: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(featured).withColumn("raw", vector_to_array("probability")[1])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    A null text scores as an empty one; a null doc_id stays null and is not
    held out; repeated rows give repeated results; an empty table gives no
    rows; texts of any length are read whole. Scores lie between 0 and 1.
    """
    texts = _texts(docs)
    if model.trees is None:
        scored = texts.select("doc_id", F.lit(float(model.base)).alias("score"))
    else:
        raw = _raw(model.trees, _featured(texts, "doc_id", "bigint", model.strong, model.weak))
        # equal calibrated values are told apart by the trees' own order
        scored = model.calibration.transform(raw.select("doc_id", "raw")).select(
            "doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction") * 0.999 + F.col("raw") * 0.001))
            .alias("score"))
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, without the rows predicted toxic. The
    decision is taken in the scan; nothing is shuffled.

    Without a classifier (no labels, or labels of one class only) nothing tells
    rows apart and all are kept, whatever the share of toxic labels. A null text
    is judged as an empty one; repeated rows are kept or dropped alike; an empty
    table stays empty.
    """
    from pyspark.ml.functions import array_to_vector

    rows = docs.select(F.struct("*").alias("all"))
    if model.trees is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.strong, model.weak))

    @F.pandas_udf("array<double>")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(*shared.value)
        for texts in batches:
            yield pd.Series(features(texts.fillna("").tolist()), dtype=object)

    raw = _raw(model.trees, rows.withColumn("features", array_to_vector(extracted("all.text"))))
    scored = model.calibration.transform(raw.select("all", "raw"))
    return scored.where(F.col("prediction") * 0.999 + F.col("raw") * 0.001 < threshold).select("all.*")
