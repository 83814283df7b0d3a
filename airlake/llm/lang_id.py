"""Language identification, words first, then shorter and shorter n-grams.

Learning: words of all labelled documents are counted per language, and from
the counted words their character n-grams (``LONGEST`` to 1, word ends marked).
The model holds log relative frequencies per language: of the relatively most
frequent words, ``MAX_WORDS`` (language, word) pairs at most, and of n-grams,
``MAX_GRAMS`` pairs at most for each length. Which pairs those are follows from
a histogram of frequencies, so nothing but the chosen pairs leaves Spark.

Scoring: a word of the model counts with its log frequencies; a language that
lacks it counts ``FLOOR``. An unseen word backs off: it counts the mean of its
n-grams of the greatest length, an unseen n-gram the mean of the two that are
one shorter, an unseen character nothing. A text's score is the share of its
best language in the likelihoods of all; equal languages go to the first in
byte order.

A word is a run of letters (Unicode), lower-cased. Defined cases: a null text
or one without a letter is ``und`` with score 0, as is every text if nothing
was learned; a null doc_id is neither held out nor learned from; rows with a
null language are never learned from. Repeated rows give repeated results and
count again in learning. Empty table: no rows. Texts are read whole; words of
over ``LONGEST_WORD`` characters are only known by their n-grams. Further
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlake.llm.runs import BREAK, split_runs
from airlake.llm.store import stored

MAX_WORDS = 300_000
MAX_GRAMS = 100_000
LONGEST = 4
LONGEST_WORD = 40
LEAST_COUNT = 2
FLOOR = -16.0
FOLDS = 5
BUFFER_BYTES = 8 << 20
CACHED_GRAMS = 200_000
#: ASCII: letters lower-cased, all else blank; other bytes stay.
TO_WORDS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 if b < 128 else b for b in range(256))
LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    languages: list[str]
    words: dict[str, int]  # row of ``word_logs``
    word_logs: object  # one column per language
    grams: dict[str, int]
    gram_logs: object


def remainder(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def letter_runs(run: bytes) -> list[str]:
    """The words in a run without ASCII marks."""
    text = run.decode()
    if text.isascii():
        return [text]
    return [w for w in LETTERS.findall(text.lower()) if any(map(str.isalpha, w))]


def count_words(docs: DataFrame, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """(lang, word, c) of ``docs`` (lang, text)."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flush(lang: str, texts: list[bytes]) -> Iterator:
            code, _, found = split_runs(BREAK.join(texts).translate(TO_WORDS))
            counts: Counter = Counter()
            for run, c in zip(found.to_pylist(), np.bincount(code, minlength=len(found)).tolist()):
                for word in letter_runs(run):
                    counts[word] += c
            out = pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(counts, pa.string()),
                                              pa.array(counts.values(), pa.int64())], ["lang", "word", "c"])
            yield from (out.slice(i, 1 << 16) for i in range(0, out.num_rows, 1 << 16))

        waiting: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                waiting.setdefault(lang, []).append(text)
                size += len(text)
                if size >= buffer_bytes:
                    for key in list(waiting):
                        yield from flush(key, waiting.pop(key))
                    size = 0
        for lang, texts in waiting.items():
            yield from flush(lang, texts)

    return docs.mapInArrow(run, "lang string, word string, c bigint").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def grams_of(word: str, n: int) -> list[str]:
    marked = f"_{word}_"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)] or [marked]


def count_grams(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, gram, c) of ``words`` (lang, word, c), for all lengths."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts: Counter = Counter()
            for lang, word, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for n in range(1, longest + 1):
                    if len(word) + 2 >= n:
                        for gram in grams_of(word, n):
                            counts[lang, gram] += c
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                 pa.array(counts.values(), pa.int64())], ["lang", "gram", "c"])

    return words.mapInArrow(run, "lang string, gram string, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def most_frequent(rows: DataFrame, key: str, totals: DataFrame, most: int) -> DataFrame:
    """(lang, key, log) of the relatively most frequent pairs, at most ``most``
    of each length class: whole steps of an eighth of an octave."""
    rows = rows.join(totals, ["lang", "kind"]).withColumn("log", F.log(F.col("c") / F.col("total")))
    rows = rows.withColumn("step", F.ceil(-F.col("log") / F.log(F.lit(2.0)) * 8))
    steps = rows.groupBy("kind", "step").agg(F.count("*").alias("pairs"))
    reach = F.sum("pairs").over(Window.partitionBy("kind").orderBy("step"))
    limits = steps.withColumn("reach", reach).where(F.col("reach") <= most).groupBy("kind").agg(F.max("step").alias("last"))
    return rows.join(limits, "kind").where("step <= last").select("lang", key, "log")


def fit(docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with a language,
    but for the held-out fold (crc32 of the decimal doc_id divisible by ``FOLDS``)."""
    import numpy as np

    learned = docs.where((remainder() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    words = stored(count_words(learned).withColumn("kind", F.lit(0)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.select("lang", "word", "c").repartition(parts, "lang", "word")
    grams = stored(count_grams(dealt).withColumn("kind", F.length("gram")))
    total = lambda rows: rows.groupBy("lang", "kind").agg(F.sum("c").alias("total"))
    known = words.where((F.length("word") <= LONGEST_WORD) & (F.col("c") >= LEAST_COUNT))
    chosen = [most_frequent(known, "word", total(words), max_words).toArrow(),
              most_frequent(grams, "gram", total(grams), max_grams).toArrow()]
    languages = sorted({lang for table in chosen for lang in table.column(0).to_pylist()}, key=str.encode)
    column = {lang: i for i, lang in enumerate(languages)}
    parts: list = [languages]
    for table in chosen:
        lang, key, log = (c.to_pylist() for c in table.columns)
        row = {k: i for i, k in enumerate(sorted(set(key)))}
        logs = np.full((len(row), len(languages)), FLOOR)
        logs[[row[k] for k in key], [column[x] for x in lang]] = np.maximum(log, FLOOR)
        parts += [row, logs]
    return Model(*parts)


class Scorer:
    """Log frequencies of words under a model; cached n-grams are bounded."""

    def __init__(self, model: Model):
        self.model = model
        self.cached: dict = {}

    def gram(self, gram: str):
        """An unseen n-gram backs off to the two that are one shorter."""
        import numpy as np

        if gram in self.model.grams:
            return self.model.gram_logs[self.model.grams[gram]]
        if len(gram) == 1:
            return np.zeros(len(self.model.languages))
        if gram not in self.cached:
            if len(self.cached) >= CACHED_GRAMS:
                self.cached.clear()
            self.cached[gram] = (self.gram(gram[:-1]) + self.gram(gram[1:])) / 2
        return self.cached[gram]

    def word(self, word: str):
        import numpy as np

        if word in self.model.words:
            return self.model.word_logs[self.model.words[word]]
        return np.mean([self.gram(g) for g in grams_of(word, LONGEST)], axis=0)

    def run(self, run: bytes):
        """Sum over the words in a run; their number."""
        words = letter_runs(run)
        return sum(map(self.word, words)), len(words)

    def texts(self, texts: list[bytes]):
        """Per text: total log frequency of each language, number of words."""
        import numpy as np

        code, text, found = split_runs(BREAK.join(texts).translate(TO_WORDS))
        runs = [self.run(r) for r in found.to_pylist()]
        logs = np.zeros((len(runs), len(self.model.languages)))
        for i, (total, _) in enumerate(runs):
            logs[i] = total
        counts = np.array([n for _, n in runs], np.float64)
        summed = lambda values: np.bincount(text, weights=values[code], minlength=len(texts))
        return np.stack([summed(logs[:, i]) for i in range(logs.shape[1])], axis=1), summed(counts)


def predict(docs: DataFrame, model: Model, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        scorer = Scorer(sent.value)
        names = np.array([*sent.value.languages, "und"], object)

        def flush(rows: list) -> pa.RecordBatch:
            ids, held, texts = zip(*rows)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if len(names) > 1:
                logs, n_words = scorer.texts(list(texts))
                some = n_words > 0
                best[some] = logs[some].argmax(axis=1)
                score[some] = 1 / np.exp(logs[some] - logs[some].max(axis=1, keepdims=True)).sum(axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(names[best], pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.binary()).to_pylist()):
                rows.append(row)
                size += len(row[2]) + 16
                if size >= buffer_bytes:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
