"""Phrase collocation mining by best-first branch and bound.

Phrases are runs of 2 to ``MAX_WORDS`` words inside a piece of text. A phrase
is a candidate from ``MIN_COUNT`` occurrences; its score is the smallest of
floor(1000 * a * n / (l * r)) over its cuts into a first part (l occurrences)
and a rest (r), of n words in its language (see ``score``).

Search tree: a phrase's children are its extensions by one word to the right.
A phrase occurs no more often than its parts, so the cut after the first word
gives a bound for it and for all its descendants from counts of prefixes:
score <= 1000 * n / f(first word). The same cut from the other end bounds the
phrase itself: score <= 1000 * n / f(last word).

Frontier: the counted two-word prefixes. Per language they are expanded in
tiers, highest bound first (``TIER_SHARES`` of the word occurrences). A round
expands one tier of all languages by two passes over the texts: ``grow`` counts
the descendants of the tier's prefixes, ``support`` counts the rests that their
cuts need and sees what stands left and right of each phrase. Then every
candidate that begins in the tier is settled: a candidate inside an equally
frequent longer one, that is, one with the same word left or right of all its
occurrences, is dropped, the others are scored. The ``top``-th settled score of
a language closes its frontier: prefixes whose bound is below it are never
expanded (those equal to it are, for ties). Rounds end when no prefix is left.

Passes: texts are split in numpy in tasks, counted per buffer of
``BUFFER_BYTES``, then summed by Spark, keyed by language and the phrase itself.
Which phrases a pass looks at is told by bitmaps of ``FILTER_BITS`` hashed
phrases, of fixed size whatever the corpus: a false hit costs a row, never
changes a count. Neighbours are compared by 64-bit hashes; a candidate would be
wrongly dropped only if different words of one hash were all its neighbours.

Defined cases. A null text is empty, a null language ``und``. Repeated rows
count again; doc_ids are not read. Ties of score go to the larger count, then
to the smaller phrase in bytes; ties of cuts to the shorter first part. An
empty table, and a language without candidates, give no rows. Texts are read
whole; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlake.llm.runs import BREAK, split_runs
from airlake.llm.store import stored

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Shares of a language's word occurrences, rare first words first, up to which a tier reaches.
TIER_SHARES = (1 / 8, 1.0)
FILTER_BITS = 26
BUFFER_BYTES = 8 << 20
ROWS_OUT = 1 << 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)


class Words:
    """The words of a buffer of texts of one language: ``code`` per word, an
    index into its ``vocabulary``, and ``piece``, the number of its piece."""

    def __init__(self, lang: str, texts: list[bytes]):
        import numpy as np
        import xxhash

        self.code, self.piece, self.vocabulary = split_runs(BREAK.join(texts).translate(LOWER))
        self.hash = np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary.to_pylist()], np.uint64)
        self.seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))

    def __len__(self) -> int:
        return len(self.code)

    def hashes(self, most: int) -> Iterator:
        """For 1 to ``most`` words: hash of the phrase that begins at each word, and whether it lies in one piece."""
        import numpy as np

        h = self.hash[self.code] if len(self) else np.zeros(0, np.uint64)
        phrase = np.full(len(self), self.seed)
        for k in range(1, most + 1):
            at = max(len(self) - k + 1, 0)
            whole, step = np.zeros(len(self), bool), np.zeros(len(self), np.uint64)
            whole[:at] = self.piece[:at] == self.piece[k - 1:]
            step[:at] = h[k - 1:]
            phrase = mix(phrase, step)
            yield phrase, whole

    def groups(self, starts, k: int, prefix_key=None):
        """Distinct phrases of ``k`` (2 or more) words at ``starts``: the dense
        key of each start, one start of each key. ``prefix_key``: keys of the
        first k - 1 words, if known."""
        import numpy as np

        key = self.code[starts] if prefix_key is None else prefix_key
        for i in range(1 if prefix_key is None else k - 1, k):
            key = np.unique(key * len(self.vocabulary) + self.code[starts + i], return_inverse=True)[1]
        example = np.empty(int(key.max()) + 1 if len(key) else 0, np.int64)
        example[key] = starts
        return key, example

    def phrases(self, example, k: int):
        """The phrases of ``k`` words that begin at ``example``, as strings."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words = [self.vocabulary.take(pa.array(self.code[example + i])).cast(pa.string()) for i in range(k)]
        return pc.binary_join_element_wise(*words, " ")


def mix(state, word):
    """One step of the 64-bit phrase hash, over numpy arrays."""
    import numpy as np

    state = (state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    return (state ^ (state >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def bit_of(phrase, bits: int):
    import numpy as np

    return (phrase ^ (phrase >> np.uint64(31))) >> np.uint64(64 - bits)


def hits(bitmap, phrase):
    import numpy as np

    bit = bit_of(phrase, len(bitmap).bit_length() + 5)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(table: DataFrame, bits: int):
    """A bitmap of 2 ** ``bits`` bits, those of the phrases of ``table`` (lang, phrase) set."""
    import numpy as np

    def cells(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            seeds: dict[str, int] = {}
            words: dict[str, int] = {}
            rows: dict[int, list] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = phrase.split(" ")
                row = [seeds.get(lang) or seeds.setdefault(lang, xxhash.xxh64_intdigest(lang.encode(), 1))]
                row += [words.get(w) or words.setdefault(w, xxhash.xxh64_intdigest(w.encode())) for w in parts]
                rows.setdefault(len(parts), []).append(row)
            for same in rows.values():
                columns = np.array(same, np.uint64).T
                bit = bit_of(reduce(mix, columns), bits)
                mask = np.uint64(1) << (bit & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)),
                                                  pa.array(mask.view(np.int64))], ["cell", "mask"])

    found = (table.select("lang", "phrase").mapInArrow(cells, "cell bigint, mask bigint")
             .groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow())
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[found["cell"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return bitmap


def over_buffers(docs: DataFrame, look: Callable[[Words], Iterator], schema: str, buffer_bytes: int) -> DataFrame:
    """``look`` applied to every buffer of texts of one language: it yields
    columns after ``lang`` as Arrow arrays."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(lang: str, texts: list[bytes]) -> Iterator:
            for columns in look(Words(lang, texts)):
                out = pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *columns], names)
                yield from (out.slice(i, ROWS_OUT) for i in range(0, out.num_rows, ROWS_OUT))

        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                waiting.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= buffer_bytes:
                    yield from flush(lang, waiting.pop(lang))
                    size.pop(lang)
            if sum(size.values()) >= 2 * buffer_bytes:  # many languages, little of each
                for lang in list(waiting):
                    yield from flush(lang, waiting.pop(lang))
                size.clear()
        for lang, texts in waiting.items():
            yield from flush(lang, texts)

    return docs.mapInArrow(run, schema)


COUNTED = "lang string, phrase string, c bigint"
AROUND = ", left_least bigint, left_most bigint, lefts bigint, right_least bigint, right_most bigint, rights bigint"


def counted(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("c").alias("c")).where(F.col("c") >= least)


def count_words(docs: DataFrame, buffer_bytes: int) -> DataFrame:
    """(lang, phrase, c) of all words; the row without a phrase counts all of a language."""
    def look(words: Words) -> Iterator:
        import numpy as np
        import pyarrow as pa

        yield words.vocabulary.cast(pa.string()), pa.array(np.bincount(words.code, minlength=len(words.vocabulary)).astype(np.int64))
        yield pa.array([None], pa.string()), pa.array([len(words)], pa.int64())

    return over_buffers(docs, look, COUNTED, buffer_bytes).groupBy("lang", "phrase").agg(F.sum("c").alias("c"))


def count_pairs(docs: DataFrame, frequent, buffer_bytes: int) -> DataFrame:
    """(lang, phrase, c) rows of pairs of words that both hit the bitmap ``frequent``."""
    def look(words: Words) -> Iterator:
        import numpy as np
        import pyarrow as pa

        (one, _), (_, whole) = words.hashes(2)
        often = hits(frequent.value, one)
        whole[:-1] &= often[1:]
        starts = np.flatnonzero(whole & often)
        key, example = words.groups(starts, 2)
        yield words.phrases(example, 2), pa.array(np.bincount(key, minlength=len(example)).astype(np.int64))

    return over_buffers(docs, look, COUNTED, buffer_bytes)


def grow(docs: DataFrame, prefixes, pairs, longest: int, buffer_bytes: int) -> DataFrame:
    """(lang, phrase, c) rows of phrases of 3 to ``longest`` words that begin
    with a pair that hits ``prefixes`` and hold only pairs that hit ``pairs``."""
    def look(words: Words) -> Iterator:
        import numpy as np
        import pyarrow as pa

        *_, (two, whole) = words.hashes(2)
        linked = hits(pairs.value, two) & whole
        starts = np.flatnonzero(linked & hits(prefixes.value, two))
        key = words.groups(starts, 2)[0]
        linked = np.append(linked, np.zeros(longest, bool))
        for k in range(3, longest + 1):
            on = linked[starts + k - 2]
            starts, key = starts[on], key[on]
            key, example = words.groups(starts, k, key)
            yield words.phrases(example, k), pa.array(np.bincount(key, minlength=len(example)).astype(np.int64))

    return over_buffers(docs, look, COUNTED, buffer_bytes)


def support(docs: DataFrame, wanted, longest: int, buffer_bytes: int) -> DataFrame:
    """(lang, phrase, c) rows of phrases of 2 to ``longest`` words that hit
    ``wanted``, with least and greatest neighbour (hashed) and number of
    neighbours on either side."""
    def look(words: Words) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not len(words):
            return
        hashed = words.hash.view(np.int64)[words.code]
        same = words.piece[1:] == words.piece[:-1]
        has_left, has_right = np.append(False, same), np.append(same, False)
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        for k, (phrase, whole) in enumerate(words.hashes(longest), 1):
            if k == 1:
                continue
            starts = np.flatnonzero(whole & hits(wanted.value, phrase))
            if not len(starts):
                continue
            key, example = words.groups(starts, k)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
            columns = [words.phrases(example, k), pa.array(np.bincount(key).astype(np.int64))]
            for there, at in ((has_left[starts], np.maximum(starts - 1, 0)),
                              (has_right[starts + k - 1], np.minimum(starts + k, len(words) - 1))):
                there, near = there[order], hashed[at][order]
                columns += [pa.array(np.minimum.reduceat(np.where(there, near, most), cuts)),
                            pa.array(np.maximum.reduceat(np.where(there, near, least), cuts)),
                            pa.array(np.add.reduceat(there.astype(np.int64), cuts))]
            yield columns

    return over_buffers(docs, look, COUNTED + AROUND, buffer_bytes)


def settled(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, c, inside): summed ``support`` rows; ``inside`` if the same word stands on one side of all occurrences."""
    one_sided = [f"({s}s = c and {s}_least = {s}_most)" for s in ("left", "right")]
    return rows.groupBy("lang", "phrase").agg(
        F.sum("c").alias("c"), *(f(f"{s}_{n}").alias(f"{s}_{n}") for s in ("left", "right") for n, f in (("least", F.min), ("most", F.max))),
        F.sum("lefts").alias("lefts"), F.sum("rights").alias("rights"),
    ).where(F.col("c") >= least).selectExpr("lang", "phrase", "c", f"{' or '.join(one_sided)} as inside")


def tiers(words: DataFrame, totals: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(lang, first, f, n, bound, tier) of the frequent words: the tier of a
    word follows from the occurrences of rarer words, told apart by octave quarters."""
    words = words.select("lang", F.col("phrase").alias("first"), F.col("c").alias("f"), F.floor(F.log2("c") * 4).alias("step"))
    steps = words.groupBy("lang", "step").agg(F.sum("f").alias("mass"))
    rarer = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("mass").over(rarer), F.lit(0)) / F.sum("mass").over(Window.partitionBy("lang"))
    tier = reduce(lambda t, s: t + F.when(share >= s, 1).otherwise(0), shares[:-1], F.lit(0))
    return (words.join(steps.select("lang", "step", tier.alias("tier")), ["lang", "step"]).join(totals, "lang")
            .select("lang", "first", "f", "n", bound("f").alias("bound"), "tier"))


def bound(count: str) -> F.Column:
    """Admissible bound of phrases that begin or end with a word of this count."""
    return F.expr(f"(1000 * cast(n as decimal(19,0))) div cast({count} as decimal(19,0))")


def score(kept: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates ``kept`` (lang,
    phrase, a, n): their lowest cut, exact in decimals."""
    cut = kept.selectExpr("*", "size(split(phrase, ' ')) as words").selectExpr("*", "explode(sequence(1, words - 1)) as k")
    cut = cut.selectExpr("*", "substring_index(phrase, ' ', k) as head", "substring_index(phrase, ' ', k - words) as rest")
    for part, name in (("head", "l"), ("rest", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(part), F.col("c").alias(name)), ["lang", part])
    cut = cut.withColumn("score", F.expr(
        "(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    low = F.min(F.struct("score", "k", "l", "r")).alias("low")
    return cut.groupBy("lang", "phrase", "a", "n").agg(low).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
         tier_shares: tuple[float, ...] = TIER_SHARES, filter_bits: int = FILTER_BITS,
         buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``
    surviving phrases of 2 to ``max_words`` words."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sent = lambda table: sc.broadcast(bitmap_of(table, filter_bits))

    counts = stored(count_words(docs, buffer_bytes).where((F.col("c") >= min_count) | F.col("phrase").isNull()))
    totals = counts.where("phrase is null").select("lang", F.col("c").alias("n"))
    words = counts.where("phrase is not null")
    firsts = stored(tiers(words, totals, tier_shares))
    pairs = stored(counted(count_pairs(docs, sent(words), buffer_bytes), min_count))
    all_pairs = sent(pairs)

    best = longer_known = None
    for tier in range(len(tier_shares)):
        opened = firsts.where(F.col("tier") == tier)
        if best is not None:  # prefixes that cannot reach the last rank any more stay closed
            closing = best.where(F.col("rank") == top).select("lang", F.col("score").alias("least"))
            opened = opened.join(closing, "lang", "left").where("least is null or bound >= least").drop("least")
        first = F.substring_index("phrase", " ", 1).alias("first")
        frontier = stored(pairs.select("lang", "phrase", first).join(opened, ["lang", "first"], "left_semi"))
        if frontier.isEmpty():
            continue
        longer = stored(counted(grow(docs, sent(frontier), all_pairs, max_words, buffer_bytes), min_count))
        n_words = F.size(F.split("phrase", " "))
        rests = longer.selectExpr("lang", "phrase as whole", "explode(sequence(3, size(split(phrase, ' ')))) as k").selectExpr(
            "lang", "substring_index(whole, ' ', -k) as phrase")
        seen = stored(settled(support(docs, sent(rests.unionByName(frontier.select("lang", "phrase"))), max_words,
                                      buffer_bytes), min_count))
        more = seen.where(n_words > 2).select("lang", "phrase", "c")
        longer_known = more if longer_known is None else longer_known.unionByName(more).distinct()
        whole = (~F.col("inside")) | (n_words == max_words)
        kept = seen.where(whole).select("lang", "phrase", F.col("c").alias("a"), first).join(opened, ["lang", "first"])
        if best is not None:
            last = firsts.select("lang", F.col("first").alias("last"), F.col("bound").alias("last_bound"))
            kept = (kept.withColumn("last", F.substring_index("phrase", " ", -1)).join(last, ["lang", "last"])
                    .join(closing, "lang", "left").where("least is null or last_bound >= least"))
        found = score(kept.select("lang", "phrase", "a", "n"), words.unionByName(pairs).unionByName(longer_known))
        best = stored(ranked(found if best is None else found.unionByName(best.drop("rank")), top))
    if best is None:
        best = counts.sparkSession.createDataFrame(
            [], "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint, rank int")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
