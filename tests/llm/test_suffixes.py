import os
import re
import time
from collections import Counter

import numpy as np
import pytest

from airlake.llm import suffixes
from airlake.llm.queries import op6_suffix_dedup
from airlake.llm.store import FILE_CLEANUP, shuffles_removed
from airlake.llm.suffixes import LENGTH, anchors, remove_repeats
from airlake.session import ensure_checkpoint_dir


def expected(texts):
    """Counts every string of LENGTH bytes, one by one."""
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i:i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - LENGTH + 1):
            if often[d[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = True
        runs = int((gone[1:] & ~gone[:-1]).sum()) + bool(gone[0])
        out.append((len(d), int(gone.sum()), runs, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def planted(seed=3):
    rng = np.random.default_rng(seed)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(400)] + ["é", "ßü"]

    def prose(n):
        return " ".join(rng.choice(words, n))
    passage, long_, line = prose(90), prose(400), prose(20)
    texts = [prose(int(n)) for n in rng.integers(1, 300, 20)]
    texts += [prose(50) + passage + prose(60), passage + prose(30), prose(30) + passage]
    texts += [prose(40) + passage[3:-5] + prose(10), prose(30) + passage[:LENGTH] + "x", "y" + passage[:LENGTH - 1]]
    texts += [long_, long_, long_[:700] + "#" + long_[700:], long_[10:900], prose(20) + long_[500:1400]]
    texts += [prose(30) + line + prose(30) for _ in range(8)]
    texts += ["\n".join([line] * 12), "ab" * 700, "a" * 500, "a" * 399, "a" * 400, None, "", prose(2000)]
    return texts


@pytest.mark.parametrize("block", [suffixes.BLOCK, 2])
def test_planted_repeats(make_docs, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)  # 2: keys are counted by window
    texts = planted()
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(make_docs(texts)).collect()}
    for i, want in enumerate(expected(texts)):
        assert (*got[i][:3], bytes(got[i][3])) == want, (i, got[i][:3], want[:3])


def test_passages_of_over_50_words(make_docs, tmp_path):
    """All that share a passage of LENGTH bytes are caught, by n_removed; shorter passages stay, however many words."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(3, 10))))
    prose = lambda n: " ".join(word() for _ in range(n))
    long_, short, texts = set(), set(), []
    for n in (51, 52, 55, 60, 65, 70, 80, 120) * 3:
        passage = prose(n)
        size = len(passage)
        if LENGTH - 20 < size < LENGTH:  # equal neighbours could make it long enough
            continue
        for _ in range(2):
            (long_ if size >= LENGTH else short).add(len(texts))
            texts.append(f"{prose(rng.integers(1, 200))} {passage} {prose(rng.integers(1, 200))}")
        texts.append(prose(rng.integers(100, 400)))
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op6_suffix_dedup(make_docs([]).sparkSession, str(tmp_path)).collect()}
    assert len(long_) >= 20 and len(short) >= 10 and len(got) == len(texts)
    assert {i for i, r in got.items() if r.n_removed} == long_
    assert all(r.n_removed >= LENGTH and r.n_spans == 1 for i, r in got.items() if i in long_)
    assert all(r.n_bytes == len(texts[i]) for i, r in got.items())  # the input's size, whatever goes


def test_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(documents).collect())
    assert got == Counter((r.doc_id, *w) for r, w in zip(rows, expected([r.text for r in rows])))


def test_edges(edge_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(edge_docs).collect())
    assert got == Counter((r.doc_id, *w) for r, w in zip(rows, expected([r.text for r in rows])))
    assert remove_repeats(edge_docs.limit(0)).count() == 0


def test_anchors_do_not_depend_on_the_chunk(monkeypatch):
    text = "".join(map(chr, np.random.default_rng(0).integers(97, 101, 5000))).encode()
    whole = [x.tolist() for x in anchors(text)]
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    assert [x.tolist() for x in anchors(text)] == whole


def test_equal_hashes_of_different_strings(monkeypatch):
    monkeypatch.setattr(suffixes, "_window_hashes", lambda data, n: np.zeros(n, np.uint64))
    a, b = bytes(range(200)) * 3, bytes(range(199, -1, -1)) * 3
    runs = suffixes.repeated_windows([(1, 9, 5, a), (1, 9, 5, b), (1, 8, 4, a[1:]), (2, 9, 5, a)])
    assert [sorted(x for r in m for x in range(r[0], r[1] + 1)) for m in runs] == [[1, 2, 3, 4], [], [0, 1, 2, 3], []]


def test_levels_merge_geometrically(make_docs):
    from pyspark.sql import functions as F
    found = suffixes.stored(suffixes.entries(make_docs(planted())))
    family = suffixes.SuffixFamily()
    ranks = []
    for b in range(6):
        family.add(found.where(F.pmod("row", F.lit(6)) == b))
        ranks.append(sorted(family.levels))
    assert ranks == [[0], [1], [0, 1], [2], [0, 2], [1, 2]]
    assert {bytes(r.seg): r.n for r in family.classes().collect()} == {
        bytes(r.seg): r["count"] for r in found.groupBy("seg").count().collect()}


def test_steps_leave_only_what_is_read(spark, make_docs):
    shared = re.sub("^file:(//)?", "", ensure_checkpoint_dir(spark))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for top in blocks.localDirsString() for d, _, names in os.walk(top) for f in names
                if re.match(r"shuffle_.*\.data$", f)}
    texts = planted()
    docs = make_docs(texts).persist()  # what others keep stays
    docs.count()
    tables, before = set(os.listdir(shared)), shuffles()
    out = remove_repeats(docs)
    assert len([t for t in set(os.listdir(shared)) - tables if t.startswith("airlake-")]) == 2  # spans and parts
    end = time.time() + 20
    while (left := shuffles() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    want = Counter(w[:3] for w in expected(texts))
    for _ in range(2):  # a result can be computed again
        assert Counter((r.n_bytes, r.n_removed, r.n_spans) for r in out.collect()) == want
    assert docs.storageLevel.useMemory and docs.count() == len(texts)
    docs.unpersist()


def test_shuffle_setting_is_restored(spark):
    before = spark.conf.get(FILE_CLEANUP, None)
    with pytest.raises(ValueError), shuffles_removed(spark):
        assert spark.conf.get(FILE_CLEANUP) == "true"
        raise ValueError
    assert spark.conf.get(FILE_CLEANUP, None) == before


def test_a_merge_writes_one_level(make_docs, monkeypatch):
    found = suffixes.stored(suffixes.entries(make_docs(planted())))
    family, written = suffixes.SuffixFamily(), []
    monkeypatch.setattr(family, "_sorted", lambda classes: written.append(1) or suffixes.SuffixFamily._sorted(classes))
    counts = []
    for b in range(4):
        family.add(found.where(f"pmod(row, 4) = {b}"))
        counts.append(len(written))
    assert counts == [1, 3, 4, 6]  # the batch, and one level for all that merge into it
    assert sorted(family.levels) == [2]
    assert {bytes(r.seg): r.n for r in family.classes().collect()} == {
        bytes(r.seg): r["count"] for r in found.groupBy("seg").count().collect()}
    family.discard()
    assert not any(os.path.exists(re.sub("^file:(//)?", "", t.path)) for t in (*family.levels.values(), *family.found))
