import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from airlake.llm import bpe, packing
from airlake.llm.packing import Packer, pack
from airlake.llm.tokens import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return bpe.load(PATH)


def expected_counts(tok, rows):
    out = Counter()
    for r in rows:
        t = r.text or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        out[r.doc_id, len(t.encode()), n, n > 1024] += 1
    return out


@pytest.mark.parametrize("which", ["edge_docs", "documents"])
def test_token_counts_equal_the_library(which, tok, request):
    df = request.getfixturevalue(which)
    got = Counter(tuple(r) for r in token_counts(df, PATH).collect())
    assert got == expected_counts(tok, df.select("doc_id", "text").collect())


def test_token_counts_empty_table(edge_docs):
    assert token_counts(edge_docs.limit(0), PATH).count() == 0


def test_small_caches_and_table_do_not_change_counts(tok):
    texts = ["one two three two one", "three four  five six", "one one one", ""]
    count = bpe.Counter(PATH, {"two": 1}, entries=2)
    assert count(texts * 2) == [len(tok.encode(t).ids) for t in texts * 2]
    assert [n for t in texts * 2 for n in count([t])] == count(texts * 2)


def test_pieces_are_encoded_as_by_the_library(tok):
    merge = bpe.Merger(PATH)
    assert merge.fast is not None
    pieces = ["a", "", " <|endoftext|>", "<|endoftext", "|>", "é x", "  ", "b\n", " don't", " 12ab", " x\r\n\ty", "'S"]
    want = [np.asarray(tok.encode(p).ids, "<u4").tobytes() for p in pieces]
    assert merge(pieces) == want
    merge.fast = None
    assert merge(pieces) == want and merge(pieces[5:]) == want[5:] and merge([]) == []


def test_both_libraries_agree_on_every_sure_character(tok):
    merge = bpe.Merger(PATH)
    probes = [f"a{c}a1{c}1 {c}!{c}{c} '{c}s" for c in map(chr, range(0x530)) if c != "<"]
    assert not any(map(bpe.UNSURE.search, probes))
    want = [np.asarray(tok.encode(p).ids, "<u4").tobytes() for p in probes]
    assert merge._merged(probes) == want


def test_other_tokenizers_are_not_taken_for_ranked():
    assert bpe._ranked(public_tokenizers.path("word_bpe_49k.json")) is None


def check_packing(tok, rows, pieces):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc, text in rows:
        ids = np.asarray([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        at = 0
        for p in sorted(by_doc.pop(doc), key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) // 4
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[4 * p.start:4 * at])
        assert at == len(ids) // 4
    assert not by_doc
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == s[0].context <= 2048 and at & (at - 1) == 0
        assert len({p.step_group for p in s}) == 1


def test_packing_round_trip(tok, documents):
    docs = documents.repartition(4, "doc_id")
    check_packing(tok, [(r.doc_id, r.text) for r in documents.collect()], pack(docs, PATH).collect())


def test_packing_edges(tok, edge_docs):
    unique = edge_docs.where("doc_id is not null and doc_id <> 5")
    check_packing(tok, [(r.doc_id, r.text) for r in unique.collect()], pack(unique, PATH).collect())
    every = pack(edge_docs, PATH).collect()
    assert sum(p.length for p in every) == sum(
        len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in edge_docs.collect())
    assert pack(edge_docs.limit(0), PATH).count() == 0


def test_rounds_keep_windows_full(monkeypatch):
    monkeypatch.setattr(packing, "ROUND_TOKENS", 5000)
    rng = np.random.default_rng(1)
    p, total = Packer(3), 0
    for d, n in enumerate(rng.integers(1, 5000, 300)):
        p.add(d, np.full(n, d, "<u4").tobytes())
        total += n
    p.finish()
    size = Counter()
    for r in p.rows:
        size[r[5], r[7]] += r[2]
    assert sum(size.values()) == total and all(v == c for (_, c), v in size.items())
    steps = Counter()
    for (s, c) in size:
        steps[next(r[8] for r in p.rows if r[5] == s)] += c
    assert max(steps.values()) == packing.STEP_TOKENS


MIXED_TEXTS = ["", " ", "a b", " a  b ", "plain words “quoted” and – dashes, then words", "中文 字 abc 中 def  中文\n\n中 x",
               "a <|endoftext|> b <| c |>", "<|endoftext|>", "ends in 中 ", "中 ", " 中", "x" * 5000 + " " + "中" * 3000,
               "a" + " " * 300_000 + "b", "\n \n" * 200_000 + "x 中", "don't 12ab\r\n\tx"]


def test_whole_texts_are_encoded_as_by_the_library(tok):
    encode = bpe.Encoder(PATH)
    want = [np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in MIXED_TEXTS]
    assert list(encode(MIXED_TEXTS)) == want
    encode.merge.fast = None
    assert list(encode(MIXED_TEXTS)) == want
    count = bpe.Counter(PATH, {"b": 1})
    assert count(MIXED_TEXTS) == [len(x) // 4 for x in want]


def test_long_chunks_are_neither_cached_nor_counted(spark, tok):
    from airlake.llm.tokens import frequent_chunks

    long = ["a " + "é" * 100_000 + str(i) + " b b" for i in range(40)]
    count = bpe.Counter(PATH, {})
    assert count(long) == [len(tok.encode(t).ids) for t in long]
    assert count(["a b"]) == [2] and max(map(len, [*count.rest, *count.rest.long])) <= bpe.LONGEST_CHUNK
    texts = spark.createDataFrame([(t,) for t in long], "text string")
    assert set(frequent_chunks(texts)) == {"b"}
