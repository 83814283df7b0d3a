from collections import Counter

import numpy as np
import xxhash

from airlake.llm.simhash import links, near_duplicates


def fingerprint(text, k=4):
    """Counts every bit of every shingle one by one."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_of(items, distance=4):
    """(doc_id, fingerprint) pairs to the smallest doc_id reachable."""
    fps = sorted({f for _, f in items})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for d, f in items:
        r = find(f)
        known = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(known) if known else None
    return {f: least[find(f)] for f in fps}


def check(df):
    rows = [(r.doc_id, fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    comp = components_of(rows)
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in near_duplicates(df).collect())
    assert got == Counter((d, f, comp[f]) for d, f in rows)


def test_documents(documents):
    check(documents)


def test_edges(edge_docs):
    check(edge_docs)
    assert near_duplicates(edge_docs.limit(0)).count() == 0


def test_every_close_pair_is_held_together(spark, monkeypatch):
    """Chains and dense clusters of fingerprints, with small blocks."""
    from airlake.llm import simhash
    from airlake.llm.graph import components

    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(25):
            y = x
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
            if rng.random() < 0.3:
                x = y
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long").repartition(4)
    found = components(links(df))
    got = {r.node % 2**64: r.component for r in found.collect()}
    want = components_of([(f, f) for f in fps])
    groups = Counter()
    for f in fps:
        groups[got.get(f, f - 2**64 if f >= 2**63 else f), want[f]] += 1
    assert len(groups) == len({g for g, _ in groups}) == len({w for _, w in groups})
