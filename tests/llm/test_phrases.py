import random
import re
from collections import Counter, defaultdict

from airlake.llm import phrases
from airlake.llm.phrases import mine


def brute(rows, top, least, longest=5):
    pieces = defaultdict(list)
    for lang, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        pieces["und" if lang is None else lang] += [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered)]
    out = []
    for lang, parts in pieces.items():
        n = sum(map(len, parts))
        f = Counter(tuple(w[i:i + k]) for w in parts for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= 100 * f[p[i:j]]}
        scored = []
        for p, a in cands.items():
            if p not in gone:
                s, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s)
                for i, (s, a, p, left, right, n) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def check(df, top, least, **how):
    want = brute([tuple(r) for r in df.select("lang", "text").collect()], top, least)
    got = sorted(tuple(r) for r in mine(df, top=top, min_count=least, **how).collect())
    assert got == want
    return got


def corpus(n=300):
    rng = random.Random(5)
    words = [a + b for a in ("the", "of", "ré", "Tion", "x") for b in ("", "a", "ny", "LY", "é")]
    fixed = ["alpha beta gamma delta epsilon zeta", "red lorry yellow lorry", "la la la la la la"]
    def text():
        out = [words[min(int(rng.expovariate(0.2)), len(words) - 1)] + rng.choice(["", "", "", ",", ".", "\n", "\t"])
               for _ in range(40)]
        if rng.random() < 0.3:
            out.insert(rng.randrange(40), rng.choice(fixed))
        return " ".join(out)
    return [(i, text(), None if i % 9 == 0 else "fr" if i % 3 else "hot") for i in range(n)]


def test_against_brute_force(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").repartition(5)
    check(df, 25, 4, filter_bits=8, buffer_bytes=2000)  # a crowded bitmap, many buffers
    got = check(df, 40, 12)
    assert any(p == "alpha beta gamma delta epsilon" for _, _, p, *_ in got)


def test_frontier_closes(spark, monkeypatch):
    """Prefixes that cannot reach the last rank are not expanded, those that tie with it are."""
    rows = [(i, f"rare{i % 40} twin{i % 40} . common common{i % 3} common . other common", "a") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    opened = []
    grow = phrases.grow
    monkeypatch.setattr(phrases, "grow", lambda *a: opened.append(1) or grow(*a))
    check(df, 40, 5)  # forty pairs of one score
    assert len(opened) == 1
    check(df, 43, 5)
    assert len(opened) > 2


def test_edges(edge_docs):
    for c in ("phrase", "c", "first", "rank", "n", "a"):
        edge_docs = edge_docs.withColumn(c, edge_docs["text"])
    check(edge_docs, 10, 2)
    assert mine(edge_docs.limit(0)).count() == 0
    assert mine(edge_docs.where("text is null")).count() == 0


def test_scores_past_64_bits(spark):
    """1000 * a * n and l * r are formed in 38 digits."""
    kept = spark.createDataFrame([("a", "x y", 4 * 10**15, 9 * 10**15)], "lang string, phrase string, a long, n long")
    counts = spark.createDataFrame([("a", "x", 5 * 10**15), ("a", "y", 4 * 10**15)], "lang string, phrase string, c long")
    assert phrases.score(kept, counts).first().score == 1000 * 4 * 9 // (5 * 4)
