import hashlib
import zlib
from collections import Counter, defaultdict

from airlake.llm.merkle import lower_cased, manifest, verify


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                     for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run, slot = nodes[i // 8 * 8:i // 8 * 8 + 8], i % 8
        out.append(("".join(run[:slot]), "".join(run[slot + 1:])))
        i //= 8
    return out


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang, leaves in groups.items():
        leaves.sort(key=lambda x: x[:3])
        trees[lang] = tree([x[2] for x in leaves])
    top = tree([trees[lang][-1][0] for lang in order])
    out = []
    for j, lang in enumerate(order):
        for i, (known, doc_id, leaf, r) in enumerate(groups[lang]):
            steps = path(trees[lang], i) + path(top, j)
            node = leaf
            if known and zlib.crc32(str(doc_id).encode()) % 3 == 0 and r.text is not None:
                node = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
            for left, right in steps:
                node = h(left + node + right)
            root = top[-1][0]
            out.append((r.doc_id, leaf, trees[lang][-1][0], root, h("".join(a + b for a, b in steps)), node, node == root))
    return Counter(out)


def check(df):
    got = Counter(tuple(r) for r in verify(manifest(df, lower_cased())).collect())
    assert got == brute(df.select("doc_id", "text", "lang", "source", "n_chars").collect())
    return got


def test_documents(documents):
    got = check(documents)
    assert 0 < sum(not row[-1] for row in got) < len(got)


def test_edges(edge_docs):
    for c in ("group", "node", "pos", "n", "run", "path", "root", "other"):
        edge_docs = edge_docs.withColumn(c, edge_docs["lang"])
    check(edge_docs)
    assert verify(manifest(edge_docs.limit(0), lower_cased())).count() == 0


def test_sizes_around_full_runs(spark, make_docs):
    for n in (1, 8, 9, 65):
        check(make_docs([(i * 7 % 101, f"Text {i}", "s") for i in range(n)]))


def test_many_languages_repeated_and_null_ids(spark, make_docs):
    rows = [(i % 70 if i % 5 else None, f"T{i % 40}" if i % 3 else None, None if i % 6 == 0 else f"l{i % 17}", f"é{i % 3}", i)
            for i in range(300)]
    rows += [(i, f"Hot {i}", "hot", "s", 1) for i in range(200)] + rows[:30] + [(1, "empty", "", None, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5))


def test_untampered_rows_verify(documents):
    assert verify(manifest(documents)).where("not verified").count() == 0
