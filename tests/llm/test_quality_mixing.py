from collections import Counter, defaultdict

from airlake.llm import quality
from airlake.llm.mixing import mix, take


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute_quality(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    bare = sum(not any(c.isalpha() for c in x) for x in w)
    bad = (5 * symbols > len(w) or 2 * dup > len(lines) or sum(map(len, w)) > 25 * len(w) or 2 * bare > len(w))
    return len(w), sum(map(len, w)), symbols, dup, len(inside), failed, not (failed or bad)


def check_quality(df):
    got = Counter(tuple(r) for r in quality.score(df, fraction=1.0).collect())
    assert got == Counter((r.doc_id, *brute_quality(r.text)) for r in df.collect())


def test_quality_documents(documents):
    check_quality(documents.where("n_chars < 30000"))


def test_quality_edges(edge_docs):
    check_quality(edge_docs.where("text is null or length(text) < 20000"))
    assert quality.score(edge_docs.limit(0)).count() == 0


def test_cascade_order_and_verdict(documents):
    order = quality.cascade_order(quality.RULES, {"symbols": (1.0, 0.5), "few_words": (0.1, 0.2), "no_letters": (9, 0)})
    assert [r.name for r in order[:3]] == ["few_words", "symbols", "no_letters"]
    measured = quality.measure(documents, fraction=1.0)
    assert set(measured) == {r.name for r in quality.RULES}
    kept = {r.doc_id for r in quality.keep(documents).where("rejected_by is null").collect()}
    assert kept == {r.doc_id for r in quality.score(documents).where("kept").collect()}


def water_fill(sizes, weights, most=3):
    total, fixed = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in fixed)
        shared = sum(w for i, w in enumerate(weights) if i not in fixed)
        goal = [most * s if i in fixed else weights[i] * left / shared for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if goal[i] > most * s}
        if not over - fixed:
            return goal
        fixed |= over


def check_mix(df):
    rows = df.select("doc_id", "text", "source").collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(words_of(r.text))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(order, water_fill([size[s] for s in order], [i % 3 + 1 for i in range(len(order))])))
    got = mix(df).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == Counter(
        (r.doc_id, len(words_of(r.text)), size[r.source], round(goal[r.source], 6)) for r in rows)
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    assert got_again(df) == Counter(tuple(r) for r in got)
    return got, rows, goal


def got_again(df):
    return Counter(tuple(r) for r in mix(df.repartition(7)).collect())


def test_mix_documents(documents):
    got, rows, goal = check_mix(documents)
    source = {r.doc_id: r.source for r in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    for s, t in goal.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    copies = Counter(r.doc_id for r in take(documents).collect())
    assert copies == Counter({r.doc_id: r.taken // r.size for r in got if r.size and r.taken})


def test_mix_edges(edge_docs, make_docs):
    check_mix(edge_docs)
    assert mix(edge_docs.limit(0)).count() == 0
    assert take(edge_docs).columns == edge_docs.columns
    check_mix(make_docs([(1, None, "a"), (2, " ", "b")]))  # no words at all
    check_mix(make_docs([(i, "word " * (i % 7), "hot" if i % 3 else f"s{i}") for i in range(200)]))


def test_sampling_follows_weights(make_docs):
    """Of equal documents, those full of symbols are taken less often."""
    rows = [(i, "good words " * 5, "a") for i in range(400)] + [(400 + i, "b*** w### " * 5, "a") for i in range(400)]
    got = {r.doc_id: r.taken for r in mix(make_docs([*rows, (900, "x " * 6000, "b")])).collect()}
    assert sum(got[i] for i in range(400)) > 1.2 * sum(got[i] for i in range(400, 800))


def test_equal_rows_of_mixed_weights_are_one_unit(make_docs):
    import duckdb

    from airlake.llm.oracle import OP8

    rows = [(None, ("good words " if i % 2 else "b*** w### ") * (1 + i % 5), "a") for i in range(300)]
    rows += [(i, "good words " * 3, "a") for i in range(300)] + [(1000, "x " * 3000, "b")]
    rows += [(7, "good words " * 3, "a"), (7, "b*** w### " * 3, "a")]
    docs = make_docs(rows)
    got = mix(docs).collect()
    assert len({(r.doc_id, r.size, r.source_size, r.taken) for r in got if r.doc_id is not None}) == len(
        {(r.doc_id, r.size, r.source_size) for r in got if r.doc_id is not None})
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    rounded = lambda rs: Counter((*r[:3], round(r[3], 6), r[4]) for r in rs)
    assert rounded(map(tuple, got)) == rounded(con.execute(OP8).fetchall())
    copies = Counter((r.doc_id, len(words_of(r.text))) for r in take(docs).collect())
    taken = Counter()
    for r in got:
        taken[r.doc_id, r.size] += r.taken // r.size
    assert copies == +taken


def test_rows_without_doc_id_meet_their_target(make_docs):
    import duckdb

    from airlake.llm.oracle import OP8

    # each source half without ids, all of one size: one unit would be half a source
    rows = [(None if i % 2 else i, f"w{i} " * 10, "abc"[i % 3]) for i in range(3000)]
    docs = make_docs(rows)
    got = mix(docs).collect()
    taken, goal = Counter(), {}
    for r in take(docs).collect():
        taken[r.source] += len(words_of(r.text))
    for i, source in enumerate("abc"):
        goal[source] = 30_000 * (i + 1) / 6
        assert abs(taken[source] - goal[source]) <= 0.01 * goal[source]
    assert sum(r.taken for r in got) == sum(taken.values())
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    rounded = lambda rs: Counter((*r[:3], round(r[3], 6), r[4]) for r in rs)
    assert rounded(map(tuple, got)) == rounded(con.execute(OP8).fetchall())
    # equal rows without ids stay together
    same = mix(make_docs([(None, "one text here", "a")] * 40 + [(1, "x " * 400, "b")])).collect()
    assert len({r.taken for r in same if r.doc_id is None}) == 1
