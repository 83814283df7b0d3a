"""The pipeline, stage by stage, against what each stage must do to its input."""

from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from airlake.llm import bpe, mixing, pii, simhash, toxicity
from airlake.llm.store import stored
from airlake.session import BATCH_BYTES, BATCH_LIMIT
from llm.test_quality_mixing import words_of
from llm.test_simhash import components_of, fingerprint

SF = "/root/testdata/sf0.001"


def stages(spark, docs):
    out = [docs]
    for _, stage in P.STAGES[:-1]:
        out.append(stored(stage(spark, out[-1], SF)))
        assert out[-1].columns == docs.columns
    return out, P.STAGES[-1][1](spark, out[-1], SF).collect()


def check(spark, docs):
    (start, clean, unique, masked, mixed), pieces = stages(spark, docs)
    key = lambda df: Counter(tuple(r) for r in df.collect())

    model = toxicity.fit(start, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(start, model).where("predicted = 1").collect()}
    assert key(clean) == key(start.where(~start.doc_id.isin(list(toxic)))) if toxic else key(clean) == key(start)

    rows = [(r.doc_id, fingerprint(r.text)) for r in clean.collect()]
    groups = components_of(rows)
    assert Counter(r.doc_id for r in unique.collect()) == Counter({groups[f]: 1 for _, f in rows})
    assert not key(unique) - key(clean)

    texts = {r.doc_id: r.text for r in unique.collect()}
    for r in masked.collect():
        assert r.text == pii.masked(texts[r.doc_id], pii.base_spans(texts[r.doc_id]))
        assert r.n_chars == len(r.text)
    assert masked.count() == unique.count()

    plan = {r.doc_id: r for r in mixing.mix(masked).collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    for d, r in plan.items():
        if r.size:
            assert copies[d] * r.size == r.taken

    tok = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    tokens, lengths = defaultdict(int), Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
        lengths[p.sequence_id] += p.length
    assert tokens == {r.doc_id: copies[r.doc_id] * (len(tok.encode(r.text, add_special_tokens=False).ids) + 1)
                      for r in mixed.dropDuplicates(["doc_id"]).collect()}
    assert all(n <= 2048 and n & (n - 1) == 0 for n in lengths.values())
    return toxic


def test_pipeline_documents(spark, documents):
    check(spark, documents)
    assert len(words_of("a b")) == 2


def test_pipeline_run_and_names(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_dedup", "pii", "mixing", "packing"]
    assert P.run(spark, SF).count() > 0


def test_pipeline_edges(spark, edge_docs):
    """Nulls, empty texts and repeated rows go through every stage."""
    plain = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs = plain
    for _, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() > 0
    empty = plain.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_keep_one_of_repeated_rows(spark, edge_docs):
    kept = simhash.keep_one(edge_docs).collect()
    groups = {r.component_id for r in simhash.near_duplicates(edge_docs).collect()}
    assert len(kept) == len(groups) and kept[0].asDict().keys() == set(edge_docs.columns)


def test_stages_bound_the_batches_of_texts(spark):
    """Stages that read texts in Python get them in batches bounded in bytes; a limit the session names stays."""
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    long = spark.range(0, 3000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    start = spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get(BATCH_LIMIT, None)
    try:
        for name in ("toxicity", "simhash_dedup", "pii", "packing"):
            spark.conf.unset(BATCH_LIMIT)
            dict(P.STAGES)[name](spark, start, SF)
            got = long.mapInArrow(sizes, "n bigint, bytes bigint").collect()
            assert sum(r.n for r in got) == 3000
            assert max(r.bytes for r in got) < BATCH_BYTES + 100_000, name
        spark.conf.set(BATCH_LIMIT, "1000000")
        dict(P.STAGES)["pii"](spark, start, SF)
        assert spark.conf.get(BATCH_LIMIT) == "1000000"
    finally:
        if before is None:
            spark.conf.unset(BATCH_LIMIT)
        else:
            spark.conf.set(BATCH_LIMIT, before)
