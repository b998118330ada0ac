"""The pipeline, stage by stage, and the registered queries."""

import collections

import __spark_entry__
import corpus_pipeline

from namesieve.llm import quality_rules, temperature_mix

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def firsts(sets):
    """The smallest id of each component of sets with a Jaccard similarity of 0.8, by brute force."""
    ids, low = sorted(sets), {}
    root = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if root[i] != root[j] and (a == b or (a | b and len(a & b) >= 0.8 * len(a | b))):
                gone, root_ = root[i], root[j]
                root.update({x: root_ for x in ids if root[x] == gone})
    for i in ids:
        low.setdefault(root[i], i)
    return list(low.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema.simpleString()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 4 and "mixing" in names
    kept = {r.doc_id for r in quality_rules.assess(docs).where("kept").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF).cache()
        if i < 3:
            assert docs.schema.simpleString() == schema
        ids = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
        if i == 0:
            assert set(ids) == kept and max(ids.values()) == 1
        if i == 1:
            assert ids == collections.Counter(firsts({r.doc_id: shingles(r.text) for r in before.collect()}))
        if i == 2:
            assert ids == collections.Counter(r.doc_id for r in temperature_mix.mix(before).collect())
            mixed = ids
        if i == 3:
            starts = collections.Counter(r.doc_id for r in docs.where("start = 0").collect())
            assert starts == mixed
    run = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "doc_tokens").collect())
    assert {i for i, _, _ in run} == set(mixed)


def test_registered():
    queries = __spark_entry__.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in queries
    assert set(__spark_entry__.CATALOGS[-1].QUERIES) == {"pipeline"}


def test_clashing_columns_stay(spark):
    text = lambda i: " ".join(f"Boat {i} {k} left the harbour at {k} in the evening." for k in range(9))
    docs = spark.createDataFrame([(i, text(i), "a", 1, "own", 9) for i in range(9)],
                                 "doc_id long, text string, source string, copy int, mixed string, n_chars int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "source", "copy", "mixed", "n_chars"]
    assert {r.mixed for r in docs.collect()} == {"own"}


def test_odd_documents_pass_through(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 30 + "end.", None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.collect()
