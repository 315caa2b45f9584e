import re

import corpus_pipeline
from plantlens.llm import pii, queries
from tests.llm.test_signature_trees import brute

DATA = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, DATA).cache()
        seen[name] = (before, docs)
        if k < 4:
            assert docs.columns == columns, name
    before, after = seen["toxicity"]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert gone and after.count() == before.count() - len(gone)
    before, after = seen["near-duplicates"]
    want = {c for (d, n, c) in brute([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id for r in after.collect()} == want
    before, after = seen["personal-data"]
    assert after.count() == before.count() and sum(r.n_email + r.n_ip + r.n_phone for r in pii.pii_report(after).collect()) == 0
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["mixture"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    before, after = seen["packing"]
    assert after.count() == before.count()


def test_every_operator_is_registered(spark):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "personal-data", "mixture", "packing"]
