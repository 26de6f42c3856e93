"""The pipeline's stages on the small tables: each takes effect and keeps what it should."""

import collections

import corpus_pipeline
from conftest import SF_MID
from spanflow.llm import decontamination, pii, queries, similarity
from spanflow.sources.tables import stage


def test_stages(spark):
    docs = queries.table(spark, SF_MID, "documents")
    columns, before, seen = docs.columns, docs.count(), {}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF_MID))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    kept = {n: d.count() for n, d in seen.items()}
    assert before > kept["quality_rules"] > kept["jaccard_join"] > kept["decontamination"] == kept["pii"]
    short = {r["doc_id"] for r in queries.quality_rules(spark, SF_MID).where("NOT kept").collect()}
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["quality_rules"] == {r["doc_id"] for r in queries.table(spark, SF_MID, "documents").collect()} - short
    assert similarity.join_sets(seen["jaccard_join"], stage).where("n_links > 0").isEmpty()
    bad = decontamination.contaminated(seen["jaccard_join"], queries.table(spark, SF_MID, "benchmark"))
    assert ids["jaccard_join"] - ids["decontamination"] == {r["doc_id"] for r in bad.collect()}
    old = {r["doc_id"]: r["text"] for r in seen["decontamination"].collect()}
    for r in seen["pii"].collect():
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] == old[r["doc_id"]]) == (not pii.find(old[r["doc_id"]]))
    full = collections.Counter()
    for r in seen["packing"].collect():
        full[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= 4096
    assert set(full) == ids["pii"]
