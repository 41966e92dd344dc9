"""The pipeline's stages in order, each on what the one before it kept."""

import corpus_pipeline
from ohlcraft.llm import decontamination, toxicity
from ohlcraft.llm.queries import ORACLES, QUERIES


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    own, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.report(docs, labels).filter("predicted = 1").collect()}
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        now = [r.doc_id for r in out.select("doc_id").collect()]
        if k < 4:
            assert out.columns == own and set(now) <= ids
        if name == "toxicity":
            assert set(now) == ids - bad
        if name == "near_dedup":
            assert len(set(now)) == len(now) and out.select("text").distinct().count() == len(now)
        if name == "decontamination":
            assert not decontamination.report(out, bench).filter("contaminated").count()
        if name == "token_files":
            assert sorted(now) == sorted(before)
        docs, ids, before = out, set(now), now


def test_names():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert set(ORACLES) <= set(QUERIES)
