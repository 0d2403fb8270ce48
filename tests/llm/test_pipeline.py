from __future__ import annotations

import re
from pathlib import Path

import corpus_pipeline
from siftwork.llm import common, registry, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(path := f"file://{tmp_path}/{k}-{name}")
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_stages_without_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_every_query_has_rows(spark):
    assert sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))[-1].startswith("op10_") and len(registry.QUERIES) == 10
    for name in ("op1_html_extract", "op3_quality_rules", "op10_packing"):
        assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_freed_memory_goes_back_to_the_system():
    def mb() -> float:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    common.return_memory()
    before = mb()
    held = [bytes(2000) for _ in range(50_000)]
    last = held[-1]  # keeps the end of the heap in use
    assert mb() > before + 80
    del held
    common.return_memory()
    assert mb() < before + 20 and len(last) == 2000


def test_memory_is_returned_once_toxicity_is_learned(spark, monkeypatch):
    said: list[str] = []
    monkeypatch.setattr(toxicity, "learn", lambda *_: said.append("learned"))
    monkeypatch.setattr(common, "return_memory", lambda: said.append("returned"))
    monkeypatch.setattr(toxicity, "without_toxic", lambda docs, _: docs)
    corpus_pipeline.non_toxic(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert said == ["learned", "returned"]
