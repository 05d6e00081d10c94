"""The pipeline on the small table: each stage against its own input."""

from collections import Counter

import corpus_pipeline
from nearfold.llm import decontaminate, quality, simhash
from nearfold.llm.line_dedup import normal_lines


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], data).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(f.columns == columns for f in frames[:-1])
    rows = [{r.doc_id: r for r in f.collect()} for f in frames]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {r.doc_id for r in quality.assess(docs, labels).where("kept").collect()}
    assert set(rows[1]) == kept
    lines = Counter(x for r in rows[2].values() for x in normal_lines((r.text or "").encode()) if x)
    assert lines and max(lines.values()) == 1
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(frames[2], 5, 8, 0.8).collect()}
    assert set(rows[3]) == set(classes.values()) and set(classes) == set(rows[2])
    leaked = {r.doc_id for r in decontaminate.leaks(frames[3], spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert set(rows[4]) == set(rows[3]) - leaked
    assert set(rows[5]) == set(rows[4]) and all(r.same and r.n_tokens == len(r.ids) for r in rows[5].values())


def test_run_and_empty(spark, data, tmp_path):
    assert corpus_pipeline.run(spark, data).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
