"""The pipeline against brute force, and every query on the smallest tables."""

import os
import shutil

import corpus_pipeline
from concord.llm import queries
from tests.llm.test_overlap import brute


def test_pipeline_equals_brute_force(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    extra = spark.createDataFrame([(7001, "12 34 -- 56", "en", "s", 5), (7002, None, "en", "s", 0), (7003, "", None, None, None), (7004, "привет " * 3, None, "s", 20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra)
    os.rename(tmp_path / "documents.parquet", tmp_path / "old.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = left.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.materialize(stage(spark, left, str(tmp_path)), "test")
        assert left.columns == columns
        kept.append({r.doc_id for r in left.collect()})
    assert not kept[0] & {7001, 7002, 7003} and all(sum(map(str.isalpha, rows[i].text or "")) < 20 for i in set(rows) - kept[0])
    group = {int(i): c for i, _, c in brute([(i, rows[i].text) for i in sorted(kept[0])], 5, 80, 100)}
    assert kept[1] == {i for i in kept[0] if group[i] == i}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaky = {i for i in kept[1] if any(t in " ".join(rows[i].text.lower().split()) for t in items)}
    assert kept[2] == kept[1] - leaky and leaky
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == kept[2]
    for r in out:
        ids = library.encode(rows[r.doc_id].text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_all_queries_run(spark, sf):
    counts = {name: query(spark, sf).count() for name, query in queries.QUERIES.items() if name not in ("op3_lm", "op5_decontamination")}
    assert counts.pop("op1_warc") == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert set(counts.values()) == {spark.read.parquet(f"{sf}/documents.parquet").count()}
