"""The pipeline against a plain version, and the queries over a whole small table."""

import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import BENCH, DOCS, brute_components, brute_fingerprint, brute_hits, brute_quality, prose, texts
from tidemark.llm import mixing, quality, registry, token_files


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    made = [*texts(), *[prose(60 + i) for i in range(12)]]
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(made)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    judge = quality.Judge()
    kept = [r for r in rows if judge(r[1])[-1]]
    assert all(not brute_quality(r[1])[-1] for r in kept if len(r[1]) < 50_000) and len(kept) > 12
    roots = brute_components([brute_fingerprint(r[1]) for r in kept])
    kept = [r for i, r in enumerate(kept) if roots[i] == i]
    kept = [r for r in kept if not brute_hits(r[1], BENCH)[-1]]
    frame = spark.createDataFrame(kept, DOCS)
    copies = {r.doc_id: r.n_copies for r in mixing.mix(frame).select("doc_id", "n_copies").collect()}
    rates = {r.source: r.rate for r in mixing.source_rates(frame).collect()}
    assert sum(len([1 for r in kept if r[3] == s]) * v for s, v in rates.items()) > 0
    t = Tokenizer.from_file(token_files.tokenizer_path())
    want, start = [], 0
    for r in kept:
        ids = [*t.encode(r[1], add_special_tokens=False).ids, 0]
        for _ in range(copies.get(r[0], 0)):
            want.append((r[0], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
            start += len(ids)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns(spark, tmp_path):
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts())], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries(spark, name):
    out = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    if name.startswith(("op1_", "op3", "op5", "op7", "op8", "op10")):
        assert out.select(F.countDistinct("doc_id")).first()[0] == 200
