"""Each stage of the pipeline against a plain version on its own input."""

import zlib

import numpy as np

import corpus_pipeline
from starledger.llm import langid, token_records

from .test_operators import SF, brute_fp, brute_leaks, reach, texts


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{zlib.crc32(name.encode())}"
        out.write.mode("overwrite").parquet(path)
        kept[name] = [r.asDict() for r in spark.read.parquet(path).collect()]
        docs = spark.read.parquet(path)
    first, second, third, fourth, last = kept.values()
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rejected = langid.judge([(r["text"] or "").encode() for r in texts()], model)[2]
    assert sorted(r["doc_id"] for r in first) == sorted(r["doc_id"] for r, x in zip(texts(), rejected, strict=True) if not x)
    root = reach({r["doc_id"]: brute_fp(r["text"]) for r in first})
    assert sorted(r["doc_id"] for r in second) == sorted(set(root.values()))
    items = [(r["item_id"], r["text"]) for r in texts("benchmark")]
    assert sorted(r["doc_id"] for r in third) == sorted(r["doc_id"] for r in second if not brute_leaks(r["text"], items)[1])
    assert {r["doc_id"] for r in fourth} <= {r["doc_id"] for r in third}
    encoder = token_records.Encoder(token_records.vocabulary_path(), 2)
    start, want = 0, []
    for r in sorted(fourth, key=lambda r: r["doc_id"]):
        ids = [*encoder.ids(r["text"] or ""), 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in last) == want


def test_run(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}
