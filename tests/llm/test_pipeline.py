"""The pipeline's stages against brute-force versions, chained as the driver chains them."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from test_near_and_lines import brute_docs, brute_lines, version  # noqa: E402

from tidewell.llm import merge_dropout  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, rows, tmp_path):
    small = [r[:5] for r in rows]
    docs = spark.createDataFrame(small, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/s{i}")
        docs = spark.read.parquet(f"{tmp_path}/s{i}")
        outs.append(docs.collect())
        if i < 4:
            assert docs.columns == COLUMNS
    quality, lines, near, mixed, encoded = outs
    texts = {r.doc_id: r.text for r in quality if r.doc_id is not None}
    keep = brute_lines([(r.doc_id, r.text) for r in quality])
    for r in lines:
        if r.doc_id is not None:
            assert r.text.split("\n") == [x for i, x in enumerate(texts[r.doc_id].split("\n")) if not x.strip() or (r.doc_id, version(texts[r.doc_id]), i) in keep] and r.n_chars == len(r.text)
    roots = brute_docs([(r.doc_id, r.text) for r in lines], 5)
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == sorted(r.doc_id for r in lines if r.doc_id is not None and roots[r.doc_id] == r.doc_id)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and len(encoded) == len(mixed)
    e, by = merge_dropout.encoder(merge_dropout.model_path(), 0.0, 1, 0), {r.doc_id: r.text for r in mixed}
    assert all(e.decode(bytes(r.piece_ids)).decode() == by[r.doc_id] for r in encoded if r.doc_id is not None)
    assert pipeline.run(spark, str(tmp_path)).count() == len(encoded)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).isEmpty()


def test_the_last_stage_decodes(spark, rows):
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.piece_encoding(spark, docs, "")
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "piece_ids", "lossless"]
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.piece_ids), r.lossless) for r in out.collect())
    plain = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.piece_ids), True) for r in merge_dropout.encode(docs).collect())
    assert got == plain
    e = merge_dropout.encoder(merge_dropout.model_path(), 0.0, None, 0)
    ids = e(["one text", "another"], [1, 2])
    assert merge_dropout.decodes(e, ["one text", "another"], ids) == [True, True] and merge_dropout.decodes(e, ["one texts", ""], ids) == [False, False]
