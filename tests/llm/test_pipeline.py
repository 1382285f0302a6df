from __future__ import annotations

import corpus_pipeline as C
from tests.llm.test_text_operators import DOCS, brute_components, corpus
from wellpanel.llm import language_hypervectors as LH
from wellpanel.llm import quality_ftrl as QF
from wellpanel.llm import source_mixing as SM


def test_each_stage_works_on_what_its_predecessor_kept(spark, tmp_path):
    spark.createDataFrame(corpus(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 != 1), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        out = C.staged(stage(spark, docs, str(tmp_path)), name)
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if k < 4:
            assert out.columns == columns
            after = [(r.doc_id, r.text) for r in out.collect()]
        if k == 0:
            scores = QF.quality(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
            assert sorted(map(str, after)) == sorted(str((r.doc_id, r.text)) for r in docs.join(scores.filter("predicted = 1").select("doc_id").distinct(), "doc_id", "left_semi").collect()) + [str(x) for x in after if x[0] is None]
        elif k == 1:
            assert len(after) == LH.languages(docs).filter("lang_pred <> 'und'").count()
        elif k == 2:
            want = brute_components(before)
            assert sorted(i for i, _ in after if i is not None) == sorted({c for _, c in want.values()})
        elif k == 3:
            assert len(after) == sum(r.taken // r.size for r in SM.mix(docs).collect() if r.size)
        else:
            assert out.count() == len(before)
        docs = out
    assert C.run(spark, str(tmp_path)).count() == docs.count()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
