"""The pipeline's line dedup removes short lines that many sites share."""

import corpus_pipeline


def test_pipeline_removes_short_shared_lines(spark):
    texts = [f"Menu\nown text of page {i} stays\n\nHome page\n \nthe last {i}" for i in range(9)]
    docs = spark.createDataFrame([(i, t, f"s{i}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got[0].text == texts[0]
    for i in range(1, 9):
        assert got[i].text == f"own text of page {i} stays\n\n \nthe last {i}" and got[i].n_chars == len(got[i].text)
