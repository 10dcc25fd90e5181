import random

import corpus_pipeline
from trafficlens.llm import cotrain, toxicity
from trafficlens.llm.common import table

from .test_operators import labelled, near_by_brute_force


def test_stages_equal_their_operators_one_by_one(spark, tmp_path):
    rows, labels = labelled(random.Random(12), 300)
    rows += [(1000 + i, rows[i][1]) for i in range(40)] + [(2000, None), (2001, "")]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, table_of_labels = table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    # the decisions of each operator on its own input, followed in Python
    clean = {r.doc_id for r in toxicity.toxicity(docs, table_of_labels).collect() if not r.rejected}
    left = docs.where(docs.doc_id.isin(list(clean)))
    good = {r.doc_id for r in cotrain.score(left, table_of_labels).collect() if r.predicted}
    assert good <= clean < set(texts)
    kept = {i for i, (_, _, k) in near_by_brute_force([(i, texts[i]) for i in good]).items() if k}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"]) == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]
    assert (out.groupby("sequence_id")["length"].sum() <= 4096).all()
