import sentencepiece
from pyspark.sql import functions as F
from test_near_copies import kept_by_hand
from test_text_operators import base_by_hand, leaks_by_hand

import corpus_pipeline
from weftline.llm import pii, queries, toxicity
from weftline.llm.tables import key_remainder

SF = "/root/testdata/sf0.001"


def test_each_stage_hands_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= left, name
        left = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == left
    assert last.where(F.size("ids") < 2).count() == 0


def test_stages_take_odd_rows(spark, odd_documents, no_documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents, SF).count() > 0
        assert stage(spark, no_documents, SF).count() == 0


def test_one_of_each_group_stays(spark, odd_documents):
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd_documents, SF).collect()]
    assert sorted(kept) == [1, 4, 5, 6, 9, 10]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def redacted_by_hand(text, model):
    """Every character that a span covers goes; the first span of those that overlap leaves its kind."""
    spans = sorted([(start, -end, kind) for kind, start, end, *_ in pii.accepted(text, model, {}, 0.5)])
    assert {(k, a, b) for k, a, b in base_by_hand(text)} <= {(k, a, -b) for a, b, k in spans}
    out, end = "", 0
    for k, c in enumerate(text + "\0"):
        here = [s for s in spans if s[0] == k]
        if here and k >= end:
            out += f"[{here[0][2].upper()}]"
        end = max([end, *[-s[1] for s in here]])
        out += c if k >= end else ""
    return out[:-1]


def test_the_whole_result_by_hand(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"), key_remainder(F.col("doc_id"), 5) != 0)
    clean = {r.doc_id for r in toxicity.score(frame, model).collect() if r.score < 0.5}
    left = {r.doc_id: r.text or "" for r in frame.collect() if r.doc_id in clean}
    left = {k: left[k] for k in kept_by_hand(left)[0]}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {k: t for k, t in left.items() if not any(leaks_by_hand(t, x) for x in items)}
    spans = pii.fit(frame.where(F.col("doc_id").isin(list(left))))
    library = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    want = {}
    for k, text in left.items():
        ids = [1, *library.encode(redacted_by_hand(text, spans)), 2]
        want[k] = ids, library.decode(ids)
    got = {r.doc_id: (r.ids, r.decoded) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys() and len(clean) > len(want) > 50
    assert got == want
