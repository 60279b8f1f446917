"""Plan shape: pushdown, pruning, no pair products, no single-task numbering."""

from __future__ import annotations

from pairloom.operators import similarity as S
from pairloom.plans import fixtures as fx
from pairloom.session import load


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, small_dir):
    from pairloom.operators import pairs as PR
    df = PR.language_subset(load(spark, small_dir, "documents").select("doc_id", "lang"), "lang", ["en", "fr"])
    plan = _plan(df)
    assert "PushedFilters: [In(lang" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_similarity_is_blocked_not_a_product(spark, small_dir):
    p = fx.f_imgtext(spark, small_dir)
    s = S.similarity(p, p, q_id="pair_id", q_vec="image_vec", c_id="pair_id", c_vec="text_vec")
    plan = _plan(s)
    # the candidate side is small: the queries are scored where they are
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    blocked = _plan(S.similarity(p, p, q_id="pair_id", q_vec="image_vec", c_id="pair_id", c_vec="text_vec", block_rows=64))
    assert "FlatMapGroupsInPandas" in blocked
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_batch_numbering_has_no_global_window(spark, small_dir):
    from pairloom.plans import indexing
    b = indexing.row_index(load(spark, small_dir, "documents").select("doc_id"), ["doc_id"], num_buckets=8)
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    # the row_number window is partitioned by the bucket; the only unpartitioned
    # window runs over the per-bucket counts (one row per bucket)
    assert "row_number()" in plan and "_pl_b" in plan


def test_ten_classes_do_not_move_the_queries(spark, small_dir):
    emb = load(spark, small_dir, "embeddings")
    top = S.top_k(emb, fx.f_classes(spark, small_dir), 5, q_id="vec_id", q_vec="embedding", c_id="label", c_vec="vector")
    assert "Exchange" not in _plan(top)


def test_tokens_are_not_shuffled(spark, small_dir):
    from pairloom.operators import tokens as TK
    from pairloom.operators.udf import embed_corpus
    docs = load(spark, small_dir, "documents")
    merges = [("t", "h"), ("th", "e</w>")]
    vocab = spark.createDataFrame([("the", 3)], "token string, id long")
    rows = TK.tokenize(docs, "doc_id", "text")
    for df in (TK.encode(docs, "doc_id", "text", merges), embed_corpus(docs, "doc_id", "text"), TK.lookup_ids(rows, vocab, "doc_id", unk_id=0)):
        plan = _plan(df)
        assert "Exchange" not in plan and "Generate" not in plan


def test_small_numbering_runs_few_jobs(spark, small_dir):
    docs = load(spark, small_dir, "documents").select("doc_id")
    sc = spark.sparkContext
    sc.setJobGroup("numbering", "jobs of one numbering")
    try:
        from pairloom.operators import batching as BT
        BT.batch_ids(docs, 16, ["doc_id"])
        assert len(sc.statusTracker().getJobIdsForGroup("numbering")) <= 2
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
