"""Inputs beyond the old limits: blank texts, zero vectors, missing truths, long digit runs, wide rows, retries."""

from __future__ import annotations

import gzip
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import text as TX
from pairloom.operators import batching as BT
from pairloom.operators import metrics as M
from pairloom.operators import pairs as PR
from pairloom.operators import pooling as PL
from pairloom.operators import similarity as S
from pairloom.operators import tokens as TK
from pairloom.operators import udf as U
from pairloom.plans.indexing import row_index
from pairloom.sources import readers as RD
from pairloom.sources import writers as WR
from pairloom.streaming import arriving as ST

TEXTS = [(0, "the cat the"), (1, None), (2, ""), (3, " \t\n"), (4, "cat"), (4, "cat")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("the", 3), ("cat", 4)], "token string, id long")


@pytest.mark.parametrize("most", [TK.MAX_ENTRIES, 1])
def test_every_text_keeps_a_row(spark, texts, vocab, most):
    ids = TK.lookup_ids(TK.tokenize(texts, "id", "text"), vocab, "id", max_entries=most)
    want = [(0, [3, 4, 3]), (1, []), (2, []), (3, []), (4, [4]), (4, [4])]
    assert sorted((r.id, r.ids) for r in ids.collect()) == want
    back = TK.lookup_pieces(ids, vocab, "id", max_entries=most)
    assert sorted((r.id, r.pieces) for r in back.collect()) == [(0, ["the", "cat", "the"]), (1, []), (2, []), (3, []), (4, ["cat"]), (4, ["cat"])]


@pytest.mark.parametrize("most", [TK.MAX_ENTRIES, 1])
def test_unknown_tokens_are_explicit(spark, vocab, most):
    rows = spark.createDataFrame([(0, ["the", "dog"])], "id long, tokens array<string>")
    assert TK.lookup_ids(rows, vocab, "id", unk_id=9, max_entries=most).first().ids == [3, 9]
    with pytest.raises(Exception, match="no entry"):
        TK.lookup_ids(rows, vocab, "id", max_entries=most).collect()
    ids = spark.createDataFrame([(0, [4, 77])], "id long, ids array<long>")
    assert TK.lookup_pieces(ids, vocab, "id", unk="?", max_entries=most).first().pieces == ["cat", "?"]
    with pytest.raises(Exception, match="no entry"):
        TK.lookup_pieces(ids, vocab, "id", max_entries=most).collect()


def test_encode_and_fixed_length_of_blank_texts(texts):
    merges = [("t", "h"), ("th", "e</w>")]
    enc = TK.encode(texts, "id", "text", merges)
    rows = sorted((r.id, r.ids) for r in enc.collect())
    assert [len(x) for _, x in rows] == [5, 0, 0, 0, 3, 3]
    sot, eot = TK.special_ids(512 + len(merges))
    assert TK.vocab_pieces(merges).index("<|startoftext|>") == sot
    fixed = {r.id: r.x for r in enc.select("id", TX.tokenize_fixed("ids", 5, sot=sot, eot=eot, truncate=True).alias("x")).collect()}
    assert fixed[1] == [sot, eot, 0, 0, 0] and fixed[0][-1] == eot and len(fixed[0]) == 5
    dec = enc.select("id", TK.decode_column(merges)(F.col("ids")).alias("t"))
    assert {r.id: r.t for r in dec.collect()}[0] == "the cat the "


def test_embedding_of_blank_texts_is_null(texts):
    for how in ({}, {"encoder_factory": lambda: U.numpy_hashed_encoder, "encoder_name": "test-hashed"}):
        got = sorted(((r.id, r.embedding is None) for r in U.embed_corpus(texts, "id", "text", **how).collect()))
        assert got == [(0, False), (1, True), (2, True), (3, True), (4, False), (4, False)]


def test_encoder_is_built_once_per_worker(spark, tmp_path):
    marks = str(tmp_path)

    def factory():
        import os
        import uuid
        open(os.path.join(marks, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: np.ones((len(texts), 2))

    docs = spark.range(64).select("id", F.lit("x").alias("text")).repartition(16)
    for _ in range(2):
        U.embed_corpus(docs, "id", "text", encoder_factory=factory, encoder_name=f"once-{marks}").count()
    import os
    workers = [name.split("-")[0] for name in os.listdir(marks)]
    assert workers and len(workers) == len(set(workers))
    with pytest.raises(ValueError, match="encoder_name"):
        U.embed_corpus(docs, "id", "text", encoder_factory=factory)


def test_merges_file(spark, tmp_path):
    path = str(tmp_path / "m.txt.gz")
    with gzip.open(path, "wt") as f:
        f.write("#version: 1\nt h\nth e</w>\n")
    rows = [(r.rank, r.left, r.right) for r in RD.read_merges(spark, path).orderBy("rank").collect()]
    assert rows == [(0, "t", "h"), (1, "th", "e</w>")]


VECS = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])]


@pytest.mark.parametrize("rows", [None, 2])
def test_vectors_without_direction(spark, rows):
    df = spark.createDataFrame(VECS, "id long, v array<double>")
    kw = dict(q_id="id", q_vec="v", c_id="id", c_vec="v", block_rows=rows)
    sim = {r.q_id: r for r in S.similarity(df, df, **kw).collect()}
    assert len(sim) == 5 and sim[2].lse is None and sim[3].best_id is None and sim[0].best_id == 0
    top = S.top_k(df, df, 2, **kw).collect()
    assert {r.c_id for r in top} == {0, 1, 4, None} and {r.q_id for r in top if r.c_id is None} == {2, 3}
    assert [(r.rank, r.c_id) for r in top if r.q_id == 4] == [(1, 4), (2, 0)]
    prob = S.top_k_softmax(df, df, 2, **kw).collect()
    assert {r.q_id for r in prob if r.prob is None} == {2, 3} and len(prob) == 8
    soft = {r.q_id: r.probs for r in S.softmax(df, df, scale=1.0, **kw).collect()}
    assert soft[2] is None and math.isclose(sum(soft[0]), 1.0) and len(soft[0]) == 3
    ranks = {r.q_id: r.rank for r in S.truth_rank(df.withColumn("t", F.col("id")), df, truth_id="t", **kw).collect()}
    assert ranks == {0: 1, 1: 1, 2: None, 3: None, 4: 1}
    absent = {r.q_id: r.rank for r in S.truth_rank(df.withColumn("t", F.col("id") + 1), df, truth_id="t", **kw).collect()}
    assert absent[4] is None and absent[0] == 3
    both = S.pair_ranks(df.withColumn("w", F.col("v")), id_col="id", a_vec="v", b_vec="w", block_rows=rows).collect()
    assert sorted((r.side, r.q_id, r["rank"]) for r in both if r["rank"] is not None) == [(s, i, 1) for s in (0, 1) for i in (0, 1, 4)]
    assert S.recall_at_k(S.truth_rank(df.withColumn("t", F.col("id")), df, truth_id="t", **kw), ks=(1,)).first().r1 == 0.6
    assert S.zero_shot_accuracy(df.withColumn("y", F.col("id")), df, id_col="id", vec_col="v", label_col="y", class_col="id", class_vec="v", ks=(1,)).first().top1 == 0.6


@pytest.mark.parametrize("rows", [None, 7])
def test_both_directions_in_one_pass(spark, rows):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for i in range(40)]
    df = spark.createDataFrame(data, "id long, a array<double>, b array<double>")
    both = {(r.side, r.q_id): (r.best_id, round(r.lse, 9)) for r in S.similarity_both(df, id_col="id", a_vec="a", b_vec="b", block_rows=rows).collect()}
    for side, (x, y) in enumerate((("a", "b"), ("b", "a"))):
        one = S.similarity(df, df, q_id="id", q_vec=x, c_id="id", c_vec=y, block_rows=rows).collect()
        assert {(side, r.q_id): (r.best_id, round(r.lse, 9)) for r in one}.items() <= both.items()
        ranks = {r.q_id: r["rank"] for r in S.truth_rank(df.withColumn("t", F.col("id")), df, q_id="id", q_vec=x, truth_id="t", c_id="id", c_vec=y, block_rows=rows).collect()}
        assert ranks == {r.q_id: r["rank"] for r in S.pair_ranks(df, id_col="id", a_vec="a", b_vec="b", block_rows=rows).collect() if r.side == side}


def test_in_batch_rows_without_vector(spark):
    df = spark.createDataFrame([(0, i, v, v) for i, v in VECS] + [(1, 9, [2.0, 0.0], [3.0, 0.0])], "b long, id long, x array<double>, y array<double>")
    got = {r.id: r for r in S.in_batch_pairs(df, batch_col="b", id_col="id", a_vec="x", b_vec="y").collect()}
    assert len(got) == 6 and got[2].lse is None and got[0].size == 3 and got[9].size == 1 and got[0]["rank"] == 1


def test_linear_map_of_wide_vectors(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(size=(5, 3))
    x = rng.normal(size=(50, 5))
    df = spark.createDataFrame([(i, a.tolist(), (a @ w).tolist()) for i, a in enumerate(x)], "id long, x array<double>, y array<double>")
    table = S.fit_linear_map(df, "x", "y")
    assert all(math.isclose(r.w, w[r.i, r.j], abs_tol=1e-9) for r in table.collect()) and table.count() == 15
    got = {r.id: r.projected for r in S.apply_map(df, table, id_col="id", vec_col="x").collect()}
    assert np.allclose([got[i] for i in range(50)], x @ w)


def test_natural_order_of_long_numbers(spark):
    names = ["a" + "9" * 20, "a1" + "0" * 21, "a2" + "0" * 22, "a007", "a7", "a10", "b1"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [r.s for r in BT.natural_sort(df, "s").orderBy("rank").collect()]
    assert got == ["a007", "a7", "a10", "a" + "9" * 20, "a1" + "0" * 21, "a2" + "0" * 22, "b1"]


def test_directions_are_rejected_at_every_size(spark, monkeypatch):
    df = spark.range(50)
    for limit in (10, 1000):
        monkeypatch.setattr(PR, "LIMIT_DIRECT", limit)
        with pytest.raises(ValueError, match="ascending"):
            PR.take_n(df, 20, [F.desc("id")])
        assert sorted(r.id for r in PR.take_n(df, 20, [-F.col("id")]).collect()) == list(range(30, 50))
    with pytest.raises(ValueError, match="ascending"):
        row_index(df, [F.col("id").desc()])


def test_batches_keep_their_remainder_and_columns(spark):
    count = lambda pdf: pd.DataFrame({"n": pdf["id"] * 2})
    for parts in (1, 4, 7):
        df = spark.range(100).withColumn("k", F.lit("x")).withColumn("junk", F.lit(1)).repartition(parts)
        assert U.map_batches(df, count, "n long", batch_size=30).count() == 100
        out = U.map_batches(df, count, "n long", batch_size=30, remove_columns=["junk"])
        assert out.columns == ["id", "k", "n"] and all(r.n == 2 * r.id and r.k == "x" for r in out.collect())
    with pytest.raises(Exception, match="remove all columns"):
        U.map_batches(spark.range(9), lambda p: pd.DataFrame({"n": [len(p)]}), "n long", remove_columns=[]).collect()


def test_image_formats(spark):
    heads = {"webp": b"RIFF\x10\x00\x00\x00WEBPVP8 ", "tiff": b"II*\x00\x08\x00\x00\x00", "tiff_be": b"MM\x00*\x00\x00\x00\x08", "png": b"\x89PNG\r\n\x1a\n",
             "wav": b"RIFF\x10\x00\x00\x00WAVEfmt ", "text": b"hello world, hello", "empty": b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "k string, content binary")
    assert {r.k for r in RD.drop_unreadable(df).collect()} == {"webp", "tiff", "tiff_be", "png"}
    assert {r.k for r in RD.drop_unreadable(df, formats=["png"]).collect()} == {"png"}


def test_missing_english_keeps_the_row(spark):
    df = spark.createDataFrame([(1, None, "oui"), (2, "yes", None)], "id long, en string, fr string")
    got = sorted((r.id, r.lang, r.source_text, r.target_text) for r in PR.unpivot_captions(df, "id", ["en", "fr"]).collect())
    assert got == [(1, "fr", "oui", None), (2, "en", "yes", "yes")]
    maps = spark.createDataFrame([(1, [{"fr": "oui"}, {"en": "a", "fr": None}])], "id long, m array<map<string,string>>")
    got = sorted((r.item, r.lang, r.target_text) for r in PR.unpivot_caption_maps(maps, "id", "m").collect())
    assert got == [(0, "fr", None), (1, "en", "a")]


def test_parts_are_rectangular_and_keep_the_first_copy(spark):
    a = spark.createDataFrame([(1, [1, 2, 3], "first"), (2, [4], "b")], "id long, x array<long>, t string")
    b = spark.createDataFrame([(1, [9], "later"), (3, None, "c")], "id long, x array<long>, t string")
    got = {r.id: (r.x, r.t) for r in PR.concat_parts([a, b], "id", pad={"x": 2}).collect()}
    assert got[1] == ([1, 2, 3], "first") and got[2] == ([4, -100, -100], "b")


def test_rows_without_vector_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    vecs = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    WR.write_rows_with_vectors(rows, vecs, str(tmp_path / "o"), "id")
    got = spark.read.schema("id long, t string, v array<double>").json(str(tmp_path / "o"))
    assert {r.id: r.v for r in got.collect()} == {1: [1.0], 2: None}


def test_metrics_of_a_retried_run_stand_once(spark, tmp_path):
    m = spark.createDataFrame([("mse", 1.0)], "name string, value double")
    for run, split in (("r1", "test"), ("r1", "test"), ("r2", "test"), ("r1", "dev")):
        WR.write_metrics(m, str(tmp_path / "m"), run, split)
    got = spark.read.schema("run string, split string, name string, value double").json(str(tmp_path / "m"))
    assert sorted((r.run, r.split, r.name) for r in got.collect()) == [("r1", "dev", "dev_mse"), ("r1", "test", "test_mse"), ("r2", "test", "test_mse")]


def test_text_values_with_line_ends(spark, tmp_path):
    df = spark.createDataFrame([(" a\nb\t",), (" c ",)], "v string")
    with pytest.raises(Exception, match="line end"):
        WR.write_text(df, "v", str(tmp_path / "x"))
    WR.write_text(df, "v", str(tmp_path / "y"), line_end=" ")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "y")).collect()) == ["a b", "c"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    body = "".join(f"line {i}\r\n" if i % 50 == 0 else f"line {i}\n" for i in range(20000))
    (tmp_path / "f.txt").write_text(body, newline="")
    (tmp_path / "g.txt").write_text("only", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = RD.read_lines(spark, str(tmp_path))
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {r.line_no: r.line for r in rows if r.path.endswith("f.txt")}
    assert len(rows) == 20001 and [got[i + 1].rstrip("\r") for i in range(20000)] == [f"line {i}" for i in range(20000)]


def test_alignment_check(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "id long, s string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string")
    with pytest.raises(ValueError, match="stands"):
        M.align_pairs(a, b, "id")
    assert M.align_pairs(b.withColumnRenamed("t", "s"), b, "id").count() == 2


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (0.0,), (4.0,)], "x double")
    rows = M.density_histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 0, 0, 1] and math.isclose(sum(r.density for r in rows), 1.0)
    assert M.density_histogram(df.where("false"), "x", 4).count() == 0


def test_pooling_without_valid_positions(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0], 0), (1, [2.0, 4.0], 1), (1, None, 1), (None, [1.0, 1.0], 1)], "s long, v array<double>, m int")
    assert {r.s: r.pooled for r in PL.pool_mean(df, "s", "v", "m").collect()} == {0: None, 1: [2.0, 4.0], None: [1.0, 1.0]}
    assert {r.s: r.pooled for r in PL.pool_max(df, "s", "v", "m").collect()} == {1: [2.0, 4.0], None: [1.0, 1.0]}


def test_materialize_runs_no_job_on_a_hit(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(3):
        assert U.materialize(make, spark, str(tmp_path), "k").count() == 3
    assert len(calls) == 1


def test_stream_writes_a_folder_per_file(spark, tmp_path):
    for name, text in (("a", "hello world"), ("b.x", "")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text('{"doc_id": 1, "text": "%s"}\n' % text)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    ST.embed_new_files(spark, str(tmp_path / "in" / "*.json"), str(tmp_path / "out"), str(tmp_path / "ck"), schema, "doc_id", "text",
                       encoder_factory=lambda: U.numpy_hashed_encoder, encoder_name="stream-hashed")
    got = {r.name: r.embedding is None for r in ST.read_embeddings(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": False, "b.x": True}


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from pairloom.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master), conf=conf)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(fake)


def test_scratch_is_released(spark):
    import os

    from pairloom.session import cut_lineage, release_scratch, scratch_path
    root = os.path.dirname(scratch_path(spark, "x").removeprefix("file:"))
    assert cut_lineage(spark.range(5), "scratch-test").count() == 5 and os.listdir(root)
    release_scratch(spark)
    assert not os.path.exists(root)
