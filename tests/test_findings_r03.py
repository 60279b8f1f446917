"""Findings of round 3: whole rows in the padded parts, lines of packed files, tokens, packed blocks, tiles, Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators import pruned
from pairloom.operators import tokens as TK
from pairloom.plans import blocks as B
from pairloom.plans import q_pairs, q_sources, q_text
from pairloom.session import prepare_session, scratch_path

TEXTS = {1: "one\ntwo\nthree", 2: "", 3: "\n", 4: "a\tb\n\n 5\tx \n", 7: "plain", 11: "é\r\n z", 20: "w " * 300}


def _documents(spark, path, texts=TEXTS):
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_padded_parts_hold_whole_documents(spark, tmp_path):
    d = _documents(spark, tmp_path)
    ids = {r.doc_id: r.ids for r in q_text.f_tokens(spark, d).collect()}
    got = {r.doc_id: r.ids for r in q_pairs.q_concat_parts_padded(spark, d).collect()}
    assert len(ids[20]) == 300 and got == {i: x + [-100] * (300 - len(x)) for i, x in ids.items()}


def _folders(spark):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x").rsplit("/", 1)[0])
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(root)
    return [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("lines-")], fs


def test_lines_of_packed_files(spark, tmp_path):
    d = _documents(spark, tmp_path, TEXTS | {100 + i: f"x{i}\ny" for i in range(300)})
    want = sorted((i, n, x) for i, t in (TEXTS | {100 + i: f"x{i}\ny" for i in range(300)}).items() for n, x in enumerate(t.split("\n"), 1))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # documents lie across splits
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scratch = _folders(spark)[0]
        before = {str(p) for p in scratch}
        lines = q_sources.q_read_lines(spark, d)
        assert sorted(map(tuple, lines.collect())) == want
        made, fs = _folders(spark)
        made = [p for p in made if str(p) not in before]
        assert len(made) == 1 and fs.getContentSummary(made[0]).getFileCount() < 50  # not a file for each document
        assert sorted(map(tuple, q_sources.q_line_at(spark, d).collect())) == [(i, x) for i, n, x in want if n == 2]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_tokens_in_one_pass_are_those_of_the_cleaned_text(spark):
    odd = ["\t a\x1cb\x85c d  e　", "It's we'll <|startoftext|>x1 22!! ¿qué?'", "ΑΣ ΣΑΣ", "… —\x1f!", " ", "", "&amp;lt; x", "Ã©Ã© CAFÉ…", "'s'tx'", "​­9́"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id int, text string").repartition(2)
    two = F.coalesce(T.pretokenize(T.clean_for_tokens(T.basic_clean("text"))), F.array().cast("array<string>"))
    rows = df.select(T.tokens("text").alias("one"), two.alias("two"), F.length(T.strip("text")).alias("n"), "text").collect()
    assert all(r.one == r.two for r in rows) and len(rows) == len(odd)
    marked = spark.createDataFrame([(t,) for t in [*odd, "&", "&1", "&#1", "Ã", "Ã\u0080", "à\u0080", "à\u0080\u0081", "ð\u009f\u0098\u0080", "ð\u009f"]], "t string")
    assert marked.where(F.col("t").rlike("&[#A-Za-z]|" + T.MOJIBAKE) != F.col("t").rlike(T._MARKED)).count() == 0


def test_packed_blocks_move_places_not_keys(spark):
    rows = spark.createDataFrame([(i, [f"w{i % 7}", "hot"] * 40) for i in range(400)], "id long, tokens array<string>").coalesce(1)
    vocab = spark.createDataFrame([("hot", 0)] + [(f"w{i}", i + 1) for i in range(7)], "token string, id long")
    out = TK.lookup_ids(rows, vocab, "id", max_entries=0)
    assert {r.id: r.ids for r in out.collect()} == {i: [i % 7 + 1, 0] * 40 for i in range(400)}
    assert "_low" in out._jdf.queryExecution().analyzed().toString()  # two bytes a key


def test_many_keys_in_a_block(spark):
    n = 70_000  # places beyond two bytes
    rows = spark.createDataFrame([(1, 0), (2, n // 2)], "id long, at long").select("id", F.sequence("at", F.lit(n)).alias("k")).coalesce(1)
    entries = spark.range(0, n, 2).select(F.col("id").alias("key"), (F.col("id") * 3).alias("value"))
    got = {r.id: r.v for r in TK._lookup_in_blocks(rows, "id", F.col("k"), entries, "v").collect()}
    assert got == {i: [3 * x if x % 2 == 0 and x < n else None for x in range(at, n + 1)] for i, at in ((1, 0), (2, n // 2))}


def test_truncated_rows_enter_the_batches(spark, tmp_path):
    from pairloom.operators import batching as BT
    d, seen = _documents(spark, tmp_path), []
    whole = BT.batch_ids

    def watch(df, *a, **k):
        seen.append(df.agg(F.max(F.size("ids"))).first()[0])
        return whole(df, *a, **k)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(q_text.BT, "batch_ids", watch)
        q_text.q_tokenize_pad_longest(spark, d).collect()
        q_text.q_attention_mask(spark, d).collect()
    assert seen == [q_text.MAX_LEN, 300]


@pytest.mark.parametrize("tile", [3, 512])
def test_tiles_give_the_rows_of_the_whole_matrix(monkeypatch, tile):
    monkeypatch.setattr(B, "TILE", tile)
    rng = np.random.default_rng(3)
    q = B.Side(np.arange(11) * 2, rng.integers(-2, 3, (11, 4)).astype(float))
    c = B.Side(np.arange(9) * 3, rng.integers(-2, 3, (9, 4)).astype(float))
    q.aux_ids, c.aux_ids = rng.choice(c.ids, 11), rng.choice(q.ids, 9)
    q.aux_vecs, c.aux_vecs = c.vecs[np.searchsorted(c.ids, q.aux_ids)], q.vecs[np.searchsorted(q.ids, c.aux_ids)]
    s = q.vecs @ c.vecs.T
    got = B.summary_kernel(1.0, both=True)(q, c)
    assert len(got) == 20  # one row for each row and column, whatever the tiles
    want = [(0, i, c.ids[np.argmax(r)], r.max(), np.exp(r - r.max()).sum()) for i, r in zip(q.ids, s)] + [(1, i, q.ids[np.argmax(r)], r.max(), np.exp(r - r.max()).sum()) for i, r in zip(c.ids, s.T)]
    assert np.allclose(got.to_numpy(float), np.array(want, float))
    better = lambda r, t, ids: int(sum((x > r[t] or (x == r[t] and i < ids[t])) and i != ids[t] for x, i in zip(r, ids)))
    want = [better(r, int(np.searchsorted(c.ids, t)), c.ids) for r, t in zip(s, q.aux_ids)] + [better(r, int(np.searchsorted(q.ids, t)), q.ids) for r, t in zip(s.T, c.aux_ids)]
    assert B.better_count_kernel(1.0, both=True)(q, c)["n_better"].tolist() == want


def test_a_query_goes_once_to_a_shelf(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    seen = []
    dealt = pruned._dealt

    def watch(visits, cands, rows):
        seen.append(visits.count())
        return dealt(visits, cands, rows)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(pruned, "_dealt", watch)
        m.setattr(pruned, "SHELF_ROWS", 200)
        got, share = pruned.top_k_pruned(df, df, 5, q_id="vec_id", q_vec="embedding", c_id="vec_id", c_vec="embedding", block_rows=8, per_pivot=20)
        top = {(r.q_id, r.rank): r.c_id for r in got.collect()}
    assert seen[-1] <= 600 * 4  # evenly spread vectors leave most blocks open: not a visit for each of them
    v = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    v /= np.linalg.norm(v, axis=1)[:, None]
    best = np.argsort(-np.round(v @ v.T, 12), axis=1, kind="stable")[:, :5]
    assert top == {(i, r + 1): best[i, r] for i in range(600) for r in range(5)} and share <= 1


def test_arrow_batches_are_bounded_in_bytes(spark):
    sizes = spark.range(400).coalesce(1).select(F.repeat(F.lit("x"), 200_000).alias("t"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    old = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    try:
        prepare_session(spark)
        assert max(r.n for r in sizes.mapInArrow(run, "n long").collect()) <= 50
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "20m")  # a session's own value stays
        prepare_session(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "20m"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch") if old is None else spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", old)
