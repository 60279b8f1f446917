"""CSV records cut by many tasks; vocabularies too large to ship."""

import pytest

from pairloom.operators import tokens as TK
from pairloom.sources import readers as RD

VALUES = ['plain', '', 'two\nlines', 'a "quoted" word', 'comma, and\n\n"both"\n', '5" disk', '"', '\n', 'é ü\nß', 'x' * 90, 'line\n' * 30, ',', '""\n""']


def _quoted(v: str, i: int) -> str:
    return '"' + v.replace('"', '""') + '"' if i % 3 or any(c in v for c in ',\n"') else v


@pytest.mark.parametrize(("size", "shipped"), [(64, True), (64, False), (100_000, True)])
def test_records_over_split_borders(spark, tmp_path, monkeypatch, size, shipped):
    if not shipped:
        monkeypatch.setattr(RD, "MAX_SPLITS_BYTES", 0)
    rows = [(str(i), VALUES[i % len(VALUES)] + VALUES[(i * 7) % len(VALUES)], VALUES[(i * 5) % len(VALUES)], "en") for i in range(60)]
    for k, name in enumerate(("a.csv", "b.csv")):
        body = "id,source_text,target_text,lang\n" + "".join(",".join([r[0], _quoted(r[1], k), _quoted(r[2], int(r[0])), r[3]]) + "\n" for r in rows[k::2])
        (tmp_path / name).write_text(body + ("" if k else "\n\n"))
    (tmp_path / "empty.csv").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = []
        for name in ("a.csv", "b.csv", "empty.csv"):
            df = RD.read_splits(spark, {"train": str(tmp_path / name)}, multi_line=True)
            got += [(str(r.id), r.source_text or "", r.target_text or "", r.lang) for r in df.collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(rows)


def test_records_like_the_one_task_reader(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(b'id,source_text,target_text,lang\r\n1,5" disk,"a ""b""",en\r\n2,"x\ny",,fr\r\n\r\n3,"",z "mid" z,\r\n4,"open, then\nmore",w,de\r\n5,short\r\n')
    path = str(tmp_path / "c.csv")
    one = spark.read.schema(RD.PAIR_SCHEMA).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    many = RD.read_splits(spark, {"s": path}, multi_line=True).drop("s", "split")
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))


def test_blocks_of_rows_ask_for_their_entries(spark, monkeypatch):
    monkeypatch.setattr(TK, "BLOCK_BITS", 3)
    texts = [(i, [f"w{(i * j) % 37}" for j in range(i % 9)] + ["hot"] * (i % 4) + [None] * (i % 50 == 7)) for i in range(300)] + [(300, None), (None, ["w1", "gone"])]
    rows = spark.createDataFrame(texts, "id long, tokens array<string>").repartition(5)
    vocab = spark.createDataFrame([("hot", 0)] + [(f"w{i}", i + 1) for i in range(37)], "token string, id long")
    shipped, asked = ({r.id: r.ids for r in TK.lookup_ids(rows, vocab, "id", unk_id=99, max_entries=n).collect()} for n in (1000, 1))
    want = {w: i for w, i in [("hot", 0)] + [(f"w{i}", i + 1) for i in range(37)]}
    assert asked == shipped == {i: [want.get(t, 99) for t in ts or []] for i, ts in texts}
    ids = TK.lookup_ids(rows, vocab, "id", unk_id=99, max_entries=1)
    back = [{r.id: r.pieces for r in TK.lookup_pieces(ids, vocab, "id", unk="?", max_entries=n).collect()} for n in (1000, 1)]
    assert back[0] == back[1] == {i: [t if t in want else "?" for t in ts or []] for i, ts in texts}
    monkeypatch.setattr(TK, "MAX_PIECE_BYTES", 10)  # few entries, long strings
    assert {r.id: r.pieces for r in TK.lookup_pieces(ids, vocab, "id", unk="?").collect()} == back[0]
    assert TK.lookup_ids(rows.where("false"), vocab, "id", unk_id=99, max_entries=1).count() == 0
    assert TK.lookup_ids(rows, vocab.where("false"), "id", unk_id=99, max_entries=-1).count() == len(texts)
