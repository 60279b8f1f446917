"""Finding F2 of round 4: padded parts of which only repeated ids move."""

from __future__ import annotations

import pytest

from pairloom.operators import pairs as PR


def test_only_repeated_ids_are_grouped(spark):
    a = spark.createDataFrame([(1, [1], "a"), (2, [], "b"), (3, [3, 3, 3], "c"), (3, [3, 3, 3], "c"), (None, [4], "n"), (5, None, "x")], "id long, x array<long>, t string")
    b = spark.createDataFrame([(1, [9, 9, 9, 9, 9, 9], "late"), (4, [7, 7], "d"), (None, [8], "late")], "id long, x array<long>, t string")
    moved = []
    earliest = PR._earliest

    def watch(rows, *more):
        moved.append(rows.count())
        return earliest(rows, *more)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(PR, "_earliest", watch)
        out = PR.concat_parts([a, b], "id", pad={"x": 2})
        got = {r.id: (r.x, r.t) for r in out.collect()}
    assert moved == [6] and out.count() == 6
    want = {1: [1], 2: [], 3: [3, 3, 3], None: [4], 4: [7, 7]}
    assert got == {i: (x + [-100] * (3 - len(x)), t) for (i, x), t in zip(want.items(), ["a", "b", "c", "n", "d"])} | {5: (None, "x")}
