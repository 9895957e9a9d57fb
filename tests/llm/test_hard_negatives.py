"""Mined negatives against all scores, in whole numbers."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn
from tessera.llm import oracles, queries

ROW = "vec_id bigint, embedding array<float>, label int"


def plain(rows: list[tuple]) -> list[tuple]:
    kept = {}
    for id, vector, label in rows:
        if id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept[id] = ((label + 1) % 10 if id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector])
    out = []
    for a, (label, vector) in kept.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, other[1], strict=False)), b) for b, other in kept.items() if b != a)
        for minus, p in [s for s in scored if kept[s[1]][0] == label][:5]:
            near = [s for s in scored if kept[s[1]][0] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus]
            out += [(a, p, k + 1, n, -minus, -score) for k, (score, n) in enumerate(near[:3])]
    return sorted(out)


def vectors(n: int, dims: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(6)]
    rows = []
    for k in range(n):
        base = centres[rng.randrange(6)]
        spread = rng.choice([0.0, 0.05, 0.4])  # zero: a frequent vector, so ties
        rows.append((k, [x + rng.gauss(0, spread) for x in base], rng.choice([0, 0, 0, 1, 2, 9])))
    return rows


AWKWARD = [
    (None, [1.0, 1.0, 1.0], 1), (5000, None, 1), (5050, [1.0, 1.0, 1.0], None), (5100, [1.0, None, 1.0], 1),
    (5150, [1.0, float("nan"), 1.0], 1), (5200, [float("inf"), 0.0, 0.0], 1), (5250, [0.0, 0.0, 0.0], 1),
    (5300, [0.5, -0.5], 0), (5350, [], 0), (-50, [0.3, 0.3, -0.3], 0), (5400, [0.2, 0.2, 0.2], 77),
]


@pytest.mark.parametrize(("dims", "block"), [(3, 16), (3, 8192), (12, 40)])
def test_against_all_scores(llm, tmp_path, dims, block):
    rows = [*vectors(600, dims, dims), *AWKWARD]
    given = llm.createDataFrame([*rows, rows[0], rows[7]], ROW).repartition(3)
    given = given.select("*", F.lit(1).alias("id"), F.lit("x").alias("vector"), F.lit(0).alias("a.b"), F.lit(2).alias("slices"))
    given.write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    frame = llm.read.parquet(f"{tmp_path}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor"), F.lit(3).alias("rank")
    )
    assert sorted(map(tuple, hn.mine(frame, block=block).collect())) == plain(rows)
    if block == hn.BLOCK:
        assert sorted(map(tuple, queries.op11_hard_negatives(llm, str(tmp_path)).collect())) == plain(rows)


def test_twin(llm, tmp_path):
    rows = vectors(300, 4, 3)
    llm.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    assert sorted(con.sql(oracles.hard_negatives()).fetchall()) == plain(rows)


def test_lists_are_left_early_and_nothing_is_lost():
    rng = np.random.default_rng(1)
    matrix = np.floor(rng.normal(0, 40, (4000, 4)))
    matrix[:20] += 200
    lists = hn.SortedLists(np.arange(4000), np.zeros(4000, int), matrix)
    anchor = np.array([3.0, 2.0, 1.0, 5.0])
    (found,) = lists.best(anchor, np.ones(4000, bool), [(-math.inf, math.inf)], 5)
    scores = matrix @ anchor
    assert found == [(int(i), int(scores[i])) for i in np.lexsort((np.arange(4000), -scores))[:5]]
    assert lists.read < 400
    above = scores.max() + 1
    assert lists.best(anchor, np.ones(4000, bool), [(above, above + 5)], 5) == [[]] and lists.read < 4000


def test_equal_scores_go_to_the_smaller_id_even_when_met_late():
    matrix = np.array([[5.0, 0.0], [0.0, 5.0], [5.0, 0.0], [2.0, 3.0]] * 30)
    ids = np.arange(120)[::-1].copy()
    lists = hn.SortedLists(ids, np.zeros(120, int), matrix)
    (found,) = lists.best(np.array([1.0, 1.0]), np.ones(120, bool), [(-math.inf, math.inf)], 3)
    assert found == [(0, 5), (1, 5), (2, 5)]


def test_huge_components_saturate(llm):
    rows = [(0, [3e38, -3e38], 1), (1, [3e38, 1.0], 1), (2, [2e38, 0.0], 2), (3, [1.0, 1.0], 2)]
    frame = llm.createDataFrame([(i, v, c, i == 0) for i, v, c in rows], "id bigint, vector array<float>, label int, anchor boolean")
    got = hn.mine(frame).collect()
    assert [(r.anchor_id, r.positive_id) for r in got] in ([(0, 1)], []) and all(abs(r.negative_score) < 2**62 for r in got)


def test_exact_beyond_floats(llm):
    """Scores above 2^53 differ by one."""
    rows = [(0, [100_000.0, 1 / 256], 1), (1, [100_000.0, 3 / 256], 1), (2, [90_000.0, 1 / 256], 2), (3, [90_000.0, 2 / 256], 2), (4, [90_000.0, 0.0], 2)]
    frame = llm.createDataFrame([(i, v, c, i == 0) for i, v, c in rows], "id bigint, vector array<double>, label int, anchor boolean")
    assert [r.negative_id for r in hn.mine(frame).orderBy("rank").collect()] == [3, 2, 4]


def test_empty_table(llm):
    frame = llm.createDataFrame([], "id bigint, vector array<float>, label int, anchor boolean")
    assert hn.mine(frame).count() == 0
