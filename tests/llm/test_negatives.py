import math

import duckdb
import numpy as np

from tidemark.llm.negatives import NEGATIVES_SQL, Asked, CoverTree, hard_negatives
from tidemark.llm.queries import op13_hard_negatives

SF = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<double>, label int, rank int, x string"


def brute(rows, every=100):
    ok = [(i, [math.floor(256 * v) for v in x], (y + 1) % 10 if i % 7 == 0 else y)
          for i, x, y, *_ in rows if i is not None and x is not None and y is not None and all(v is not None and math.isfinite(v) for v in x)]
    found = []
    for a, (i, x, y) in enumerate(ok):
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, u)), j, z) for b, (j, u, z) in enumerate(ok) if b != a and len(u) == len(x)]
        for ps, pid, _ in sorted(s for s in scored if s[2] == y)[:5]:
            fits = sorted(s for s in scored if s[2] != y and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:10]
            found += [(i, pid, k + 1, nid, -ps, -ns) for k, (ns, nid, _) in enumerate(fits)]
    return sorted(found)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], y, 0, "x") for i, x, y in rows], SHAPE)


def test_equals_brute_force_with_hot_vectors_many_trees_and_odd_rows(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 10))
    x = centres[r.integers(0, 12, 1500)] + r.normal(size=(1500, 10)) * 0.3
    x[200:700] = x[0]  # a third of all rows
    rows = [(i, x[i].tolist(), int(r.integers(0, 10))) for i in range(1500)]
    rows += [(5000, None, 1), (5100, [1.0] * 10, None), (5200, [float("nan")] * 10, 1), (5300, [None] * 10, 1), (5400, [float("inf")] * 10, 1), (None, [1.0] * 10, 1)]
    rows += [(5500, [0.0] * 10, 2), (5600, [], 3), (5601, [], 4), (5700, [1.0, 2.0], 1), (5701, [1.5, 2.5], 1), (5702, [1.0, 1.0], 2), (300, [9.0] * 10, 4)]
    want = brute(rows)
    assert len(want) > 500
    df = table(spark, rows)
    assert got(hard_negatives(df)) == want
    assert got(hard_negatives(df.repartition(5), block_rows=64, sample_rows=300, most_cells=8)) == want


def test_few_rows_one_label_and_no_rows(spark):
    one = [(i * 100, [1.0 * i, 2.0], 3) for i in range(1, 6) if (i * 100) % 7]
    assert got(hard_negatives(table(spark, one))) == brute(one) == []
    assert hard_negatives(table(spark, [])).count() == 0
    huge = table(spark, [(100, [1e200, 1.0], 1), (101, [1e200, 2.0], 1), (102, [1e200, 3.0], 2), (200, [1e12, 1.0], 2)])
    hard_negatives(huge).collect()


def test_nodes_cover_their_rows_and_levels_are_separated():
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(900, 6)) * 256)
    norm2 = float((x**2).sum(1).max())
    tree = CoverTree(x, np.arange(900), np.arange(900), np.zeros(900, int), norm2)
    wide = np.column_stack([x, np.sqrt(norm2 - (x**2).sum(1))])
    kept = wide[tree.ids]
    assert sorted(tree.ids) == list(range(900))
    for node, (a, b) in enumerate(tree.span):
        away = np.linalg.norm(kept[a:b] - wide[tree.point[node]], axis=1)
        assert away.max() <= tree.radius[node]
        kids = tree.kids[node]
        for k, p in enumerate(kids):
            assert tree.radius[p] <= tree.radius[node] / 2 * (1 + 1e-6) + 1e-6
            for q in kids[:k]:
                assert np.linalg.norm(wide[tree.point[p]] - wide[tree.point[q]]) > tree.radius[node] / 2 * (1 - 1e-6) - 1e-3


def test_descent_skips_nodes():
    r = np.random.default_rng(6)
    x = np.floor((r.normal(size=(20, 8))[r.integers(0, 20, 4000)] * 3 + r.normal(size=(4000, 8)) * 0.05) * 256)
    tree = CoverTree(x, np.arange(4000), np.arange(4000), r.integers(0, 3, 4000), float((x**2).sum(1).max()))
    looked = []
    block = Asked(x[:1], np.array([0]), np.array([9]), [[(-math.inf, math.inf)]])
    real = block.may_gain
    block.may_gain = lambda *a: looked.append(1) or real(*a)
    tree.descend(block, 10, False)
    score = x @ x[0]
    assert [-s for s, _, _ in block.best[0][0]] == sorted((score[i] for i in range(4000) if i != 0), reverse=True)[:10]
    assert len(looked) < len(tree.point) / 3


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({NEGATIVES_SQL})").fetchall())
    assert got(op13_hard_negatives(spark, SF)) == want
