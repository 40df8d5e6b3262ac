import numpy as np

from tidemark.llm.embeddings import _labels, near_vectors


def test_links_of_a_hot_group_over_many_lists(spark):
    r = np.random.default_rng(2)
    hot = r.normal(size=16) + r.normal(size=(700, 16)) * 0.22
    x = np.concatenate([hot, r.normal(size=(1400, 16))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {v.vec_id: v.n_links for v in near_vectors(df, list_rows=8).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found == links).all()


def test_equals_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 24))
    x = np.concatenate([base + r.normal(size=base.shape) * s for s in (0, 0.05, 0.1, 0.2, 0.3)] + [r.normal(size=(600, 24)), np.tile(base[:1], (90, 1))])
    rows = [(int(i) * 2, [float(v) for v in x[i]], "same") for i in range(len(x))]
    odd = [(5001, None, "same"), (5002, [0.0] * 24, "same"), (5003, [float("nan")] * 24, "same"), (5004, [None] + [1.0] * 23, "same"), (5005, [], "same"), (5006, [1.0, 2.0], "same"), (5007, [2.0, 4.0], "same"), (5008, [float("inf")] * 24, "same")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, kept string")
    got = {v.vec_id: v for v in near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = _labels(len(x), *np.nonzero(link))
    found = np.array([got[i * 2].n_links for i in range(len(x))])
    assert (found == link.sum(1)).all()
    assert all(got[i * 2].component_id == label[i] * 2 for i in range(len(x)))
    for i in (5001, 5002, 5003, 5004, 5005, 5008):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[5007].n_links, got[5007].component_id) == (1, 5006)
    assert near_vectors(df.limit(0)).count() == 0


def test_tiny_and_huge_components_change_no_other_link(spark):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(60, 8)), 3, axis=0) + r.normal(size=(180, 8)) * 0.05
    scale = np.ones(len(x))
    scale[[0, 3, 6]], scale[[1, 4, 7]], scale[9] = 1e-200, 1e200, 5e-324 / np.abs(x[9]).max() * 3
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in x[i] * scale[i]]) for i in range(len(x)) if i != 9]
    keep = np.array([i for i, _ in rows])
    links = (u[keep] @ u[keep].T >= 0.95).sum(1) - 1
    rows.append((500, [5e-324] + [0.0] * 7))
    rows.append((501, [1e308] * 8))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {v.vec_id: v.n_links for v in near_vectors(df, list_rows=8).collect()}
    extra = {i: 0 for i in keep}
    for v in (np.eye(8)[0], np.ones(8) / 8**0.5):
        for i in keep:
            extra[i] += bool(u[i] @ v >= 0.95)
    assert [got[i] for i in keep] == [int(n) + extra[i] for i, n in zip(keep, links)]


def test_null_and_repeated_ids(spark):
    def at(degrees):
        return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]

    # 18 degrees and less link; ids: a null between 4 and 9, a null alone, two null copies, 4 again elsewhere
    rows = [(9, at(0)), (None, at(15)), (4, at(30)), (None, at(100)), (None, at(150)), (None, at(150)), (4, at(200)), (3, at(210)), (4, at(30)), (None, None), (None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in near_vectors(df).collect()))
    want = [(9, 1, 4, False), (-1, 3, 4, False), (4, 2, 4, True), (4, 2, 4, True), (-1, 0, -1, True), (-1, 1, -1, True), (-1, 1, -1, True), (4, 1, 3, False), (3, 1, 3, True), (-1, 0, -1, True), (-1, 0, -1, True)]
    assert got == sorted(want)


def test_rows_sent_to_comparisons_grow_as_the_table_does(spark, monkeypatch):
    r = np.random.default_rng(4)
    kind, sent = type(spark.range(1).groupBy("id")), []
    whole = kind.applyInPandas

    def counted(self, *args, **kwargs):
        sent.append(self._df.count())
        return whole(self, *args, **kwargs)

    monkeypatch.setattr(kind, "applyInPandas", counted)
    for n in (1200, 4800):
        # a third is one group that several blocks share, with exact copies; the rest links with nothing
        x = np.concatenate([r.normal(size=32) + r.normal(size=(n // 3, 32)) * 0.15, r.normal(size=(n - n // 3, 32))])
        x[: n // 30] = x[n // 30 : n // 15]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        link = u @ u.T >= 0.95
        np.fill_diagonal(link, False)
        df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
        got = {v.vec_id: v for v in near_vectors(df, list_rows=32).collect()}
        label = _labels(n, *np.nonzero(link))
        assert [got[i].n_links for i in range(n)] == list(link.sum(1))
        assert [got[i].component_id for i in range(n)] == list(label)
    assert sent[1] <= 8 * 4800 and sent[1] <= 5.5 * sent[0]
