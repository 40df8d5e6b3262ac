from tidemark.llm.mixing import mixed, mixed_rows, source_targets


def corpus(spark):
    rows, n = [], 0
    for source, docs, words in (("a", 40, 50), ("b", 3, 7), ("c", 60, 30), (None, 20, 11), ("empty", 2, 0)):
        for _ in range(docs):
            rows.append((n, "w " * (words + n % 5 * bool(words)), source, -1))
            n += 1
    rows.append((n, None, "a", -1))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(3 * sizes[s] for s in fixed)
        for s in names:
            target[s] = 3 * sizes[s] if s in fixed else left * weight[s] / sum(weight[x] for x in open_)
        above = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not above:
            return target
        fixed |= above


def test_targets_and_takes(spark):
    df = corpus(spark)
    rows = mixed(df).collect()
    assert len(rows) == df.count()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 2, (s, taken[s], want[s])
    again = sorted((r["doc_id"], r["taken"]) for r in mixed(df.repartition(7)).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_rows_of_the_mix(spark):
    df = corpus(spark)
    assert mixed_rows(df).columns == df.columns
    assert mixed_rows(df).count() > 0
    assert mixed(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, " ", "x")], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixed(blank).collect()] == [(0, 0, 0.0)] * 2


def test_all_excess_goes_round(spark):
    sizes = spark.createDataFrame([("=a", "a", 10), ("=b", "b", 1000), ("=c", "c", 1)], "key string, source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    assert all(abs(got[s] - t) < 1e-6 for s, t in brute_targets({"a": 10, "b": 1000, "c": 1}).items())
