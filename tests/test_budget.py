import random

from packetloom.operators import budget


def _greedy(items, limit):
    used, kept = 0, set()
    for key, size in items:
        if used + size <= limit:
            used += size
            kept.add(key)
    return kept


def test_greedy_equals_fold_and_conserves_rows(spark):
    rng = random.Random(3)
    data = []
    for group, count in (("hot", 300), ("small", 40), ("empty", 5)):
        for i in range(count):
            size = rng.choice([0, 1, 2, 3, 7, 8, 9, 40, 64, 100, 101]) if group != "empty" else 500
            data.append((group, i, size))
    df = spark.createDataFrame(data, "g string, p long, size long")
    kept, skips = budget.byte_budget(df, ["g"], "p", "size", 100, mode="greedy")
    mine = {(r.g, r.p) for r in kept.collect()}
    expected = set()
    for group in {"hot", "small", "empty"}:
        expected |= {(group, k) for k in _greedy([(p, s) for g, p, s in data if g == group], 100)}
    assert mine == expected
    assert kept.count() + skips.count() == len(data)
    assert {r.reason for r in skips.collect()} == {"byte-budget"}


def test_prefix_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("a", 1, 60), ("a", 2, 50), ("a", 3, 10)], "g string, p long, size long")
    kept, skips = budget.byte_budget(df, ["g"], "p", "size", 100)
    assert [r.p for r in kept.collect()] == [1]
    assert sorted(r.p for r in skips.collect()) == [2, 3]


def test_group_limit_admits_first_seen_groups(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 3), (1, "b", 4), (2, "z", 9)], "cap int, g string, p long")
    kept, skips = budget.limit_groups(df, ["cap"], ["g"], "p", 2)
    assert sorted((r.g, r.p) for r in kept.collect()) == [("a", 2), ("b", 1), ("b", 4), ("z", 9)]
    assert [(r.g, r.reason) for r in skips.collect()] == [("c", "group-limit")]


def test_row_limit_lists_the_rest(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "cap int, p long")
    kept, skips = budget.limit_rows(df, ["cap"], "p", 4)
    assert sorted(r.p for r in kept.collect()) == [0, 1, 2, 3] and skips.count() == 6
    assert [(r.cap, r.skipped) for r in budget.skip_counts(skips, ["cap"]).collect()] == [(1, 6)]


def _sent(spark, groups, rows, seed):
    rng = random.Random(seed)
    data = [(g, i, rng.choice([0, 1, 2, 3, 7, 8, 40, 64, 100, 101, None])) for g in range(groups) for i in range(rows)]
    expected = {(g, k) for g in range(groups) for k in _greedy([(p, s) for o, p, s in data if o == g and s is not None], 100)}
    return spark.createDataFrame(data, "g int, p long, size long").repartition(4), data, expected


def test_greedy_walks_rows_once_and_scans_only_crowded_keys(spark, monkeypatch):
    df, data, expected = _sent(spark, 6, 80, 11)
    written = []
    real = budget.cut
    monkeypatch.setattr(budget, "cut", lambda frame: written.append(frame) or real(frame))
    for most, fewest, copies in ((1000, 0, 2), (79, 6, 9)):
        monkeypatch.setattr(budget, "HOT_ROWS", most)
        written.clear()
        kept, skips = budget.byte_budget(df, ["g"], "p", "size", 100, mode="greedy")
        assert {(r.g, r.p) for r in kept.collect()} == expected
        assert kept.count() + skips.count() == len(data)
        # One copy of the crowded keys, one of the rows walked, and for crowded keys one per power of two.
        assert len(written) == copies and real(written[0]).count() == fewest


def test_greedy_walk_goes_on_across_batches(spark, monkeypatch):
    df, data, expected = _sent(spark, 3, 50, 12)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        kept, _ = budget.byte_budget(df, ["g"], "p", "size", 100, mode="greedy")
        assert {(r.g, r.p) for r in kept.collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
