import random

from pyspark.sql import functions as F

from copse.operators.ordered import fold_changes, global_rank, segments


def test_rank_is_the_same_in_one_task_and_in_many(spark):
    rnd = random.Random(1)
    values = rnd.sample(range(100_000), 3000)
    df = spark.createDataFrame([(v % 7, v) for v in values], "a long, b long").repartition(6)
    want = {row: i for i, row in enumerate(sorted((v % 7, -v) for v in values))}
    for limit in (10_000, 10):
        got = global_rank(df, "a", F.desc("b"), single_task_rows=limit).collect()
        assert {(r.a, -r.b): r["rank"] for r in got} == want


def test_runs_do_not_depend_on_the_block_size(spark):
    rnd = random.Random(2)
    rows = [(k, p, rnd.randint(-3, 3), rnd.random() < 0.5 and 1 or 0)
            for k in range(5) for p in rnd.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k long, p long, v long, w long")

    def result(**kw):
        return sorted(tuple(r) for r in segments(df, ["k"], "p", ["v", "w"], **kw).select(
            "k", "p", "cum_v", "cum_w", "next_p").fillna(-1).collect())

    plain = result(n_positions=200)
    assert plain == result(block=16) == result(n_positions=200, block=7)
    total = sum(v for k, p, v, w in rows if k == 3)
    assert [r[2] for r in plain if r[0] == 3 and r[4] == -1] == [total]


def test_a_split_range_leaves_no_change_point(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 3, 4)], "k long, f long, l long")
    got = fold_changes(df, ["k"], "f", "l", {"d": F.lit(1)}, pos="p").collect()
    assert {(r.k, r.p): r.d for r in got} == {(1, 0): 1, (1, 9): -1, (2, 3): 1, (2, 4): -1}
