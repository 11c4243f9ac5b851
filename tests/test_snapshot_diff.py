import random

from pyspark.sql import functions as F

from inkwell.operators.snapshot_diff import snapshot_diff, write_snapshot_ranges

SCHEMA = "snapshot_no int, path string, content_hash string, loaded_at string, change string, __v string, __before int"


def diff(spark, rows, ranges=None):
    df = spark.createDataFrame([(*r, "extra", "clash", 1) for r in rows], SCHEMA)
    out = snapshot_diff(df, ["path"], "snapshot_no", {"hash": F.lower("content_hash")}, "loaded_at", ranges)
    return sorted((r.snapshot_no, r.path, r.change, tuple(r.changed_columns)) for r in out.collect())


def test_changes_over_gaps_and_late_deliveries(spark):
    rows = [
        (1, "a", "X", "1"), (1, "a", "y", "2"), (1, "b", "B", "1"), (1, "c", None, "1"),
        (4, "a", "Y", "1"), (4, "c", "z", "1"), (4, "d", "d", "1"), (4, "d", "d", "1"),
        (5, "a", None, None), (5, "a", "y", None), (5, "b", "b", "1"), (5, "c", "z", "1"), (5, "d", None, "9"),
    ]
    assert diff(spark, rows) == [(4, "b", "removed", ()), (4, "c", "changed", ("hash",)), (4, "d", "added", ()), (5, "b", "added", ()), (5, "d", "changed", ("hash",))]


def test_nothing_to_compare(spark):
    assert diff(spark, []) == []
    assert diff(spark, [(3, "a", "x", "1")]) == []
    assert diff(spark, [(1, None, "x", "1"), (None, "a", "x", "1"), (2, None, "x", "1")]) == []


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 2, 5, 9]), rnd.choice(["hot", *"abcdefg"]) if rnd.random() < 0.7 else "hot", rnd.choice(["p", "P", "q", None]), str(rnd.randrange(50))) for _ in range(400)]
    latest = {}
    for v, p, h, at in rows:
        k = (at, h is not None, (h or "").lower())
        latest[v, p] = max(latest.get((v, p), k), k)
    want, versions = [], sorted({v for v, _ in latest})
    for old, new in zip(versions, versions[1:]):
        for p in {p for v, p in latest if v in (old, new)}:
            a, b = latest.get((old, p)), latest.get((new, p))
            if a is None or b is None:
                want.append((new, p, "added" if a is None else "removed", ()))
            elif a[1:] != b[1:]:
                want.append((new, p, "changed", ("hash",)))
    assert diff(spark, rows, 3) == sorted(want)


def test_plan_has_no_join_of_snapshots(spark):
    df = spark.createDataFrame([(1, "a", "x", "1", "", "", 1)], SCHEMA)
    plan = snapshot_diff(df, ["path"], "snapshot_no", {"h": F.col("content_hash")}, "loaded_at")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "__range" in plan and "Join" not in plan


def test_written_ranges_read_back(spark, tmp_path):
    df = spark.createDataFrame([(v, p, "h", "1", "", "", 1) for v in (1, 2) for p in "abcdef"], SCHEMA)
    write_snapshot_ranges(df, str(tmp_path / "s"), ["path"], "snapshot_no", 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 12


def test_newest_of_kept_snapshots(spark, tmp_path):
    from pyspark.sql import functions as F

    from inkwell.operators.snapshot_diff import newest_changes, write_snapshot_ranges

    rows = [(1, "a", "x", 1), (1, "b", "x", 1), (2, "a", "y", 1), (2, "b", "x", 1), (4, "b", "z", 1), (4, "c", None, 1)]
    df = spark.createDataFrame(rows, "v int, k string, h string, at int")
    where = str(tmp_path / "kept")
    write_snapshot_ranges(df.where("v < 4"), where, ["k"], "v", 2)
    write_snapshot_ranges(df.where("v = 4"), where, ["k"], "v", 2)
    got = sorted((r.v, r.k, r.change) for r in newest_changes(spark, where, ["k"], "v", {"h": F.col("h")}, "at").collect())
    assert got == [(4, "a", "removed"), (4, "b", "changed"), (4, "c", "added")]


def test_many_deliveries_of_one_key(spark):
    from pyspark.sql import functions as F

    from inkwell.operators.snapshot_diff import snapshot_diff

    rows = [(1 + n % 2, "hot", f"h{n % 2}{n // 40_000}", n) for n in range(50_000)] + [(v, f"k{n:04d}", "x", 0) for v in (1, 2) for n in range(2000)]
    got = snapshot_diff(spark.createDataFrame(rows, "v int, k string, h string, at int"), ["k"], "v", {"h": F.col("h")}, "at").collect()
    assert [(r.v, r.k, r.change, r.changed_columns) for r in got] == [(2, "hot", "changed", ["h"])]
