import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm.neighbors import NeighborParams, Tree, _sampled, chi2_cdf, chi2_quantile, similar_pairs, similar_vectors

SMALL = NeighborParams(leaf_rows=64, sample=500)


def frame(spark, vectors, extra=True):
    rows = [(f"v{i:04d}" if isinstance(k, int) else k, v, 1, "x") for i, (k, v) in enumerate(vectors)]
    return spark.createDataFrame(rows, "id string, embedding array<float>, rank int, leaf string")


def brute(x, k, least=None):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {(i, j) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k].tolist() if least is None or s[i, j] >= least}


def test_chi_square():
    assert chi2_cdf(chi2_quantile(0.99, 16), 16) == pytest.approx(0.99)
    assert chi2_cdf(3.0, 2) == pytest.approx(1 - math.exp(-1.5))
    assert chi2_cdf(1.0, 1) == pytest.approx(math.erf(math.sqrt(0.5)))
    assert chi2_cdf(0, 3) == 0 and chi2_cdf(1e6, 3) == 1


def test_threshold_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 16))
    x = np.concatenate([base, base[:150] + 0.25 * rng.standard_normal((150, 16))]).astype(np.float32)
    got = similar_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), "id", "embedding", 5, 0.9, 16, SMALL)
    pairs = {(int(r.id[1:]), int(r.other[1:])) for r in got.collect()}
    want = brute(x, 5, 0.9)
    assert pairs <= want and len(pairs) >= 0.97 * len(want)


def test_all_neighbours(spark):
    x = np.random.default_rng(2).standard_normal((300, 12)).astype(np.float32)
    got = similar_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), "id", "embedding", 4, None, 12, SMALL).collect()
    want = brute(x, 4)
    assert len(got) == 1200 and len({(int(r.id[1:]), int(r.other[1:])) for r in got} & want) >= 0.9 * len(want)
    assert sorted(r.rank for r in got if r.id == "v0000") == [1, 2, 3, 4]


def test_copies_and_bad_rows(spark):
    good, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(f"c{i:03d}", [2.0, 0.0, 0.0]) for i in range(30)] + [("d", good), ("d", good), ("n", None), ("z", [0.0] * 3), ("s", [1.0]), ("x", [1.0, None, 0.0]), ("nan", [float("nan"), 1.0, 0.0]), (None, good), ("o", other)]
    df = spark.createDataFrame([(k, v, 1, "") for k, v in rows], "id string, embedding array<float>, rank int, leaf string")
    got = similar_vectors(df, "id", "embedding", 3, 0.9, 3, SMALL).collect()
    per = {}
    for r in got:
        per.setdefault(r.id, []).append(r.other)
    assert len(per) == 31 and all(len(v) == 3 for v in per.values())
    assert sorted(per["d"]) == ["c000", "c001", "c002"] and sorted(per["c000"]) == ["c001", "c002", "c003"]
    assert similar_pairs(similar_vectors(df.limit(0), "id", "embedding", 3, 0.9, 3, SMALL)).count() == 0
    assert similar_vectors(df.where("id = 'd'"), "id", "embedding", 3, None, 3, SMALL).count() == 0


def test_tree_visits_every_leaf_within_reach():
    x = np.random.default_rng(3).standard_normal((500, 8)).astype(np.float32)
    tree = Tree(x, 3, SMALL)
    z = x @ tree.matrix
    rows, leaves = tree.visits(z, np.full(len(z), 1e9))
    assert len(rows) == 500 * 8 and set(tree.home(z)) == set(range(8, 16))
    assert tree.visits(z, np.full(len(z), -1.0))[1].tolist() == tree.home(z).tolist()


DELIVERED = "/root/testdata/sf0.01/embeddings.parquet"


@pytest.mark.skipif(not __import__("os").path.exists(DELIVERED), reason="no delivered vectors")
def test_delivered_vectors_through_a_tree(spark):
    """The ten nearest without a least cosine, of every id divisible by 20 against all rows, where the tree has several levels."""
    rows = spark.read.parquet(DELIVERED).select("vec_id", "embedding")
    params = NeighborParams(leaf_rows=64)
    got = {(r.id, r.other) for r in similar_vectors(rows, "vec_id", "embedding", 10, params=params).collect() if int(r.id) % 20 == 0}
    table = rows.toPandas().drop_duplicates("vec_id").set_index("vec_id").sort_index()
    x = np.stack(table.embedding.to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, want = table.index.to_numpy(), set()
    for n in np.flatnonzero(ids % 20 == 0):
        near = x @ x[n]
        near[n] = -2
        want |= {(str(ids[n]), str(ids[m])) for m in np.argsort(-near, kind="stable")[:10]}
    assert len(ids) > 4 * params.leaf_rows and len(got & want) >= 0.9 * len(want)


def test_ties_go_by_id(spark):
    rows = [(k, v) for k, v in (("q", [1.0, 0.0, 0.0]), ("b", [1.0, 1.0, 0.0]), ("a", [1.0, -1.0, 0.0]), ("d", [1.0, 0.0, 1.0]), ("c", [1.0, 0.0, -1.0]))]
    got = similar_vectors(spark.createDataFrame(rows, "id string, embedding array<float>"), "id", "embedding", 2, 0.6, 3, SMALL).where("id = 'q'").orderBy("rank").collect()
    assert [r.other for r in got] == ["a", "b"]


def test_driver_gets_the_sample_only(spark):
    """What tasks send to the driver does not grow with their number."""
    x = np.random.default_rng(4).standard_normal((4000, 64)).astype(np.float32)
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def sent():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).resultSize() for i in range(stages.size())}

    earlier = sent()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        similar_vectors(rows, "id", "embedding", 3, 0.9, 64, NeighborParams(leaf_rows=512, sample=500))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most = max(v for k, v in sent().items() if k not in earlier)
    assert 500 * 256 < most < 2 * 500 * 300  # four tasks with 500 vectors each would send over 500,000


def test_sample_is_the_least_hashes(spark):
    """The bound on the hash changes nothing in the sample."""
    x = np.random.default_rng(5).standard_normal((3000, 4)).astype(np.float32)
    rows = spark.createDataFrame([(v.tobytes(),) for v in x], "u binary").withColumn("h1", F.xxhash64("u")).cache()
    want = [bytes(r.u) for r in sorted(rows.collect(), key=lambda r: r.h1)]
    for most in (1, 100, 2900, 5000):
        assert [bytes(r.u) for r in _sampled(rows, 3000, most).collect()] == want[:most]
    assert _sampled(rows.limit(0), 0, 10).count() == 0


def test_plan_for_the_driver_is_short(spark):
    """The joins back to rows do not have the search in them again and again: the driver plans what is left anew after every stage."""
    x = np.random.default_rng(6).standard_normal((50, 4)).tolist()
    near = similar_vectors(frame(spark, list(enumerate(x))), "id", "embedding", 3, 0.9, 4, SMALL)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 20 and "Pandas" not in plan
