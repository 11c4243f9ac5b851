"""Most similar vectors for every vector.

Unit vectors are projected to a few dimensions by a Gaussian (2-stable) matrix, so that a projected squared distance is the true one times a chi-square variable.
A kd-tree over the projections, fitted on a bounded sample, gives the leaves. In a leaf, projected neighbours are verified in
order of projected distance until the chi-square test says that a closer one would have shown up; the same test, applied to the gap
between a vector and a splitting plane, decides which other leaves it must visit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import materialize, salted_join


@dataclass(frozen=True)
class NeighborParams:
    #: projected dimensions
    projected: int = 16
    #: confidence of the chi-square test that ends the search in a leaf
    confidence: float = 0.99
    #: confidence of the test at each splitting plane
    plane_confidence: float = 0.9
    #: vectors of a leaf, about
    leaf_rows: int = 8192
    #: most vectors in the sample that the tree is fitted on; every vector is indexed
    sample: int = 20_000
    #: queries that are compared at once
    block: int = 512
    #: most tasks of a stage; with more leaves than that, a task has several
    tasks: int = 10_000
    seed: int = 7


def chi2_cdf(x: float, m: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = m / 2, x / 2
    if h > a + 60 + 10 * math.sqrt(a):
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-14:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


class Tree:
    """A perfect kd-tree over projections: at each node the widest dimension is cut at its median."""

    def __init__(self, vectors: np.ndarray, depth: int, params: NeighborParams):
        self.depth = depth
        self.matrix = np.random.default_rng(params.seed).standard_normal((vectors.shape[1], params.projected)).astype(np.float32)
        self.dim, self.cut = np.zeros(max(1, 2**depth), np.int64), np.zeros(max(1, 2**depth), np.float32)
        self._fit(vectors @ self.matrix, 1, 0)

    def _fit(self, z: np.ndarray, node: int, level: int) -> None:
        if level == self.depth:
            return
        if len(z):
            d = int(z.var(0).argmax())
            self.dim[node], self.cut[node] = d, np.median(z[:, d])
            right = z[:, d] > self.cut[node]
        else:
            right = np.zeros(0, bool)
        self._fit(z[~right], 2 * node, level + 1)
        self._fit(z[right], 2 * node + 1, level + 1)

    def home(self, z: np.ndarray) -> np.ndarray:
        node = np.ones(len(z), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (z[np.arange(len(z)), self.dim[node]] > self.cut[node])
        return node

    def visits(self, z: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves, their own among them, whose planes are all within ``reach``."""
        row, node = np.arange(len(z)), np.ones(len(z), np.int64)
        for _ in range(self.depth):
            gap = z[row, self.dim[node]] - self.cut[node]
            near = np.abs(gap) <= reach[row]
            side = (gap > 0).astype(np.int64)
            row, node = np.concatenate([row, row[near]]), np.concatenate([2 * node + side, 2 * node[near] + 1 - side[near]])
        return row, node


class Leaf:
    """Vectors of one leaf with their projections."""

    def __init__(self, vectors: np.ndarray, matrix: np.ndarray):
        self.x, self.z = vectors, vectors @ matrix
        square = (self.z**2).sum(1, keepdims=True)
        one = np.ones_like(square)
        self.left, self.right = np.concatenate([-2 * self.z, square, one], 1), np.concatenate([self.z, one, square], 1)

    def search(self, rows: np.ndarray, skip: np.ndarray | None, k: int, limit: np.ndarray, params: NeighborParams):
        """Per row of ``rows``: up to ``k`` nearest others with a squared distance of at most ``limit``. ``skip`` marks vectors that only count for rows outside it.

        Yields (row positions, neighbours, squared distances).
        """
        stop, n = chi2_quantile(params.confidence, params.projected), len(self.x)
        for at in range(0, len(rows), params.block):
            part = rows[at : at + params.block]
            projected = self.left[part] @ self.right.T
            if skip is not None:
                projected[np.ix_(skip[part], skip)] = np.inf
            projected[np.arange(len(part)), part] = np.inf
            open_, bound = np.arange(len(part)), limit[part].copy()
            few = (projected <= bound[:, None] * stop).sum(1)
            size = np.minimum(n, np.maximum(4 * k, 64))
            # Rows for which the test leaves few candidates are settled in one step, by verifying them all.
            easy = few <= 4 * size
            q, c = np.nonzero(projected[easy] <= (bound[easy] * stop)[:, None])
            q = open_[easy][q]
            yield self._verify(part, q, c, limit)
            open_ = open_[~easy]
            while len(open_):  # the others in rounds over ever more of the nearest projections
                near = np.argpartition(projected[open_], size - 1, 1)[:, :size] if size < n else np.tile(np.arange(n), (len(open_), 1))
                reached = np.take_along_axis(projected[open_], near, 1)
                d = 2 - 2 * np.einsum("ij,ikj->ik", self.x[part[open_]], self.x[near])
                d[np.isinf(reached)] = np.inf
                kth = np.partition(d, k - 1, 1)[:, k - 1] if size >= k else np.full(len(open_), np.inf)
                frontier = np.where(np.isinf(reached), -np.inf, reached).max(1)
                done = (frontier >= np.minimum(kth, bound[open_]) * stop) | (size >= n)
                q, c = np.nonzero(d[done] <= np.minimum(kth, bound[open_])[done][:, None])
                yield self._verify(part, open_[done][q], near[done][q, c], limit)
                open_, size = open_[~done], int(min(n, size * 8))

    def _verify(self, part, q, c, limit):
        d = 2 - 2 * np.einsum("ij,ij->i", self.x[part[q]].astype(np.float64), self.x[c].astype(np.float64))
        ok = d <= limit[part[q]]
        return part[q][ok], c[ok], d[ok]


def _unit(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dims)


def _sampled(groups: DataFrame, n: int, most: int) -> DataFrame:
    """The ``most`` vectors of ``n`` with the least hashes, in their order.

    Each task of a limit sends up to ``most`` rows, so all of them together the table; a bound on the hash, which ``most`` vectors fall short
    of once in 10^9 draws, is applied first, so that about as many rows as are wanted reach the driver, however large the table is.
    """
    share = (most + 6 * math.sqrt(most)) / max(1, n)
    low = groups if share >= 1 else groups.where(F.col("h1") < -(2**63) + int(share * 2**64))
    return low.orderBy("h1", "u").limit(most).select("u")


def _nearest(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["gid", "d", "other"], kind="stable")
    return frame[frame.groupby("gid").cumcount() < k]


def similar_vectors(table: DataFrame, id_col: str, vector_col: str, k: int = 10, min_cosine: float | None = None, dims: int = 64, params: NeighborParams = NeighborParams()) -> DataFrame:
    """For every vector the ``k`` most similar of the table: ``id``, ``other``, ``cosine``, ``rank``.

    With ``min_cosine`` neighbours below it are left out, which also bounds the search; the result is the same as of cutting afterwards.
    Neighbours with equal cosines are ranked by id. The search is approximate: a near neighbour is missed only if it lies farther off in every
    visited leaf than the chi-square tests allow for.

    Copies, that is vectors equal to six digits, are one point of the index, so a third of all rows may be copies of each other; each
    copy gets its neighbours, other copies first.

    Defined cases: rows with a null id, a null or short or long or all-zero vector or one with null or non-finite numbers take no part; an id that
    occurs twice counts once, with the greatest of its vectors; fewer than two vectors have no neighbours.
    """
    spark = table.sparkSession
    v = F.col(vector_col)
    rows = table.select(F.col(id_col).cast("string").alias("id"), v.cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    once = rows.groupBy("id").agg(F.max("v").alias("v"))

    def normalize(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy()).astype(np.float64)
            norm = np.sqrt((x * x).sum(1))
            if not (norm > 0).any():
                continue
            x = x[norm > 0] / norm[norm > 0][:, None]
            unit = (np.round(x * 2**20) / 2**20).astype(np.float32)
            yield pd.DataFrame({"id": batch["id"][norm > 0].to_numpy(), "u": [r.tobytes() for r in unit]})

    # Two hashes stand for a vector where only equality is asked for.
    hashes = (F.xxhash64("u").alias("h1"), F.xxhash64(F.lit(1), "u").alias("h2"))
    units = materialize(once.mapInPandas(normalize, "id string, u binary").select("id", "u", *hashes), "units")
    by_vector = Window.partitionBy("h1", "h2").orderBy("id")
    low = units.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)  # pruned before the shuffle as well
    groups = low.groupBy("h1", "h2").agg(F.min("u").alias("u"), F.array_sort(F.collect_list("id")).alias("low"))
    # numbered in the order of their least ids, so that ties in distance go by id wherever numbers are compared
    ordered = groups.withColumn("first", F.col("low")[0]).repartitionByRange("first").sortWithinPartitions("first").drop("first")
    groups = materialize(ordered.withColumn("gid", F.monotonically_increasing_id()), "vectors")
    n = groups.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / params.leaf_rows)))
    sampled = _sampled(groups, n, params.sample).toPandas()
    tree = Tree(_unit(sampled["u"], dims) if len(sampled) else np.zeros((0, dims), np.float32), depth, params)
    shared = spark.sparkContext.broadcast(tree)
    widest = np.float64(4.0 if min_cosine is None else 2 - 2 * min_cosine)
    width = min(max(12, 4 * 2**depth), params.tasks)

    def at_home(batches):
        for batch in batches:
            x = _unit(batch["u"], dims)
            yield pd.DataFrame({"leaf": shared.value.home(x @ shared.value.matrix), "gid": batch["gid"], "u": batch["u"]})

    def search_home(frame: pd.DataFrame) -> pd.DataFrame:
        x = _unit(frame["u"], dims)
        gid, leaf = frame["gid"].to_numpy(), Leaf(x, shared.value.matrix)
        found = [(gid[a], gid[b], d) for a, b, d in leaf.search(np.arange(len(x)), None, k, np.full(len(x), widest), params)]
        near = _nearest(pd.DataFrame({"gid": np.concatenate([f[0] for f in found]), "other": np.concatenate([f[1] for f in found]), "d": np.concatenate([f[2] for f in found])}), k)
        lists = near.groupby("gid").agg({"other": list, "d": list}).reindex(gid)
        none = [[] if not isinstance(o, list) else o for o in lists["other"]], [[] if not isinstance(o, list) else o for o in lists["d"]]
        reach = [min(float(widest), d[-1]) if len(d) == k else float(widest) for d in none[1]]
        return pd.DataFrame({"leaf": frame["leaf"].to_numpy(), "gid": gid, "u": frame["u"].to_numpy(), "reach": reach, "others": none[0], "ds": none[1]})

    placed = groups.select("gid", "u").mapInPandas(at_home, "leaf bigint, gid bigint, u binary")
    home = placed.repartition(width, "leaf").groupBy("leaf").applyInPandas(search_home, "leaf bigint, gid bigint, u binary, reach double, others array<bigint>, ds array<double>")
    home = materialize(home, "home-neighbours")
    edges = home.select("gid", F.explode(F.arrays_zip("others", "ds")).alias("e")).select("gid", F.col("e.others").alias("other"), F.col("e.ds").alias("d"))
    if depth:
        factor = math.sqrt(chi2_quantile(params.plane_confidence, 1)) / 2  # both ends of a pair come half the way

        def route(batches):
            for batch in batches:
                x = _unit(batch["u"], dims)
                row, leaf = shared.value.visits(x @ shared.value.matrix, np.sqrt(np.maximum(batch["reach"].to_numpy(), 0)) * factor)
                away = leaf != batch["leaf"].to_numpy()[row]  # projections of another batch may differ in the last bit
                row, leaf = row[away], leaf[away]
                own = pd.DataFrame({"leaf": batch["leaf"], "gid": batch["gid"], "u": batch["u"], "reach": batch["reach"], "guest": False})
                guests = pd.DataFrame({"leaf": leaf, "gid": batch["gid"].to_numpy()[row], "u": batch["u"].to_numpy()[row], "reach": batch["reach"].to_numpy()[row], "guest": True})
                yield pd.concat([own, guests], ignore_index=True)

        def search_guests(frame: pd.DataFrame) -> pd.DataFrame:
            guest = frame["guest"].to_numpy(bool)
            if not guest.any():
                return pd.DataFrame({"gid": [], "other": [], "d": []}).astype({"gid": "int64", "other": "int64", "d": "float64"})
            x, gid, reach = _unit(frame["u"], dims), frame["gid"].to_numpy(), frame["reach"].to_numpy()
            leaf, found = Leaf(x, shared.value.matrix), []
            for a, b, d in leaf.search(np.arange(len(x)), ~guest, k, reach, params):
                found.append((gid[a], gid[b], d))
            return _nearest(pd.DataFrame({"gid": np.concatenate([f[0] for f in found]), "other": np.concatenate([f[1] for f in found]), "d": np.concatenate([f[2] for f in found])}), k)

        routed = home.select("leaf", "gid", "u", "reach").mapInPandas(route, "leaf bigint, gid bigint, u binary, reach double, guest boolean")
        edges = edges.unionByName(routed.repartition(width, "leaf").groupBy("leaf").applyInPandas(search_guests, "gid bigint, other bigint, d double"))
    return _expand(edges, groups, units, k)


def _expand(edges: DataFrame, groups: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """From points of the index back to rows: every copy gets the copies and the members of near points, the nearest ``k``."""
    best = Window.partitionBy("gid").orderBy("d", "other")
    # Lineage is cut where little is left, since the driver plans each part anew after every stage: in one piece the two salted joins have the search in them many times.
    near = materialize(edges.dropDuplicates(["gid", "other"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), "near")
    members = groups.select(F.col("gid").alias("other"), "low")
    reached = near.join(members, "other").select("gid", F.col("d"), F.explode("low").alias("to"))
    copies = groups.where(F.size("low") > 1).select("gid", F.lit(0.0).alias("d"), F.explode("low").alias("to"))
    order = Window.partitionBy("gid").orderBy("d", "to")
    offered = reached.unionByName(copies).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    several = groups.where(F.size("low") > 1).select("gid", "h1", "h2")
    single = groups.where(F.size("low") == 1).select("gid", F.col("low")[0].alias("id"))
    listed = materialize(single.unionByName(salted_join(units.select("id", "h1", "h2"), several, ["h1", "h2"]).select("gid", "id")), "members")
    each = salted_join(listed, offered, ["gid"]).where(F.col("id") != F.col("to"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "to"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("id", F.col("to").alias("other"), (1 - F.col("d") / 2).alias("cosine"), "rank")


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs, ``id_a`` < ``id_b``, of which one is among the other's neighbours."""
    return neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
