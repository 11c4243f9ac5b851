"""Variant spellings of names typed by people.

Names become vectors of character n-grams weighted by rarity. A distributed sparse join finds all pairs whose cosine reaches a threshold: a pair must
share one of the rarest n-grams of both, so only those are joined, in blocks of bounded size. Pairs whose words contradict each other are struck
out; which words are of no weight and which stand for each other is learned from the pairs of the whole table. Average-linkage clustering on the
cosines groups the entities.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import materialize, salted_join


@dataclass(frozen=True)
class NameParams:
    #: characters of an n-gram
    gram: int = 4
    #: least cosine of two names
    cosine: float = 0.35
    #: n-grams that fewer names have count as this rare, so that typos do not outweigh the rest of a name
    rare: int = 16
    #: so do those that fewer than this share of all names have: true n-grams grow with the table, those of a typo do not
    rare_share: float = 1 / 1400
    #: power of the logarithm of rarity that weighs an n-gram
    sharpness: float = 3.0
    #: least average cosine of two clusters that are merged
    linkage: float = 0.3
    #: names that are compared at once: n-grams of more names are joined block by block
    block: int = 1000
    #: components of more entities are first merged in rounds over all tasks
    component: int = 2000
    #: names of different things in which something must be seen before it is learned
    support: int = 3
    #: a word is of no weight if it is what one of two names lacks in at least this share of the cases in which it tells them apart
    light: float = 1 / 3
    #: two words stand for each other if that is what the rarer of them is exchanged for in at least this share of cases
    variant: float = 0.3
    #: what is learned is held by every task, so it must be seen in over 1/learned of the cases of all that could be learned; that bounds each list
    learned: int = 10_000


def plain(name: str) -> str:
    """Lower case without accents; words that were run together by capitals are parted."""
    name = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", name)
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().replace("ß", "ss")


@lru_cache(200_000)
def words(name: str) -> tuple[str, ...]:
    """Runs of letters, in order."""
    return tuple(re.findall(r"[^\W\d_]+", plain(name)))


def word_grams(word: str, n: int = 4) -> list[str]:
    """Character n-grams of a word with a mark at either end."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]


def grams(name: str, n: int = 4) -> list[str]:
    return sorted({g for w in words(name) for g in word_grams(w, n)})


@lru_cache(500_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, replacements and swaps of neighbours; ``most`` if there are so many or more."""
    if abs(len(a) - len(b)) >= most:
        return most
    old, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            c = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if old and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, old[j - 2] + 1)
            new.append(c)
        old, row = row, new
        if min(new) >= most:
            return most
    return min(most, row[-1])


def _within(short: str, full: str) -> bool:
    """Whether ``short`` leaves letters of ``full`` out, in order."""
    rest = iter(full)
    return all(c in rest for c in short)


def alike(a: str, b: str) -> bool:
    """Whether two words can be forms of one: equal, a typo or two in a long word, an initial, a beginning, an abbreviation."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return b[0] == a
    d = edits(a, b)
    if (d == 1 and len(b) >= 4) or (d == 2 and len(a) >= 7 and a[0] == b[0]):
        return True
    return a[0] == b[0] and len(b) >= 5 and (b.startswith(a) or (len(a) <= 4 and _within(a, b)))


@lru_cache(200_000)
def unmatched(name_a: str, name_b: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], int, tuple[bool, bool]]:
    """The words of each name that have no counterpart in the other, the words that are equal in both, how many pairs of words agree, and which names have initials.

    Equal words are matched first, then words that the other name parts in two, then those that are alike, the closest first.
    """
    a, b = list(words(name_a)), list(words(name_b))
    equal = []
    for w in words(name_a):
        if w in b:
            a.remove(w), b.remove(w), equal.append(w)
    agree = len(equal)
    for whole, parts in ((a, b), (b, a)):
        for w in [w for w in whole if len(w) >= 5]:
            k = next((k for k in range(len(parts) - 1) if max(len(parts[k]), len(parts[k + 1])) < len(w) and edits(w, parts[k] + parts[k + 1]) <= 1), None)
            if k is not None:
                whole.remove(w)
                del parts[k : k + 2]
                agree += 1
    initials = [False, False]
    close = sorted((edits(x, y) if min(len(x), len(y)) > 1 else 9, x, y) for x in {*a} for y in {*b} if alike(x, y))
    for _, x, y in close:
        if x in a and y in b:
            a.remove(x), b.remove(y)
            agree += 1
            initials = [initials[0] or len(x) == 1 < len(y), initials[1] or len(y) == 1 < len(x)]
    return tuple(a), tuple(b), tuple(equal), agree, tuple(initials)


@dataclass(frozen=True)
class Usage:
    """What the table itself shows about words: those of no weight, and pairs that stand for each other."""

    light: frozenset = frozenset()
    variants: frozenset = frozenset()


def contradict(name_a: str, name_b: str, usage: Usage = Usage()) -> bool:
    """Whether each of two names has a word that the other has nothing for: members of a family, companies of a group, unlike things.

    Words of no weight are passed over if a whole word is equal; so are single letters beside two words that agree. An acronym stands for the words whose first
    letters it has, an initial for no word if its name has another one that could be meant.
    """
    a, b, equal, agree, initials = unmatched(name_a, name_b)
    if not agree or any(own and any(len(w) > 2 and w not in usage.light for w in side) for own, side in zip(initials, (a, b))):
        return True
    if any(len(w) > 2 for w in equal):
        a, b = (tuple(w for w in side if w not in usage.light) for side in (a, b))
    if agree > 1:
        a, b = (tuple(w for w in side if len(w) > 1) for side in (a, b))
    if not a or not b:
        return False
    for own, whole in ((a, words(name_b)), (b, words(name_a))):
        short = own[0] if len(own) == 1 and len(own[0]) <= 4 else "".join(own) if all(len(w) == 1 for w in own) else ""
        if len(short) > 1 and short in "".join(w[0] for w in whole):
            return False
    rest = list(b)
    for w in a:
        to = next((v for v in rest if (min(v, w), max(v, w)) in usage.variants), None)
        if to is not None:
            rest.remove(to)
    return len(b) - len(rest) < min(len(a), len(b))


def same_words(name_a: str, name_b: str, usage: Usage = Usage()) -> bool:
    """Whether two names have the same words, those of no weight aside, in whatever order."""
    heavy = lambda n: sorted(w for w in words(n) if w not in usage.light) or sorted(words(n))
    return heavy(name_a) == heavy(name_b)


def name_vectors(names: DataFrame, params: NameParams = NameParams()) -> DataFrame:
    """``name``, its n-grams ``gs`` as 64-bit keys from the rarest to the commonest, unit weights ``ws``, ``dfs``, ``rests``, ``rarity``.

    ``dfs`` has the number of names of each n-gram of the prefix: as many as it takes until the rest has a norm below ``params.cosine``, so no other name
    reaches it through the rest alone. ``rests`` has the norm of each of these n-grams and all after it. ``rarity`` is, for each of the words, the number of names that have its rarest n-gram.
    """

    def split(batches):
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "gs": [grams(x, params.gram) for x in batch["name"]]})

    given = materialize(names.mapInPandas(split, "name string, gs array<string>"), "grams")
    total = given.count()
    rare = max(params.rare, total * params.rare_share)
    flat = given.select("name", F.explode("gs").alias("g"))
    counts = flat.groupBy("g").agg(F.count("*").cast("int").alias("df"))
    counted = salted_join(flat, counts, ["g"]).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("g").alias("h"), "g"))).alias("v"))

    def weigh(batches):
        for batch in batches:
            rows = []
            for name, v in zip(batch["name"], batch["v"]):
                df = np.array([x["df"] for x in v], np.int64)
                w = np.log(1.5 + total / np.maximum(df, rare)) ** params.sharpness
                w /= math.sqrt(float((w * w).sum()))
                left = 1 - np.concatenate([[0.0], np.cumsum(w * w)[:-1]])
                of = {x["g"]: x["df"] for x in v}
                rarity = [min(of[g] for g in word_grams(x, params.gram)) for x in words(name)]
                prefix = left >= params.cosine**2 - 1e-6
                rows.append((name, [x["h"] for x in v], w.tolist(), df[prefix].tolist(), np.sqrt(left[prefix]).tolist(), rarity))
            yield pd.DataFrame(rows, columns=["name", "gs", "ws", "dfs", "rests", "rarity"])

    return counted.mapInPandas(weigh, "name string, gs array<bigint>, ws array<float>, dfs array<int>, rests array<float>, rarity array<int>")


class _Rows:
    """Names of a batch with their vectors, which are compared many pairs at once."""

    def __init__(self, frame: pd.DataFrame, params: NameParams):
        self.params, self.name, self.rarity = params, frame["name"].to_numpy(), frame["rarity"].to_numpy()
        self.n, self.prefix = frame["gs"].str.len().to_numpy(), frame["dfs"].str.len().to_numpy()
        self.at = np.cumsum(self.n) - self.n
        self.g, self.w = np.concatenate(frame["gs"].to_numpy()), np.concatenate(frame["ws"].to_numpy()).astype(np.float64)

    def padded(self, rows: np.ndarray, width: int):
        spot = np.arange(width)
        inside = spot < self.n[rows, None]
        index = np.where(inside, self.at[rows, None] + spot, 0)
        return self.g[index], np.where(inside, self.w[index], 0.0), inside, spot < self.prefix[rows, None]

    def near(self, i: np.ndarray, j: np.ndarray, key: np.ndarray, cells: int = 4_000_000):
        """Of the pairs of rows those whose cosine reaches the threshold, unless a rarer n-gram is in both prefixes, under which they are found as well."""
        width = np.maximum(self.n[i], self.n[j])
        size = 8
        while len(i):  # the short ones first, so that a long name widens no other's row
            now = width <= size
            a, b, k, step = i[now], j[now], key[now], max(1, cells // size**2)
            for s in range(0, len(a), step):
                yield from self._compare(a[s : s + step], b[s : s + step], k[s : s + step], size)
            i, j, key, width, size = i[~now], j[~now], key[~now], width[~now], 2 * size

    def _compare(self, a, b, key, width):
        (ga, wa, ina, pa), (gb, wb, inb, pb) = self.padded(a, width), self.padded(b, width)
        p, x, y = np.nonzero((ga[:, :, None] == gb[:, None, :]) & ina[:, :, None] & inb[:, None, :])
        cosine = np.bincount(p, wa[p, x] * wb[p, y], len(a))
        both = pa[p, x] & pb[p, y]
        first = np.full(len(a), width)
        np.minimum.at(first, p[both], x[both])  # n-grams stand in the same order in all names
        ok = (cosine >= self.params.cosine) & (first < width)
        for q in np.flatnonzero(ok).tolist():
            if ga[q, first[q]] == key[q]:
                yield self._row(int(a[q]), int(b[q]), min(1.0, float(cosine[q])))

    def _row(self, i: int, j: int, cosine: float) -> tuple:
        if self.name[i] > self.name[j]:
            i, j = j, i
        a, b = self.name[i], self.name[j]
        left_a, left_b, equal, _, _ = unmatched(a, b)
        rare = {**dict(zip(words(b), self.rarity[j])), **dict(zip(words(a), self.rarity[i]))}
        root = min(equal, key=lambda w: (rare[w], w), default=None)
        if root is not None and any(rare[w] < rare[root] for w in left_a + left_b):
            root = None  # the words in common are not what tells what is meant
        return a, b, cosine, root, list(left_a), list(left_b)


def whole_runs(batches, keys: list[str]):
    """Batches of rows sorted by ``keys``, cut anew so that none of them parts rows with equal keys."""
    held = None
    for batch in batches:
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(frame):
            continue
        tail = frame.iloc[-1]
        last = np.logical_and.reduce([frame[c].to_numpy() == tail[c] for c in keys])  # may go on in the next batch
        held, frame = frame[last], frame[~last]
        if len(frame):
            yield frame
    if held is not None and len(held):
        yield held


PAIRS = "a string, b string, cosine double, root string, left_a array<string>, left_b array<string>"


def name_pairs(names: DataFrame, params: NameParams = NameParams()) -> DataFrame:
    """All pairs of distinct names, ``a`` < ``b``, with a ``cosine`` of at least ``params.cosine``; with the words in which they differ and the rarest they share.

    Prefix filtering is exact: of a pair that reaches the threshold both prefixes share an n-gram. Each name goes, with its vector, to every n-gram of its
    prefix; one that more than ``params.block`` names have is joined block by block, so no task holds more than two blocks of it. A pair is given
    once, under the rarest n-gram that both prefixes share; so the norms from that n-gram on bound its cosine, and most pairs are dropped by these alone.
    """
    posted = name_vectors(names, params).withColumn("p", F.explode(F.arrays_zip("gs", "dfs", "rests"))).where("p.dfs > 1")
    blocks = F.ceil(F.col("p.dfs") / params.block).cast("int")
    placed = posted.withColumn("mine", F.pmod(F.xxhash64("name"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tile = ["key", "lo", "hi"]
    tiles = placed.select(F.col("p.gs").alias("key"), F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", F.col("p.rests").alias("rest"), "name", "gs", "ws", "dfs", "rarity")

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reset_index(drop=True)
        key, lo, hi, mine, rest = (frame[c].to_numpy() for c in (*tile, "mine", "rest"))
        n = np.arange(len(key))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        ends = np.append(starts[1:], len(key))
        after = np.repeat(ends, ends - starts) - n - 1
        i = np.repeat(n, after)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        own = (lo[i] == hi[i]) | (mine[i] != mine[j])  # pairs within a block belong to the tile of that block alone
        i, j = i[own], j[own]
        near = rest[i] * rest[j] >= params.cosine - 1e-5  # no rarer n-gram is in both, or the pair belongs to that one's tile
        i, j = i[near], j[near]
        return pd.DataFrame(list(_Rows(frame, params).near(i, j, key[i])), columns=[c.split()[0] for c in PAIRS.split(", ")]).astype({"cosine": float})

    def search(batches):
        for frame in whole_runs(batches, tile):
            yield compared(frame)

    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(tasks, *tile).sortWithinPartitions(*tile).mapInPandas(search, PAIRS)


def word_usage(pairs: DataFrame, params: NameParams = NameParams()) -> Usage:
    """What pairs of names with a telling word in common show about the other words, counted once for each telling word, over all pairs.

    A word that one name of a pair has and the other just lacks is of no weight, if that is so in a large enough share of the cases in which the word
    tells names apart. Two words stand for each other if names that differ only in them are common, measured by the rarer of the two: short forms of given names
    meet the full form, members of a family meet all sorts of names. Each list has fewer than ``params.learned`` entries by arithmetic: an entry must have
    over 1/``learned`` of the cases of its own kind, not of all pairs, since pairs that are near by chance grow faster than the table.
    """
    seen = pairs.where(F.col("root").isNotNull() & (F.size("left_a") + F.size("left_b") > 0)).select("root", "left_a", "left_b")
    alone = (F.size("left_a") + F.size("left_b") == 1).cast("int")
    cases = seen.select("root", F.explode(F.array_union("left_a", "left_b")).alias("w"), alone.alias("alone")).groupBy("w", "root").agg(F.max("alone").alias("alone"))
    told = cases.groupBy("w").agg(F.count("*").alias("n"), F.sum("alone").alias("alone"))
    often = lambda df: df.crossJoin(F.broadcast(df.agg(F.sum("n").alias("all")))).where(F.col("n") * params.learned > F.col("all"))
    light = often(materialize(told.where((F.length("w") > 1) & (F.col("alone") >= params.support) & (F.col("alone") >= params.light * F.col("n"))), "light")).select("w").collect()
    swaps = seen.where((F.size("left_a") == 1) & (F.size("left_b") == 1)).select("root", F.least(F.col("left_a")[0], F.col("left_b")[0]).alias("u"), F.greatest(F.col("left_a")[0], F.col("left_b")[0]).alias("v")).distinct()
    each = swaps.select("root", F.explode(F.array("u", "v")).alias("w")).distinct().groupBy("w").agg(F.count("*").alias("cases"))
    of = lambda k: each.select(F.col("w").alias(k), F.col("cases").alias(f"n{k}"))
    common = swaps.groupBy("u", "v").agg(F.count("*").alias("n")).where((F.col("n") >= params.support) & (F.length("u") > 1) & (F.length("v") > 1))
    kept = materialize(common.join(of("u"), "u").join(of("v"), "v").where(F.col("n") >= params.variant * F.least("nu", "nv")).select("u", "v", "n"), "variants")
    return Usage(frozenset(r.w for r in light), frozenset((r.u, r.v) for r in often(kept).select("u", "v").collect()))


#: similarities are summed as whole numbers of 1/UNIT, so that equal averages are equal in whatever order they were added up
UNIT = 1_000_000


def average_linkage(nodes: list, edges: list[tuple], threshold: float, sizes: dict | None = None) -> dict:
    """Clusters of a component: repeatedly merges the two with the highest average similarity, missing pairs counting 0.

    Ties go by a checksum of the two names, an order that ``_in_rounds`` shares. Nodes may be clusters: of ``sizes`` members, edges with summed similarities.
    """
    members = {n: [n] for n in nodes}
    size = {n: sizes[n] if sizes else 1 for n in nodes}
    sums: dict = {n: {} for n in nodes}
    for a, b, s in edges:
        sums[a][b] = sums[b][a] = round(s * UNIT)

    def entry(a, b):
        a, b = min(a, b), max(a, b)
        return -(sums[a][b] / (size[a] * size[b])), zlib.crc32(f"{a}\0{b}".encode()), a, b

    heap = [entry(a, b) for a in sums for b in sums[a] if a < b]
    heapq.heapify(heap)
    while heap:
        s, _, a, b = heapq.heappop(heap)
        if -s < threshold * UNIT:
            break
        if a not in members or b not in members or b not in sums[a] or sums[a][b] / (size[a] * size[b]) != -s:
            continue  # merged since
        for c, t in sums.pop(b).items():
            if c != a:
                sums[a][c] = sums[c][a] = sums[a].get(c, 0) + t
                del sums[c][b]
        del sums[a][b]
        members[a] += members.pop(b)
        size[a] += size.pop(b)
        for c in sums[a]:
            heapq.heappush(heap, entry(a, c))
    return {n: root for root, group in members.items() for n in group}


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``a``, ``b``: ``node``, ``component`` (its least node); nulls are no nodes.

    Large-star and small-star rounds: every node links its larger neighbours, then its smaller ones, to the least node it knows. Rounds go on until one changes
    nothing, which is when all nodes hang on the least of their component; their number grows with the logarithm of the size.
    """
    both = lambda e: e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    given = edges.where("a is not null and b is not null")
    links = materialize(given.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    nodes, before = given.select(F.explode(F.array("a", "b")).alias("node")).distinct(), mark(links)
    while before[0]:
        ways = both(links)
        least = ways.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = materialize(salted_join(ways, least, ["u"]).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large-star")
        near = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = salted_join(large, near, ["hi"]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(near.select("hi", F.col("m").alias("lo")))
        links = materialize(small.distinct(), "small-star")
        now = mark(links)
        if now == before:
            break
        before = now
    return nodes.join(links.select(F.col("hi").alias("node"), F.col("lo").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def same_entities(entities: DataFrame, key: str = "key", name: str = "name", aliases: str = "aliases", params: NameParams = NameParams()) -> DataFrame:
    """Clusters of entities with variant names: ``key``, ``cluster`` (its least key); only clusters of two or more.

    Entities whose names have the same words in the same order are one node. Two nodes are as similar as the closest of their names and aliases, one of which must be a
    name, but not at all where their names contradict each other, unless a name or alias of one has the same words as the name of the other.

    Defined cases: rows with a null key take no part; a null or blank name has only its aliases; repeated rows count once, and the names of rows that
    share a key are names of one entity; null aliases are none; names without any letters match nothing; no rows give no clusters.
    """
    rows = entities.select(F.col(key).alias("key"), F.col(name).alias("name"), F.coalesce(F.col(aliases), F.array()).alias("aliases")).where(F.col("key").isNotNull())
    each = rows.select("key", F.explode(F.concat(F.array(F.struct(F.col("name").alias("name"), F.lit(True).alias("main"))), F.transform("aliases", lambda x: F.struct(x.alias("name"), F.lit(False).alias("main"))))).alias("n"))
    lettered = each.select("key", "n.name", "n.main").where(F.col("name").isNotNull() & F.col("name").rlike(r"\p{L}"))

    def worded(batches):
        for batch in batches:
            yield batch.assign(name=[" ".join(words(n)) for n in batch["name"]])

    owned = materialize(lettered.mapInPandas(worded, "key string, name string, main boolean").where("name <> ''").groupBy("key", "name").agg(F.max("main").alias("main")), "names")
    label = materialize(owned.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("main"), F.col("name"))), F.concat(F.lit("\0"), "key")).alias("node")), "nodes")
    named = materialize(owned.join(label, "key").groupBy("node", "name").agg(F.max("main").alias("main")), "node-names")
    pairs = materialize(name_pairs(named.select("name").distinct(), params), "name-pairs")
    usage = word_usage(pairs, params)

    def judge(batches):
        for b in batches:
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "s": b["cosine"], "bad": [contradict(x, y, usage) for x, y in zip(b["a"], b["b"])], "same": [same_words(x, y, usage) for x, y in zip(b["a"], b["b"])]})

    judged = pairs.select("a", "b", "cosine").mapInPandas(judge, "a string, b string, s double, bad boolean, same boolean")
    mains, all_ = named.where("main").select(F.col("name").alias("m"), F.col("node").alias("km")), named.select("name", "node", "main")
    ways = judged.unionByName(judged.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "bad", "same"))
    equal = named.where("main").select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("s"), F.lit(False).alias("bad"), F.lit(True).alias("same")).distinct()
    # one side is a name, of which a node has few; the other side may be an alias that very many nodes share
    wide = salted_join(all_, mains.join(ways.unionByName(equal), mains["m"] == F.col("a")).select(F.col("b").alias("name"), "km", "s", "bad", "same"), ["name"]).where(F.col("km") != F.col("node"))
    met = wide.groupBy(F.least("km", "node").alias("a"), F.greatest("km", "node").alias("b")).agg(
        F.max(F.when(~F.col("bad"), F.col("s"))).alias("s"), F.max(F.col("main") & F.col("bad")).alias("against"), F.max(F.col("same")).alias("exact")
    )
    edges = materialize(met.where(F.col("s").isNotNull() & (~F.col("against") | F.col("exact"))).select("a", "b", "s"), "node-pairs")
    grouped = _clusters(edges, params).withColumnRenamed("key", "node")
    found = label.join(grouped, "node", "left").select("key", F.coalesce("cluster", "node").alias("cluster"))
    least = found.groupBy("cluster").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    return salted_join(found, least, ["cluster"]).select("key", F.col("least").alias("cluster"))


def _clusters(edges: DataFrame, params: NameParams) -> DataFrame:
    """Average linkage inside the components of the edges that reach the threshold, each whole in one task; components over the bound are first merged in rounds."""
    edges = edges.select("a", "b", F.round(F.col("s") * UNIT).cast("bigint").alias("t"), F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb"))
    found = components(edges.where(F.col("t") >= params.linkage * UNIT))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    label = materialize(found.join(sizes, "component"), "components")
    of = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"), "size")
    inside = edges.join(of("a"), "a").join(of("b").drop("size"), "b").where("ca = cb").drop("cb")

    def link(batches):
        for frame in whole_runs(batches, ["ca"]):
            a, b, t = (frame[c].tolist() for c in ("a", "b", "t"))
            members = dict(zip(a, frame["na"].tolist())) | dict(zip(b, frame["nb"].tolist()))
            groups = average_linkage(sorted(members), [(x, y, s / UNIT) for x, y, s in zip(a, b, t)], params.linkage, members)
            yield pd.DataFrame({"key": list(groups), "cluster": list(groups.values())})

    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given, else small components all end up in one task
    linked = lambda part: part.repartition(tasks, "ca").sortWithinPartitions("ca").mapInPandas(link, "key string, cluster string")
    out = linked(inside.where(F.col("size") <= params.component).drop("size"))
    if label.where(F.col("size") > params.component).limit(1).count():
        large = label.where(F.col("size") > params.component).select("node", F.col("node").alias("cluster"))
        merged, rest = _in_rounds(materialize(inside.where(F.col("size") > params.component).drop("size"), "large-components"), large, params)
        for part in rest:
            ends = linked(part).select(F.col("key").alias("cluster"), F.col("cluster").alias("end"))
            merged = materialize(merged.join(ends, "cluster", "left").select("node", F.coalesce("end", "cluster").alias("cluster")), "merged")
        out = out.unionByName(merged.select(F.col("node").alias("key"), "cluster"))
    many = Window.partitionBy("cluster")
    return out.withColumn("n", F.count("*").over(many)).where("n > 1").withColumn("cluster", F.min("key").over(many)).select("key", "cluster")


def _in_rounds(edges: DataFrame, merged: DataFrame, params: NameParams) -> tuple[DataFrame, list[DataFrame]]:
    """Merges clusters that are each other's best, all such pairs at once, until at most ``params.component`` clusters of a component can still merge.

    The result is that of ``average_linkage``: a merged cluster is never closer to a third than the closer of its halves was, so two that are each other's best
    stay so until they merge, and a cluster that reaches the threshold with no other never will. Gives ``node``, ``cluster``, and the summed edges that are left.
    """
    left = []
    while True:
        average = F.col("t") / (F.col("na") * F.col("nb"))
        ranked = edges.withColumn("rank", F.struct((-average).alias("s"), F.crc32(F.concat_ws("\0", "a", "b").cast("binary")).alias("h"), F.col("a").alias("x"), F.col("b").alias("y")))
        ends = ranked.select(F.col("a").alias("node"), F.col("na").alias("n"), "ca", "rank").unionByName(ranked.select(F.col("b").alias("node"), F.col("nb").alias("n"), "ca", "rank"))
        best = ends.groupBy("node").agg(F.first("n").alias("n"), F.first("ca").alias("ca"), F.min("rank").alias("rank")).where(F.col("rank.s") <= -params.linkage * UNIT)
        pair = Window.partitionBy("rank.x", "rank.y")
        mutual = F.count("*").over(pair) == 2
        new, total = F.when(mutual, F.col("rank.x")).otherwise(F.col("node")), F.when(mutual, F.sum("n").over(pair)).otherwise(F.col("n"))
        move = materialize(best.select("node", "ca", "n", new.alias("new"), total.alias("total")), "moves")
        sizes = materialize(move.groupBy("ca").agg(F.count("*").alias("size")), "sizes")
        small = sizes.where(F.col("size") <= params.component)
        alive = edges.join(move.select(F.col("node").alias("a")), "a", "left_semi").join(move.select(F.col("node").alias("b")), "b", "left_semi")
        left.append(materialize(alive.join(small, "ca", "left_semi"), "left-components"))
        large = sizes.where(F.col("size") > params.component)
        if not large.limit(1).count():
            return merged, left
        move = move.join(large, "ca", "left_semi")
        side = lambda k: move.select(F.col("node").alias(k), F.col("new").alias(f"{k}2"), F.col("total").alias(f"n{k}2"))
        moved = edges.join(side("a"), "a").join(side("b"), "b").where("a2 <> b2")
        x, y = F.struct(F.col("a2").alias("k"), F.col("na2").alias("n")), F.struct(F.col("b2").alias("k"), F.col("nb2").alias("n"))
        edges = materialize(
            moved.select("ca", "t", F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).groupBy("x", "y").agg(F.first("ca").alias("ca"), F.sum("t").alias("t"))
            .select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), "t", F.col("x.n").alias("na"), F.col("y.n").alias("nb"), "ca"), "large-components"
        )
        to = move.select(F.col("node").alias("cluster"), "new")
        merged = materialize(merged.join(to, "cluster", "left").select("node", F.coalesce("new", "cluster").alias("cluster")), "merged")


def same_pairs(clusters: DataFrame) -> DataFrame:
    """All unordered pairs of a cluster: ``key_a`` < ``key_b``."""
    a, b = clusters.select(F.col("key").alias("key_a"), "cluster"), clusters.select(F.col("key").alias("key_b"), "cluster")
    return a.join(b, "cluster").where("key_a < key_b").select("key_a", "key_b")
