"""Passages of evaluation items inside a training corpus.

A prefix-filtered set join over word shingles. A document that reproduces enough of an item must share a certain number of the item's shingles
with it, so it shares one of the item's prefix: its shingles, the rarest in the corpus first, but for that number less one. Prefixes and documents
are joined by Spark; of the pairs that meet, those remain that hold enough shingles, and cover enough of the item's words by them, within an item-sized
window (length and positional bounds), and the words of these windows are aligned exactly.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import materialize, salted_join

#: Punctuation outside ASCII that parts words.
PUNCTUATION = "\u00a0\u00a1\u00ab\u00b7\u00bb\u00bf\u2009\u200b\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2022\u2026\u202f"
#: ASCII letters and digits, bytes of other characters and the mark between texts stay; all else parts words.
KEPT = bytes(i if i >= 128 or i == 0 or chr(i).isalnum() else 32 for i in range(256))
MARK = -1
#: Odd multipliers that spread the bits of a key over the filter.
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class LeakParams:
    #: words of a shingle; runs are made of shingles, so no run is without one
    shingle: int = 3
    #: least share of an item's words, reproduced in order
    coverage: float = 0.4
    #: longest stretch of the document, as a multiple of the item's words
    stretch: float = 4.0
    #: words of a run, and of the shorter runs that count for coverage
    run: int = 8
    short_run: int = 4
    #: least share of the reproduced words that stand in such runs
    in_runs: float = 0.9
    #: words that may differ inside a run
    gap: int = 3
    #: items are verified in blocks of at most so many words; this bounds what is broadcast
    block_words: int = 200_000
    #: most bits, as a power of two, of the filter over all shingles of the items, which goes to every task; a fuller filter lets more pass, and loses none
    filter_bits: int = 28
    #: prefix tables of up to so many rows are broadcast, larger ones are joined by key
    broadcast_rows: int = 200_000


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def tokens(text: str) -> list[bytes]:
    """Words in lower case without markup and punctuation, as UTF-8."""
    text = text.lower()
    if not text.isascii():
        for c in PUNCTUATION:
            text = text.replace(c, " ")
    return text.encode("utf-8", "replace").translate(KEPT).split()


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, without accents."""
    return [w if w.isascii() else fold(w.decode("utf-8", "replace")).encode() for w in tokens((text or "").replace("\x00", " "))]


class Keys(dict):
    """Word -> 63-bit key of the word without accents; spellings seen are kept, up to a bound."""

    def __init__(self, bound: int = 1_000_000):
        super().__init__({b"\x00": MARK})
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        bare = word if word.isascii() else fold(word.decode("utf-8", "replace")).encode()
        key = int.from_bytes(hashlib.blake2b(bare, digest_size=8).digest(), "big") >> 1
        if len(self) > self.bound:
            self.clear()
            self[b"\x00"] = MARK
        self[word] = key
        return key


def _mix(ids: np.ndarray, n: int) -> np.ndarray:
    """A 63-bit key for every n-gram of word keys; -1 where it would reach over the end of a text."""
    if len(ids) < n:
        return np.empty(0, np.int64)
    key, known = np.zeros(len(ids) - n + 1, np.uint64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        part = ids[k : len(ids) - n + 1 + k]
        known &= part >= 0
        key = (key ^ (part.astype(np.uint64) + np.uint64(SPREAD[0]))) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return np.where(known, (key >> np.uint64(1)).astype(np.int64), np.int64(-1))


def item_keys(words: list[bytes], keys: Keys, params: LeakParams) -> tuple[int, np.ndarray, int]:
    """Length of the shingles of an item (all of it if it is shorter), their keys in order, and how many different ones a case has at least.

    Each shingle gives at most its length of reproduced words, so a case has coverage/length as many shingle positions as the item has words; shingles that the item
    repeats fill several of them.
    """
    n = min(params.shingle, len(words))
    found = _mix(np.array([keys[w] for w in words], np.int64), n)
    times = np.sort(np.unique(found, return_counts=True)[1])[::-1]
    return n, found, int(np.searchsorted(np.cumsum(times), np.ceil(params.coverage * len(words) / n - 1e-9)) + 1)


class Filter:
    """A Bloom filter as an array of bytes; what it lets pass in error is dropped by the join."""

    def __init__(self, bits: int, raw: np.ndarray | None = None):
        self.bits, self.raw = bits, np.zeros(2**bits // 8, np.uint8) if raw is None else raw

    def _spots(self, keys: np.ndarray):
        for m in SPREAD:
            yield (keys.astype(np.uint64) * np.uint64(m)) >> np.uint64(64 - self.bits)

    def add(self, keys: np.ndarray) -> None:
        for spot in self._spots(keys):
            np.bitwise_or.at(self.raw, (spot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = np.arange(len(keys))
        for spot in self._spots(keys):
            spot = spot[at] if len(at) < len(spot) else spot
            at = at[(self.raw[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
        return at


def shared_shingles(texts: list[str], keys: Keys, sizes: list[int], known: Filter):
    """Per text: positions and keys of the shingles that some item may have, by position."""
    words = tokens(" \x00 ".join([t.replace("\x00", " ") for t in texts]))
    ids = np.fromiter(map(keys.__getitem__, words), np.int64, len(words))
    at, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in sizes:
        k = _mix(ids, n)
        ok = np.flatnonzero(k >= 0)
        ok = ok[known.has(k[ok])]
        at.append(ok), found.append(k[ok])
    at, found = np.concatenate(at), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    at, found = at[order], found[order]
    starts = np.concatenate([[0], np.flatnonzero(ids == MARK) + 1])
    bounds = np.searchsorted(at, np.append(starts, len(ids) + 1))
    for a, b, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), starts.tolist()):
        yield at[a:b] - s, found[a:b]


def possible(at: np.ndarray, size: float, need: int) -> bool:
    """Whether some ``size`` words hold ``need`` hits."""
    return len(at) >= need and bool((at[need - 1 :] - at[: len(at) - need + 1] <= size).any())


class Block:
    """Items of bounded size as verification needs them: a posting for every position of every shingle. Many documents are judged at once."""

    def __init__(self, rows: list[tuple], params: LeakParams):
        self.params, self.ids = params, [r[0] for r in rows]
        self.number = {i: k for k, i in enumerate(self.ids)}
        self.length, self.need = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.n, self.least = np.minimum(params.shingle, self.length), np.minimum(params.run, self.length)
        keys = np.concatenate([r[3] for r in rows])
        order = np.argsort(keys, kind="stable")
        self.item = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])[order]
        self.pos = np.concatenate([np.arange(len(r[3])) for r in rows])[order]
        self.unique, self.starts = np.unique(keys[order], return_index=True)
        self.times = np.diff(np.append(self.starts, len(order)))

    def cases(self, at: list[np.ndarray], keys: list[np.ndarray], asked: list) -> list[tuple[int, int]]:
        """The numbers of document and item of the pairs asked for that hold.

        First all equal shingles of a pair, and of these the ones that could be part of a long run, must cover enough of the item's words: no chain of runs has more.
        Pairs for which they do are aligned exactly.
        """
        p, many, wide = self.params, len(self.ids), int(self.length.max()) + 1
        doc, all_, where = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys), np.concatenate(at)
        spot = np.minimum(np.searchsorted(self.unique, all_), len(self.unique) - 1)
        own = self.unique[spot] == all_
        doc, spot, where = doc[own], spot[own], where[own].astype(np.int64)
        times = self.times[spot]
        index = np.repeat(self.starts[spot] - np.cumsum(times) + times, times) + np.arange(times.sum())
        pair, i, j = np.repeat(doc, times) * many + self.item[index], self.pos[index], np.repeat(where, times)
        wanted = np.array([d * many + self.number[x] for d, of in enumerate(asked) for x in of], np.int64)
        for of, least in ((None, p.coverage), ("long", p.coverage * p.in_runs)):
            if of is None:
                kept = np.isin(pair, wanted)
                pair, i, j = pair[kept], i[kept], j[kept]
                order = np.lexsort((i, j, pair))
                pair, i, j = pair[order], i[order], j[order]
                lasting = np.ones(len(pair), bool)
            else:
                lasting = self.lasting(pair, i, j)
            mine = pair[lasting] % many
            words = np.concatenate([(pair[lasting] * wide + i[lasting] + k)[k < self.n[mine]] for k in range(p.shingle)])
            words.sort()  # faster than np.unique, which hashes whole numbers
            words = words[np.flatnonzero(np.diff(words, prepend=-1))]
            found, covered = np.unique(words // wide, return_counts=True)
            kept = np.isin(pair, found[covered >= least * self.length[found % many] - 1e-9])
            pair, i, j, lasting = pair[kept], i[kept], j[kept], lasting[kept]
        pairs, first = np.unique(pair, return_index=True)
        last = np.append(first[1:], len(pair))
        return [divmod(x, many) for x, a, b in zip(pairs.tolist(), first.tolist(), last.tolist()) if self.is_case(x % many, i[a:b], j[a:b], lasting[a:b])]

    def lasting(self, pair: np.ndarray, i: np.ndarray, j: np.ndarray, steps: int = 48) -> np.ndarray:
        """Which matches some path through others, each near enough to continue the one before, could make part of a long run.

        A step goes on by a word of the item at least, so as many steps either way as words are lacking tell. Matches are sorted by pair and document position. Where a text
        repeats itself so much that a match has over ``steps`` others near it, its pair passes unchecked.
        """
        mine = pair % len(self.ids)
        more, reach = (self.least - self.n)[mine], self.params.gap + self.n[mine]
        before, after = [], []
        a = np.arange(len(i))
        for s in range(1, steps + 1):
            a = a[a + s < len(i)]
            a = a[(pair[a + s] == pair[a]) & (j[a + s] - j[a] <= reach[a])]  # the others have no partner further on either
            b = a + s
            on = (j[b] > j[a]) & (i[b] > i[a]) & (i[b] - i[a] <= reach[a])
            before.append(a[on]), after.append(b[on])
        low, high = i.copy(), i.copy()
        if before:
            before, after = np.concatenate(before), np.concatenate(after)
            for _ in range(int(more.max(initial=0))):
                np.minimum.at(low, after, low[before])
                np.maximum.at(high, before, high[after])
        return np.isin(pair, pair[a]) | (high - low >= more)

    def covered(self, item: int, i: np.ndarray) -> int:
        """How many of the item's words stand in shingles at these positions."""
        words = np.zeros(self.length[item] + self.n[item], bool)
        for k in range(self.n[item]):
            words[i + k] = True
        return int(words.sum())

    def is_case(self, item: int, i: np.ndarray, j: np.ndarray, lasting: np.ndarray) -> bool:
        """Exact verification of one pair from its matches: enough of the item's words in order within the stretch, mostly in long runs."""
        p, length = self.params, int(self.length[item])
        enough, stretch = p.coverage * length, p.stretch * length
        for a, b in windows(np.unique(j), int(stretch), int(self.need[item])):
            lo, hi = np.searchsorted(j, a), np.searchsorted(j, b, "right")
            if self.covered(item, i[lo:hi]) < enough or self.covered(item, i[lo:hi][lasting[lo:hi]]) < p.in_runs * enough:
                continue
            runs = runs_of(i[lo:hi].tolist(), j[lo:hi].tolist(), int(self.n[item]), p.gap)
            long = [r for r in runs if r[1] - r[0] >= self.least[item]]
            if sum(r[4] for r in long) < p.in_runs * enough or not chained(long, stretch, p.in_runs * enough):
                continue
            if chained([r for r in runs if r[4] >= min(p.short_run, length)], stretch, enough):
                return True
        return False


def runs_of(at_item: list[int], at_doc: list[int], n: int, gap: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches in which a document follows an item: item from, to, document from, to, words in common; from the positions of equal shingles of ``n`` words.

    Shingles in common are joined while at most ``gap`` words in between differ on either side; of several runs that one could extend, it goes to that on the nearest
    diagonal. There is one open run a diagonal, so the work grows with the pairs of equal shingles, however repetitive the texts.
    """
    reach, out = gap + n, []
    open_: dict[int, list] = {}  # diagonal -> first item and document position, last ones, words
    offsets = sorted(range(-reach, reach + 1), key=abs)
    for i, j in zip(at_item, at_doc):
        d, run = i - j, None
        for o in offsets:
            r = open_.get(d + o)
            if r is not None and 0 < i - r[2] <= reach and 0 < j - r[3] <= reach:
                run = r
                if o:
                    del open_[d + o]
                break
        if run is None:
            run = [i, j, i, j, n]
            out.append(run)
        else:
            run[4] += min(n, i - run[2])
            run[2], run[3] = i, j
        open_[d] = run
    return [(r[0], r[2] + n, r[1], r[3] + n, r[4]) for r in out]


def chained(runs: list[tuple[int, int, int, int, int]], stretch: float, enough: float = float("inf")) -> int:
    """Most words in runs that follow each other on both sides within ``stretch`` words of the document; 0 if they are not ``enough``, where that is asked."""
    runs, best, most = sorted(runs, key=lambda r: r[2]), [], 0
    for k, (i0, _, j0, j1, words) in enumerate(runs):
        chains = [(j0, words)]
        for p in range(k - 1, -1, -1):
            p0, p1, q0, _, _ = runs[p]
            if j1 - q0 > stretch:  # so do all before it, and no chain may begin there
                break
            if p0 < i0 and p1 <= i0 + 2:
                chains += [(start, sum_ + words) for start, sum_ in best[p] if j1 - start <= stretch]
        kept: list[tuple[int, int]] = []  # a chain that starts further back counts only if it has more words
        for start, sum_ in sorted(chains, reverse=True):
            if not kept or sum_ > kept[-1][1]:
                kept.append((start, sum_))
        best.append(kept)
        most = max(most, kept[-1][1])
        if most >= enough:
            return most
    return most if enough == float("inf") else 0


def windows(at: np.ndarray, size: int, need: int) -> list[tuple[int, int]]:
    """Unions of the stretches of ``size`` words that start at a hit and hold at least ``need`` hits."""
    ends = np.searchsorted(at, at + size)
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(ends - np.arange(len(at)) >= need).tolist():
        a, b = int(at[k]), int(at[ends[k] - 1])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def leaked_items(documents: DataFrame, items: DataFrame, params: LeakParams = LeakParams(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs ``doc_id``, ``item_id`` where the document reproduces passages of the item.

    Texts are read and parted into words once, whatever the number of items. Every document in which a window could hold a case keeps the positions and 63-bit keys of
    the shingles that some item may have (a filter of bounded size over all of them decides; what it lets pass in error drops out later). Counted over
    all documents, these give the order of rarity and so the prefixes, which are joined with the documents by key. The pairs that meet are verified
    from the kept shingles, the items in blocks of at most ``block_words`` words; each block reads its own candidates only.

    Defined cases: null or blank texts and items share nothing; a repeated (id, text) row gives its pair once; rows of one document id are texts of their own; texts of one item
    id are one item; an item shorter than a shingle is one shingle of its own length; no documents or no items give no rows; ties in rarity are broken by the key.
    """
    spark = documents.sparkSession
    doc_type, item_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    given = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).where(F.col("item").isNotNull() & F.col("t").isNotNull())
    one = given.groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("t")), "\n").alias("t"))

    def parse(batches):
        keys = Keys()
        for batch in batches:
            rows = []
            for item, t in zip(batch["item"], batch["t"]):
                words = words_of(t)
                if words:
                    n, found, need = item_keys(words, keys, params)
                    rows.append((item, len(words), n, need, found.tolist()))
            yield _frame(item=[r[0] for r in rows], length=[r[1] for r in rows], n=[r[2] for r in rows], need=[r[3] for r in rows], keys=[r[4] for r in rows])

    parsed = one.mapInPandas(parse, f"item {item_type}, length int, n int, need int, keys array<bigint>")
    before = F.sum("length").over(Window.orderBy("item").rowsBetween(Window.unboundedPreceding, -1))  # over the items, without their texts
    numbered = parsed.select("item", "length").withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / params.block_words).cast("int"))
    shingled = materialize(parsed.join(numbered.select("item", "block"), "item"), "item-shingles")
    facts = shingled.agg(F.max("length").alias("longest"), F.min("need").alias("need"), F.collect_set("n").alias("sizes"), F.sum(F.size("keys")).alias("keys"), F.max("block").alias("last")).first()
    if not facts.keys:
        return spark.createDataFrame([], f"doc_id {doc_type}, item_id {item_type}")
    known = spark.sparkContext.broadcast(_filter(shingled, facts["keys"], params))
    sizes, need, reach = sorted(facts.sizes), facts.need, params.stretch * facts.longest

    def scan(batches):
        keys = Keys()
        for batch in batches:
            for part in _parts(batch):
                rows = [(d, at, k) for d, (at, k) in zip(part["doc"], shared_shingles(part["txt"].tolist(), keys, sizes, known.value)) if possible(at, reach, need)]
                yield _frame(doc=[r[0] for r in rows], at=[r[1].astype(np.int32) for r in rows], keys=[r[2] for r in rows])

    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("txt")).where(F.col("doc").isNotNull() & F.col("txt").isNotNull())
    hits = docs.mapInPandas(scan, f"doc {doc_type}, at array<int>, keys array<bigint>").withColumn("row", F.monotonically_increasing_id())
    hits = materialize(hits, "shingle-hits")
    probe = hits.select("row", F.explode(F.array_distinct("keys")).alias("key"))
    seen = probe.groupBy("key").agg(F.count("*").alias("seen"))
    of_items = shingled.select("item", "block", "need", F.explode(F.array_distinct("keys")).alias("key"))
    rarest = Window.partitionBy("item").orderBy("seen", "key")
    ranked = of_items.join(seen, "key", "left").withColumn("seen", F.coalesce("seen", F.lit(0))).withColumn("rank", F.row_number().over(rarest)).withColumn("n", F.count("*").over(Window.partitionBy("item")))
    prefix = materialize(ranked.where((F.col("rank") <= F.col("n") - F.col("need") + 1) & (F.col("seen") > 0)).select("key", "item", "block"), "prefixes")
    met = probe.join(F.broadcast(prefix), "key") if prefix.count() <= params.broadcast_rows else salted_join(probe, prefix, ["key"])
    asked = met.groupBy("block", "row").agg(F.collect_set("item").alias("items"))
    candidates = materialize(asked.join(hits, "row").select("block", "doc", "at", "keys", "items"), "candidates", by=["block"])
    found = [_verified(candidates.where(F.col("block") == b), shingled.where(F.col("block") == b), params, doc_type, item_type) for b in range(facts["last"] + 1)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct().select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def _filter(shingled: DataFrame, n: int, params: LeakParams) -> Filter:
    """The filter over all shingles of the items: 32 bits each as far as ``filter_bits`` allows. Tasks make it in parts of that size, of which there are at most four."""
    bits = max(16, min(params.filter_bits, int(np.ceil(np.log2(32 * n)))))

    def collect(batches):
        part = Filter(bits)
        for batch in batches:
            for keys in batch["keys"]:
                part.add(np.asarray(keys))
        yield pd.DataFrame({"raw": [part.raw.tobytes()]})

    raw = np.zeros(2**bits // 8, np.uint8)
    for row in shingled.select("keys").coalesce(4).mapInPandas(collect, "raw binary").toLocalIterator():
        raw |= np.frombuffer(row.raw, np.uint8)
    return Filter(bits, raw)


def _verified(candidates: DataFrame, block: DataFrame, params: LeakParams, doc_type: str, item_type: str) -> DataFrame:
    """``doc``, ``item`` of the candidates that hold; the items of the block, whose size is bounded, go to every task."""
    spark = candidates.sparkSession
    held = spark.sparkContext.broadcast([(r["item"], r["length"], r["need"], np.array(r["keys"], np.int64)) for r in block.select("item", "length", "need", "keys").collect()])

    def verify(batches):
        items = Block(held.value, params)
        for batch in batches:
            docs, found = [], []
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500]
                doc = part["doc"].tolist()
                for d, i in items.cases(part["at"].tolist(), part["keys"].tolist(), part["items"].tolist()):
                    docs.append(doc[d]), found.append(items.ids[i])
            yield _frame(doc=docs, item=found)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the table is small beside the work, and would be read by few tasks
    return candidates.repartition(tasks).mapInPandas(verify, f"doc {doc_type}, item {item_type}")


def _parts(batch: pd.DataFrame, chars: int = 4_000_000):
    """Runs of rows with about so many characters, so long texts do not swell a batch."""
    size = batch["txt"].str.len().cumsum() // chars
    for _, part in batch.groupby(size, sort=False):
        yield part


def _frame(**columns: list) -> pd.DataFrame:
    """A frame whose columns keep their kind where they are empty."""
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})
