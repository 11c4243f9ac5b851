"""Filling fixed-capacity containers with texts measured in tokens.

Vector bin packing with the dot-product heuristic: an open container takes, of the items that still fit under all its limits, the one whose demand
has the largest dot product with what is left. Limits are tokens, segments and loss-bearing tokens.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import materialize

FRONT = re.compile(r"\A\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
#: Fixed value: the pattern that parts a text before byte-pair merging, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class PackParams:
    #: vocabulary as ranks of a byte-level BPE
    vocabulary: str = os.environ.get("INKWELL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    #: one segment is allowed per so many tokens of capacity, so a container of 512 tokens holds 64
    tokens_per_segment: int = 8
    #: share of the capacity that may bear loss
    loss_share: float = 1.0
    #: items that are packed together, about
    group_rows: int = 16_384
    #: containers filled less than this are opened again and packed with those of other groups
    well_filled: float = 0.98
    #: most rows of the container table; it goes to every task
    slots: int = 1000
    #: most tasks of a round; with more groups than that, a task packs several
    tasks: int = 10_000


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, doc_id: str, text: str, params: PackParams) -> DataFrame:
    """``doc_id``, ``tokens`` and ``masked``, the leading tokens of the frontmatter, which bear no loss."""
    kind, path = documents.schema[doc_id].dataType.simpleString(), params.vocabulary

    def measure(batches):
        encode = encoder(path).encode_ordinary
        for batch in batches:
            tokens, masked = [], []
            for t in batch["txt"]:
                front = FRONT.match(t)
                head = len(encode(front.group())) if front else 0
                masked.append(head)
                tokens.append(head + len(encode(t[front.end() :] if front else t)))
            yield pd.DataFrame({"doc_id": batch["doc"], "tokens": tokens, "masked": masked})

    given = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("txt")).where(F.col("doc").isNotNull() & F.col("txt").isNotNull())
    return given.mapInPandas(measure, f"doc_id {kind}, tokens bigint, masked bigint").where("tokens > 0").distinct()


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_limit: int) -> np.ndarray:
    """The container number of each item, by the dot-product heuristic; -1 for an item above the capacity. Items of equal demand are taken in order.

    An item that alone bears more loss than the limit has a container of its own, since it may not be split.
    """
    out = np.full(len(tokens), -1, np.int64)
    alone = np.flatnonzero((tokens <= capacity) & (loss > loss_limit)) if segments > 0 else np.empty(0, np.int64)
    out[alone] = np.arange(len(alone))
    order = np.lexsort((np.arange(len(tokens)), -loss, -tokens))
    order = order[(tokens[order] <= capacity) & (loss[order] <= loss_limit)] if segments > 0 else order[:0]
    n = len(order)
    if not n:
        return out
    t, l = tokens[order], loss[order]
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (l[1:] != l[:-1])]))
    count = np.diff(np.append(first, n))
    kt, kl, next_ = t[first], l[first], first.copy()
    unit_t, unit_l, unit_s = kt / capacity, kl / max(1, loss_limit), 1 / segments
    bin_, left = len(alone), n
    alive = np.arange(len(kt))
    while left:
        room_t, room_l, room_s = capacity, loss_limit, segments
        while room_s > 0:
            lo = np.searchsorted(-kt[alive], -room_t)  # sizes fall along ``alive``
            ok = alive[lo:]
            if not len(ok):
                break
            score = unit_t[ok] * (room_t / capacity) + unit_l[ok] * (room_l / max(1, loss_limit)) + unit_s * (room_s / segments)
            score[kl[ok] > room_l] = -1
            best = int(score.argmax())
            if score[best] < 0:
                break
            k = int(ok[best])
            out[order[next_[k]]] = bin_
            next_[k] += 1
            count[k] -= 1
            room_t, room_l, room_s, left = room_t - kt[k], room_l - kl[k], room_s - 1, left - 1
            if not count[k]:
                alive = np.delete(alive, lo + best)
        bin_ += 1
    return out


def pack_documents(documents: DataFrame, slots: DataFrame, params: PackParams = PackParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places every text in containers of every size: ``slot_id``, ``container``, ``doc_id``, ``part``, ``first_token``, ``tokens``, ``loss_tokens``.

    A text above the capacity, and no other, is split: into parts that fill a container each, and a rest. Sizes are counted once for all container sizes. Items are
    packed in groups of about ``group_rows``, so no task holds more whatever the corpus; containers that stay emptier than ``well_filled`` are opened and their
    items packed again with those of other groups, until one group is left of them or a round leaves over nine tenths of them; then all stay as they are.

    Defined cases: null, blank-only and empty texts with no tokens are left out, as are null ids; a repeated row counts once; a container size below one is left
    out; no documents or no sizes give no rows. Frontmatter bears no loss. A text whose loss alone is above the limit has a container of its own.
    """
    sizes = slots.select("slot_id", "capacity_tokens").where("slot_id is not null and capacity_tokens > 0").distinct().limit(params.slots + 1).collect()
    if len(sizes) > params.slots:
        raise ValueError(f"more than {params.slots} container sizes")
    spark, kind = documents.sparkSession, documents.schema[doc_id].dataType.simpleString()
    slot_type = slots.schema["slot_id"].dataType.simpleString()
    if not sizes:
        return spark.createDataFrame([], f"slot_id {slot_type}, container string, doc_id {kind}, part int, first_token bigint, tokens bigint, loss_tokens bigint")
    limits = {(s.slot_id): (int(s.capacity_tokens), max(1, int(s.capacity_tokens) // params.tokens_per_segment), max(1, int(s.capacity_tokens * params.loss_share))) for s in sizes}
    measured = materialize(token_sizes(documents, doc_id, text, params), "token-sizes")
    every = F.explode(F.array(*(F.struct(F.lit(k).cast(slot_type).alias("slot_id"), F.lit(c).cast("bigint").alias("most")) for k, (c, _, _) in limits.items())))
    parts = measured.select("*", every.alias("s")).select("doc_id", "tokens", "masked", "s.slot_id", "s.most")
    cut = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("most")).cast("int")))).withColumn("first_token", F.col("part") * F.col("most"))
    size = F.least(F.col("most"), F.col("tokens") - F.col("first_token"))
    loss = F.greatest(F.lit(0), F.least(size, F.col("tokens") - F.greatest("first_token", "masked")))
    items = cut.select("slot_id", "doc_id", "part", "first_token", size.alias("size"), loss.cast("bigint").alias("loss_tokens"), "most")
    full = items.where(F.col("size") == F.col("most"))
    name = lambda *x: F.concat_ws("-", *x)
    done = full.select("slot_id", name(F.lit("full"), F.col("doc_id").cast("string"), F.col("part").cast("string")).alias("container"), "doc_id", "part", "first_token", "size", "loss_tokens")
    rest = items.where(F.col("size") < F.col("most")).drop("most")
    out_type = f"slot_id {slot_type}, container string, doc_id {kind}, part int, first_token bigint, size bigint, loss_tokens bigint, again boolean"

    def filler(label: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda frame: fill(frame, label)

    def fill(frame: pd.DataFrame, label: str) -> pd.DataFrame:
        capacity, segments, loss_limit = limits[frame["slot_id"].iloc[0]]
        frame = frame.sort_values(["doc_id", "part"], kind="stable")
        size = frame["size"].to_numpy()
        bins = pack(size, frame["loss_tokens"].to_numpy(), capacity, segments, loss_limit)
        filled = np.bincount(bins, size)
        group = frame["group"].iloc[0]
        return pd.DataFrame({
            "slot_id": frame["slot_id"], "container": [f"{label}-{group}-{b}" for b in bins], "doc_id": frame["doc_id"], "part": frame["part"], "first_token": frame["first_token"],
            "size": size, "loss_tokens": frame["loss_tokens"], "again": filled[bins] < params.well_filled * capacity,
        })

    before, round_ = None, -1
    while True:
        round_ += 1
        counts = {r.slot_id: r.n for r in rest.groupBy("slot_id").agg(F.count("*").alias("n")).collect()}
        n = max(counts.values(), default=0)
        if not n:
            break
        groups = max(1, math.ceil(n / params.group_rows))
        grouped = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "part", F.lit(round_)), F.lit(groups)))
        packed = grouped.repartition(min(max(12, len(sizes) * groups), params.tasks), "slot_id", "group").groupBy("slot_id", "group").applyInPandas(filler(f"r{round_}"), out_type)
        packed = materialize(packed, "packed")
        last = groups == 1 or (before is not None and n > 0.9 * before)
        done = done.unionByName((packed if last else packed.where(~F.col("again"))).drop("again"))
        if last:
            break
        before, rest = n, packed.where("again").drop("again", "container")
    return done.withColumnRenamed("size", "tokens")


def fill_report(packed: DataFrame, slots: DataFrame) -> DataFrame:
    """Per container size: containers, tokens, the share of space filled, and the fewest containers that any packing needs."""
    capacity = slots.select("slot_id", F.col("capacity_tokens").alias("capacity")).distinct()
    total = packed.groupBy("slot_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).join(capacity, "slot_id")
    return total.select("slot_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"), F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"))


def limit_report(packed: DataFrame, slots: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Per container size: containers, and how many of them are full by each limit: ``by_tokens`` (``well_filled``), ``by_segments``, ``by_loss`` (``well_filled``)."""
    capacity = slots.select("slot_id", F.col("capacity_tokens").alias("capacity")).distinct()
    per = packed.groupBy("slot_id", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss")).join(F.broadcast(capacity), "slot_id")
    segments, loss = F.greatest(F.lit(1), F.floor(F.col("capacity") / params.tokens_per_segment)), F.greatest(F.lit(1), F.floor(F.col("capacity") * params.loss_share))
    n = lambda c, name: F.count_if(c).alias(name)
    return per.groupBy("slot_id").agg(
        F.count("*").alias("containers"), n(F.col("tokens") >= params.well_filled * F.col("capacity"), "by_tokens"), n(F.col("segments") >= segments, "by_segments"), n(F.col("loss") >= params.well_filled * loss, "by_loss")
    )


def invariants(packed: DataFrame, slots: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Per container size what must hold of any packing: ``documents`` placed, and how often a rule is broken, which should be never.

    ``overfull`` containers have more tokens than their capacity, ``crowded`` ones more segments than allowed, ``torn`` documents were split though they fit, and ``gappy``
    ones have parts that do not follow each other without a gap.
    """
    capacity = slots.select("slot_id", F.col("capacity_tokens").alias("capacity")).distinct()
    size = lambda df: df.join(F.broadcast(capacity), "slot_id")
    boxes = size(packed.groupBy("slot_id", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    texts = size(packed.groupBy("slot_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.max(F.col("first_token") + F.col("tokens")).alias("end")))
    n = lambda c, name: F.count_if(c).alias(name)
    per_box = boxes.groupBy("slot_id").agg(n(F.col("tokens") > F.col("capacity"), "overfull"), n(F.col("n") > F.greatest(F.lit(1), F.floor(F.col("capacity") / params.tokens_per_segment)), "crowded"))
    per_text = texts.groupBy("slot_id").agg(F.count("*").alias("documents"), n((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity")), "torn"), n(F.col("end") != F.col("tokens"), "gappy"))
    return per_text.join(per_box, "slot_id").select("slot_id", "documents", "overfull", "crowded", "torn", "gappy")
