import random

import numpy as np
import pytest

from inkwell.llm.packing import PackParams, encoder, fill_report, invariants, limit_report, pack, pack_documents

VOCABULARY = PackParams().vocabulary
needs_vocabulary = pytest.mark.skipif(not __import__("os").path.exists(VOCABULARY), reason="no vocabulary")


@pytest.mark.parametrize("seed", range(5))
def test_limits_hold(seed):
    rnd = random.Random(seed)
    t = np.array([rnd.randint(1, 100) for _ in range(500)])
    loss = np.array([rnd.randint(0, x) for x in t])
    bins = pack(t, loss, 100, 6, 70)
    assert (bins >= 0).all() and np.bincount(bins, t).max() <= 100 and np.bincount(bins).max() <= 6
    over = np.flatnonzero(np.bincount(bins, loss) > 70)
    assert all((bins == b).sum() == 1 for b in over)


def test_fill_and_ties():
    t = np.array([60, 40, 50, 50, 100, 30, 30, 40])
    bins = pack(t, t, 100, 8, 100)
    assert np.bincount(bins, t).max() <= 100 and bins.max() + 1 == 4
    assert pack(np.array([], int), np.array([], int), 5, 1, 5).tolist() == []
    assert len(set(pack(np.ones(10, int), np.ones(10, int), 100, 2, 100))) == 5


@needs_vocabulary
def test_documents(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma,", "delta.", "üß"]) for _ in range(rnd.randint(1, 90))) for _ in range(200)]
    texts += ["---\ntitle: x\n---\nbody text", "word " * 3000, "", " ", None]
    rows = [(i, t, "en", 0) for i, t in enumerate(texts)] + [(0, texts[0], "en", 0), (None, "x", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part string, container int")
    slots = spark.createDataFrame([(1, "short", 64), (2, "long", 512), (3, "bad", 0), (None, "bad", 5), (1, "short", 64)], "slot_id int, slot_name string, capacity_tokens int")
    packed = pack_documents(docs, slots, PackParams(group_rows=50)).collect()
    encode = encoder(VOCABULARY).encode_ordinary
    for slot, capacity in ((1, 64), (2, 512)):
        own = [r for r in packed if r.slot_id == slot]
        per, used, segments = {}, {}, {}
        for r in own:
            per.setdefault(r.doc_id, []).append(r)
            used[r.container] = used.get(r.container, 0) + r.tokens
            segments[r.container] = segments.get(r.container, 0) + 1
        assert max(used.values()) <= capacity and max(segments.values()) <= capacity // 8
        for i, t in enumerate(texts):
            n = len(encode(t)) if t else 0
            if i == 200:
                n = sum(r.tokens for r in per[i])
                assert sum(r.loss_tokens for r in per[i]) < n
            assert sum(r.tokens for r in per.get(i, [])) == n
            assert len(per.get(i, [])) == -(-n // capacity)
        assert sum(used.values()) / (len(used) * capacity) > 0.95
    report = fill_report(pack_documents(docs, slots), slots).collect()
    assert {r.slot_id for r in report} == {1, 2} and all(r.containers >= r.fewest for r in report)
    assert pack_documents(docs.limit(0), slots).count() == 0 and pack_documents(docs, slots.limit(0)).count() == 0


@needs_vocabulary
def test_no_text_is_lost_or_split_by_other_limits(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma " * (1 + i % 15)) for i in range(300)], "doc_id bigint, text string")
    slots = spark.createDataFrame([(1, 64)], "slot_id int, capacity_tokens int")
    params = PackParams(group_rows=10, tokens_per_segment=16, loss_share=0.6)
    packed = pack_documents(docs, slots, params)
    rows = packed.collect()
    assert sorted(r.doc_id for r in rows) == list(range(300)) and all(r.part == 0 for r in rows)
    report = limit_report(packed, slots, params).first()
    assert report.by_segments > 0 and report.by_loss > 0
    assert tuple(invariants(packed, slots, params).first()) == (1, 300, 0, 0, 0, 0)
