import random

import numpy as np

from inkwell.llm.leakage import Block, Filter, Keys, LeakParams, _mix, item_keys, leaked_items, runs_of, shared_shingles, windows, words_of

VOCAB = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeio" for c in ("lan", "mer", "tos", "vik")]


def text(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def test_words():
    assert words_of("Émile’s [[soldering-iron]] — “ok”_x\x00") == [b"emile", b"s", b"soldering", b"iron", b"ok", b"x"]
    assert words_of(None) == words_of("  ") == []


def block_of(texts, params=LeakParams()):
    keys, rows = Keys(), []
    for k, t in enumerate(texts):
        n, found, need = item_keys(words_of(t), keys, params)
        rows.append((k, len(words_of(t)), need, found))
    known = Filter(20)
    for r in rows:
        known.add(r[3])
    return Block(rows, params), known, keys


def test_hits_do_not_cross_texts():
    _, known, keys = block_of([text(1, 30)])
    w = text(1, 30).split()
    got = list(shared_shingles([" ".join(w[:10]), " ".join(w[10:20]) + "\x00", "", "none at all"], keys, [3], known))
    assert [len(a) for a, _ in got] == [8, 8, 0, 0] and len(got) == 4
    assert got[0][0].tolist() == list(range(8))


def test_filter_loses_nothing():
    keys = np.random.default_rng(1).integers(0, 2**63 - 1, 5000)
    for bits in (20, 10):
        known = Filter(bits)
        known.add(keys)
        assert len(known.has(keys)) == len(keys)
    known = Filter(20)
    known.add(keys)
    assert len(known.has(np.random.default_rng(2).integers(0, 2**63 - 1, 10_000))) < 100


def test_least_number_of_shingles():
    keys, params = Keys(), LeakParams()
    assert item_keys(words_of(text(1, 60)), keys, params)[2] == 8
    assert item_keys([b"a"] * 60, keys, params)[::2] == (3, 1)
    assert item_keys([b"a", b"b"], keys, params)[::2] == (2, 1)


def test_windows_and_runs():
    assert windows(np.array([0, 1, 2, 50, 90, 91]), 10, 3) == [(0, 2)]
    item, doc = np.arange(20), np.array([*range(8), 99, *range(9, 20)])
    where = {int(k): i for i, k in enumerate(_mix(item, 3))}
    met = [(where[int(k)], j) for j, k in enumerate(_mix(doc, 3)) if int(k) in where]
    assert [(r[0], r[1], r[4]) for r in runs_of([m[0] for m in met], [m[1] for m in met], 3, 3)] == [(0, 20, 19)]


def test_repetitive_texts_stay_cheap():
    import time

    block, known, keys = block_of(["so it goes " * 60, text(1, 50)])
    at, found = next(shared_shingles(["so it goes " * 1000], keys, [3], known))
    began = time.time()
    assert block.cases([at], [found], [[0, 1]]) == [(0, 0)] and time.time() - began < 30


def test_bounds_lose_no_case():
    """What is judged in bulk equals aligning every pair by itself."""
    rnd, params = random.Random(6), LeakParams()
    items = [text(k, rnd.randrange(9, 80)) for k in range(12)]
    block, known, keys = block_of(items)
    docs = []
    for k in range(60):
        w = items[k % 12].split()
        cut = w[rnd.randrange(len(w) // 2) :][: rnd.randrange(5, 60)]
        step = rnd.choice((3, 4, 5, 9, 99))
        docs.append(text(100 + k, rnd.randrange(60)) + " " + " ".join("zzz" if n % step == step - 1 else x for n, x in enumerate(cut)) + " " + " ".join(rnd.sample(w, len(w) // 2)) + " " + text(200 + k, 30))
    shared = list(shared_shingles(docs, keys, [3], known))
    got = set(block.cases([a for a, _ in shared], [k for _, k in shared], [list(range(12))] * len(docs)))
    want = set()
    for d, (at, found) in enumerate(shared):
        for i in range(12):
            own = {int(k): [p for p, q in enumerate(_mix(np.array([keys[x] for x in words_of(items[i])]), 3)) if q == k] for k in found}
            met = [(p, int(j)) for j, k in zip(at, found) for p in own[int(k)]]
            if met and block.is_case(i, np.array([m[0] for m in met]), np.array([m[1] for m in met]), np.ones(len(met), bool)):
                want.add((d, i))
    assert got == want and len(want) > 10


def test_cases(spark):
    item = text(1, 60).split()
    stock = "read the following excerpt from the vault and answer the question below it"
    alter = lambda ws, step: [("zzz" if i % step == step - 1 else w) for i, w in enumerate(ws)]
    docs = {
        1: text(9, 300) + " " + " ".join(item) + " " + text(8, 200), 2: text(7, 100) + " " + " ".join(item[10:40]).upper().replace(" ", "\n") + ".", 3: " ".join(alter(item, 12)),
        4: text(5, 40) + " ".join(item[:12]), 5: stock + " " + text(4, 90), 6: " ".join(w + " " + text(i, 12) for i, w in enumerate(item)), 7: None, 8: "  ", 10: " ".join(alter(item, 4)), 9: " ".join(item[:14]) + text(3, 500) + " ".join(item[30:44]),
    }
    rows = [(k, v, "x") for k, v in docs.items()] + [(1, docs[1], "x"), (None, docs[1], "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(1, " ".join(item), "q"), (1, " ".join(item), "q"), (2, stock + " " + text(2, 50), "q"), (3, None, "q"), (4, "", "q"), (5, "two words", "q")], "item_id bigint, text string, doc_id string")
    got = sorted(map(tuple, leaked_items(d, i).collect()))
    assert got == [(1, 1), (2, 1), (3, 1), (10, 1)]
    small = sorted(map(tuple, leaked_items(d, i, LeakParams(block_words=50)).collect()))
    shuffled = sorted(map(tuple, leaked_items(d, i, LeakParams(broadcast_rows=0, filter_bits=16)).collect()))
    assert small == got == shuffled
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0


def test_chain_is_the_best_of_all_starts():
    from itertools import combinations

    from inkwell.llm.leakage import chained

    assert chained([(0, 12, 0, 12, 12), (20, 42, 370, 392, 22), (50, 72, 400, 422, 22)], 400) == 44

    def brute(runs, stretch):
        fits = lambda c: all(p[0] < q[0] and p[1] <= q[0] + 2 for p, q in zip(c, c[1:])) and all(q[3] - c[0][2] <= stretch for q in c[1:])
        return max(sum(r[4] for r in c) for n in range(1, len(runs) + 1) for c in combinations(sorted(runs, key=lambda r: r[2]), n) if fits(c))

    rnd = random.Random(3)
    for _ in range(300):
        runs = []
        for _ in range(7):
            i, j, n = rnd.randrange(90), rnd.randrange(300), rnd.randrange(5, 25)
            runs.append((i, i + n, j, j + n, n))
        assert chained(runs, 120) == brute(runs, 120)
