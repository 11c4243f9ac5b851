import json
import math
import random

from inkwell import schemas
from inkwell.operators import entities as E
from inkwell.sources.providers import extraction_prompts


def reply(ents, rels=()):
    return json.dumps({"entities": [dict(zip(("name", "type", "aliases"), e)) for e in ents], "relations": [dict(zip(("source", "target", "type", "confidence"), r)) for r in rels]})


def test_windows_merge_and_cap(spark):
    raw = spark.createDataFrame(
        [("p", 0, reply([("Big Thing", "TOOL", ["bt"]), ("Other", "alien", None)], [("Big Thing", "Other", "Uses", "0.7"), ("Big Thing", "Ghost", "uses", 1)])),
         ("p", 1, "```json\n" + reply([("big thing", "person", ["BT", ""]), ("???", "tool", [])], [("big-thing", "other", "eats", None), ("Other", "other", "uses", 1)]) + "\n```"),
         ("q", 0, "no json"), ("r", 0, None)],
        "path string, window int, raw string",
    )
    replies = E.parsed_replies(raw)
    found = {r.key: r for r in E.document_entities(replies).collect()}
    assert set(found) == {"big-thing", "other"}
    big = found["big-thing"]
    assert (big.name, big.type, big["count"], big.aliases) == ("Big Thing", "tool", 2, ["BT", "bt"]) and found["other"].type == "concept"
    rels = sorted((r.source, r.type, r.target, r.confidence) for r in E.document_relations(replies, E.document_entities(replies)).collect())
    assert rels == [("big-thing", "related_to", "other", 0.5), ("big-thing", "uses", "other", 0.7)]
    assert [r.key for r in E.document_entities(replies, cap=1).collect()] == ["big-thing"]


def test_upserts(spark):
    rows = spark.createDataFrame([("k", "old", "tool", ["a"], [1.0], 0), ("k", "new", "person", ["b", None], [2.0], 1), ("k", "x", "person", None, None, 2)], schemas.ENTITY + ", seq int")
    r = E.upsert_entities(rows).first()
    assert (r.name, r.type, r.aliases, r.embedding) == ("old", "tool", ["a", "b"], [2.0])
    rel = spark.createDataFrame([("a", "b", "uses", 0.9, "p", 0), ("a", "b", "uses", 0.1, "q", 1), ("b", "a", "uses", None, "q", 1)], schemas.RELATES_TO + ", seq int")
    assert sorted((x.source, x.confidence, x.source_path) for x in E.upsert_relations(rel).collect()) == [("a", 0.9, "q"), ("b", None, "q")]
    men = spark.createDataFrame([("p", "k", 1), ("p", "k", None), ("p", "k", 2)], schemas.MENTIONS)
    assert E.upsert_mentions(men).first()["count"] == 3


def test_greedy_dedup_follows_order(spark):
    v = lambda a, b: [float(a), float(b)]
    stored = spark.createDataFrame([("s", "S", "tool", [], v(1, 0))], schemas.ENTITY)
    rows = [(1, "p", "t1", "tool", v(1, 0.1)), (1, "p", "t2", "tool", v(1, 0.05)), (1, "p", "other", "person", v(1, 0)), (2, "q", "n", "tool", v(0, 1)), (3, "r", "m", "tool", v(0.1, 1)), (3, "r", "bad", "tool", None), (3, "r", "zero", "tool", v(0, 0))]
    mentioned = spark.createDataFrame(rows, "seq int, path string, key string, type string, embedding array<float>")
    got = {r.key: r.resolved for r in E.greedy_dedup(mentioned, stored, 0.95, dims=2).collect()}
    assert got == {"t1": "s", "t2": "s", "other": "other", "n": "n", "m": "n", "bad": "bad", "zero": "zero"}
    assert E.greedy_dedup(mentioned.limit(0), stored, dims=2).count() == 0


def test_greedy_dedup_keeps_ties_and_streams(spark):
    """Of equally near entities the five with the smallest keys count, whatever order they are stored in; the fold holds no table of vectors."""
    stored = spark.createDataFrame([(f"k{i}", "person" if i else "tool", [1.0, 0.0]) for i in reversed(range(10))], "key string, type string, embedding array<float>")
    mentioned = spark.createDataFrame([(1, "p", "new", "tool", [1.0, 0.0])], "seq int, path string, key string, type string, embedding array<float>")
    got = E.greedy_dedup(mentioned, stored, dims=2)
    assert [r.resolved for r in got.collect()] == ["k0"]
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]


def test_greedy_dedup_matches_a_plain_fold(spark):
    rnd = random.Random(3)
    vector = lambda: [round(rnd.gauss(0, 1), 3) for _ in range(3)] if rnd.random() < 0.9 else rnd.choice([None, [0.0, 0.0, 0.0], [1.0]])
    stored = [(f"s{i:02d}", rnd.choice("ab"), vector()) for i in range(30)]
    rows = [(d, f"p{d}", k, rnd.choice("ab"), vector()) for d in range(40) for k in sorted(rnd.sample([f"s{i:02d}" for i in range(5)] + [f"n{i:02d}" for i in range(60)], 4))]
    state, want = {k: [t, v] for k, t, v in stored}, {}
    good = lambda v: v is not None and len(v) == 3 and any(v)
    score = lambda v, w: (1 + sum(x * y for x, y in zip(v, w)) / math.hypot(*v) / math.hypot(*w)) / 2
    for d in range(40):
        writes = []
        for _, _, k, t, v in (r for r in rows if r[0] == d):
            top = sorted((-score(v, w), o) for o, (_, w) in state.items() if good(v) and good(w))[:5]
            want[d, k] = next((o for s, o in top if -s >= 0.92 and state[o][0] == t), k)
            writes.append((want[d, k], t, v))
        for k, t, v in writes:
            old = state.setdefault(k, [t, None])
            old[1] = v if good(v) else old[1]
    frames = spark.createDataFrame(rows, "seq int, path string, key string, type string, embedding array<double>"), spark.createDataFrame(stored, "key string, type string, embedding array<double>")
    for block in (20_000, 7):
        assert {(r.seq, r.key): r.resolved for r in E.greedy_dedup(*frames, dims=3, block=block).collect()} == want
    assert any(k != o for (_, k), o in want.items())


def test_top_five_are_cut_before_the_type(spark):
    near = [(f"p{i}", f"p{i}", "person", [], [1.0, 0.01 * i]) for i in range(5)]
    stored = spark.createDataFrame([*near, ("t", "t", "tool", [], [1.0, 0.2])], schemas.ENTITY)
    probe = spark.createDataFrame([(1, "tool", [1.0, 0.0]), (2, "tool", None)], "probe int, type string, embedding array<float>")
    assert E.similar_entity(probe, stored, dims=2).count() == 0
    assert E.similar_entity(probe, stored, dims=2, type_first=True).first().key == "t"


def test_remap_drops_loops(spark):
    rel = spark.createDataFrame([("p", "a", "uses", "b", 1.0), ("p", "a", "uses", "c", 1.0), ("p", "a", "uses", "none", 1.0)], "path string, source string, type string, target string, confidence double")
    to = spark.createDataFrame([("p", "a", "x"), ("p", "b", "x"), ("p", "c", "c")], "path string, key string, resolved string")
    assert [tuple(r) for r in E.remap_relations(rel, to).collect()] == [("p", "x", "uses", "c", 1.0)]


def test_extraction_windows(spark):
    df = spark.createDataFrame([("p", "T", "a  b"), ("q", None, " "), ("r", "R", "w " * 7)], "path string, title string, body string")
    rows = {(r.path, r.window): r.prompt for r in extraction_prompts(df, 3).collect()}
    assert set(rows) == {("p", 0), ("r", 0), ("r", 1), ("r", 2)} and rows["p", 0].endswith("a  b")


def test_checked_replies(spark):
    from inkwell.operators.entities import checked_replies

    ok = ['{"entities": []}', "{}", '{"entities": null, "relations": []}', 'so:\n```json\n{"entities": [{"name": "x"}]}\n```']
    bad = ['{"entities": [{"name": "x"}, {"na', '{"entities": [{"name": "x"}], "relations": [{"source": "x"}, {"sou', '{"entities": "x"}', "none found", "", None]
    rows = [("p", n, raw, None) for n, raw in enumerate(ok + bad)] + [("p", 99, None, "down")]
    got = {r.window: r.error for r in checked_replies(spark.createDataFrame(rows, "path string, window int, raw string, error string")).collect()}
    assert [n for n in range(len(ok + bad)) if got[n] is None] == list(range(len(ok))) and got[99] == "down"
