import math
import random
from collections import Counter

import pytest

from inkwell.llm.names import NameParams, Usage, _clusters, average_linkage, components, contradict, edits, grams, name_pairs, same_entities, same_pairs, unmatched, word_usage

SAME = [("DI (Denseguto)", "Denseguto Institute"), ("Gukagelo L. (S.A.)", "Gukagelo Laboratories S.A."), ("Darirecor Fdn", "Darirecor Foundation B.V."), ("Alexander Denfo nopu", "Alexander Denfonopu"), ("X.A. Geguzuulor", "Xenia Geguzulor"), ("Böduhode, J.", "Jonathan Boduhode"), ("Kai Lund", "Lund, Kai"), ("Anna Roth", "Ana Roth"), ("A. Roth", "Anna Roth"), ("Lotha Remo", "Lothar Remo")]
APART = [("Aiko Falkudufen", "Chidi Falkudufen"), ("A. Falkudufen", "Chidi Falkudufen"), ("BR (Bensutosol)", "Bensutosol Technologies"), ("Fengitefo Manufacturing GmbH", "Fengitefo Publishing GmbH"), ("Francisco L. Garhisolle", "Lucia Garhisolle"), ("Alexander Guhanude", "Alexander Hulorotu"), ("", "x"), ("???", "!!!"), ("Kai Lund", "Kai Berg"), ("Kim Lee", "Tim Lee")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert not contradict(a, b) and not contradict(b, a)


@pytest.mark.parametrize("a, b", APART)
def test_apart(a, b):
    assert contradict(a, b) and contradict(b, a)


def test_learned_words():
    usage = Usage(frozenset({"gmbh", "ltd"}), frozenset({("bob", "robert")}))
    assert contradict("Remo Lights GmbH", "Remo Lights Ltd") and not contradict("Remo Lights GmbH", "Remo Lights Ltd", usage)
    assert contradict("Bob Lund", "Robert Lund") and not contradict("Robert Lund", "Bob Lund", usage)
    assert unmatched("Remo lights", "Lights of Remo") == ((), ("of",), ("remo", "lights"), 2, (False, False))


def test_usage(spark):
    """Short forms and words of no weight come from how names are used; members of a family are no short forms of each other."""
    rnd, rows = random.Random(4), []
    given = "anna bruno carla dario elsa franz gerda hanno".split()
    for k in range(400):
        root = "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4))
        one = rnd.choice(given)
        rows += [(f"{one} {root}",), (f"{'nono' if one == 'bruno' else rnd.choice(given)} {root}",), (f"doc {one} {root}",)]
    usage = word_usage(name_pairs(spark.createDataFrame(rows, "name string").distinct()))
    assert usage.variants == {("bruno", "nono")} and "doc" in usage.light and not usage.light & {*given}


def test_variants_among_many_chance_pairs(spark):
    """Names that are near by chance grow faster than the table; what they differ in must not crowd out what is learned."""
    pairs = [(f"r{k}", ["bob"], ["robert"]) for k in range(8)] + [(f"r{k}", ["dr"], []) for k in range(8)] + [(f"c{k}", [f"x{k}"], [f"y{k}"]) for k in range(3000)]
    usage = word_usage(spark.createDataFrame(pairs, "root string, left_a array<string>, left_b array<string>"), NameParams(learned=100))
    assert usage == Usage(frozenset({"dr"}), frozenset({("bob", "robert")}))


def test_a_larger_table_hides_no_typo(spark):
    """The n-grams of names grow with the table, those of a typo do not and must not outweigh them."""
    def cosine(total):
        rnd, one = random.Random(7), ("wanda tolibano", "wanda tolibanu")
        word = lambda: "".join(rnd.choice("cjqwxy") + rnd.choice("aeiou") for _ in range(5))
        names = {*one} | {f"{word()} {w}" for k in range(total // 500) for w in ("tolibano", "wanda")} | {word() for _ in range(total)}
        return next((r.cosine for r in name_pairs(spark.createDataFrame([(n,) for n in sorted(names)], "name string"), NameParams(rare=1)).where("a like 'wanda tol%' and b like 'wanda tol%'").collect()), 0)

    small, large = cosine(1500), cosine(15_000)
    assert small > 0.35 and large > small - 0.05


def test_edits():
    assert [edits("abcd", x) for x in ("abcd", "abdc", "abd", "abxcd", "dcba")] == [0, 1, 1, 1, 3]


def test_average_linkage():
    edges = [("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.2), ("d", "e", 0.4)]
    groups = average_linkage(list("abcde"), edges, 0.5)
    assert groups["a"] == groups["b"] == groups["c"] and groups["d"] != groups["e"]
    groups = average_linkage(list("abc"), [("a", "b", 0.9), ("b", "c", 0.9)], 0.5)
    assert len(set(groups.values())) == 2


@pytest.mark.parametrize("nodes", [500, 20_000])
def test_components_of_a_shuffled_chain(spark, nodes):
    names = [f"{i:05d}" for i in range(nodes)]
    random.Random(1).shuffle(names)
    got = components(spark.createDataFrame(list(zip(names, names[1:])), "a string, b string"))
    assert [(r.component, r.n) for r in got.groupBy("component").count().withColumnRenamed("count", "n").collect()] == [("00000", nodes)]


def test_components(spark):
    rows = [("hub", f"s{i:04d}") for i in range(3000)] + [(f"x{i}", f"y{i}") for i in range(1000)] + [("y0", "x0"), ("q", "q"), ("z", None), ("c1", "c2"), ("c2", "c3"), ("c3", "c1")]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert {got[f"s{i:04d}"] for i in range(3000)} == {"hub"} and all(got[f"y{i}"] == got[f"x{i}"] == f"x{i}" for i in range(1000))
    assert got["q"] == "q" and got["c3"] == "c1" and "z" not in got and len(got) == 3001 + 2000 + 1 + 3
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("block", [1000, 3])
def test_pairs_match_brute_force(spark, block):
    params = NameParams(cosine=0.5, block=block)
    names = [f"{a} {b}" for a in ("Anna", "Bernd") for b in ("Kolibano", "Kolibana", "Talomidu", "Talomidu X", "Zer")] + ["x" * 900 + "abcd", "abcd" + "x" * 900, "".join(map(chr, range(97, 123))) * 40]
    df_ = Counter(g for n in names for g in grams(n))
    vec = {n: {g: math.log(1.5 + len(names) / max(params.rare, df_[g])) ** params.sharpness for g in grams(n)} for n in names}
    cos = lambda a, b: sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) / math.sqrt(sum(w * w for w in vec[a].values()) * sum(w * w for w in vec[b].values()))
    want = {(a, b): cos(a, b) for a in names for b in names if a < b and cos(a, b) >= 0.5}
    rows = name_pairs(spark.createDataFrame([(n,) for n in names], "name string"), params).collect()
    assert sorted((r.a, r.b) for r in rows) == sorted(want) and want
    assert all(abs(r.cosine - want[r.a, r.b]) < 1e-5 for r in rows)


def test_entities(spark):
    rows = [("k1", "Charles Fagilosu", None, 1), ("k1", "Charles Fagilosu", [], 1), ("k2", "Charles Fagliosu", [], 1), ("k3", None, ["fagilosu_c", None, ""], 1), ("k4", "Edith Fagilosu", [], 1), ("k5", " ", None, 1), (None, "Charles Fagilosu", None, 1), ("k6", "123", [], 1), ("k7", "y" * 3000, [], 1), ("k8", "charles FAGILOSU", None, 1)]
    df = spark.createDataFrame(rows, "key string, name string, aliases array<string>, cluster int")
    got = {(r.key_a, r.key_b) for r in same_pairs(same_entities(df)).collect()}
    assert got == {(a, b) for a in ("k1", "k2", "k3", "k8") for b in ("k1", "k2", "k3", "k8") if a < b}
    assert same_entities(df.limit(0)).count() == 0


def test_large_components_lose_nothing(spark):
    """Groups above the bound of one task give what they give below it: weak pairs, edges between parts and ties included."""
    rnd = random.Random(5)
    rows = [(f"k{i:02d}", f"k{j:02d}", rnd.choice((0.3, 0.5625, 0.8, 0.8, 0.9, 1.0))) for i in range(60) for j in range(i + 1, 60) if rnd.random() < (0.8 if i % 6 == j % 6 else 0.08)]
    rows += [(f"m{i:02d}", f"m{j:02d}", 0.9) for i in range(12) for j in range(i + 1, 12)] + [("m00", "z0", 0.5625), ("z0", "z1", 0.5625)]
    edges = spark.createDataFrame(rows, "a string, b string, s double")
    got = [{(r.key, r.cluster) for r in _clusters(edges, NameParams(component=n, linkage=0.5)).collect()} for n in (2000, 3)]
    want = average_linkage(sorted({n for r in rows for n in r[:2]}), rows, 0.5)
    many = {c for c in want.values() if list(want.values()).count(c) > 1}
    assert got[0] == got[1] == {(k, c) for k, c in want.items() if c in many}
    assert {k for k, c in want.items() if c == want["z1"]} == {"z0", "z1"}


def test_exact_alias_overrules_names(spark):
    rows = [("k1", "Kai Lundberg", ["Nils Lundberg"]), ("k2", "Nils Lundberg", []), ("k3", "Lundberg, Kai", []), ("k4", "Anna Rothmann", ["Rothmann"]), ("k5", "Kurt Rothmann", ["Rothmann"])]
    edges = same_pairs(same_entities(spark.createDataFrame(rows, "key string, name string, aliases array<string>")))
    got = {(r.key_a, r.key_b) for r in edges.collect()}
    assert {("k1", "k2"), ("k1", "k3")} <= got and ("k4", "k5") not in got
