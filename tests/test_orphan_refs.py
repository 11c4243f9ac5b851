from datetime import datetime

import pytest

from inkwell.operators.orphan_refs import orphan_note_references, orphan_references, orphan_report
from inkwell.session import salted_join

DAY = lambda n: datetime(2026, 1, n)
NOTES = "path string, stub boolean, links array<string>, supersedes array<string>, scanned_at timestamp_ntz, deleted_at timestamp_ntz, field string, target string"


def orphans(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], NOTES)
    return sorted((r.path, r.field, r.target) for r in orphan_note_references(df).collect())


@pytest.mark.parametrize("match, want", [("simple", [3]), ("partial", [3, 5, 6]), ("full", [2, 3, 4, 5, 6])])
def test_match_semantics(spark, match, want):
    keys = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 7)], "x string, id int")
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, "a", 2), (4, None, 2), (5, None, 9), (6, "z", None), (7, None, None)], "id int, k string, n int")
    for hot in (True, False):
        got = sorted(r.id for r in orphan_references(refs, keys, [("k", "x"), ("n", "id")], match, hot=hot).collect())
        assert got == want


def test_empty_sides_and_repeats(spark):
    keys, refs = spark.createDataFrame([], "k string"), spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert orphan_references(refs, keys, [("k", "k")]).count() == 2
    assert orphan_references(keys, refs, [("k", "k")]).count() == 0


def test_note_references(spark):
    rows = [
        ("a/One.md", None, ["two", "B/TWO.md/", "/b/two", "gone", "dup", "stubby", "late", "a/one", None, ""], ["b/two.md", "B/two.md"], DAY(3), None),
        ("a/One.md", None, ["two"], None, DAY(5), None),
        ("b/two.md", False, None, [], DAY(1), DAY(9)),
        ("c/dup.md", False, [], None, DAY(1), None),
        ("d/Dup.md", False, ["x/two"], None, DAY(9), None),
        ("unresolved:stubby", True, None, None, DAY(1), None),
        ("e/late.md", False, None, None, DAY(4), None),
    ]
    assert orphans(spark, rows) == [
        ("a/One.md", "links", ""), ("a/One.md", "links", "dup"), ("a/One.md", "links", "gone"), ("a/One.md", "links", "late"), ("a/One.md", "links", "stubby"),
        ("a/One.md", "supersedes", "B/two.md"), ("d/Dup.md", "links", "x/two"),
    ]
    report = orphan_report(orphan_note_references(spark.createDataFrame([(*r, "", "") for r in rows], NOTES))).collect()
    assert {(r.field, r.scanned_at.day): r.orphans for r in report} == {("links", 3): 5, ("links", 9): 1, ("supersedes", 3): 1}


def test_empty_table(spark):
    assert orphans(spark, []) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    left = spark.createDataFrame([(k, i) for i in range(300) for k in (["h"] if i % 3 else ["h", None, f"k{i % 7}"])], "k string, i int")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("k1", 3), (None, 4)], "k string, v int")
    want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
    assert sorted(map(tuple, salted_join(left, right, ["k"], how, salts=4, min_rows=50).collect()), key=repr) == want
