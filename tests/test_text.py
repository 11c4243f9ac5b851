import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions import vectors as V
from inkwell.sources.corpus import front_entries


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("text", ["one two", " 　a\x1cb\x85c\xa0d\n\te ", "", None, "x" * 20000])
def test_words_split_like_python(spark, text):
    assert value(spark, T.words("t"), t=text) == (text or "").split()
    assert value(spark, T.word_count("t"), t=text) == len((text or "").split())


@pytest.mark.parametrize(
    "body, links",
    [
        ("[[a]] [[b|alias]] [[c#part]] [[a]] ![[pic.png]] [[#here]]", ["a", "b", "c"]),
        ("`[[no]]` [[yes]]\n```\n[[no]]\n```\n[[2077 x]]", ["yes", "2077 x"]),
        ("~~~~py\n[[no]]\n```\n~~~\n[[yes]]", ["yes"]),
        ("```\nnever closed [[no]]", []),
        ("grep [[:space:]] [[*]] [[123]]", []),
        ("", []),
    ],
)
def test_wikilinks(spark, body, links):
    assert value(spark, T.wikilinks("b"), b=body) == links


def test_frontmatter(spark):
    block = "title: 'A b'\n# note\ntags: [x, \"y\" , ]\n  inner: 1\nlist:\n  - p\n  - 'q'\nempty:\ntitle: last\n"
    assert front_entries(block) == [("title", "last", None), ("tags", None, ["x", "y"]), ("list", None, ["p", "q"]), ("empty", None, [])]
    assert front_entries(None) == []
    text = "---\na: 1\n---\nbody\n---\n"
    assert value(spark, T.frontmatter_block("t"), t=text) == "a: 1"
    assert value(spark, T.body_of("t"), t=text) == "body\n---\n"
    assert value(spark, T.body_of("t"), t="no fences") == "no fences"


def test_titles(spark):
    none = F.lit(None).cast("string")
    of = lambda front, body, synced, path: value(spark, T.title(F.lit(front).cast("string"), F.col("b"), F.lit(synced).cast("string"), F.lit(path)), b=body)
    assert of("Given", "# Other", None, "x.md") == "Given"
    assert of(None, "# Top one\ntext", None, "x.md") == "Top one"
    assert of(None, "# SKILL.md\n", "/opt/skills/web-research/SKILL.md", "a/x.md") == "web research"
    assert of(" ", "```\n# code\n```", None, "a/my_file-name.md") == "my file name"
    assert none is not None


def test_slugs_tags_paths(spark):
    assert value(spark, T.entity_slug("n"), n=" Ünder Score_1! ") == "nder-score-1"
    assert value(spark, T.entity_slug("n"), n="***") == ""
    assert value(spark, T.normal_tag("n"), n=" ##A b# ") == "a b"
    assert value(spark, T.tag_list(F.lit(None).cast("array<string>"), F.col("n")), n="#A, b\tA") == ["a", "b"]
    assert value(spark, T.stub_title("n"), n="a/some-note.md") == "some note"
    assert [value(spark, T.category("p"), p=p) for p in ("x.md", "a/x.md", "a/b/x.md")] == ["(root)", "a", "a"]
    assert [value(spark, T.subcategory("p"), p=p) for p in ("x.md", "a/x.md", "a/b/x.md")] == ["", "", "b"]


@pytest.mark.parametrize("n, size, overlap", [(0, 5, 2), (5, 5, 2), (6, 5, 2), (7, 5, 2), (30, 5, 2), (9, 3, 5), (10, 4, 0)])
def test_windows_match_a_loop(spark, n, size, overlap):
    words, want, at = [f"w{i}" for i in range(n)], [], 0
    while n:
        want.append(" ".join(words[at : at + size]))
        if at + size >= n:
            break
        at += max(1, size - overlap)
    assert value(spark, T.word_windows(T.words("t"), size, overlap), t=" ".join(words)) == want


def test_lenient_json(spark):
    schema = "entities array<struct<name string>>"
    for raw in ('{"entities": [{"name": "x"}]}', 'Sure:\n```json\n{"entities": [{"name": "x"}]}\n```', 'so {"entities": [{"name": "x"}]} it is'):
        assert value(spark, T.lenient_json("r", schema, "entities"), r=raw).entities[0].name == "x"
    for raw in ("no", "", None, '{"other": 1}'):
        assert value(spark, T.lenient_json("r", schema, "entities"), r=raw) is None
    assert [value(spark, T.confidence("c"), c=c) for c in ("0.7", "9", "-1", "much", None)] == [0.7, 1.0, 0.0, 0.5, 0.5]
    assert [value(spark, T.coerced("c", ["uses"], "related_to"), c=c) for c in (" USES", "eats", None)] == ["uses", "related_to", "related_to"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], None), ([1.0], [1.0, None])], "a array<float>, b array<float>")
    assert [r.u for r in df.select(V.usable(F.col("a"), 2).alias("u")).collect()] == [True, False, False]
    assert [r.u for r in df.select(V.usable(F.col("b"), 2).alias("u")).collect()] == [True, False, False]
    assert df.select(V.dot(F.col("a"), F.col("b")).alias("d")).first().d == 4.0
    with pytest.raises(ValueError):
        V.score(F.col("a"), "other")
