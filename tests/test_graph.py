import pytest

from inkwell import schemas
from inkwell.operators import graph as G


@pytest.fixture(scope="module")
def world(spark):
    doc = [(f"d{i}.md", f"D{i}", "c", "", "h", "2025", f"2026-0{i}", 1, False, None, None) for i in range(1, 6)] + [("unresolved:x", "x", "unresolved", None, None, None, None, None, True, None, None)]
    ent = [("a", "A", "tool", ["aye"], None), ("b", "B", "tool", [], None), ("c", "C", "tool", None, None), ("d", "D", "tool", [], None), ("z", "Z", "tool", [], None)]
    rel = [("a", "b", "uses", 1.0, "d1.md"), ("b", "a", "uses", 1.0, "d1.md"), ("c", "b", "part_of", 1.0, "d1.md"), ("c", "d", "uses", 1.0, "d1.md"), ("d", "d", "uses", 1.0, "d1.md")]
    return {
        "document": spark.createDataFrame(doc, schemas.DOCUMENT), "entity": spark.createDataFrame(ent, schemas.ENTITY), "relates_to": spark.createDataFrame(rel, schemas.RELATES_TO),
        "mentions": spark.createDataFrame([(f"d{i}.md", "b", 1) for i in range(1, 6)] + [("d1.md", "a", 2)], schemas.MENTIONS),
        "tagged": spark.createDataFrame([("d1.md", "t"), ("d2.md", "t"), ("d1.md", "u")], schemas.TAGGED), "links_to": spark.createDataFrame([("d1.md", "unresolved:x"), ("d2.md", "d1.md")], schemas.LINKS_TO),
    }


def test_related_entities_use_no_edge_twice(world):
    rows = G.find_related_entities(world["entity"], world["relates_to"], world["mentions"], world["document"], "AYE", 2).collect()
    got = [(r.entity, r.hops, tuple(r.via)) for r in rows]
    assert got == [("B", 1, ("uses",)), ("A", 2, ("uses", "uses")), ("C", 2, ("uses", "part_of"))]
    assert rows[0].documents == ["d1.md", "d2.md", "d3.md", "d4.md"] and rows[2].documents == []
    assert G.find_related_entities(world["entity"], world["relates_to"], world["mentions"], world["document"], "nobody", 9).count() == 0


def test_shortest_path(world):
    of = lambda a, b: G.shortest_path(world["entity"], world["relates_to"], a, b).collect()
    (row,) = of("a", "D")
    assert (row.nodes, row.relations, row.hops) == (["A", "B", "C", "D"], ["uses", "part_of", "uses"], 3)
    assert G.render_path(row) == "A -[uses]- B -[part_of]- C -[uses]- D (3 hops)"
    assert of("a", "z") == of("a", "a") == of("aye", "d") == of("a", "nobody") == []


def test_neighbourhood_and_lists(world):
    w = world
    rows = {r.path: r for r in G.entities_in_documents(w["document"], w["tagged"], w["links_to"], w["mentions"], w["entity"]).collect()}
    assert rows["d1.md"].tags == ["t", "u"] and rows["d1.md"].links_in == ["d2.md"] and rows["d1.md"].entities == ["A (tool)", "B (tool)"]
    assert rows["unresolved:x"].links_in == ["d1.md"] and rows["d5.md"].links_out == []
    assert G.entities_in_documents(w["document"], w["tagged"], w["links_to"], w["mentions"], w["entity"], "none").count() == 0
    assert [r.path for r in G.documents_by_tag(w["document"], w["tagged"], " #T").collect()] == ["d2.md", "d1.md"]
    assert [(r.tag, r.documents) for r in G.list_tags(w["tagged"], 0).collect()] == [("t", 2), ("u", 1)]
    recent = G.recent_related_changes(w["entity"], w["mentions"], w["document"], "b", "2026-03").collect()
    assert [r.path for r in recent] == ["d5.md", "d4.md", "d3.md"]
    assert G.formatted([], ["a"], "none") == "none" and G.formatted([{"a": [1, 2]}], ["a"], "") == "- 1, 2"


def test_overview_and_vectors(spark, world):
    w = world
    rows = [(f"d{i}.md#0", f"d{i}.md", 0, "some words", "S", 2, v) for i, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], None, [0.0, 0.0]], 1)]
    chunk = spark.createDataFrame(rows, schemas.CHUNK)
    over = G.graph_overview(w["document"], chunk, w["tagged"], w["entity"], w["links_to"], w["mentions"], w["relates_to"]).first()
    assert (over.documents, over.stubs, over.chunks, over.embedded_chunks, over.tags, over.relates_to) == (5, 1, 5, 4, 2, 5)
    found = G.semantic_search(chunk, [1.0, 0.0], 2, dims=2).collect()
    assert [(r.path, r.score) for r in found] == [("d1.md", 1.0), ("d2.md", 0.9969)] and found[0].snippet == "some words…"
    assert [r.path for r in G.similar_documents(w["document"], chunk, "d1.md", dims=2).collect()] == ["d2.md", "d3.md"]
    assert G.similar_documents(w["document"], chunk, "d1.md", nearest=1, dims=2).count() == 0
