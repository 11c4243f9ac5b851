from inkwell import schemas
from inkwell.operators import reconcile as R

NOTE = schemas.PARSED


def notes(spark, *rows):
    full = [(p, p.upper(), "c", "", h, "2026", "2026", 1, tags, links, sup, "body") for p, h, tags, links, sup in rows]
    return spark.createDataFrame(full, NOTE)


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_resolution_rules(spark):
    df = notes(spark, ("a/x.md", "1", [], ["y", "b/x", "x", "zz/y", "Y.md", "a/x", "/B/Y.md/", None], []), ("b/x.md", "2", [], [], []), ("b/y.md", "3", None, None, None))
    got = sorted((r.src, r.raw, r.dst) for r in R.resolve_links(df).collect() if r.dst) + sorted((r.src, r.raw, r.dst) for r in R.resolve_links(df).collect() if not r.dst)
    assert got == [("a/x.md", "/B/Y.md/", "b/y.md"), ("a/x.md", "b/x", "b/x.md"), ("a/x.md", "x", None)]


def test_state_and_pruning(spark):
    first = R.structural_state(notes(spark, ("a.md", "1", ["t", "t", "u"], ["gone", "Gone", "b"], ["b.md", "none.md"]), ("b.md", "2", [], [], [])))
    assert pairs(first["links_to"], "src", "dst") == [("a.md", "b.md"), ("a.md", "unresolved:Gone"), ("a.md", "unresolved:gone")]
    assert pairs(first["supersedes"], "src", "dst") == [("a.md", "b.md")]
    assert pairs(first["tagged"], "path", "tag") == [("a.md", "t"), ("a.md", "u")]
    assert first["document"].where("stub").count() == 2
    marked = R.marked(first["document"], first["document"].where("path = 'b.md'"), "chunked_hash")
    old = {**first, "document": marked, "chunk": spark.createDataFrame([("a.md#0", "a.md", 0, "x", "", 1, [1.0]), ("b.md#0", "b.md", 0, "x", "", 1, [1.0])], schemas.CHUNK)}
    second = R.structural_state(notes(spark, ("b.md", "2", ["v"], [], [])), old)
    assert pairs(second["document"], "path", "chunked_hash") == [("b.md", "2")]
    assert pairs(second["chunk"], "id") == [("b.md#0",)]
    assert pairs(R.prune_documents(first["document"], second["document"]), "path") == [("a.md",)]
    assert pairs(R.orphan_tags(first["tagged"], second["tagged"]), "tag") == [("t",), ("u",)]
    assert R.orphan_stubs(first["document"], second["links_to"]).count() == 2
    assert R.stale(second["document"], "chunked_hash").count() == 0
    assert R.stale(second["document"], "chunked_hash", force=True).count() == 1
    assert R.stale(second["document"], "extracted_hash").count() == 1


def test_chunks_of_unknown_documents_vanish(spark):
    chunk = lambda *ids: spark.createDataFrame([(f"{p}#0", p, 0, t, "", 1, [1.0]) for p, t in ids], schemas.CHUNK)
    document = R.structural_state(notes(spark, ("a.md", "1", [], [], []), ("b.md", "1", [], [], [])))["document"]
    pending = document.where("path = 'b.md'")
    out = R.replace_chunks(chunk(("a.md", "old"), ("b.md", "old")), chunk(("b.md", "new"), ("x.md", "new")), pending, document)
    assert pairs(out, "doc_path", "text") == [("a.md", "old"), ("b.md", "new")]


def test_report_text():
    text = R.Report("s", {"n": 1}, [str(i) for i in range(20)]).render()
    assert "n: 1" in text and "5 more" in text


def test_duplicates(spark):
    df = spark.createDataFrame([("a", "k", 1), ("a", "k", 2), ("b", "k", None)], schemas.MENTIONS)
    assert pairs(R.duplicate_keys(df, ["path", "key"]), "path", "rows") == [("a", 2)]
