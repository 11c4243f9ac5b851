from datetime import datetime

import pytest

from inkwell.__main__ import main
from inkwell.config import Settings
from inkwell.engine import Engine
from inkwell.sources import providers
from inkwell.sources.corpus import list_notes
from inkwell.streaming.incremental import current, run_available


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    for path, text in {
        "index.md": "# skip", "a/index.md": "# Kept\n[[b]]", "_under.md": "Red Fox meets Blue Bird.", ".hidden/x.md": "no", "a/b.md": "---\ntags: [X, y]\nsupersedes: a/index.md\n---\n# B\r\nGreen Tree and Red Fox. [[missing one]]", "sp ace.md": b"\xff bytes",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())
    return root


def test_pipeline(spark, vault, tmp_path):
    settings = Settings(corpus=str(vault), store=f"file://{tmp_path}/store", semantic_queries=True)
    assert list_notes(str(vault)) == ["_under.md", "a/b.md", "a/index.md", "sp ace.md"]
    engine = Engine(spark, settings)
    reports = engine.sync_all(semantic=True)
    assert reports[0].counts["documents"] == 4 and reports[0].counts["stubs"] == 1 and reports[0].notes == ["a/b.md -> [[missing one]]"]
    assert reports[1].counts["chunks"] == 4 and reports[2].counts["failed"] == 0 and reports[2].counts["entities"] >= 3
    assert [r.tag for r in engine.list_tags().collect()] == ["x", "y"]
    assert engine.search("Green Tree").first().path == "a/b.md"
    assert engine.entities_in_document("a/b.md").first().entities != []
    assert engine.shortest_path("Red Fox", "Green Tree").first().hops == 1
    assert engine.find_related_entities("red fox").count() >= 2 and engine.recent_related_changes("Red Fox").count() == 2
    assert engine.sync_embeddings().counts["chunks written"] == 0
    assert engine.sync_semantic().counts["pending"] == 0
    (vault / "a/b.md").unlink()
    again = engine.sync_structural()
    assert (again.counts["removed documents"], again.counts["removed stubs"], again.counts["removed tags"]) == (1, 1, 2)
    assert engine.store.read("chunk").where("doc_path = 'a/b.md'").count() == 0
    assert engine.store.read("document", 2).where("path = 'a/b.md'").count() == 1
    assert "documents: 3" in engine.status() and engine.parse_check().counts["notes"] == 3
    engine.clear_semantics()
    assert engine.store.read("entity").count() == 0


def test_failures_are_reported(spark, vault, tmp_path):
    class Broken:
        def extract(self, prompt):
            raise OSError("down")

    engine = Engine(spark, Settings(corpus=str(vault), store=f"file://{tmp_path}/store"), extractor=Broken())
    engine.sync_structural()
    report = engine.sync_semantic(limit=2)
    assert report.counts["failed"] == 2 and report.counts["documents"] == 0 and "down" in report.notes[0]
    assert engine.sync_semantic(max_seconds=0).counts["not reached"] == 4
    with pytest.raises(PermissionError):
        engine.shortest_path("a", "b")
    with pytest.raises(FileNotFoundError):
        list_notes(str(tmp_path / "none"))


def test_settings_and_providers(spark):
    s = Settings.from_env({"INKWELL_CHUNK_WORDS": "10", "INKWELL_SEMANTIC_QUERIES": "Yes", "INKWELL_LLM_URL": " "})
    assert (s.chunk_words, s.semantic_queries, s.llm_url) == (10, True, "")
    assert providers.HashEmbedder(8).embed(["a b", ""])[1] == [0.0] * 8
    with pytest.raises(providers.EmbeddingError):
        providers.checked([[1.0]], 1, 2)
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    assert providers.embedded(df, providers.HashEmbedder(4), "t").count() == 2


def test_command_line(spark, vault, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("INKWELL_CORPUS", str(vault))
    monkeypatch.setenv("INKWELL_STORE", f"file://{tmp_path}/store")
    assert main(["schema"]) == main(["parse-check"]) == main(["status"]) == 0
    assert "notes: 4" in capsys.readouterr().out


def test_stream_keeps_chunks_current(spark, tmp_path):
    source, sink, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    schema = "path string, title string, body string, scanned_at timestamp_ntz"
    days = iter(range(1, 29))  # every delivery is scanned later than those before
    put = lambda *rows: spark.createDataFrame([(*r, datetime(2026, 1, next(days))) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
    put(("a", "A", "one"), ("a", "A", "two"), ("b", "B", None), (None, "x", "y"))
    run = lambda: run_available(spark, source, spark.read.parquet(source).schema, sink, mark)
    run()
    assert {r.path: [c.text for c in r.chunks] for r in current(spark, sink).collect()} == {"a": ["two"], "b": []}
    put(("a", "A", "two"), ("b", "B", "three"))
    run()
    assert {r.path: [c.text for c in r.chunks] for r in current(spark, sink).collect()} == {"a": ["two"], "b": ["three"]}
    assert spark.read.parquet(sink).where("batch = 1").count() == 1


def test_unusable_replies_are_failures(spark, tmp_path):
    """A window without usable JSON keeps the document's old mentions and its mark, and the document is tried again."""
    import json

    class Scripted:
        def __init__(self, second):
            self.second = second

        def extract(self, prompt):
            good = json.dumps({"entities": [{"name": "Red Fox", "type": "concept", "aliases": []}], "relations": []})
            return self.second if "omega" in prompt else good

    (tmp_path / "vault").mkdir()
    (tmp_path / "vault/n.md").write_text("alpha beta gamma omega psi chi")
    settings = Settings(corpus=str(tmp_path / "vault"), store=f"file://{tmp_path}/store")
    run = lambda reply: Engine(spark, settings, extractor=Scripted(reply)).sync_semantic(force=True, extract_words=3)
    Engine(spark, settings).sync_structural()
    for bad in ('{"entities": [{"name": "Blue Bird"}, {"na', "Nothing here.", None):
        report = run(bad)
        assert report.counts["failed"] == 1 and report.counts["documents"] == 0 and "n.md" in report.notes[0]
    store = Engine(spark, settings).store
    assert store.read("document").where("extracted_hash is not null").count() == 0
    assert run('{"entities": [], "relations": []}').counts["documents"] == 1 and store.read("mentions").count() == 1
    run("Nothing here.")
    assert store.read("mentions").count() == 1


def test_cut_off_reply_is_an_error(monkeypatch):
    reply = {"choices": [{"finish_reason": "length", "message": {"content": '{"entities": []}'}}]}
    monkeypatch.setattr(providers, "_post", lambda *a, **k: reply)
    with pytest.raises(ValueError, match="cut off"):
        providers.HttpExtractor("http://x", "m").extract("p")


def test_extractor_gives_instructions_and_negotiates(monkeypatch):
    asked = []

    def endpoint(url, key, payload, timeout):
        asked.append(payload)
        if payload.get("response_format", {}).get("type") == "json_schema":
            raise providers.Refused("no json_schema")
        return {"choices": [{"finish_reason": "stop", "message": {"content": "{}"}}]}

    monkeypatch.setattr(providers, "_post", endpoint)
    extractor = providers.HttpExtractor("http://negotiates", "m")
    assert extractor.extract("note") == extractor.extract("note") == "{}"
    assert [p["response_format"]["type"] for p in asked] == ["json_schema", "json_object", "json_object"]
    system, user = asked[0]["messages"]
    assert system["role"] == "system" and "entities" in system["content"] and "contradicts" in system["content"] and user["content"] == "note"

    def full(*_):
        raise providers.Refused("Context size has been exceeded")

    monkeypatch.setattr(providers, "_post", full)
    with pytest.raises(providers.Refused):
        providers.HttpExtractor("http://full", "m").extract("note")


def test_bad_request_is_not_repeated():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            calls.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(400), self.end_headers()
            self.wfile.write(b"unknown response_format")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with pytest.raises(providers.Refused, match="unknown response_format"):
        providers.HttpExtractor(f"http://127.0.0.1:{server.server_port}", "m", timeout=10).extract("note")
    server.shutdown()
    assert len(calls) == len(providers.FORMATS)


def test_late_deliveries_and_deletions_of_a_stream(spark, tmp_path):
    from inkwell.streaming.incremental import compact, merge_batch

    schema = "path string, title string, body string, scanned_at timestamp_ntz, deleted_at timestamp_ntz"
    day = lambda n: datetime(2026, 1, n)
    sink, state = str(tmp_path / "sink"), lambda where: {r.path: [c.text for c in r.chunks] for r in current(spark, where).collect()}
    batch = lambda n, *rows: merge_batch(spark.createDataFrame(list(rows), schema), n, sink)
    assert state(sink) == {}
    batch(0, ("a", "A", "new", day(9), None), ("b", "B", "stays", day(1), None), ("c", "C", "goes", day(1), None))
    batch(1, ("a", "A", "old", day(2), None), ("c", "C", "goes", day(1), day(5)))
    assert state(sink) == {"a": ["new"], "b": ["stays"]}
    batch(2, ("c", "C", "late", day(3), None), ("b", "B", "again", day(8), None))
    batch(2, ("c", "C", "late", day(3), None), ("b", "B", "again", day(8), None))
    assert state(sink) == {"a": ["new"], "b": ["again"]}
    compact(spark, sink, str(tmp_path / "small"))
    assert state(str(tmp_path / "small")) == state(sink)
    batch(3, ("c", "C", "back", day(11), None))
    assert state(sink) == {"a": ["new"], "b": ["again"], "c": ["back"]}


def test_commit_keeps_its_promises(spark, tmp_path):
    import pytest

    from inkwell.store import DuplicateKeys, Store

    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", "x"), ("b", "x")], "path string, tag string")
    assert store.commit({"tagged": rows}) == 1
    with pytest.raises(DuplicateKeys, match="'a', 'x'"):
        store.commit({"tagged": rows.unionByName(rows.where("path = 'a'"))})
    assert store.versions() == [1] and store.read("tagged").count() == 2


def test_embedding_failures_cost_one_slice(spark, tmp_path):
    from dataclasses import dataclass

    from inkwell.sources.providers import EmbeddingError, HashEmbedder

    @dataclass(frozen=True)
    class Fragile:
        dims: int = 8

        def embed(self, texts):
            if any("broken" in t for t in texts):
                raise EmbeddingError("no")
            return HashEmbedder(self.dims).embed(texts)

    corpus = tmp_path / "notes"
    corpus.mkdir()
    for n in range(12):
        (corpus / f"n{n}.md").write_text("# Title\n" + ("broken" if n == 3 else "words") + f" number {n}")
    engine = Engine(spark, Settings(corpus=str(corpus), store=f"file://{tmp_path}/store", embed_dims=8), embedder=Fragile())
    engine.schema()
    engine.sync_structural()
    report = engine.sync_embeddings(slice_documents=3)
    assert report.counts["failed slices"] == 1 and 0 < report.counts["chunks written"] < 12
    engine.embedder = HashEmbedder(8)
    report = engine.sync_embeddings()
    assert report.counts["failed slices"] == 0 and report.counts["chunks"] == 12


def test_corpus_by_scheme(spark, tmp_path):
    from inkwell.sources.corpus import parse_notes, read_corpus

    (tmp_path / "deep" / ".hidden").mkdir(parents=True)
    for where in ("a.md", "deep/b.md", "index.md", "deep/.hidden/c.md", "deep/d.txt"):
        (tmp_path / where).write_bytes(b"# T\r\ntext \xff")
    got = {r.path: r for r in read_corpus(spark, f"file://{tmp_path}").collect()}
    plain = {r.path: r for r in read_corpus(spark, str(tmp_path)).collect()}
    assert set(got) == set(plain) == {"a.md", "deep/b.md"}
    assert all(got[p].text == plain[p].text and got[p].mtime[:19] == plain[p].mtime[:19] for p in got)
    assert parse_notes(read_corpus(spark, f"file://{tmp_path}")).count() == 2


def test_questions_have_answers_or_say_so(spark, tmp_path, monkeypatch, capsys):
    corpus = tmp_path / "notes"
    (corpus / "sub").mkdir(parents=True)
    (corpus / "a.md").write_text("---\ntags: [lamp]\n---\n# Alpha\nRed Fox saw Blue Owl near [[sub/b]].")
    (corpus / "sub" / "b.md").write_text("# Beta\nBlue Owl met Grey Elk.")
    engine = Engine(spark, Settings(corpus=str(corpus), store=f"file://{tmp_path}/store", semantic_queries=True))
    engine.sync_all(semantic=True)
    assert "a.md" in engine.ask("tag", "#Lamp") and engine.ask("tag", "none") == "No document has the tag none."
    assert "lamp" in engine.ask("tags") and "sub/b.md" in engine.ask("document", "a.md") and "no document" in engine.ask("document", "zzz")
    assert engine.ask("path", "Red Fox", "Grey Elk") == "Red Fox -[related_to]- Blue Owl -[related_to]- Grey Elk (2 hops)"
    assert "leads from Red Fox to Nobody" in engine.ask("path", "Red Fox", "Nobody") and "Blue Owl" in engine.ask("related", "red fox", "1")
    assert "a.md" in engine.ask("search", "Red Fox saw") and "sub/b.md" in engine.ask("similar", "a.md") and "Beta" in engine.ask("recent", "Blue Owl")
    with pytest.raises(ValueError):
        engine.ask("weather")
    monkeypatch.setenv("INKWELL_STORE", f"file://{tmp_path}/store")
    assert main(["ask", "tags"]) == 0 and "lamp" in capsys.readouterr().out
