import random

from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm.splitting import SplitParams, oversized, pieces, sections, split_oversized

NOTE, CHUNK = "path string, title string, body string, text string, piece int", "doc_path string, ordinal int, text string, breadcrumb string, item string"


def test_sections():
    body = "intro\n# A #\nx\n```\n# not\n~~~\n```\n## B\n#no\n####### no\n# \n~~~~\n# in an open fence"
    got = sections(body, "T")
    assert [(n, c) for n, c, _ in got] == [(0, "T"), (1, "T > A"), (2, "T > A > B"), (3, "T")]
    assert "# not" in got[1][2] and "in an open fence" in got[3][2]
    assert sections("", "") == [(0, "", "")]
    assert sections("# A\n### C\nx")[-1][1] == "A > C"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 900), st.integers(5, 60), st.integers(0, 4), st.integers(0, 10**6))
def test_pieces_cover_and_overlap(n, size, overlap, seed):
    rnd = random.Random(seed)
    words = [f"w{i}{rnd.choice(['', '', '', ',', '.', '. A'])}" for i in range(n)]
    text = "".join(w + rnd.choice([" ", " ", " ", "\n", "\n\n", "\n- "]) for w in words)
    tokens, params = text.split(), SplitParams(size, overlap)
    got = pieces(text, params)
    if len(tokens) <= size:
        assert got == []
        return
    at = 0
    for k, first, count, how, piece in got:
        assert piece.split() == tokens[first : first + count] and count <= size
        assert first == (at - overlap if k and at >= overlap else 0)
        at = first + count
    assert at == len(tokens)


def test_natural_boundaries():
    sentence = "One two three four five six seven eight nine ten. "
    text = "\n\n".join(sentence * 3 for _ in range(6))
    got = pieces(text, SplitParams(70, 10))
    assert [g[3] for g in got] == ["block"] * (len(got) - 1) + ["end"]
    got = pieces(sentence * 20, SplitParams(55, 5))
    assert all(g[3] == "sentence" for g in got[:-1])
    assert pieces("x " * 100, SplitParams(30, 5))[0][3] == "word"


def test_table(spark):
    long = "word " * 400
    notes = spark.createDataFrame([("p", "T", f"{long}\n# H\nshort\n# K\n{long}", "", 0), ("p", "T", f"{long}\n# H\nshort\n# K\n{long}", "", 0), ("q", None, None, "", 0), (None, None, "w " * 360, "", 0)], NOTE)
    chunks = spark.createDataFrame([("p", 3, long, "B > C", ""), ("p", 4, "word " * 350, None, ""), ("r", None, long, None, ""), ("s", 1, None, "", "")], CHUNK)
    out = split_oversized(notes, chunks)
    rows = out.collect()
    assert sorted(((r.item, r.path, r.ordinal) for r in oversized(out).collect()), key=repr) == sorted([("body", "p", 0), ("body", "p", 2), ("body", None, 0), ("chunk", "p", 3), ("chunk", "r", None)], key=repr)
    assert len(rows) == 10 and {r.breadcrumb for r in rows if r.path == "p"} == {"T", "T > K", "B > C"}
    assert split_oversized(notes.limit(0), chunks.limit(0)).count() == 0


def test_blank_lines_in_code_are_no_blocks():
    import re

    from inkwell.llm.splitting import boundaries

    text = "intro words\n\n```\na b\n\nc d\n```\n\nafter it"
    levels = boundaries(text, [m.span() for m in re.finditer(r"\S+", text)])
    assert dict(zip(text.split(), levels)) == {"intro": 0, "words": 4, "```": 1, "a": 1, "b": 4, "c": 1, "d": 4, "after": 0, "it": 4}


def test_nested_items_lie_below_their_list():
    text = "\n".join(f"- part {k} " + "w " * 40 + "\n" + "\n".join(f"  - sub {k} {n} " + "v " * 20 for n in range(4)) for k in range(9))
    cut = pieces(text, SplitParams(200, 20))
    assert len(cut) > 4 and all(how in ("item", "end") for *_, how, _ in cut) and max(n for _, _, n, _, _ in cut) <= 200
