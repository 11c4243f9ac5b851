import random

from inkwell.llm.quality import CLASSES, EXAMPLES, QualityParams, fit, passage_blocks, passages, statistics, text_measures, text_passages, text_quality

PROSE = ["We moved the old lamp to the hall because the light in the loft was too weak for the work. ", "Nobody knows who wrote the note, but it was on the table when I came in. ", "The second printer is in the cellar, and the cable that we need for it is not there. "]
TABLE = "\n".join(f"lamp{i}\t{i}.20\t{i * 77}\thall" for i in range(12))
LIST = "\n".join(f"- part {i}\n- lamp, cable: {i}" for i in range(12))


def prose(n, seed=0):
    rnd = random.Random(seed)
    return "".join(rnd.choice(PROSE) for _ in range(n))


def test_passages():
    text = "---\na: 1\n---\n# Head\nplain one\nplain two\n- x\n- y\n\n| a | b |\n```\ncode\n```\nend"
    assert [(k, len(v)) for k, v in passages(text)] == [("front", 3), ("heading", 1), ("plain", 2), ("item", 2), ("row", 1), ("code", 3), ("plain", 1)]
    assert passages("") == [] and text_passages(None) == []
    assert statistics(["äö ü"])[0] == 3
    assert {c for c, _ in EXAMPLES} == set(CLASSES)


def test_kinds(spark):
    texts = {i: prose(8, i) for i in range(30)} | {30 + i: TABLE for i in range(8)} | {40 + i: LIST for i in range(8)}
    texts |= {50: prose(4) + "\n\n" + TABLE + "\n\n" + TABLE, 51: prose(20) + "\n\n" + LIST, 52: "```\n" + prose(9) + "\n```", 53: "4f 00 a1 9c 33 07 e5 b2 " * 60, 60: "", 61: None, 62: " \n ", 63: prose(3000)}
    rows = [(k, v, "x") for k, v in texts.items()] + [(0, texts[0], "x"), (None, texts[1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chars string")
    got = text_quality(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].is_prose for i in [*range(30), 51, 52, 63]) and by[None].is_prose
    assert not any(by[i].is_prose for i in [*range(30, 38), *range(40, 48), 50, 53])
    assert by[30].kind == "table" and by[40].kind == "list" and by[53].kind == "junk"
    assert all(by[i].is_prose is None and by[i].chars == 0 and by[i].prose_share is None for i in (60, 61, 62))
    assert text_quality(df.limit(0)).count() == 0
    assert text_quality(df.where("doc_id = 60")).first().is_prose is None


def test_mixture_converges_whatever_the_partitions(spark):
    texts = [prose(6, i) for i in range(40)] + [TABLE] * 9 + [LIST] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fits = [fit(passage_blocks(df.repartition(n), "doc_id", "text"), QualityParams(components=6)) for n in (1, 4)]
    assert all(m.converged and m.rounds > 1 for m in fits) and abs(fits[0].likelihood - fits[1].likelihood) < 1e-6
    assert {CLASSES[c] for c in fits[0].classes()} >= {"prose", "list", "table"}
    start = fit(passage_blocks(df, "doc_id", "text"), QualityParams(components=6, rounds=0))
    assert start.rounds == 0 and not start.converged


def test_unconverged_fit_warns(spark):
    import pytest

    df = spark.createDataFrame([(i, prose(6, i)) for i in range(20)], "doc_id bigint, text string")
    with pytest.warns(UserWarning, match="not converged"):
        fit(passage_blocks(df, "doc_id", "text"), QualityParams(components=2, rounds=1))


def test_measures(spark):
    df = spark.createDataFrame([(1, "The lamp is on.\n- lamp"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in text_measures(df).collect()}
    assert (got[1].words, got[1].ended_lines, got[1].common_words) == (6, 0.5, 0.5)
    assert got[2].words == 0 and got[2].mean_word_length is None and got[3].words is None
