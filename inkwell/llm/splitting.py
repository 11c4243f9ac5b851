"""Splitting oversized texts at natural boundaries.

A text is parsed into a tree: sections, blocks (paragraphs, lists, code), their items, nested as the lists are, sentences, clauses, words. Sibling subtrees are merged into a piece while they
fit, and only a node that is itself oversized is descended into. Consecutive pieces share a fixed number of words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.fences import fenced

WORD = re.compile(r"\S+")
HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
HEADING_MARK = re.compile(r"#{1,6}\s")
ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)]|[a-zA-Z][.)])\s")
LEVELS = ("block", "item", "sentence", "clause", "word")


@dataclass(frozen=True)
class SplitParams:
    #: most words of a piece
    max_words: int = 350
    #: words shared by consecutive pieces
    overlap: int = 60

    def __post_init__(self):
        if not 0 <= self.overlap < self.max_words:
            raise ValueError("the overlap must be smaller than a piece")


def sections(body: str, title: str = "") -> list[tuple[int, str, str]]:
    """Sections of a markdown body: ordinal (headings before it), breadcrumb, text without heading lines.

    A heading is a line of one to six ``#`` and whitespace outside fenced code. A fence opens at a line whose first non-blank characters are three or more
    backticks or tildes and closes at the next line that begins so with three of that character, or at the end.
    """
    out, stack, ordinal, held = [], [], 0, []
    crumb, lines = title, re.split(r"\r\n|\n|\r", body)
    for line, code in zip(lines, fenced(lines)):
        if not code and line.startswith("#") and HEADING_MARK.match(line):
            out.append((ordinal, crumb, "\n".join(held)))
            mark = HEADING.match(line)
            name = mark.group(2) if mark else line.lstrip("#").strip()
            stack = stack[: line[:7].split(None, 1)[0].count("#") - 1] + [name]
            crumb = " > ".join([title, *(x for x in stack if x and x != title)] if title else [x for x in stack if x])
            ordinal, held = ordinal + 1, []
            continue
        held.append(line)
    out.append((ordinal, crumb, "\n".join(held)))
    return out


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[float]:
    """For every word, the level (index into ``LEVELS``) of the boundary before it. Items of nested lists lie between the items and sentences, the deeper the lower.

    Fenced code is one block, whose lines are its items, blank ones or not.
    """
    out, levels, inside = [0.0], {}, set()
    at, indents = 0, []
    lines = text.split("\n")
    for line, code, before in zip(lines, fenced(lines), [False, *fenced(lines)]):  # what starts at a line
        bare = line.lstrip()
        if bare:
            first = at + len(line) - len(bare)
            if code:
                levels[first] = 1.0 if before else 0.0
                if before:
                    inside.add(first)
            elif bare[0] == "|":
                levels[first] = 1.0
            elif ITEM.match(line):
                indent = len(line) - len(bare)
                indents = [x for x in indents if x < indent]
                levels[first] = 1 + min(len(indents), 9) / 10
                indents.append(indent)
            elif not line[:1].isspace():
                indents = []
        at += len(line) + 1
    for (_, end), (start, stop) in zip(spans, spans[1:]):
        space = text[end:start]
        last, first = text[end - 1], text[start]
        if start in levels:
            out.append(0 if space.count("\n") > 1 and start not in inside and levels[start] <= 1 else levels[start])
        elif space.count("\n") > 1:
            out.append(0)
        elif last in ".!?…" or (last in "\"')]»”" and end >= 2 and text[end - 2] in ".!?…"):
            out.append(3 if first.islower() else 2)
        else:
            out.append(3 if last in ",;:—–" else 4)
    return out


def cut_points(levels: list[float], params: SplitParams) -> list[int]:
    """Word positions at which new pieces begin (without their overlap); the first is 0.

    Nodes are runs of words between boundaries of a level. They are added to the open piece while they fit; one that does not fit opens the next piece if it fits
    there, else its children are packed in its place.
    """
    cuts = [0]
    room = params.max_words

    order = sorted({*levels, len(LEVELS) - 1})

    def pack(start: int, end: int, depth: int) -> None:
        nonlocal room
        begin = start
        while begin < end:
            stop = begin + 1
            while stop < end and levels[stop] > order[depth]:
                stop += 1
            size = stop - begin
            if size > room and size <= params.max_words - params.overlap and begin > cuts[-1]:
                cuts.append(begin)
                room = params.max_words - params.overlap
            if size <= room:
                room -= size
            elif depth < len(order) - 1:
                pack(begin, stop, depth + 1)
            else:  # a single word and no room
                cuts.append(begin)
                room = params.max_words - params.overlap - size
            begin = stop

    pack(0, len(levels), 0)
    return cuts


def pieces(text: str, params: SplitParams = SplitParams()) -> list[tuple[int, int, int, str, str]]:
    """Pieces of a text of over ``max_words`` words: number, first word, words, boundary at its end, text. None if it fits."""
    spans = [m.span() for m in WORD.finditer(text)]
    if len(spans) <= params.max_words:
        return []
    levels = boundaries(text, spans)
    cuts = cut_points(levels, params)
    out = []
    for k, begin in enumerate(cuts):
        end = cuts[k + 1] if k + 1 < len(cuts) else len(spans)
        first = max(0, begin - params.overlap) if k else 0
        how = LEVELS[int(levels[end])] if end < len(spans) else "end"
        out.append((k, first, end - first, how, text[spans[first][0] : spans[end - 1][1]]))
    return out


COLUMNS = "item string, path string, ordinal int, piece int, first_word int, words int, boundary string, breadcrumb string, text string"


def split_oversized(notes: DataFrame, chunks: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """Pieces of the note sections and stored chunks of more than ``max_words`` words.

    ``item`` is ``body`` (a section of a note; ``ordinal`` counts the headings before it) or ``chunk``. A piece has at most ``max_words`` words, starts with the
    last ``overlap`` words of the one before, and ends at the highest boundary that packing leaves: ``block``, ``item``, ``sentence``,
    ``clause``, else ``word``, the last at ``end``. Each carries its ``breadcrumb``.

    Narrow: texts that are too short to hold so many words are passed over before they reach Python, and nothing but the pieces is shuffled, to drop repeated ones.

    Defined cases: null and blank texts give nothing, null titles and breadcrumbs count as empty; rows without a path are kept with a null path; repeated
    rows give their pieces once; texts that differ under one path and ordinal each give theirs; a word of any length is one word.
    """
    least = 2 * params.max_words + 1  # characters that one word more than the limit needs, spaces included
    title = F.col("title") if "title" in notes.columns else F.lit(None).cast("string")
    body = notes.where(F.length("body") >= least).select(F.lit("body").alias("item"), F.col("path"), F.lit(None).cast("int").alias("ordinal"), title.alias("crumb"), F.col("body").alias("txt"))
    stored = chunks.where(F.length("text") >= least).select(F.lit("chunk").alias("item"), F.col("doc_path").alias("path"), F.col("ordinal").cast("int").alias("ordinal"), F.col("breadcrumb").alias("crumb"), F.col("text").alias("txt"))

    def split(batches):
        for batch in batches:
            rows = []
            for item, path, ordinal, crumb, text in zip(batch["item"], batch["path"], batch["ordinal"], batch["crumb"], batch["txt"]):
                crumb = crumb if isinstance(crumb, str) else ""
                parts = sections(text, crumb) if item == "body" else [(None if pd.isna(ordinal) else int(ordinal), crumb, text)]
                for number, way, part in parts:
                    if len(part) >= least:
                        rows += [(item, path, number, k, first, n, how, way, piece) for k, first, n, how, piece in pieces(part, params)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")]).astype({"ordinal": "Int32"})

    out = body.unionByName(stored).mapInPandas(split, COLUMNS)
    return out.dropDuplicates(["item", "path", "ordinal", "piece", "first_word", "breadcrumb", "text"])


def oversized(found: DataFrame) -> DataFrame:
    """The items that ``split_oversized`` has cut: ``item``, ``path``, ``ordinal``."""
    return found.where("piece = 0").select("item", "path", "ordinal").distinct()
