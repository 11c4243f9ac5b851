"""Fenced code in markdown, for whatever reads texts line by line in Python."""

from __future__ import annotations

import re

FENCE = re.compile(r"\s*(`{3}|~{3})")


def fenced(lines: list[str]) -> list[bool]:
    """For each line whether it is part of fenced code, the lines of the fence included.

    A fence opens at a line that begins, after blanks, with three backticks or tildes, and closes at the next that begins with three of the same, or at the end.
    """
    marks = [m and m[1] for m in map(FENCE.match, lines)]
    inside = [False] * len(lines)
    at = 0
    while at < len(lines):
        if marks[at]:
            last = next((n for n in range(at + 1, len(lines)) if marks[n] == marks[at]), len(lines) - 1)
            inside[at : last + 1] = [True] * (last + 1 - at)
            at = last
        at += 1
    return inside
