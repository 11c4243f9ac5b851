"""Scalar operators on text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, file, group, record and unit separators included (fixed value).
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

FRONTMATTER = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n)?"
FENCED = r"(?ms)^[^\S\n]*(```|~~~).*?(?:\n[^\S\n]*\1[^\n]*|\z)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_c(c), f"^{SPACE}+|{SPACE}+$", "")


def words(c: Column | str) -> Column:
    """Runs of non-whitespace, in order; none of a null."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def content_hash(c: Column | str) -> Column:
    """SHA-256 in hex of the body."""
    return F.sha2(_c(c).cast("binary"), 256)


def frontmatter_block(c: Column | str) -> Column:
    """What stands between the fences at the head; empty where there is no frontmatter."""
    return F.regexp_extract(_c(c), FRONTMATTER, 1)


def body_of(c: Column | str) -> Column:
    """The text after the frontmatter."""
    return F.regexp_replace(_c(c), FRONTMATTER, "")


def outside_code(c: Column | str) -> Column:
    """The text with fenced blocks and inline code taken out; an unclosed fence reaches to the end. For scans that need no line numbers."""
    return F.regexp_replace(F.regexp_replace(_c(c), FENCED, "\n"), r"`[^`\n]*`", " ")


def plausible_target(c: Column) -> Column:
    """Whether a link target may name a note: some letter, and no colon or asterisk."""
    return c.rlike(r"\p{L}") & ~c.contains(":") & ~c.contains("*")


def wikilinks(body: Column | str) -> Column:
    """Distinct link targets outside code, in order, without alias and anchor; embeds and links within the page are left out."""
    text = outside_code(body)
    marks, inner = F.regexp_extract_all(text, F.lit(r"(!?)\[\[([^\]\n]+)\]\]"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(!?)\[\[([^\]\n]+)\]\]"), F.lit(2))
    target = lambda x: trim(F.split_part(F.split_part(x, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)))
    kept = F.filter(F.zip_with(marks, inner, lambda m, x: F.when(m == "", target(x))), lambda x: x.isNotNull() & (x != "") & plausible_target(x))
    return F.array_distinct(kept)


def normal_tag(c: Column | str) -> Column:
    """Trimmed, without ``#`` at either end, in lower case."""
    return F.lower(F.regexp_replace(trim(c), "^#+|#+$", ""))


def tag_list(listed: Column, scalar: Column) -> Column:
    """Distinct normal tags in order: of a list as it stands, else of a string parted at commas and white space."""
    raw = F.coalesce(listed, F.split(scalar, rf"(?:,|{SPACE})+"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(raw, normal_tag), lambda t: t != ""))


def entity_slug(c: Column | str) -> Column:
    """Lower case, runs of other than ``a-z0-9`` as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_stem(path: Column | str) -> Column:
    """The file name without ``.md``."""
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"(?i)\.md$", "")


def spaced(c: Column) -> Column:
    return trim(F.regexp_replace(c, "[-_]", " "))


def stub_title(raw: Column | str) -> Column:
    """Title of a note that is only referred to: last part of the path, no ``.md``, hyphens as blanks."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(_c(raw), "/"), -1), r"\.md$", ""), "-", " ")


def category(path: Column | str) -> Column:
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("(root)")


def subcategory(path: Column | str) -> Column:
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > 2, parts[1]).otherwise("")


def title(front_title: Column, body: Column, synced_from: Column, path: Column) -> Column:
    """Title of a note: from the frontmatter; else its first top heading, unless that is a file name; else the folder it was synced from; else its file name."""
    heading = F.regexp_extract(outside_code(body), r"(?m)^#\s+(.+?)\s*$", 1)
    heading = F.when((heading != "") & ~heading.rlike(r"(?i)^[\w.-]+\.(md|txt|yaml|yml|json)$"), trim(heading))
    folder = spaced(F.element_at(F.split(F.regexp_replace(trim(synced_from), "/+$", ""), "/"), -2))
    folder = F.when(F.size(F.split(F.regexp_replace(trim(synced_from), "/+$", ""), "/")) > 1, folder)
    return F.coalesce(F.nullif(trim(front_title), F.lit("")), heading, F.nullif(folder, F.lit("")), spaced(file_stem(path)))


def snippet(c: Column | str, n: int = 60) -> Column:
    """The first words and an ellipsis."""
    return F.concat(F.array_join(F.slice(words(c), 1, n), " "), F.lit("…"))


def embed_text(breadcrumb: Column | str, text: Column | str) -> Column:
    return F.when(F.coalesce(_c(breadcrumb), F.lit("")) != "", F.concat(_c(breadcrumb), F.lit("\n\n"), _c(text))).otherwise(_c(text))


def word_windows(ws: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` words, ``overlap`` shared; the last is the first that reaches the end. None of no words.

    The words are bound once, as the only element of an array; written out inside the lambda they would be parted anew for every window.
    """
    step = max(1, size - overlap)

    def cut(w: Column) -> Column:
        n = F.size(w)
        count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)) + 1)
        starts = F.sequence(F.lit(0), ((count - 1) * step).cast("int"), F.lit(step))
        return F.when(n > 0, F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(ws), cut)[0]


def lenient_json(raw: Column | str, schema: str, required: str) -> Column:
    """A struct parsed from text that may wrap JSON in a fence or in prose; null where no parse yields ``required``."""
    text = trim(raw)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    candidate = F.when(fenced != "", trim(fenced)).otherwise(text)
    ways = F.transform(F.array(candidate), lambda c: F.array(c, F.regexp_extract(c, r"(?s)\{.*\}", 0)))[0]  # as it is, and what stands in braces
    parsed = F.transform(ways, lambda t: F.from_json(t, schema))
    return F.get(F.filter(parsed, lambda x: x.getField(required).isNotNull()), F.lit(0))


def coerced(c: Column | str, vocabulary, default: str) -> Column:
    """A label of a closed vocabulary, ``default`` for any other."""
    label = F.lower(trim(c))
    return F.when(label.isin(list(vocabulary)), label).otherwise(default)


def confidence(c: Column | str, default: float = 0.5) -> Column:
    """A number between 0 and 1; ``default`` where there is none."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_c(c).try_cast("double"), F.lit(default))))
