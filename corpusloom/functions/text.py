"""Text functions as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore in Unicode, written so that Java and RE2 read it alike.
WORD = r"[\p{L}\p{N}_]+"
CITATION = r"\[([^\[\]\s]+#c\d+)\]"
#: An answer that begins like this declines to answer (fixed value).
ABSTAIN_PREFIX = "Not answerable from the documentation."


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (trim alone takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """CRLF and CR become LF; white space at both ends goes."""
    return strip(F.regexp_replace(text, "\r\n?", "\n"))


def collapse_blank_runs(text: Column) -> Column:
    """Three line feeds or more become two."""
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def strip_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), strip), "\n")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def question_key(text: Column) -> Column:
    return F.lower(squeeze(text))


def doc_id_from_path(path: Column) -> Column:
    """A relative path without its last suffix; raises on "#", which separates document and chunk number."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    return F.when(F.contains(path, F.lit("#")), F.raise_error(F.concat(F.lit("'#' in path "), path)).cast("string")).otherwise(bare)


def utf8(content: Column) -> Column:
    """Bytes as text, with the replacement character for what isn't UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def citations(text: Column) -> Column:
    """Distinct cited chunk ids in order of first citation."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)))


def abstained(text: Column, prefix: str = ABSTAIN_PREFIX) -> Column:
    return F.startswith(strip(text), F.lit(prefix))


def first_match(text: Column, pattern: str, context: int = 60) -> Column:
    """The first case-insensitive match with so many code points on both sides, squeezed; null without a match."""
    p = f"(?iu){pattern}"
    found = F.regexp_substr(text, F.lit(p))
    at = F.length(F.element_at(F.split(text, p, 2), 1))  # in code points, which regexp_instr doesn't count
    lo = F.greatest(at - context, F.lit(0))
    return squeeze(F.substring(text, lo + 1, at + F.length(found) + context - lo))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once also where then uses it in a function of array elements."""
    return F.element_at(F.transform(F.array(value), then), 1)


def windows(text: Column, size: int) -> Column:
    """Every run of so many lower-case words, joined by spaces; none for a text of fewer."""
    def of(words: Column) -> Column:
        starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))

    return let(tokens(text), of)
