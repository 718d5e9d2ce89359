"""Text expressions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a synthetic context as unusable.
UNUSABLE = ("INFEASIBLE", "UNFEASIBLE")


def normalized(text: Column) -> Column:
    """White space runs to one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def with_newline(text: Column) -> Column:
    """``text`` ending in a line feed."""
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def first_present(*candidates: Column) -> Column:
    """The first candidate that is there, else the empty text."""
    return F.coalesce(*candidates, F.lit(""))


def is_blank(text: Column) -> Column:
    """Null or white space only."""
    return text.isNull() | ~text.rlike(r"\S")


def usable(contexts: Column) -> Column:
    """Contexts that are not null and not marked as unusable."""
    return F.filter(contexts, lambda c: c.isNotNull() & ~F.trim(c).isin(*UNUSABLE))


def with_contexts(original: Column, contexts: Column, mode: str = "prepend", separator: str = "\n\n") -> Column:
    """``original`` with its usable contexts before or after it; unchanged without any."""
    joined = F.array_join(usable(contexts), separator)
    if mode == "prepend":
        full = F.concat(joined, F.lit(separator), original)
    elif mode == "append":
        full = F.concat(original, F.lit(separator), joined)
    else:
        raise ValueError(f"mode is prepend or append, not {mode!r}")
    return F.when(F.size(usable(contexts)) > 0, full).otherwise(original)


def context_boundary(original: Column, contexts: Column, separator: str = "\n\n") -> Column:
    """Characters before ``original`` when contexts are prepended."""
    return F.when(F.size(usable(contexts)) > 0, F.length(F.array_join(usable(contexts), separator)) + len(separator)).otherwise(0)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("long")


def single_line(text: Column) -> Column:
    """Line ends of any kind to one space."""
    return F.regexp_replace(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", " ")


# What counts as Markdown's headers, bold marks, bullets, numbering, fences and italics, in the order of removal.
MARKUP = (
    (r"(?m)^\s{0,3}#{1,6}\s*", ""),
    (r"\*\*|__", ""),
    (r"(?m)^\s*[\*\-•]\s+", ""),
    (r"(?m)^\s*\d+(\.\d+)*[\.\)]\s+", ""),
    (r"(?m)^\s*```\w*\s*$", ""),
    (r"(?<!\*)\*(?!\s)([^*\n]+)\*", "$1"),
)


def stripped_markup(text: Column) -> Column:
    """Text without Markdown's marks. Lines end at line feeds only, and blanks, digits and letters are those of Unicode."""
    for pattern, kept in MARKUP:
        text = F.regexp_replace(text, f"(?Ud){pattern}", kept)
    return text


def byte_tokens(text: Column, bos: int | None = 256, eos: int | None = 257) -> Column:
    """UTF-8 bytes as token ids with begin and end ids."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), F.lit(".."), F.lit(0))  # in one pass over the text
    body = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))
    start, end = F.array(*[F.lit(bos)] * (bos is not None)).cast("array<int>"), F.array(*[F.lit(eos)] * (eos is not None)).cast("array<int>")
    return F.concat(start, body, end)
