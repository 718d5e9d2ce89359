"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, merged into runs of one role and concatenated. The template is
``<s>`` + runs; a run is an opening mark, its texts joined by ``<sep>``, and a closing mark:

    user       ``[INST] ... [/INST]``          assistant  ``<ans>...</s>``
    system     ``<<SYS>>...<</SYS>>``          any other  ``<<ROLE>>name<</ROLE>>...<</TURN>>``

Control strings inside texts and role names get one backslash after their first character (``<\\/s>``); one that already has
backslashes there gets one more, so that removing one from each restores the text. Nothing else in a text changes.

Defined cases: a null text is empty; a null role is an empty name; rows with equal turn numbers are ordered by role, then text, and
null turns come first; repeated rows are repeated turns; a null conversation id is a conversation of its own; extra columns are
ignored. A conversation is one value of one row, since its digest and its formatted text are sequential: its text must fit Spark's
2 GB a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings, as they follow their first character.
_TAILS = ["s>", "/s>", "sep>", "ans>", "<SYS>>", "</SYS>>", "<ROLE>>", "</ROLE>>", "</TURN>>", "INST]", "/INST]"]
_TAIL = "(" + "|".join(t.replace("]", "\\]") for t in _TAILS) + ")"
_OPEN = {"user": "[INST] ", "assistant": "<ans>", "system": "<<SYS>>"}
_CLOSE = {"user": " [/INST]", "assistant": "</s>", "system": "<</SYS>>"}
#: Pieces and spans that are put together at once: running sums and cuts go over blocks, then within one.
BLOCK = 64
_RUN = r"(?s)\[INST\] .*? \[/INST\]|<ans>.*?</s>|<<SYS>>.*?<</SYS>>|<<ROLE>>.*?<</TURN>>"


def escape(text: Column) -> Column:
    """``text`` without control strings."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _runs(turns: Column) -> Column:
    """Sorted turns as an array of (role, texts), adjacent turns of one role merged."""

    def merged(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (t[i]["role"] != t[F.greatest(i - 1, F.lit(0))]["role"]))

        def cut(heads: Column) -> Column:
            return F.transform(
                heads,
                lambda h, k: F.struct(
                    t[h]["role"].alias("role"),
                    F.transform(F.slice(t, h + 1, F.when(k + 1 < F.size(heads), heads[F.least(k + 1, F.size(heads) - 1)]).otherwise(F.size(t)) - h), lambda x: x["text"]).alias("texts"),
                ),
            )

        return _let(at, cut)

    return _let(turns, merged)


def _marked(run: Column) -> Column:
    """Pieces of a run: (text, loss)."""
    role = run["role"]
    pick = lambda table, other: F.when(role == "user", table["user"]).when(role == "assistant", table["assistant"]).when(role == "system", table["system"]).otherwise(other)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    opening = pick(_OPEN, F.concat(F.lit("<<ROLE>>"), escape(role), F.lit("<</ROLE>>")))
    body = F.transform(run["texts"], lambda x, i: F.array(piece(F.when(i == 0, "").otherwise("<sep>"), F.lit(False)), piece(escape(x), role == "assistant")))
    return F.concat(F.array(piece(opening, F.lit(False))), F.flatten(body), F.array(piece(pick(_CLOSE, F.lit("<</TURN>>")), F.lit(False))))


def _block(part: Column) -> Column:
    """The text of a block of pieces, and where in it the loss pieces are."""
    size = lambda p: F.length(p["text"])
    before = lambda i: F.aggregate(F.slice(part, 1, i), F.lit(0), lambda n, p: n + size(p))
    spans = F.transform(F.filter(F.sequence(F.lit(0), F.size(part) - 1), lambda i: part[i]["loss"]), lambda i: F.struct(before(i).alias("start"), size(part[i]).alias("length")))
    return F.struct(F.array_join(F.transform(part, lambda p: p["text"]), "").alias("text"), spans.alias("spans"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss array<struct<start, length>>``: the text, and the spans of its characters that carry the loss, one per
    assistant text."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    runs = grouped.select("conv_id", _runs(F.col("turns")).alias("runs"))
    start = F.array(F.struct(F.lit("<s>").alias("text"), F.lit(False).alias("loss")))
    pieces = runs.select("conv_id", F.concat(start, F.flatten(F.transform("runs", _marked))).alias("pieces"))
    cut = F.transform(F.sequence(F.lit(0), F.size("pieces") - 1, F.lit(BLOCK)), lambda at: _let(F.slice("pieces", at + 1, BLOCK), _block))
    blocks = pieces.select("conv_id", cut.alias("blocks"))
    sized = blocks.select("conv_id", "blocks", F.transform("blocks", lambda b: F.length(b["text"])).alias("sizes"))
    before = lambda k: F.aggregate(F.slice("sizes", 1, k), F.lit(0), lambda n, x: n + x)
    moved = F.transform("blocks", lambda b, k: _let(before(k), lambda at: F.transform(b["spans"], lambda x: F.struct((at + x["start"]).alias("start"), x["length"].alias("length")))))
    return sized.select("conv_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("formatted"), F.flatten(moved).alias("loss"))


def masked_text(formatted: Column, loss: Column) -> Column:
    """The characters of a formatted text under its loss spans, unescaped span by span. Spans are cut in blocks, since cutting counts
    characters from the start of a string."""

    def cut(part: Column) -> Column:
        first = part[0]["start"]
        end = F.element_at(part, -1)["start"] + F.element_at(part, -1)["length"]
        inside = lambda text: F.array_join(F.transform(part, lambda x: unescape(F.substring(text, x["start"] - first + 1, x["length"]))), "")
        return _let(F.substring(formatted, first + 1, end - first), inside)

    blocks = F.transform(F.sequence(F.lit(0), F.size(loss) - 1, F.lit(BLOCK)), lambda at: _let(F.slice(loss, at + 1, BLOCK), cut))
    return F.when(F.size(loss) == 0, "").otherwise(F.array_join(blocks, ""))


def read_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>, read from its text alone."""

    def texts(run: Column, opening: str, closing: str, role: Column) -> Column:
        body = F.substring(run, len(opening) + 1, F.length(run) - len(opening) - len(closing))
        return F.transform(F.split(body, "<sep>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    def turns(run: Column) -> Column:
        name = F.regexp_extract(run, r"(?s)^<<ROLE>>(.*?)<</ROLE>>", 1)
        other = F.substring(run, F.length(name) + 18, F.length(run))
        out = F.when(run.startswith("[INST] "), texts(run, "[INST] ", " [/INST]", F.lit("user")))
        out = out.when(run.startswith("<ans>"), texts(run, "<ans>", "</s>", F.lit("assistant")))
        out = out.when(run.startswith("<<SYS>>"), texts(run, "<<SYS>>", "<</SYS>>", F.lit("system")))
        return out.otherwise(texts(other, "", "<</TURN>>", unescape(name)))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(_RUN), F.lit(0)), turns))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text and its loss spans give when read back."""
    read = formatted.withColumns({"_turns": read_formatted(F.col("formatted")), "_loss": masked_text(F.col("formatted"), F.col("loss"))})
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
