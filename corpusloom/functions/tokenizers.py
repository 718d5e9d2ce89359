"""Tokenizers by kind, over vocabulary files whose path is given, and token ids of a whole column in Arrow batches."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text, and of a run of blanks or of others in it, that a rank-based encoder takes at once.
MOST_CHARS, MOST_RUN = 400_000, 25_000


class Tokens:
    """Ids of a text, optionally between begin and end ids; ``offsets`` says at which character each id's text begins."""

    bos: int | None = None
    eos: int | None = None

    def ids(self, text: str) -> list[int]:
        raise TypeError("a tokenizer names its ids")

    def text(self, ids: list[int]) -> str:
        raise TypeError("a tokenizer decodes its ids")

    def encode(self, text: str, begin: bool = False, end: bool = False) -> list[int]:
        return [*([self.bos] if begin and self.bos is not None else []), *self.ids(text), *([self.eos] if end and self.eos is not None else [])]

    def decode(self, ids: list[int]) -> str:
        return self.text([i for i in ids if i not in (self.bos, self.eos)])


class Given(Tokens):
    """For tests: a text is its ids, separated by blanks."""

    def ids(self, text: str) -> list[int]:
        return [int(x) for x in text.split()]

    def text(self, ids: list[int]) -> str:
        return " ".join(map(str, ids))


class Bytes(Tokens):
    """UTF-8 bytes, with 256 and 257 for begin and end."""

    bos, eos = 256, 257

    def ids(self, text: str) -> list[int]:
        return [*text.encode("utf-8", "ignore")]

    def text(self, ids: list[int]) -> str:
        return bytes(ids).decode("utf-8", "backslashreplace")

    def offsets(self, text: str) -> list[int]:
        return [at for at, c in enumerate(text) for _ in c.encode("utf-8", "ignore")]


class Pieces(Tokens):
    """A SentencePiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = self.model.bos_id(), self.model.eos_id()

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)

    def text(self, ids: list[int]) -> str:
        return self.model.decode(ids)

    def offsets(self, text: str) -> list[int]:
        return [a for a, _ in self.model.encode_as_offset_mapping(text)["offsets"]]


class Ranks(Tokens):
    """A file of ranked byte strings (base64 and rank a line) with a split pattern; long texts and runs go in parts."""

    def __init__(self, path: str, pattern: str, specials: tuple[str, ...] = ("<|begin_of_text|>", "<|end_of_text|>")) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        names = {s: max(ranks.values()) + 1 + i for i, s in enumerate(specials)}
        self.model = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=names)
        self.bos, self.eos = names[specials[0]], names[specials[1]]

    @staticmethod
    def parts(text: str) -> Iterator[str]:
        for at in range(0, len(text), MOST_CHARS):
            yield from re.findall(rf"(?s)(?:\s{{1,{MOST_RUN}}}|\S{{1,{MOST_RUN}}})", text[at : at + MOST_CHARS]) if _long_run(text[at : at + MOST_CHARS]) else [text[at : at + MOST_CHARS]]

    def ids(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self.model.encode(part, disallowed_special=())]

    def text(self, ids: list[int]) -> str:
        return self.model.decode(ids)

    def offsets(self, text: str) -> list[int]:
        return self.model.decode_with_offsets(self.ids(text))[1]


def _long_run(text: str) -> bool:
    return len(text) > MOST_RUN and re.search(rf"\s{{{MOST_RUN + 1}}}|\S{{{MOST_RUN + 1}}}", text) is not None


class Library(Tokens):
    """A tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str, bos: str | None = None, eos: str | None = None) -> None:
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.bos, self.eos = (self.model.token_to_id(x) if x else None for x in (bos, eos))

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def text(self, ids: list[int]) -> str:
        return self.model.decode(ids)

    def offsets(self, text: str) -> list[int]:
        return [a for a, _ in self.model.encode(text, add_special_tokens=False).offsets]


KINDS = {"given": Given, "bytes": Bytes, "pieces": Pieces, "ranks": Ranks, "library": Library}


def built(kind: str, *where: str) -> Tokens:
    """A tokenizer of a kind; ``where`` is its file's path, and for ranks its pattern."""
    if kind not in KINDS:
        raise ValueError(f"there is no tokenizer of the kind {kind!r}")
    return KINDS[kind](*where)


def tokenized(docs: DataFrame, kind: str, *where: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = False, end: bool = False) -> DataFrame:
    """``id, tokens``: the ids of every whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = built(kind, *where)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [tokenizer.encode(t or "", begin, end) for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id bigint, tokens array<int>")
