"""Token counts of prompts by a public tokenizer's file, in Arrow batches."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import slices

#: Characters of a piece at least, and where one may end.
PIECE = 512
_CUT = re.compile(r"[A-Za-z](?= [A-Za-z])")
_made: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, once a process."""
    if path not in _made:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _made[path] = Tokenizer.from_file(path)
    return _made[path]


def token_count(text: Column, path: str) -> Column:
    """How many tokens a text has (null: none), special ones that models add left out."""

    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        t = tokenizer(path)
        return pa.concat_arrays([pa.array((_many(t, x or "") for x in column.slice(a, b - a).to_pylist()), pa.int32()) for a, b in slices(column)])

    return run(text)


def _many(tokenizer, text: str) -> int:
    return len(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)


def pieces(text: str) -> Iterator[str]:
    """Parts of a text whose tokens by a byte-level tokenizer are together those of the text: they end with a letter, and the
    next one begins with a single blank and a letter, where its words end anyway and no special token goes on."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PIECE)
        stop = cut.end() if cut else len(text)
        yield text[at:stop]
        at = stop


def reaches(tokenizer, text: str, most: int) -> bool:
    """Whether a text has so many tokens.  No token is shorter than a byte, and what follows the piece that decides is not encoded."""
    n, left = 0, len(text.encode("utf-8", "surrogatepass"))
    for piece in pieces(text):
        if n >= most or n + left < most:
            break
        n, left = n + _many(tokenizer, piece), left - len(piece.encode("utf-8", "surrogatepass"))
    return n >= most


def is_cut(text: Column, path: str, most: int) -> Column:
    """Whether a prompt reaches the number of tokens that a model takes, so that its end, where the question stands, may be cut.
    path: of a byte-level tokenizer without a normalizer."""

    @F.arrow_udf("boolean")
    def run(column: pa.Array) -> pa.Array:
        t = tokenizer(path)
        return pa.concat_arrays([pa.array((reaches(t, x or "", most) for x in column.slice(a, b - a).to_pylist()), pa.bool_()) for a, b in slices(column)])

    return run(text)
