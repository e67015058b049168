"""Byte-level BPE ids of whole texts through the tokenizers library, each distinct unit once.

The byte-level pre-tokenizer always begins a token at a blank or line end that stands between
two characters that are not white space, and where a mark such as a full stop follows a
letter. Text may be cut there without changing its ids. The units between such cuts repeat a
lot: each distinct one is encoded once and remembered by the worker process. Texts with runs
of white space, white space at an end or NUL characters are encoded whole.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textops as T
from .unit_memory import UnitMemory

_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_LOOSE = f"{_SPACE}{{2}}|^{_SPACE}|{_SPACE}$|\\x00"
_MARK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([.,!%*&$#])"
_LINE = "\n"


def cut(column: pa.Array) -> pa.ListArray:
    """Units of each text, for texts without loose white space; joined they give the text again."""
    marked = pc.replace_substring_regex(pc.replace_substring(column, " ", "\0 "), _MARK, "\\1\0\\2")
    return pc.split_pattern(pc.replace_substring(marked, _LINE, "\0\n\0"), "\0")


class Encoder(UnitMemory):
    """Ids of texts under one byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.line = self.whole([_LINE])[0]
        if len(self.line) != 1:
            raise ValueError("the tokenizer has no single id for a line end")
        self.clear()

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids straight from the library."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        super().clear()
        self.remember(pa.array(["", _LINE], pa.string()), np.array(self.line), np.array([0, 1]))

    def encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in one string with line ends between them, where the library cuts.

        No unit but the line end itself contains one, and that one is remembered from the start.
        """
        ids = np.array(self.whole([_LINE.join(units.to_pylist())])[0], np.uint32)
        line = ids == self.line[0]
        ends = np.append(np.flatnonzero(line), len(ids))
        if len(ends) != len(units):
            raise ValueError("units and ids do not line up")
        return ids[~line], np.diff(ends, prepend=-1) - 1

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets); nulls are empty texts."""
        column = pc.fill_null(column, "").cast(pa.string())
        loose = pc.match_substring_regex(column, _LOOSE).to_numpy(zero_copy_only=False)
        parts = cut(column.filter(pa.array(~loose)))
        coded = parts.flatten().dictionary_encode()
        code = self.codes(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        size = self.size[code]
        ids = self.pool[T.ragged(self.start[code], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()] if len(parts) else np.zeros(1, np.int64)
        if not loose.any():
            return ids, ends
        odd = self.whole(column.filter(pa.array(loose)).to_pylist())
        begin, count = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        begin[~loose], count[~loose] = ends[:-1], np.diff(ends)
        count[loose] = [len(x) for x in odd]
        begin[loose] = len(ids) + np.cumsum(count[loose]) - count[loose]
        pool = np.concatenate([ids, np.array([x for y in odd for x in y], np.uint32)])
        return pool[T.ragged(begin, count)], np.concatenate([[0], np.cumsum(count)])


@cache
def encoder(path: str) -> Encoder:
    """The worker process's encoder for a file; its memory serves all tasks of the worker."""
    return Encoder(path)
