"""Encoding texts unit by unit, with a memo of units already encoded.

Byte-level BPE treats each match of the pre-token pattern separately. A space
or a line feed between two characters that are not white space always begins a
match, so a text may be cut there. A batch is cut and its units are numbered by
Arrow; the memo is asked once for each different unit of the batch, and only
new units go to the encoder behind. Texts with runs of white space, or with
special strings, go to that encoder whole. The memo is emptied when full, so
its memory is bounded and results never depend on it; nor do they depend on how
many bytes of text are encoded together.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Unicode White_Space, spelled out: Python's ``\s`` also has U+001C to U+001F.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_SPACES = frozenset(chr(c) for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])

#: How a unit begins that no single white space stands before, or a line feed.
_ODD = _SPACES | {""}

#: Units that a memo holds at most before it is emptied, and bytes of text that are encoded together (a text that is longer comes whole).
MEMO, AT_ONCE = 600_000, 4 << 20

#: What an encoder gives for several strings: all ids, and how many each string has.
Encoded = tuple[np.ndarray, np.ndarray]


def pre_token_pattern(pattern: str | None = None) -> regex.Pattern:
    """The tokenizers' pre-token pattern with white space as Unicode defines it."""
    p = pattern or public_tokenizers.PATTERN
    p = p.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    return regex.compile(p)


def flattened(rows: Sequence[Sequence[int]]) -> Encoded:
    """Lists of ids as one array and the lengths."""
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.uint32, int(counts.sum())), counts


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``encode_units`` encodes units (each with the space or line feed that it
    begins with), ``encode_whole`` texts of any form.
    """

    def __init__(self, encode_units: Callable[[list[str]], Encoded], encode_whole: Callable[[list[str]], Encoded], special: Sequence[str] = (), capacity: int = MEMO, at_once: int = AT_ONCE):
        self.encode_units, self.encode_whole = encode_units, encode_whole
        self.special, self.capacity, self.at_once = list(special), capacity, at_once
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.ends, self.n_units = np.zeros(1 << 16, np.int64), 0

    def _append(self, ids: np.ndarray) -> None:
        """Write ids behind the memo's; room doubles, so the cost does not depend on the batches."""
        need = self.n_ids + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(max(need, 2 * len(self.ids)) - self.n_ids, np.uint32)])
        self.ids[self.n_ids : need] = ids

    @staticmethod
    def _alone(unit: str) -> bool:
        """Whether what stands before the unit is a single white space."""
        body = unit[1:] if unit[:1] == "\n" else unit
        return bool(body) and body[0] not in _SPACES

    def _numbers(self, units: list[str]) -> np.ndarray:
        """The memo's number of each unit; -1 where a run of white space goes through it."""
        if len(self.number) > self.capacity:
            self._forget()
        get = self.number.get
        found = list(map(get, units))
        if None in found:
            gaps = [i for i, n in enumerate(found) if n is None]
            fit = [u for u in map(units.__getitem__, gaps) if u[:1] not in _ODD or self._alone(u)]
            if fit:
                ids, counts = self.encode_units([u if u[0] == "\n" else " " + u for u in fit])
                self.number.update(zip(fit, range(self.n_units, self.n_units + len(fit)), strict=True))
                self._append(ids)
                until = self.n_units + len(fit)
                if until > len(self.ends):
                    self.ends = np.concatenate([self.ends[: self.n_units], np.zeros(max(until, 2 * len(self.ends)) - self.n_units, np.int64)])
                self.ends[self.n_units : until] = self.n_ids + np.cumsum(counts)
                self.n_units, self.n_ids = until, self.n_ids + len(ids)
            for i in gaps:
                found[i] = get(units[i], -1)
        return np.array(found, np.int64)

    def encode(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text (null: none)."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return []
        until = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff((until - 1) // self.at_once)) + 1).tolist(), len(column)]
        return list(chain.from_iterable(self._encode(column.slice(a, z - a)) for a, z in zip(cuts, cuts[1:], strict=False)))

    def _encode(self, column: pa.LargeStringArray) -> list[bytes]:
        """Ids of texts that are encoded together."""
        whole = pc.match_substring(column, " \n").to_numpy(zero_copy_only=False)
        for s in self.special:
            whole = whole | pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", column) if whole.any() else column
        parts = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        firsts, at = at[:-1] - at[0], at - at[0]
        units = parts.flatten()
        heads = units.take(pa.array(firsts)).to_pylist()
        coded = units.dictionary_encode()
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        number[firsts] = 0
        if (number < 0).any():
            whole[np.searchsorted(at, np.flatnonzero(number < 0), side="right") - 1] = True
        counts = np.zeros(len(number), np.int64)
        starts = np.zeros(len(number), np.int64)
        used = ~np.repeat(whole, np.diff(at))
        used[firsts] = False
        own = number[used]
        begins = np.where(own > 0, self.ends[own - 1], 0)
        counts[used] = self.ends[own] - begins
        starts[used] = begins
        if whole.any():
            asked = column.filter(pa.array(whole)).to_pylist()
            for i, t in zip(np.flatnonzero(whole).tolist(), asked, strict=True):
                heads[i] = t
        head_ids, head_counts = self.encode_whole(heads)
        counts[firsts] = head_counts
        self._append(head_ids)  # for this batch only
        starts[firsts] = self.n_ids + np.cumsum(head_counts) - head_counts
        until = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(starts - until[:-1], counts)
        places += np.arange(until[-1])
        raw = self.ids[places].astype("<u4", copy=False).tobytes()
        cuts = (4 * until[at]).tolist()
        return [raw[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]


class LibraryEncoder:
    """The ``tokenizers`` library over a tokenizer file, special strings as the library has them."""

    #: Units that the library gets in one string.
    JOINED = 64

    def __init__(self, path: str, capacity: int = MEMO, at_once: int = AT_ONCE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token: the vocabulary spells a byte as a character.
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.memo = PieceEncoder(self._units, self._whole, special, capacity, at_once)

    def _whole(self, texts: list[str]) -> Encoded:
        return flattened([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _units(self, units: list[str]) -> Encoded:
        """Encode units in joined strings; a unit's ids end where its bytes do."""
        joined = ["".join(units[i : i + self.JOINED]) for i in range(0, len(units), self.JOINED)]
        ids, _ = self._whole(joined)
        ends = np.cumsum(self.width[ids])
        sizes = np.cumsum(pc.binary_length(pa.array(units, pa.string())).to_numpy(zero_copy_only=False), dtype=np.int64)
        last = np.searchsorted(ends, sizes)
        if not np.array_equal(ends[last], sizes):
            raise ValueError("the tokenizer joins bytes across a white space")
        return ids, np.diff(last, prepend=-1)

    def encode(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text (null: none)."""
        return self.memo.encode(texts)


_LOADED: dict[tuple[str, int, int], LibraryEncoder] = {}


def library_encoder(path: str, capacity: int = MEMO, at_once: int = AT_ONCE) -> LibraryEncoder:
    """The encoder of this worker process for a tokenizer file; the one before goes, so that a worker holds one memo."""
    key = (path, capacity, at_once)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = LibraryEncoder(*key)
    return _LOADED[key]
