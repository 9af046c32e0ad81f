"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash (hash and displace) over the vocabulary: a
pre-token that is a token itself is resolved by one probe and one comparison.
Tier two, for the rest, merges bytes held in a linked list, taking the pair of
lowest rank (leftmost first) from a heap, so a pre-token of n bytes costs
O(n log n).

Defined results: a null text counts as empty and has no ids; null ids pass
through; repeated rows give equal rows; texts of any length are encoded whole;
an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, small_batches
from .pieces import Encoded, PieceEncoder, flattened, pre_token_pattern

_M64 = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MinimalPerfectHash:
    """Maps each of n keys to its own slot in 0..n-1; other keys to some slot."""

    def __init__(self, keys: list[bytes], load: int = 3):
        n = self.size = len(keys)
        self.shift = [0] * max(1, n // load)
        buckets: list[list[tuple[int, int]]] = [[] for _ in self.shift]
        for i, key in enumerate(keys):
            high, low = divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)
            buckets[high % len(self.shift)].append((low, i))
        free = bytearray(b"\1") * n
        self.order = [0] * n
        for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) < 2:
                break
            d = 0
            while True:
                slots = {self._slot(low, d) for low, _ in own}
                if len(slots) == len(own) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for low, i in own:
                s = self._slot(low, d)
                free[s] = 0
                self.order[s] = i
        left = iter([s for s in range(n) if free[s]])
        for b, own in enumerate(buckets):
            if len(own) == 1:
                s = next(left)
                self.shift[b] = -s - 1
                self.order[s] = own[0][1]

    def _slot(self, low: int, d: int) -> int:
        x = (low ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & _M64
        return (x >> 20) % self.size

    def slot(self, key: bytes) -> int:
        """The slot of ``key`` if it is one of the keys."""
        high, low = divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)
        d = self.shift[high % len(self.shift)]
        return -d - 1 if d < 0 else self._slot(low, d)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    #: Pre-tokens that the memo holds before it is emptied.
    CAPACITY = 300_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys = list(ranks)
        self.hash = MinimalPerfectHash(keys)
        self.slots = [(keys[i], ranks[keys[i]]) for i in self.hash.order]
        self.tokens = {r: k for k, r in ranks.items()}
        self.decimal = {r: str(r) for r in self.tokens}
        self.memo: PieceEncoder | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pieces", "find")} | {"memo": None}

    def whole(self, piece: bytes) -> int | None:
        """The id of a pre-token that is in the vocabulary."""
        if not self.slots:
            return None
        key, rank = self.slots[self.hash.slot(piece)]
        return rank if key == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Merge the bytes of a pre-token by rank."""
        n, rank = len(piece), self.ranks.get
        after = list(range(1, n + 1))  # where the part that begins here ends
        before = list(range(-1, n - 1))  # where the part before it begins
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if after[i] != mid or mid >= n or after[mid] != end:
                continue  # one of the two parts has been merged since
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, end, after[end]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, i, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _pieces(self, units: list[str]) -> Encoded:
        """Ids of strings, pre-token by pre-token; new pre-tokens go through the two tiers."""
        known = self.pieces
        if len(known) > self.CAPACITY:
            known.clear()
        rows = []
        for unit in units:
            row: list[int] = []
            for p in [unit] if unit[1:].isalpha() and unit[0] == " " else self.find(unit):
                if (ids := known.get(p)) is None:
                    raw = p.encode()
                    ids = known[p] = self.merged(raw) if (one := self.whole(raw)) is None else [one]
                row += ids
            rows.append(row)
        return flattened(rows)

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.memo is None:
            self.pieces: dict[str, list[int]] = {}
            self.find = pre_token_pattern().findall
            self.memo = PieceEncoder(self._pieces, self._pieces)
        return self.memo.encode(texts)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Per document: id, number of tokens, and the ids as an int array."""
    return _mapped(docs, ranks_path, id_col, text_col, [("n_tokens", "long", pa.int64()), (ids_col, "array<int>", pa.list_(pa.int32()))], lambda bpe, ids: (len(ids), ids))


def digests(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, number of tokens, digests of the ids and of the bytes decoded from them."""

    def row(bpe: ByteBpe, ids: list[int]) -> tuple:
        text = " ".join(map(bpe.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _mapped(docs, ranks_path, id_col, text_col, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], row)


def _mapped(docs: DataFrame, ranks_path: str, id_col: str, text_col: str, columns: list[tuple], row) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(ByteBpe(read_ranks(ranks_path)))  # bounded by the vocabulary
    schema = extended(docs.select(id_col), ", ".join(f"`{name}` {kind}" for name, kind, _ in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shipped.value
        for b in batches:
            rows = [row(bpe, array("I", x).tolist()) for x in bpe.encode(b.column(1))]
            parts = zip(*rows, strict=True) if rows else [()] * len(columns)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k[2]) for c, k in zip(parts, columns, strict=True))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
