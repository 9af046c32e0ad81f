"""SentencePiece encoding and decoding through a table of distinct chunks.

A space is spelled as a marker, one marker is put before the text, and no piece
of the model has a marker behind another character. So no merge crosses the
place before a run of markers, and a text may be cut there: a chunk is a run of
markers with the characters up to the next run. A batch's texts are cut by
Arrow, its chunks are numbered in a dictionary, each distinct chunk that the
table lacks is segmented once, and the ids come back by the places of the
chunks. The table is emptied when full, so its memory is bounded and results
never depend on it. A model that the rule does not hold for (pieces across
markers, another normalizer or kind) gets each text whole as its one chunk.

Defined results: a null text counts as empty and has only the end id; null ids
and further columns pass through or are ignored; repeated rows give equal rows;
texts of any length are encoded whole; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, small_batches

MARKER = "▁"
_CHUNKS = re.compile(r" +[^ ]*")


class ChunkTable:
    """Encoder and decoder of one model, with the distinct chunks that this worker has met."""

    #: Chunks that the table holds, and ids: it is emptied past either.
    CAPACITY, MOST_IDS = 600_000, 8_000_000

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = separable(self.model)
        self.marker = self.model.piece_to_id(MARKER)
        self.decimal = [str(i) for i in range(self.model.get_piece_size())]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.n_ids = 0

    def _segmented(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks (each without its first marker, which the model puts before it), and how many each has."""
        rows = self.model.encode(chunks, num_threads=1)
        if self.cut and "" in chunks:  # a marker alone: the model gives an empty text nothing
            rows[chunks.index("")] = [self.marker]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.int32, int(counts.sum())), counts

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The table's numbers of distinct chunks; those it lacks are segmented."""
        if len(self.number) > self.CAPACITY or self.n_ids > self.MOST_IDS:
            self._forget()
        fresh = [c for c in chunks if c not in self.number]
        if fresh:
            ids, counts = self._segmented(fresh)
            first, until = len(self.number), len(self.number) + len(fresh)
            self.number.update(zip(fresh, range(first, until), strict=True))
            self.ids = _fitted(self.ids, self.n_ids, self.n_ids + len(ids))
            self.ends = _fitted(self.ends, first, until)
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.ends[first:until] = self.n_ids + np.cumsum(counts)
            self.n_ids += len(ids)
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))

    def _cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All chunks of the texts in order, and how many each text has."""
        if not self.cut:
            return column.filter(pc.not_equal(column, "")), pc.not_equal(column, "").to_numpy(zero_copy_only=False).astype(np.int64)
        column = pc.replace_substring(column, MARKER, " ")  # one and the same to the model
        plain = pc.split_pattern(column, " ")
        odd = pc.match_substring_regex(column, "^ | $|  |^$").to_numpy(zero_copy_only=False)
        if not odd.any():
            return plain.flatten(), pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        own = [[c[1:] for c in _CHUNKS.findall(" " + t)] if t else [] for t in column.filter(pa.array(odd)).to_pylist()]
        both = pa.concat_arrays([plain.filter(pa.array(~odd)), pa.array(own, plain.type)])
        place = np.empty(len(column), np.int64)
        place[np.flatnonzero(~odd)] = np.arange(len(column) - len(own))
        place[np.flatnonzero(odd)] = np.arange(len(column) - len(own), len(column))
        both = both.take(pa.array(place))
        return both.flatten(), pc.list_value_length(both).to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none), without an end id."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        if not len(column):
            return []
        chunks, many = self._cut(column)
        coded = chunks.dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        begins = np.where(number > 0, self.ends[number - 1], 0)
        counts = self.ends[number] - begins
        until = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(begins - until[:-1], counts)
        places += np.arange(until[-1])
        ids = self.ids[places]
        cuts = until[np.concatenate([[0], np.cumsum(many)])].tolist()
        return [ids[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for."""
        return self.model.decode(ids)


def _fitted(a: np.ndarray, used: int, need: int) -> np.ndarray:
    """Room for ``need`` entries; it doubles, so the cost does not depend on the batches."""
    return a if need <= len(a) else np.concatenate([a[:used], np.zeros(max(need, 2 * len(a)) - used, a.dtype)])


def separable(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether texts of a model may be cut before runs of markers."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model.serialized_model_proto())
    n, t = spec.normalizer_spec, spec.trainer_spec
    unchanged = not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not t.treat_whitespace_as_suffix
    return bool(unchanged and t.model_type == t.BPE and not any(MARKER in p.piece.lstrip(MARKER) for p in spec.pieces) and not model.is_unknown(model.piece_to_id(MARKER)))


_LOADED: dict[bytes, ChunkTable] = {}


def _table(model: bytes) -> ChunkTable:
    """The table of this worker process for a model."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = ChunkTable(model)
    return _LOADED[key]


def encode(docs: DataFrame, model_path: str, *, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, number of tokens (with the end id if ``end``), and ``ids`` as an int array."""
    return _mapped(docs, model_path, end, id_col, text_col, [("n_tokens", "long", pa.int64()), ("ids", "array<int>", pa.list_(pa.int32()))], lambda table, ids: (len(ids), ids))


def decode(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``text``, what its ids stand for (null ids: an empty text)."""
    small_batches(encoded.sparkSession)
    shipped = _shipped(encoded, model_path)
    schema = extended(encoded.select(id_col), "text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shipped.value)
        for b in batches:
            texts = [table.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, number of tokens with the end id, digests of the ids and of the text decoded from them."""

    def row(table: ChunkTable, ids: list[int]) -> tuple:
        text = " ".join(map(table.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(table.decode(ids).encode()).hexdigest()

    return _mapped(docs, model_path, True, id_col, text_col, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], row)


def _shipped(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary


def _mapped(docs: DataFrame, model_path: str, end: bool, id_col: str, text_col: str, columns: list[tuple], row) -> DataFrame:
    small_batches(docs.sparkSession)
    shipped = _shipped(docs, model_path)
    schema = extended(docs.select(id_col), ", ".join(f"`{name}` {kind}" for name, kind, _ in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shipped.value)
        closing = [table.model.eos_id()] if end else []
        for b in batches:
            rows = [row(table, ids.tolist() + closing) for ids in table.encode(b.column(1))]
            parts = zip(*rows, strict=True) if rows else [()] * len(columns)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k[2]) for c, k in zip(parts, columns, strict=True))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
