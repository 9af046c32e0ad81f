"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts (orders 0 to
``ORDER``) is counted once from a bounded labelled sample and then frozen. A
text's score under a language is its exact code length: escape method C with
full symbol exclusion, order -1 being uniform over the bytes never seen. With
frozen counts the cost of a byte depends only on the ``ORDER`` bytes before it,
so each distinct window is priced once and remembered. Texts are priced in
pieces of ``PIECE`` bytes, each with the ``ORDER`` bytes before it, so memory
does not grow with a text.

Defined results: null text or a text without a letter gives ``und`` and score
0; an empty training set gives ``und`` everywhere; ties go to the language that
sorts first; repeated rows give equal rows, and are learned from like others; a
null id is in no held-out fold; texts of any length are scored whole; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, fold, hash_share, small_batches

UNKNOWN = "und"
ORDER = 3
#: Bound of the labelled sample: so many texts a language (in expectation, chosen by a hash of the id) ...
SAMPLE_DOCS = 400
#: ... of at most so many bytes each.
SAMPLE_BYTES = 32_768
#: Bytes of all languages' samples together: with many languages each has less.
SAMPLE_ALL = 64 << 20
#: More languages than this are an error: they would share too small a sample.
MOST_LANGUAGES = 5000
#: Bytes of text that are priced at once, of their costs under all languages, and of the table of windows already priced.
PIECE, COSTS_BYTES, MEMO_BYTES = 1 << 20, 64 << 20, 16 << 20


def _joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with ``order`` zeros before each text; starts and ends of the texts."""
    pad = b"\0" * order
    buffer = np.frombuffer(b"".join(pad + t for t in texts) or pad, dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + order)
    return buffer, ends - lengths, ends


def _windows(buffer: np.ndarray, width: int) -> np.ndarray:
    """At each position, the ``width`` bytes that end there, as one number."""
    out = np.zeros(len(buffer), np.uint64)
    for back in range(min(width, len(buffer))):
        out[back:] |= buffer[: len(buffer) - back].astype(np.uint64) << np.uint64(8 * back)
    return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys


class ContextTree:
    """Frozen PPM statistics of one language."""

    def __init__(self, texts: list[bytes], order: int = ORDER):
        self.order = order
        buffer, starts, ends = _joined(texts, order)
        real = np.zeros(len(buffer), bool)
        for a, b in zip(starts, ends, strict=True):
            real[a:b] = True
        self.levels = []
        for k in range(order + 1):
            grams, counts = np.unique(_windows(buffer, k + 1)[real], return_counts=True)
            contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
            add = lambda x, at=first: np.add.reduceat(x, at) if len(x) else x
            total, distinct = add(counts).astype(float), add(np.ones(len(grams)))
            level = {"grams": grams, "counts": counts.astype(float), "contexts": contexts, "total": total, "distinct": distinct}
            if k:  # what this context's symbols take out of the next shorter context
                below = self.levels[-1]
                at, _ = _find(below["grams"], grams & np.uint64((1 << 8 * k) - 1))
                level["taken"] = add(below["counts"][at]) if len(grams) else total
            self.levels.append(level)
        self.unseen = max(1, 256 - len(self.levels[0]["grams"]))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window of ``order + 1`` bytes."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        taken, gone = np.zeros(len(grams)), np.zeros(len(grams))
        for k in range(self.order, -1, -1):
            level, own = self.levels[k], grams[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            c, known = _find(level["contexts"], own >> np.uint64(8))
            g, seen = _find(level["grams"], own)
            if not len(level["grams"]):
                continue
            total = level["total"][c] - taken[todo]
            distinct = level["distinct"][c] - gone[todo]
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.log2((total + distinct) / level["counts"][g])
                escape = np.where(distinct > 0, np.log2((total + distinct) / distinct), 0.0)
            out[todo] += np.where(known, np.where(seen, hit, escape), 0.0)
            if k:
                taken[todo] = np.where(known, level["taken"][c], taken[todo] * 0)
                gone[todo] = np.where(known, level["distinct"][c], 0)
            todo = todo[~(seen & known)]
        out[todo] += np.log2(self.unseen)
        return out


class Model:
    """The context trees of all languages, with a table of windows already priced."""

    def __init__(self, texts_by_language: dict[str, list[bytes]], order: int = ORDER):
        self.order = order
        self.languages = sorted(k for k, v in texts_by_language.items() if v)
        self.trees = [ContextTree(texts_by_language[k], order) for k in self.languages]
        self.memo: tuple[np.ndarray, np.ndarray] | None = None
        wide = 8 * max(1, len(self.trees))
        self.piece = max(1 << 10, min(PIECE, COSTS_BYTES // wide))
        self.memo_bits = max(8, min(18, int(np.log2(MEMO_BYTES // wide))))

    def _priced(self, grams: np.ndarray) -> np.ndarray:
        if self.memo is None:
            self.memo = np.full(1 << self.memo_bits, np.uint64(1 << 63)), np.zeros((1 << self.memo_bits, len(self.trees)), np.float64)
        keys, costs = self.memo
        slot = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.memo_bits)).astype(np.int64)
        out = costs[slot]
        miss = np.flatnonzero(keys[slot] != grams)
        if len(miss):
            new, back = np.unique(grams[miss], return_inverse=True)
            priced = np.stack([t.bits(new) for t in self.trees], 1)
            out[miss] = priced[back]
            at = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.memo_bits)).astype(np.int64)
            at, one = np.unique(at, return_index=True)
            keys[at], costs[at] = new[one], priced[one]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        out = np.zeros((len(texts), len(self.trees)))
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > self.piece:  # by itself, piece by piece
                before = b"\0" * self.order
                for a in range(0, len(text), self.piece):
                    piece = before + text[a : a + self.piece]
                    out[i] += self._priced(_windows(np.frombuffer(piece, np.uint8), self.order + 1)[self.order :]).sum(0)
                    before = piece[-self.order :] if self.order else b""
                continue
            group.append(i)
            size += len(text)
            if size >= self.piece:
                out[group] = self._sums([texts[j] for j in group])
                group, size = [], 0
        if group:
            out[group] = self._sums([texts[j] for j in group])
        return out

    def _sums(self, texts: list[bytes]) -> np.ndarray:
        buffer, starts, ends = _joined(texts, self.order)
        running = np.zeros((len(buffer) + 1, len(self.trees)))
        np.cumsum(self._priced(_windows(buffer, self.order + 1)), axis=0, out=running[1:])
        return running[ends] - running[starts]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and their posterior probabilities under equal priors."""
        known = [i for i, t in enumerate(texts) if t and self.trees and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            bits = self.code_lengths([texts[i].encode() for i in known])
            best = bits.argmin(1)
            scores[known] = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
            for i, b in zip(known, best, strict=True):
                names[i] = self.languages[b]
        return names, scores


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 1, folds: int = 3, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> Model:
    """Learn from texts with a label outside the held-out fold.

    The sample is at most about ``sample_docs`` texts a language of at most
    ``sample_bytes`` bytes, so it and the model have a fixed bound at any input
    size. A language whose labelled texts are all longer is learned from a piece
    of that size of each drawn text. Rows that repeat an id are drawn together;
    at most ``4 * sample_docs`` of a language are taken, however ids repeat, and
    no more bytes than its share of ``SAMPLE_ALL`` (but one text at least).
    """
    own = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, folds) != held_out)).select(F.col(lang_col).cast("string").alias("k"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    short = F.octet_length("t") <= sample_bytes
    counts = own.groupBy("k").agg(F.sum(short.cast("long")).alias("short"), F.count(F.lit(1)).alias("all")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Model({}, order)
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r.k, min(1.0, sample_docs / (r.short or r["all"])))])
    only_long = [r.k for r in counts if not r.short]
    drawn = own.filter((short | F.col("k").isin(only_long)) & (hash_share("id", 17) < rate[F.col("k")])).select("k", F.left("t", F.lit(sample_bytes)).alias("t"))
    order_of = Window.partitionBy("k").orderBy(F.xxhash64("t"), "t")
    drawn = drawn.withColumn("place", F.row_number().over(order_of)).filter(F.col("place") <= 4 * sample_docs)
    so_far = F.sum(F.octet_length("t")).over(Window.partitionBy("k").orderBy("place"))
    chosen = drawn.withColumn("bytes", so_far).filter((F.col("place") == 1) | (F.col("bytes") <= SAMPLE_ALL // len(counts))).select("k", "t")
    texts: dict[str, list[bytes]] = {}
    for k, t in sorted((r.k, r.t.encode()) for r in chosen.collect()):
        texts.setdefault(k, []).append(t)
    return Model(texts, order)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``lang_pred``, ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    schema = extended(docs.select(id_col), "lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shipped.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose language is known with ``least_score``."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shipped.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()) if not len(scores) else pa.array((scores >= least_score) & (np.array(names, object) != UNKNOWN)))

    return docs.mapInArrow(run, docs.schema)
