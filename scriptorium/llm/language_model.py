"""Language-model scoring with a log-frequency Bloom filter.

One pass over the training texts counts words (64-bit hashes) and bigrams
(``KEY_BITS``-bit keys); each task sums its own counts and ships them sorted
and squeezed by key range, so the shuffle carries about three bytes a distinct
bigram and task. For each key range one task quantises the counts into cells of
whole numbers (single ones at first, then each ``BASE`` times wider) and enters the
events (key, 1..q) of a key in cell q into that range's part of the filter, the
first by ``FIRST`` bits, the rest by ``LATER``. Workers read a count back by
probing j = 1, 2, ... and, past ``LINEAR``, by doubling and halving, and take
the mean of the cell's whole numbers. The probability is Dirichlet-smoothed:
P(w|v) = (c(vw) + MU P(w)) / (c(v) + FALSE + MU), P(w) = (c(w)+1) / (N+V+1),
c(vw) at most c(v) and c(w), c(v) and c(w) exact for frequent words. FALSE is
the count that false positives add to a context's V possible bigrams on average:
V times the chance that ``FIRST`` probes hit in a filter filled as this one is.
So the probabilities after a word sum to 1 but for the chance in which false
positives it meets (a deviation of sqrt(FALSE) / (c(v) + FALSE + MU)) and the
rounding of counts over 50, by at most 1 in 100.

The exact base score needs exact word counts. Words with a count of at least
N / ``HEAVY`` are at most ``HEAVY`` many and are broadcast; occurrences of all
others are joined by hash, where no key holds more than N / HEAVY rows.

The filter takes ``BITS_PER_EVENT`` bits an event at every size. Up to
``BROADCAST_BITS`` workers hold all of it. Past that no process does: each batch
of texts asks its distinct keys of the filter's parts, one key range at a time,
and the answers (two bytes a key) return to the batch; the scores are the same.

Defined results: a null text is the end token alone; a null id is in no held-out
fold; repeated rows are counted and scored each; texts of any length are scored
whole, a task holds the tokens of one batch; with no training text every word
is unknown; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import discard, extended, fold, give_back, path_of, small_batches, written
from .words import ODD, WordHasher, mixed, squeezed, summed, unsqueezed

KEY_BITS = 56
BASE = 1.02
MU = 500.0
#: Bits of a key's first event, whose false positives are unseen bigrams, and of each later one.
FIRST, LATER = 10, 5
LINEAR = 8
BITS_PER_EVENT = 12
#: Up to 192 MB of filter a worker holds all of it.
BROADCAST_BITS = 3 << 29
HEAVY = 1 << 22
#: The end token, also the context of the first word; no word holds white space.
END = np.uint64(0x5E6D1A7C3B2F4E91)
#: Keys that a counting task holds between two sums.
_FLUSH = 2_000_000
_SHIFT = np.uint64(64 - KEY_BITS)


def _cells() -> np.ndarray:
    """The least count of each cell; the last one, of some 10 ** 12, has no end."""
    least = [1]
    while len(least) < 1300:
        least.append(max(least[-1] + 1, int(np.ceil(least[-1] * BASE))))
    return np.array(least, np.int64)


_LEAST = _cells()
_MEAN = np.concatenate([[0.0], (_LEAST + np.append(_LEAST[1:] - 1, _LEAST[-1])) / 2])


def _word_keys(words: np.ndarray) -> np.ndarray:
    return mixed(words * ODD[0] + np.uint64(1)) >> _SHIFT


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * ODD[1] ^ (second + ODD[2]) * ODD[0]) >> _SHIFT


def _previous(words: np.ndarray) -> np.ndarray:
    """The token before each one; texts follow each other, each closed by END."""
    return np.concatenate([[END], words[:-1]]).astype(np.uint64)


def _tokens(hasher: WordHasher, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' word hashes, each text closed by END, and the texts' token counts."""
    parts: list[np.ndarray] = []
    sizes = []
    end = np.array([END])
    for t in texts:
        h = hasher(t)
        parts += [h, end]
        sizes.append(len(h) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def counts(docs: DataFrame, *, text_col: str = "text", ranges: int = 64) -> DataFrame:
    """Counts of all words and bigrams of ``docs``: rows (pairs, range, squeezed)."""
    small_batches(docs.sparkSession)
    word_bits, pair_bits = np.uint64(64 - ranges.bit_length() + 1), np.uint64(KEY_BITS - ranges.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

        def joined(pairs: bool) -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held[pairs], strict=True))
            held[pairs].clear()
            return summed(keys, n)

        def shipped(pairs: bool) -> pa.RecordBatch:
            keys, n = joined(pairs)
            cut = np.searchsorted(keys >> (pair_bits if pairs else word_bits), np.arange(ranges + 1, dtype=np.uint64))
            rows = [(r, squeezed(keys[a:b], n[a:b])) for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([pairs] * len(rows)), pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["pairs", "range", "squeezed"])

        for b in batches:
            words, _ = _tokens(hasher, b.column(0).to_pylist())
            for pairs, keys in ((False, words), (True, np.concatenate([_pair_keys(_previous(words), words), _word_keys(words)]))):
                if len(keys):
                    held[pairs].append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held[pairs]) > _FLUSH:
                    held[pairs] = [joined(pairs)]
                    if len(held[pairs][0][0]) > _FLUSH // 2:
                        yield shipped(pairs)
        for pairs in held:
            if held[pairs]:
                yield shipped(pairs)
        del hasher
        give_back()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "pairs boolean, `range` int, squeezed binary")


def _merged(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    parts = [unsqueezed(x) for x in column]
    return summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def word_counts(counted: DataFrame) -> DataFrame:
    """Exact counts: one row a word hash (``h``, ``c``)."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = _merged(rows["squeezed"])
        give_back()
        return pd.DataFrame({"h": keys.view(np.int64), "c": n})

    return counted.filter(~F.col("pairs")).groupBy("range").applyInPandas(merge, "h long, c long")


def _places(keys: np.ndarray, j: np.ndarray | int, bits: np.ndarray | int, probes: int) -> Iterator[np.ndarray]:
    """The bit positions of events (key, j)."""
    x = mixed(keys * ODD[1] + np.asarray(j, np.uint64) * ODD[2])
    step = (x >> np.uint64(32)) | np.uint64(1)
    low = x & np.uint64(0xFFFFFFFF)
    for i in range(probes):
        yield (low + np.uint64(i) * step) % np.asarray(bits, np.uint64)


def filter_parts(counted: DataFrame, *, ranges: int = 64, bits_per_event: int = BITS_PER_EVENT) -> DataFrame:
    """The filter: one row a key range (``range``, ``events``, ``filled`` share, ``bits``)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = _merged(rows["squeezed"])
        q = np.searchsorted(_LEAST, n, "right")
        size = int(max(64, q.sum() * bits_per_event)) // 8 * 8
        flags = np.zeros(size, bool)
        for j in range(1, int(q.max()) + 1):
            keys, q = keys[q >= j], q[q >= j]
            for at in _places(keys, j, size, FIRST if j == 1 else LATER):
                flags[at.astype(np.int64)] = True
        events, filled, bits = int(np.searchsorted(_LEAST, n, "right").sum()), float(flags.mean()), np.packbits(flags, bitorder="little").tobytes()
        del keys, n, q, flags
        give_back()
        return pd.DataFrame({"range": [int(rows["range"].iloc[0])], "events": [events], "filled": [filled], "bits": [bits]})

    return counted.filter("pairs").groupBy("range").applyInPandas(build, "`range` int, events long, filled double, bits binary")


def _steps(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The cell of each key by probing its part of the filter; 0 if the first event is missing."""
    q = np.zeros(len(keys), np.int64)
    if not len(bits):
        return q
    size = np.uint64(8 * len(bits))

    def held(at: np.ndarray, j: np.ndarray | int, probes: int) -> np.ndarray:
        """Which of ``keys[at]`` have their event j, as a mask."""
        out, left = np.zeros(len(at), bool), np.arange(len(at))
        x = mixed(keys[at] * ODD[1] + np.asarray(j, np.uint64) * ODD[2])
        step, low = (x >> np.uint64(32)) | np.uint64(1), x & np.uint64(0xFFFFFFFF)
        for i in range(probes):
            place = ((low + np.uint64(i) * step) % size).astype(np.int64)
            hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            left, low, step = left[hit], low[hit], step[hit]
        out[left] = True
        return out

    alive = np.arange(len(keys))
    for j in range(1, LINEAR + 1):
        alive = alive[held(alive, j, FIRST if j == 1 else LATER)]
        q[alive] = j
    low, high = np.full(len(alive), LINEAR), np.full(len(alive), len(_LEAST) + 1)
    reach = 2 * LINEAR
    climbing = np.arange(len(alive))
    while len(climbing) and reach <= len(_LEAST):
        hit = held(alive[climbing], reach, LATER)
        low[climbing[hit]], high[climbing[~hit]] = reach, reach
        climbing, reach = climbing[hit], 2 * reach
    while len(between := np.flatnonzero(high - low > 1)):
        middle = (low[between] + high[between]) // 2
        hit = held(alive[between], middle, LATER)
        low[between[hit]], high[between[~hit]] = middle[hit], middle[~hit]
    q[alive] = low
    return q


class Model:
    """The filter (an array a key range) and the frequent words' exact counts; past ``BROADCAST_BITS``, ``parts`` is the filter's table and ``bits`` is empty."""

    def __init__(self, bits: list[np.ndarray], sizes: np.ndarray, heavy: np.ndarray, heavy_counts: np.ndarray, tokens: int, distinct: int, false: float = 0.0, parts: str | None = None):
        self.bits, self.sizes = bits, sizes * 8
        self.range_shift = np.uint64(KEY_BITS - len(sizes).bit_length() + 1)
        order = np.argsort(heavy)
        self.heavy, self.heavy_counts = heavy[order], heavy_counts[order]
        self.tokens, self.distinct, self.false, self.parts = tokens, distinct, false, parts
        self.hasher: WordHasher | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"hasher": None}

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts by probing, as the mean of the cell."""
        order = np.argsort(keys, kind="stable")
        ranges = (keys[order] >> self.range_shift).astype(np.int64)
        own, first = np.unique(ranges, return_index=True)
        q = np.zeros(len(keys), np.int64)
        for r, at in zip(own, np.split(order, first[1:]), strict=False):  # no keys: no range, one empty piece
            q[at] = _steps(keys[at], self.bits[r])
        return _MEAN[q]

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Counts of the frequent words among ``words``, 0 for others."""
        at = np.searchsorted(self.heavy, words)
        at[at == len(self.heavy)] = 0
        return np.where(self.heavy[at] == words, self.heavy_counts[at], 0) if len(self.heavy) else np.zeros(len(words), np.int64)

    def probability(self, before: np.ndarray, words: np.ndarray, count: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """P(word | word before) of each pair of hashes."""
        count = count or self.count
        known, back = np.unique(np.concatenate([before, words]), return_inverse=True)
        single = self.exact(known)
        rare = np.flatnonzero(single == 0)
        single = single.astype(float)
        single[rare] = count(_word_keys(known[rare]))
        pairs, pair_back = np.unique(_pair_keys(before, words), return_inverse=True)
        c_before, c = single[back[: len(before)]], single[back[len(before) :]]
        pair = np.minimum(count(pairs)[pair_back], np.minimum(c_before, c))
        return (pair + MU * (c + 1) / (self.tokens + self.distinct + 1.0)) / (c_before + self.false + MU)

    def asked(self, texts: list[str | None]) -> np.ndarray:
        """All keys whose counts :meth:`score` reads, sorted."""
        self.hasher = self.hasher or WordHasher(120_000)
        words, _ = _tokens(self.hasher, texts)
        return np.unique(np.concatenate([_word_keys(words), _word_keys(np.array([END])), _pair_keys(_previous(words), words)]))

    def score(self, texts: list[str | None], steps: np.ndarray | None = None) -> list[tuple]:
        """Per text: tokens, known ones, base score, model score; hashes and numbers of the words not among the frequent.

        ``steps`` answers the keys of :meth:`asked` in their order, where the filter is not held here.
        """
        self.hasher = self.hasher or WordHasher(120_000)
        words, sizes = _tokens(self.hasher, texts)
        count = self.count
        if steps is not None:
            known, answers = self.asked(texts), _MEAN[steps.astype(np.int64)]
            count = lambda keys: answers[np.searchsorted(known, keys)]
        distinct, back = np.unique(words, return_inverse=True)
        c = self.exact(distinct)
        frequent = c > 0
        whole = self.tokens + self.distinct + 1.0
        p = self.probability(_previous(words), words, count)
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        base, score, known = add(np.log10((c + 1) / whole)[back]), add(np.log10(p)), add((c > 0)[back].astype(np.int64))
        out = []
        rare = ~frequent[back]
        for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            own, many = np.unique(back[a : a + n][rare[a : a + n]], return_counts=True)
            out.append((n, int(known[i]), float(base[i]), float(score[i]), distinct[own].view(np.int64), many))
        return out


def train(docs: DataFrame, *, text_col: str = "text", ranges: int | None = None, heavy: int = HEAVY, bits_per_event: int = BITS_PER_EVENT, broadcast_bits: int = BROADCAST_BITS) -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and all words' exact counts."""
    spark = docs.sparkSession
    ranges = ranges or 64 << max(0, (docs.count() // 1_000_000).bit_length())
    counted = written(counts(docs, text_col=text_col, ranges=ranges), "lm-counts")
    words = written(word_counts(counted), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = words.filter(F.col("c") * heavy >= n).toArrow()  # at most `heavy` rows, as the counts sum to n
    built = written(filter_parts(counted, ranges=ranges, bits_per_event=bits_per_event), "lm-filter")
    discard(counted)
    sizes = np.zeros(ranges, np.int64)
    false = 0.0
    for r, size, filled in built.select("range", F.octet_length("bits"), "filled").collect():
        sizes[r] = size
        false += v * filled**FIRST / ranges
    whole = int(sizes.sum()) * 8 <= broadcast_bits
    bits = [np.zeros(0, np.uint8)] * (ranges if whole else 0)
    for a in range(0, len(bits), 4):  # a few parts at a time: the driver holds the filter once
        for r in built.filter(F.col("range").between(a, a + 3)).select("range", "bits").collect():
            bits[r["range"]] = np.frombuffer(r.bits, np.uint8)
    keys, many = frequent.column("h").to_numpy().view(np.uint64), frequent.column("c").to_numpy()
    return Model(bits, sizes, keys, many, n, v, false, None if whole else path_of(built)), words.filter(F.col("c") * heavy < n)


def _ask(source: DataFrame, shipped: Broadcast, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``source`` in numbered chunks, and the filter's answers to each chunk's keys (``chunk``, ``range``, ``payload``).

    A task holds one part of the filter at a time, and the keys that one chunk asks of it.
    """
    schema = extended(source, "row long, chunk long, `range` int, payload binary")
    schema = StructType([StructField(f.name, f.dataType) for f in schema.fields])
    null = lambda n, k: [pa.nulls(n, t) for t in k]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = chunk = TaskContext.get().partitionId() << 40
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(row, row + n)), pa.array(np.full(n, chunk)), *null(n, (pa.int32(), pa.binary()))], names=schema.names)
            keys = shipped.value.asked(b.column(2).to_pylist())
            r, at = np.unique((keys >> shipped.value.range_shift).astype(np.int32), return_index=True)
            payload = [x.tobytes() for x in np.split(keys, at[1:])]
            yield pa.RecordBatch.from_arrays([*null(len(r), [c.type for c in b.columns]), pa.nulls(len(r), pa.int64()), pa.array(np.full(len(r), chunk)), pa.array(r), pa.array(payload, pa.binary())], names=schema.names)
            row, chunk = row + n, chunk + 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = None, np.zeros(0, np.uint8)
        for b in batches:
            out = []
            for r, chunk, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk is None:
                    held, bits = r, np.frombuffer(payload, np.uint8)
                    continue
                keys = np.frombuffer(payload, np.uint64)
                out.append((chunk, r, _steps(keys, bits if r == held else bits[:0]).astype(np.uint16).tobytes()))
            chunks, ranges, payloads = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(ranges, pa.int32()), pa.array(payloads, pa.binary())], names=["chunk", "range", "payload"])

    both = written(source.mapInArrow(cut, schema), "lm-asked")
    asked = both.filter("`range` IS NOT NULL").select("range", "chunk", "payload")
    held = parts.select("range", F.lit(None).cast("long").alias("chunk"), F.col("bits").alias("payload"))
    dealt = held.unionByName(asked).repartition("range").sortWithinPartitions("range", F.col("chunk").asc_nulls_first())
    answers = dealt.mapInArrow(probe, "chunk long, `range` int, payload binary")
    return both.filter("`range` IS NULL").drop("range", "payload"), answers


def score(docs: DataFrame, model: Model, rare: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, folds: int = 7) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("_id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).cast("string"))
    schema = extended(docs.select(F.col(id_col).alias("_id")), "held_out boolean, row long, n_tokens long, known long, base double, score double, rare array<long>, many array<long>")

    def columns(rows: list[tuple], start: int) -> list[pa.Array]:
        n, known, base, score, rare, many = zip(*rows, strict=True) if rows else [()] * 6
        cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (rare, many)]
        return [pa.array(np.arange(start, start + len(rows))), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), *lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        give_back()
        for b in batches:
            for part in (b.slice(a, 512) for a in range(0, b.num_rows, 512)):
                rows = shipped.value.score(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns(rows, row)], names=schema.names)
                row += len(rows)

    def answered(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts, answers = texts.sort_by("row"), answers.sort_by("range")
        steps = np.frombuffer(b"".join(answers.column("payload").to_pylist()), np.uint16)
        rows = shipped.value.score(texts.column("text").to_pylist(), steps)
        return pa.Table.from_arrays([*texts.select(["_id", "held_out"]).columns, *columns(rows, texts.column("row")[0].as_py() if rows else 0)], names=schema.names)

    if model.parts is None:
        scored = written(source.mapInArrow(run, schema), "lm-scored")
    else:
        texts, answers = _ask(source.withColumnRenamed(text_col, "text"), shipped, spark.read.parquet(model.parts))
        scored = written(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answered, schema), "lm-scored")
    spread = scored.select("row", F.explode(F.arrays_zip("rare", "many")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.many").alias("many"))
    more = spread.join(rare, "h").groupBy("row").agg(F.sum("many").alias("more_known"), F.sum(F.col("many") * F.log10(F.col("c") + 1)).alias("more_base"))
    zero = F.lit(0)
    return scored.drop("rare", "many").join(more, "row", "left").select(
        F.col("_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero.cast("double"))).alias("base_score"),
        "score",
    )
