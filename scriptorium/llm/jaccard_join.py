"""Exact Jaccard join on word shingles by token-combination prefixes.

A text's set holds the 64-bit hashes of its distinct ``WIDTH``-word shingles.
Tokens fall into two classes by a count sketch of the corpus (a counter for
about ten words, ``MOST_SKETCH_BITS`` at most): frequent ones and the rest. In
the global order (rare before frequent, then by
count and hash) a prefix is extended until its signatures survive the loss of
as many tokens as a partner at the threshold may lack. Rare tokens are indexed
alone. Frequent tokens are indexed by pairs inside groups of tokens; m of them
in a group survive m-1 losses. The number of groups follows the size tier of
the set, and a set near a tier's edge is indexed for both tiers, so partners
always agree. Sets under ``SMALL`` tokens use single tokens only. Any pair at
the threshold shares a key, whatever the sketch says.

Links are found without emitting all pairs of a group of copies. Equal sets
are one class from the start; a class is named by ``_ID_BITS`` bits of a 128-bit
digest, and names that two digests share are replaced before anything is joined.
Keys whose tokens all have full counters may be held by any share of the
classes: their least member is found by partial aggregation and joined, so that
adaptive execution can split them. All other keys are sorted once and read in
runs. Under each key all members are verified against
one pivot, the set with the smallest share of rare tokens (the likely original
of its copies). The components so far are then computed, and only pairs that
share a key and lie in different components are verified: listed under keys of
at most ``FEW`` classes, compared in blocks of neighbouring sizes inside the
tasks, once a pivot, under all others; there bitmaps decide first which sets
are shipped at all. Other pairs cannot change the result. What a pair of sets
shares is counted exactly.

Defined results: a text without words has no shingles and is linked with
nothing; one of fewer than ``WIDTH`` words is a single shingle; rows with a
null id take part, and a component of such rows alone has a null id; repeated
rows are copies, also of one id; a text may have any length (a task holds the
tokens of one at a time); an empty table gives an empty one. Two different
shingles count as one if their 64-bit hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, extended, give_back, small_batches, written
from .components import components
from .words import ODD, WordHasher, mixed, squeezed, unsqueezed

WIDTH = 5
PERCENT = 80
#: The sketch has a counter for so many bytes of text ...
SKETCH_BYTES = 64
#: ... and at most 2 to this many; past that the bar between rare and frequent rises, and more keys are shared.
MOST_SKETCH_BITS = 26
#: A full counter.
FULL = 255
SMALL = 16
#: Classes and tokens of a block when those that met one pivot are compared: by bitmaps, then by tokens.
BITS_BLOCK, BLOCK = (1024, 1 << 22), (128, 1 << 18)
#: Parts into which the classes of a hot key are dealt.
_SALT = 64
#: Under keys of at most so many classes pairs are listed; under others they are compared in blocks.
FEW = 48
#: A class keeps so many bits of its digest below its rank.
_ID_BITS = 57
_ID = (1 << _ID_BITS) - 1
_BITMAP_BITS = 24


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's word hashes."""
    n = len(words)
    if not n:
        return words
    if n < width:
        x = np.array([n], np.uint64)
        for w in words:
            x = mixed(x * ODD[0] + w)
        return x
    x = words[: n - width + 1] * ODD[0]
    for i in range(1, width):
        x = (x ^ (x >> np.uint64(31))) * ODD[1] + words[i : n - width + 1 + i]
    return np.unique(mixed(x))


class Identity:
    """Names of sets: the low bits of a 128-bit digest, its high half where two digests share those."""

    def __init__(self, shared: frozenset[int] = frozenset(), mask: int = _ID):
        self.shared, self.mask = shared, mask

    def __call__(self, own: np.ndarray) -> tuple[int, int]:
        """A set's name, and the other half of its digest (signed)."""
        digest = xxhash.xxh3_128_intdigest(own.tobytes())
        name, other = digest & self.mask, digest >> 64
        if name in self.shared:
            name = other & self.mask
        return name, other - (1 << 64 if other >> 63 else 0)


def _bucket(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(own: np.ndarray) -> bytes:
    """A bit for each bucket of hashes that the set meets; two to four buckets a token."""
    level = (2 * len(own) - 1).bit_length()
    flags = np.zeros(1 << max(3, level), bool)
    flags[(own >> np.uint64(64 - max(3, level))).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def may_reach(x: bytes, nx: int, y: bytes, ny: int, percent: int) -> bool:
    """Whether two sets may reach the threshold: a bucket that one alone meets holds a token that the other lacks."""
    a, b = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
    while len(a) > len(b):
        a = a.reshape(-1, 2).max(1)
    while len(b) > len(a):
        b = b.reshape(-1, 2).max(1)
    both = int((a & b).sum())
    most = min(nx - (int(a.sum()) - both), ny - (int(b.sum()) - both))
    return 100 * most >= percent * (nx + ny - most)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n must share with any partner."""
    return -(-n * percent // 100)


class Signer:
    """Index keys of sets under one token order."""

    def __init__(self, sketch: np.ndarray, percent: int = PERCENT):
        self.sketch, self.percent = sketch, percent
        mean = float(sketch.mean()) if len(sketch) else 0.0
        self.frequent = mean + max(6.0, 4 * mean**0.5)
        self.bits = len(sketch).bit_length() - 1

    def tiers(self, n: int) -> list[int]:
        """Tiers in which a set of n tokens may meet a partner; -1: single tokens only."""
        def tier(size: float) -> int:
            return -1 if size < SMALL else int(np.log2(size / SMALL) // 2)

        return list(range(tier(n * self.percent / 100), tier(n * 100 / self.percent) + 1))

    def __call__(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys of a sorted set, which of them may be hot, and the set's rank (0 to 63) by its share of rare tokens."""
        n = len(own)
        count = self.sketch[_bucket(own, self.bits)].astype(np.int64)
        is_frequent = count > self.frequent
        order = np.lexsort((own, np.where(is_frequent, count, 0), is_frequent))
        tokens, frequent, full = own[order], is_frequent[order], count[order] >= FULL
        rare = n - int(frequent.sum())
        need = n - least_overlap(n, self.percent) + 1
        single = min(need, n if self.tiers(n) == [-1] else max(rare, 0))
        keys, hot = [mixed(tokens[:single])], [full[:single]]
        for tier in self.tiers(n):
            if tier < 0:
                keys.append(mixed(tokens[:need]))
                hot.append(full[:need])
            elif rare < need:
                groups = max(1, SMALL * 4**tier // 8)
                late, late_full = tokens[rare:], full[rare:]
                group = (mixed(late) % np.uint64(groups)).astype(np.int64)
                # the first token of a group adds no survivor, each further one adds one
                by = np.lexsort((np.arange(len(late)), group))
                first = np.zeros(len(late), bool)
                first[by] = np.concatenate([[True], group[by][1:] != group[by][:-1]])
                end = int(np.searchsorted(np.cumsum(~first), need - rare)) + 1
                by = np.lexsort((np.arange(end), group[:end]))
                late, late_full, group = late[by], late_full[by], group[by]
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                for a, b in zip(starts, np.append(starts[1:], end), strict=True):
                    i, j = np.triu_indices(b - a, 1)
                    keys.append(mixed(late[a:b][i] * ODD[0] ^ (late[a:b][j] + np.uint64(tier + 2)) * ODD[1]))
                    hot.append(late_full[a:b][i] & late_full[a:b][j])
        distinct, first = np.unique(np.concatenate(keys), return_index=True)
        return distinct, np.concatenate(hot)[first], min(63, 64 * rare // max(1, n))


class Counters:
    """What a task adds to the count sketch: a byte a counter, whatever the number of tokens."""

    def __init__(self, bits: int):
        self.bits, self.piece = bits, 1 << min(20, bits - 6)
        self.counts = np.zeros(1 << bits, np.uint8)

    def add(self, tokens: np.ndarray) -> None:
        """Count tokens, up to FULL each counter."""
        at, many = np.unique(_bucket(tokens, self.bits), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + many, FULL)

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        """The counters that are not 0, a piece of the sketch at a time."""
        for i, a in enumerate(range(0, len(self.counts), self.piece)):
            own = self.counts[a : a + self.piece]
            at = np.flatnonzero(own)
            if len(at):
                yield i, squeezed((at + a).astype(np.uint64), own[at])


def sketch_bits(docs: DataFrame, text_col: str) -> int:
    """The size of the sketch, by the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return min(MOST_SKETCH_BITS, max(16, (int(size) // SKETCH_BYTES).bit_length()))


def sets(docs: DataFrame, *, id_col: str, text_col: str, width: int, bits: int, identity: Identity | None = None) -> DataFrame:
    """One pass: per row id, set size, class and bitmap; per task what it adds to the count sketch."""
    identity = identity or Identity()
    schema = extended(docs.select(F.col(id_col).alias("id")), "n long, class long, other long, bits binary, part int, counts binary")
    schema["id"].nullable = True  # rows of the sketch have no id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        hasher, seen, kind = WordHasher(), set(), None
        counters = Counters(bits)

        for b in batches:
            kind = b.column(0).type
            own = [shingles(hasher(t), width) for t in b.column(1).to_pylist()]
            named = [identity(x) if len(x) else (None, None) for x in own]
            fresh = []
            for x, (name, _) in zip(own, named, strict=True):
                if name is not None and name not in seen:
                    seen.add(name)
                    fresh.append(x)
            if fresh:
                counters.add(np.concatenate(fresh))
            n = len(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, own)), pa.int64()), pa.array([x for x, _ in named], pa.int64()), pa.array([y for _, y in named], pa.int64()), pa.array([bitmap(x) if len(x) else None for x in own], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=schema.names)
        for i, raw in counters.pieces():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array([i], pa.int32()), pa.array([raw], pa.binary())], names=schema.names)

    return written(docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema), "sets")


def _sketch(table: DataFrame, bits: int) -> np.ndarray:
    size = 1 << min(20, bits - 6)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        part, total = int(rows["part"].iloc[0]), np.zeros(size, np.int64)
        for raw in rows["counts"]:
            keys, many = unsqueezed(raw)
            total[keys.astype(np.int64) - part * size] += many
        return pd.DataFrame({"part": [part], "counts": [np.minimum(total, FULL).astype(np.uint8).tobytes()]})

    out = np.zeros(1 << bits, np.uint8)
    for r in table.filter("counts is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r["counts"], np.uint8)
    return out


def _named_apart(table: DataFrame, mask: int = _ID, most: int = 1 << 20) -> tuple[DataFrame, Identity]:
    """The rows of :func:`sets` under names that no two digests share, and the naming."""
    own = table.filter("counts is null").select("id", "n", "class", "other", "bits")
    two = lambda t: t.filter("n > 0").groupBy("class").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo <> hi").select("class")
    shared = [r[0] for r in two(own).limit(most + 1).collect()]  # expected: rows ** 2 / 2 ** 58
    if not shared:
        return own, Identity(mask=mask)
    if len(shared) > most:
        raise RuntimeError("too many sets share a name")
    again = F.broadcast(table.sparkSession.createDataFrame([(x,) for x in shared], "class long").withColumn("again", F.lit(True)))
    own = own.join(again, "class", "left").withColumn("class", F.when(F.col("again"), F.col("other").bitwiseAND(mask)).otherwise(F.col("class"))).drop("again")
    if two(own).limit(1).collect():
        raise RuntimeError("two sets share a name")
    return own, Identity(frozenset(shared), mask)


def index(docs: DataFrame, sketch: np.ndarray, identity: Identity, *, text_col: str, width: int, percent: int) -> DataFrame:
    """Rows (key, code, hot): a set's keys, and its class under its rank."""
    shipped = docs.sparkSession.sparkContext.broadcast(sketch)  # a byte a counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        hasher, seen, sign = WordHasher(), set(), Signer(shipped.value, percent)
        for b in batches:
            keys, hots, codes, many = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [], []
            for t in b.column(0).to_pylist():
                own = shingles(hasher(t), width)
                if not len(own) or (cls := identity(own)[0]) in seen:
                    continue
                seen.add(cls)
                k, hot, rank = sign(own)
                keys.append(k)
                hots.append(hot)
                codes.append(rank << _ID_BITS | cls)
                many.append(len(k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(codes, np.int64), many)), pa.array(np.concatenate(hots))], names=["key", "code", "hot"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key long, code long, hot boolean")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, code), the distinct ones of keys with two codes or more, with the least code; all distinct ones of hot keys, without it."""
    def shared(k: np.ndarray, c: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c, hot = k[new], c[new], hot[new]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(k)))
        pivot, keep = np.repeat(c[start], size), np.repeat(size > 1, size) | hot
        return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(c[keep]), pa.array(pivot[keep], mask=hot[keep])], names=["key", "code", "pivot"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    for b in batches:
        if b.num_rows:
            held = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, b.columns, strict=True)]
            end = len(held[0]) if held[2][-1] else int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
            yield shared(*(x[:end] for x in held))
            held = [x[end:] for x in held]
    yield shared(*held)


def _met(indexed: DataFrame) -> DataFrame:
    """Rows (key, class, pivot) of all keys with two classes or more; written."""
    salt = F.when(F.col("hot"), F.pmod("code", F.lit(_SALT))).otherwise(0)
    dealt = indexed.repartition("key", salt).sortWithinPartitions("key", "code")
    with _batches_of(indexed.sparkSession, 1 << 14):
        found = written(dealt.mapInArrow(_runs, "key long, code long, pivot long"), "runs")
    hot = found.filter("pivot is null").select("key", "code")
    least = hot.groupBy("key").agg(F.min("code").alias("pivot"), F.max("code").alias("last")).filter("pivot < last").select("key", "pivot")
    both = found.filter("pivot is not null").unionByName(hot.join(least, "key"))
    return written(both.select("key", F.col("code").bitwiseAND(_ID).alias("class"), F.col("pivot").bitwiseAND(_ID).alias("pivot")), "met")


def _chosen_sets(docs: DataFrame, wanted: DataFrame, identity: Identity, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """Sets (``class``, ``tokens``) of documents among ``wanted`` ids, found through a bitmap of fixed size; written."""
    h = F.pmod(F.xxhash64(F.col("id")), F.lit(1 << _BITMAP_BITS))
    words = wanted.select(F.shiftright(h, 6).alias("w"), (h % 64).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).collect()
    bitmap = np.zeros(1 << (_BITMAP_BITS - 6), np.int64)
    for w, m in words:
        bitmap[w] = m
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)
    source = docs.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << _BITMAP_BITS)).alias("h"), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        hasher, seen, bits = WordHasher(), set(), shipped.value
        for b in batches:
            at = b.column(0).to_numpy()
            keep = (bits[at >> 6] >> (at & 63)) & 1 == 1
            cls, tokens = [], []
            for t in b.column(1).filter(pa.array(keep)).to_pylist():
                own = shingles(hasher(t), width)
                if len(own) and (c := identity(own)[0]) not in seen:
                    seen.add(c)
                    cls.append(c)
                    tokens.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(tokens, pa.binary())], names=["class", "tokens"])

    return written(source.mapInArrow(run, "class long, tokens binary"), "tokens")


@contextmanager
def _batches_of(spark, rows: int):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold; written."""
    first = found.select(F.col("class").alias("a"), F.col("tokens").alias("x"))
    second = found.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    same = int((x[at] == y).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with _batches_of(pairs.sparkSession, 64):
        return written(both.mapInArrow(run, "a long, b long"), "links")


def link_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All sets (id, n, class), the classes' roots (v, root), and the links (a, b) they rest on."""
    small_batches(docs.sparkSession)
    bits = sketch_bits(docs, text_col)
    table = sets(docs, id_col=id_col, text_col=text_col, width=width, bits=bits)
    own, identity = _named_apart(table)
    met = _met(index(docs, _sketch(table, bits), identity, text_col=text_col, width=width, percent=percent))
    stars = met.filter("class <> pivot").select(F.greatest("class", "pivot").alias("a"), F.least("class", "pivot").alias("b")).distinct()
    size = own.filter("n > 0").groupBy("class").agg(F.max("n").alias("n"), F.max("id").alias("id"), F.max("bits").alias("bits"))
    size = written(met.select("class").distinct().join(size, "class"), "met-classes")
    first = _near(stars, size, percent)
    find = lambda classes: _chosen_sets(docs, size.join(classes.distinct(), "class").select("id"), identity, id_col=id_col, text_col=text_col, width=width)
    found = find(_ends(first))
    links = verified(first, found, percent)
    discard(found)
    roots = written(components(links), "roots")
    rooted = met.join(roots.withColumnRenamed("v", "class"), "class", "left")
    rooted = written(rooted.select("key", "pivot", "class", F.coalesce("root", "class").alias("root")), "rooted")
    discard(met)
    spread = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi and m > 2")
    open_keys = written(spread.select("key", "m"), "open-keys")
    few = _few(rooted, open_keys.filter(F.col("m") <= FEW), size, percent).join(first, ["a", "b"], "left_anti")
    few = _near(few, size, percent)
    many = rooted.join(open_keys.filter(F.col("m") > FEW).select("key"), "key").select("pivot", "class", "root").distinct()
    many = _candidates(written(many, "many"), size, percent)
    discard(rooted)
    found = find(_ends(few).unionByName(many.select("class")))
    links = links.unionByName(verified(few, found, percent)).unionByName(_across(many, found, percent))
    discard(found)
    return own.select("id", "n", "class"), components(links), links


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))


def _near(pairs: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and then bitmaps do not rule out; written."""
    n = lambda c, *more: size.select(F.col("class").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", *more)])
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    pairs = written(pairs.join(n("a"), "a").join(n("b"), "b").filter(100 * low >= percent * high).select("a", "b"), "near-size")
    both = pairs.join(n("a", "bits"), "a").join(n("b", "bits"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many, raw = [c.to_pylist() for c in (b.column(2), b.column(4))], [c.to_pylist() for c in (b.column(3), b.column(5))]
            keep = [may_reach(x, nx, y, ny, percent) for nx, x, ny, y in zip(many[0], raw[0], many[1], raw[1], strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = written(both.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a long, b long"), "near")
    discard(pairs)
    return out


def _few(rooted: DataFrame, keys: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components under keys of few classes, sizes allowing."""
    own = rooted.join(keys.select("key"), "key").join(size.select("class", "n"), "class")
    own = written(own.select("key", "class", "root", "n"), "few-classes")
    x, y = own.alias("x"), own.alias("y")
    near = (F.col("x.class") > F.col("y.class")) & (F.col("x.root") != F.col("y.root")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & near).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def _blocks(rooted: DataFrame, block: tuple[int, int]) -> DataFrame:
    """Deal the classes that met one pivot to block pairs: rows (pivot, band, kind, i, j, class, root).

    Partners differ in size by less than the width of a band, so a set meets
    those of its own band and of the next; each band is a group of its own.
    Only pairs of different components matter. The members of a group's largest
    component (M) therefore meet only the rest (R), and the rest meet each
    other; both are dealt by a hash into blocks of about ``block`` classes and tokens.
    """
    size = lambda c: F.ceil(F.greatest(F.col(f"{c}.c") / block[0], F.col(f"{c}.t") / block[1])).cast("int")
    rooted = rooted.withColumn("band", F.explode(F.array(F.col("own_band"), F.col("own_band") - 1)))
    parts = rooted.groupBy("pivot", "band", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    groups = parts.groupBy("pivot", "band").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.max(F.struct("c", "root", "t")).alias("main"))
    groups = groups.filter("main.c < c").withColumn("rest", F.struct((F.col("c") - F.col("main.c")).alias("c"), (F.col("t") - F.col("main.t")).alias("t")))
    groups = groups.select("pivot", "band", F.col("main.root").alias("main"), size("main").alias("nm"), size("rest").alias("nr"))
    own = rooted.join(written(groups, "groups"), ["pivot", "band"])
    main = F.col("root") == F.col("main")
    own = own.withColumn("block", F.pmod(F.xxhash64("class"), F.when(main, F.col("nm")).otherwise(F.col("nr"))).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    of_main = F.transform(each("nr"), lambda r: cell("M", F.col("block"), r))
    of_rest = F.concat(
        F.transform(each("nm"), lambda m: cell("M", m, F.col("block"))),
        F.transform(each("nr"), lambda r: cell("R", F.least(r, F.col("block")), F.greatest(r, F.col("block")))),
    )
    dealt = own.withColumn("x", F.explode(F.when(main, of_main).otherwise(of_rest)))
    return dealt.select("pivot", "band", "x.kind", "x.i", "x.j", "class", "root")


_CELL = ("pivot", "band", "kind", "i", "j")


def _candidates(rooted: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Of the classes that met one pivot (pivot, class, root), those whose bitmaps allow a partner of another component; written, with their band."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    banded = written(rooted.join(size.select("class", "n", band.alias("own_band")), "class"), "banded")
    dealt = _blocks(banded, BITS_BLOCK).join(size.select("class", "n", "bits"), "class")

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        root, n = rows["root"].to_numpy(), rows["n"].to_numpy().astype(np.float32)
        flags = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in rows["bits"]]
        least = min(map(len, flags))
        flags = np.stack([x.reshape(least, -1).max(1) for x in flags])
        weight = flags.sum(1, dtype=np.float32)
        some = np.zeros(len(n), bool)
        for a in range(0, len(n), 256):  # so many rows at a time, so many buckets at a time: memory stays small
            own = slice(a, a + 256)
            both = sum(flags[own, c : c + 4096].astype(np.float32) @ flags[:, c : c + 4096].T.astype(np.float32) for c in range(0, least, 4096))
            spare = np.minimum((n - weight)[own, None], (n - weight)[None, :]) + both
            some[own] = ((100 * spare >= percent * (n[own, None] + n[None, :] - spare)) & (root[own, None] != root[None, :])).any(1)
        return rows.loc[some, ["pivot", "class", "root"]]

    found = dealt.groupBy(*_CELL).applyInPandas(check, "pivot long, class long, root long").distinct()
    return written(found.join(banded, ["pivot", "class", "root"]), "candidates")


def overlaps(sets: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Common tokens of each two sets."""
    tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    number = np.cumsum(first) - 1
    many = np.bincount(number)[number] > 1  # a token of one set is common to none
    _, number = np.unique(number[many], return_inverse=True)
    row = row[many]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        lo, hi = np.searchsorted(number, [a, a + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[lo:hi], number[lo:hi] - a] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def _across(candidates: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between classes that met one pivot and lie in different components, as far as they merge components."""
    dealt = written(_blocks(candidates, BLOCK), "dealt")

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("class")  # copies of a text may bring its set twice
        own = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
        n, root, cls = np.array(list(map(len, own))), rows["root"].to_numpy(), rows["class"].to_numpy()
        same = overlaps(own)
        near = (100 * same >= percent * (n[:, None] + n[None, :] - same)) & (root[:, None] != root[None, :])
        leader = {r: r for r in root.tolist()}
        links = []
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            a, b = root[i], root[j]
            while leader[a] != a:
                a = leader[a]
            while leader[b] != b:
                b = leader[b]
            if a != b:
                leader[a] = b
                links.append((cls[i], cls[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return written(dealt.join(found, "class").groupBy(*_CELL).applyInPandas(check, "a long, b long"), "links")


def clustered(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (the component's smallest id)."""
    own, roots, _ = link_classes(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    smallest = own.filter("class is not null").groupBy("class").agg(F.min("id").alias("id"))
    lifted = written(smallest.join(roots.withColumnRenamed("v", "class"), "class", "left").select("class", F.coalesce("root", "class").alias("root"), "id"), "classes")
    ids = written(lifted.groupBy("root").agg(F.min("id").alias("component_id")), "component-ids")
    named = written(lifted.join(ids, "root").select("class", "component_id"), "class-ids")
    return own.join(named, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
