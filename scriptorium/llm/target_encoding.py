"""Time-ordered target encoding: what rows of other folds told of a key before this row's time.

A row is an event at a time, in a fold, with a count and a count of hits. For
each of its key columns a row asks how many events, and hits, its key had at
strictly earlier times in the other folds. All columns go through one scan:
events lie in one long table, dealt by ranges of (column, key, time) and sorted,
so that a key of any size is spread over as many chunks as it needs. Within a
chunk the folds of a key-time are pivoted into one vector of counts, vectors are
summed up by key, and each event takes the total minus its own fold's component
at the latest vector strictly before it. What a chunk's first key has in the
chunks before it comes from a table of the chunks' edges (three rows a chunk),
summed by key and added to the chunk's rows. Equal times that straddle chunks
are told apart from earlier ones by the edges' times.

A task holds a batch and one vector; the driver holds nothing; what is broadcast
is ten numbers a chunk, and there are as many chunks as
``spark.sql.shuffle.partitions`` says, however long the tables are.

Keys are longs (equal if equal) or anything else by 128 bits of hash; null is a
value of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import small_batches, written

FOLDS = 5
_OUT = "g int, key long, rid long, tag long, n long, s long, before_n long, before_s long, slot long, h long, t long, v array<long>"
_PLAIN, _EDGE, _FIRST = -1, -2, -3  # values of slot: no carry is due; a row of a chunk's edge; the chunk's first key


def long_form(events: DataFrame, columns: list[str], number: int, *, id_col: str, tag_col: str, time_col: str, fold_col: str, n_col: str, s_col: str) -> DataFrame:
    """A row for each event and key column; columns are numbered from ``number`` on."""
    kinds = {f.name: f.dataType for f in events.schema.fields}
    rows: list[Column] = []
    for g, c in enumerate(columns, number):
        exact = isinstance(kinds[c], (ByteType, ShortType, IntegerType, LongType))
        key = F.col(c).cast("long") if exact else F.xxhash64(F.col(c), F.lit(7))
        rows += [F.lit(g), F.xxhash64(F.lit(g), F.col(c)), key]
    own = [F.col(c).alias(a) for c, a in ((id_col, "rid"), (tag_col, "tag"), (time_col, "t"), (n_col, "n"), (s_col, "s"))]
    return events.select(F.stack(F.lit(len(columns)), *rows).alias("g", "h", "key"), *own, F.col(fold_col).cast("int").alias("fold"))


def scanned(long: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(g, key, rid, tag, n, s, before_n, before_s): the long table with the history of each row, written to the shared folder."""
    small_batches(long.sparkSession)
    order = ("h", "g", "key", "t", "rid")
    chunks = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = long.repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    rows = written(dealt.mapInArrow(lambda batches: _scan(batches, folds), _OUT), "target-scan")

    edges = rows.filter(F.col("slot") <= _EDGE).select("slot", F.col("rid").alias("chunk"), "h", "g", "key", "t", *(F.col("v")[i].alias(f"v{i}") for i in range(2 * folds)))
    of = Window.partitionBy("h", "g", "key")
    passed = [of.orderBy("t").rangeBetween(Window.unboundedPreceding, -1), of.orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)]
    for later, window in enumerate(passed):  # before the chunk's first time, and before the chunk
        edges = edges.select("*", *(F.coalesce(F.sum(f"v{i}").over(window), F.lit(0)).alias(f"c{later}_{i}") for i in range(2 * folds)))
    both = []
    for f in range(folds):
        for later in (0, 1):
            n, s = (sum((F.col(f"c{later}_{i + at}") for i in range(folds) if i != f), F.lit(0)) for at in (0, folds))
            both.append(F.struct((F.col("chunk") * 2 * folds + 2 * f + later).alias("slot"), n.cast("long").alias("carry_n"), s.cast("long").alias("carry_s")))
    carry = edges.filter(F.col("slot") == _FIRST).select(F.inline(F.array(*both)))
    own = rows.filter(F.col("slot") > _EDGE).join(F.broadcast(carry), "slot", "left")
    total = [(F.col(f"before_{x}") + F.coalesce(f"carry_{x}", F.lit(0))).alias(f"before_{x}") for x in "ns"]
    return own.select("g", "key", "rid", "tag", "n", "s", *total)


def _scan(batches: Iterator[pa.RecordBatch], folds: int) -> Iterator[pa.RecordBatch]:
    chunk, width = TaskContext.get().partitionId(), 2 * folds
    names = [c.split()[0] for c in _OUT.split(", ")]
    last, first = None, None  # (h, g, key, t, whether key is null) of the last row and of the first one
    before, run = np.zeros(width, np.int64), np.zeros(width, np.int64)  # up to the last row's key-time; of that key-time
    in_first_key = in_first_run = True
    for b in batches:
        if not b.num_rows:
            continue
        col = {c: b.column(c) for c in b.schema.names}
        g, h, t = (col[c].cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("g", "h", "t"))
        key = col["key"].fill_null(0).to_numpy(zero_copy_only=False)
        fold, n, s = (col[c].to_numpy(zero_copy_only=False) for c in ("fold", "n", "s"))
        if last is None:
            first = (h[0], g[0], key[0], t[0])
        was = last or (None,) * 4
        differs = lambda a, k: np.concatenate([[was[k] is None or a[0] != was[k]], a[1:] != a[:-1]])  # noqa: B023, E731
        new_key = differs(h, 0) | differs(g, 1) | differs(key, 2)
        new_run = new_key | differs(t, 3)
        at = np.cumsum(new_run)  # 0: the key-time that the batch before ended in
        runs = int(at[-1]) + 1
        vector = np.hstack([np.bincount(at * folds + fold, weights=w, minlength=runs * folds).reshape(runs, folds) for w in (n, s)]).astype(np.int64)
        vector[0] += run
        passed = np.cumsum(vector, axis=0) - vector
        begins = np.zeros(runs, np.int64)
        begins[at[new_key]] = at[new_key]
        begins = np.maximum.accumulate(begins)
        prefix = passed - passed[begins]
        prefix[begins == 0] += before
        rows = np.arange(len(at))
        told = prefix[at]
        before_n = told[:, :folds].sum(1) - told[rows, fold]
        before_s = told[:, folds:].sum(1) - told[rows, folds + fold]
        slot = np.full(len(at), _PLAIN, np.int64)
        seen = 1 if last is None else 0
        if in_first_key:
            carried = np.cumsum(new_key) == seen
            early = np.cumsum(new_run) == seen if in_first_run else np.zeros(len(at), bool)
            slot[carried] = chunk * width + 2 * fold[carried] + ~early[carried]
            in_first_key, in_first_run = bool(carried[-1]), bool(early[-1])
        last, before, run = (h[-1], g[-1], key[-1], t[-1]), prefix[-1].copy(), vector[-1].copy()
        none = pa.nulls(len(at))
        yield pa.RecordBatch.from_arrays([col["g"].cast(pa.int32()), col["key"], col["rid"], col["tag"], col["n"], col["s"], *(pa.array(x, pa.int64()) for x in (before_n, before_s, slot)), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))], names=names)
    if last is not None:
        edges = [(_FIRST, *first, np.zeros(width, np.int64)), (_EDGE, *last[:3], last[3] - 1, before), (_EDGE, *last, run)]
        slot, h, g, key, t, v = zip(*edges, strict=True)
        longs = lambda x: pa.array([int(i) for i in x], pa.int64())
        zero = longs([0] * 3)
        yield pa.RecordBatch.from_arrays([longs(g).cast(pa.int32()), longs(key), longs([chunk] * 3), zero, zero, zero, zero, zero, longs(slot), longs(h), longs(t), pa.array([x.tolist() for x in v], pa.list_(pa.int64()))], names=names)


def rate(n: Column, s: Column, prior: Column, *, weight: int = 50, scale: int = 1_000_000) -> Column:
    """floor((scale * s + weight * prior) / (n + weight)) in longs; the prior where there is no event."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", F.lit(scale).cast("long") * s + F.lit(weight) * prior, n + F.lit(weight)))


def encoded_lines(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, *, hit: str = "returned", prior: int = 500_000) -> DataFrame:
    """Rates of returns of each sold line's item, vendor and client, smoothed towards those of its kind, nation and segment.

    A row for each sale, item and vendor: sale_id, item_id, vendor_id, n_lines,
    n_returned, and (n, rate) by item, vendor and client. Lines without a sale, or
    whose sale has no time, go; null item_id and client_id become -1; a null
    vendor_id is a value of its own, as are all kinds, nations and segments that
    are null or unknown together. Repeated lines count each; a sale_id that
    several sales have gives its lines to each; where a dimension repeats an id,
    its least value counts. Empty tables give an empty one.
    """

    def dim(table: DataFrame, key: str, value: str) -> DataFrame:
        # written: a join right on the exchange of its groups could not be split where a key is common
        return written(table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value)), f"target-{key}").hint("shuffle_hash")

    fold = F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    sold = sales.filter(F.col("sale_id").isNotNull() & F.col("sold_at").isNotNull()).select("sale_id", F.coalesce(F.col("client_id").cast("long"), F.lit(-1)).alias("client_id"), F.col("sold_at").alias("t"), fold.alias("fold"))
    sold = sold.join(dim(clients, "client_id", "segment"), "client_id", "left").withColumn("sale_row", F.monotonically_increasing_id())
    sold = written(sold, "target-sales")
    own = lines.filter(F.col("sale_id").isNotNull()).groupBy("sale_id", F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "vendor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flag") == hit).alias("s"))
    own = own.join(dim(items, "item_id", "kind"), "item_id", "left").join(dim(vendors, "vendor_id", "nation_id"), "vendor_id", "left")
    own = own.join(sold.hint("shuffle_hash"), "sale_id").withColumn("rid", F.monotonically_increasing_id())
    own = written(own, "target-lines")

    by_line, by_sale = ["item_id", "vendor_id", "kind", "nation_id"], ["client_id", "segment", "whole"]
    names = by_line + by_sale
    told = {"time_col": "t", "fold_col": "fold", "n_col": "n", "s_col": "s"}
    whole = own.groupBy("sale_row", "sale_id", "client_id", "segment", "t", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("whole", F.lit(0))
    long = long_form(own, by_line, 0, id_col="rid", tag_col="sale_row", **told).unionByName(long_form(whole, by_sale, len(by_line), id_col="sale_row", tag_col="sale_id", **told))
    rows = scanned(long)

    at = lambda name, value: F.max(F.when(F.col("g") == names.index(name), F.col(value)))
    counts = lambda columns: [at(c, f"before_{x}").alias(f"{c}_{x}") for c in columns for x in "ns"]
    lines_told = rows.filter(F.col("g") < len(by_line)).groupBy("rid").agg(at("item_id", "tag").alias("sale_row"), at("item_id", "key").alias("item_id"), at("vendor_id", "key").alias("vendor_id"), at("item_id", "n").alias("n_lines"), at("item_id", "s").alias("n_returned"), *counts(by_line))
    sales_told = rows.filter(F.col("g") >= len(by_line)).groupBy(F.col("rid").alias("sale_row")).agg(at("whole", "tag").alias("sale_id"), *counts(by_sale))
    sales_told = written(sales_told, "target-sales-told")  # as the dimensions: so that a sale of very many lines is split
    both = lines_told.join(sales_told.hint("shuffle_hash"), "sale_row")
    rated = lambda c, prior: rate(F.col(f"{c}_n"), F.col(f"{c}_s"), prior)
    both = both.withColumn("p", rated("whole", F.lit(prior).cast("long")))
    out = ["sale_id", "item_id", F.col("vendor_id").cast(lines.schema["vendor_id"].dataType), "n_lines", "n_returned"]
    for c, short, parent in (("item_id", "item", "kind"), ("vendor_id", "vendor", "nation_id"), ("client_id", "client", "segment")):
        out += [F.col(f"{c}_n").alias(f"{short}_n"), rated(c, rated(parent, F.col("p"))).alias(f"{short}_rate")]
    return both.select(*out)
