"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule maps a text to a whole level from 0 to 100. Within a stratum
(language) a level's rank is the permille of all texts of the stratum with a
smaller level; no label enters it. A text's severity is its highest rank under
any rule, so one cutoff on the severity is a cutoff for every rule, and all
rules together have one family of cutoffs a stratum.

Cutoffs are tested on the labelled texts from lenient to strict. A cutoff is
certified if the exact binomial tail P(Bin(n, risk) <= k) of its k false
rejections among the n good texts is at most ``delta`` divided by the number of
strata (Bonferroni); the tail grows along the order, so the sequence itself
needs no correction. Of the certified cutoffs the one with the best balance of
bad and good texts rejected is taken, the most lenient one on a tie. With
probability 1 - ``delta`` no stratum loses more than ``risk`` of its good texts
to the rules. A stratum needs ln(delta / strata) / ln(1 - risk) good labels
(about 220 for four strata); one with fewer gets no cutoff.

Defined results: a null text has no words and fails the base rule; a null
language is a stratum of its own; a null id has no label; a text with several
labels counts with the lowest, and a label of an id on several rows counts for
each; repeated rows get the same verdict; texts of any length are measured
whole; levels and severities at a cutoff are kept; without labels only the base
rule rejects; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "marks", "dup_lines", "repeats")
RISK = 0.02
DELTA = 0.05


def _long(c: Column) -> Column:
    return c.cast("long")


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def measured(docs: DataFrame, text_col: str = "text", into: str = "_q") -> DataFrame:
    """``docs`` with a struct of counts and rule levels."""
    t, w, s, f = (f"{into}_{x}" for x in "twsf")
    gap = r"[\x20\x09-\x0D]+"
    out = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumn(w, F.filter(F.split(t, gap), lambda x: x != ""))
    # windows by hash, neighbours in hash order are the repeats
    window = F.transform(
        F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    out = out.withColumn(s, F.sort_array(window))

    def again(x: Column, j: Column) -> Column:
        h = x["h"]
        return F.when((h == F.get(s, j - 1)["h"]) | (h == F.get(s, j + 1)["h"]), x["i"])

    out = out.withColumn(f, F.filter(F.transform(s, again), lambda x: x.isNotNull()))
    covered = F.array_distinct(F.concat(F.col(f), F.transform(f, lambda x: x + 1), F.transform(f, lambda x: x + 2)))
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, SPACE) != "")
    # explode of one struct: a generated column is computed once, whatever filters follow
    out = out.withColumn(s, lines).withColumn(
        into,
        _once(
            _long(F.size(w)).alias("n_words"),
            _long(F.length(_without(F.col(t), SPACE))).alias("word_chars"),
            _long(F.length(t) - F.length(_without(F.col(t), SYMBOLS))).alias("n_symbols"),
            _long(F.size(s) - F.size(F.array_distinct(s))).alias("n_dup_lines"),
            _long(F.size(covered)).alias("n_repeat_words"),
            _long(F.size(s)).alias("n_lines"),
            _long(F.length(t) - F.length(_without(F.col(t), "!?"))).alias("n_marks"),
        ),
    )
    return out.drop(t, w, s, f)


def _once(*columns: Column) -> Column:
    return F.explode(F.array(F.struct(*columns)))


def base_failed(q: str = "_q") -> Column:
    """Under 50 words, or more than half of them in repeated windows."""
    n = F.col(f"{q}.n_words")
    return (n < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * n)


def levels(q: str = "_q") -> dict[str, Column]:
    """Each rule's level, a whole number from 0 to 100."""
    def share(part: str, of: str) -> Column:
        whole = F.greatest(F.col(f"{q}.{of}"), F.lit(1))
        return F.least(F.floor(100 * F.col(f"{q}.{part}") / whole), F.lit(100)).cast("int")

    parts = {"symbols": ("n_symbols", "n_words"), "marks": ("n_marks", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    return {rule: share(*parts[rule]) for rule in RULES}


def _tail(n: Column, k: Column, limit: float, enough: float) -> Column:
    """P(Bin(n, limit) <= k), exact where it matters.

    Above the mean it is over any level used here (1 is returned); where the
    Chernoff bound is already under ``enough`` that bound is returned.
    """
    odds, share = math.log(limit / (1 - limit)), k / n
    kl = F.when(k > 0, share * F.log(share / limit)).otherwise(F.lit(0.0)) + (1 - share) * F.log((1 - share) / (1 - limit))
    first = n * F.lit(math.log1p(-limit))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(acc["total"] - high) + F.exp(term - high))).alias("total"))

    exact = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("term"), first.alias("total")), step, lambda acc: F.exp(acc["total"]))
    chernoff = F.exp(-n * kl)
    return F.when(k >= n * limit, F.lit(1.0)).when(chernoff <= enough, chernoff).otherwise(exact)


def _stratum(c: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("stratum"), F.col(c).isNull().alias("unnamed")]


def certificates(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row a stratum that has a certified cutoff: the cutoff's severity, the good texts (``n``), those it rejects (``k``), the bad texts rejected (``hit``) of ``n_bad``, the ``tail`` and its bound, a column a rule with its greatest level kept.

    ``stats`` has the id, the stratum and the struct of :func:`measured`.
    """
    own = ["stratum", "unnamed"]
    levelled = stats.filter(~base_failed()).select(F.col(id_col).alias("_k"), *_stratum(stratum_col), *[c.alias(r) for r, c in levels().items()])
    lifted = levelled.select(*own, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES])).alias("x")).select(*own, "x.rule", "x.level")
    texts = lifted.groupBy(*own, "rule", "level").agg(F.count(F.lit(1)).alias("texts"))
    all_of = Window.partitionBy(*own, "rule")
    below = F.coalesce(F.sum("texts").over(all_of.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = written(texts.select(*own, "rule", "level", F.floor(1000 * below / F.sum("texts").over(all_of)).cast("int").alias("rank")), "quality-ranks")
    # at most 101 levels a rule
    ranks = ranked.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "rule", "level"), "rank"))).alias("ranks"))
    good = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_k")).agg(F.min(label_col).alias("_good"))
    severity = F.greatest(*[F.element_at("ranks", F.concat_ws(":", F.lit(r), F.col(r))) for r in RULES])
    counted = levelled.join(good, "_k").join(ranks, own).groupBy(*own, severity.alias("severity")).agg(F.sum((F.col("_good") == 1).cast("long")).alias("good"), F.sum((F.col("_good") == 0).cast("long")).alias("bad"))
    counted = written(counted, "quality-counts")
    enough = delta / max(1, counted.select(*own).distinct().count())
    each = Window.partitionBy(*own)
    above = each.orderBy(F.desc("severity")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    cut = counted.withColumn("n", F.sum("good").over(each)).withColumn("n_bad", F.sum("bad").over(each)).withColumn("k", F.coalesce(F.sum("good").over(above), zero)).withColumn("hit", F.coalesce(F.sum("bad").over(above), zero))
    certified = cut.filter(F.col("n") > 0).withColumn("tail", _tail(F.col("n"), F.col("k"), risk, enough)).filter((F.col("tail") <= enough) & (F.col("hit") > 0))
    balance = F.col("hit") / F.greatest(F.col("n_bad"), F.lit(1)) - F.col("k") / F.col("n")
    best = certified.groupBy(*own).agg(F.max_by(F.struct("severity", "n", "k", "hit", "n_bad", "tail"), F.struct(balance, F.col("severity"))).alias("best")).select(*own, "best.*", F.lit(enough).alias("bound"))
    kept = ranked.join(best.select(*own, "severity"), own).filter(F.col("rank") <= F.col("severity")).groupBy(*own).agg(*[F.max(F.when(F.col("rule") == r, F.col("level"))).alias(f"cut_{r}") for r in RULES])
    return best.join(kept, own)


def thresholds(stats: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The cutoffs of :func:`certificates` alone: a row a certified stratum, a column a rule."""
    return certificates(stats, labels, **options).select("stratum", "unnamed", *[f"cut_{r}" for r in RULES])


def judged(docs: DataFrame, cutoffs: DataFrame, *, stratum_col: str = "lang") -> DataFrame:
    """Rows of :func:`measured` with ``_base_failed`` and ``_kept``.

    The cutoffs may be broadcast: a stratum is among them only if some hundreds
    of labelled texts certify it (the tail of fewer cannot be small).
    """
    c = cutoffs.select(F.col("stratum").alias("_stratum"), F.col("unnamed").alias("_unnamed"), *[F.col(f"cut_{r}").alias(f"_cut_{r}") for r in RULES])
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    joined = docs.join(F.broadcast(c), (stratum == F.col("_stratum")) & (F.col(stratum_col).isNull() == F.col("_unnamed")), "left")
    over = F.lit(False)
    for r, level in levels().items():
        over = over | F.coalesce(level > F.col(f"_cut_{r}"), F.lit(False))
    return joined.withColumn("_base_failed", base_failed()).withColumn("_kept", ~base_failed() & ~over).drop(*c.columns)


def rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row: id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``.

    Texts are measured once; the small table of counts then serves both the
    choice of cutoffs and the verdicts.
    """
    stats = written(measured(docs.select(F.col(id_col).alias("_id"), F.col(stratum_col).alias("_lang"), F.col(text_col).alias("_text")), "_text").drop("_text"), "quality-stats")
    cutoffs = thresholds(stats, labels.select(F.col(id_col).alias("_id"), "quality"), id_col="_id", stratum_col="_lang")
    out = judged(stats, cutoffs, stratum_col="_lang")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_q.{n}").alias(n) for n in names], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    Texts are measured once: rows are written beside their counts, from which
    both the cutoffs and the verdicts are read.
    """
    row = docs.select(F.struct("*").alias("_row"))
    row = row.select("_row", F.col(f"_row.{text_col}").alias("_text"), F.col(f"_row.{stratum_col}").alias("_lang"), F.col(f"_row.{id_col}").alias("_id"))
    stats = written(measured(row, "_text").drop("_text"), "quality-rows")
    cutoffs = thresholds(stats, labels.select(F.col(id_col).alias("_id"), "quality"), id_col="_id", stratum_col="_lang")
    return judged(stats, cutoffs, stratum_col="_lang").filter("_kept").select("_row.*")
