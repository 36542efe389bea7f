"""Quality rules with risk-controlled cutoffs.

Each rule rejects texts whose metric exceeds a cutoff. All rules of a stratum are tightened together along one fixed
sequence of moves, from lenient to strict: each move sets the next cutoff of one rule. A move is taken as long as an exact
binomial test on texts labelled good shows that all rules together, so set, reject at most a given share of the good texts
of the stratum. The first move without proof ends the sequence, so that its tests need no correction among each other;
between strata the error is split evenly (Bonferroni).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .common import cut

METRICS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_distinct_words long"
#: Rule: metric and the cutoffs that are tested in this order. They don't depend on the data.
GRID: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "repeat_words": ("n_repeat_words / greatest(n_words, 1)", (0.28, 0.24, 0.2, 0.15, 0.1)),
    "few_distinct": ("1 - n_distinct_words / greatest(n_words, 1)", (0.99, 0.98, 0.96, 0.94, 0.92, 0.9)),
    "long_words": ("word_chars / greatest(n_words, 1)", (40.0, 25.0, 18.0, 14.0, 12.0, 10.0)),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ta.chunks(batches, limit=1 << 18):
        data, offs = ta.as_bytes(batch.column(2))
        n = batch.num_rows
        start, end, doc = ta.words(data, offs)
        prints = ta.Prints(data)
        w = prints.of(start, end)
        per = lambda d, keep=slice(None): np.bincount(d[keep], minlength=n).astype(np.int64)
        solid = ~ta._SPACE[data]
        _, again = ta.repeats(ta.in_doc(w, doc))
        ls, le, ld = ta.lines(data, offs)
        worded = ta.counts(solid, ls, le) > 0
        ls, le, ld = ls[worded], le[worded], ld[worded]
        _, dup = ta.repeats(ta.in_doc(prints.of(ls, le), ld))
        g, first = ta.grams(w, doc, 8)
        twice, _ = ta.repeats(ta.in_doc(g, doc[first]))
        cover = np.zeros(len(w) + 9, np.int64)
        np.add.at(cover, first[twice], 1)
        np.add.at(cover, first[twice] + 8, -1)
        covered = np.cumsum(cover)[: len(w)] > 0
        cols = [per(doc), ta.counts(solid & ((data & 0xC0) != 0x80), offs[:-1], offs[1:]), ta.counts(_SYMBOL[data], offs[:-1], offs[1:]), per(ld), per(ld, dup), per(doc, covered), per(doc, ~again)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols)], ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words"])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exactly summed."""
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs - logs.max()).sum() * math.exp(logs.max())))


def moves() -> list[tuple[str, float]]:
    """(rule, cutoff) in the order in which they are tested: one step of every rule, then the next of every rule."""
    return [(rule, xs[i]) for i in range(max(len(xs) for _, xs in GRID.values())) for rule, (_, xs) in GRID.items() if i < len(xs)]


def first_move() -> Column:
    """The number of the first move that rejects a text; null if none does."""
    at = {rule: [k for k, (r, _) in enumerate(moves()) if r == rule] for rule in GRID}
    return F.least(*[F.coalesce(*[F.when(F.expr(m) > x, F.lit(k)) for k, x in zip(at[rule], xs)]) for rule, (m, xs) in GRID.items()])


def proven(rejected: list[int], n: int, share: float, level: float) -> int:
    """The moves that are proven: rejected[k] of n good texts are rejected by move k first."""
    total = 0
    for k, more in enumerate(rejected):
        total += more
        if binomial_tail(total, n, share) > level:
            return k
    return len(rejected)


def cutoffs(good: DataFrame, max_rejected: float = 0.05, error: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff from the metrics of texts labelled good; a rule without a proven cutoff has no row.

    Together the rules of a stratum reject at most max_rejected of its good texts, for all strata at once with
    probability 1 - error. Strata of so few labelled texts that nothing could be proven take no part of the error.
    """
    steps = moves()
    counted = good.select("stratum", F.coalesce(first_move(), F.lit(len(steps))).alias("move")).groupBy("stratum", "move").count()
    held = cut(counted.groupBy("stratum").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("move", "count"))).alias("rejected")))
    needed = math.ceil(math.log(error) / math.log1p(-max_rejected))
    level = error / max(1, held.filter(F.col("n") >= needed).count())

    def test(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [proven([dict(r).get(k, 0) for k in range(len(steps))], int(n), max_rejected, level) for r, n in zip(p.rejected, p.n)]
            yield pd.DataFrame({"stratum": p.stratum, "taken": found})

    taken = held.mapInPandas(test, "stratum string, taken int")
    table = F.array(*[F.struct(F.lit(k).alias("move"), F.lit(rule).alias("rule"), F.lit(x).alias("cutoff")) for k, (rule, x) in enumerate(steps)])
    passed = taken.select("stratum", "taken", F.explode(table).alias("t")).filter(F.col("t.move") < F.col("taken"))
    return passed.groupBy("stratum", "t.rule").agg(F.max_by("t.cutoff", "t.move").alias("cutoff"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_rejected: float = 0.05, error: float = 0.05) -> DataFrame:
    """Metrics, base_failed, kept and the rules that reject, for each row of docs (doc_id, text and the stratum).

    labels: doc_id, quality; several labels of a document count as good if all are. A null text has no words, a null
    stratum is a stratum of its own. A stratum with too few labelled texts has no cutoffs and rejects nothing but what
    fails the base rules; so does a table without labels.
    """
    metrics = cut(docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text").mapInArrow(measure, METRICS))
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q")).filter("_q = 1")
    limits = cutoffs(metrics.join(good, F.col("doc_id") == F.col("_id"), "left_semi").filter(~base_failed()), max_rejected, error)
    one = limits.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_limits"))
    out = metrics.join(one, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").withColumn("base_failed", base_failed())
    hits = F.array_compact(F.array(*[F.when(F.expr(m) > F.col("_limits")[rule], F.lit(rule)) for rule, (m, _) in GRID.items()]))
    out = out.withColumn("rejected_by", hits)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_stratum", "_limits")
