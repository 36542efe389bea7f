"""Mixing sources to target weights: temperature, then budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, stored

#: High bits of the permutation hash: each source and pass is ordered in so many independent pieces.
CELL_BITS = 12
#: Equal rows that one row is made into at once.
COPIES = 4096


def words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def permuted(seed: int, *cols: Column) -> Column:
    """A place between 0 and 2**63 - 1 that orders the rows of a source in one pass over it."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 63) - 1))


def exponent(shares: DataFrame, max_repeats: float | None = None, min_entropy: float | None = None) -> float:
    """The largest exponent in [0, 1] under which no source is repeated more than max_repeats times while the largest
    is seen once, and, or else, the entropy of the weights reaches min_entropy (a fraction of its maximum).

    shares: one row a source, with its token share. Each round measures 15 exponents at once and keeps the step that
    holds the limit, so the bracket shrinks 16-fold. Fails if no exponent holds all limits.
    """
    ends = shares.filter("share > 0").agg(F.max("share"), F.min("share"), F.count("*")).first()
    if not ends[2] or ends[2] == 1:
        return 1.0

    def entropies(at: list[float]) -> list[float]:
        power = lambda a: F.pow("share", F.lit(a))
        row = shares.filter("share > 0").agg(*[x for a in at for x in (F.sum(power(a)), F.sum(power(a) * F.log("share") * a))]).first()
        return [math.log(row[2 * i]) - row[2 * i + 1] / row[2 * i] for i in range(len(at))]

    def held(at: list[float]) -> list[bool]:
        ok = [max_repeats is None or (ends[0] / ends[1]) ** (1 - a) <= max_repeats * (1 + 1e-12) for a in at]
        if min_entropy is not None:
            even = [h >= min_entropy * math.log(ends[2]) - 1e-12 for h in entropies(at)]
            ok = even if max_repeats is None else [x and y for x, y in zip(ok, even)]
        return ok

    # More temperature (a smaller exponent) raises the entropy and the repeats: each limit holds on one side.
    lo, hi = 0.0, 1.0
    rising = max_repeats is not None  # the repeats limit holds for large exponents, the entropy limit for small ones
    if held([hi if rising else lo])[0] and held([lo if rising else hi])[0]:
        return lo if rising else hi
    for _ in range(8):
        at = [lo + (hi - lo) * i / 16 for i in range(17)]
        ok = held(at)
        good = [i for i, x in enumerate(ok) if x]
        if not good:
            raise ValueError(f"no exponent repeats sources {max_repeats} times at most and reaches {min_entropy} of the greatest entropy")
        if rising:
            lo, hi = at[max(good[0] - 1, 0)], at[good[0]]
        else:
            lo, hi = at[good[-1]], at[min(good[-1] + 1, 16)]
    return hi if rising else lo


def weigh(per_source: DataFrame, max_repeats: float | None = 2.0, min_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """source, n_tokens -> source, n_tokens, share, weight, target, passes (whole ones) and rest (tokens of the last).

    budget: tokens of the mix; by default as many as let the largest source be seen once, so that no row is lost.
    """
    all_tokens = per_source.agg(F.sum("n_tokens")).first()[0] or 0
    shares = per_source.withColumn("share", F.col("n_tokens") / F.lit(max(all_tokens, 1)))
    a = exponent(shares, max_repeats, min_entropy)
    raw = shares.withColumn("weight", F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(0.0))
    z, top = raw.agg(F.sum("weight"), F.max(F.struct("n_tokens", "weight"))).first()
    out = raw.withColumn("weight", F.col("weight") / F.lit(z or 1.0))
    size = budget if budget is not None else (top[0] * z / top[1] if top and top[1] else 0.0)
    target = F.when(F.col("n_tokens") > 0, F.floor(F.col("weight") * size + 0.5)).otherwise(0).cast("long")
    passes = F.when(F.col("n_tokens") > 0, F.floor(F.try_divide("target", "n_tokens"))).otherwise(1).cast("long")
    return out.withColumn("target", target).withColumn("passes", passes).withColumn("rest", F.when(F.col("n_tokens") > 0, F.col("target") - F.col("passes") * F.col("n_tokens")).otherwise(0).cast("long"))


def mix(docs: DataFrame, tokens: Column | None = None, max_repeats: float | None = 2.0, min_entropy: float | None = None, budget: float | None = None, block_tokens: int = 1 << 18, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix of docs (doc_id, source, text) and its table of sources.

    Rows of the mix: doc_id, source, n_tokens, epoch, place, block, slot. Each pass over a source is a permutation of
    its own; whole passes take every document, the last one takes documents until the source's budget is met. A block
    draws from each source in proportion to its weight and is shuffled within; it exceeds its tokens by a document of each
    source at most. Null sources form one source; sources without tokens are seen once; rows without tokens are spread over
    all blocks; rows of equal doc_id and text stay separate rows, of which a pass takes all or none, block after block.
    Empty tables give no rows.
    """
    own = docs.select("doc_id", "source", (words() if tokens is None else tokens).alias("n_tokens"), F.xxhash64("text").alias("print"))
    rows = stored(own.groupBy(own.columns).agg(F.count("*").alias("copies")).withColumn("_sum", F.col("n_tokens") * F.col("copies")))
    sources = stored(weigh(rows.groupBy("source").agg(F.sum("_sum").alias("n_tokens"), F.sum("copies").alias("n_rows")), max_repeats, min_entropy, budget))
    plan = sources.select(F.col("source").alias("_source"), F.col("n_tokens").alias("_all"), "weight", "passes", "rest")
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("epoch", F.explode(F.expr("CASE WHEN passes + CAST(rest > 0 AS INT) > 0 THEN sequence(0, CAST(passes AS INT) + CAST(rest > 0 AS INT) - 1) END")))
    dealt = dealt.withColumn("place", permuted(seed, F.col("epoch"), F.col("doc_id"), F.col("print"))).withColumn("cell", F.shiftright("place", 63 - CELL_BITS))
    keys = ["source", "epoch", "cell"]
    before = dealt.groupBy(*keys).agg(F.sum("_sum").alias("_sum"))
    before = before.withColumn("_before", F.sum("_sum").over(Window.partitionBy("source", "epoch").orderBy("cell")) - F.col("_sum")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_before")
    inside = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("place").rangeBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_epoch")) & (F.col("cell") == F.col("_cell"))).withColumn("_start", F.col("_before") + F.col("_inside"))
    kept = placed.filter((F.col("epoch") < F.col("passes")) | (F.col("_start") < F.col("rest")))
    # equal rows are one until here; each comes after the one before it
    kept = kept.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    if (rows.agg(F.max("copies")).first()[0] or 0) > COPIES:
        kept = kept.repartition("doc_id", "print", "epoch", "_part")
    kept = kept.withColumn("_copy", F.explode(F.sequence(F.col("_part") * COPIES, F.least("copies", (F.col("_part") + 1) * COPIES) - 1)))
    at = F.col("epoch") * F.col("_all") + F.col("_start") + F.col("_copy") * F.col("n_tokens")
    size = sources.agg(F.sum(F.when(F.col("n_tokens") > 0, F.col("target")).otherwise(F.col("n_rows")))).first()[0] or 0
    empty = F.pmod(F.col("place") + F.col("_copy"), F.lit(max(1, math.ceil(size / block_tokens))))
    full = F.when(F.col("n_tokens") > 0, F.floor(F.try_divide(at, F.col("weight") * block_tokens)))
    kept = kept.withColumn("block", F.coalesce(full, empty).cast("long"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy(permuted(seed + 1, F.col("doc_id"), F.col("print"), F.col("epoch")), "doc_id", "print", "epoch")).cast("long") - 1
    return kept.select("doc_id", "source", "n_tokens", "epoch", "place", "block", slot.alias("slot")), sources


def mix_rows(docs: DataFrame, max_repeats: float | None = 2.0, seed: int = 42) -> DataFrame:
    """docs with each row as often as the mix has it; only a table of one row a source is joined to the texts.

    Rows that share doc_id, text and source are repeated alike. All columns of docs stay as they are.
    """
    own, count, stop, copy = free(docs, "_source", "_passes", "_end", "_n")
    mixed, sources = mix(docs, max_repeats=max_repeats, seed=seed)
    last = mixed.groupBy("source").agg(F.max(F.struct("epoch", "place")).alias("last"))
    end = F.when((F.col("rest") > 0) & (F.col("last.epoch") == F.col("passes")), F.col("last.place"))
    ends = stored(sources.join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias(own), F.col("passes").cast("int").alias(count), end.alias(stop)))
    n = F.col(count) + F.coalesce((permuted(seed, F.col(count), F.col("doc_id"), F.xxhash64("text")) <= F.col(stop)).cast("int"), F.lit(0))
    return docs.join(ends, F.col("source").eqNullSafe(F.col(own))).withColumn(copy, F.explode(F.array_repeat(F.lit(1), n))).drop(own, count, stop, copy)
