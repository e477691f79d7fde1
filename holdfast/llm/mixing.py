"""Mixing sources to target weights by temperature, in DataFrame operations only.

With p the token shares of the sources, their weights are p**a / sum p**a. The exponent a is bisected: the largest that
reaches a target entropy, raised if need be to the smallest that keeps every source within a number of repetitions.
The weights are then realised as block permutations: in each pass over a source its rows are dealt to blocks by hash
and permuted inside them; of the last pass, each block gives the rows that its share of the token budget pays for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small, stored, text_of

#: Rows of a block on average: what one window partition holds.
BLOCK = 2048
#: Digits kept of the exponent and of repetitions, so that the order of additions cannot show.
DIGITS = 6


@dataclass(frozen=True)
class Mix:
    """Targets. `entropy` is a share of the largest possible one, log of the number of sources; `passes` the most often
    that a source may be repeated; `budget` the tokens wanted as a share of all tokens, None for as many as it takes
    for every row to be used once at least."""

    entropy: float | None = 0.95
    passes: float = 4.0
    budget: float | None = 1.0
    seed: int = 1


def words(text_col: str) -> Column:
    """Words between white space; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def source_key(column: str) -> Column:
    """A name for each source, null being a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")).alias("source_key")


def weights(counted: DataFrame, mix: Mix) -> DataFrame:
    """source_key, rows, tokens, weight, repeats of each source; `counted` has source_key and n.

    Sources without tokens have weight 0 and repeats 1: their rows cost nothing and are used once.
    """
    totals = stored(counted.groupBy("source_key").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")))
    with_tokens = totals.filter("tokens > 0")
    sources, tokens = with_tokens.agg(F.count("*"), F.sum("tokens")).first()
    if not sources:
        return totals.select("*", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"))
    if mix.budget is not None and mix.budget > mix.passes:
        raise ValueError("a budget above the limit of passes cannot be met")
    log_share = F.log(F.col("tokens") / F.lit(float(tokens)))
    shares = with_tokens.select(log_share.alias("lp"), F.log("tokens").alias("lt"))
    wanted = 0.0 if mix.entropy is None else mix.entropy * math.log(sources)
    budget = None if mix.budget is None else mix.budget * tokens
    # entropy falls as the exponent rises, and so does the most frequent repetition
    by_entropy = _bisect(shares, lambda row: _entropy(row) >= wanted - 1e-12) if mix.entropy is not None else 1.0
    by_passes = _bisect(shares, lambda row: _most(row, budget) > mix.passes)
    scale = 10**DIGITS
    a = max(math.floor(by_entropy * scale) / scale, min(1.0, math.ceil(by_passes * scale) / scale))
    z, most, least = _at(shares, [a])[0][1:4]
    raised = F.exp(F.lit(a) * log_share)
    cost = F.exp(F.lit(a) * log_share - F.log("tokens"))
    repeats = cost / F.lit(least) if budget is None else cost * F.lit(budget / z)
    some = F.col("tokens") > 0
    return totals.select("*", F.when(some, raised / F.lit(z)).otherwise(0.0).alias("weight"), F.when(some, F.round(repeats, DIGITS)).otherwise(1.0).alias("repeats"))


def _at(shares: DataFrame, exponents: list[float]) -> list[tuple]:
    """(exponent, sum p**a, largest and smallest p**a / tokens, sum p**a * a * log p) for each exponent, one aggregate for all."""
    power = F.exp(F.col("a") * F.col("lp"))
    rows = shares.select("lp", "lt", F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a")).groupBy("a").agg(
        F.sum(power), F.max(F.exp(F.col("a") * F.col("lp") - F.col("lt"))), F.min(F.exp(F.col("a") * F.col("lp") - F.col("lt"))), F.sum(power * F.col("a") * F.col("lp")))
    return sorted(map(tuple, rows.collect()))


def _entropy(row: tuple) -> float:
    return math.log(row[1]) - row[4] / row[1]


def _most(row: tuple, budget: float | None) -> float:
    return row[2] / row[3] if budget is None else budget * row[2] / row[1]


def _bisect(shares: DataFrame, holds, halvings: int = 32, at_once: int = 4) -> float:
    """The exponent in [0, 1] below which `holds` is true and above which it is false; `at_once` halvings in one query."""
    parts, lo, hi = 2**at_once, 0.0, 1.0
    ends = _at(shares, [0.0, 1.0])
    if holds(ends[1]):
        return 1.0
    if not holds(ends[0]):
        return 0.0
    for _ in range(halvings // at_once):
        points = [lo + (hi - lo) * i / parts for i in range(1, parts)]
        true = sum(map(holds, _at(shares, points)))  # monotone: the first `true` points hold
        lo, hi = ([lo, *points][true], [*points, hi][true])
    return lo


def _number(key: Column) -> Column:
    """The first 32 bits of a hexadecimal key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def _tag(id_col: str, text_col: str) -> Column:
    """What tells a row from others: its id and its text, so that rows of one id fall into different blocks."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col))).alias("tag")


def _key(epoch: Column, mix: Mix) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), "tag"))


def plan(counted: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """Of each source its repeats and blocks, and of each block of the last, partial pass the greatest key that is used."""
    sources = stored(weights(counted, mix).select(
        "source_key", "weight", F.floor("repeats").cast("int").alias("whole"), (F.col("repeats") - F.floor("repeats")).alias("part"),
        F.greatest(F.lit(1), F.floor(F.col("rows") / BLOCK)).cast("long").alias("blocks")))
    key = _key(F.col("whole"), mix)
    rows = counted.join(small(sources, 100), "source_key").filter("part > 0").select("source_key", "part", "n", key.alias("key"), F.pmod(_number(key), F.col("blocks")).alias("block"))
    block = W.partitionBy("source_key", "block")
    before = F.sum("n").over(block.orderBy("key", "n").rowsBetween(W.unboundedPreceding, -1))
    # the row that crosses the budget is used if at least half of it is paid for
    used = F.coalesce(before, F.lit(0)) + F.col("n") / 2 <= F.col("part") * F.sum("n").over(block)
    last = rows.withColumn("used", used).filter("used").groupBy("source_key", "block").agg(F.max("key").alias("last"))
    return sources, stored(last)


def _times(rows: DataFrame, mix: Mix, sources: DataFrame, last: DataFrame) -> DataFrame:
    """`rows` (with source_key and tag) and how often each is used."""
    key = _key(F.col("whole"), mix)
    dealt = rows.join(small(sources, 100), "source_key").withColumn("key", key).withColumn("block", F.pmod(_number(F.col("key")), F.col("blocks")))
    return dealt.join(small(last, 100), ["source_key", "block"], "left").withColumn("times", F.col("whole") + F.coalesce(F.col("key") <= F.col("last"), F.lit(False)).cast("int"))


def schedule(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per use of a document: doc_id, source, weight (of its source, 6 digits), n_tokens, epoch, block, place.

    Rows of `epoch` 0, 1, ... are the passes over a source; within (source, epoch, block) `place` counts from 1 in
    permuted order. Null texts count as empty; documents without words are used as often as their source's full passes
    and cost nothing. A null source is a source of its own. Ids may repeat or be null: rows are told apart by id and text,
    and rows that repeat both are used equally often, in any order among themselves. Other columns are not read, and an empty table gives an empty result. No source is gathered in one
    task: blocks hold about 2,048 rows, totals are pre-aggregated.
    """
    counted = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(source_col), words(text_col).alias("n"), _tag(id_col, text_col)))
    sources, last = plan(counted, mix)
    used = _times(counted, mix, sources, last).filter("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    key = _key(F.col("epoch"), mix)
    placed = used.select("id", "source", "source_key", "weight", "n", "epoch", key.alias("key"), F.pmod(_number(key), F.col("blocks")).alias("block"))
    place = F.row_number().over(W.partitionBy("source_key", "epoch", "block").orderBy("key", "n"))
    return placed.select(F.col("id").alias("doc_id"), "source", F.round("weight", DIGITS).alias("weight"), F.col("n").alias("n_tokens"), "epoch", "block", place.cast("long").alias("place"))


def mixed(docs: DataFrame, mix: Mix = Mix(budget=None), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, whole, each as often as `schedule` uses it; nulls, repeats and empty tables as there. Texts are not shuffled."""
    counted = stored(docs.select(source_key(source_col), words(text_col).alias("n"), _tag(id_col, text_col)))
    sources, last = plan(counted, mix)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_key(source_col), _tag(id_col, text_col))
    used = _times(rows, mix, sources, last).filter("times > 0")
    return used.select("row", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).select("row.*")
