"""Operator 5: mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, lang, topic) are raked in turn to the target share of each value of source,
language and topic. Where a cell would need more tokens than it has, the raking goes on with every cell bounded by what
it has, until the sample's marginals hold; targets that no sample of the wanted size can reach are lowered to what there
is, and reported. A document is then kept with its cell's calibrated probability, drawn from a hash of its id and the
seed, so equal inputs give equal samples on any cluster.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import fresh, small, store

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are the corpus's own, raised to this power and normalised: below 1 large values give way to small ones.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 1.0}
ROUNDS = 8
#: Marginals hold where they are off by at most this share of their target. Raking goes on in blocks of rounds until they
#: do, or a block gains less than a hundredth, or so many blocks are done; what does not hold then is reported.
TOLERANCE, BLOCKS = 1e-3, 25
#: So few cells are raked in one task, where no window needs an exchange; more are dealt by value.
ONE_TASK = 20_000
Targets = dict[str, dict[str | None, float]]


def tokens(text: Column) -> Column:
    """Words between runs of white space; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def topic(text: Column) -> Column:
    """A coarse topic by form: empty, table, shouting, symbols, note, article or book."""
    body = F.coalesce(text, F.lit(""))
    n = F.length(body)
    symbols = sum((n - F.length(F.replace(body, F.lit(c), F.lit(""))) for c in "$%&*#"), F.lit(0))
    return (
        F.when(n == 0, "empty")
        .when(n - F.length(F.replace(body, F.lit(" | "), F.lit(""))) >= n * 0.06, "table")
        .when(n - F.length(F.replace(body, F.lit("!! "), F.lit(""))) >= n * 0.1, "shouting")
        .when(symbols >= n * 0.1, "symbols")
        .when(n < 600, "note")
        .when(n < 12000, "article")
        .otherwise("book")
    )


def target_shares(share: DataFrame, targets: dict[str | None, float] | None) -> DataFrame:
    """Of v, s (a share of a value): v, s with given shares in place; values not named share what is left in proportion.

    Given shares of values that have no tokens are left out, and the rest is scaled to a sum of 1.
    """
    if not targets:
        return share
    if min(targets.values()) < 0 or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target shares must be 0 or more and add up to 1 at most")
    given = share.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).cast("string").alias("named"), F.lit(float(x)).alias("want")) for v, x in targets.items()])))
    both = share.join(small(given), F.col("v").cast("string").eqNullSafe(F.col("named")), "left")
    others = both.agg(F.sum(F.when(F.col("want").isNull(), F.col("s"))).alias("others"))
    left = F.lit(max(0.0, 1.0 - sum(targets.values())))
    found = F.when(F.col("want").isNotNull(), F.when(F.col("s") > 0, F.col("want")).otherwise(F.lit(0.0)))
    return both.crossJoin(F.broadcast(others)).select("v", found.otherwise(F.when(F.col("others") > 0, F.col("s") / F.col("others") * left).otherwise(F.lit(0.0))).alias("s"))


def fit_cells(cells: DataFrame, powers: dict[str, float], rounds: int = ROUNDS, targets: Targets | None = None) -> DataFrame:
    """Cells (dimensions, tokens) with a raked weight whose marginals are the targets; a cell without tokens weighs 0.

    Targets are the shares given for a dimension's values, or the cells' own raised to the dimension's power.
    Rounds go on in blocks until the marginals hold (see TOLERANCE); those that cannot be met are logged as a warning.
    """
    current = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("tokens").cast("double").alias("all"))
    for d, power in powers.items():
        share = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("own")).crossJoin(F.broadcast(total))
        share = share.select(F.col(d).alias("v"), F.when(F.col("own") > 0, F.pow(F.col("own") / F.col("all"), F.lit(power))).otherwise(F.lit(0.0)).alias("s"))
        share = target_shares(share, (targets or {}).get(d))
        norm = share.agg(F.sum("s").alias("norm"))
        target = share.crossJoin(F.broadcast(norm)).select("v", (F.col("s") / F.col("norm")).alias(f"{d}_target"))
        current = current.join(small(target), current[d].eqNullSafe(target["v"])).drop("v")
    current = store(current, "cells")
    if current.count() <= ONE_TASK:
        current = current.coalesce(1)
    dims, last = list(powers), float("inf")
    current = _rake(current, dims, rounds)
    for _ in range(BLOCKS):
        off = _off(current, dims)
        if off <= TOLERANCE or off > 0.99 * last:
            break
        current, last = _rake(current, dims, rounds), off
    report(current, dims, "weight")
    return current


def _rake(current: DataFrame, dims: list[str], rounds: int, weight: Column | None = None, target: str = "target") -> DataFrame:
    """Rounds over the dimensions: weight times target over what the value weighs now (by the given column, or weight)."""
    for i in range(rounds):
        for d in dims:
            now = F.sum("weight" if weight is None else weight).over(Window.partitionBy(d))
            current = current.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"{d}_{target}") / now).otherwise(F.lit(0.0)))
        if i == rounds // 2:
            current = store(current, "raked")
    return store(current, "raked")


def marginals(cells: DataFrame, dims: list[str], weight: str = "weight", target: str = "target") -> DataFrame:
    """dimension, value, target, reached, off (share of the target): a row per value of each dimension that has tokens."""
    out = None
    for d in dims:
        one = cells.groupBy(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.first(f"{d}_{target}").alias("target"), F.sum(weight).alias("reached"))
        out = one if out is None else out.unionByName(one)
    return out.where("target > 0").withColumn("off", F.abs(F.col("reached") / F.col("target") - 1))


def _off(*args, **kwargs) -> float:
    return marginals(*args, **kwargs).agg(F.max("off")).first()[0] or 0.0


def bound_cells(fitted: DataFrame, dims: list[str], fraction: float, rounds: int = ROUNDS) -> DataFrame:
    """Raked cells with sampled: the weight that a sample of the given fraction of all tokens can have, weight where no bound is met.

    A cell is bounded by its tokens over the sample's. sampled is the lesser of the bound and the product of the cell's
    own tokens with a factor of each of its values, as in raking; the factors are raked until the bounded marginals hold.
    """
    all_tokens = fitted.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    size = min(float(fraction), 1.0) * all_tokens
    cells = fitted.withColumn("bound", F.col("tokens") / F.lit(size) if size > 0 else F.lit(float("inf")))
    if cells.where("weight > bound").isEmpty():
        return fitted.withColumn("sampled", F.col("weight"))
    for d in dims:
        # targets over all that a value has become that; the others share the rest in proportion
        sums, times = cells.groupBy(d).agg(F.first(f"{d}_target").alias("t"), F.sum("bound").alias("b")).where("t > 0"), 1.0
        while True:
            over = F.col("t") * F.lit(times) >= F.col("b")
            full, free = sums.agg(F.sum(F.when(over, F.col("b"))), F.sum(F.when(~over, F.col("t")))).first()
            if not free or (more := (1 - (full or 0.0)) / free) <= times * (1 + 1e-12):
                break
            times = more
        cells = cells.withColumn(f"{d}_reach", F.least(F.col(f"{d}_target") * F.lit(times), F.sum("bound").over(Window.partitionBy(d))))
    sampled, last = F.least("weight", "bound"), float("inf")
    for _ in range(BLOCKS):
        cells = _rake(cells, dims, rounds, sampled, "reach")
        off = _off(cells.withColumn("sampled", sampled), dims, "sampled", "reach")
        if off <= TOLERANCE or off > 0.99 * last:
            break
        last = off
    cells = cells.withColumn("sampled", sampled)
    report(cells, dims, "sampled")
    return cells.drop("bound", *[f"{d}_reach" for d in dims])


def report(cells: DataFrame, dims: list[str], weight: str) -> None:
    """A warning with the number of marginals that do not hold and the worst of them."""
    missed = marginals(cells, dims, weight).where(F.col("off") > TOLERANCE)
    worst = [f"{r.dimension}={r.value}: {r.reached:.6f} of {r.target:.6f}" for r in missed.orderBy(F.desc("off"), "dimension", "value").limit(10).collect()]
    if worst:
        logging.getLogger(__name__).warning("%s: %d target shares cannot be met; the worst: %s", weight, missed.count(), "; ".join(worst))


def mix(docs: DataFrame, fraction: float = 0.5, powers: dict[str, float] | None = None, seed: int = 17, rounds: int = ROUNDS, targets: Targets | None = None, topic_of: Callable[[Column], Column] = topic) -> DataFrame:
    """docs with topic, tokens, weight, probability and kept (names taken by docs get an underscore behind).

    targets: wanted shares of tokens by dimension (source, lang, topic) and value, as {"source": {"web": 0.3}}; a value that is not
    named has its part of the rest, and a dimension that is not named goes by its power. topic_of gives a text's topic.
    weight: raked weight of the row's cell over its own share, 1 where nothing changes. probability: fraction x weight, so
    that the expected tokens are the given fraction of the corpus (1 at most); where that passes 1 for some cell, the
    weights are raked again within the bounds (see bound_cells), so that what a full cell lacks comes from others of its
    source, language and topic. Marginals that a sample of this size cannot have are logged as a warning. Null values of a dimension are a value of their own. Rows
    without tokens (null and empty texts among them) have weight and probability 0 and are not kept; a text of any length
    counts whole. Repeated ids share a draw, and rows of one cell have one probability, so there are no ties to break; an
    empty table stays one.

    One narrow pass sums cells by partial aggregation, so a hot source costs no more than any other; the raking works
    on cells alone, and a second narrow pass looks each row's cell up.
    """
    powers = powers or POWERS
    names = {n: fresh(n, docs.columns) for n in ("topic", "tokens", "weight", "probability", "kept")}
    marked = docs.withColumns({names["topic"]: topic_of(F.col("text")), names["tokens"]: tokens(F.col("text"))})
    dims = [F.col(names["topic"] if d == "topic" else d).alias(d) for d in DIMENSIONS]
    cells = store(marked.select(*dims, F.col(names["tokens"]).alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "sums")
    whole = cells.agg(F.sum("tokens").cast("double").alias("all"))
    fitted = fit_cells(cells, {d: powers.get(d, 1.0) for d in DIMENSIONS}, rounds, targets)
    fitted = bound_cells(fitted, list(DIMENSIONS), fraction, rounds).crossJoin(F.broadcast(whole))
    over_own = lambda w: F.when(F.col("tokens") > 0, F.round(F.col(w) * F.col("all") / F.col("tokens"), 9)).otherwise(F.lit(0.0))
    # the cells' own columns clash with none of docs
    of = {d: fresh(f"cell_{d}", marked.columns) for d in (*DIMENSIONS, "weight", "sampled")}
    looked = fitted.select(*[F.col(d).alias(of[d]) for d in DIMENSIONS], *[over_own(w).alias(of[w]) for w in ("weight", "sampled")])
    on = [F.col(names["topic"] if d == "topic" else d).eqNullSafe(F.col(of[d])) for d in DIMENSIONS]
    out = marked.join(small(looked), on[0] & on[1] & on[2], "left")
    own, sampled = (F.when(F.col(names["tokens"]) > 0, F.coalesce(of[w], F.lit(0.0))).otherwise(F.lit(0.0)) for w in ("weight", "sampled"))
    chance = F.round(F.least(F.lit(1.0), sampled * F.lit(float(fraction))), 9)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    out = out.withColumns({names["weight"]: own, names["probability"]: chance}).withColumn(names["kept"], draw < F.col(names["probability"]))
    return out.drop(*of.values())
