"""Many paths of a series by resampling its returns, and the spread of results over them.

A simulation is a key. Which bar a simulated bar repeats is computed from the
seed, the simulation's and the bar's number by modular arithmetic, so paths do
not depend on how rows are dealt out; history is joined by bar number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.storage import BROADCAST_ROWS, stored
from tidemark.operators.metrics import long_form, metrics
from tidemark.operators.simulate import Account, backtest

KINDS = ("shuffle", "stationary", "wrapped", "circular", "gbm")
_M = 2147483647


def draw(seed: int, sim: Column, i: Column, stream: int) -> Column:
    """A whole number below 2^31 - 1 for (simulation, number, stream): a few rounds of a modular generator."""
    x = F.pmod(sim * 7919 + i * 104729 + F.lit(seed * 15485863 + stream * 32452843), F.lit(_M)).cast("long")
    for a, c in ((48271, 11), (69621, 1013), (16807, 7001)):
        x = F.pmod((x + c) * a, F.lit(_M))
        x = F.pmod(x * F.pmod(x, F.lit(65521)) + x, F.lit(_M))
    return x


def uniform(seed: int, sim: Column, i: Column, stream: int) -> Column:
    """A number above 0 and below 1."""
    return (draw(seed, sim, i, stream) + 0.5) / F.lit(float(_M))


def default_block(n: int) -> int:
    return max(2, round(n ** (1 / 3)))


def history(bars: DataFrame) -> DataFrame:
    """symbol, i, ts, close and, from the second bar on, log return r and the bar's ratios to its close; n bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    c = F.col("close")
    was = F.lag(c).over(w)
    good = lambda x: F.when(c > 0, x / F.nullif(c, F.lit(0.0)))
    rows = bars.select("symbol", "ts", c, (F.row_number().over(w) - 1).cast("long").alias("i"), F.when((c > 0) & (was > 0), F.ln(c / F.nullif(was, F.lit(0.0)))).alias("r"), good(F.col("open")).alias("o"), good(F.col("high")).alias("h"), good(F.col("low")).alias("l"), F.col("volume").alias("v"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("symbol")))


def _steps(keyed: DataFrame) -> DataFrame:
    """keyed (symbol, sim, n) once for each simulated bar but the first: i from 1 to n - 1."""
    return keyed.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)))


def _sources(keyed: DataFrame, kind: str, block: int | None, seed: int) -> DataFrame:
    """keyed (symbol, sim, n) by bar i from 1 on, with src: the number of the return that comes here, from 1 to n - 1."""
    sim, i, m = F.col("sim"), F.col("i") - 1, F.col("n") - 1
    size = F.lit(block) if block else F.greatest(F.lit(2), F.round(F.pow(F.col("n"), F.lit(1 / 3)))).cast("long")
    if kind == "circular":
        start = F.pmod(draw(seed, sim, F.floor(i / size), 1), m)
        return _steps(keyed).withColumn("src", F.pmod(start + F.pmod(i, size), m) + 1)
    if kind == "shuffle":
        return _steps(keyed).withColumn("src", F.row_number().over(Window.partitionBy("symbol", "sim").orderBy(draw(seed, sim, i, 1), "i")).cast("long"))
    # what follows is done once a block, not once a bar: where it begins, which return it begins with, where it ends
    heads = _steps(keyed).filter((i == 0) | (uniform(seed, sim, i, 2) < 1.0 / size)).withColumn("at", i)
    until = F.coalesce(F.lead("at").over(Window.partitionBy("symbol", "sim").orderBy("at")), m)
    begin = lambda at: F.pmod(draw(seed, sim, at, 1), m)
    heads = heads.withColumns({"until": until, "start": begin(F.col("at"))})
    at, start, until = F.col("at"), F.col("start"), F.col("until")
    one = lambda a, b: F.struct(a.alias("at"), b.alias("start"))
    if kind == "wrapped":
        pieces = F.array(one(at, start))
    else:
        # a block that runs past the last return ends there and another begins, which may do so too; few blocks come to that
        end = lambda p: p["at"] + m - p["start"]
        further = lambda done, _: F.when(end(F.element_at(done, -1)) < until, F.concat(done, F.array(one(end(F.element_at(done, -1)), begin(end(F.element_at(done, -1))))))).otherwise(done)
        pieces = F.when(start + until - at <= m, F.array(one(at, start))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), until - at), F.array(one(at, start)), further))
    parts = heads.select("symbol", "sim", "n", "until", F.explode(pieces).alias("piece")).select("symbol", "sim", "n", "until", "piece.*")
    stop = F.col("until") if kind == "wrapped" else F.least(F.col("until"), F.col("at") + m - F.col("start"))
    bars = parts.withColumn("i", F.explode(F.sequence(F.col("at") + 1, stop)))
    return bars.select("symbol", "sim", "n", "i", (F.pmod(F.col("start") + F.col("i") - 1 - F.col("at"), m) + 1).alias("src"))


def paths(bars: DataFrame, n_sims: int, kind: str = "stationary", seed: int = 0, block: int | None = None) -> DataFrame:
    """Simulated bars: symbol, sim, ts and prices, as many as history has, for simulations 0 to n_sims - 1.

    shuffle permutes returns; circular repeats blocks of fixed length that wrap
    round the series' end, wrapped those of geometric length, and stationary
    cuts these off at the end; gbm draws normal returns of the same deviation
    sd and, so that prices grow as history's do, of the mean less sd^2 / 2. Each bar takes its shape from a
    historical bar drawn at random and its volume from another. The first bar
    is history's. A series of fewer than three bars makes no paths; a block
    must be shorter than the series.

    Simulations are dealt out by symbol and number once, and stay so; history is
    stored, and broadcast if it is BROADCAST_ROWS rows at most, else joined by shuffle.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; one of {KINDS}")
    past = stored(history(bars), "history")
    if kind == "circular" and block is not None and past.filter(F.col("n") <= block).limit(1).count():
        raise ValueError("block must be shorter than every series")
    light = past.count() <= BROADCAST_ROWS
    known = lambda *columns: F.broadcast(past.select("symbol", *columns)) if light else past.select("symbol", *columns)
    first = past.filter("i = 0 AND n > 2")
    if kind == "gbm":
        first = first.join(past.filter("i > 0").groupBy("symbol").agg(F.avg("r").alias("mu"), F.stddev_pop("r").alias("sd")), "symbol")
    keyed = first.select("symbol", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sims - 1).cast("long"))).alias("sim")).repartition("symbol", "sim")
    sim, i, m = F.col("sim"), F.col("i"), F.col("n") - 1
    if kind == "gbm":
        keyed = first.select("symbol", "n", "mu", "sd", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sims - 1).cast("long"))).alias("sim")).repartition("symbol", "sim")
        z = F.sqrt(-2 * F.ln(uniform(seed, sim, i, 3))) * F.cos(2 * math.pi * uniform(seed, sim, i, 4))
        drawn = _steps(keyed).select("symbol", "sim", "n", "i", (F.col("mu") - F.col("sd") * F.col("sd") / 2 + F.col("sd") * z).alias("r"))
    else:
        drawn = _sources(keyed, kind, block, seed).join(known(F.col("i").alias("src"), "r"), ["symbol", "src"]).drop("src")
    drawn = drawn.withColumns({"shape": F.pmod(draw(seed, sim, i, 5), m) + 1, "vol": F.pmod(draw(seed, sim, i, 6), m) + 1})
    drawn = drawn.join(known(F.col("i").alias("shape"), "o", "h", "l"), ["symbol", "shape"]).join(known(F.col("i").alias("vol"), F.col("v").alias("volume")), ["symbol", "vol"])
    # the first bar has history's close; its shape and volume are drawn as all others'
    opening = keyed.withColumn("i", F.lit(0).cast("long")).withColumns({"shape": F.pmod(draw(seed, sim, i, 5), m) + 1, "vol": F.pmod(draw(seed, sim, i, 6), m) + 1})
    opening = opening.join(known(F.col("i").alias("shape"), "o", "h", "l"), ["symbol", "shape"]).join(known(F.col("i").alias("vol"), F.col("v").alias("volume")), ["symbol", "vol"])
    columns = ["symbol", "sim", "i", "r", "o", "h", "l", "volume"]
    drawn = drawn.select(*columns).unionByName(opening.withColumn("r", F.lit(0.0)).select(*columns))
    start = past.filter("i = 0").select("symbol", F.col("close").alias("c0"))
    drawn = drawn.join(F.broadcast(start) if light else start, "symbol").join(known("i", "ts"), ["symbol", "i"])
    w = Window.partitionBy("symbol", "sim").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    close = F.col("c0") * F.exp(F.sum(F.coalesce("r", F.lit(0.0))).over(w))
    drawn = drawn.withColumn("close", close)
    c = F.col("close")
    priced = drawn.withColumn("open", c * F.coalesce("o", F.lit(1.0)))
    o = F.col("open")
    high, low = F.greatest(c * F.coalesce("h", F.lit(1.0)), o, c), F.least(c * F.coalesce("l", F.lit(1.0)), o, c)
    return priced.select("symbol", "sim", "ts", "open", high.alias("high"), low.alias("low"), "close", "volume")


def run(bars: DataFrame, strategy, n_sims: int, account: Account = Account(), kind: str = "stationary", seed: int = 0, block: int | None = None, names: list[str] | None = None) -> DataFrame:
    """symbol, sim, metric, value: a backtest of each simulated path, all in one job.

    Paths are series of their own to the strategy: symbol and simulation make
    its key. Simulations whose value is not finite keep it as it is.
    """
    made = paths(bars, n_sims, kind, seed, block)
    keyed = made.withColumn("symbol", F.concat_ws("#", "symbol", "sim")).drop("sim")
    scores = metrics(backtest(keyed, strategy, account))
    out = long_form(scores, ("symbol",), names)
    return out.select(F.regexp_extract("symbol", r"^(.*)#\d+$", 1).alias("symbol"), F.regexp_extract("symbol", r"#(\d+)$", 1).cast("long").alias("sim"), "metric", "value")


def path_scores(made: DataFrame) -> DataFrame:
    """symbol, sim, metric, value of simulated paths themselves, without a strategy: log_return, volatility (of a bar), max_drawdown of closes."""
    w = Window.partitionBy("symbol", "sim").orderBy("ts")
    c = F.col("close")
    steps = made.select("symbol", "sim", "ts", c, F.ln(c / F.lag(c).over(w)).alias("r"), (c / F.max(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("down"))
    by = steps.groupBy("symbol", "sim").agg(F.ln(F.max_by("close", "ts") / F.min_by("close", "ts")).alias("log_return"), F.stddev_samp("r").alias("volatility"), F.min("down").alias("max_drawdown"))
    return by.unpivot(["symbol", "sim"], ["log_return", "volatility", "max_drawdown"], "metric", "value")


def _good(value: str = "value") -> Column:
    return F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.col(value))


def summary(results: DataFrame, percentiles: tuple[int, ...] = (5, 25, 50, 75, 95), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """mean, std (of the whole), min, percentiles, max, n_valid, n_nan of each metric; finite values only."""
    x = _good()
    return results.groupBy(*keys, "metric").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), *[F.percentile(x, p / 100).alias(f"p{p}") for p in percentiles], F.max(x).alias("max"), F.count(x).alias("n_valid"), F.count(F.when(x.isNull(), 1)).alias("n_nan"))


def confidence_interval(results: DataFrame, metric: str, low: float = 5, high: float = 95, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    x = _good()
    return results.filter(F.col("metric") == metric).groupBy(*keys).agg(F.percentile(x, low / 100).alias("low"), F.percentile(x, high / 100).alias("high"))


def percentile_of(results: DataFrame, metric: str, value: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The share in per cent of simulations at or below a value."""
    x = _good()
    return results.filter((F.col("metric") == metric) & x.isNotNull()).groupBy(*keys).agg((F.avg((x <= value).cast("double")) * 100).alias("percentile"))


def sharpe_interval(returns: DataFrame, block: int, n_boot: int = 1000, confidence: float = 0.95, seed: int = 0, year: int = 252) -> DataFrame:
    """symbol, sharpe, ci_low, ci_high of returns (symbol, ts, ret) over circular blocks, yearly.

    A block's sum of returns and of their squares are differences of two
    running sums, so a resampling is as many rows as it has blocks, and two
    look-ups a row. Running sums are of returns less their mean, as squares' sums lose digits otherwise.
    """
    rows = returns.filter(F.col("ret").isNotNull())
    w = Window.partitionBy("symbol")
    rows = rows.select("symbol", "ret", "ts", F.avg("ret").over(w).alias("mean"), F.count("*").over(w).alias("m"))
    order = w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    off = F.col("ret") - F.col("mean")
    rows = stored(rows.select("symbol", "ret", "mean", "m", F.count("*").over(order).alias("i"), F.sum(off).over(order).alias("s"), F.sum(off * off).over(order).alias("q")), "returns")
    ratio = F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * math.sqrt(year)
    # running sums before each place, from 0 on
    sums = rows.select("symbol", "i", "s", "q").unionByName(rows.filter("i = 1").select("symbol", F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")))
    if rows.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    m, start = F.col("m"), F.col("start")
    whole = rows.filter("i = m").select("symbol", "m", "mean", F.col("s").alias("all_s"), F.col("q").alias("all_q"))
    blocks = whole.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long")))).repartition("symbol", "sim")
    blocks = blocks.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((m - 1) / block))))
    # a draw for each block; what reaches over the series' length is left out, what reaches over its end goes on at its start
    blocks = blocks.withColumn("start", F.pmod(draw(seed, F.col("sim"), F.col("k"), 1), m)).withColumn("size", F.least(F.lit(block), m - F.col("k") * block))
    end = start + F.col("size")
    blocks = blocks.withColumns({"laps": F.floor(end / m), "end": F.pmod(end, m)})
    at = lambda name: sums.select("symbol", F.col("i").alias(name), F.col("s").alias(f"{name}_s"), F.col("q").alias(f"{name}_q"))
    for name in ("start", "end"):
        blocks = blocks.join(at(name), ["symbol", name])
    part = lambda x: F.sum(F.col("laps") * F.col(f"all_{x}") + F.col(f"end_{x}") - F.col(f"start_{x}"))
    made = blocks.groupBy("symbol", "sim").agg(F.first("mean").alias("mean"), F.sum("size").alias("n"), part("s").alias("s"), part("q").alias("q"))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    var = (q - s * s / n) / F.nullif(n - 1, F.lit(0))
    sd = F.when(var > 1e-14 * q / n, F.sqrt(var))
    ends = made.select("symbol", ((F.col("mean") + s / n) / sd * math.sqrt(year)).alias("x")).groupBy("symbol")
    ends = ends.agg(F.percentile("x", (1 - confidence) / 2).alias("ci_low"), F.percentile("x", (1 + confidence) / 2).alias("ci_high"))
    return rows.groupBy("symbol").agg(ratio.alias("sharpe")).join(ends, "symbol")
