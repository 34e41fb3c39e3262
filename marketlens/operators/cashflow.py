"""Cash-flow and schedule jobs over tables of loans, assets and flows.

A flows table has one row per flow: the key columns of the investment, the regular
period number (or the date) and the amount.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from marketlens.operators.ordered import join_keys
from marketlens.operators.scratch import scratch_table

MAX_ROUNDS = 128  # fixed value: steps of the bracket and of the bisection
LOWEST_RATE = -1.0 + 1e-9
PRECISION = 1e-14
LISTED_TIMES = 10_000  # an investment with more distinct times is solved by sums over its rows
GRID = 32  # rates tried in one pass over such rows
WIDER = 1.6  # growth of the bracket in one round, as a share of its width


def npv(flows: DataFrame, keys: Sequence[str], period: str, amount: str, rate: Column | float, name: str = "npv") -> DataFrame:
    """Sum of amount / (1 + rate)^period; the first flow has period 1."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return flows.groupBy(*keys).agg(F.sum(F.col(amount) / F.pow(1 + rate, F.col(period))).alias(name))


def xnpv(flows: DataFrame, keys: Sequence[str], day: str, amount: str, rate: float, name: str = "xnpv") -> DataFrame:
    """Dated present value on the first day; null unless amounts of both signs (or zero) occur."""
    first = flows.groupBy(*keys).agg(F.min(day).alias("_first"), F.min(amount).alias("_low"), F.max(amount).alias("_high"))
    rows = join_keys(flows, first, keys)
    years = F.datediff(day, "_first") / 365
    value = F.sum(F.col(amount) / F.pow(F.lit(1.0 + rate), years))
    return rows.groupBy(*keys).agg(F.when((F.max("_low") <= 0) & (F.max("_high") >= 0), value).alias(name))


def mirr(
    flows: DataFrame, keys: Sequence[str], period: str, amount: str, finance_rate: float, reinvest_rate: float, name: str = "mirr"
) -> DataFrame:
    """Modified internal rate from two discounted sums; the first flow has period 1."""
    v, i = F.col(amount), F.col(period) - 1
    sums = flows.groupBy(*keys).agg(
        F.sum(F.when(v >= 0, v / F.pow(F.lit(1.0 + reinvest_rate), i)).otherwise(0.0)).alias("_in"),
        F.sum(F.when(v < 0, v / F.pow(F.lit(1.0 + finance_rate), i)).otherwise(0.0)).alias("_out"),
        F.count(F.lit(1)).alias("_n"),
    )
    growth = F.try_divide(-F.col("_in") * F.pow(F.lit(1.0 + reinvest_rate), F.col("_n") - 1), F.col("_out"))
    value = F.pow(growth, F.try_divide(F.lit(1.0), (F.col("_n") - 1).cast("double"))) - 1
    return sums.select(*keys, F.when((F.col("_in") != 0) & (F.col("_out") != 0) & (F.col("_n") > 1), value).alias(name))


def fvschedule(rates: DataFrame, keys: Sequence[str], rate: str, principal: Column, name: str = "fv") -> DataFrame:
    """Principal compounded by every rate of the group."""
    return rates.groupBy(*keys).agg(F.product(1 + F.col(rate)).alias("_growth"), F.first(principal).alias("_pv")).select(
        *keys, (F.col("_pv") * F.col("_growth")).alias(name)
    )


def _roots(times: np.ndarray, amounts: np.ndarray, guess: float) -> np.ndarray:
    """Rates at which the discounted amounts of each line add up to zero; nan where none is bracketed.

    All lines of equal length are solved together: widen [0, guess] on the side of the
    smaller value until the sign changes, then halve. Times count from the first flow,
    which leaves the rates as they are and lets negative rates be bracketed. Sums are
    scaled by their largest exponent, so that late flows can't overflow.
    """
    times = times - times[:, :1]
    some = amounts != 0
    first = np.where(some, times, np.inf).min(axis=1)
    last = np.where(some, times, -np.inf).max(axis=1)
    whole = np.isfinite(times).all(axis=1) & np.isfinite(amounts).all(axis=1)

    def value(rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        growth = np.log1p(rate)
        top = np.where(some.any(axis=1), np.maximum(-growth * first, -growth * last), 0.0)
        sums = np.sum(np.where(some, amounts * np.exp(-growth[:, None] * times - top[:, None]), 0.0), axis=1)
        return np.sign(sums), np.log(np.abs(sums)) + top

    low, high = np.zeros(len(times)), np.full(len(times), float(guess))
    with np.errstate(all="ignore"):
        (at_low, size_low), (at_high, size_high) = value(low), value(high)
        for _ in range(MAX_ROUNDS):
            wide = ~(at_low * at_high <= 0)
            if not wide.any():
                break
            down = wide & (size_low < size_high)
            up = wide & ~down
            step = WIDER * (high - low)
            low = np.where(down, np.maximum(low - step, LOWEST_RATE), low)
            high = np.where(up, np.maximum(high + step, LOWEST_RATE), high)
            (at_low, size_low), (at_high, size_high) = value(low), value(high)
        found = (at_low * at_high <= 0) & whole
        for _ in range(MAX_ROUNDS):
            middle = (low + high) / 2
            if np.all(np.abs(high - low) <= PRECISION * (1.0 + np.abs(middle))):
                break
            at_middle = value(middle)[0]
            left = at_low * at_middle <= 0
            high = np.where(left, middle, high)
            low, at_low = np.where(left, low, middle), np.where(left, at_low, at_middle)
    return np.where(found, (low + high) / 2, np.nan)


def _rates(guess: float):
    @pandas_udf("double")
    def solve(times: pd.Series, amounts: pd.Series) -> pd.Series:
        out = np.full(len(times), np.nan)
        sizes = times.map(len).to_numpy()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            out[rows] = _roots(
                np.stack(times.iloc[rows].to_list()).astype(float), np.stack(amounts.iloc[rows].to_list()).astype(float), guess
            )
        return pd.Series(out)

    return solve


def _solved(flows: DataFrame, keys: Sequence[str], time: Column, amount: str, guess: float, name: str) -> DataFrame:
    """Flows of one time are summed first. Few times are solved as one list, many by passes of sums over the rows."""
    summed = flows.groupBy(*keys, time.alias("_time")).agg(F.sum(amount).alias("_amount"))
    sizes = summed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long = scratch_table(sizes.filter(F.col("_n") > LISTED_TIMES).select(*keys), "long-flows")
    some_long = not long.isEmpty()
    short = join_keys(summed.withColumn("_short", F.lit(True)), long.withColumn("_long", F.lit(True)), keys, "left").filter("_long IS NULL") if some_long else summed
    lists = short.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_time", "_amount"))).alias("_flows"))
    rate = _rates(guess)(F.col("_flows._time"), F.col("_flows._amount"))
    solved = lists.select(*keys, F.nanvl(rate, F.lit(None).cast("double")).alias(name))
    if not some_long:
        return solved
    rows = scratch_table(join_keys(summed, long.withColumn("_long", F.lit(True)), keys).drop("_long"), "long-flow-rows")
    return solved.union(_solved_by_passes(rows, keys, guess).select(*keys, F.col("_rate").alias(name)))


def _bracket_rates(low: float, high: float) -> list[float]:
    """The rates that the next widening rounds can ask for: the high ends of rounds that all go up, and the low end after each."""
    rates = [low, high]
    while len(rates) < GRID:
        step = WIDER * (high - low)
        down, high = max(low - step, LOWEST_RATE), max(high + step, LOWEST_RATE)
        rates += [r for r in dict.fromkeys((down, high)) if r not in rates] or [high]
    return rates[:GRID]


def _middle_rates(low: float, high: float, rounds: int) -> list[float]:
    """The middles that the next halving rounds can ask for."""
    middle = (low + high) / 2
    return [middle, *_middle_rates(low, middle, rounds - 1), *_middle_rates(middle, high, rounds - 1)] if rounds else []


def _advanced(low: float, high: float, at_low: float | None, rounds: int, known: dict[float, tuple[float, float]]) -> tuple[float, float, float | None, int, list[float], float | None]:
    """As many rounds of ``_roots`` as the known signs and sizes allow; then the rates to ask for, or the rate found.

    ``at_low`` is the sign at the low end once the bracket is found.
    """
    while at_low is None:
        if low not in known or high not in known:
            return low, high, None, rounds, _bracket_rates(low, high), None
        (sign_low, size_low), (sign_high, size_high) = known[low], known[high]
        if sign_low * sign_high <= 0:
            at_low, rounds = sign_low, 0
            break
        step = WIDER * (high - low)
        ends = (max(low - step, LOWEST_RATE), high) if size_low < size_high else (low, max(high + step, LOWEST_RATE))
        if rounds == MAX_ROUNDS or ends == (low, high):  # an end that can't move never will
            return low, high, None, rounds, [], None
        (low, high), rounds = ends, rounds + 1
    while True:
        middle = (low + high) / 2
        if rounds == MAX_ROUNDS or abs(high - low) <= PRECISION * (1.0 + abs(middle)):
            return low, high, at_low, rounds, [], middle
        if middle not in known:
            asked = _middle_rates(low, high, GRID.bit_length() - 1)
            return low, high, at_low, rounds, asked + asked[-1:] * (GRID - len(asked)), None
        if at_low * known[middle][0] <= 0:
            high = middle
        else:
            low, at_low = middle, known[middle][0]
        rounds += 1


_PLACE = "low double, high double, at_low double, rounds int, rates array<double>, growths array<double>, tops array<double>, rate double"


def _next_place(*columns: str | Column) -> Column:
    """The place after the sums at its rates, from the place, the sums and the times of the first and last amount."""

    @pandas_udf(_PLACE)
    def move(place: pd.DataFrame, sums: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        out = []
        for low, high, at_low, rounds, rates, tops, values, t0, t1 in zip(place.low, place.high, place.at_low, place.rounds, place.rates, place.tops, sums, first, last):
            with np.errstate(divide="ignore"):
                known = dict(zip(map(float, rates), zip(np.sign(values), np.log(np.abs(values)) + tops)))
            low, high, at_low, rounds, asked, rate = _advanced(low, high, None if pd.isna(at_low) else at_low, int(rounds), known)
            growths = [float(np.log1p(r)) for r in asked]
            out.append((low, high, at_low, rounds, asked, growths, [max(-g * t0, -g * t1) for g in growths], rate))
        done = pd.DataFrame(out, columns=["low", "high", "at_low", "rounds", "rates", "growths", "tops", "rate"])
        return done.astype({"low": "float64", "high": "float64", "at_low": "float64", "rounds": "int32", "rate": "float64"})

    return move(*columns)


def _solved_by_passes(rows: DataFrame, keys: Sequence[str], guess: float) -> DataFrame:
    """The rounds of ``_roots`` for every investment at once, from sums of discounted amounts over the rows.

    One pass sums at GRID rates, which holds many rounds of widening or five of halving,
    so the same ends and middles are tried as for a list and the same rate is found.
    """
    some = F.when(F.col("_amount") != 0, F.col("_time"))
    whole = F.col("_time").isNotNull() & F.col("_amount").isNotNull() & (F.abs("_time") < float("inf")) & (F.abs("_amount") < float("inf"))
    figures = scratch_table(
        rows.groupBy(*keys).agg(
            F.min("_time").alias("_start"), F.min(some).alias("_first"), F.max(some).alias("_last"), F.bool_and(whole).alias("_whole"),
            F.min("_amount").alias("_least"), F.max("_amount").alias("_most"),
        ), "long-flow-figures",
    )
    # amounts of one sign have no rate; amounts that are all zero have the rate 0, as in a list
    solvable = F.col("_whole") & (F.col("_least") < 0) & (F.col("_most") > 0)
    settled = figures.filter(~solvable).select(*keys, F.when(F.col("_whole") & (F.col("_least") == 0) & (F.col("_most") == 0), 0.0).alias("_rate"))
    ends = figures.filter(solvable).select(*keys, "_start", (F.col("_first") - F.col("_start")).alias("_first"), (F.col("_last") - F.col("_start")).alias("_last"))
    rows = rows.filter(F.col("_amount") != 0)
    nothing = F.array().cast("array<double>")
    begin = F.struct(
        F.lit(0.0).alias("low"), F.lit(float(guess)).alias("high"), F.lit(None).cast("double").alias("at_low"), F.lit(0).alias("rounds"),
        nothing.alias("rates"), nothing.alias("growths"), nothing.alias("tops"), F.lit(None).cast("double").alias("rate"),
    )
    places = ends.withColumn("_place", begin).withColumn("_place", _next_place("_place", nothing, "_first", "_last"))
    open_ = scratch_table(places, "growth-rates")
    while not open_.isEmpty():
        asked = open_.select(*keys, "_start", "_place.growths", "_place.tops")
        time = F.col("_time") - F.col("_start")
        sums = [F.sum(F.col("_amount") * F.exp(-(F.col("growths")[i] * time) - F.col("tops")[i])) for i in range(GRID)]
        values = join_keys(rows, asked, keys).groupBy(*keys).agg(F.array(*sums).alias("_sums"))
        moved = join_keys(open_, values, keys).withColumn("_place", _next_place("_place", "_sums", "_first", "_last")).drop("_sums")
        moved = scratch_table(moved, "growth-rates")
        settled = settled.union(moved.filter(F.size("_place.rates") == 0).select(*keys, F.nanvl("_place.rate", F.lit(None).cast("double")).alias("_rate")))
        open_ = moved.filter(F.size("_place.rates") > 0)
    return settled


def irr(flows: DataFrame, keys: Sequence[str], period: str, amount: str, guess: float = 0.1, name: str = "irr") -> DataFrame:
    """Internal rate of regular flows; null where none is found from the guess."""
    return _solved(flows, keys, F.col(period).cast("double"), amount, guess, name)


def xirr(flows: DataFrame, keys: Sequence[str], day: str, amount: str, guess: float = 0.1, name: str = "xirr") -> DataFrame:
    """Internal rate of dated flows, in years of 365 days from the first day."""
    first = flows.groupBy(*keys).agg(F.min(day).alias("_first"))
    rows = join_keys(flows, first, keys)
    return _solved(rows, keys, F.datediff(day, "_first") / 365, amount, guess, name)


def schedule(df: DataFrame, periods: str | Column, name: str = "period") -> DataFrame:
    """One row per loan or asset and period 1..n."""
    n = F.col(periods) if isinstance(periods, str) else periods
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), n.cast("int"))))
