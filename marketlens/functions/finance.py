"""Finance functions as Columns; a schedule is the same formula per period of an exploded sequence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _growth(rate: Column, n: Column) -> Column:
    return F.pow(1 + rate, n)


def _annuity(rate: Column, n: Column) -> Column:
    """((1 + r)^n - 1) / r, which is n at rate zero."""
    return F.when(rate == 0, n.cast("double")).otherwise(F.try_divide(_growth(rate, n) - 1, rate))


def pmt(rate, nper, pv, fv=0.0, due: int = 0) -> Column:
    """Level payment; ``due`` 1 means at the start of a period."""
    rate, nper, pv, fv = _c(rate), _c(nper), _c(pv), _c(fv)
    return F.try_divide(-fv - pv * _growth(rate, nper), (1 + rate * due) * _annuity(rate, nper))


def _capital_before(rate, per, nper, pv, fv, due: int) -> Column:
    """Capital outstanding when period ``per`` starts."""
    payment = pmt(rate, nper, pv, fv, due)
    if due:
        after_first = pv + payment
        return F.when(per == 1, pv).otherwise(after_first * _growth(rate, per - 2) + payment * _annuity(rate, per - 2))
    return pv * _growth(rate, per - 1) + payment * _annuity(rate, per - 1)


def ipmt(rate, per, nper, pv, fv=0.0, due: int = 0) -> Column:
    """Interest part of period ``per``; null outside 1..nper."""
    rate, per, nper, pv, fv = _c(rate), _c(per), _c(nper), _c(pv), _c(fv)
    interest = -_capital_before(rate, per, nper, pv, fv, due) * rate
    if due:
        interest = F.when(per == 1, F.lit(0.0)).otherwise(interest)
    return F.when((per >= 1) & (per <= nper), interest)


def ppmt(rate, per, nper, pv, fv=0.0, due: int = 0) -> Column:
    """Principal part of period ``per``."""
    return pmt(rate, nper, pv, fv, due) - ipmt(rate, per, nper, pv, fv, due)


def ispmt(rate, per, nper, pv) -> Column:
    """Interest of a loan that repays equal principal; nothing is left in the last period."""
    rate, per, nper, pv = _c(rate), _c(per), _c(nper), _c(pv)
    return F.when(per == nper, F.lit(0.0)).otherwise(-rate * (pv - F.try_divide(pv, nper) * per))


def fv(rate, nper, payment, pv=0.0, due: int = 0) -> Column:
    rate, nper, payment, pv = _c(rate), _c(nper), _c(payment), _c(pv)
    return -pv * _growth(rate, nper) - payment * (1 + rate * due) * _annuity(rate, nper)


def pv(rate, nper, payment, fv_=0.0, due: int = 0) -> Column:
    rate, nper, payment, fv_ = _c(rate), _c(nper), _c(payment), _c(fv_)
    return (-payment * (1 + rate * due) * _annuity(rate, nper) - fv_) / _growth(rate, nper)


def nper(rate, payment, pv_, fv_=0.0, due: int = 0) -> Column:
    """Number of periods; null where no number of periods settles the loan."""
    rate, payment, pv_, fv_ = _c(rate), _c(payment), _c(pv_), _c(fv_)
    level = F.try_divide(payment * (1 + rate * due), rate)
    share = F.try_divide(level - fv_, pv_ + level)
    curved = F.try_divide(F.ln(F.when(share > 0, share)), F.ln(F.when(rate > -1, 1 + rate)))
    return F.when(rate == 0, F.try_divide(-pv_ - fv_, payment)).otherwise(curved)


def effect(nominal_rate, periods) -> Column:
    rate, n = _c(nominal_rate), _c(periods)
    return F.when((rate > 0) & (n >= 1), F.pow(1 + F.try_divide(rate, n), n) - 1)


def nominal(effective_rate, periods) -> Column:
    rate, n = _c(effective_rate), _c(periods)
    return F.when((rate > 0) & (n >= 1), n * (F.pow(rate + 1, F.try_divide(F.lit(1.0), n)) - 1))


def sln(cost, salvage, life) -> Column:
    return F.when(_c(life) >= 0, F.try_divide(_c(cost) - _c(salvage), _c(life)))


def syd(cost, salvage, life, period) -> Column:
    cost, salvage, life, period = _c(cost), _c(salvage), _c(life), _c(period)
    value = F.try_divide((cost - salvage) * (life - period + 1) * 2, life * (life + 1))
    return F.when((life >= 1) & (period <= life), value)


def db(cost, salvage, life, period, months: int = 12) -> Column:
    """Fixed declining balance; the rate is rounded to three digits, the first year has ``months`` months."""
    cost, salvage, life, period = _c(cost), _c(salvage), _c(life), _c(period)
    rate = F.round(1 - F.pow(F.try_divide(salvage, cost), F.try_divide(F.lit(1.0), life)), 3)
    left = lambda n: cost * (1 - rate * months / 12) * F.pow(1 - rate, n)
    value = (
        F.when(period == 1, cost * rate * months / 12)
        .when(period == life + 1, left(life - 1) * rate * (12 - months) / 12)
        .otherwise(left(period - 2) * rate)
    )
    return F.when(cost == 0, F.lit(0.0)).when((cost > 0) & (salvage >= 0) & (life > 0) & (period >= 1), value)


def ddb(cost, salvage, life, period, factor: float = 2.0) -> Column:
    """Declining balance by ``factor`` that stops at the salvage value."""
    cost, salvage, life, period = _c(cost), _c(salvage), _c(life), _c(period)
    rate = F.try_divide(F.lit(float(factor)), life)
    balance = cost * F.pow(1 - rate, period - 1)
    value = F.when(balance <= salvage, F.lit(0.0)).otherwise(F.least(balance * rate, balance - salvage))
    return F.when((cost > 0) & (salvage >= 0) & (life > 0) & (period >= 1) & (period <= life), value)
