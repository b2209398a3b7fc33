"""Queue formulas as column expressions: headcount, M/M/c delay, staffing."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def naive_count(cells: Column, threshold=40, scale=0.8) -> Column:
    return F.size(F.filter(cells, lambda c: c > threshold)) * F.lit(scale)


def predict_count(cells: Column, a, b) -> Column:
    total = F.aggregate(cells, F.lit(0.0), lambda s, c: s + c)
    return F.greatest(F.lit(0.0), total * a + b)


def _term(rho, k):
    return F.pow(rho, k) / F.factorial(k.cast("int"))


def erlang_c(rho: Column, c: Column) -> Column:
    """Chance that an arrival waits; 1 when saturated, NULL for invalid input.

    Factorials stay exact up to 20 servers.
    """
    base = F.aggregate(F.sequence(F.lit(0), F.greatest(c.cast("int") - 1, F.lit(0))),
                       F.lit(0.0), lambda s, k: s + _term(rho, k))
    tail = F.try_divide(_term(rho, c), 1.0 - rho / c)
    return (F.when((c <= 0) | (rho < 0), F.lit(None).cast("double"))
            .when(rho >= c, F.lit(1.0))
            .otherwise(F.try_divide(tail, base + tail)))


def erlang_wait(rho: Column, c: Column, mu: Column) -> Column:
    """Mean wait; infinite when saturated, NULL for invalid input."""
    return (F.when((mu <= 0) | (c <= 0) | (rho < 0), F.lit(None).cast("double"))
            .when(rho >= c, F.lit(float("inf")))
            .otherwise(F.try_divide(erlang_c(rho, c), c * mu - rho * mu)))


def forecast_wait(rho, c, mu, naive_wait) -> Column:
    mean = erlang_wait(rho, c, mu)
    return F.when(mean.isNotNull(), F.greatest(mean, naive_wait))


def required_servers(lam: Column, mu: Column, target_s: Column, max_servers=16) -> Column:
    """Smallest server count whose mean wait meets the target, else the maximum."""
    rho = F.try_divide(lam, mu)
    fits = F.filter(F.sequence(F.lit(1), F.lit(max_servers)),
                    lambda c: (rho < c) & (erlang_wait(rho, c, mu) <= target_s))
    return (F.when((lam <= 0) | (mu <= 0), F.lit(1))
            .otherwise(F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(max_servers))))


def staffing_advice(current: Column, lam: Column, mu: Column, target_s: Column,
                    max_servers=16) -> Column:
    """Struct with the advice, NULL when enough counters are open."""
    need = required_servers(lam, mu, target_s, max_servers)
    return F.when(need > current, F.struct(
        need.alias("open"),
        F.round(lam * 60, 2).alias("lambda_per_min"),
        F.round(mu * 60, 2).alias("mu_per_min"),
        erlang_wait(F.try_divide(lam, mu), need, mu).alias("projected_wait_s")))
