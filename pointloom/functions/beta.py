"""The Beta distribution's cumulative share and its inverse, as Spark expressions and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Halvings of the interval that a quantile lies in.
HALVINGS = 40


def log_gamma(x: Column) -> Column:
    """ln Gamma by Stirling's series after shifting the argument by eight."""
    y = x + 8
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete Beta function, by Lentz's method, two terms a step.

    Steps grow with the root of the parameters, as its convergence does.
    """
    first = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / (1 + even * s["d"]), 1 + even / s["c"]
        d2, c2 = 1 / (1 + odd * d1), 1 + odd / c1
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

    steps = F.sequence(F.lit(1), (20 + 3 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def beta_share(x: Column, a: Column, b: Column, log_beta: Column) -> Column:
    """The chance that a Beta (a, b) variable is below x, for 0 < x < 1; ``log_beta``: ln B(a, b), held in a column."""
    front = F.exp(a * F.log(x) + b * F.log(1 - x) - log_beta)
    return F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)


def beta_quantile(p: Column, a: Column, b: Column, log_beta: Column) -> Column:
    """The number below which a Beta (a, b) variable lies with chance p; ``log_beta``: ln B(a, b), held in a column.

    The interval from 0 to 1 is halved ``HALVINGS`` times by the regularised incomplete Beta function.
    """

    def halve(s: Column, _: Column) -> Column:
        x = (s["lo"] + s["hi"]) / 2
        low = beta_share(x, a, b, log_beta) < p
        return F.struct(F.when(low, x).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(x).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def beta_quantile_sql(source: str, keys: str) -> str:
    """Table ``quantiles`` of (keys, q), from a select of (keys, p, a, b); to be put after ``with recursive``."""

    def fraction(a: str, b: str, x: str) -> str:
        even, odd = f"(m.m*({b}-m.m)*{x}/(({a}+2*m.m-1)*({a}+2*m.m)))", f"(-({a}+m.m)*({a}+{b}+m.m)*{x}/(({a}+2*m.m)*({a}+2*m.m+1)))"
        d1, c1 = f"(1/(1+{even}*s.d))", f"(1+{even}/s.c)"
        d2, c2 = f"(1/(1+{odd}*{d1}))", f"(1+{odd}/{c1})"
        first = f"(1/(1-({a}+{b})*{x}/({a}+1)))"
        steps = f"list_transform(range(0, cast(21+3*ceil(sqrt(greatest(a, b))) as bigint)), lambda k: {{m: k::double, c: 1.0::double, d: {first}, h: {first}}})"
        return f"list_reduce({steps}, lambda s, m: {{m: m.m, c: {c2}, d: {d2}, h: s.h*{d1}*{c1}*{d2}*{c2}}}).h"

    below = f"case when x < (a+1)/(a+b+2) then exp(a*ln(x)+b*ln(1-x)-lb)*{fraction('a', 'b', 'x')}/a else 1-exp(a*ln(x)+b*ln(1-x)-lb)*{fraction('b', 'a', '(1-x)')}/b end"
    return f"""halves as (select {keys}, p, a, b, lgamma(a)+lgamma(b)-lgamma(a+b) lb, 0 n, 0.0::double lo, 1.0::double hi from ({source}) union all
 select {keys}, p, a, b, lb, n+1, case when low then x else lo end, case when low then hi else x end from (select *, {below} < p low from (select *, (lo+hi)/2 x from halves where n < {HALVINGS}))),
quantiles as (select {keys}, (lo+hi)/2 q from halves where n = {HALVINGS})"""
