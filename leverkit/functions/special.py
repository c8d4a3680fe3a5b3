"""Special functions as Columns: log gamma, the regularised incomplete beta
function, and with it the tail and the quantiles of Student's t.

Arguments are numbers or SQL expressions (a column's name is one).  Each
function is built as one SQL expression: loops of a fixed length run inside
``aggregate`` over a sequence, and a value that a formula uses often is bound
once, as the variable of a ``transform`` over one element, so formulas of
hundreds of steps stay small and are evaluated per row in the JVM.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: coefficients of the continued fraction
STEPS = 200
#: Newton steps of a quantile
NEWTON = 40
#: arguments of the asymptotic series are moved up by this first
SHIFT = 10

Arg = str | float


def _let(body: str, **values: Arg) -> str:
    """``body`` with each name bound to its value, computed once a row."""
    pairs = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in values.items())
    for k in values:
        body = body.replace(f"${k}", f"v{_let.depth}.{k}")
    out = f"transform(array(named_struct({pairs})), v{_let.depth} -> {body})[0]"
    _let.depth += 1  # names of nested variables differ
    return out


_let.depth = 0


def _series(z: str) -> str:
    """Stirling's series: what log gamma has besides its leading terms."""
    return f"((1/12D - (1/360D - (1/1260D - 1/1680D / ({z} * {z})) / ({z} * {z})) / ({z} * {z})) / {z})"


def _log_gamma(x: Arg) -> str:
    rising = " * ".join(f"($x + {k})" for k in range(SHIFT))
    return _let(f"($z - 0.5D) * ln($z) - $z + {0.5 * math.log(2 * math.pi)!r}D + {_series('$z')} - ln({rising})", x=x, z=f"({x}) + {SHIFT}")


def _log_gamma_step(a: Arg, b: Arg) -> str:
    """ln(gamma(a + b) / gamma(a)) without the loss of digits that the
    difference of two large logarithms has."""
    rising = " * ".join(f"(1 + $b / ($a + {k}))" for k in range(SHIFT))
    return _let(f"($z - 0.5D) * log1p($b / $z) + $b * (ln($y) - 1) + {_series('$y')} - {_series('$z')} - ln({rising})",
                a=a, b=b, z=f"({a}) + {SHIFT}", y=f"({a}) + ({b}) + {SHIFT}")


def _log_beta(a: Arg, b: Arg) -> str:
    lo, hi = (f"{f}(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for f in ("least", "greatest"))
    return f"({_log_gamma(lo)} - {_log_gamma_step(hi, lo)})"


def _fraction(steps: int) -> str:
    """The continued fraction 1 / (1 + d1 y / (1 + d2 y / (1 + ...))) of the
    incomplete beta function of $p, $q and $y, from its front: the product of
    the ratios of neighbouring numerators (c) and denominators (d)."""
    away = lambda x: f"if(abs({x}) < 1e-300D, 1e-300D, {x})"
    # coefficients 2, 3, ...: even and odd ones differ
    m = "(e DIV 2)"
    even = f"{m} * ($q - {m}) / (($p + 2 * {m} - 1) * ($p + 2 * {m}))"
    odd = f"-($p + {m}) * ($p + $q + {m}) / (($p + 2 * {m}) * ($p + 2 * {m} + 1))"
    terms = f"transform(sequence(2, {steps}), e -> $y * if(e % 2 = 0, {even}, {odd}))"
    first = f"named_struct('d', 1D, 'c', {away('(1 - ($p + $q) * $y / ($p + 1))')}, 'f', 1D)"
    step = f"named_struct('d', 1 / {away('(1 + t * s.d)')}, 'c', {away('(1 + t / s.c)')}, 'f', s.f * s.d * s.c)"
    return f"aggregate({terms}, {first}, (s, t) -> {step}, s -> 1 / (s.f * s.d * s.c))"


def _beta_inc(a: Arg, b: Arg, x: Arg, steps: int) -> str:
    # the fraction converges fast below the mean; above it, I_x(a, b) = 1 - I_1-x(b, a)
    front = f"exp($p * ln($y) + $q * log1p(-$y) - {_log_beta('$p', '$q')}) / $p"
    part = _let(f"{front} * {_fraction(steps)}", p="if($swap = 1, $b, $a)", q="if($swap = 1, $a, $b)", y="if($swap = 1, 1 - $x, $x)")
    body = (f"CASE WHEN NOT ($a > 0 AND $b > 0 AND $x >= 0 AND $x <= 1) THEN NULL WHEN $x = 0 THEN 0D WHEN $x = 1 THEN 1D "
            f"WHEN $swap = 1 THEN 1 - {part} ELSE {part} END")
    return _let(body, a=a, b=b, x=x, swap=f"int(({x}) > (({a}) + 1) / (({a}) + ({b}) + 2))")


def _t_two_sided(t: Arg, df: Arg, steps: int) -> str:
    # as doubles: a plain number is a decimal in SQL, whose quotients are rounded
    t, df = f"CAST({t} AS DOUBLE)", f"CAST({df} AS DOUBLE)"
    return _beta_inc(f"{df} / 2D", "0.5D", f"{df} / ({df} + {t} * {t})", steps)


def log_gamma(x: Arg) -> Column:
    """ln(gamma(x)) for x > 0."""
    return F.expr(_log_gamma(x))


def beta_inc(a: Arg, b: Arg, x: Arg, steps: int = STEPS) -> Column:
    """Regularised incomplete beta function I_x(a, b); NULL outside a, b > 0
    and 0 <= x <= 1."""
    return F.expr(_beta_inc(a, b, x, steps))


def t_two_sided(t: Arg, df: Arg, steps: int = STEPS) -> Column:
    """P(|T| >= |t|) of Student's t with ``df`` degrees of freedom."""
    return F.expr(_t_two_sided(t, df, steps))


def t_quantile(level: Arg, df: Arg, steps: int = STEPS) -> Column:
    """The t > 0 with P(|T| <= t) = ``level``: half width of a two-sided
    interval in standard errors.

    The tail falls and is convex for t > 0, so Newton's steps from 0 come up
    to the root from one side and never pass it.
    """
    slope = "(2 * exp($c - ($n + 1) / 2 * log1p(t * t / $n)))"
    step = f"t + coalesce(try_divide({_t_two_sided('t', '$n', steps)} - $alpha, {slope}), 0D)"
    body = f"if($n > 0 AND $alpha > 0 AND $alpha < 1, aggregate(sequence(1, {NEWTON}), 0D, (t, i) -> {step}), NULL)"
    return F.expr(_let(body, alpha=f"1 - ({level})", n=df, c=f"-{_log_beta(f'({df}) / 2D', '0.5D')} - 0.5D * ln({df})"))
