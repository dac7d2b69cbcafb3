"""Numeric and colour functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNARY: dict[str, Callable[[Column], Column]] = {
    "identity": lambda x: x, "abs": F.abs, "square": lambda x: x * x, "sqrt": F.sqrt,
    "quiet_sqrt": lambda x: F.when(x < 0, F.lit(float("nan"))).otherwise(F.sqrt(F.abs(x))), "log2": lambda x: F.when(x > 0, F.log2(x)),
    "round": lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5),
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "plus": lambda a, b: a + b, "minus": lambda a, b: a - b, "mult": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b),
    "min": F.least, "max": F.greatest, "equals": lambda a, b: (a == b).cast("int"), "cmp": lambda a, b: F.signum(a - b).cast("int"), "pow": F.pow,
    "hypot": F.hypot, "abs_diff": lambda a, b: F.abs(a - b), "square_diff": lambda a, b: (a - b) * (a - b),
    "canberra_diff": lambda a, b: F.try_divide(F.abs(a - b), F.abs(a) + F.abs(b)),
}


def p_diff(p: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))


def plus_mult(m: float) -> Callable[[Column, Column], Column]:
    """a + m * b; a alone for m = 0."""
    return lambda a, b: a if m == 0 else a + F.lit(float(m)) * b


def bind_first(f: Callable[[Column, Column], Column], value: float) -> Callable[[Column], Column]:
    return lambda x: f(F.lit(value), x)


def bind_second(f: Callable[[Column, Column], Column], value: float) -> Callable[[Column], Column]:
    return lambda x: f(x, F.lit(value))


def chain(*functions: Callable) -> Callable:
    """The last function is applied first; only that one may take two arguments."""

    def run(*args):
        out = functions[-1](*args)
        for f in reversed(functions[:-1]):
            out = f(out)
        return out

    return run


# colours -----------------------------------------------------------------------------------------------------------
def hex_to_rgb(text: Column) -> Column:
    h = F.regexp_replace(text, "^#", "")
    part = lambda k: F.conv(F.substring(h, k, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def _hue(r: Column, g: Column, b: Column, top: Column, delta: Column) -> Column:
    """Degrees; 0 for greys."""
    h = F.when(top == r, F.pmod(F.try_divide(g - b, delta), F.lit(6.0))).when(top == g, F.try_divide(b - r, delta) + 2).otherwise(F.try_divide(r - g, delta) + 4)
    return F.coalesce(h * 60, F.lit(0.0))


def hsv(r: Column, g: Column, b: Column) -> Column:
    r, g, b = (c / F.lit(255.0) for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.struct(_hue(r, g, b, top, top - low).alias("h"), F.coalesce(F.try_divide(top - low, top), F.lit(0.0)).alias("s"), top.alias("v"))


def hsl(r: Column, g: Column, b: Column) -> Column:
    r, g, b = (c / F.lit(255.0) for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light = (top + low) / 2
    return F.struct(_hue(r, g, b, top, top - low).alias("h"), F.coalesce(F.try_divide(top - low, 1 - F.abs(2 * light - 1)), F.lit(0.0)).alias("s"), light.alias("l"))
