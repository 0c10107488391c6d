"""Numbers as text, rounded by the exact value of the double: half to even, which the JVM's own formats do not do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def scaled(value: Column, places: Column) -> Column:
    """value * 10**places as a whole number, half to even; value is at least 0 and below 2**52, places 0 to 12.

    A double is a whole number m below 2**54 over 2**k; m * 10**places is divided by 2**k in whole numbers.
    """
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n).cast("decimal(20,0)")

    def rounded(q: Column, whole: Column, over: Column) -> Column:
        rest2 = ((whole - (q.cast("decimal(20,0)") * over).cast(_WIDE)) * 2).cast(_WIDE)
        return q + F.when((rest2 > over) | ((rest2 == over) & (q % 2 == 1)), 1).otherwise(0)

    def divided(v: Column, k: Column) -> Column:
        m = (v * F.pow(F.lit(2.0), k)).cast("bigint").cast("decimal(20,0)")
        whole = (m * F.pow(F.lit(10.0), places).cast("decimal(13,0)")).cast(_WIDE)
        half = F.floor(k / 2).cast("int")
        return let(whole, lambda w: let((power(half) * power(k - half)).cast(_WIDE), lambda o: let(_div(w, o), lambda q: rounded(q, w, o))))

    return let(value, lambda v: F.when(v == 0, F.lit(0).cast("bigint")).otherwise(let(F.lit(52) - F.floor(F.log2(v)).cast("int"), lambda k: divided(v, k))))


def _point(digits: Column, places: Column) -> Column:
    """A whole number with its last `places` digits behind the point."""

    def cut(padded: Column) -> Column:
        n = F.length(padded) - places
        return F.when(places == 0, padded).otherwise(F.concat(padded.substr(F.lit(1), n), F.lit("."), padded.substr(n + 1, places)))

    return let(digits.cast("string"), lambda d: let(F.lpad(d, F.greatest(F.length(d), places + 1), F.lit("0")), cut))


def fixed(value: Column, places: int) -> Column:
    """As %.1f, %.2f, ... have it."""
    return let(value, lambda v: F.concat(F.when(v < 0, "-").otherwise(""), _point(scaled(F.abs(v), F.lit(places)), F.lit(places))))


def short(value: Column, digits: int = 3) -> Column:
    """As %.3g has it, of magnitudes from 1e-9 to below 10**digits: so many significant digits, no zeros at the end, powers of ten below 0.0001 or where rounding reaches 10**digits."""
    bare = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+\z", "")).otherwise(t)

    def shown(q: Column, e: Column) -> Column:
        wide = F.concat(bare(_point(q, F.lit(digits - 1))), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        return F.when((e < -4) | (e >= digits), wide).otherwise(bare(_point(q, F.greatest(F.lit(digits - 1) - e, F.lit(0)))))

    def grown(q: Column, e: Column) -> Column:
        # rounding may make another digit
        return let(F.when(q >= 10**digits, 1).otherwise(0), lambda g: let(F.when(g == 1, _div(q, F.lit(10))).otherwise(q), lambda q2: let(e + g, lambda e2: shown(q2, e2))))

    def exponent(x: Column) -> Column:
        guess = F.floor(F.log10(x)).cast("int")
        return let(guess, lambda g: F.when(x >= F.pow(F.lit(10.0), g + 1), g + 1).when(x < F.pow(F.lit(10.0), g), g - 1).otherwise(g))

    text = lambda x: let(exponent(x), lambda e: let(scaled(x, F.lit(digits - 1) - e), lambda q: grown(q, e)))
    return let(value, lambda v: F.when(v == 0, "0").otherwise(F.concat(F.when(v < 0, "-").otherwise(""), text(F.abs(v)))))
