"""Number formatting used by the status reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .address import _col


_FRACTION_BITS = 52


def _let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one_decimal(x: Column) -> Column:
    """A number of at least 1 with one decimal, rounded as C prints `%.1f`.

    The exact binary value decides, ties go to the even digit; Java would round
    the shortest decimal text half up.
    """
    whole = F.floor(x)
    tenfold = ((x - whole) * float(1 << _FRACTION_BITS)).cast("bigint") * 10
    tenths = whole * 10 + F.shiftright(tenfold, _FRACTION_BITS)
    rest, half = tenfold.bitwiseAND((1 << _FRACTION_BITS) - 1), 1 << (_FRACTION_BITS - 1)
    up = (rest > half) | ((rest == half) & (tenths % 2 == 1))
    return _let(
        tenths + F.when(up, 1).otherwise(0),
        lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")),
    )


def compact_count(c) -> Column:
    """`1234` -> `1.2k`, then m and g; text that is no integer stays as it is."""
    text = _col(c).cast("string")
    number = F.when(text.rlike("^-?[0-9]+$"), text).try_cast("double")

    def short(n: Column) -> Column:
        size = F.abs(n)
        unit = F.when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).otherwise(1e3)
        suffix = F.when(size >= 1e9, "g").when(size >= 1e6, "m").otherwise("k")
        digits = F.when(
            size >= 1e3, F.concat(_let(size / unit, _one_decimal), suffix)
        ).otherwise(F.format_string("%.0f", size))
        return F.when(n.isNotNull(), F.concat(F.when(n < 0, "-").otherwise(""), digits))

    return F.coalesce(_let(number, short), text)


def group_digits(c) -> Column:
    return F.format_number(_col(c), 0)
