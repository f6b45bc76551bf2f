"""Rounding of the exact binary value, as C and Python print and round it.

Spark's ``round`` and ``format_string`` round the shortest decimal text of a double, half up, so
1.005 (stored slightly below) becomes 1.01. The helpers here scale by a power of two, which is
exact, and compare the remainder with the half in integers. They stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decimal_units(value: str, digits: int, bits: int) -> Column:
    """``value``, an SQL expression, as a whole number of ``10**-digits`` units; exact ties go to the
    even count.

    ``bits`` sets the fixed-point resolution; |value| * 2**bits * 10**digits must fit a bigint.
    """
    size, scale = 1 << bits, 10**digits
    stretched = f"(abs({value}) * {size}D)"
    whole = f"floor({stretched})"
    rest = f"(({stretched} - {whole}) * {scale}D)"
    total = f"({whole} * {scale}L)"
    base = f"shiftright({total}, {bits})"
    to_half = f"({size // 2}L - ({total} & {size - 1}L))"
    up = f"CASE WHEN {rest} > {to_half} THEN 1L WHEN {rest} = {to_half} THEN {base} & 1L ELSE 0L END"
    return F.expr(f"({base} + {up}) * (CASE WHEN {value} < 0 THEN -1L ELSE 1L END)")


def round_rate(value: str) -> Column:
    """A rate or rate difference (|value| <= 4), an SQL expression, rounded to six decimals."""
    return decimal_units(value, 6, 40) / F.lit(1e6)


def with_two_decimals(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds texts of SQL expressions (|value| below ten million) with two decimals.

    One projection per step: the steps refer to columns instead of repeating their expressions,
    which keeps plans short.
    """
    values = {f"_v_{name}": F.expr(f"CAST({value} AS DOUBLE)") for name, value in texts.items()}
    units = {f"_u_{name}": decimal_units(f"abs(_v_{name})", 2, 20) for name in texts}
    shown = {
        name: F.expr(
            f"concat(if(_v_{name} < 0, '-', ''), CAST(_u_{name} DIV 100 AS STRING), '.', "
            f"lpad(CAST(_u_{name} % 100 AS STRING), 2, '0'))"
        )
        for name in texts
    }
    return df.withColumns(values).withColumns(units).withColumns(shown).drop(*values, *units)
