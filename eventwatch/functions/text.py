"""Text helpers used in alert titles, descriptions and evidence."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Byte units, each 1024 of the one before.
BYTE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def or_none(col: Column) -> Column:
    """Missing values print as the word None in the message texts."""
    return F.coalesce(col.cast("string"), F.lit("None"))


def filled(col: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(col != "", col)


def fixed0(col: Column) -> Column:
    """`col` printed without decimals, ties to even."""
    return F.rint(col).cast("bigint").cast("string")


def _tenths_sql(rest: str) -> str:
    """SQL counting the tenths `rest` (0 <= rest < 1) rounds to, judged on its exact binary value."""
    tests = []
    for k in range(10):
        edge = (2 * k + 1) / 20
        error = Decimal(edge) - Decimal(2 * k + 1) / 20
        closed = error > 0 or (error == 0 and k % 2 == 1)
        tests.append(f"if({rest} {'>=' if closed else '>'} {edge!r}D, 1, 0)")
    return " + ".join(tests)


def fixed1(name: str) -> Column:
    """Column `name` printed with one decimal, rounding the exact binary value, ties to even."""
    size = f"abs(double({name}))"
    tenths = f"(floor({size}) * 10 + {_tenths_sql(f'({size} - floor({size}))')})"
    return F.expr(f"if({name} < 0, '-', '') || string({tenths} div 10) || '.' || string({tenths} % 10)")


def exact_round(name: str, digits: int) -> Column:
    """Round column `name` by its exact binary value, ties to even (0.575 is below the tie).

    Spark's own round works on the shortest decimal text of the value, which moves such cases. A
    value equal to the double nearest a tie is judged by the sign of that double's error, found
    with an exact product of its two halves. Takes a column name, as it is mentioned many times.
    """
    scale = f"{float(10 ** digits)!r}D"
    size = f"abs(double({name}))"
    floor = f"floor({size} * {scale})"
    # the product may itself have rounded up to the next integer
    low = f"if({floor} / {scale} > {size}, {floor} - 1, {floor})"
    odd = f"({low} * 2 + 1)"
    edge = f"({odd} / (2 * {scale}))"
    spread = f"({edge} * 134217729.0D)"
    high = f"({spread} - ({spread} - {edge}))"
    error = f"(({high} * (2 * {scale}) - {odd}) + ({edge} - {high}) * (2 * {scale}))"
    up = f"({size} > {edge} or ({size} = {edge} and ({error} > 0 or ({error} = 0 and {low} % 2 = 1))))"
    return F.expr(f"if({name} < 0, -1D, 1D) * ({low} + if({up}, 1, 0)) / {scale}")


def human_bytes(sql: str) -> Column:
    """Byte count (SQL text) with one decimal in the largest unit that keeps it under 1024."""

    def text(power: int) -> str:
        # a multiple of a power of two: its shortest decimal text shows exactly the true ties
        return f"format_string('%.1f {BYTE_UNITS[power]}', bround(double({sql}) / {float(1024 ** power)!r}D, 1))"

    cases = " ".join(f"when {sql} < {float(1024 ** (p + 1))!r}D then {text(p)}" for p in range(5))
    return F.expr(f"case {cases} else {text(5)} end")


def sentence(parts: Column) -> Column:
    """Join with "; ", capital first letter, everything else lower case."""
    text = F.concat_ws("; ", parts)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def lookup(values: list[float], index: Column) -> Column:
    """values[index], clamped to the last entry."""
    table = F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")")
    return F.element_at(table, (F.least(index, F.lit(len(values) - 1)) + 1).cast("int"))
