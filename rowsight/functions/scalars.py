"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def integer_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, two decimals, half up, in integers; null when whole is 0."""
    part, whole = part.cast("bigint"), whole.cast("bigint")
    return F.when(whole > 0, integer_div(part * 20000 + whole, whole * 2) / F.lit(100.0))


def grouped(x: Column) -> Column:
    """1234567 -> 1,234,567"""
    return F.format_number(x, 0)


def fixed(x: Column, digits: int) -> Column:
    """1234.5 -> 1234.50; halves round to even as on binary doubles."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def plain_float(c: Column, dtype: T.DataType) -> Column:
    """Floating NaN becomes null; other types pass."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def has_type(dtype: T.DataType, kinds: tuple[type, ...]) -> bool:
    """Does ``dtype`` hold one of ``kinds`` at any depth?"""
    if isinstance(dtype, kinds):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_type(dtype.elementType, kinds)
    if isinstance(dtype, T.MapType):
        return has_type(dtype.keyType, kinds) or has_type(dtype.valueType, kinds)
    if isinstance(dtype, T.StructType):
        return any(has_type(f.dataType, kinds) for f in dtype.fields)
    return False


def col(name: str) -> Column:
    """Column by exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def quoted(name: str) -> str:
    """Column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str | None) -> str:
    """String literal for SQL text."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def run(sql: str, **frames) -> DataFrame:
    """SQL over DataFrames named @name@ in the text. One statement builds a plan
    far faster than thousands of column calls."""
    session = next(iter(frames.values())).sparkSession
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in frames:
        sql = sql.replace(f"@{name}@", "{" + name + "}")
    return session.sql(sql, **frames)


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def digest(keys: list[Column], salt: str) -> Column:
    """Hex digest of a row key and a salt: an order that looks random and that
    any engine with md5 reproduces."""
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(salt)))


def digest_number(hex_digest: Column) -> Column:
    """First 52 bits of a digest, exact as bigint and as double."""
    return F.conv(F.substring(hex_digest, 1, 13), 16, 10).cast("bigint")
