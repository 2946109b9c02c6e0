"""Defect injection: nulls, outliers, exact and near duplicates.

Rows are picked in the order of md5(key:salt), so a pick is the same on every
run, after a lost executor and in any engine. ``key`` must identify a row;
``with_row_key`` makes one where a table has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.scalars import col, digest, digest_number, quoted, run, text
from ..session import cut_lineage
from .quantiles import select_ranks


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Add a unique key and fix it by a checkpoint, as it depends on task order."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def share_of(total: Column, rate: float, of_result: bool = False) -> Column:
    """floor(total * rate); ``of_result`` takes the share of what the table
    holds after that many rows are added."""
    if of_result:
        return F.round(total * F.lit(rate / (1 - rate))).cast("bigint")
    return F.floor(total * F.lit(float(rate))).cast("bigint")


def _cutoffs(df: DataFrame, key: list[str], rates: dict[str, float]) -> Column:
    """Map salt -> digest of its last picked row, as one scalar: all picks of a
    table come from one chain of counts that reads the key columns only."""
    names = ", ".join(quoted(k) for k in key)
    keys = ", ".join(f"CAST({quoted(k)} AS STRING)" for k in key)
    salts = list(rates)
    marks = ", ".join(f"named_struct('ordinal', {i}, 'mark', md5(concat_ws(':', {keys}, {text(salt)})))" for i, salt in enumerate(salts))
    number = "CAST(CAST(conv(substring(mark, 1, 13), 16, 10) AS BIGINT) AS DOUBLE)"
    long = run(f"SELECT *, {number} AS v FROM (SELECT inline(array({marks})) FROM (SELECT {names} FROM @df@))", df=df)
    share = f"element_at(array({', '.join(f'{float(rates[x])!r}D' for x in salts)}), ordinal + 1)"
    at = select_ranks(long.select("ordinal", "v"), f"filter(array(CAST(floor(total * {share}) AS BIGINT)), r -> r > 0)")
    # rows that share 52 bits of the digest with the last pick: one, by all odds
    last = run(
        f"""
        SELECT map_from_entries(collect_list(struct(salt, mark))) AS cutoffs FROM (
          SELECT /*+ BROADCAST(a) */ element_at(array({', '.join(text(x) for x in salts)}), m.ordinal + 1) AS salt,
                 element_at(sort_array(collect_set(mark)), CAST(least(max(rest), count(DISTINCT mark)) AS INT)) AS mark
          FROM @marks@ m JOIN @at@ a ON m.ordinal = a.ordinal AND m.v = a.v GROUP BY m.ordinal)
        """,
        marks=long, at=at,
    )
    return last.scalar()


def _hit(df: DataFrame, key: list[str], salt: str, rate: float, cutoffs: Column | None) -> Column:
    """Is this row picked: exactly floor(rows * rate) rows by cutoff, or each on its own."""
    mark = digest([col(k) for k in key], salt)
    if cutoffs is None:
        return digest_number(mark) < int(rate * (1 << 52))
    return F.coalesce(mark <= F.try_element_at(cutoffs, F.lit(salt)), F.lit(False))


def inject_nulls(
    df: DataFrame, rates: dict[str, float], key: list[str], seed: int = 42, exact: bool = True, keys: DataFrame | None = None,
) -> DataFrame:
    """Blank floor(rows * rate) cells per column; columns independent, unknown ones
    ignored. Not ``exact``: each cell on its own with that probability. ``keys``
    may name a cheaper table that holds the same keys."""
    salts = {name: f"null:{name}:{seed}" for name in rates if name in df.columns}
    if not salts:
        return df
    cutoffs = _cutoffs(df if keys is None else keys, key, {salts[n]: rates[n] for n in salts}) if exact else None
    changed = {n: F.when(~_hit(df, key, salts[n], rates[n], cutoffs), col(n)) for n in salts}
    return df.select([changed.get(c, col(c)).alias(c) for c in df.columns])


def inject_outliers(
    df: DataFrame, config: dict[str, dict], key: list[str], seed: int = 42, exact: bool = True, keys: DataFrame | None = None,
) -> DataFrame:
    """Overwrite cells with a fixed ``value``, with one of ``choices`` in equal
    shares, or with a number in [``min``, ``max``] (whole for integer columns).
    Default rate 0.02."""
    config = {n: c for n, c in config.items() if n in df.columns and ("value" in c or "choices" in c or {"min", "max"} <= set(c))}
    if not config:
        return df
    salts = {n: f"outlier:{n}:{seed}" for n in config}
    rates = {n: c.get("rate", 0.02) for n, c in config.items()}
    cutoffs = _cutoffs(df if keys is None else keys, key, {salts[n]: rates[n] for n in config}) if exact else None
    changed = {}
    for name, c in config.items():
        dtype = df.schema[name].dataType
        part = digest_number(digest([col(k) for k in key], f"value:{name}:{seed}")) / F.lit(float(1 << 52))
        if "value" in c:
            value = F.lit(c["value"])
        elif "choices" in c:
            options = F.array(*[F.lit(x) for x in c["choices"]])
            value = F.element_at(options, (F.floor(part * len(c["choices"])) + 1).cast("int"))
        elif isinstance(dtype, T.IntegralType):
            value = F.floor(part * (int(c["max"]) - int(c["min"]) + 1)) + int(c["min"])
        else:
            value = part * (c["max"] - c["min"]) + F.lit(float(c["min"]))
        changed[name] = F.when(_hit(df, key, salts[name], rates[name], cutoffs), value.cast(dtype)).otherwise(col(name))
    return df.select([changed.get(c, col(c)).alias(c) for c in df.columns])


def with_dense_index(df: DataFrame, key: list[str], salt: str, name: str = "row_index", last: Column | None = None) -> DataFrame:
    """Number rows 1..n in digest order: counts per digest prefix give each
    prefix its offset, and rows are ranked within their prefix only. ``last``: only
    rows up to this number, others are left out by their key before anything is made of them."""
    mark = digest([col(k) for k in key], salt)
    head = F.substring(mark, 1, 4)
    upto = F.sum("count").over(Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1))
    # 16^4 prefixes at most
    offsets = df.groupBy(head.alias("__head")).count().select("__head", F.coalesce(upto, F.lit(0)).alias("__offset"))
    if last is not None:
        df = df.where(head <= offsets.where(F.col("__offset") < last).agg(F.max("__head")).scalar())
    marked = df.withColumn("__mark", mark).withColumn("__head", F.substring("__mark", 1, 4))
    place = F.row_number().over(Window.partitionBy("__head").orderBy("__mark"))
    return (
        marked.join(F.broadcast(offsets), "__head")
        .withColumn(name, (place + F.col("__offset")).cast("bigint"))
        .drop("__head", "__mark", "__offset")
        .where(F.lit(True) if last is None else F.col(name) <= last)
    )


def inject_duplicates(df: DataFrame, rate: float, key: list[str], seed: int = 42, of_result: bool = False) -> DataFrame:
    """Append floor(rows * rate) copies of rows drawn with replacement.

    Draw i takes row 1 + md5(i) mod n of the numbered table; draws fold to one
    count per row before the join. Row i of n makes the draws i, i + n, i + 2 n, ...
    """
    if rate < 0 or (of_result and rate >= 1):
        raise ValueError("rate must not be negative, and below 1 as a share of the result")
    numbered = with_dense_index(df, key, f"order:{seed}")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = share_of(total, rate, of_result)
    made = numbered.where(F.col("row_index") <= wanted).select(F.explode(F.sequence(F.col("row_index"), wanted, total)).alias("draw"), total.alias("n"))
    aim = (F.pmod(digest_number(digest([F.col("draw")], f"draw:{seed}")), F.col("n")) + 1).alias("row_index")
    draws = made.select(aim).groupBy("row_index").count()
    copies = (
        numbered.join(draws, "row_index")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
        .select([col(c) for c in df.columns])
    )
    return df.unionByName(copies)


def near_duplicates(
    df: DataFrame, rate: float, id_column: str, date_column: str | None = None,
    shift_share: float = 0.3, max_shift: int = 3, seed: int = 42, of_result: bool = False,
) -> DataFrame:
    """Append floor(rows * rate) distinct rows under new ids that follow the
    largest one; a share of them gets its date moved by 1..max_shift days."""
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.max(col(id_column)).alias("top"))
    wanted, top = share_of(totals.select("n").scalar(), rate, of_result), totals.select("top").scalar()
    picked = with_dense_index(df, [id_column], f"near:{seed}", last=wanted)
    part = digest_number(digest([col(id_column)], f"shift:{seed}")) / F.lit(float(1 << 52))
    days = (F.floor(digest_number(digest([col(id_column)], f"days:{seed}")) % max_shift) + 1).cast("int")
    made = {id_column: (top + F.col("row_index")).cast(df.schema[id_column].dataType)}
    if date_column:
        moved = col(date_column) + F.make_dt_interval(days)
        if isinstance(df.schema[date_column].dataType, T.DateType):
            moved = F.date_add(col(date_column), days)
        made[date_column] = F.when(part < shift_share, moved).otherwise(col(date_column)).cast(df.schema[date_column].dataType)
    extra = picked.select([made.get(c, col(c)).alias(c) for c in df.columns])
    return df.unionByName(extra)


def shuffled(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Rows in digest order."""
    return df.orderBy(digest([col(k) for k in key], f"shuffle:{seed}"))
