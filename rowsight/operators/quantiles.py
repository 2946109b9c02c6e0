"""Exact order statistics of many columns at once, without sorting them.

``column_quantiles`` reads a table twice: sketches give each quantile a bracket of
values that surely holds it, and one counting pass finds how many values lie below
each bracket and which lie inside. About a thousandth of the values is shuffled; a
value in a third of all rows, and all that lie outside, fold to counts before that.

``select_ranks`` finds single ranks of (ordinal, v) rows with buckets alone. Each level counts values per bucket, keeps the buckets that hold a wanted rank
and splits only those further: first by magnitude (16 buckets per power of two),
then twice into 65,536 equal steps, at last by value. A bucket of the first
level spans 2^48 doubles at most, so two splits leave about 2^16 values. No task
ever holds more than one bucket table per column, whatever the row count, and a
value repeated in a third of all rows folds to one count before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.scalars import run

# floor(log2) in sixteenths, 0 at 0, negative below
MAGNITUDE = (
    "CAST(CASE WHEN v = 0 THEN 0 ELSE sign(v) * (floor((least(log2(abs(v)), 1100.0D) + 1080.0D) * 16.0D) + 1) END AS INT)"
)
STEP = "CAST(CASE WHEN high > low THEN floor((v - low) / (high - low) * 65536.0D) ELSE 0 END AS INT)"
TALLY = "count(1) AS n, min(v) AS low_, max(v) AS high_"


def _hits(counted: str, keys: str) -> str:
    """Buckets holding a wanted rank, with the rank counted from the bucket's start."""
    return f"""
      SELECT ordinal, total, wanted, low_ AS low, high_ AS high FROM (
        SELECT ordinal, total, low_, high_,
               transform(filter(wanted, w -> w.rest > upto - n AND w.rest <= upto),
                         w -> named_struct('rank', w.rank, 'rest', w.rest - upto + n)) AS wanted
        FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto FROM {counted}))
      WHERE size(wanted) > 0"""


def select_ranks(values: DataFrame, ranks: str) -> DataFrame:
    """(ordinal, v) -> (ordinal, total, v, rank, rest) for the 1-based ranks of
    each ordinal; ``ranks`` is an array in SQL over ``total``, the number of
    values, and ``rest`` the rank among equal values.
    """
    # one statement per step: common table expressions that contain each other may
    # fail when the optimizer inlines them into a union of many tables
    vals = run("SELECT CAST(ordinal AS INT) AS ordinal, CAST(v AS DOUBLE) AS v FROM @values@ WHERE v IS NOT NULL", values=values)
    first = run(f"SELECT ordinal, {MAGNITUDE} AS bucket, {TALLY} FROM @vals@ GROUP BY ordinal, {MAGNITUDE}", vals=vals)
    total = run("SELECT *, sum(n) OVER (PARTITION BY ordinal) AS total FROM @first@", first=first)
    wanted = run(f"SELECT *, transform({ranks}, r -> named_struct('rank', r, 'rest', r)) AS wanted FROM @total@", total=total)
    hits = run(_hits("@counted@", "ordinal"), counted=wanted)
    for bucket in (STEP, STEP, "v"):
        # one row per wanted rank and column at most: bounded by the schema
        counted = run(
            f"""
            SELECT /*+ BROADCAST(h) */ h.ordinal, total, wanted, low, high, {bucket} AS bucket, {TALLY}
            FROM @vals@ x JOIN @hits@ h ON x.ordinal = h.ordinal AND v BETWEEN low AND high
            GROUP BY h.ordinal, total, wanted, low, high, {bucket}
            """,
            vals=vals, hits=hits,
        )
        hits = run(_hits("@counted@", "ordinal, low"), counted=counted)
    return run("SELECT ordinal, total, low AS v, inline(wanted) FROM @hits@", hits=hits)


def _interpolated(spot: str, a: str, b: str) -> str:
    """Value at a place between the ranks of ``a`` and ``b``."""
    part = f"({spot} - floor({spot}))"
    # from the nearer end, as numpy does; next to an infinity that is NaN, even at a whole rank
    return f"CASE WHEN {part} < 0.5D THEN {a} + ({b} - {a}) * {part} ELSE {b} - ({b} - {a}) * (1.0D - {part}) END"


#: a sketch is off by at most 1 / ACCURACY of all ranks; brackets reach SLACK to either side
ACCURACY, SLACK = 10_000, 0.0005
#: up to so many values a bracket is the whole range: there, rounding of ranks outweighs the slack
FEW = 20_000


def column_quantiles(df: DataFrame, numbers: dict[int, str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(ordinal, *names): exact quantiles, with linear interpolation, of SQL expressions over ``df``.

    ``numbers``: ordinal -> expression of type double; nulls don't count. Should a
    sketch ever miss its error bound, the query fails rather than give another value.
    """
    marks = ", ".join(f"{min(1.0, max(0.0, p + side))!r}D" for p in probs for side in (-SLACK, SLACK))
    width = len(probs)
    xs = ", ".join(f"{x} AS x{i}" for i, x in numbers.items())
    cells = ", ".join(f"named_struct('ordinal', {i}, 'place', {at * width}, 'v', x{i})" for at, i in enumerate(numbers))
    sketches = ", ".join(
        f"count(x{i}) AS n{i}, min(x{i}) AS low{i}, max(x{i}) AS high{i}, percentile_approx(x{i}, array({marks}), {ACCURACY}) AS q{i}" for i in numbers
    )
    lows, highs = (
        ", ".join(f"if(n{i} <= {FEW}, {end}{i}, q{i}[{2 * j + side}])" for i in numbers for j in range(width)) for side, end in enumerate(("low", "high"))
    )
    typed = run(f"SELECT {xs} FROM @df@", df=df)
    brackets = run(f"SELECT array({lows}) AS lows, array({highs}) AS highs FROM (SELECT {sketches} FROM @typed@)", typed=typed)
    # how each value lies to its column's brackets, as bits; values outside all of them fold to one record for each way to lie
    inside = " + ".join(f"CAST(v BETWEEN lows[place + {j}] AND highs[place + {j}] AS INT) * {1 << j}" for j in range(width))
    below = " + ".join(f"CAST(v < lows[place + {j}] AS INT) * {1 << j}" for j in range(width))
    placed = run(
        f"""
        SELECT /*+ BROADCAST(s) */ ordinal, {below} AS below, {inside} AS inside, v
        FROM (SELECT inline(array({cells})) FROM @typed@) CROSS JOIN @brackets@ s WHERE v IS NOT NULL
        """,
        typed=typed, brackets=brackets,
    )
    counted = run("SELECT ordinal, below, inside, if(inside > 0, v, NULL) AS v, count(1) AS n FROM @placed@ GROUP BY ordinal, below, inside, if(inside > 0, v, NULL)", placed=placed)
    each = ", ".join(
        f"named_struct('bracket', {j}, 'v', if((inside & {1 << j}) > 0, v, NULL), 'n', if(((inside | below) & {1 << j}) > 0, n, 0L), 'total', n)" for j in range(width)
    )
    flat = run(f"SELECT ordinal, inline(array({each})) FROM @counted@", counted=counted)
    # each bracket's records without a value come first: what lies below
    ranked = run(
        """
        SELECT *, sum(n) OVER (PARTITION BY ordinal, bracket ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto,
               sum(total) OVER (PARTITION BY ordinal, bracket) AS whole
        FROM @flat@
        """,
        flat=flat,
    )
    found, out = ["max(whole) AS total"], []
    for j, (p, name) in enumerate(zip(probs, names)):
        low = f"(CAST(floor((whole - 1) * {float(p)!r}D) AS BIGINT) + 1)"
        mine = f"bracket = {j} AND v IS NOT NULL AND upto >="
        found += [
            f"min(CASE WHEN {mine} {low} THEN v END) AS a{j}", f"min(CASE WHEN {mine} least({low} + 1, whole) THEN v END) AS b{j}",
            f"bool_or(bracket = {j} AND v IS NULL AND upto >= {low}) AS missed{j}",
        ]
        value = _interpolated(f"((total - 1) * {float(p)!r}D)", f"a{j}", f"b{j}")
        out.append(f"CASE WHEN total > 0 THEN if(missed{j} OR b{j} IS NULL, CAST(raise_error('a quantile lies outside its bracket') AS DOUBLE), {value}) END AS {name}")
    return run(
        f"SELECT ordinal, {', '.join(out)} FROM (SELECT ordinal, {', '.join(found)} FROM @ranked@ GROUP BY ordinal)", ranked=ranked
    )


def exact_quantiles(values: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Quantiles with linear interpolation: (ordinal, *names)."""
    spots = [f"((total - 1) * {float(p)!r}D)" for p in probs]
    lows = [f"(CAST(floor({s}) AS BIGINT) + 1)" for s in spots]
    ranks = f"array_distinct(array({', '.join(lows)}, {', '.join(f'least({r} + 1, total)' for r in lows)}))"
    out = []
    for spot, low, name in zip(spots, lows, names):
        a, b = f"max(CASE WHEN rank = {low} THEN v END)", f"max(CASE WHEN rank = least({low} + 1, total) THEN v END)"
        out.append(f"{_interpolated(f'max({spot})', a, b)} AS {name}")
    return run(f"SELECT ordinal, {', '.join(out)} FROM @found@ GROUP BY ordinal", found=select_ranks(values, ranks))
