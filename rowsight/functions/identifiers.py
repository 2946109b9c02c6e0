"""Columns that classify table names, requests and replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: source kinds and the words that point to them
WAREHOUSE, DATABASE = "snowflake", "postgres"
ALIASES = {"postgresql": DATABASE}


def default_connector(configured: list[str], explicit: str | None = None) -> str:
    """Explicit if configured, else the first configured, else explicit, else the warehouse."""
    explicit = (explicit or "").strip()
    if explicit in configured:
        return explicit
    return (configured[0] if configured else None) or explicit or WAREHOUSE


def has_upper_only(c: Column) -> Column:
    """At least one cased letter, none lower case."""
    return (c == F.upper(c)) & (c != F.lower(c))


def has_lower_only(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def detect_connector(dataset_id: Column, configured: tuple[str, ...] = (WAREHOUSE, DATABASE)) -> Column:
    """Source kind from the spelling of the database part."""
    first = F.substring_index(dataset_id, ".", 1)
    low = F.lower(first)
    fallback = configured[0] if configured else WAREHOUSE
    dotted = dataset_id.contains(".")
    found = F.when(dataset_id.isNull(), F.lit(None).cast("string"))
    for kind, test in (
        (WAREHOUSE, has_upper_only(first)),
        (DATABASE, has_lower_only(first)),
        (WAREHOUSE, low.contains("prod") | low.contains("sales")),
        (DATABASE, low.contains("stage") | low.contains("dev")),
    ):
        if kind in configured:
            found = found.when(dotted & test, kind)
    return found.otherwise(fallback)


# fixed values: three-part names in running text, first pattern first
NAME_PATTERNS = (
    r"`([^`]+\.[^`]+\.[^`]+)`",
    r"([A-Z_]+\.[A-Z_]+\.[A-Z_]+)",
    r"([a-z_]+\.[a-z_]+\.[a-z_]+)",
)


def extract_dataset(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in NAME_PATTERNS])


def connector_from_text(text: Column, dataset_id: Column) -> Column:
    """Source kind from words in the text, else from the name; null without a name."""
    low, up = F.lower(text), F.upper(dataset_id)
    return (
        F.when(dataset_id.isNull(), F.lit(None).cast("string"))
        .when(low.contains(WAREHOUSE), WAREHOUSE)
        .when(low.contains(DATABASE), DATABASE)
        .when(up.startswith("STAGE") | up.contains("_STAGE"), DATABASE)
        .when(up.startswith("PROD") | up.contains("_PROD"), WAREHOUSE)
        .when(has_upper_only(dataset_id), WAREHOUSE)
        .otherwise(DATABASE)
    )


def dataset_suffix(dataset_id: Column) -> Column:
    """DB.SCHEMA.TABLE -> db_table; shorter names: dots to underscores."""
    parts = F.split(dataset_id, r"\.")
    return F.lower(
        F.when(F.size(parts) >= 3, F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(2)))).otherwise(
            F.replace(dataset_id, F.lit("."), F.lit("_"))
        )
    )


# fixed values: replies that name no table
NO_TABLE = ("No tables found with sufficient relevance", "No relevant tables found")


def is_valid_response(text: Column) -> Column:
    return ~(text.contains(NO_TABLE[0]) | text.contains(NO_TABLE[1]))


# fixed values: names of the checks, in order, and the phrases that ask for them
CHECKS = ("duplicates", "null_values", "descriptive_stats")
PHRASES = {
    "save_report": r"save report|export report|create files",
    "report": r"comprehensive report|full report|assessment report|generate report",
    "assessment": r"comprehensive assessment|full assessment|all checks",
    "duplicates": r"duplicate",
    "null_values": r"null|missing data|missing value",
    "descriptive_stats": r"descriptive stat|statistics|data summary",
}


def route_intent(text: Column) -> Column:
    """struct(action, checks): which checks a request asks for; all by default."""
    low = F.lower(text)
    every = F.array(*[F.lit(c) for c in CHECKS])
    named = F.filter(
        F.array(*[F.when(low.rlike(PHRASES[c]), c) for c in CHECKS]), lambda c: c.isNotNull()
    )
    action = F.lit("check")
    for name in ("assessment", "report", "save_report"):
        action = F.when(low.rlike(PHRASES[name]), name).otherwise(action)
    some = (action == "check") & (F.size(named) > 0)
    return F.struct(
        F.when((action == "check") & ~some, "assessment").otherwise(action).alias("action"),
        F.when(some, named).otherwise(every).alias("checks"),
    )
