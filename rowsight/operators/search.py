"""Which tables is a request about? Vector distance plus word boosts, in batch.

``requests``: request_id, text, embedding. ``index``: full_name (unique),
table_name, connector, embedding and, for context text, document.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.identifiers import DATABASE, WAREHOUSE
from ..functions.scalars import fixed
from .nearest import nearest

# tasks get the code of this module with the closure, no install on executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: characters of request texts that are searched together
TEXTS = 32 << 20

# fixed values: environment words and boosts
STAGING_MARKS = ("stage", "staging", "dev", "test")
STAGING_WORDS = ("stage", "staging", "dev", "development", "test")
PRODUCTION_MARKS = ("prod", "production", "live")
PRODUCTION_WORDS = ("prod", "production", "live")
CONNECTOR_BOOST, NAME_BOOST = 0.3, 0.2
MIN_WORD = 3


def _contains_any(c: Column, words) -> Column:
    found = c.contains(words[0])
    for w in words[1:]:
        found = found | c.contains(w)
    return found


def _words(db: Column) -> Column:
    """Database name and its longer parts."""
    parts = F.filter(F.split(F.replace(db, F.lit("_"), F.lit(" ")), r"\s+"), lambda w: F.length(w) >= MIN_WORD)
    return F.concat(F.array(db), parts)


def keyword_map(sources: DataFrame, index: DataFrame) -> DataFrame:
    """(keyword, connector, position): which source a word points to.

    ``sources`` (source_no, connector, database) come first, then the databases
    of ``index`` in order of their names; the last writer of a keyword wins and
    ``position`` is that of its first writer.
    """
    db = F.lower("database")
    env = F.when(_contains_any(db, STAGING_MARKS), F.array(*[F.lit(w) for w in STAGING_WORDS])).when(
        _contains_any(db, PRODUCTION_MARKS), F.array(*[F.lit(w) for w in PRODUCTION_WORDS])
    ).otherwise(F.array().cast("array<string>"))
    named = F.coalesce(F.col("database"), F.lit("")) != ""
    keys = _words(db)
    configured = sources.where(named).select(
        F.lit(0).alias("stage"), F.col("source_no").cast("bigint").alias("major"), F.lit("").alias("name"), "connector",
        F.posexplode(F.concat(F.slice(keys, 1, 1), env, F.slice(keys, F.lit(2), F.size(keys)))).alias("minor", "keyword"),
    )
    first = F.lower(F.substring_index("full_name", ".", 1))
    # one row per database and connector before the words are made
    databases = (
        index.where(F.col("full_name").contains(".") & (F.col("connector") != ""))
        .groupBy(first.alias("name"), "connector")
        .agg(F.min("full_name").alias("low"), F.max("full_name").alias("high"))
    )

    def written(at: str) -> DataFrame:
        return databases.select(
            F.lit(1).alias("stage"), F.lit(0).cast("bigint").alias("major"), F.col(at).alias("name"), "connector",
            F.posexplode(_words(F.col("name"))).alias("minor", "keyword"),
        )

    when = F.struct("stage", "major", "name", "minor")
    both = configured.unionByName(written("low")).unionByName(written("high"))
    return both.groupBy("keyword").agg(
        F.max_by("connector", F.struct(when, F.col("connector"))).alias("connector"), F.min(when).alias("first")
    ).select("keyword", "connector", "first")


def preferred_connector(requests: DataFrame, keywords: DataFrame) -> DataFrame:
    """(request_id, preferred): named source; else the first word that is a
    keyword; else the earliest keyword found anywhere in the text; else an
    environment word."""
    low = F.lower("text")
    named = F.when(low.contains(DATABASE), DATABASE).when(low.contains(WAREHOUSE), WAREHOUSE)
    base = requests.select("request_id", low.alias("low"), named.alias("named"))
    found = _found_keywords(base.where("named is null").select("request_id", "low"), keywords)

    def environment(words) -> Column:
        order = F.array_position(F.array(*[F.lit(w) for w in words]), F.col("keyword"))
        return keywords.where(F.col("keyword").isin(*words)).agg(F.min_by("connector", order)).scalar()

    by_env = F.when(_contains_any(F.col("low"), STAGING_WORDS), environment(STAGING_WORDS)).when(
        _contains_any(F.col("low"), PRODUCTION_WORDS), environment(PRODUCTION_WORDS)
    )
    return (
        base.join(found, "request_id", "left")
        .select("request_id", F.coalesce("named", "by_word", "by_part", by_env).alias("preferred"))
    )


def _found_keywords(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(request_id, by_word, by_part): connectors of the first word that is a keyword and
    of the earliest keyword anywhere in the text; no row where there is none.

    One automaton of all keywords reads each text once, in time that grows with the
    text and not with the keywords; a text gives one row at most, so that a word
    that most texts hold is no hot key. Keywords are a few words for each database.
    """
    # a text belongs to one of as many buckets as their characters ask for; each bucket meets the keywords once
    buckets = texts.agg(F.greatest(F.ceil(F.coalesce(F.sum(F.length("low")), F.lit(0)) / F.lit(TEXTS)), F.lit(1)).cast("bigint")).scalar()
    placed = texts.where("low is not null").withColumn("bucket", F.pmod(F.xxhash64("request_id"), buckets))
    order = Window.orderBy("first", "keyword")
    ranked = keywords.where("keyword <> ''").select("keyword", "connector", F.row_number().over(order).alias("place"))
    spread = ranked.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), buckets - 1)))

    def read(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        known = {k: (place, connector) for k, connector, place in zip(b["keyword"], b["connector"], b["place"])}
        automaton = ahocorasick.Automaton()
        for k, v in known.items():
            automaton.add_word(k, v)
        if known:
            automaton.make_automaton()
        ids, words, parts = [], [], []
        for key, low in zip(a["request_id"], a["low"]) if known else ():
            word = next((known[w][1] for w in WORD_ENDS.split(low.replace("_", " ")) if w in known), None)
            first = min((v for _, v in automaton.iter(low)), default=None, key=lambda v: v[0])
            if word is not None or first is not None:
                ids.append(key), words.append(word), parts.append(first and first[1])
        return pd.DataFrame({"request_id": ids, "by_word": words, "by_part": parts}, dtype=object)

    kind = texts.schema["request_id"].dataType.simpleString()
    return placed.groupBy("bucket").cogroup(spread.groupBy("bucket")).applyInPandas(read, f"request_id {kind}, by_word string, by_part string")


#: what splits words, as in the SQL functions
WORD_ENDS = re.compile(r"[ \t\n\x0b\f\r]+")


def candidates(requests: DataFrame, index: DataFrame, keywords: DataFrame, n: int, metric: str = "sqeuclidean") -> DataFrame:
    """The n nearest tables of each request, scored: boosts come after this cut."""
    near = nearest(
        requests.select("request_id", "embedding"), index.select("full_name", "embedding"), n, item="full_name", metric=metric
    )
    facts = index.drop("embedding")
    asked = requests.select("request_id", F.lower("text").alias("low")).join(
        preferred_connector(requests, keywords), "request_id"
    )
    hits = F.filter(
        F.split(F.trim("low"), r"\s+"), lambda w: (F.length(w) >= MIN_WORD) & F.contains(F.lower("table_name"), w)
    )
    base = 1 - F.col("distance")
    boosted = F.coalesce(F.col("connector") == F.col("preferred"), F.lit(False))
    table_boost = F.size(hits) * F.lit(NAME_BOOST)
    score = F.least(F.when(boosted, F.least(base + CONNECTOR_BOOST, F.lit(1.0))).otherwise(base) + table_boost, F.lit(1.0))
    return (
        near.withColumnRenamed("rank", "near_rank")
        .join(facts, "full_name")
        .join(asked, "request_id")
        .select(
            "request_id", "full_name", "table_name", "connector", "near_rank", "distance",
            base.alias("base_score"), boosted.alias("boosted"), table_boost.alias("table_boost"),
            F.col("preferred").alias("detected_source"), score.alias("score"),
            *[c for c in ("document",) if c in facts.columns],
        )
    )


def _top(scored: DataFrame, top_k: int, min_relevance: float) -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "distance", "full_name")
    return (
        scored.where(F.col("score") >= min_relevance)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
    )


def pool_size(top_k: int) -> int:
    return max(2 * top_k, 10)


def search_tables(
    requests: DataFrame, index: DataFrame, keywords: DataFrame, top_k: int = 3, min_relevance: float = 0.05,
    metric: str = "sqeuclidean",
) -> DataFrame:
    scored = candidates(requests, index, keywords, pool_size(top_k), metric)
    return _top(scored, top_k, min_relevance).drop("near_rank", "distance")


def search_gate(
    requests: DataFrame, index: DataFrame, keywords: DataFrame, top_k: int = 3, threshold: float = 0.20,
    metric: str = "sqeuclidean",
) -> DataFrame:
    """One row per request: the accepted tables, or why there is none.

    Accepted are the top tables at or above ``threshold``; otherwise the best of
    a wider search (top 10, no threshold below 0) is named in the message.
    """
    scored = candidates(requests, index, keywords, max(pool_size(top_k), pool_size(10)), metric)
    good = (F.col("near_rank") <= pool_size(top_k)) & (F.col("score") >= threshold)
    order = F.struct((-F.col("score")).alias("s"), "distance", "full_name")
    entry = F.struct(
        order.alias("o"), "full_name", "connector", "score",
        *[c for c in ("document",) if c in scored.columns],
    )
    # at most pool_size(10) entries per request
    picked = scored.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.when(good, entry))).alias("good"),
        F.min_by(F.struct("full_name", "score"), F.when(F.col("score") >= 0, order)).alias("best"),
    )
    joined = requests.select("request_id", "text").join(picked, "request_id", "left")
    accepted = F.slice(F.coalesce("good", F.array().cast(picked.schema["good"].dataType)), 1, top_k)
    best = F.col("best")
    message = F.when(F.size("accepted") > 0, F.lit(None).cast("string")).when(
        best.isNotNull(),
        F.concat(
            F.lit(f"No tables found with sufficient relevance (minimum {threshold * 100:.0f}% match required). Best match was '"),
            best["full_name"], F.lit("' with only "), fixed(best["score"] * 100, 1),
            F.lit("% relevance. Please try a more specific table name or check if the table exists in your schema index."),
        ),
    ).otherwise("No relevant tables found. Please ensure the schema index is built.")
    lines = F.transform(
        "accepted",
        lambda t, i: F.concat(
            F.lit("--- Table #"), (i + 1).cast("string"), F.lit(" ---\nConnector Type: "), F.upper(t["connector"]),
            F.lit("\nFull Name: "), t["full_name"], F.lit("\nRelevance: "), fixed(t["score"] * 100, 2), F.lit("%\n"),
            *([F.lit("Metadata:\n"), t["document"], F.lit("\n")] if "document" in scored.columns else []),
        ),
    )
    return joined.withColumn("accepted", accepted).select(
        "request_id",
        (F.size("accepted") > 0).alias("found"),
        F.size("accepted").cast("bigint").alias("table_count"),
        F.get("accepted", F.lit(0))["full_name"].alias("best_table"),
        message.alias("message"),
        F.when(F.size("accepted") > 0, F.concat(F.lit("RELEVANT TABLES (ranked by relevance):\n\n"), F.array_join(lines, "\n"))).alias("context"),
    )


def text_vectors(df: DataFrame, text: str = "text", features: int = 256, out: str = "embedding") -> DataFrame:
    """Unit word-weight vectors for texts that come without an embedding; null
    and empty texts have the zero vector."""
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"[^\p{L}\p{N}]+").transform(df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))))
    counts = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=features).transform(words)
    weights = IDF(inputCol="__counts", outputCol="__weights").fit(counts).transform(counts)
    unit = Normalizer(inputCol="__weights", outputCol="__unit").transform(weights)
    return unit.withColumn(out, vector_to_array("__unit", "float32")).drop("__text", "__words", "__counts", "__weights", "__unit")


def build_index(documents: DataFrame, features: int = 256) -> DataFrame:
    """Table documents with their vectors, ready for ``sinks.write_index``."""
    return text_vectors(documents, "document", features)
