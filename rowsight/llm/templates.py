"""Line deduplication with a log-template tree.

Lines fall into the leaves of a tree of fixed depth: by their number of tokens, then
by their leading tokens, words with digits standing for any value. In a leaf with
several distinct lines, a position whose token is not shared by most of them is a
variable field; lines that agree with enough of the constant positions have the
leaf's template. The others are split by the most shared of their tokens and tried
again, until no group that is in enough documents is left; so a leaf has as many
templates as it needs. Lines without any are templates of their own. A template that
recurs in enough documents is dropped everywhere but in the first of them.

A template stays unseen if its variable fields hold, in every one of its lines, another
token that is more common in the leaf than all of its constants, as each line then goes
another way.

All of it is DataFrame operations. Lines travel as two hashes; the text of a line
is shuffled only to compare lines within leaves and to rebuild documents. Counts
fold before each shuffle, so a very common line costs one record per task; joins
back to its occurrences are sort-merge joins that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowsight.functions.scalars import col
from rowsight.llm.shared import free_name, settled

#: stands for a variable field
ANY = "<*>"
#: documents for a line under min_tokens tokens, which counts as it is written; tokens from which two documents are enough
WHOLE_JOB = {"short_docs": 8, "long_tokens": 50}


SPACE = r" \t\r\x0B\f"


def tokens(line: Column) -> Column:
    """Words of a line, those with a digit as ANY; one empty word if there is none."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+", ANY)).otherwise(line)
    return F.split(F.trim(masked, F.lit(" \t\r\x0b\f")), rf"[{SPACE}]+")


def occurrences(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int, min_docs: int, short_docs: int | None, long_tokens: int | None) -> DataFrame:
    """(doc, body, line_no, leaf, line, need): every line that may recur, and in how many documents it must; body is a hash of the document's text.

    A line under ``min_tokens`` tokens is a leaf of its own.
    """
    text = col(text_col).cast("string")
    lines = docs.where(col(id_col).isNotNull() & text.isNotNull()).select(col(id_col).alias("doc"), F.xxhash64(text).alias("body"), F.posexplode(F.split(text, "\n")).alias("line_no", "said"))
    size, said = F.size("tokens"), F.trim("said", F.lit(" \t\r\x0b\f"))
    parsed = lines.select("doc", "body", "line_no", "said", tokens(F.col("said")).alias("tokens"))
    leaf = F.xxhash64(size, *[F.get("tokens", F.lit(i)) for i in range(depth)])
    need = F.lit(min_docs) if long_tokens is None else F.when(size >= long_tokens, min(2, min_docs)).otherwise(min_docs)
    # a generator and not a filter: a filter would be pushed below and split every line twice
    one = F.when(size >= min_tokens, F.array(F.struct(leaf.alias("leaf"), F.xxhash64("tokens").alias("line"), need.alias("need"))))
    if short_docs is not None:
        whole = F.struct(F.xxhash64(said).alias("leaf"), F.xxhash64(said, F.lit(1)).alias("line"), F.lit(short_docs).alias("need"))
        one = one.when(F.get("tokens", F.lit(0)) != "", F.array(whole))
    return parsed.select("doc", "body", "line_no", F.inline(one))


def decisions(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int, similarity: float, min_docs: int, short_docs: int | None, long_tokens: int | None) -> DataFrame:
    """(doc, body, line_no) of the lines to drop."""
    where = settled(occurrences(docs, id_col, text_col, depth, min_tokens, min_docs, short_docs, long_tokens))
    held = where.groupBy("leaf", "line", "need", "doc").agg(F.min(F.struct("body", "line_no")).alias("at"))
    exact = settled(held.groupBy("leaf", "line", "need").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "at")).alias("rep")).select("leaf", "line", "need", "docs", F.col("rep.doc").alias("first_doc"), "rep.at.body", "rep.at.line_no"))
    # leaves whose lines together are in too few documents have nothing to drop
    crowded = exact.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs"), F.max("need").alias("need")).where("lines > 1 AND docs >= need")

    # one document shows each line of a crowded leaf
    shown = exact.join(crowded.select("leaf"), "leaf", "left_semi").groupBy(F.col("first_doc").alias("doc"), "body").agg(F.collect_list(F.struct("leaf", "line", "need", "docs", "line_no")).alias("lines"))
    text = col(text_col).cast("string")
    bodies = docs.select(col(id_col).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text")).join(shown, ["doc", "body"])
    texts = bodies.select(F.split("text", "\n").alias("said"), F.inline("lines")).select("leaf", "line", "need", "docs", F.col("leaf").alias("group"), tokens(F.get("said", "line_no")).alias("tokens"))
    texts = settled(texts.dropDuplicates(["leaf", "line"]))
    matched = assigned(texts, depth, similarity)

    # documents of a template: of all its lines together
    spread = where.select("leaf", "line", "need", "doc").join(matched, ["leaf", "line"]).select("template", "need", "doc").distinct()
    of_template = spread.groupBy("template", "need").agg(F.count("*").alias("docs"), F.min("doc").alias("first_doc")).where("docs >= need")
    shared = matched.join(of_template, "template").select("leaf", "line", "first_doc")
    alone = exact.where("docs >= need").join(matched, ["leaf", "line"], "left_anti").select("leaf", "line", "first_doc")
    return where.join(shared.union(alone), ["leaf", "line"]).where("doc <> first_doc").select("doc", "body", "line_no")


def agrees(similarity: float) -> Column:
    size = F.size("tokens")
    agreeing = F.size(F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get("tokens", i) == F.get("template", i)))
    return agreeing >= F.lit(similarity) * size


def of_majority(lines: DataFrame, similarity: float) -> DataFrame:
    """(leaf, line, template): lines that agree with the tokens that more than half of their group's lines share."""
    votes = lines.select("group", F.posexplode("tokens").alias("at", "token")).groupBy("group", "at", "token").agg(F.count("*").alias("n"))
    sizes = lines.groupBy("group").agg(F.count("*").alias("lines"))
    top = votes.groupBy("group", "at").agg(F.max(F.struct("n", "token")).alias("top")).join(sizes, "group")
    field = F.struct("at", F.when(F.expr("2 * top.n > lines"), F.col("top.token")).otherwise(ANY).alias("token"))
    template = F.transform(F.array_sort(F.collect_list(field)), lambda x: x["token"])
    return lines.join(top.groupBy("group").agg(template.alias("template")), "group").where(agrees(similarity)).select("leaf", "line", "template")


def split(lines: DataFrame) -> DataFrame:
    """``lines`` in new groups: each goes with those of its group that have the most shared of its tokens, at the same position.

    Tokens that a whole group shares don't count, so every round adds a position that
    a group agrees on, and rounds end. Lines that share no such token with another,
    and groups in too few documents, are left out.
    """
    each = lines.select("group", "leaf", "line", F.posexplode("tokens").alias("at", "token"))
    votes = each.groupBy("group", "at", "token").agg(F.count("*").alias("n"))
    sizes = lines.groupBy("group").agg(F.count("*").alias("lines"))
    telling = votes.join(sizes, "group").where("n > 1 AND n < lines").drop("lines")
    best = each.join(telling, ["group", "at", "token"]).groupBy("leaf", "line").agg(F.max(F.struct("n", (-F.col("at")).alias("at"), "token", "group")).alias("best"))
    moved = lines.drop("group").join(best.select("leaf", "line", F.xxhash64("best.group", "best.at", "best.token").alias("group")), ["leaf", "line"])
    large = moved.groupBy("group").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs"), F.max("need").alias("need")).where("lines > 1 AND docs >= need")
    return moved.join(large.select("group"), "group", "left_semi")


def pieces(words: Column, depth: int, similarity: float) -> Column:
    """Hashes of the pieces into which the tokens behind the leading ones are cut: one more than a line
    may have tokens that differ from its template, so that line and template have a piece in common."""
    size = F.size(words)
    n = (size - F.ceil(F.lit(similarity) * size) + 1).cast("int")
    cut = lambda c: F.floor(c * F.greatest(size - depth, F.lit(0)) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.xxhash64(c, F.slice(words, cut(c) + depth + 1, cut(c + 1) - cut(c))))


def assigned(texts: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(leaf, line, template): the lines that have a template, and a hash of it.

    The first round takes each leaf's majority. What it leaves is split and tried again
    until nothing is left to split; then every such line takes, of all templates found
    on the way that it agrees with, the one with most documents.
    """
    first = settled(of_majority(texts, similarity).select("leaf", "line", F.col("leaf").alias("template")))
    rest = settled(texts.join(first, ["leaf", "line"], "left_anti"))
    found, open_ = None, settled(split(rest))
    while not open_.isEmpty():
        hit = settled(of_majority(open_, similarity))
        found = hit.select("leaf", "template") if found is None else found.union(hit.select("leaf", "template"))
        open_ = settled(split(open_.join(hit, ["leaf", "line"], "left_anti")))
    if found is None:
        return first
    keyed = found.distinct().select("leaf", "template", F.explode(F.array_distinct(pieces(F.col("template"), depth, similarity))).alias("piece"))
    lines = rest.select("leaf", "line", "docs", "tokens", F.explode(F.array_distinct(pieces(F.col("tokens"), depth, similarity))).alias("piece"))
    pairs = lines.join(keyed, ["leaf", "piece"]).where(agrees(similarity))
    pairs = settled(pairs.select("leaf", "line", "docs", F.xxhash64("leaf", "template").alias("template")).distinct())
    support = pairs.groupBy("template").agg(F.sum("docs").alias("docs"))
    best = pairs.drop("docs").join(support, "template").groupBy("leaf", "line").agg(F.max(F.struct("docs", "template")).alias("best"))
    return first.union(best.select("leaf", "line", "best.template"))


def drop_recurring(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_tokens: int = 8, similarity: float = 0.7, min_docs: int = 3,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped", short_docs: int | None = None, long_tokens: int | None = None,
) -> DataFrame:
    """The columns of ``docs`` with recurring lines taken out of the text, and how many lines it had and lost.

    A line is a template's if it has its number of tokens, its first ``depth`` tokens
    and at least ``similarity`` of its tokens equal to the template's (variable fields
    don't count as equal, values with digits do). Templates found in ``min_docs``
    documents or more stay in the document with the smallest id only. Templates of ``long_tokens``
    tokens or more need two documents only. Lines under ``min_tokens`` tokens recur if
    ``short_docs`` documents have the very same line, white space around it apart;
    blank lines always stay. Without these two parameters (``WHOLE_JOB`` has both),
    short lines stay and long ones are as any other. Null texts and rows with a null id pass
    unchanged; rows that repeat an id are one document, and keep or lose lines by
    their own text. An empty table gives an empty result.
    """
    n_lines, n_dropped, body, gone = (free_name(docs, x) for x in (n_lines, n_dropped, "__body", "__gone"))
    drop = decisions(docs, id_col, text_col, depth, min_tokens, similarity, min_docs, short_docs, long_tokens).distinct()
    per_doc = drop.groupBy("doc", "body").agg(F.collect_list("line_no").alias(gone))
    text = col(text_col).cast("string")
    lines = F.split(text, "\n")
    joined = docs.withColumn(body, F.xxhash64(text)).join(per_doc.select(F.col("doc").alias("__doc__"), F.col("body").alias("__body__"), gone), (col(id_col) == F.col("__doc__")) & (F.col(body) == F.col("__body__")), "left")
    # the lines stand outside the function of a line, or the text would be split again for each of them
    rebuilt = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(gone, i)), "\n"))
    columns = [rebuilt.alias(c) if c == text_col else col(c) for c in docs.columns]
    return joined.select(*columns, *[F.when(x.isNotNull(), F.size(x)).otherwise(0).cast("bigint").alias(name) for x, name in ((lines, n_lines), (F.col(gone), n_dropped))])
