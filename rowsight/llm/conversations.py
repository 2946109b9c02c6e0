"""Reply trees to formatted conversations.

Messages point to the message they answer. Root-to-leaf paths are enumerated by
iterative self-joins that double the distance in each round, so a thread of a
thousand replies takes ten rounds. Branches are ranked by the sum of their
messages' scores, the chosen ones are formatted as one conversation each, with a
mask of what is to be learnt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from rowsight.functions.scalars import col
from rowsight.llm.shared import settled

START, BODY, END = "<|start|>", "<|text|>", "<|end|>"
#: fixed values: control strings of this and other common templates, none of which may survive inside a text
CONTROL = ["<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"]
#: escapes are this character and a digit; the character itself is number 0
ESCAPE = "␛"


def escaped(text: Column) -> Column:
    """Text without any control string; ``unescaped`` gives it back."""
    for i, control in enumerate([ESCAPE, *CONTROL]):
        text = F.replace(text, F.lit(control), F.lit(f"{ESCAPE}{i}"))
    return text


def unescaped(text: Column) -> Column:
    for i, control in reversed(list(enumerate([ESCAPE, *CONTROL]))):
        text = F.replace(text, F.lit(f"{ESCAPE}{i}"), F.lit(control))
    return text


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best root-to-leaf paths of each tree: (tree, leaf, branch, score, node, depth) for each message on one.

    ``messages``: (tree, node, parent, score), nodes unique within their tree, parent
    null at roots. A path's score is the sum of its messages' scores (null counts 0);
    the ``branches`` highest of each tree are kept, ties to the smaller leaf. Messages
    whose parents are missing or go round in a circle hang on no root and are on no
    path. A tree may have several roots. All keys compare null-safe.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    # hop: from a node to the ancestor 2 ** round steps up (null beyond the root), with the scores from the node up to before it
    first = settled(nodes.select("tree", "node", F.col("parent").alias("up"), "score", F.lit(1).cast("bigint").alias("depth")))
    hop, whole = first.where("up IS NOT NULL"), first.where("up IS NULL")  # still climbing; arrived at a root
    hops, rounds, limit = [hop], 0, None
    while True:
        above = hop.union(whole).select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"))
        joined = hop.join(above, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2")), "left")
        # a parent that isn't there leaves the node hanging for good
        after = joined.select(
            "tree", "node", F.when(F.col("n2").isNull(), F.col("up")).otherwise(F.col("up2")).alias("up"),
            (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
        )
        seen = Observation()
        after = settled(after.observe(seen, F.count_if(F.col("up").isNotNull()).alias("open"), F.count("*").alias("n")))
        hop, whole = after.where("up IS NOT NULL"), whole.union(after.where("up IS NULL"))
        rounds += 1
        limit = limit or max(1, seen.get["n"]).bit_length() + 1
        if not seen.get["open"] or rounds > limit:  # what is open after that many doublings is no tree
            break
        hops.append(hop)
    whole = whole.select("tree", "node", "score", "depth")
    inner = nodes.where("parent IS NOT NULL").select(F.col("tree").alias("t2"), F.col("parent").alias("n2")).distinct()
    leaves = whole.join(inner, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti")
    ranked = leaves.selectExpr("tree", "node AS leaf", "score", "depth", "row_number() OVER (PARTITION BY tree ORDER BY score DESC, node) AS branch").where(f"branch <= {branches}")
    walk = settled(ranked.select("tree", "leaf", "branch", "score", F.col("leaf").alias("node"), "depth"))
    for step, hop in enumerate(hops):  # everything within 2 ** step of the leaf is there; add as much again
        up = hop.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        further = walk.join(up, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).where("up IS NOT NULL")
        walk = walk.union(further.select("tree", "leaf", "branch", "score", F.col("up").alias("node"), (F.col("depth") - (1 << step)).alias("depth")))
        walk = settled(walk) if step % 4 == 3 else walk
    return walk


def threads(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages (tree, node, parent, score, role, text) of plain conversations: each turn answers the one before.

    Equal turns of a conversation follow one another by role and text.
    """
    rows = turns.select(col(conversation).alias("tree"), col(turn).alias("turn"), col(role).cast("string").alias("role"), col(text).cast("string").alias("text"))
    numbered = rows.selectExpr("tree", "row_number() OVER (PARTITION BY tree ORDER BY turn, role, text) AS node", "role", "text")
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def formatted(messages: DataFrame, branches: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One conversation for each chosen path: (tree, leaf, branch, score, n_turns, formatted, loss_spans).

    ``messages``: (tree, node, parent, score, role, text), see ``paths``. Null roles
    and texts are empty. Each turn is START role BODY text END with control strings
    escaped. loss_spans: (start, length) in characters of the escaped texts of roles
    in ``learn``, in order.
    """
    messages = settled(messages)
    body = messages.select(
        F.col("tree").alias("t3"), F.col("node").alias("n3"), F.coalesce("role", F.lit("")).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"),
    )
    turns = paths(messages, branches).join(body, F.col("tree").eqNullSafe(F.col("t3")) & (F.col("node") == F.col("n3")))
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(BODY))
    one = F.struct("depth", head.alias("head"), "text", F.col("role").isin(list(learn)).alias("learnt"))
    path = turns.groupBy("tree", "leaf", "branch", "score").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    # running ends of the turns give the texts' places
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.char_length(t["head"]) + F.char_length(t["text"]) + len(END)).alias("at"),
            F.when(t["learnt"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["text"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return path.select("tree", "leaf", "branch", "score", F.size("turns").cast("bigint").alias("n_turns"), whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(text: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(text, r"<\|end\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring(p, len(START) + 1, F.char_length(p)), BODY, 1)).alias("role"),
            unescaped(F.substring_index(p, BODY, -1)).alias("text"),
        ),
    )


def learnt(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")
