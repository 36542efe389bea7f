"""Conversations from reply trees: root-to-leaf paths, ranked by score, each formatted as one training text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The template's control strings. Texts can't hold them: "<" and "[" are escaped, and "&" so that this can be undone.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def chain(turns: DataFrame) -> DataFrame:
    """Turn tables as trees: each row replies to the one before it (by turn; ties by role, then text)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", F.row_number().over(w).cast("long").alias("node"), "role", "text", F.lit(0.0).alias("score")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths: conv_id, leaf, node, up (steps above the leaf).

    nodes: conv_id, node, parent. Self-joins double the length of the known jumps, so a path of n turns takes log2(n)
    rounds. A parent that doesn't exist counts as none; nodes that no root reaches (cycles) are in no path.
    """
    ids = nodes.select("conv_id", "node", "parent")
    known = ids.select(F.col("conv_id").alias("c"), F.col("node").alias("p")).distinct()
    jump = cut(ids.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p"))).select("conv_id", "node", F.col("parent").alias("to")))
    parents = jump.select(F.col("conv_id").alias("c"), F.col("to").alias("p")).distinct()
    path = ids.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti").select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    most = ids.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    roots = ids.join(jump.select(F.col("conv_id").alias("c"), F.col("node").alias("p")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti").select(F.col("conv_id").alias("rc"), F.col("node").alias("root"))
    for k in range(math.ceil(math.log2(most)) if most > 1 else 0):
        j = jump.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "to")
        path = cut(path.union(path.join(j, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv_id", "leaf", "to", F.col("up") + 2**k)))
        jump = cut(jump.join(j.withColumnRenamed("to", "far"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("to") == F.col("n"))).select("conv_id", "node", F.col("far").alias("to")))
    whole = path.join(roots, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("node") == F.col("root")), "left_semi").select(F.col("conv_id").alias("wc"), F.col("leaf").alias("wl"))
    return path.join(whole, F.col("conv_id").eqNullSafe(F.col("wc")) & (F.col("leaf") == F.col("wl")), "left_semi")


def format_trees(nodes: DataFrame, branches: int = 1, train: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each of the best branches of each conversation: conv_id, leaf, branch, formatted, loss.

    nodes: conv_id, node, parent, role, text, score; extra columns are left out. Branches rank by the sum of their
    scores (null: 0), then by leaf. Null roles and texts count as empty. loss: the (start, length) code-point spans of
    formatted, from 0, that hold the text of the roles in train. Empty tables give no rows.
    """
    nodes = cut(nodes.select("conv_id", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")))
    found = paths(nodes)
    said = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "score", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*train).alias("trained"))
    steps = found.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    whole = steps.groupBy("conv_id", "leaf").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "node", "head", "body", "trained"))).alias("turns"))
    ranked = whole.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf"))).filter(F.col("branch") <= branches)
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + len(END)).cast("long").alias("at"),
            F.when(t["trained"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.char_length(t["head"])).cast("long").alias("start"), F.char_length(t["body"]).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return ranked.select("conv_id", "leaf", "branch", formatted.alias("formatted"), walk["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted conversation."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest_conversations(turns: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted conversations, digested. turns: conv_id, turn, role, text.

    Null roles and texts are empty; a null conv_id is one conversation; rows of equal turn follow by role, then text, and
    repeated rows are turns of their own. Other columns are left out; no rows give no rows.
    """
    out = format_trees(chain(turns)).withColumns({"_turns": read_turns(F.col("formatted")), "_loss": read_loss(F.col("formatted"), F.col("loss"))})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


DIGEST_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
