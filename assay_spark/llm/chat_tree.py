"""Operator 6: reply trees to formatted conversations.

Messages (id, parent, role, text, score) form trees.  Iterative self-joins find
every message's root, depth and path score: each round doubles how far up a
message has looked, so a path of n messages takes log2(n) rounds.  Leaves are
ranked by path score within their tree (ties: smaller id), the best ``branches``
stay, and the same doubled links enumerate each chosen path from leaf to root.
A path becomes one conversation text.

Template: ``<turn:ROLE>`` newline, text, ``</turn>`` newline, per turn.  Inside
roles and texts ``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes
``\\g``, so a raw ``<`` is always the template's and ``read_back`` restores every
turn.  The loss mask is a list of (start, length) spans in code points, one per
assistant text.

A message whose parent is absent, or itself, is a root.  Null roles and texts count as
empty, null scores as 0.  Ids must be unique and not null; a cycle raises.  An
empty table gives no conversations.  Extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay_spark.llm.common import stage, unstage

#: The escapes of the template.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
#: Rounds of doubling; paths of up to 2**MAX_ROUNDS messages.
MAX_ROUNDS = 40
#: Parts of a tree whose leaves are ranked separately first.
SALTS = 16
_TURN = re.compile(r"<turn:([^<>]*)>\n([^<>]*)</turn>\n")


def escape(s: str) -> str:
    for raw, safe in ESCAPES:
        s = s.replace(raw, safe)
    return s


def unescape(s: str) -> str:
    for raw, safe in reversed(ESCAPES):
        s = s.replace(safe, raw)
    return s


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[dict]]:
    """The text of one conversation and its loss spans."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn:{escape(role)}>\n", escape(text)
        if role == learn:
            spans.append({"start": at + len(head), "length": len(body)})
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def learned_text(formatted: str, spans) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[s["start"]:s["start"] + s["length"]]) for s in spans)


def links(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Doubled parent links by round, and where every message ends.

    A round holds (id, up) of the messages that have one 2**round above them.
    The ends are (id, top, n, s): the root, and messages and score on the way.
    Messages that have reached their root leave the rounds.
    """
    ids = messages.select(F.col("id").alias("up"), F.lit(True).alias("_is"))
    first = messages.select("id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("up"), "score").join(ids, "up", "left").select(
        "id", F.when(F.col("_is"), F.col("up")).alias("up"), F.col("id").alias("top"), F.lit(1).cast("bigint").alias("n"), F.col("score").alias("s"))
    now, rounds, ends = stage(first, "links"), [], None
    while True:
        done, open_ = now.where("up IS NULL"), now.where("up IS NOT NULL")
        ends = done if ends is None else ends.unionByName(done)
        if not open_.limit(1).count():
            return rounds, ends.drop("up")
        if len(rounds) == MAX_ROUNDS:
            raise ValueError("the messages hold a cycle")
        rounds.append(open_.select("id", "up"))
        higher = open_.unionByName(ends).select(
            F.col("id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("n").alias("_n"), F.col("s").alias("_s"))
        now = stage(open_.join(higher, "up").select(
            "id", F.col("_up").alias("up"), F.col("_top").alias("top"), (F.col("n") + F.col("_n")).alias("n"), (F.col("s") + F.col("_s")).alias("s")), "links")


def best_leaves(messages: DataFrame, reached: DataFrame, branches: int) -> DataFrame:
    """(path, root, rank) of the best leaves of each tree."""
    parents = messages.where("parent != id").select(F.col("parent").alias("id"))
    leaves = reached.join(parents, "id", "left_anti").withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    by = [F.desc("s"), F.asc("id")]
    for keys in (["top", "_salt"], ["top"]):  # a tree with very many leaves is ranked in parts first
        leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= branches)
    return leaves.select(F.col("id").alias("path"), F.col("top").alias("root"), "rank", F.col("s").alias("path_score"))


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(path, root, rank, path_score, n_turns, formatted, loss_spans) of each tree's best branches.

    ``messages``: id, parent, role, text, score; ``path`` is the leaf's id.
    """
    messages = messages.select(
        "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rounds, ends = links(messages)
    chosen = stage(best_leaves(messages, ends, branches), "leaves")
    on_path = chosen.select("path", F.col("path").alias("id"), F.lit(0).cast("bigint").alias("back"))
    for k, level in enumerate(rounds):
        step = on_path.join(level, "id").select(
            "path", F.col("up").alias("id"), (F.col("back") + 2 ** k).alias("back"))
        before, on_path = on_path, stage(on_path.unionByName(step), "paths")
        if k:
            unstage(before)
    turns = on_path.join(messages.select("id", "role", "text"), "id")
    paths = turns.groupBy("path").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in b["turns"]]
            yield pd.DataFrame({"path": b["path"], "n_turns": [len(t) for t in b["turns"]],
                                "formatted": [m[0] for m in made], "loss_spans": [m[1] for m in made]})

    kind = messages.schema["id"].dataType.simpleString()
    texts = paths.mapInPandas(run, f"path {kind}, n_turns bigint, formatted string, loss_spans array<struct<start:bigint,length:bigint>>")
    return texts.join(chosen, "path")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each row answers the one before it.

    Rows of one conversation go by (turn, role, text), nulls first.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    key = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), n.cast("string"))
    rows = rows.withColumn("_at", at)
    return rows.select("conv_id", key(F.col("_at")).alias("id"), F.when(F.col("_at") > 1, key(F.col("_at") - 1)).alias("parent"),
                       "role", "text", F.lit(0.0).alias("score"))
