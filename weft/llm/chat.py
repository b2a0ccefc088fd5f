"""Chat formatting from reply trees.

Messages point to the message they reply to. Self-joins by pointer doubling give every message its distance and summed score
from the root; leaves are ranked by that score within their tree, and the paths of the chosen leaves are expanded by the same
doubled pointers. Each path becomes one formatted conversation.

Template: every turn is ``### <role>: <text></turn>`` and a newline. In roles and texts a backslash goes before each of
``\\ # <`` (in roles also ``:``), so no marker can occur inside them, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

_TEXT, _ROLE = re.compile(r"([\\#<])"), re.compile(r"([\\#<:])")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*?): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


def write_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (code points) of it that count for the loss: texts of role ``learn``."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"### {_ROLE.sub(r'\\\1', role)}: ", _TEXT.sub(r"\\\1", text)
        if role == learn:
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises if it is not one."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((_UNESCAPE.sub(r"\1", m[1]), _UNESCAPE.sub(r"\1", m[2])))
        at = m.end()
    return out


def masked_text(formatted: str, mask: list[tuple[int, int]]) -> str:
    """All text under the mask, unescaped."""
    return "".join(_UNESCAPE.sub(r"\1", formatted[a:b]) for a, b in mask)


def paths(spark: SparkSession, messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Chosen root-to-leaf paths of reply trees (conv_id, msg_id, parent_id, score): (conv_id, leaf, rank, msg_id, up).

    up: steps from the leaf. A parent that is null, missing or the message itself makes a root. Branches of a conversation
    are ranked by the summed score of their messages (null: 0), highest first, ties to the smaller leaf; ``branches`` of them
    are taken, or all. Messages in a ring of replies, or replying to one, hang on no root and are on no path, and neither are
    rows without conv_id or msg_id. (conv_id, msg_id) must be distinct.
    """
    messages = messages.filter(F.col("conv_id").isNotNull() & F.col("msg_id").isNotNull())
    ids = messages.select("conv_id", "msg_id")
    parents = ids.withColumnRenamed("msg_id", "parent_id")
    known = messages.filter(F.col("msg_id") != F.col("parent_id")).join(parents, ["conv_id", "parent_id"], "left_semi").select("conv_id", "msg_id", F.col("parent_id").alias("to"))
    step = written(spark, messages.select("conv_id", "msg_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
                   .join(known, ["conv_id", "msg_id"], "left"), "step0")
    # after i rounds ``to`` is the ancestor 2**i steps up, total the score from there (without it) down; who has none is done
    done, steps, left = [step.filter(F.col("to").isNull())], [], None
    step = step.filter(F.col("to").isNotNull())
    while (now := step.count()) and now != left:  # a round that ends no path finds only rings
        left = now
        steps.append(step)
        up = reduce(DataFrame.unionByName, done, step).select("conv_id", F.col("msg_id").alias("to"), F.col("to").alias("next"), F.col("total").alias("more"))
        step = written(spark, step.join(up, ["conv_id", "to"]).select("conv_id", "msg_id", (F.col("total") + F.col("more")).alias("total"), F.col("next").alias("to")), f"step{len(steps)}")
        done.append(step.filter(F.col("to").isNull()))
        step = step.filter(F.col("to").isNotNull())
    leaves = reduce(DataFrame.unionByName, done).join(known.select("conv_id", F.col("to").alias("msg_id")), ["conv_id", "msg_id"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("total"), "msg_id")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    path = written(spark, ranked.select("conv_id", F.col("msg_id").alias("leaf"), "rank", "msg_id", F.lit(0).cast("long").alias("up")), "leaves")
    for i, step in enumerate(steps):
        pointer = step.select("conv_id", "msg_id", "to")
        higher = path.join(pointer, ["conv_id", "msg_id"]).select("conv_id", "leaf", "rank", F.col("to").alias("msg_id"), (F.col("up") + (1 << i)).alias("up"))
        path = written(spark, path.unionByName(higher), f"path{i}")
    return path


def format_paths(spark: SparkSession, messages: DataFrame, branches: int | None = None, learn: str = "assistant") -> DataFrame:
    """One formatted conversation for each chosen path: (conv_id, leaf, rank, formatted, mask).

    messages: conv_id, msg_id, parent_id, role, text, score. A null role or text is empty; an empty table gives no rows.
    """
    chosen = paths(spark, messages.select("conv_id", "msg_id", "parent_id", "score"), branches)
    turns = (chosen.join(messages.select("conv_id", "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["conv_id", "msg_id"])
             .groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns")))

    def run(batches):
        for b in batches:
            made = [write_turns([(t["role"], t["text"]) for t in turns], learn) for turns in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([f for f, _ in made], pa.string()),
                                              pa.array([[{"start": a, "end": z} for a, z in m] for _, m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                                             names=["conv_id", "leaf", "rank", "formatted", "mask"])

    return turns.mapInArrow(run, "conv_id long, leaf long, rank int, formatted string, mask array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: counts and digests of turns and of the text under the mask."""
    def run(batches):
        for b in batches:
            rows = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, mask in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns, loss = read_turns(text), masked_text(text, [(m["start"], m["end"]) for m in mask])
                for k, v in zip(rows, (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in rows.items())], names=["conv_id", *rows])

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chained(conversations: DataFrame) -> DataFrame:
    """Plain conversations as trees: each row replies to the one before it by turn (null turns first; ties by role, text).

    Rows without conv_id belong to no conversation. Repeated rows are turns of their own.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", F.row_number().over(order).cast("long").alias("msg_id"), "role", "text", F.lit(1.0).alias("score"))
    return rows.withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))


SAID = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_paths(spark, written(spark, chained(rows), "messages")))
