"""Conversations from reply trees.

Messages point at the message they reply to. Each round of self-joins doubles how far up every message sees: its ancestor
2^k steps up and the sum of scores as far as there, three numbers, whatever the depth. After log2(depth) rounds all depths
and mean scores are known and branches are ranked by them. The messages of the chosen branches alone are then listed, from
the leaf up: with the largest jump first, each message listed adds the one that many steps above it, so every message of a
path comes up once. Each path is formatted as one conversation with a mask over what the model is to learn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import write_table

#: Fixed marks of the template.
START, USER, USER_END, ASSISTANT, ASSISTANT_END, OTHER, OTHER_END, ROLE_END = "<s>", "[INST]", "[/INST]", "[ASST]", "</s>", "[ROLE:", "[/ROLE]", "]"
#: Characters that open or close a mark, and the escape itself; no escaped text has any of the first four.
ESCAPES = {"&": "&amp;", "<": "&lt;", "[": "&lsqb;", "]": "&rsqb;"}
_BACK = {v: k for k, v in ESCAPES.items()}
_TURN = re.compile(r"\[INST\](?P<u>[^\[<]*)\[/INST\]|\[ASST\](?P<a>[^\[<]*)</s>|\[ROLE:(?P<r>[^\]\[<]*)\](?P<o>[^\[<]*)\[/ROLE\]")


def escape(text: str) -> str:
    return re.sub(r"[&<\[\]]", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"&(?:amp|lt|lsqb|rsqb);", lambda m: _BACK[m[0]], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The conversation as one text, and the flat [start, end) spans in code points that carry loss: assistant texts."""
    parts, at, mask = [START], len(START), []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            head, tail = USER, USER_END
        elif role == "assistant":
            head, tail = ASSISTANT, ASSISTANT_END
            mask += [at + len(head), at + len(head) + len(body)]
        else:
            head, tail = f"{OTHER}{escape(role)}{ROLE_END}", OTHER_END
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; a text that the template can't have made raises an error."""
    at, turns = len(START), []
    if not formatted.startswith(START):
        raise ValueError("not a formatted conversation")
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        role = "user" if m["u"] is not None else "assistant" if m["a"] is not None else unescape(m["r"])
        turns.append((role, unescape(m["u"] if m["u"] is not None else m["a"] if m["a"] is not None else m["o"])))
        at = m.end()
    return turns


def unique_messages(messages: DataFrame) -> DataFrame:
    """(tree, msg, parent, score, role, text): of rows alike in tree and msg the least by (parent, score, role, text)."""
    first = F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return messages.groupBy("tree", "msg").agg(first.alias("m")).select("tree", "msg", "m.*")


def climbed(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, msg, depth, score) of each message of ``messages`` (tree, msg, parent, score) that has a root, with the sum of
    scores from its root to itself; and for k = 0, 1, ... (tree, msg, up): the message 2^k steps up.

    A message whose parent is null or missing is a root; messages on a cycle, or under one, have none. What is done isn't
    written again: round k writes the messages that are 2^k deep or deeper.
    """
    ids = messages.select("tree", F.col("msg").alias("up"), F.lit(True).alias("known"))
    state = messages.select("tree", "msg", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    state = write_table(state.join(ids, ["tree", "up"], "left").select("tree", "msg", F.when(F.col("known"), F.col("up")).alias("up"), "steps", "total"), "jumps")
    done, jumps, before = None, [], None
    while True:
        ended = state.filter("up IS NULL")
        done = ended if done is None else done.unionByName(ended)
        state = state.filter("up IS NOT NULL")
        still = state.count()
        if not still or still == before:
            return done.select("tree", "msg", F.col("steps").alias("depth"), F.col("total").alias("score")), jumps
        before = still
        jumps.append(state.select("tree", "msg", "up"))
        above = done.unionByName(state).select("tree", F.col("msg").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        joined = state.join(above, ["tree", "up"])
        state = write_table(joined.select("tree", "msg", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total")), "jumps")


def ranked_leaves(messages: DataFrame, depths: DataFrame, best: int | None) -> DataFrame:
    """(tree, leaf, depth, score, rank) of the best leaves by the mean score of their path; a leaf has no replies."""
    inner = messages.select("tree", F.col("parent").alias("msg")).filter("msg IS NOT NULL").distinct()
    leaves = depths.join(inner, ["tree", "msg"], "left_anti")
    return best_paths(leaves.select("tree", F.col("msg").alias("leaf"), "depth", (F.col("score") / F.col("depth")).alias("score")), best)


def listed(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, rank, at, msg): the messages of the paths of ``leaves`` (tree, leaf, depth, rank), at 1 being the root."""
    found = write_table(leaves.select("tree", "leaf", "rank", F.col("depth").alias("at"), F.col("leaf").alias("msg")), "path")
    for k in reversed(range(len(jumps))):
        # only what is deep enough has a message so far up
        more = found.filter(F.col("at") > 2**k).join(jumps[k], ["tree", "msg"]).select("tree", "leaf", "rank", (F.col("at") - 2**k).alias("at"), F.col("up").alias("msg"))
        found = found.unionByName(write_table(more, "path"))
    return found


def reply_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, path, score): each root-to-leaf path of ``messages`` (tree, msg, parent, score) with its mean score, for
    trees whose paths are short enough to stand in one row. Null scores count as 0, repeated rows once, and messages on a
    cycle have no root and so no path."""
    one = write_table(unique_messages(messages.select("tree", "msg", "parent", "score", F.lit("").alias("role"), F.lit("").alias("text"))), "messages")
    depths, jumps = climbed(one)
    leaves = write_table(ranked_leaves(one, depths, None), "leaves")
    paths = listed(leaves, jumps).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "msg"))).alias("p"))
    return paths.join(leaves, ["tree", "leaf"]).select("tree", "leaf", F.col("p.msg").alias("path"), "score")


def best_paths(paths: DataFrame, best: int | None, salts: int = 32) -> DataFrame:
    """The ``best`` paths of each tree by mean score, then leaf, with their ``rank`` from 1; None ranks and keeps all.

    A tree's paths are first cut to its best in each of ``salts`` parts, so no task sorts all branches of a large tree.
    """
    order = [F.desc("score"), F.asc("leaf")]
    if best is not None:
        part = W.partitionBy("tree", F.pmod(F.xxhash64("leaf"), F.lit(salts))).orderBy(*order)
        paths = paths.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= best).drop("rank")
    ranked = paths.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(*order)))
    return ranked if best is None else ranked.filter(F.col("rank") <= best)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from turns sorted by (tree, leaf, at); one conversation is held at a time."""

    def out(key: tuple, turns: list[tuple[str, str]]) -> pa.RecordBatch:
        text, mask = format_turns(turns)
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, text, mask), kinds, strict=True)], names=["tree", "leaf", "rank", "formatted", "mask"])

    now, turns = None, []
    for b in batches:
        for *key, role, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4, 5)), strict=True):
            if key != now:
                if turns:
                    yield out(now, turns)
                now, turns = key, []
            turns.append((role, text))
    if turns:
        yield out(now, turns)


def format_unique(messages: DataFrame, best: int | None) -> DataFrame:
    """As ``format_trees``, for messages of which no two are alike in (tree, msg) and none has a null score, role or text."""
    depths, jumps = climbed(messages)
    steps = listed(ranked_leaves(messages, depths, best), jumps)
    turns = steps.join(messages.select("tree", "msg", "role", "text"), ["tree", "msg"]).select("tree", "leaf", "rank", "at", "role", "text")
    ordered = turns.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "at")
    return ordered.mapInArrow(_format, "tree string, leaf long, rank int, formatted string, mask array<long>")


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, mask): the best branches of each reply tree of ``messages`` (tree, msg, parent, score,
    role, text; more columns are ignored), each as one conversation. Null role and text count as empty, a null score as 0; of
    rows alike in tree and msg the least by (parent, score, role, text) stays. An empty table gives an empty result."""
    return format_unique(write_table(unique_messages(messages.select("tree", "msg", "parent", "score", "role", "text")), "messages"), best)


def linear_messages(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as reply trees of one branch: each row answers the one before it by
    (turn, role, text). Null conv_id, role and text count as empty, and null turns come first.

    Rows are dealt by ranges of the whole order and numbered in it, so a conversation of very many turns has many tasks. A
    row names the one before it as its parent; the first one of a tree thus names a message that its tree lacks.
    """
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = ["tree", "turn", "role", "text"]
    placed = write_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part).count()
    starts = sizes.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("start"))  # a row a range
    out = placed.select("*", part).join(F.broadcast(starts), "part").withColumn("msg", F.col("start") + within)
    return out.select("tree", "msg", (F.col("msg") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        for formatted, mask in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            turns = parse_turns(formatted)
            loss = "".join(unescape(formatted[s:e]) for s, e in zip(mask[::2], mask[1::2], strict=True))
            row = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations, and from one more, -1, whose texts are full of marks; rows of a
    conversation -1 that the table has already are turns of it."""
    extra = conversations.sparkSession.sql("SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    formatted = format_unique(write_table(linear_messages(rows), "messages"), best=1)
    out = formatted.select("tree", "formatted", "mask").mapInArrow(_read_back, "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(F.expr("try_cast(tree AS bigint)").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: DuckDB SQL for conversation_digests().
CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;') AS body,
             replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;') AS named FROM c),
f AS (SELECT *, CASE role WHEN 'user' THEN length(body) + 13 WHEN 'assistant' THEN length(body) + 10 ELSE length(body) + length(named) + 14 END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
