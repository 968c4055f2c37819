"""Chat formatting over reply trees.

Messages form a forest: each names its parent.  Paths from the roots come from iterative
self-joins that double their reach: after step k every message knows its ancestor 2**k levels up
and how many messages and score points lie between, so a tree of depth d takes log2(d) joins,
not d.  Leaves are ranked by the score of their path within their tree (ties: longer path, then
smaller leaf key), and each chosen path is formatted as one conversation.

A template marks turns and control strings inside texts are escaped: a backslash is put
after the first character of every marker and every backslash is doubled, which undoes
exactly.  The loss mask covers the assistant's texts.

Conversations given as rows by turn are the special case of one chain: the parent is the row
before (order: turn, then role, then text), so no row is lost where turns tie.

Defined results: a null text is empty, a null role counts as an empty role; null turns come first;
an empty table gives no conversations; extra columns are ignored.  Rows that repeat a message (tree and
node) are one message, the least by parent, score, role and text.  A parent that isn't there counts as none.
A message that reaches no root, because its parents go round in a circle, is on no path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm import textkit
from tallybook.llm.shared import forget, stored

BEGIN, HEAD, END = "<s>[TURN]", "[TEXT]", "</s>"
#: Strings that steer common chat models; any of them inside a text is escaped.
CONTROL = (BEGIN, HEAD, END, "<s>", "[TURN]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_MARK = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


def escape(text: str) -> str:
    """Break up every control string so that none stands in the result."""
    text = text.replace("\\", "\\\\")
    while _MARK.search(text):
        text = _MARK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    """Undo ``escape``: a doubled backslash is one, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the loss mask as ranges of its code points."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role)}{HEAD}", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def read_back(whole: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in whole.split(END)[:-1]:
        head, _, body = part.removeprefix(BEGIN).partition(HEAD)
        turns.append((unescape(head), unescape(body)))
    return turns


def chains(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a forest: tree, node, parent, score, role, text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def messages(forest: DataFrame) -> DataFrame:
    """The forest with each message once."""
    one = F.min(F.struct("parent", "score", "role", "text")).alias("one")
    return forest.groupBy("tree", "node").agg(one).select("tree", "node", "one.parent", "one.score", "one.role", "one.text")


def leaf_paths(forest: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, rank: the ``best`` leaves of each tree by the score of their whole path.

    The forest may hold any branching, and each message once.  ``up`` is the ancestor reached so far, null
    once a root is behind; every round joins each message that has one with it, and no path has more
    messages than the forest, so that circles end the rounds as well."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    parents = forest.select(F.col("tree").alias("t2"), F.col("parent").alias("p2")).where("p2 IS NOT NULL").distinct()
    reach = stored(forest.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length")), "reach")
    most, span = reach.count(), 1
    while span <= most and not reach.where("up IS NOT NULL").isEmpty():
        above = reach.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("length").alias("length2"))
        joined = reach.where("up IS NOT NULL").join(above, same("tree", "t2") & (F.col("up") == F.col("n2")), "left")
        further = joined.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"), (F.col("length") + F.coalesce("length2", F.lit(0))).alias("length"))
        after = stored(further.unionByName(reach.where("up IS NULL")), "reach")
        forget(reach)
        reach, span = after, span * 2
    leaves = reach.where("up IS NULL").join(parents, same("tree", "t2") & (F.col("node") == F.col("p2")), "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("length"), "node")
    return leaves.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= best).select("tree", F.col("node").alias("leaf"), "rank", "length")


def on_paths(forest: DataFrame, leaves: DataFrame) -> DataFrame:
    """tree, leaf, rank, place, node of every message on the chosen paths.

    The mirror of ``leaf_paths``: the known tops of each path double, by joining them with jump
    tables of 1, 2, 4 ... levels."""
    jumps = [stored(forest.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("up")), "jump")]
    span, deepest = 1, leaves.agg(F.max("length")).first()[0] or 0
    while span * 2 < deepest:
        low, high = jumps[-1], jumps[-1].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"))
        jumps.append(stored(low.join(high, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2"))).select("tree", "node", F.col("up2").alias("up")), "jump"))
        span *= 2
    paths = leaves.select("tree", "leaf", "rank", F.col("length").alias("place"), F.col("leaf").alias("node"))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        more = paths.join(jump, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select("tree", "leaf", "rank", (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("node"))
        longer = stored(paths.unionByName(more), "paths")
        forget(paths)
        paths = longer
    for jump in jumps:
        forget(jump)
    return paths


def conversations_of(forest: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, rank, formatted, mask of the chosen path of every tree."""
    forest = stored(messages(forest), "forest")
    paths = on_paths(forest, stored(leaf_paths(forest, best), "leaves"))
    own = forest.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "role", "text")
    told = paths.join(own, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
    rows = told.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [formatted([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column(3)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x[0] for x in done], pa.string()), pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in done], kind)], ["tree", "leaf", "rank", "formatted", "mask"])

    return rows.mapInArrow(textkit.tidy(run), "tree long, leaf long, rank int, formatted string, mask array<struct<start:long,end:long>>")


def digests(formats: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted strings."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for whole, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(whole)
                loss = "".join(unescape(whole[m["start"] : m["end"]]) for m in mask)
                for column, x in zip(columns, (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formats.select("tree", "formatted", "mask").mapInArrow(textkit.tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _oracle() -> str:
    def escaped(c: str) -> str:
        out = f"replace({c}, '{chr(92)}', '{chr(92) * 2}')"
        tails = "|".join(re.escape(x[1:]) for x in sorted(CONTROL, key=len, reverse=True))
        heads = "".join(re.escape(x) for x in sorted({x[0] for x in CONTROL}))
        for _ in range(4):
            out = f"regexp_replace({out}, '([{heads}])({tails})', '{chr(92)}1{chr(92) * 2}{chr(92)}2', 'g')"
        return out

    said = "</s>[INST] ok [/INST]"
    marks = len(BEGIN) + len(HEAD) + len(END)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({marks} + length({escaped('role')}) + length({escaped('text')}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


ORACLE = _oracle()
