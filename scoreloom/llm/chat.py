"""Chat formatting into a prefix tree: turns that conversations share from the start are emitted once.

A node is a turn together with everything before it. Each node belongs to the first conversation (by identifier) that
passes through it, so a conversation owns one chain of nodes, its *segment*, hanging below a node of another one. Segments
in depth-first order make one packed sequence of characters; every node carries its offset there, the position its first
character has in its conversation, and the intervals of the packed sequence that its ancestors occupy (what its
characters may attend to, besides those before them in the node). No task holds a tree or a conversation's texts.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.ordinals import running_total
from scoreloom.session import materialise, ship_package

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this and of other common templates; none of them survives in a formatted text.
CONTROL = (BEGIN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
TRAINED = "assistant"  # the role whose texts count for the loss


def escape(text: str) -> str:
    """One more backslash after the first character of every control string, with or without backslashes there."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where the characters that count for the loss begin and end in it."""
    head = f"{BEGIN}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
    body = escape(text)
    end = len(head) + len(body) if role == TRAINED else len(head)
    return f"{head}{body}{END}\n", len(head), end


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, body = formatted.removeprefix(BEGIN).partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(body.removesuffix(f"{END}\n"))


TURNS = "conv struct<id:long>, depth int, node string, parent string, formatted string, loss_start int, loss_end int, length long"


def _chained(batches):
    """Rows by conversation and turn, streamed: each turn's node is a digest of its parent's and of itself."""
    now, depth, node = None, 0, ""
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if conv != now:
                now, depth, node = conv, 0, ""
            role, text = role or "", text or ""
            parent, depth = node, depth + 1
            node = hashlib.sha256(f"{parent}\n{len(role)}\n{role}{text}".encode()).hexdigest()[:32]
            formatted, begin, end = format_turn(role, text)
            rows.append((conv, depth, node, parent, formatted, begin, end, len(formatted)))
        names = ["conv", "depth", "node", "parent", "formatted", "loss_start", "loss_end", "length"]
        kinds = [pa.struct([("id", pa.int64())]), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
        columns = zip(*rows) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _paths(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conv, depth, node, owner, start, end, head`` of every turn: where it lies in its conversation, and whether another
    conversation owns the turn before.

    Positions are a distributed running sum over all turns in the order of conversation and depth, less what it is at the
    conversation's first turn, so a conversation may have any number of turns and no task holds one.
    """
    rows = turns.join(nodes, "node").withColumn("key", F.struct("conv", "depth"))
    summed = materialise(running_total(rows, "key", "length", "before").drop("key"), "chat-summed")
    begins = materialise(summed.where("depth = 1").select("conv", F.col("before").alias("base")), "chat-begins")
    previous = summed.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("previous"))
    start = F.col("before") - F.col("base")
    path = summed.join(previous, ["conv", "depth"], "left").join(begins, "conv").select(
        "conv", "depth", "node", "owner", start.alias("start"), (start + F.col("length")).alias("end"),
        F.coalesce(F.col("previous") != F.col("owner"), F.lit(True)).alias("head"),
    )
    return materialise(path, "chat-paths")


def pack(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (node, parent, conv, depth, offset, length, position, ancestors, formatted, loss_start, loss_end), in
    depth-first order, and ``turns`` (conv, depth, node), which says what nodes a conversation consists of.

    Turns are taken in the order of turn, role, text, nulls first; ties and repeated rows are turns of their own. Null roles
    and texts count as empty. Rows without ``conv_id`` are one conversation. Empty tables give empty tables.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    rows = conversations.select(F.struct(F.col("conv_id").cast("long").alias("id")).alias("conv"), "turn", "role", "text")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    turns = materialise(rows.mapInArrow(_chained, TURNS), "chat-turns")

    same = ("parent", "depth", "formatted", "loss_start", "loss_end", "length")  # functions of the node
    nodes = turns.groupBy("node").agg(F.min("conv").alias("owner"), *(F.first(c).alias(c) for c in same))
    nodes = materialise(nodes, "chat-nodes")
    path = _paths(turns.select("conv", "depth", "node"), nodes.select("node", "owner", "length"))

    # a conversation's own segment, and the segments it passes through on the way there: heads, not turns
    own = path.where(F.col("owner") == F.col("conv"))
    heads = path.where("head").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "owner", "start"))).alias("heads"))
    owned = own.groupBy("conv").agg(F.min("start").alias("start"), F.max("end").alias("end")).join(heads, "conv")
    owned = materialise(owned, "chat-owned")

    # segments in depth-first order: by tree, then branches from deeper nodes first, then by conversation
    branch = F.transform(F.slice("heads", 2, F.size("heads")), lambda h: F.struct((-h["depth"]).alias("up"), h["owner"].alias("owner")))
    segments = owned.select(
        "conv", F.struct(F.col("heads")[0]["owner"].alias("tree"), branch.alias("branch")).alias("key"), "start", (F.col("end") - F.col("start")).alias("size"),
    )
    segments = running_total(segments, "key", "size", "offset").select("conv", (F.col("offset") - F.col("start")).alias("shift"))
    segments = materialise(segments, "chat-segments")

    # each segment's ancestors: where the path runs through other segments, in packed coordinates
    through = F.transform("heads", lambda h, i: F.struct(
        h["owner"].alias("owner"), h["start"].alias("start"), F.coalesce(F.get("heads", i + 1)["start"], F.col("end")).alias("end")))
    above = owned.select("conv", F.explode(through).alias("t")).select("conv", "t.*").join(segments.withColumnRenamed("conv", "owner"), "owner")
    above = above.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "shift"))).alias("through"), F.max_by("shift", "start").alias("shift"))
    # written, so that the join meets plain tables, and Spark can split a conversation of very many turns
    above = materialise(above, "chat-above")
    placed = own.select("conv", "node", F.col("start").alias("at")).join(above, "conv")
    # the part of the last interval that lies before the node itself
    to = lambda x: F.least(x["end"], F.col("at"))
    ancestors = F.transform(F.filter("through", lambda x: x["start"] < F.col("at")), lambda x: F.struct(
        (x["start"] + x["shift"]).alias("start"), (to(x) + x["shift"]).alias("end")))
    placed = placed.select("node", "conv", (F.col("at") + F.col("shift")).alias("offset"), F.col("at").alias("position"), ancestors.alias("ancestors"))
    packed = nodes.drop("owner").join(placed, "node").orderBy("offset")
    packed = packed.select("node", "parent", "conv", "depth", "offset", "length", "position", "ancestors", "formatted", "loss_start", "loss_end")
    return materialise(packed, "chat-packed"), turns.select("conv", "depth", "node")


def _read_back(batches):
    """Nodes by conversation and depth, streamed: digests of what the formatted text holds."""
    now = None
    done: list[tuple] = []

    def finish():
        if now is not None:
            done.append((now["id"], n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    n, chars, formatted, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def flush():
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*done)) if done else [[] for _ in names]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for conv, text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv", "formatted", "loss_start", "loss_end"))):
            if conv != now:
                finish()
                now, n, chars, formatted, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            role, said = parse_turn(text)
            turns.update(f"{role}\n{said}\n".encode())
            trained = unescape(text[begin:end])
            loss.update(trained.encode())
            n, chars, formatted = n + 1, chars + len(trained), formatted + len(text)
        yield flush()
    finish()
    yield flush()


def read_back(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from packed nodes."""
    texts = nodes.select("node", "formatted", "loss_start", "loss_end")
    rows = turns.join(texts, "node").repartition("conv").sortWithinPartitions("conv", "depth")
    return rows.select("conv", "formatted", "loss_start", "loss_end").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations plus one, -1, whose texts are control strings."""
    probe = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, TRAINED, probe)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)


def _escaped(text: str) -> str:
    tails = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]").replace("/", "/") for c in CONTROL)
    return rf"regexp_replace({text}, '([<\[])(\\*)({tails})', '\1\\\2\3', 'g')"


ORACLE = rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, '{TRAINED}', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
        CAST(sum({len(BEGIN) + len(END) + 2} + length(role) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id"""
