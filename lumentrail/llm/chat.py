"""Chat formatting over a prefix tree.

Conversations that share initial turns share the nodes of a tree; every node's text is emitted once, in
depth-first order. A node carries the position of its first character within the conversation (so that
position ids run on over shared turns), its place in the emitted stream, the stretches of the stream that
its characters attend to (its ancestors), and the stretch of it that the loss is taken on. Here a token is
a code point.

Turns are the same node if they and all turns before them agree, at any depth. A node's heavy child is the one
that most conversations run through; runs of heavy children are paths, and a node's key names the paths down to
it, by where each is left and for which child, and its place on its own. A turn is at most the 25th light one of
its conversation among 2**24, so keys stay short however long conversations are. Byte order of keys is a
depth-first order that takes heavy children first, so a path is one stretch of the stream, and sorting by ranges
of keys lays out the stream in parallel, however many conversations share their beginning.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import blake2b, sha256
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.shared import checkpoint, scratch, text_batches

DIGEST = 16
LAST = (1 << 64) - 1

CONTROL = r"(?:\[/?(?:INST|SYS|ROLE)|</?s>)"
_ESCAPE, _UNESCAPE = re.compile(rf"\\*{CONTROL}"), re.compile(rf"\\(\\*{CONTROL})")
_MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", " </s>")}


def escape(text: str) -> str:
    """Puts one more backslash before each control string and any backslashes that precede it."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked-up turn and the stretch of it under the loss mask, empty but for the assistant."""
    before, after = _MARKS.get(role) or (f"[ROLE {quote(role, safe='')}] ", " [/ROLE]")
    body = escape(text)
    return before + body + after, len(before), len(before) + (len(body) if role == "assistant" else 0)


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text of a marked-up turn."""
    for role, (before, after) in _MARKS.items():
        if segment.startswith(before) and segment.endswith(after) and len(segment) >= len(before) + len(after):
            return role, unescape(segment[len(before) : -len(after)])
    head, _, rest = segment.removeprefix("[ROLE ").partition("] ")
    return unquote(head), unescape(rest.removesuffix(" [/ROLE]"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _chains(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn_no, role, text, position, parent, node)``: each turn with digests of all turns before it and up to it."""
    src = text_batches(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("position", pa.int64()), ("parent", pa.binary()), ("node", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, no, position, node = (), 0, 0, b""
        for b in batches:
            rows = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last != (conv,):
                    last, no, position, node = (conv,), 0, 0, b""
                raw = role.encode()
                parent, node = node, blake2b(node + struct.pack(">I", len(raw)) + raw + text.encode(), digest_size=DIGEST).digest()
                rows.append((conv, no, role, text, position, parent, node))
                no += 1
                position += len(format_turn(role, text)[0])
            yield _batch(rows, schema)

    return src.mapInArrow(run, "conv_id long, turn_no long, role string, text string, position long, parent binary, node binary")


def _keys(chains: DataFrame) -> DataFrame:
    """``(conv_id, turn_no, key, first)``: each turn's key, and whether its conversation is the first with that node."""
    nodes = chains.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    heavy = nodes.where(F.length("parent") > 0).groupBy("parent").agg(F.max(F.struct("n", "node"))["node"].alias("node")).select("node", F.lit(True).alias("heavy"))
    nodes = nodes.select("node", "least").join(heavy, "node", "left")
    src = chains.select("conv_id", "turn_no", "node").join(nodes, "node").select("conv_id", "turn_no", "node", F.coalesce("heavy", F.lit(False)).alias("heavy"), F.col("conv_id").eqNullSafe(F.col("least")).alias("first"))
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    schema = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("key", pa.binary()), ("first", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, path, place = (), b"", 0
        for b in batches:
            rows = []
            for conv, no, node, is_heavy, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last != (conv,):
                    last, path, place = (conv,), b"", 0
                if is_heavy:
                    place += 1
                else:  # places count down from LAST, so later leaves come first, and all after the path's own nodes
                    path, place = path + struct.pack(">Q", LAST - place) + node, 0
                rows.append((conv, no, path + struct.pack(">Q", place), first))
            yield _batch(rows, schema)

    return src.mapInArrow(run, "conv_id long, turn_no long, key binary, first boolean")


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn_no, role, text, position, key, first)``: each turn with its number and its key in the tree.

    ``position`` is that of its first character in the conversation; ``first`` marks one turn of each key.
    Turns are ordered by turn, then role, then text; null texts and roles are empty; rows with a null conv_id
    are one conversation. A conversation streams through one task, however long.
    """
    chains = checkpoint(_chains(conversations))
    keys = checkpoint(_keys(chains)).withColumnsRenamed({"conv_id": "__conv", "turn_no": "__no"})
    of = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("turn_no") == F.col("__no"))
    return chains.join(keys, of).select("conv_id", "turn_no", "role", "text", "position", "key", "first")


class _Walk:
    """Follows nodes in depth-first order, keeping the paths down to the current node."""

    def __init__(self, at: int, stack: list[tuple[bytes, int, int]]):
        self.at, self.stack = at, list(stack)  # path, its start in the stream, position of its first character

    def step(self, key: bytes, position: int, length: int) -> tuple[int, list[tuple[int, int]]]:
        """Start of a node in the stream and its ancestors' stretches, joined."""
        path, place = key[:-8], key[-8:]
        while self.stack and not path.startswith(self.stack[-1][0]):
            self.stack.pop()
        if not any(place):
            self.stack.append((path, self.at, position))
        stretches: list[tuple[int, int]] = []
        for (_, start, first), left in zip(self.stack, [*(x[2] for x in self.stack[1:]), position], strict=False):
            if left == first:
                continue
            if stretches and stretches[-1][1] == start:
                stretches[-1] = (stretches[-1][0], start + left - first)
            else:
                stretches.append((start, start + left - first))
        start = self.at
        self.at += length
        return start, stretches


NODES = "key binary, start long, length long, position long, attends array<struct<from: long, to: long>>, loss_from int, loss_to int, segment string"


def pack(all_turns: DataFrame, path: str) -> DataFrame:
    """Writes the tree's nodes in depth-first order as Parquet below ``path`` and returns them read back.

    ``segment`` takes ``length`` code points from ``start`` in the stream; they have the position ids from
    ``position`` on and attend to the stretches ``attends`` and, causally, to themselves; the loss is taken on
    those from ``loss_from`` to ``loss_to`` of the segment. Two passes run over the ranges of sorted keys: the
    first sums each range's length, and the running sums, with the few paths open between two ranges, start the
    second.
    """
    nodes = checkpoint(all_turns.where("first").select("key", "role", "text", "position").repartitionByRange("key").sortWithinPartitions("key"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, last = _Walk(0, []), b""
        for b in batches:
            for key, role, text, position in zip(*(c.to_pylist() for c in b.columns), strict=True):
                walk.step(key, position, len(format_turn(role, text)[0]))
                last = key
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([walk.at], pa.int64()), pa.array([last], pa.binary()), pa.array([[{"k": k, "s": s, "p": p} for k, s, p in walk.stack]], pa.list_(pa.struct([("k", pa.binary()), ("s", pa.int64()), ("p", pa.int64())])))], ["part", "length", "last", "stack"])

    carry: dict[int, tuple[int, list[tuple[bytes, int, int]]]] = {}
    at, stack = 0, []
    for part, length, last, own in sorted(nodes.mapInArrow(measure, "part int, length long, last binary, stack array<struct<k: binary, s: long, p: long>>").collect()):
        carry[part] = at, stack
        if not last:
            continue
        down = bytes(last)[:-8]
        stack = [x for x in stack if down.startswith(x[0])] + [(bytes(r["k"]), at + r["s"], r["p"]) for r in own]
        at += length

    schema = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("attends", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("segment", pa.string())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(*carry.get(TaskContext.get().partitionId(), (0, [])))
        for b in batches:
            rows = []
            for key, role, text, position in zip(*(c.to_pylist() for c in b.columns), strict=True):
                segment, a, z = format_turn(role, text)
                start, stretches = walk.step(key, position, len(segment))
                rows.append((key, start, len(segment), position, [{"from": s, "to": e} for s, e in stretches], a, z, segment))
            yield _batch(rows, schema)

    nodes.mapInArrow(emit, NODES).write.parquet(path)
    return all_turns.sparkSession.read.schema(NODES).parquet(path)


def read_back(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """What the output says about each conversation of ``members(conv_id, turn_no, key)``; contract as in ``digest``."""
    src = members.select("conv_id", "turn_no", "key").join(nodes.select("key", "position", "attends", "loss_from", "loss_to", "segment"), "key").drop("key")
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            rows = []
            for conv, _, position, attends, a, z, segment in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last != (conv,):
                    if last:
                        rows.append((last[0], n, whole.hexdigest(), lost, loss.hexdigest(), chars))
                    last, n, whole, lost, loss, chars = (conv,), 0, sha256(), 0, sha256(), 0
                if position != chars or sum(x["to"] - x["from"] for x in attends) != chars:
                    raise ValueError(f"conversation {conv}: positions {position} after {chars} characters")
                role, text = parse_turn(segment)
                whole.update(f"{role}\n{text}\n".encode())
                under = unescape(segment[a:z])
                lost += len(under)
                loss.update(under.encode())
                chars += len(segment)
                n += 1
            yield _batch(rows, schema)
        if last:
            yield _batch([(last[0], n, whole.hexdigest(), lost, loss.hexdigest(), chars)], schema)

    return src.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(conversations: DataFrame) -> DataFrame:
    """Formats all conversations into the packed stream and reads each back from it.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``. Repeated rows are turns of
    their own. An empty table gives an empty result.
    """
    all_turns = turns(conversations)
    nodes = pack(all_turns, scratch(conversations.sparkSession, "chat"))
    return read_back(all_turns, nodes)
