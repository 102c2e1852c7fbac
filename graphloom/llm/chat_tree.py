"""Chat formatting over a prefix tree of turns.

Conversations that share initial turns share tree nodes.  A node is a turn in the context of all
turns before it, named by a digest of them.  Distinct conversations are range-sorted by the path of
their nodes' digests, which is a depth-first order; each range is then walked once, and a node's
tokens are written when the walk first comes to it.  Every conversation carries the number of turns that it
shares with the one before it in the whole order, over the edges of ranges too, so a node is new in one
place only, however the rows are dealt.  The output is blocks of tokens with, for every
node, its place, its position ids (those of the conversation, not of the block) and the intervals
of the block that it may attend to: its ancestors and itself.  A block is closed when it is full;
the next one repeats the ancestors of the node it begins with, marked as repeated, so that each
block stands for itself and a first turn that is common to a third of all conversations is dealt
over many tasks.

Template: ``<s>[INST]role[/INST]text</s>`` for each turn.  Control strings inside roles and texts get
a backslash after their first character, one more if backslashes stand there already; reading
takes one away, so the escape is reversible and an escaped text never holds a control string.

Defined results: a null role or text is an empty one.  Rows with equal conv_id and turn stand in
order of role and text; repeated rows are turns of their own.  A null conv_id is one conversation.
An empty table gives an empty result.  Texts of any length are formatted whole; a turn longer than a
block makes a block of that size.  Other columns do not pass through.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import append_columns, emit
from graphloom.llm.tokens import default_path, encoding
from graphloom.storage import materialize

_TAIL = r"/?s>|/?INST\]"
_BARE = re.compile(rf"([<\[])(\\*)({_TAIL})")
_STUFFED = re.compile(rf"([<\[])\\(\\*)({_TAIL})")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
LEARNT = "assistant"
#: Characters of a node's name.
DIGEST = 24


def escape(text: str) -> str:
    return _BARE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _STUFFED.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, what stands after it."""
    return f"{OPEN}{escape(role)}{ROLE_END}", escape(text), CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def node_names(turns: list[dict]) -> list[str]:
    """A digest for each turn of all turns up to it."""
    out, state = [], hashlib.blake2b(digest_size=DIGEST // 2)
    for t in turns:
        for part in (t["role"], t["text"]):
            data = part.encode()
            state.update(len(data).to_bytes(8, "little") + data)
        out.append(state.hexdigest())
    return out


def gather(rows: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, turns in order, leaf (name of the last node), path."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))

    def make():
        def compute(turns: pa.Array):
            names = [node_names(t) for t in turns.to_pylist()]
            return [[n[-1] for n in names], ["".join(n) for n in names]]

        return compute

    return append_columns(convs, ["turns"], "leaf string, path string", make)


NODE = "struct<name: string, leaf: boolean, repeated: boolean, start: bigint, end: bigint, position: bigint, loss_start: bigint, loss_end: bigint, attends: array<struct<start: bigint, end: bigint>>>"


def ordered(distinct: DataFrame) -> DataFrame:
    """Conversations in depth-first order, with ``shared``: the turns they have in common with the one
    before.  That of a range's first row is found on the driver, from a row per range."""

    def make():
        last: str | None = None

        def compute(paths: pa.Array):
            nonlocal last
            shared = []
            for path in paths.to_pylist():
                shared.append(None if last is None else _common(last, path))
                last = path
            return [[TaskContext.get().partitionId()] * len(shared), shared]

        return compute

    rows = distinct.repartitionByRange("path").sortWithinPartitions("path")
    rows = materialize(append_columns(rows, ["path"], "part int, shared int", make), "ordered")
    ends = sorted(rows.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last")).collect())
    over = [(r.first[-DIGEST:], _common(q.last, r.first)) for q, r in zip([None, *ends], ends) if q is not None]
    edges = rows.sparkSession.createDataFrame(over, "leaf string, over int")
    inner = rows.where("shared is not null").select("turns", "shared")
    heads = rows.where("shared is null").join(F.broadcast(edges), "leaf", "left")  # a row per range
    return inner.unionByName(heads.select("turns", F.coalesce("over", F.lit(0)).alias("shared")))


def _common(a: str, b: str) -> int:
    """Turns that two paths share from the first on."""
    return len(os.path.commonprefix([a, b])) // DIGEST


class Block:
    """Tokens and nodes being written.  ``open`` is the path from the root to the last node."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.open: list[dict] = []

    def add(self, name: str, parts: list[np.ndarray], learnt: bool, repeated: bool) -> None:
        parent = self.open[-1] if self.open else None
        before, text, after = (len(p) for p in parts)
        start, end = self.size, self.size + before + text + after
        attends = [*parent["attends"]] if parent else []
        if attends and attends[-1]["end"] == start:
            attends[-1] = {"start": attends[-1]["start"], "end": end}
        else:
            attends.append({"start": start, "end": end})
        position = parent["position"] + parent["end"] - parent["start"] if parent else 0
        loss = (start + before, start + before + text) if learnt else (start, start)
        node = {"name": name, "leaf": False, "repeated": repeated, "start": start, "end": end, "position": position, "loss_start": loss[0], "loss_end": loss[1], "attends": attends}
        self.nodes.append(node)
        self.open.append(node)
        self.ids += parts
        self.size = end

    def row(self) -> dict:
        return {"ids": [np.concatenate(self.ids)], "nodes": [self.nodes]}


def write_blocks(spark_df: DataFrame, path: str, block_tokens: int) -> DataFrame:
    """Walk distinct conversations in order; a row per block: ids and nodes."""

    def make():
        encode = encoding(path).encode_to_numpy
        block = Block()

        def tokens(turn: dict) -> list[np.ndarray]:
            return [encode(p, disallowed_special=()) for p in format_turn(turn["role"], turn["text"])]

        def step(*columns) -> Iterator[dict]:
            nonlocal block
            if not columns:
                if block.nodes:
                    yield block.row()
                return
            for turns, known in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True):
                names = node_names(turns)
                shared = 0
                while shared < len(block.open) and shared < len(names) and block.open[shared]["name"] == names[shared]:
                    shared += 1
                if shared < len(names) and block.size >= block_tokens:
                    yield block.row()
                    block = Block()
                    for name, turn in zip(names[:shared], turns[:shared]):
                        block.add(name, tokens(turn), turn["role"] == LEARNT, True)
                del block.open[shared:]
                for i in range(shared, len(names)):
                    block.add(names[i], tokens(turns[i]), turns[i]["role"] == LEARNT, i < known)
                block.open[-1]["leaf"] = True

        return step

    return emit(spark_df, ["turns", "shared"], f"ids array<int>, nodes array<{NODE}>", make)


def positions(node: dict) -> range:
    """Position ids of a node's tokens."""
    return range(node["position"], node["position"] + node["end"] - node["start"])


def tree(rows: DataFrame, path: str | None = None, block_tokens: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """Blocks of the prefix tree, and the leaf of each conversation (conv_id, leaf)."""
    convs = materialize(gather(rows), "conversations")
    distinct = convs.select("leaf", "path", "turns").dropDuplicates(["leaf"])
    blocks = materialize(write_blocks(ordered(distinct), path or default_path(), block_tokens), "blocks")
    return blocks, convs.select("conv_id", "leaf")


def read_leaf(decode, ids: np.ndarray, by_end: dict[int, dict], node: dict) -> tuple[str, list[str]]:
    """Formatted text of a leaf's conversation, and the texts under its loss masks, from the
    intervals that it attends to."""
    spans, text = [], []
    for part in node["attends"]:
        text.append(ids[part["start"] : part["end"]])
        at = part["start"]
        while at < part["end"]:
            turn = by_end[at]
            if turn["loss_end"] > turn["loss_start"]:
                spans.append(unescape(decode(ids[turn["loss_start"] : turn["loss_end"]])))
            at = turn["end"]
    return decode(np.concatenate(text)), spans


def read_back(blocks: DataFrame, path: str | None = None) -> DataFrame:
    """A row per leaf with what its conversation reads as: leaf and digests."""
    path = path or default_path()

    def make():
        enc = encoding(path)

        def decode(ids: np.ndarray) -> str:
            return enc.decode_bytes(ids.tolist()).decode()

        def step(*columns) -> Iterator[dict]:
            if not columns:
                return
            out: list[tuple] = []
            for ids, nodes in zip(columns[0], columns[1].to_pylist(), strict=True):
                ids = np.asarray(ids.values)
                by_start = {n["start"]: n for n in nodes}
                for node in nodes:
                    if not node["leaf"]:
                        continue
                    formatted, spans = read_leaf(decode, ids, by_start, node)
                    turns = parse(formatted)
                    said = "".join(f"{r}\n{t}\n" for r, t in turns)
                    loss = "".join(spans)
                    out.append((node["name"], len(turns), _sha(said), len(loss), _sha(loss), len(formatted)))
            if out:
                yield dict(zip(("leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), zip(*out), strict=True))

        return step

    return emit(blocks, ["ids", "nodes"], "leaf string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint", make)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation, what is read back from the blocks."""
    blocks, members = tree(rows)
    return members.join(read_back(blocks), "leaf").drop("leaf")
