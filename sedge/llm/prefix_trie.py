"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is 20 bytes: the first 16 of the SHA-256 of role and text, then the text's code points as a big-endian number.
A conversation is the string of its ids. Distinct strings are sorted by ranges; every range is one adaptive radix tree
whose nodes grow from 4 to 16, 48 and 256 branches and whose single-branch stretches are compressed. Only byte depths that
are multiples of the id's width are nodes of the result. Ranges share nodes only along their first and last string; these
spines, a handful of rows per range, are merged by one more step, and all other rows are final where they are made.

Defined results: rows without conv_id are left out; a null role or text is empty; turns of equal number go by their id, so
repeated rows count as turns of their own; a conversation that ends up without turns ends in the root; an empty table has no
node at all, not even the root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes of a turn id, and how many of them at the end hold the code points of the text.
WIDTH, LENGTH = 20, 4
#: Branches that the layouts of a node hold.
LAYOUTS = (4, 16, 48, 256)
#: Bytes of distinct strings that one range, and so one tree, holds about.
RANGE_BYTES = 4 << 20
#: Width of the ranges of conv_id whose members are joined to one piece of text before they are hashed in order.
PIECE = 4096

NODES = "depth long, n_convs long, conv_id long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chars long, spine boolean, path binary, above binary"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
EMPTY = hashlib.sha256().hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """Hex digits of a turn's id. The role's length stands before it, so that different turns never read alike."""
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.upper(F.concat(F.substring(told, 1, 2 * (WIDTH - LENGTH)), F.lpad(F.hex(F.length(text)), 2 * LENGTH, "0")))


def heads(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and key: the ids of its rebuilt turns in a row.

    Texts are hashed where they are read; what is shuffled is an id and a number per turn. At most five ids of one
    conversation in a hundred are joined to the others.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), turn_id(role, text).alias("id")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["id"].alias("own"))
    first = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_first"), F.slice("own", 1, 5).alias("_lent"))
    met = own.withColumn("_h", heads(F.col("conv_id"))).join(first, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_first"), "left")
    lent = F.slice(F.coalesce("_lent", F.array().cast("array<string>")), F.lit(1), F.col("_h"))
    kept = F.slice("own", F.col("_h") + 1, F.greatest(F.size("own") - F.col("_h"), F.lit(0)))
    return met.select("conv_id", F.unhex(F.array_join(F.concat(lent, kept), "")).alias("key"))


def hash_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces of members to one row per key: n, least and the digest of all members, hashed as they pass by."""
    now, state, n, least = None, None, 0, 0
    for batch in batches:
        out = []
        for key, count, lowest, ids in zip(batch["key"], batch["n"], batch["least"], batch["ids"], strict=True):
            if key != now:
                if now is not None:
                    out.append((now, n, least, state.hexdigest()))
                now, state, n, least = key, hashlib.sha256(), 0, int(lowest)
            state.update((("," if n else "") + ids).encode())
            n += int(count)
        yield pd.DataFrame(out, columns=["key", "n", "least", "ends"])
    if now is not None:
        yield pd.DataFrame([(now, n, least, state.hexdigest())], columns=["key", "n", "least", "ends"])


def distinct_keys(keyed: DataFrame) -> DataFrame:
    """key, n, least and ends of every distinct string.

    Members are joined to pieces by range of their number, at most 4096 in a group, however many share a key; pieces then
    pass in order through the task that hashes them and never lie in memory together.
    """
    piece = F.floor(F.col("conv_id") / PIECE)
    ids = F.sort_array(F.collect_list("conv_id"))
    pieces = keyed.groupBy("key", piece.alias("piece")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))
    ordered = pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "n", "least", "ids")
    return ordered.mapInPandas(hash_members, "key binary, n long, least long, ends string")


class Node:
    """A node of the radix tree: the path to it is sample[:depth], of which the stretch below its parent is compressed.

    edges and slots have the layout for `room` branches: bytes beside their branches for 4 and 16, an index of 256 places
    for 48, one slot per byte for 256.
    """

    __slots__ = ("sample", "depth", "end", "room", "edges", "slots")

    def __init__(self, sample: bytes, depth: int, end: int = -1):
        self.sample, self.depth, self.end = sample, depth, end
        self.room, self.edges, self.slots = LAYOUTS[0], bytearray(), []

    def place(self, byte: int) -> int:
        """Slot of a byte's branch, -1 if there is none."""
        if self.room == 256:
            return byte if self.slots[byte] is not None else -1
        return self.edges[byte] - 1 if self.room == 48 else self.edges.find(byte)

    def put(self, byte: int, child: Node) -> None:
        """A new branch; a full node moves to the next layout first."""
        if self.room < 256 and len(self.slots) == self.room:
            self.grow()
        if self.room == 256:
            self.slots[byte] = child
            return
        self.slots.append(child)
        if self.room == 48:
            self.edges[byte] = len(self.slots)
        else:
            self.edges.append(byte)

    def grow(self) -> None:
        room = LAYOUTS[LAYOUTS.index(self.room) + 1]
        if room == 48:
            index = bytearray(256)
            for slot, byte in enumerate(self.edges):
                index[byte] = slot + 1
            self.edges = index
        elif room == 256:
            self.edges, self.slots = bytearray(), [self.slots[x - 1] if x else None for x in self.edges]
        self.room = room

    def branches(self) -> list[Node]:
        return [x for x in self.slots if x is not None]


def shared(a: bytes, b: bytes, start: int, stop: int) -> int:
    """Up to which depth two strings agree that agree up to start; stop at most."""
    x, y = a[start:stop], b[start:stop]
    if x == y:
        return start + len(x)
    n = min(len(x), len(y))
    apart = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
    return start + n - (apart.bit_length() + 7) // 8


def insert(root: Node, key: bytes, row: int) -> None:
    node = root
    while len(key) > node.depth:
        at = node.place(key[node.depth])
        if at < 0:
            node.put(key[node.depth], Node(key, len(key), row))
            return
        child = node.slots[at]
        common = shared(child.sample, key, node.depth, child.depth)
        if common < child.depth:  # the compressed stretch parts here
            middle = Node(key, common)
            middle.put(child.sample[common], child)
            node.slots[at] = child = middle
        node = child
    node.end = row


def tree_rows(keys: list[bytes], n: np.ndarray, least: np.ndarray, ends: list[str]) -> pd.DataFrame:
    """Rows of the turn-aligned nodes over distinct keys in order; those on the paths of the first and last key are the spine.

    Spine rows hold sums over what hangs on the spine but not on it; `above` is set where the parent is in the spine.
    """
    root = Node(b"", 0)
    for row, key in enumerate(keys):
        insert(root, key, row)
    depth, parent, chars, end = [0], [-1], [0], [root.end]
    stack = [(root, 0)]
    while stack:
        node, at = stack.pop()
        for child in node.branches():
            here = at
            for d in range((node.depth // WIDTH + 1) * WIDTH, child.depth + 1, WIDTH):
                depth.append(d // WIDTH)
                parent.append(here)
                chars.append(int.from_bytes(child.sample[d - LENGTH : d]))
                end.append(-1)
                here = len(depth) - 1
            if child.end >= 0:
                end[here] = child.end
            stack.append((child, here))
    size = len(depth)
    spine, path, told = np.zeros(size, bool), [None] * size, np.array(end)
    for row in {0, len(keys) - 1}:
        ways, state = [], hashlib.sha256()
        at = int(np.flatnonzero(told == row)[0])
        while at >= 0:
            spine[at] = True
            ways.append(at)
            at = parent[at]
        path[0] = state.digest()[:16]
        for k, at in enumerate(reversed(ways[:-1])):
            state.update(keys[row][k * WIDTH : (k + 1) * WIDTH])
            path[at] = state.digest()[:16]
    members, lowest = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    ending = told >= 0
    members[ending], lowest[ending] = n[told[ending]], least[told[ending]]
    kids, leaves, saved = ([0] * size for _ in range(3))
    members, lowest = members.tolist(), lowest.tolist()
    for at in range(size - 1, 0, -1):  # parents come before their children
        up = parent[at]
        members[up] += members[at]
        lowest[up] = min(lowest[up], lowest[at])
        if not spine[at]:
            leaves[at] = leaves[at] or 1
            saved[at] += (members[at] - 1) * chars[at]
            kids[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    under = [at > 0 and spine[parent[at]] for at in range(size)]
    return pd.DataFrame({
        "depth": depth, "n_convs": members, "conv_id": lowest,
        "parent_conv_id": pd.array([None if under[at] or not at else lowest[parent[at]] for at in range(size)], "Int64"),
        "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": [ends[x] if x >= 0 else EMPTY for x in end],
        "chars": chars, "spine": spine, "path": path, "above": [path[parent[at]] if under[at] else None for at in range(size)],
    })


def grow_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One tree per range of keys."""
    held = [b for b in batches if len(b)]
    if held:
        rows = pd.concat(held, ignore_index=True)
        out = tree_rows(list(rows["key"]), rows["n"].to_numpy(), rows["least"].to_numpy(), list(rows["ends"]))
        for k in range(0, len(out), 50_000):
            yield out.iloc[k : k + 50_000]


def merge_spines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spine rows of all ranges to final rows: sums over the ranges, then from the deepest up along the spines."""
    nodes: dict = {}
    for batch in batches:
        for r in batch.itertuples(index=False):
            x = nodes.setdefault(r.path, {"depth": r.depth, "above": r.above, "chars": r.chars, "n": 0, "least": r.conv_id, "kids": 0, "leaves": 0, "saved": 0, "ends": EMPTY})
            for to, add in (("n", r.n_convs), ("kids", r.n_children), ("leaves", r.n_leaves), ("saved", r.saved_tokens)):
                x[to] += int(add)
            x["least"] = min(x["least"], r.conv_id)
            x["ends"] = r.ends_sha256 if r.ends_sha256 != EMPTY else x["ends"]
    for x in sorted(nodes.values(), key=lambda x: -x["depth"]):
        x["leaves"] = x["leaves"] if x["kids"] else 1
        x["saved"] += (x["n"] - 1) * x["chars"]
        if x["depth"]:
            up = nodes[x["above"]]
            up["kids"] += 1
            up["leaves"] += x["leaves"]
            up["saved"] += x["saved"]
    rows = [(x["least"], x["depth"], nodes[x["above"]]["least"] if x["depth"] else None, x["n"], x["kids"], x["leaves"], x["saved"], x["ends"], p) for p, x in nodes.items()]
    yield pd.DataFrame(rows, columns=[*RESULT, "path"]).astype({"parent_conv_id": "Int64"})


def trie(keyed: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The nodes of the trie over keyed (conv_id, key)."""
    keys = cut(distinct_keys(keyed))
    total = keys.agg(F.sum(F.length("key") + 100).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // range_bytes))
    nodes = cut(keys.repartitionByRange(int(parts), "key").sortWithinPartitions("key").mapInPandas(grow_trees, NODES))
    spines = cut(nodes.where("spine").coalesce(1).mapInPandas(merge_spines, ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in RESULT) + ", path binary"))
    inner = nodes.where("NOT spine AND above IS NULL").select(RESULT)
    parents = spines.select(F.col("path").alias("_path"), F.col("conv_id").alias("_parent"))
    if spines.count() <= 100_000:  # 40 bytes each; beyond, the join is left to the planner, which splits what hangs on the root
        parents = F.broadcast(parents)
    hanging = nodes.where("NOT spine AND above IS NOT NULL").join(parents, F.col("above") == F.col("_path")).withColumn("parent_conv_id", F.col("_parent")).select(RESULT)
    return inner.unionByName(hanging).unionByName(spines.select(RESULT))


def report(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(conversations))
