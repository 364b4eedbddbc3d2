"""Conversation prefixes as adaptive radix trees over fixed-width turn ids.

A turn's id is 16 bytes of its content's SHA-256, so a conversation is a string
of bytes whose every 16th depth ends a turn. Tasks insert such keys into adaptive
radix trees: inner nodes hold 4, 16, 48 or 256 children and grow from one layout
to the next, and a path without branches is one compressed edge. Only byte depths
at the end of a turn emit nodes.

Conversations of any length are cut into blocks of ``BLOCK`` turns. A key begins
with its block's number and the name of all turns before, so a block's tree hangs
below the node where the block before ended. Equal keys are summed first, so a
group of copies is one key. Keys are then dealt out by ranges and sorted, and a
task closes its tree when it holds enough and begins another. A node can be shared
with another tree only on the way to a tree's first or last key, or to the end of
a full block; these few nodes are summed over trees, and sums over subtrees reach
them by pointer doubling in as many rounds as their depth has bits. All other nodes
are final where they are made and are never shuffled.

A node's name is the exclusive or, in two 64-bit hashes, of its turns' ids hashed
with their places. Two sequences of one length get the same name with a chance of
2^-128.

Defined results: null roles and texts are empty; turns are ordered by turn number,
null first, and turns with equal numbers by the digest of their content, rows that
repeat being turns as any others; rows with a null conv_id belong to no
conversation; an empty table gives no rows, not even a root. Columns besides the
four are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.order import id_digests, numbered
from ledgerloom.llm.skew import spread_join
from ledgerloom.session import materialise

WIDTH = 16
BLOCK = 256  # turns
HEAD = 20  # bytes of a key before its turns: block number and name of the turns before
GROUP, MOST = 5, 9
SALT = 4096  # turns of one conversation that meet its row in one task
TREE_TURNS = 200_000  # turns in a tree before a task begins another


class Sorted:
    """Up to 4, then up to 16 children beside their sorted bytes."""

    __slots__ = ("room", "bytes", "kids")

    def __init__(self) -> None:
        self.room, self.bytes, self.kids = 4, bytearray(), []

    def find(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.kids[at]

    def add(self, byte: int, kid: "Node"):
        if len(self.kids) == self.room:
            if self.room == 16:
                return Indexed(self).add(byte, kid)
            self.room = 16
        at = bisect_left(self.bytes, byte)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def ordered(self) -> list["Node"]:
        return self.kids


class Indexed:
    """Up to 48 children, found through a table of 256 places."""

    __slots__ = ("place", "kids")

    def __init__(self, before: Sorted) -> None:
        self.place, self.kids = bytearray(256), []
        for byte, kid in zip(before.bytes, before.kids):
            self.add(byte, kid)

    def find(self, byte: int):
        at = self.place[byte]
        return self.kids[at - 1] if at else None

    def add(self, byte: int, kid: "Node"):
        if len(self.kids) == 48:
            return Direct(self).add(byte, kid)
        self.kids.append(kid)
        self.place[byte] = len(self.kids)
        return self

    def ordered(self) -> list["Node"]:
        return [self.kids[at - 1] for at in self.place if at]


class Direct:
    """A child for every byte."""

    __slots__ = ("kids",)

    def __init__(self, before: Indexed) -> None:
        self.kids = [before.find(byte) for byte in range(256)]

    def find(self, byte: int):
        return self.kids[byte]

    def add(self, byte: int, kid: "Node"):
        self.kids[byte] = kid
        return self

    def ordered(self) -> list["Node"]:
        return [kid for kid in self.kids if kid is not None]


class Node:
    """``path`` follows the byte that led here; ``stop`` is the value of the key that ends here."""

    __slots__ = ("path", "stop", "below", "byte")

    def __init__(self, byte: int, path: bytes, stop=None) -> None:
        self.byte, self.path, self.stop, self.below = byte, path, stop, None

    def attach(self, kid: "Node") -> None:
        self.below = (self.below or Sorted()).add(kid.byte, kid)

    def split(self, at: int) -> None:
        """Move what follows the first ``at`` bytes of the path into a child."""
        kid = Node(self.path[at], self.path[at + 1 :], self.stop)
        kid.below = self.below
        self.path, self.stop, self.below = self.path[:at], None, None
        self.attach(kid)

    def children(self) -> list["Node"]:
        return self.below.ordered() if self.below else []


def shared_length(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of a path a key has from ``at`` on."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(path[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def insert(root: Node | None, key: bytes, stop) -> Node:
    """Put a key that is not yet there into a tree."""
    if root is None:
        return Node(0, key, stop)
    node, at = root, 0
    while True:
        common = shared_length(node.path, key, at)
        if common < len(node.path):
            node.split(common)
        at += common
        if at == len(key):
            node.stop = stop
            return root
        kid = node.below.find(key[at]) if node.below else None
        if kid is None:
            node.attach(Node(key[at], key[at + 1 :], stop))
            return root
        node, at = kid, at + 1


FIELDS = [
    ("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("up_a", pa.int64()), ("up_b", pa.int64()),
    ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("bytes", pa.int64()), ("ends", pa.string()),
    ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
    ("open", pa.bool_()), ("parent", pa.int64()),
]
NODES = ", ".join(f"{name} {'string' if kind == pa.string() else 'boolean' if kind == pa.bool_() else 'bigint'}" for name, kind in FIELDS)
PARENT = len(FIELDS) - 1


class Sums:
    """What the nodes below a byte depth add up to, until a turn's end takes it over."""

    __slots__ = ("n", "conv", "children", "leaves", "saved", "tops", "sample", "open")

    def __init__(self, node: Node, below: list["Sums"], edge: bool) -> None:
        stop = node.stop
        self.n = sum(s.n for s in below) + (stop[0] if stop else 0)
        self.conv = min([s.conv for s in below] + ([stop[1]] if stop else []))
        self.children = sum(s.children for s in below)
        self.leaves = sum(s.leaves for s in below)
        self.saved = sum(s.saved for s in below)
        self.tops = [row for s in below for row in s.tops]
        self.sample = stop[3] if stop else below[0].sample
        full = bool(stop) and len(stop[3][5]) == BLOCK
        self.open = edge or full or any(s.open for s in below)


def edges(root: Node) -> set[int]:
    """The nodes on the way to the first and to the last key."""
    found = set()
    node = root
    while node:
        found.add(id(node))
        node = None if node.stop else node.children()[0]
    node = root
    while node:
        found.add(id(node))
        kids = node.children()
        node = kids[-1] if kids else None
    return found


def emit(root: Node) -> list[list]:
    """A row for every depth at a turn's end; ``open`` rows may have a part in another tree."""
    edge, rows = edges(root), []
    waiting, done = [(root, -1, False)], []
    while waiting:
        node, after, ready = waiting.pop()  # ``after``: the byte depth of the node above
        kids = node.children()
        end = after + 1 + len(node.path) if after >= 0 else len(node.path)
        if not ready:
            waiting.append((node, after, True))
            waiting.extend((kid, end, False) for kid in kids)
            continue
        below = done[len(done) - len(kids) :]
        del done[len(done) - len(kids) :]
        sums = Sums(node, below, id(node) in edge)
        for turn in range((end - HEAD) // WIDTH, max(-1, (after - HEAD) // WIDTH), -1):
            _turn(rows, sums, turn, node.stop if HEAD + WIDTH * turn == end else None)
        done.append(sums)
    return rows


def _turn(rows: list[list], sums: Sums, turn: int, stop) -> None:
    """Add the row of one turn's end and let it stand for all below."""
    block, a, b, all_a, all_b, sizes = sums.sample
    depth = block * BLOCK + turn
    ends = stop[2] if stop else None
    if turn == 0:  # the root, or a node that an earlier block's tree counts
        first = block == 0
        head = [depth, a, b, None, None, sums.conv if first else None, sums.n if first else 0, 0 if first else None]
        rows.append([*head, ends, sums.children, sums.leaves, sums.saved, True, None])
        sums.children, sums.leaves, sums.saved, sums.tops, sums.open = 0, 0, 0, [], True
        return
    up = (a, b) if turn == 1 else (int(all_a[turn - 2]), int(all_b[turn - 2]))
    size = int(sizes[turn - 1])
    head = [depth, int(all_a[turn - 1]), int(all_b[turn - 1]), *up, sums.conv, sums.n, size, ends]
    if sums.open:
        rows.append([*head, sums.children, sums.leaves, sums.saved, True, None])
        sums.children, sums.leaves, sums.saved, sums.tops = 0, 0, 0, []
        return
    for row in sums.tops:
        rows[row][PARENT] = sums.conv
    sums.leaves = sums.leaves or 1
    sums.saved += (sums.n - 1) * size
    sums.tops = [len(rows)]
    rows.append([*head, sums.children, sums.leaves, sums.saved, False, None])
    sums.children = 1


def grow_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the trees of sorted keys (key, n, conv_id, ends, block, a, b, turn_a, turn_b, sizes)."""

    def closed(root: Node) -> pa.RecordBatch:
        columns = list(zip(*emit(root)))
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, (_, kind) in zip(columns, FIELDS)], names=[name for name, _ in FIELDS]
        )

    root, held = None, 0
    for batch in batches:
        plain = [batch.column(i).to_pylist() for i in range(7)]
        lists = [batch.column(i) for i in range(7, 10)]
        for row, (key, n, conv, ends, block, a, b) in enumerate(zip(*plain)):
            turn_a, turn_b, sizes = (values[row].values.to_numpy(zero_copy_only=False) for values in lists)
            all_a = np.bitwise_xor.accumulate(turn_a) ^ np.int64(a)
            all_b = np.bitwise_xor.accumulate(turn_b) ^ np.int64(b)
            root = insert(root, key, (n, conv, ends, (block, a, b, all_a, all_b, sizes)))
            held += 1 + len(sizes)
            if held >= TREE_TURNS:
                yield closed(root)
                root, held = None, 0
    if root is not None:
        yield closed(root)


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id, bytes) of every turn: 16 bytes that name its content, and its text's length."""
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.unhex(F.substring(F.sha2(content, 256), 1, 2 * WIDTH)).alias("id"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return (F.crc32(conv_id.cast("string")) % MOST).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, id, bytes, length) of the rebuilt turns, and (conv_id, length) of all conversations."""
    rows = numbered(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("id")], "place")
    rows = materialise(rows.drop("turn"), "turns")
    counted = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    counted = counted.select("conv_id", "n", first.alias("base"), borrowed(F.col("conv_id")).alias("h"))
    bases = counted.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0))).cast("bigint")
    convs = materialise(
        counted.join(bases, "base", "left")
        .select("conv_id", "base", "n", "h", taken.alias("taken"))
        .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))),
        "conversations",
    )
    # A long conversation's row meets its turns in as many tasks as it has parts.
    part = F.floor((F.col("place") - 1) / F.lit(SALT))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.lit(SALT))))
    own = (
        rows.filter(F.col("place") > borrowed(F.col("conv_id")))
        .withColumn("part", part)
        .join(convs.select("conv_id", "h", "taken", "length", parts.alias("part")), ["conv_id", "part"])
        .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("at"), "id", "bytes", "length")
    )
    heads = rows.filter(F.col("place") < MOST).withColumnRenamed("conv_id", "base")
    lent = (
        convs.filter("taken > 0")
        .join(heads, "base")
        .filter("place <= taken")
        .select("conv_id", F.col("place").alias("at"), "id", "bytes", "length")
    )
    return own.unionByName(lent), convs.select("conv_id", "length")


def block_keys(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of all conversations with their names, and (depth, end_a, end_b, conv_id) where each ends."""
    lanes = turns.withColumns({"x": F.xxhash64("at", "id"), "y": F.xxhash64("id", "at")})
    blocks = (
        lanes.groupBy("conv_id", F.floor((F.col("at") - 1) / F.lit(BLOCK)).alias("block"))
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "id", "bytes", "x", "y"))).alias("turns"),
            F.bit_xor("x").alias("x"),
            F.bit_xor("y").alias("y"),
            F.max("length").alias("length"),
        )
    )
    blocks = materialise(blocks, "blocks")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = F.col("length") > BLOCK
    names = blocks.filter(later).select(
        "conv_id", "block", F.bit_xor("x").over(before).alias("a"), F.bit_xor("y").over(before).alias("b")
    )
    zero = F.lit(0).cast("bigint")
    single = blocks.filter(~later).withColumns({"a": zero, "b": zero})
    several = blocks.filter(later).join(names, ["conv_id", "block"])
    several = several.withColumns({"a": F.coalesce("a", zero), "b": F.coalesce("b", zero)})
    keyed = single.unionByName(several.select(single.columns)).withColumns(
        {
            "depth": F.col("block") * BLOCK + F.size("turns"),
            "end_a": F.col("a").bitwiseXOR(F.col("x")),
            "end_b": F.col("b").bitwiseXOR(F.col("y")),
        }
    )
    empty = convs.filter("length = 0").select(
        "conv_id", zero.alias("block"), zero.alias("a"), zero.alias("b"),
        F.array().cast(blocks.schema["turns"].dataType).alias("turns"), zero.alias("length"),
        zero.alias("depth"), zero.alias("end_a"), zero.alias("end_b"),
    )
    keyed = keyed.select(empty.columns).unionByName(empty)
    return keyed, keyed.filter("depth = length").select("depth", "end_a", "end_b", "conv_id")


def distinct_keys(keyed: DataFrame, ends: DataFrame) -> DataFrame:
    """What ``grow_trees`` reads: each key once, with the number and the smallest of its conversations."""
    name = ["depth", "end_a", "end_b"]
    digests = id_digests(ends, name, "conv_id", "ends")
    classes = (
        keyed.groupBy(*name)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("conv_id").alias("conv_id"),
            F.first(F.struct("block", "a", "b", "turns")).alias("one"),
        )
        .join(digests, name, "left")
        .select("n", "conv_id", "ends", "one.*")
    )

    def wide(number: Column, digits: int) -> Column:
        return F.lpad(F.hex(number), digits, "0")

    ids = F.array_join(F.transform("turns", lambda turn: F.hex(turn["id"])), "")
    head = F.concat(wide(F.col("block"), 8), wide(F.col("a"), 16), wide(F.col("b"), 16))
    return classes.select(
        F.unhex(F.concat(head, ids)).alias("key"), "n", "conv_id", "ends", "block", "a", "b",
        F.col("turns.x").alias("x"), F.col("turns.y").alias("y"), F.col("turns.bytes").alias("sizes"),
    )


def closed_sums(shared: DataFrame) -> DataFrame:
    """The nodes that several trees may hold, summed, with ``leaves`` and ``saved`` over their subtrees.

    Pointers double: in each round every node sends its sums to the node its
    pointer names and takes over that node's pointer.
    """
    name = ["depth", "a", "b"]
    merged = shared.groupBy(*name).agg(
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("ends").alias("ends"),
        F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )
    merged = materialise(merged, "shared")
    kids = (
        merged.filter("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
        .agg(F.count(F.lit(1)).alias("more"))
    )
    children = F.col("children") + F.coalesce("more", F.lit(0))
    nodes = materialise(
        merged.join(kids, name, "left")
        .withColumn("children", children)
        .withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("bigint"))
        .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes"))
        .drop("more"),
        "closing",
    )
    to = ["to_depth", "to_a", "to_b"]
    step = nodes.select(
        *name, "leaves", "saved",
        F.when(F.col("depth") > 0, F.col("depth") - 1).alias("to_depth"),
        F.col("up_a").alias("to_a"), F.col("up_b").alias("to_b"),
    )
    while not step.filter("to_depth IS NOT NULL").isEmpty():
        sent = (
            step.filter("to_depth IS NOT NULL")
            .groupBy(*to)
            .agg(F.sum("leaves").alias("more"), F.sum("saved").alias("kept"))
            .toDF(*name, "more", "kept")
        )
        further = step.select(*[F.col(n).alias(t) for n, t in zip(name, to)], *[F.col(t).alias(f"_{t}") for t in to])
        step = materialise(
            step.join(sent, name, "left")
            .join(further, to, "left")
            .select(
                *name,
                (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("kept", F.lit(0))).alias("saved"),
                *[F.col(f"_{t}").alias(t) for t in to],
            ),
            "doubling",
        )
    return nodes.drop("leaves", "saved").join(step.drop(*to), name)


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row for every distinct sequence of first turns of the rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256).
    """
    turns, convs = rebuilt(turn_ids(conversations))
    keyed, ends = block_keys(turns, convs)
    keys = distinct_keys(materialise(keyed, "keys"), ends)
    grown = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(grow_trees, NODES)
    nodes = materialise(grown, "nodes")
    shared = materialise(closed_sums(nodes.filter("open")), "closed")

    up = ["depth", "a", "b"]
    above = shared.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("over"))
    local = nodes.filter("NOT open")
    loose = local.filter("parent IS NULL").drop("parent", "open").unionByName(
        shared.withColumns({"bytes": F.col("bytes"), "ends": F.col("ends")}).select(*[n for n, _ in FIELDS[:-2]])
    )
    named = spread_join(loose, above, ["depth", "up_a", "up_b"], "a").withColumnRenamed("over", "parent")
    whole = local.filter("parent IS NOT NULL").drop("open").unionByName(named.select(*[n for n, _ in FIELDS if n != "open"]))
    return whole.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit, for an engine without that function."""
    bit = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(crc, code), range(8)), lambda x, step: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, code: {byte}), 4294967295)"


def oracle() -> str:
    """Prefixes as lists and ancestors by recursion, as SQL for the checking engine."""
    return f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
         sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, id, strlen(text) AS bytes,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place FROM given),
convs AS (SELECT conv_id AS c, conv_id - conv_id % {GROUP} AS base, {crc32_sql("conv_id::VARCHAR")} % {MOST} AS h
          FROM (SELECT DISTINCT conv_id FROM placed)),
turns AS (
  SELECT c, place AS pos, id, bytes FROM convs JOIN placed ON placed.conv_id = base AND place <= h
  UNION ALL SELECT c, place + 1000000000, id, bytes FROM convs JOIN placed ON placed.conv_id = c AND place > h),
prefixes AS (
  SELECT c, list(id) OVER (PARTITION BY c ORDER BY pos) AS path, bytes FROM turns
  UNION ALL SELECT c, []::VARCHAR[], 0 FROM convs),
whole AS (SELECT c, arg_max(path, len(path)) AS path FROM prefixes GROUP BY c),
nodes AS (SELECT path, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY path),
stops AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM whole GROUP BY path),
kids AS (SELECT path[:-2] AS path, count(*) AS n_children FROM nodes WHERE len(path) > 0 GROUP BY 1),
joined AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.path = k.path),
reach AS (SELECT path AS top, path, bytes, n_convs, n_children FROM joined
          UNION ALL SELECT top[:-2], path, bytes, n_convs, n_children FROM reach WHERE len(top) > 0),
sums AS (SELECT top, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM reach GROUP BY top)
SELECT j.conv_id, len(j.path)::BIGINT AS depth, p.conv_id AS parent_conv_id, j.n_convs, j.n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM joined j JOIN sums s ON s.top = j.path
LEFT JOIN nodes p ON len(j.path) > 0 AND p.path = j.path[:-2]
LEFT JOIN stops t ON t.path = j.path
"""
