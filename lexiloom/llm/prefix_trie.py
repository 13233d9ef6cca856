"""Conversation prefix trie by adaptive radix trees over turn ids.

A turn's id is 16 bytes of a hash of its role and text, so a conversation is a byte string and its
prefixes of whole turns are the nodes of the trie. Conversations are range-partitioned by that
string; each task builds one radix tree of its range, with node layouts that grow from 4 to 256
children and with compressed paths, and emits nodes at byte depths that are whole turns only.

A node below a range lies wholly in it unless it is a prefix of the range's first or last string.
These few edge nodes, at most two paths a range, leave a task as partial sums under the hash of
their prefix. They are merged, and what hangs below them is summed along the paths by doubling
steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written_table
from .base import query, small_or_shuffled, table, text_or_empty

#: Bytes of a turn id, and turns a range of conversations holds on average.
WIDTH, RANGE_TURNS = 16, 50_000
BASE_OF, HEADS = 20, 4


class Children:
    """Children of a node by key byte, in the smallest layout that holds them: 4, 16, 48 or 256."""

    __slots__ = ("layout", "keys", "slots")

    def __init__(self):
        self.layout, self.keys, self.slots = 4, bytearray(), []

    def __len__(self):
        return 256 - self.slots.count(None) if self.layout == 256 else len(self.slots)

    def get(self, byte: int):
        if self.layout <= 16:  # unsorted key bytes beside their slots
            at = self.keys.find(byte)
            return self.slots[at] if at >= 0 else None
        if self.layout == 48:  # a table of slot numbers, 255 for none
            at = self.keys[byte]
            return self.slots[at] if at < 255 else None
        return self.slots[byte]

    def put(self, byte: int, node: Node):
        if self.layout < 256 and len(self.slots) == self.layout:
            self._grow()
        if self.layout <= 16:
            self.keys.append(byte)
            self.slots.append(node)
        elif self.layout == 48:
            self.keys[byte] = len(self.slots)
            self.slots.append(node)
        else:
            self.slots[byte] = node

    def _grow(self):
        held = self.items()
        self.layout = {4: 16, 16: 48, 48: 256}[self.layout]
        if self.layout == 48:
            self.keys, self.slots = bytearray(b"\xff" * 256), []
        elif self.layout == 256:
            self.keys, self.slots = bytearray(), [None] * 256
        else:
            self.keys, self.slots = bytearray(), []
        for byte, node in held:
            self.put(byte, node)

    def items(self) -> list[tuple[int, Node]]:
        """(byte, child) in byte order."""
        if self.layout <= 16:
            return sorted(zip(self.keys, self.slots), key=lambda x: x[0])
        if self.layout == 48:
            return [(b, self.slots[at]) for b, at in enumerate(self.keys) if at < 255]
        return [(b, node) for b, node in enumerate(self.slots) if node is not None]


class Node:
    """``prefix`` are the bytes between the key byte that leads here and the node's branches."""

    __slots__ = ("prefix", "children", "end", "n", "low", "words", "rows", "hanging")

    def __init__(self, prefix: bytes, end=None):
        self.prefix, self.children, self.end = prefix, Children(), end


class RadixTree:
    """Byte strings with a value each; ``insert`` takes every string once."""

    def __init__(self):
        self.root = None

    def insert(self, key: bytes, value) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, at = self.root, 0
        while True:
            here = key[at : at + len(node.prefix)]
            if here != node.prefix:
                same = next((i for i, (x, y) in enumerate(zip(here, node.prefix)) if x != y), len(here))
                below = Node(node.prefix[same + 1 :], node.end)
                below.children = node.children
                branch = node.prefix[same]
                node.prefix, node.children, node.end = node.prefix[:same], Children(), None
                node.children.put(branch, below)
            at += len(node.prefix)
            if at == len(key):
                node.end = value
                return
            child = node.children.get(key[at])
            if child is None:
                node.children.put(key[at], Node(key[at + 1 :], value))
                return
            node, at = child, at + 1


def _walk(tree: RadixTree):
    """(node, byte depth above it, byte depth, on the first path, on the last path), parents first, in key order."""
    stack = [(tree.root, -1, len(tree.root.prefix), True, True)]
    order = []
    while stack:
        node, above, depth, first, last = stack.pop()
        order.append((node, above, depth, first, last))
        held = node.children.items()
        for i in range(len(held) - 1, -1, -1):
            child = held[i][1]
            stack.append(
                (child, depth, depth + 1 + len(child.prefix), first and node.end is None and i == 0, last and i == len(held) - 1)
            )
    return order


def trie_rows(tree: RadixTree, first: bytes, last: bytes):
    """Rows (closed, depth, low, parent, n, children, leaves, saved, ends, edge, edge parent, words) of all nodes.

    A value is (members that end here, smallest of them, words of each turn, hash of the ids, their
    text). Nodes on the path of ``first`` or ``last`` are edges: their children, leaves and savings
    are those of closed subtrees that hang from them directly.
    """
    order = _walk(tree)
    for node, above, depth, on_first, on_last in reversed(order):
        n, low, words = (node.end[0], node.end[1], node.end[2]) if node.end else (0, None, None)
        tops = leaves = saved = 0
        for _, child in node.children.items():
            n += child.n
            low = child.low if low is None else min(low, child.low)
            words = words if words is not None else child.words
            tops, leaves, saved = tops + child.hanging[0], leaves + child.hanging[1], saved + child.hanging[2]
        node.n, node.low, node.words, node.rows = n, low, words, []
        for at in range(depth // WIDTH * WIDTH, above, -WIDTH):
            turn = at // WIDTH
            own = words[turn - 1] if turn else 0
            if on_first or on_last:
                node.rows.append((False, turn, tops, leaves, saved, own))
                tops = leaves = saved = 0
            else:
                leaves, saved = leaves or 1, saved + (n - 1) * own
                node.rows.append((True, turn, tops, leaves, saved, own))
                tops = 1
        node.hanging = (tops, leaves, saved)
    none = hashlib.sha256().hexdigest()
    names = {}

    def edge_name(on_first: bool, turn: int) -> str:
        path = first if on_first else last
        if (on_first, turn) not in names:
            names[on_first, turn] = hashlib.sha256(path[: turn * WIDTH]).hexdigest()
        return names[on_first, turn]

    # The logical parent of a node's topmost row: (its smallest member, or its name if an edge).
    parents = {id(tree.root): (None, None)}
    for node, _, depth, on_first, on_last in order:
        low, name = parents.pop(id(node))
        for closed, turn, tops, leaves, saved, own in reversed(node.rows):
            ended = node.end if node.end and turn * WIDTH == depth else None
            if closed:
                yield (True, turn, node.low, low, node.n, tops, leaves, saved, ended[3] if ended else none, None, name, own)
                low, name = node.low, None
            else:
                edge = edge_name(on_first, turn)
                yield (False, turn, node.low, None, node.n, tops, leaves, saved, ended[4] if ended else None, edge, name, own)
                low, name = None, edge
        for _, child in node.children.items():
            parents[id(child)] = (low, name)


_FIELDS = (
    "closed boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends string, edge string, edge_parent string, words long"
)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trie rows of a range whose conversations arrive in order of (key, conv_id)."""
    tree, first, key, ids, words = RadixTree(), None, None, [], None

    def close():
        text = ",".join(map(str, ids))
        tree.insert(key, (len(ids), ids[0], words, hashlib.sha256(text.encode()).hexdigest(), text))

    for batch in batches:
        for k, w, c in zip(batch["key"].to_pylist(), batch["words"].to_pylist(), batch["conv_id"].to_pylist()):
            if k != key:
                if key is not None:
                    close()
                key, ids, words = k, [], w
                first = k if first is None else first
            ids.append(c)
    if key is None:
        return
    close()
    rows = []
    types = [pa.bool_(), *[pa.int64()] * 7, *[pa.string()] * 3, pa.int64()]
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for row in trie_rows(tree, first, key):
        rows.append(row)
        if len(rows) == 20_000:
            yield packed()
            rows = []
    if rows:
        yield packed()


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each edge's id texts, joined by commas in the order they arrive; holds one text at a time."""
    edge, running, done = None, None, []
    for batch in batches:
        for e, text in zip(batch["edge"].to_pylist(), batch["ends"].to_pylist()):
            if e != edge:
                if edge is not None:
                    done.append((edge, running.hexdigest()))
                edge, running = e, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
    if edge is not None:
        done.append((edge, running.hexdigest()))
    columns = zip(*done) if done else [[], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["edge", "sha"])


def rebuilt(turns: DataFrame, base_of: int = BASE_OF, heads: int = HEADS) -> DataFrame:
    """(conv_id, key, words): the turn ids of each rebuilt conversation as one string, and the words of each turn.

    Turns are ordered by number, null first; turns that share a number by their id.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), "turn",
        F.substring(F.sha2(whole, 256), 1, 2 * WIDTH).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"),
    )
    own = turns.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
    own = own.agg(F.array_sort(F.collect_list(turn)).alias("own"))
    own = written_table(own.select("conv_id", F.expr("transform(own, t -> struct(t.id, t.words))").alias("own")), "conversations")
    bases = own.filter(F.col("conv_id") % base_of == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % base_of).join(bases, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = both.withColumn("h", h).select(
        "conv_id", F.expr("concat(coalesce(slice(head, 1, h), array()), slice(own, h + 1, greatest(size(own) - h, 0)))").alias("turns")
    )
    return both.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("key"), F.col("turns.words").alias("words"))


def prefix_trie(turns: DataFrame, base_of: int = BASE_OF, heads: int = HEADS) -> DataFrame:
    """One row per distinct prefix of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. A null role or text is
    empty, a row without a conv_id belongs to no conversation, and repeated rows are turns of their
    own. Without conversations there are no nodes. A conversation's ids are held as one value (16 bytes a turn).
    """
    convs = written_table(rebuilt(turns, base_of, heads), "rebuilt")
    total = convs.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    parts = max(1, ceil(total / RANGE_TURNS))
    ranged = convs.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = ranged.mapInArrow(_tries, _FIELDS).withColumn("range", F.spark_partition_id())
    found = written_table(found, "trie")
    edges = _merged_edges(found.filter("NOT closed"))
    near = small_or_shuffled(edges.select(F.col("edge").alias("edge_parent"), F.col("conv_id").alias("above")), 500_000)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = found.filter("closed AND edge_parent IS NULL").withColumnRenamed("ends", "ends_sha256").select(columns)
    outer = found.filter("closed AND edge_parent IS NOT NULL").drop("parent_conv_id").join(near, "edge_parent")
    outer = outer.withColumnsRenamed({"ends": "ends_sha256", "above": "parent_conv_id"}).select(columns)
    return inner.unionByName(outer).unionByName(edges.select(columns))


def _merged_edges(partial: DataFrame) -> DataFrame:
    """Edge nodes with their final values; ``partial`` holds the share of each range in them."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    firsts = [F.first(c).alias(c) for c in ("depth", "edge_parent", "words")]
    merged = written_table(partial.groupBy("edge").agg(F.min("conv_id").alias("conv_id"), *sums, *firsts), "edges")
    below = merged.groupBy(F.col("edge_parent").alias("edge")).agg(F.count(F.lit(1)).alias("edge_children"))
    own = merged.join(below, "edge", "left").withColumn("n_children", F.col("n_children") + F.coalesce("edge_children", F.lit(0)))
    own = own.withColumns({
        "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
    })
    own = written_table(own.drop("edge_children"), "edges")
    # After k rounds a node holds the sums of all edge nodes less than 2^k levels below it.
    run = own.select("edge", F.col("edge_parent").alias("up"), "n_leaves", "saved_tokens")
    while run.filter("up IS NOT NULL").head(1):
        sent = run.groupBy(F.col("up").alias("edge")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        next_up = run.select(F.col("edge").alias("up"), F.col("up").alias("further"))
        run = run.join(sent, "edge", "left").join(next_up, "up", "left").select(
            "edge", F.col("further").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
        )
        run = written_table(run, "edge-sums")
    # The id texts of one edge are hashed in order of the ranges, by a stream.
    texts = partial.filter("ends IS NOT NULL").select("edge", "range", "ends")
    ends = texts.repartition("edge").sortWithinPartitions("edge", "range").mapInArrow(_joined_ids, "edge string, sha string")
    parent = own.select(F.col("edge").alias("edge_parent"), F.col("conv_id").alias("parent_conv_id"))
    done = own.drop("n_leaves", "saved_tokens").join(run.drop("up"), "edge").join(ends, "edge", "left").join(parent, "edge_parent", "left")
    return done.withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256)))


@query("op12_prefix_trie", """
WITH ct AS (SELECT list(list_reduce(list_prepend(v, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY v)
  AS crc_table FROM (SELECT unnest(range(256)) AS v)),
o AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: xor((a >> 8), crc_table[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 4 AS h FROM o, ct),
rb AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS t FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
px AS (SELECT conv_id, len(t) AS n, d, sha256(t[1:d]::VARCHAR) AS k, sha256(t[1:d - 1]::VARCHAR) AS up,
  CASE WHEN d > 0 THEN len(regexp_extract_all(t[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS w
  FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM rb)),
nd AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM px GROUP BY d, k),
ch AS (SELECT d - 1 AS d, up AS k, count(*) AS c FROM nd WHERE d > 0 GROUP BY ALL),
nc AS (SELECT nd.*, coalesce(c, 0) AS c FROM nd LEFT JOIN ch USING (d, k)),
an AS (SELECT p.d, p.k, sum((x.c = 0)::INT) AS leaves, sum((x.n - 1) * x.w) AS saved
  FROM nc x JOIN px p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY ALL)
SELECT nc.conv_id, nc.d::BIGINT AS depth, pa.conv_id AS parent_conv_id, nc.n::BIGINT AS n_convs, nc.c::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nc.ends AS ends_sha256
FROM nc JOIN an USING (d, k) LEFT JOIN nd pa ON pa.d = nc.d - 1 AND pa.k = nc.up""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
