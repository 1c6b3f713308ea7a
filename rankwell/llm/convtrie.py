"""The prefix trie of conversations, from a global sort of their turn arrays.

A turn is a digest of its role and text, a conversation the string of its turns' digests.
Sorted by that string, all conversations that begin with the same turns lie beside each other:
a node of the trie is such an interval, and its depth a common prefix. The sort is a range
partition, so one sweep a partition over neighbouring rows makes the nodes: the longest common
prefix (LCP) of two neighbours tells which open intervals end between them and which begin, and
a stack holds what is open.

An interval that reaches the first or the last row of a partition may go on in the next one.
These are the prefixes of two rows a partition, and each partition hands them on as the open
stacks of its left and right end. A second sweep, over the open stacks in the order of the
partitions, stitches them in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a turn's digest (of SHA-256).
STEP = 32
#: Conversations that a partition of the sort takes.
PART_ROWS = 100_000
#: Ids that a node gathers before they are handed on as a piece of text.
PIECE = 8_192
#: Nodes with more children than this, and than a 10,000th of all nodes, find them by a broadcast.
WIDE = 10_000
#: Of a conversation whose id leaves a remainder by GROUP, up to HEADS - 1 first turns are the group's.
GROUP, HEADS = 20, 4


def turn_lists(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: of each conversation the array of (digest, words) of its turns.

    Turns are in the order of ``turn``, null first, ties by the digest. A null role or text is
    empty. Rows with a null conv_id belong to no conversation and are left out, and so are other
    columns. Only digests are gathered, never texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, STEP)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return got.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_group_heads(lists: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The conversations with their first h turns replaced by those of the conversation that leads
    their group (conv_id less its remainder by ``group``), h being crc32(conv_id) % ``heads``.

    Of a leader with fewer turns all are taken, of one that isn't there none. A leader heads at
    most ``group`` conversations, so no key is hot.
    """
    lead = lists.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("lead"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    own = lists.withColumns({"lead": F.col("conv_id") - F.col("conv_id") % group, "h": h})
    none = F.slice("turns", 1, 0)
    begin = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns") + 1)
    return own.join(lead, "lead", "left").select("conv_id", F.concat(begin, rest).alias("turns"))


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key string, parent_key string"
OPEN = f"kind string, part long, side int, step string, words long, ids string, {NODE}"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
EMPTY = hashlib.sha256(b"").hexdigest()


class _Rows:
    """Rows of a schema, given out in batches."""

    def __init__(self, schema: str):
        self.fields = [(n, _TYPES[t]) for n, t in (f.split() for f in schema.split(", "))]
        self.rows: list[dict] = []

    def add(self, **row) -> None:
        self.rows.append(row)

    def full(self, at_least: int = 10_000) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= at_least:
            cols = [pa.array([r.get(n) for r in self.rows], t) for n, t in self.fields]
            self.rows = []
            yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in self.fields])


class _Node:
    """An open interval: what is known of it so far."""

    __slots__ = ("words", "low", "n", "children", "leaves", "saved", "ids", "seq", "asked", "step", "key", "ended")

    def __init__(self, step: str, words: int):
        self.step, self.words = step, words
        self.low, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ids: list[str] = []
        self.seq, self.asked, self.key, self.ended = 0, False, None, False

    def member(self, conv: int) -> None:
        self.n += 1
        self.low = conv if self.low is None else min(self.low, conv)

    def merge(self, n: int, low: int | None, children: int, leaves: int, saved: int) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if low is not None:
            self.low = low if self.low is None else min(self.low, low)

    def close(self) -> None:
        """What only the whole interval tells: tokens saved in the node itself, and if it is a leaf."""
        self.saved += (self.n - 1) * self.words
        self.leaves = self.leaves or 1

    def into(self, parent: _Node) -> None:
        parent.merge(self.n, self.low, 1, self.leaves, self.saved)


def _key(path: str, depth: int) -> str:
    return hashlib.sha256(path[: depth * STEP].encode()).hexdigest()[:STEP]


def _lcp(a: str, b: str) -> int:
    """Turns that two paths have in common at their beginning."""
    lo, hi = 0, min(len(a), len(b)) // STEP
    if a[: hi * STEP] == b[: hi * STEP]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * STEP] == b[: mid * STEP]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _close(stack: list[_Node], depth: int, is_open) -> Iterator[tuple[_Node, int, _Node | None]]:
    """Take what is deeper than ``depth`` off the stack, the deepest first: (node, its depth, its
    parent if that ends with it). Nodes for which ``is_open`` (of their depth) holds are handed out as
    they are; the others are complete and count in their parents."""
    ended: list[tuple[_Node, int]] = []

    def whole() -> Iterator[tuple[_Node, int, _Node | None]]:
        for i, (node, at) in enumerate(ended):
            yield node, at, ended[i + 1][0] if i + 1 < len(ended) else None
        ended.clear()

    while len(stack) > depth + 1:
        node, at = stack.pop(), len(stack)
        if is_open(at):
            yield from whole()
            yield node, at, None
            continue
        node.close()
        if stack:
            node.into(stack[-1])
        ended.append((node, at))
    if ended and stack:
        stack[-1].asked = True
    yield from whole()


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one partition, sorted by path and conv_id: whole nodes, and as ``open`` ones the
    prefixes of its first and its last path, without what their open children add.

    A node whose parent ends with it gets its parent's conv_id here; one whose parent stays open
    gets the parent's key. The ids that end in a node are hashed here unless they are many or the
    node is open: then they leave as pieces of text under the node's key.
    """
    part, out = TaskContext.get().partitionId(), _Rows(OPEN)
    stack: list[_Node] = []
    path, left = "", 0  # left: up to this depth, the first path's prefixes are still open

    def piece(node: _Node, depth: int) -> None:
        if node.ids:
            node.key = node.key or _key(path, depth)
            out.add(kind="ids", part=part, side=node.seq, key=node.key, ids=",".join(node.ids))
            node.seq, node.ids = node.seq + 1, []

    def hand_on(node: _Node, depth: int, side: int) -> None:
        piece(node, depth)
        out.add(kind="open", part=part, side=side, depth=depth, step=node.step, words=node.words, conv_id=node.low, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, key=node.key or _key(path, depth), ends_sha256=None if node.seq else EMPTY)

    def whole(node: _Node, depth: int, parent: _Node | None) -> None:
        if node.seq:
            piece(node, depth)
        ends = None if node.seq else hashlib.sha256(",".join(node.ids).encode()).hexdigest()
        key = node.key or (_key(path, depth) if node.asked else None)
        out.add(kind="node", depth=depth, conv_id=node.low, parent_conv_id=parent.low if parent else None, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, ends_sha256=ends, key=key, parent_key=None if parent else _key(path, depth - 1))

    for batch in batches:
        convs, paths, words = (batch.column(c) for c in ("conv_id", "path", "words"))
        for conv, new, sizes in zip(convs.to_pylist(), paths.to_pylist(), words, strict=True):
            depth, same = len(new) // STEP, 0
            if not stack:
                stack, left = [_Node("", 0)], depth
            else:
                same = _lcp(path, new)
                for node, at, parent in _close(stack, same, lambda at: at <= left):
                    hand_on(node, at, 1) if at <= left else whole(node, at, parent)
                left = min(left, same)
            path = new
            if depth > same:
                each = sizes.as_py()
                stack += [_Node(new[d * STEP : (d + 1) * STEP], each[d]) for d in range(same, depth)]
            stack[-1].member(conv)
            stack[-1].ids.append(str(conv))
            if len(stack[-1].ids) >= PIECE:
                piece(stack[-1], depth)
            yield from out.full()
    for depth, node in enumerate(stack):
        hand_on(node, depth, 0 if depth <= left else 2)
    yield from out.full(1)


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole nodes that the open ones of all partitions make, sorted by part, side and depth.

    Of each partition come first the prefixes of its first path (side 0 those of the last path too,
    side 1 the others), then the rest of its last path (side 2). As far as the first path agrees with
    the stack, its nodes go on; where it departs, what is open below ends.
    """
    out, stack, follows = _Rows(NODE), [], True

    def end(depth: int) -> None:
        for node, at, parent in _close(stack, depth, lambda at: False):
            out.add(depth=at, conv_id=node.low, parent_conv_id=parent.low if parent else None, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, ends_sha256=None if node.seq else EMPTY, key=node.key, parent_key=None if parent or not stack else stack[-1].key)

    for batch in batches:
        for r in batch.to_pylist():
            depth = r["depth"]
            follows = depth == 0 or follows and r["side"] != 2 and depth < len(stack) and stack[depth].step == r["step"]
            if not (follows and depth < len(stack)):
                end(depth - 1)
                stack.append(_Node(r["step"], r["words"]))
                stack[-1].key = r["key"]
                follows = False
            stack[depth].merge(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
            stack[depth].seq += r["ends_sha256"] is None
            yield from out.full()
    end(-1)
    yield from out.full(1)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, ends_sha256`` of pieces of text sorted by key and order; one piece is held at a time."""
    out, key, sha = _Rows("key string, ends_sha256 string"), None, None
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k == key:
                sha.update(b",")
            else:
                if key is not None:
                    out.add(key=key, ends_sha256=sha.hexdigest())
                key, sha = k, hashlib.sha256()
            sha.update(ids.encode())
            yield from out.full()
    if key is not None:
        out.add(key=key, ends_sha256=sha.hexdigest())
    yield from out.full(1)


def prefix_trie(lists: DataFrame, parts: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of ``lists`` (conv_id, turns: array of (digest, words)), which has
    each conv_id once: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``, see ``op11_conversation_trie``.

    Conversations without turns end in the root. Without any conversation there is no node, the
    root included. Equal conversations are members of one node, however many; they may fill any
    number of partitions. The ids that end in one node have one hash, so they are read by one task,
    but piece by piece and as text of some thousand ids a row.
    """
    spark = lists.sparkSession
    path = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = written(lists.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")), "paths")
    parts = parts or max(spark.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    ranged = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    swept = written(ranged.mapInArrow(sweep, OPEN), "swept")
    cols = [f.split()[0] for f in NODE.split(", ")]
    # the open stacks: a few rows a partition, however many rows it has
    opened = swept.filter("kind = 'open'").select("part", "side", "step", "words", *cols)
    stitched = opened.repartition(1).sortWithinPartitions("part", "side", "depth").mapInArrow(stitch, NODE)
    pieces = swept.filter("kind = 'ids'").select("key", "part", "side", "ids")
    ends = pieces.repartition("key").sortWithinPartitions("key", "part", "side").select("key", "ids").mapInArrow(hashed, "key string, ends_sha256 string")
    nodes = written(swept.filter("kind = 'node'").select(cols).unionByName(stitched), "nodes")
    late = nodes.filter("ends_sha256 IS NULL").drop("ends_sha256").join(ends, "key").select(cols)
    nodes = nodes.filter("ends_sha256 IS NOT NULL").unionByName(late)
    return _with_parents(written(nodes, "nodes")).select(*[c for c in cols if not c.endswith("key")])


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the parents that are known by key only. Parents of many children are few (at most
    one for each 10,000th of all nodes), and broadcast; the others are joined by a shuffle."""
    wide = max(WIDE, nodes.count() // 10_000)
    parents = nodes.filter("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"), "n_children")
    asked = nodes.filter("parent_key IS NOT NULL")
    few = parents.filter(F.col("n_children") > wide).drop("n_children")
    rest = parents.filter(F.col("n_children") <= wide).drop("n_children")
    met = asked.join(F.broadcast(few), "parent_key", "left").withColumn("parent_conv_id", F.col("found")).drop("found")
    late = met.filter("parent_conv_id IS NULL").join(rest, "parent_key").withColumn("parent_conv_id", F.col("found")).drop("found")
    return nodes.filter("parent_key IS NULL").unionByName(met.filter("parent_conv_id IS NOT NULL")).unionByName(late)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations whose first turns are their group's.

    Of each node: ``conv_id``, its smallest member; ``depth``; ``parent_conv_id``, its parent's (root:
    null); ``n_convs`` members; ``n_children``; ``n_leaves``, childless nodes in its subtree;
    ``saved_tokens``, the words that need not be processed again in its subtree; ``ends_sha256`` of
    the ids that end in it.
    """
    return prefix_trie(with_group_heads(turn_lists(table(spark, sf_dir, "conversations"))))


SQL_OP11 = """
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(0, 256) AS r(i))
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS k, sha, words FROM (
    SELECT conv_id, turn, left(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS sha,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS lead, xor(4294967295, list_reduce(
      list_transform(range(0, len(b) // 2), lambda i: CAST('0x' || substr(b, 2 * i + 1, 2) AS BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 4 AS h
  FROM (SELECT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS b FROM (SELECT DISTINCT conv_id FROM turns)), crc
), built AS (
  SELECT c.conv_id, 0 AS own, k, sha, words FROM convs c JOIN turns t ON t.conv_id = c.lead AND t.k <= c.h
  UNION ALL SELECT c.conv_id, 1, k, sha, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h
), steps AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(sha, '') OVER w AS path, words FROM built
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, k ROWS UNBOUNDED PRECEDING)
), members AS (
  SELECT conv_id, depth, path, words FROM steps UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), longest AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
nodes AS (
  SELECT m.path, m.depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(CASE WHEN l.depth = m.depth THEN CAST(m.conv_id AS VARCHAR) END, ',' ORDER BY m.conv_id), '')) AS ends_sha256
  FROM members m JOIN longest l ON l.conv_id = m.conv_id GROUP BY m.path, m.depth
), kids AS (
  SELECT p.path, count(*) AS n_children FROM nodes p JOIN nodes c ON c.depth = p.depth + 1 AND left(c.path, p.depth * 32) = p.path GROUP BY p.path
), leaf AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
under AS (
  SELECT left(path, CAST(d * 32 AS INTEGER)) AS top, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS d FROM leaf) GROUP BY top
)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, l.n_convs, l.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM leaf l JOIN under u ON u.top = l.path LEFT JOIN nodes p ON p.depth = l.depth - 1 AND p.path = left(l.path, CAST(p.depth * 32 AS INTEGER))
"""
