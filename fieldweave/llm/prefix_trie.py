"""Conversation prefix trie with a minimal-perfect-hash node table.

Conversations are first rebuilt: the head of each comes from the conversation that leads its
family.  A turn travels as the SHA-256 of its role and text, so texts are never shuffled; a node
is a prefix, named by 128 bits of the digests chained along it.

Nodes with more than ``HEAVY`` members (few: rows / ``HEAVY``) are the top of the trie, and every
member's path leaves the top at a *light root*, below which at most ``HEAVY`` conversations lie.
Subtrees of light roots are dealt into shards of about ``SHARD`` rows.  A shard enumerates its
distinct digests, gives each a slot by a minimal perfect hash (levels of bitmaps: a digest that
collides on one level goes to the next; a slot is its rank, and holds the digest, which every look-up
compares), scatters its rows into flat arrays of counts, and accumulates leaves and savings through
the array of parent slots, deepest nodes first.  What the light roots yield is summed by their
parents, and the top is accumulated in depth order, a join a depth.

A frequent conversation or first turn is rows of heavy nodes, which tasks count before they are
shuffled.  The sorted list of the conversations that end at a heavy node is hashed as a stream:
blocks of a range of ids are joined to text in parallel, and one hash runs over a node's blocks
in order, of which it holds one.

Defined results: turns in order of turn (null first), equal turns by the digest of role and text,
repeated rows as often as they occur; null role or text is empty; rows without a conv_id belong to
no conversation; a very long text is hashed where it lies; a long conversation is streamed; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

FAMILY, HEADS = 20, 4
HEAVY, SHARD = 1024, 2**14
#: Nodes of the top up to which their table is broadcast; beyond it Spark joins it as any table.
BROADCAST_TOP = 2**18
#: A block of an ends list spans 2**12 conversation ids.
SPAN_BITS = 12

_PATHS = pa.schema([("c", pa.int64()), ("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("pa", pa.int64()), ("pb", pa.int64()), ("words", pa.int64()), ("ends", pa.bool_())])
_NODES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("pa", pa.int64()), ("pb", pa.int64()), ("is_root", pa.bool_())])


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, pos, digest, words) of every turn of the rebuilt conversations, and a row of position 0 for each."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(C.WORD)).cast("long").alias("words"))
    i = F.row_number().over(Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    turns = C.store(turns.withColumn("i", i.cast("long")).drop("turn"))
    heads = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    leader = F.col("c") - F.col("c") % FAMILY
    convs = turns.where("i = 1").select("c", heads.alias("h"), leader.alias("leader"))
    # a family has fewer than 2 * FAMILY conversations, and a leader gives fewer than HEADS turns
    given = turns.where(F.col("i") < HEADS).where(F.col("c") % FAMILY == 0).select(F.col("c").alias("leader"), "i", "digest", "words")
    head = convs.join(given, "leader").where(F.col("i") <= F.col("h")).select("c", F.col("i").alias("pos"), "digest", "words")
    # own turns stand behind at most HEADS - 1 others: their places need not be dense
    own = turns.where(F.col("i") > heads).select("c", (F.col("i") + HEADS).alias("pos"), "digest", "words")
    start = convs.select("c", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return start.unionByName(head).unionByName(own)


def paths(turns: DataFrame) -> DataFrame:
    """(c, depth, a, b, pa, pb, words, ends): each conversation's nodes, with the parent's name, streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, depth, waiting = b"", 0, None
        for batch in batches:
            out = []
            for c, pos, digest, words in C.rows(batch.select(["c", "pos", "digest", "words"])):
                if waiting is not None:
                    out.append((*waiting, pos == 0))
                if pos == 0:
                    name, depth, above = bytes(16), 0, bytes(16)
                else:
                    name, above, depth = hashlib.sha256(name + digest).digest()[:16], name, depth + 1
                waiting = (c, depth, *np.frombuffer(name + above, np.int64).tolist(), words)
            if out:
                yield C.batch(_PATHS, *zip(*out))
        if waiting is not None:
            yield C.batch(_PATHS, *zip((*waiting, True)))

    return turns.repartition("c").sortWithinPartitions("c", "pos").mapInArrow(run, C.ddl(_PATHS))


class Slots:
    """A minimal perfect hash of distinct 128-bit names, verified by the names it holds."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        left, before = np.arange(len(a)), 0
        slot = np.zeros(len(a), np.int64)
        while len(left):
            size = 2 * len(left)
            place = self._place(a[left], b[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = np.cumsum(alone) - 1
            mine = alone[place]
            slot[left[mine]] = before + rank[place[mine]]
            self.levels.append((alone, rank, before))
            before += int(alone.sum())
            left = left[~mine]
        self.size = before
        self.a, self.b = np.zeros(before, np.int64), np.zeros(before, np.int64)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        h = C.mix(a.view(np.uint64) * C.MULT[0, level & 63] + b.view(np.uint64) * C.MULT[1, level & 63] + C.U64(level))
        return (h % C.U64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each name, -1 for names that are not held."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, rank, before) in enumerate(self.levels):
            place = self._place(a[left], b[left], level, len(alone))
            hit = alone[place]
            out[left[hit]] = before + rank[place[hit]]
            left = left[~hit]
        held = out >= 0
        out[held] = np.where((self.a[out[held]] == a[held]) & (self.b[out[held]] == b[held]), out[held], -1)
        return out


def _sha(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def light_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of one shard of light subtrees, all their counts final."""
    c, depth, a, b, up_a, up_b, words, ends, root = (rows[x].to_numpy() for x in ("c", "depth", "a", "b", "pa", "pb", "words", "ends", "is_root"))
    order = np.lexsort((b, a))
    head = order[np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))]
    table = Slots(a[head], b[head])
    slot = table.find(a, b)
    n = table.size
    members, least = np.bincount(slot, minlength=n), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, c)
    parent, level, last, top = (np.zeros(n, np.int64) for _ in range(4))
    at_a, at_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    level[slot], last[slot], top[slot], at_a[slot], at_b[slot] = depth, words, root, up_a, up_b
    if (at_a[slot] != up_a).any() or (at_b[slot] != up_b).any() or (level[slot] != depth).any():
        raise ArithmeticError("two prefixes share a digest")
    parent[:] = np.where(top > 0, -1, table.find(at_a, at_b))
    inner = parent >= 0
    children = np.bincount(parent[inner], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), (members - 1) * last
    for d in range(int(level.max()), int(level.min()), -1):
        at = np.flatnonzero((level == d) & inner)
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    final = np.flatnonzero(ends)
    final = final[np.lexsort((c[final], slot[final]))]
    edge = np.searchsorted(slot[final], np.arange(n + 1))
    mine = c[final].tolist()
    shas = [_sha(mine[i:j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
    above = pa.array(np.where(inner, least[parent], 0), mask=~inner)
    return pa.Table.from_arrays([pa.array(least), pa.array(level, pa.int32()), above, pa.array(members), pa.array(children), pa.array(leaves), pa.array(saved), pa.array(shas), pa.array(at_a), pa.array(at_b), pa.array(top > 0)], schema=_NODES)


def ends_of_top(rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes at which one of the rows (a, b, c) ends."""
    block = F.shiftright("c", SPAN_BITS)
    # at most 2**SPAN_BITS ids in a block
    texts = rows.groupBy("a", "b", block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in C.rows(batch.select(["a", "b", "ids"])):
                if (a, b) == node:
                    state.update(b"," + ids)
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["a", "b", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["a", "b", "ends_sha256"])

    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(run, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    spark = conversations.sparkSession
    path = C.store(paths(rebuilt(conversations, conv_col, turn_col, role_col, text_col)))
    node = ["a", "b"]
    counted = path.groupBy(*node).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("words").alias("words"),
        F.max(F.struct("pa", "pb", "depth")).alias("most"), F.min(F.struct("pa", "pb", "depth")).alias("least"),
    )
    top = C.store(counted.where(F.col("n_convs") > HEAVY))
    if top.where("most != least").limit(1).count():
        raise ArithmeticError("two prefixes share a digest")
    top = top.drop("most", "least")
    small = F.broadcast if top.count() <= BROADCAST_TOP else (lambda df: df)
    flagged = path.join(small(top.select(*node, F.lit(True).alias("heavy"))), node, "left")
    light = flagged.where("heavy is null").drop("heavy")
    # the least depth of a conversation's light nodes is that of its light root
    w = Window.partitionBy("c").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rooted = light.withColumn("root", F.first(F.struct("a", "b")).over(w))
    shards = -(-path.count() // SHARD) or 1
    dealt = rooted.select(*_PATHS.names, ((F.col("root.a") == F.col("a")) & (F.col("root.b") == F.col("b"))).alias("is_root"), F.pmod(F.xxhash64("root.a", "root.b"), F.lit(shards)).alias("shard"))
    below = C.store(dealt.groupBy("shard").applyInArrow(light_nodes, C.ddl(_NODES)))
    ends = ends_of_top(flagged.where("heavy and ends").select(*node, "c"))
    up = [F.col("pa").alias("a"), F.col("pb").alias("b")]
    sums = [F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    from_light = C.store(below.where("is_root").groupBy(*up).agg(*sums))
    done, above = [], None
    for d in range(top.agg(F.max("depth")).first()[0] if top.take(1) else -1, -1, -1):
        parts = from_light if above is None else from_light.unionByName(above)
        parts = parts.groupBy(*node).agg(*[F.sum(x).alias(x) for x in ("n_children", "n_leaves", "saved_tokens")])
        here = top.where(F.col("depth") == d).join(parts, node, "left")
        here = here.select(
            *node, "conv_id", "depth", "n_convs", "pa", "pb", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"),
        )
        done.append(C.store(here))
        above = done[-1].groupBy(*up).agg(*sums)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    leader = small(top.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("leader")))
    out = below.where("not is_root").select(*columns)
    roots = below.where("is_root").join(leader, ["pa", "pb"], "left")
    # the root of the trie has itself as its parent's name
    out = out.unionByName(roots.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("leader"))).select(*columns))
    for part in done:
        part = part.join(leader, ["pa", "pb"], "left").join(ends, node, "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("leader")))
        out = out.unionByName(part.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_sha([])))).select(*columns))
    return out.withColumn("depth", F.col("depth").cast("long"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie(C.table(spark, sf_dir, "conversations"))


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, four bits at a time."""
    step = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        step.append(n)
    four = lambda c: f"xor(({c}) >> 4, {step}[(({c}) & 15) + 1])"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, x: {four(four('xor(c, x)'))}), 4294967295)"


#: The same rows in DuckDB's SQL, with whole prefixes as names.
OP12_SQL = rf"""
WITH t0 AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t1 AS (
  SELECT c, turn, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t0),
t AS (SELECT c, digest, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS i FROM t1),
v AS (SELECT c, c - c % {FAMILY} AS leader, {_crc32("CAST(c AS VARCHAR)")} % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT v.c, i, digest, words FROM v JOIN t ON t.c = v.leader AND i <= h
  UNION ALL SELECT v.c, i + {HEADS}, digest, words FROM v JOIN t ON t.c = v.c AND i > h),
l0 AS (SELECT c, list(digest ORDER BY i) AS d, list(words ORDER BY i) AS w FROM r GROUP BY c),
l AS (SELECT c, coalesce(d, []) AS d, coalesce(w, []) AS w FROM v LEFT JOIN l0 USING (c)),
p AS (
  SELECT c, depth, array_to_string(d[1:depth], '') AS name, CASE WHEN depth > 0 THEN array_to_string(d[1:depth - 1], '') END AS parent,
         CASE WHEN depth > 0 THEN w[depth] ELSE 0 END AS words, depth = len(d) AS final
  FROM (SELECT *, unnest(range(0, len(d) + 1)) AS depth FROM l)),
n AS (
  SELECT name, depth, min(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE final), '')) AS ends_sha256
  FROM p GROUP BY name, depth),
k AS (SELECT parent AS name, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
s AS (
  SELECT p.name, sum((n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (WHERE k.name IS NULL) AS n_leaves
  FROM n LEFT JOIN k USING (name) JOIN p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.name)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (name) LEFT JOIN k USING (name) LEFT JOIN n AS up ON up.name = n.parent AND n.depth > 0
"""
