"""Trie of the conversations' prefixes, built level by level, and what sharing them saves.

Of a turn only its digest and its length move, not its text. Conversations of equal
turns are one class with a count, so a group of copies of any size is one member
of the levels. The turns of a class meet its place in the trie depth by depth: members
are grouped by (parent node, next turn), which makes the nodes of that depth; a node
is named by the least conv_id of its members. A class that is alone in its node is alone
in all deeper ones; it leaves the levels, and the rest of its turns are nodes as
they stand. So there are as many rounds as the longest prefix that two different
conversations share, whatever the longest conversation.

Then the levels are joined in reverse: each depth sums its children's leaves and
savings into their parents.

The ids that end in a node are the members of one class. They are dealt by ranges
of (class, id), written as comma-joined pieces of ``PIECE_IDS``, and only the pieces
of a class run through its hash, one after another.

Defined cases: turns are ordered by turn, null first, then by the digest of role and
text; a row that repeats another is a turn of its own; a null role or text is
empty; rows without a conv_id belong to no conversation. An empty table has no
conversations and no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, small_batches, stored, table
from .order import running

HEADS, FAMILY = 6, 100
PIECE_IDS = 5000


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (place from 1), digest and chars of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))
    return running(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("digest")], "trie-turns", p="one").select("conv_id", "p", "digest", "chars")


def head_turns(conv_id: Column, heads: int = HEADS) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % heads).cast("long")


def rebuilt(turns: DataFrame, heads: int = HEADS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, digest, chars) of the rebuilt conversations, and (conv_id, size), also of those without a turn.

    The first turns come from the conversation that heads the family, as many as the id's hash says.
    """
    counts = turns.groupBy("conv_id").agg(F.max("p").alias("own"))
    # at most heads - 1 turns a family, as a list
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("p") < heads)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("p", "digest", "chars"))).alias("head"))
    base = F.col("conv_id") - F.col("conv_id") % family
    convs = counts.withColumn("base", base).withColumn("h", head_turns(F.col("conv_id"), heads)).join(first, "base", "left")
    head = F.when(F.col("head").isNull(), F.array().cast("array<struct<p:bigint,digest:binary,chars:bigint>>")).otherwise(F.slice("head", F.lit(1), F.col("h").cast("int")))
    convs = stored(convs.select("conv_id", "own", "h", head.alias("head")).withColumn("m", F.size("head").cast("long")), "trie-convs")
    sizes = convs.select("conv_id", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    taken = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.p").alias("d"), "x.digest", "x.chars")
    own = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("p > h").select("conv_id", (F.col("p") - F.col("h") + F.col("m")).alias("d"), "digest", "chars")
    return stored(taken.unionByName(own), "trie-rebuilt"), sizes


def _classes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv_id, size, rep (least id of the conversations with the same turns) and copies.

    Equality is by length and 256 bits, over (place, digest) pairs: each place has one, so the order needs no list.
    """
    pair = F.sha2(F.concat(F.col("digest"), F.encode(F.col("d").cast("string"), "utf-8")), 256)
    words = [F.bit_xor(F.conv(F.substring(pair, 15 * k + 1, 15), 16, 10).cast("long")).alias(f"x{k}") for k in range(4)]
    marks = sizes.join(rows.groupBy("conv_id").agg(*words), "conv_id", "left").fillna(0, [f"x{k}" for k in range(4)])
    keys = ["size", *[f"x{k}" for k in range(4)]]
    marks = stored(marks, "trie-marks")
    groups = marks.groupBy(*keys).agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies"))
    return stored(marks.join(groups, keys).select("conv_id", "size", "rep", "copies"), "trie-classes")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each class's pieces, which come in order, comma-joined; a class's pieces are never held together."""
    now, digest = None, None
    for batch in batches:
        out: list[tuple[int, str]] = []
        for rep, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rep != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = rep, hashlib.sha256()
                digest.update(piece.encode())
            else:
                digest.update(f",{piece}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["rep", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["rep", "ends_sha256"])


def ends_hashes(members: DataFrame) -> DataFrame:
    """rep and ends_sha256: the hash of the conv_ids of each class in ascending order, comma-joined. members: rep, conv_id."""
    small_batches(members.sparkSession)
    ranked = running(members.select("rep", "conv_id", F.lit(1).cast("long").alias("one")), ["rep"], [F.asc("conv_id")], "trie-members", nth="one")
    pieces = ranked.groupBy("rep", F.floor((F.col("nth") - 1) / PIECE_IDS).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))
    dealt = pieces.repartition(max(8, partitions(members)), "rep").sortWithinPartitions("rep", "k")
    return dealt.select("rep", "piece").mapInArrow(_hashed, "rep long, ends_sha256 string")


def _levels(rows: DataFrame, reps: DataFrame) -> list[DataFrame]:
    """For each depth: (rep, size, copies, node, parent, n_convs, n_reps, chars) of the classes on a node that the depth before shared.

    rows: rep, d, digest, chars. reps: rep, size, copies.
    """
    root = reps.agg(F.min("rep").alias("node"), F.sum("copies").alias("n_convs"), F.count("*").alias("n_reps"))
    none = F.lit(None).cast("long")
    level = stored(reps.crossJoin(F.broadcast(root)).select("rep", "size", "copies", "node", none.alias("parent"), "n_convs", "n_reps", F.lit(0).cast("long").alias("chars")), "trie-level-0")
    levels = [level]
    while True:
        d = len(levels)
        live = level.where((F.col("n_reps") > 1) & (F.col("size") >= d)).select("rep", "size", "copies", F.col("node").alias("parent"))
        if live.isEmpty():
            return levels
        turned = stored(live.join(rows.where(F.col("d") == d).select("rep", "digest", "chars"), "rep"), f"trie-live-{d}")
        nodes = turned.groupBy("parent", "digest").agg(F.min("rep").alias("node"), F.sum("copies").alias("n_convs"), F.count("*").alias("n_reps"))
        level = stored(turned.join(nodes, ["parent", "digest"]).select("rep", "size", "copies", "node", "parent", "n_convs", "n_reps", "chars"), f"trie-level-{d}")
        levels.append(level)


def _tails(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) below those where a class got alone, and their parents' share."""
    alone = [level.where("n_reps = 1 and size > " + str(d)).select("rep", "size", "copies", F.lit(d).cast("long").alias("from")) for d, level in enumerate(levels)]
    alone = alone[0] if len(alone) == 1 else _union(alone)
    own = rows.join(alone, "rep").where(F.col("d") > F.col("from")).select("rep", "d", "size", "copies", (F.col("chars") * (F.col("copies") - 1)).alias("saves"))
    # savings below a node: nothing where there is one copy, else summed from the end
    one, more = own.where("copies = 1"), own.where("copies > 1")
    summed = running(more, ["rep"], [F.desc("d")], "trie-tails", saved="saves")
    return one.withColumn("saved", F.lit(0).cast("long")).unionByName(summed).select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("copies").alias("n_convs"), (F.col("d") < F.col("size")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _rolled(levels: list[DataFrame], tails: DataFrame) -> list[DataFrame]:
    """Nodes of the levels with their children, leaves and savings, the deepest first."""
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    out: list[DataFrame] = []
    for d in reversed(range(len(levels))):
        nodes = levels[d].groupBy(F.col("node").alias("conv_id")).agg(F.first("parent").alias("parent_conv_id"), F.first("n_convs").alias("n_convs"), F.first("chars").alias("chars"))
        below = [x.where(F.col("depth") == d + 1) for x in (tails, *out[-1:])]
        sums = _union(below).groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        met = nodes.join(sums, "conv_id", "left").withColumn("depth", F.lit(d).cast("long"))
        met = met.withColumns(
            {
                "n_children": F.coalesce("children", F.lit(0)),
                "n_leaves": F.coalesce("leaves", F.lit(1)),
                "saved_tokens": (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0)),
            }
        )
        out.append(stored(met.select(*shown), f"trie-nodes-{d}"))
    return out


def prefix_trie(conversations: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = conversations.sparkSession
    rows, sizes = rebuilt(_turns(conversations), heads, family)
    classes = _classes(rows, sizes)
    reps = stored(classes.where("conv_id = rep").select("rep", "size", "copies"), "trie-reps")
    if reps.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    own = rows.join(reps.select("rep"), F.col("conv_id") == F.col("rep")).select("rep", "d", "digest", "chars")
    # a depth lies together, so that a level reads its own rows
    by_depth = stored(own.sortWithinPartitions("d"), "trie-rows")
    levels = _levels(by_depth, reps)
    tails = stored(_tails(by_depth, levels), "trie-tail-nodes")
    nodes = _union([tails, *_rolled(levels, tails)])
    ended = ends_hashes(classes.select("rep", "conv_id"))
    at_level = [level.where(F.col("size") == d).select("rep", F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("depth")) for d, level in enumerate(levels)]
    below = tails.where("n_children = 0").select(F.col("conv_id").alias("rep"), "conv_id", "depth")
    ends = _union([*at_level, below]).join(ended, "rep").drop("rep")
    return nodes.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
         sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, ''))::BIGINT AS chars
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base,
         xor(list_reduce(
           [4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: ((ascii(x) >> i) & 1)::BIGINT))),
           lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM t)
),
m AS (SELECT c.conv_id, c.h, count(t.p) AS m FROM c LEFT JOIN t ON t.conv_id = c.base AND t.p <= c.h GROUP BY ALL),
r AS (
  SELECT c.conv_id, t.p AS d, digest, chars FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL
  SELECT m.conv_id, t.p - m.h + m.m, digest, chars FROM m JOIN t ON t.conv_id = m.conv_id AND t.p > m.h
),
size AS (SELECT c.conv_id, count(r.d) AS size FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY ALL),
-- on: the node, as the hash of all turns up to a depth, that each conversation is on
paths AS (SELECT conv_id, d, chars, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM r),
on_ AS (SELECT conv_id, 0 AS d, 0 AS chars, '' AS node FROM c UNION ALL SELECT conv_id, d, chars, node FROM paths),
n AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM on_ GROUP BY d, node),
parent AS (
  SELECT n.*, pn.conv_id AS parent_conv_id FROM n
  LEFT JOIN on_ up ON up.conv_id = n.conv_id AND up.d = n.d - 1 LEFT JOIN n pn ON pn.d = up.d AND pn.node = up.node
),
kids AS (SELECT d - 1 AS d, parent_conv_id AS conv_id, count(*) AS n FROM parent WHERE d > 0 GROUP BY ALL),
-- each node with all above it, by its first member
above AS (
  SELECT n.conv_id, n.d, n.n_convs, n.chars, k.n IS NULL AS leaf, up.d AS up_d, up.node AS up_node
  FROM n LEFT JOIN kids k ON k.d = n.d AND k.conv_id = n.conv_id JOIN on_ up ON up.conv_id = n.conv_id AND up.d <= n.d
),
sums AS (SELECT up_d AS d, up_node AS node, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM above GROUP BY ALL),
ends AS (SELECT o.d, o.node, string_agg(o.conv_id::VARCHAR, ',' ORDER BY o.conv_id) AS ids FROM on_ o JOIN size s ON s.conv_id = o.conv_id AND s.size = o.d GROUP BY ALL)
SELECT p.conv_id, p.d::BIGINT AS depth, p.parent_conv_id, p.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM parent p LEFT JOIN kids k ON k.d = p.d AND k.conv_id = p.conv_id
JOIN sums s ON s.d = p.d AND s.node = p.node LEFT JOIN ends e ON e.d = p.d AND e.node = p.node
"""
