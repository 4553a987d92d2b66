"""Operator 11: the prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of the first d turns of some conversations.  It is named by
its smallest member and d, so the nodes on a conversation's way from the root are its
prefixes, each with the name of that prefix's smallest member.

1. Turns are put in order by ranges, so that a conversation of any length is dealt to many
   tasks; numbers and running hashes are taken within a range and carried from range to
   range.  A prefix's hash is the exclusive-or of hashes of place and turn, in two lanes.
2. Nodes are grouped by prefix hash.  A node's weight is the number of conversations through
   it; the weight of its subtree is a plain sum over its members, so no rollup is needed
   to find centroids.
3. The tree of parent edges is split again and again at the centroid of each component, the
   deepest node whose subtree has half of the component's weight.  Its subtree's total is
   added to it and to the nodes between it and the component's top, which are prefixes of
   the centroid's conversation; the parts below it and what is left above are the next
   components.  A node and one below it are parted exactly once, so every total is whole.
   Each split halves the weight: rounds grow with its logarithm.  Components above ``local``
   are split by joins, smaller ones within a task, many at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.llm.common import spread_join, written

GROUP, HEADS = 100, 6
#: Weight up to which a component is split within a task.
LOCAL = 50_000
#: Up to so many centroids are broadcast in a round.
FEW = 10_000
#: Ids that share all but the lowest bits are joined to one text; so many at most.
ID_BITS = 10


def base_of(conv: Column) -> Column:
    return conv - conv % GROUP


def taken_over(conv: Column) -> Column:
    """Turns that a conversation takes over from its base: 0 to HEADS - 1."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("long")


def _carried(pieces: DataFrame, total: Column) -> Column:
    """The aggregate of a conversation's earlier ranges, over pieces of (conv_id, range)."""
    return total.over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))


def numbered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, range, pos (from 1), one, two (hashes of role and text), n_chars of all turns;
    and conv_id, range, before, n_own of the pieces of conversations in ranges."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("one"), F.xxhash64(text, role, F.lit("lane")).alias("two"), F.char_length(text).cast("long").alias("n_chars"))
    order = ["turn", "role", "one", "two"]
    # equal rows are dealt by a seeded number: any order of them is the same
    ranged = rows.withColumn("salt", F.rand(7)).repartitionByRange("conv_id", *order, "salt").withColumn("range", F.spark_partition_id().cast("long")).drop("salt")
    ranged = written(ranged)
    pieces = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("conv_id"))
    pieces = pieces.select("conv_id", "range", F.coalesce(_carried(pieces, F.sum("n")), F.lit(0)).alias("before"), whole.alias("n_own"))
    place = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    placed = ranged.withColumn("place", place).join(pieces, ["conv_id", "range"])
    return placed.select("conv_id", "range", (F.col("before") + F.col("place")).alias("pos"), "one", "two", "n_chars"), pieces


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node (of the prefix of so many rebuilt turns: depth and two hashes),
    up (the node one turn shorter), n_chars of the last turn and n_turns, the number of
    rebuilt turns; depth 0 has no up."""
    placed, pieces = numbered_turns(turns)
    convs = pieces.groupBy("conv_id").agg(F.max("n_own").alias("n_own")).withColumn("h", taken_over(F.col("conv_id"))).withColumn("base", base_of(F.col("conv_id")))
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n_own").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")))
    heads = placed.where((F.col("conv_id") == base_of(F.col("conv_id"))) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "one", "two", "n_chars")
    head = convs.join(heads, "base").where(F.col("depth") <= F.col("h")).select("conv_id", F.lit(-1).cast("long").alias("range"), "depth", "one", "two", "n_chars", "n_turns")
    own = placed.join(convs, "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", "range", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "one", "two", "n_chars", "n_turns")
    rows = head.unionByName(own).withColumn("a", F.xxhash64("depth", "one", "two")).withColumn("b", F.xxhash64("two", "one", "depth", F.lit("lane"))).drop("one", "two")
    rows = written(rows)
    within = Window.partitionBy("conv_id", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "range").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    sums = sums.select("conv_id", "range", *[F.coalesce(_carried(sums, F.bit_xor(c)), F.lit(0)).alias(c) for c in ("xa", "xb")])
    hashed = rows.withColumn("ka", F.bit_xor("a").over(within)).withColumn("kb", F.bit_xor("b").over(within)).join(sums, ["conv_id", "range"])
    ka, kb = F.col("ka").bitwiseXOR(F.col("xa")), F.col("kb").bitwiseXOR(F.col("xb"))
    name = lambda d, a, b: F.struct(d.cast("long").alias("d"), a.alias("a"), b.alias("b"))
    found = hashed.select("conv_id", "depth", name(F.col("depth"), ka, kb).alias("node"), name(F.col("depth") - 1, ka.bitwiseXOR(F.col("a")), kb.bitwiseXOR(F.col("b"))).alias("up"), "n_chars", "n_turns")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), name(zero, zero, zero).alias("node"), F.lit(None).cast(found.schema["up"].dataType).alias("up"), zero.alias("n_chars"), "n_turns")
    return found.unionByName(root)


def _chained_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the texts of each node, which come one after the other."""
    node, digest, out = None, None, []
    for pdf in batches:
        for key, text in zip(pdf["key"], pdf["ids"], strict=True):
            if key != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
                digest.update(text.encode())
            else:
                digest.update(b"," + text.encode())
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
            out = []
    if node is not None:
        out.append((node, digest.hexdigest()))
    yield pd.DataFrame(out, columns=["key", "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """conv_id (the node's smallest member), depth, ends_sha256 of nodes where conversations
    end.  paths: member, depth, n_turns, conv_id.  Ids are joined to texts of bounded length
    first; where a node has several of these, they stream through one digest in order."""
    ends = paths.where(F.col("depth") == F.col("n_turns")).withColumn("part", F.shiftright("member", ID_BITS))
    texts = ends.groupBy("conv_id", "depth", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda c: c.cast("string")), ",").alias("ids"))
    texts = written(texts.withColumn("key", F.concat_ws("|", "conv_id", "depth")))
    parts = texts.groupBy("key", "conv_id", "depth").agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    one = parts.where("n = 1").select("conv_id", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    many = texts.join(parts.where("n > 1").select("key"), "key").select("key", "part", "ids")
    many = many.repartition("key").sortWithinPartitions("key", "part").mapInPandas(_chained_digest, "key string, ends_sha256 string")
    key = F.split("key", "[|]")
    return one.unionByName(many.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("depth"), "ends_sha256"))


SUMS = "conv_id long, depth long, n_leaves long, saved_tokens long"


def split_component(members: list[int], parent: list[int], weight: list[int], values: list[list[int]], sums: list[list[int]]) -> None:
    """Centroid decomposition of one component: adds to ``sums`` of each node what its
    subtree in the component holds.  members: nodes, parents before children; weight: of
    subtrees, which is used up."""
    stack = [members]
    while stack:
        rows = stack.pop()
        top, c = rows[0], max((i for i, r in enumerate(rows) if 2 * weight[r] >= weight[rows[0]]), default=0)
        c = rows[c]
        part, parts, rest = {c: -1}, {}, []
        totals = [v[c] for v in values]
        for i in rows:
            over = part.get(parent[i]) if i not in (c, top) else None
            if over is not None:
                part[i] = i if over == -1 else over
                parts.setdefault(part[i], []).append(i)
                for k, v in enumerate(values):
                    totals[k] += v[i]
            elif i != c:
                rest.append(i)
        for k, total in enumerate(totals):
            sums[k][c] += total
        i = c
        while i != top:
            i = parent[i]
            weight[i] -= weight[c]
            for k, total in enumerate(totals):
                sums[k][i] += total
        stack += [rest] * bool(rest) + list(parts.values())


def _split_locally(t: pa.Table) -> pa.Table:
    t = t.sort_by([("top_conv", "ascending"), ("top_depth", "ascending"), ("depth", "ascending")])
    conv, depth, up, top_conv, top_depth, weight, *rest = (t.column(c).to_pylist() for c in ("conv_id", "depth", "parent_conv_id", "top_conv", "top_depth", "weight", "leaf", "saved", "n_leaves", "saved_tokens"))
    at = {x: i for i, x in enumerate(zip(conv, depth, strict=True))}
    parent = [at.get((p, d - 1), -1) for p, d in zip(up, depth, strict=True)]
    begin = [i for i in range(len(conv)) if not i or (top_conv[i], top_depth[i]) != (top_conv[i - 1], top_depth[i - 1])]
    for a, b in zip(begin, [*begin[1:], len(conv)], strict=True):
        split_component(list(range(a, b)), parent, weight, rest[:2], rest[2:])
    return pa.table([pa.array(x, pa.int64()) for x in (conv, depth, *rest[2:])], ["conv_id", "depth", "n_leaves", "saved_tokens"])


TOP = ["top_conv", "top_depth"]


def subtree_sums(nodes: DataFrame, ways, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: leaf and saved summed over subtrees.

    nodes: conv_id, depth, parent_conv_id, weight (of the subtree), leaf, saved of one tree;
    ways(): conv_id, depth, owner, parent_owner, the names of the nodes on the way to each
    node, asked for only if a component is larger than ``local``.
    """
    zero = F.lit(0).cast("long")
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("top_conv"))
    state = nodes.crossJoin(F.broadcast(root)).select(*nodes.columns, "top_conv", zero.alias("top_depth"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    done, way = [], None
    while True:
        state = written(state)
        large = state.groupBy(*TOP).agg(F.max("weight").alias("total")).where(F.col("total") > local)
        n = large.count()
        if not n:
            break
        way = written(ways()) if way is None else way
        heavy = _by_top(state, large, n).where(2 * F.col("weight") >= F.col("total"))
        centroids = written(heavy.groupBy(*TOP).agg(F.max_by(F.struct("conv_id", "depth", "weight"), "depth").alias("c")).select(*TOP, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")))
        small = state.join(centroids.select(*TOP), TOP, "left_anti")
        # the node after the centroid's depth on each node's way tells whether it is below
        after = way.select("conv_id", F.col("depth").alias("_at"), "owner", F.col("parent_owner"))
        seen = _by_top(state, centroids, n).withColumn("_at", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1)).join(after, ["conv_id", "_at"], "left")
        below = F.coalesce((F.col("depth") > F.col("c_depth")) & (F.col("parent_owner") == F.col("c_conv")), F.lit(False))
        itself = (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        seen = written(seen.withColumn("below", below).withColumn("itself", itself).drop("_at", "parent_owner"))
        totals = seen.where("below OR itself").groupBy(*TOP).agg(F.sum("leaf").alias("t1"), F.sum("saved").alias("t2"))
        over = way.withColumnRenamed("conv_id", "c_conv").join(centroids.join(totals, TOP), "c_conv").where((F.col("depth") < F.col("c_depth")) & (F.col("depth") >= F.col("top_depth")))
        over = over.select(F.col("owner").alias("conv_id"), "depth", "t1", "t2", F.col("c_weight").alias("less"))
        own = totals.join(centroids, TOP).select(F.col("c_conv").alias("conv_id"), F.col("c_depth").alias("depth"), "t1", "t2", zero.alias("less"))
        more = seen.join(over.unionByName(own), ["conv_id", "depth"], "left").na.fill(0, ["t1", "t2", "less"])
        more = more.withColumn("n_leaves", F.col("n_leaves") + F.col("t1")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("t2")).withColumn("weight", F.col("weight") - F.col("less"))
        more = more.withColumn("top_conv", F.when(F.col("below"), F.col("owner")).otherwise(F.col("top_conv"))).withColumn("top_depth", F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")))
        done.append(written(more.where("itself").select("conv_id", "depth", "n_leaves", "saved_tokens")))
        state = small.unionByName(more.where("NOT itself").select(state.columns))
    bins = max(1, -(-state.count() // local))
    found = state.withColumn("bin", F.pmod(F.xxhash64(*TOP), F.lit(bins))).groupBy("bin").applyInArrow(_split_locally, SUMS)
    for d in done:
        found = found.unionByName(d)
    return found


def _by_top(state: DataFrame, side: DataFrame, n: int) -> DataFrame:
    """State with the row of its component in ``side`` (n rows); a large component is dealt."""
    if n <= FEW:
        return state.join(F.broadcast(side), TOP)
    name = F.struct(*TOP).alias("top")
    joined = spread_join(state.withColumn("top", name), side.withColumn("top", name).drop(*TOP), "top", "conv_id")
    return joined.drop("top")


def conversation_trie(turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 of every node of the trie of rebuilt conversations.

    turns: conv_id, turn, role, text; further columns are dropped.  Turns are in order of
    turn (null first), then role, then a hash of the text; a null role or text is empty, and
    turns that repeat exactly stay turns of their own.  Rows without conv_id take no part.
    A conversation begins with the first ``taken_over`` turns of its base, and goes on with
    its own turns after as many.  n_leaves and saved_tokens are sums over the subtree.  An
    empty table gives no rows.
    """
    paths = written(prefixes(turns))
    weight = F.col("n_turns") - F.col("depth") + 1
    nodes = paths.groupBy("node").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(weight).alias("weight"), F.max("n_chars").alias("n_chars"), F.first("up").alias("up"))
    nodes = written(nodes)
    children = written(nodes.where(F.col("up").isNotNull()).groupBy("up").agg(F.count("*").alias("n")))
    total = nodes.count()
    named = spread_join(nodes.where(F.col("up").isNotNull()), nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id")), "up", "conv_id", children, total)
    named = named.unionByName(nodes.where(F.col("up").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long")))
    named = named.drop("up").join(children.select(F.col("up").alias("node"), F.col("n").alias("n_children")), "node", "left").na.fill(0, ["n_children"])
    saved = (F.col("n_convs") - 1) * F.col("n_chars")
    named = written(named.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "weight", (F.col("n_children") == 0).cast("long").alias("leaf"), saved.alias("saved")))
    sizes = named.select("node", F.col("n_convs").alias("n"))
    members = paths.select("node", F.col("conv_id").alias("member"), "depth", "n_turns")
    owned = spread_join(members, named.select("node", "conv_id", "parent_conv_id"), "node", "member", sizes, paths.count())
    owned = written(owned.drop("node"))
    ways = lambda: owned.select(F.col("member").alias("conv_id"), "depth", F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("parent_owner"))
    sums = subtree_sums(named.select("conv_id", "depth", "parent_conv_id", "weight", "leaf", "saved"), ways, local)
    out = named.drop("weight", "leaf", "saved", "node").join(sums, ["conv_id", "depth"]).join(end_digests(owned), ["conv_id", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS MATERIALIZED (
  SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY pos) AS l,
         xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % {HEADS} AS h
  FROM t GROUP BY conv_id
), b AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(o.l[1:c.h], []), c.l[c.h + 1:]) AS l FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % {GROUP}
), p AS MATERIALIZED (SELECT conv_id, len(l) AS n, d, l[1:d] AS s, l[d].x AS last FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM b)),
n AS MATERIALIZED (
  SELECT d, s, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(coalesce(length(last), 0)) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY d, s
), w AS MATERIALIZED (SELECT p.conv_id AS member, p.d, n.conv_id FROM p JOIN n ON n.d = p.d AND n.s = p.s),
k AS MATERIALIZED (
  SELECT n.conv_id, n.d, u.conv_id AS parent_conv_id, n.n_convs, n.ends_sha256, (n.n_convs - 1) * n.chars AS saved
  FROM n LEFT JOIN w u ON u.member = n.conv_id AND u.d = n.d - 1
), f AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM k WHERE d > 0 GROUP BY 1, 2),
g AS MATERIALIZED (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN f USING (conv_id, d)),
r AS (
  SELECT w.conv_id, w.d, sum((g.n_children = 0)::INT)::BIGINT AS n_leaves, sum(g.saved)::BIGINT AS saved_tokens
  FROM g JOIN w ON w.member = g.conv_id AND w.d <= g.d GROUP BY 1, 2
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM g JOIN r USING (conv_id, d)
"""
