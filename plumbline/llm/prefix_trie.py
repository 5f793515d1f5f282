"""Prefix trie of conversations by ROLLUP over positional turn columns.

The turns of a conversation stand in columns t1..tw, one row a conversation. A
``ROLLUP`` over them groups the conversations by all their prefixes at once;
``grouping_id`` tells how long a prefix is. A second ``ROLLUP`` over the nodes
found sums what lies below each of them. Conversations longer than ``w`` turns
go on in a further block of columns, keyed by the node in which they left the
block before. A conversation that is alone in that node needs no grouping any
more: each of its further turns is a node of its own.

A node is named by its depth and the least conversation in it: at one depth every
conversation lies in one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ordered import numbered
from plumbline.llm.storage import stored

WIDTH = 8
BUCKET = 4096


def turn_value(role: Column, text: Column) -> Column:
    """A turn as a struct: ``id``, the MD5 of role and text, and ``chars``, the code points of the text."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.struct(F.unhex(F.md5(said.cast("binary"))).alias("id"), F.length(text).cast("long").alias("chars"))


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``pos`` (from 0), ``t`` of every row; rows of equal turn by their MD5, rows without a turn first.

    Null roles and texts count as empty; rows without a conversation id are left out.
    """
    c = lambda name: F.col(f"`{name}`")
    value = turn_value(F.coalesce(c(role), F.lit("")), F.coalesce(c(text), F.lit("")))
    turns = rows.filter(c(conv_id).isNotNull()).select(c(conv_id).alias("conv_id"), c(turn).alias("turn"), value.alias("t"))
    return numbered(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("t.id").asc()]).select("conv_id", "pos", "t")


def with_shared_heads(turns: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first ``head`` turns of conversation ``base``, then the own turns after the first ``head``.

    ``head`` and ``base`` are expressions over ``conv_id``. Returns the
    conversations (``conv_id``, ``n``) and their turns (``conv_id``, ``pos``, ``t``).
    """
    turns = stored(turns)
    lengths = stored(turns.groupBy("conv_id").agg(F.count("*").alias("len"))).withColumn("h", head).withColumn("base", base)
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    plan = lengths.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_len", F.lit(0))))
    plan = stored(plan.withColumn("n", F.col("taken") + F.greatest(F.col("len") - F.col("h"), F.lit(0))))
    heads = plan.filter("taken > 0").join(turns.withColumnRenamed("conv_id", "base"), "base").filter("pos < taken").select("conv_id", "pos", "t")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t")
    return plan.select("conv_id", "n"), stored(heads.unionByName(own))


def _columns(turns: DataFrame, convs: DataFrame, start: int, width: int) -> DataFrame:
    """``convs(conv_id, n, prior)`` with the turns from ``start`` on in columns t1..tw."""
    here = turns.filter((F.col("pos") >= start) & (F.col("pos") < start + width))
    wide = here.groupBy("conv_id").agg(*[F.max(F.when(F.col("pos") == start + i, F.col("t"))).alias(f"t{i + 1}") for i in range(width)])
    return convs.join(wide, "conv_id", "left")


def _path(width: int, upto: Column | None = None) -> Column:
    """The turns of a block in one binary: the ids of t1 to tw, or of the first ``upto``."""
    each = [F.coalesce(F.col(f"t{i + 1}.id"), F.lit(b"")) for i in range(width)]
    return F.concat(*[x if upto is None else F.when(upto > i, x).otherwise(F.lit(b"")) for i, x in enumerate(each)])


def _rollup(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """All prefixes of t1..tw under each prior node; ``level`` is the length of the prefix, ``last`` its last turn."""
    names = ", ".join(f"t{i + 1}" for i in range(width))
    found = rows.sparkSession.sql(
        f"SELECT prior, {names}, {width} - bit_count(grouping_id()) AS level, {aggregates} FROM {{rows}} GROUP BY prior, ROLLUP({names})", rows=rows
    )
    last = F.get(F.array(*[F.col(f"t{i + 1}") for i in range(width)]), F.col("level") - 1)
    return found.withColumn("last", last).filter((F.col("level") == 0) | F.col("last").isNotNull())


def _block(turns: DataFrame, convs: DataFrame, start: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one block, and where each conversation leaves it: ``conv_id``, ``n``, ``node``, ``n_convs``."""
    rows = stored(_columns(turns, convs, start, width))
    found = _rollup(rows, width, "min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest")
    found = found if start == 0 else found.filter("level > 0")
    nodes = stored(found.withColumn("path", _path(width)).withColumn("depth", start + F.col("level")))
    exits = nodes.select(F.col("prior").alias("p"), F.col("path").alias("q"), F.col("conv_id").alias("node"), "n_convs")
    left = rows.withColumn("path", _path(width)).join(exits, F.col("prior").eqNullSafe(F.col("p")) & (F.col("path") == F.col("q")))
    return nodes, stored(left.select("conv_id", "n", "node", "n_convs"))


def _summed(nodes: DataFrame, below: DataFrame | None, start: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of a block with ``n_children``, ``n_leaves``, ``saved_tokens``; and the same sums for the nodes above it.

    ``below(node, children, leaves, saved)`` is what the following blocks have under the deepest nodes of this one.
    """
    own = nodes.withColumn("leaf", (F.col("longest") == F.col("depth")).cast("long"))
    own = own.withColumn("saved", (F.col("n_convs") - 1) * F.coalesce("last.chars", F.lit(0)))
    if below is None:
        own = own.withColumn("further", F.lit(0).cast("long"))
    else:
        b = below.select(F.col("node").alias("bn"), F.col("children").alias("bc"), F.col("leaves").alias("bl"), F.col("saved").alias("bs"))
        own = own.join(b, (F.col("level") == width) & (F.col("conv_id") == F.col("bn")), "left")
        more = lambda c: F.coalesce(c, F.lit(0))
        own = own.withColumns({"leaf": F.col("leaf") + more("bl"), "saved": F.col("saved") + more("bs"), "further": more("bc")})
    counts = ", ".join(f"count_if(level = {i + 1}) AS l{i + 1}" for i in range(width))
    rows = own.withColumnRenamed("level", "length").select("prior", *[f"t{i + 1}" for i in range(width)], "length", "conv_id", "n_convs", "leaf", "saved", "further")
    found = _rollup(rows, width, counts.replace("level", "length") + (
        ", min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens, max_by(further, length) AS further"
    ))
    under = F.get(F.array(*[F.col(f"l{i + 1}") for i in range(width)], F.lit(None).cast("long")), F.col("level"))
    found = stored(found.withColumn("n_children", F.coalesce(under, "further")).withColumn("path", _path(width)).withColumn("above", _path(width, F.col("level") - 1)))
    up = found.filter("level = 0").select(F.col("prior").alias("node"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    shown = found if start == 0 else found.filter("level > 0")
    parents = shown.select(F.col("prior").alias("pp"), F.col("path").alias("pq"), F.col("conv_id").alias("parent"))
    inside = (F.col("level") > (0 if start == 0 else 1)) & F.col("prior").eqNullSafe(F.col("pp")) & (F.col("above") == F.col("pq"))
    named = shown.join(parents, inside, "left")
    parent = F.when(F.col("level") == 0, None).otherwise(F.coalesce("parent", "prior"))
    return named.select(
        "conv_id", (start + F.col("level")).cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
    ), up


_ENDS = "conv_id long, depth long, ends_sha256 string"


def _hash_in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the pieces of each node, which come sorted; only one piece is held at a time."""
    at, state = None, None
    for part in parts:
        done = []
        for node, depth, ids in zip(part["node"], part["n"], part["ids"]):
            if (node, depth) != at:
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (node, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "depth", "ends_sha256"])
    if at:
        yield pd.DataFrame([(*at, state.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])


def _ends(ended: DataFrame, bucket: int) -> DataFrame:
    """``conv_id``, ``depth``, ``ends_sha256`` of the nodes in which conversations end, ``ended(conv_id, n, node)``.

    Ids are joined in buckets of neighbouring ids; a node with several buckets is hashed piece after piece.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = stored(ended.withColumn("bucket", F.floor(F.col("conv_id") / bucket)).groupBy("node", "n", "bucket").agg(ids.alias("ids")))
    counted = pieces.groupBy("node", "n").agg(F.count("*").alias("pieces"), F.any_value("ids").alias("ids"))
    single = counted.filter("pieces = 1").select(F.col("node").alias("conv_id"), F.col("n").alias("depth"), F.sha2("ids", 256).alias("ends_sha256"))
    long = counted.filter("pieces > 1").select(F.col("node").alias("k"), F.col("n").alias("d"))
    several = pieces.join(long, (F.col("node") == F.col("k")) & (F.col("n") == F.col("d")), "left_semi")
    hashed = several.repartition("node", "n").sortWithinPartitions("node", "n", "bucket").select("node", "n", "ids").mapInPandas(_hash_in_order, _ENDS)
    return single.unionByName(hashed)


def prefix_trie(convs: DataFrame, turns: DataFrame, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """One row per distinct prefix of the conversations, the root (depth 0) included.

    ``convs(conv_id, n)`` are all conversations with their number of turns, 0
    allowed; ``turns(conv_id, pos, t)`` their turns as of ``ordered_turns``. Ids
    are integers, not null. Columns: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs`` (members), ``n_children``,
    ``n_leaves`` (childless nodes in the subtree, itself included),
    ``saved_tokens`` (over the subtree, members but one times code points of the
    last text), ``ends_sha256`` (of the ids ending here, ascending, joined by
    commas). Without conversations there is no row. Repeated turns are turns of
    their own, and conversations may have any number of turns of any length.
    """
    turns, convs = stored(turns), stored(convs)
    now = convs.withColumn("prior", F.lit(None).cast("long"))
    blocks, ends, tails, start = [], [], [], 0
    while not now.isEmpty():
        nodes, left = _block(turns, now, start, width)
        blocks.append((start, nodes))
        ends.append(left.filter(F.col("n") <= start + width).select("conv_id", "n", "node"))
        start += width
        onward = left.filter(F.col("n") > start)
        tails.append(onward.filter("n_convs = 1").select("conv_id", "n", F.lit(start).cast("long").alias("after")))
        now = stored(onward.filter("n_convs > 1").select("conv_id", "n", F.col("node").alias("prior")))
    if not blocks:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    below, out = None, []
    for (start, nodes), tail in zip(reversed(blocks), reversed(tails)):
        one = F.lit(1).cast("long")
        alone = tail.select(F.col("conv_id").alias("node"), one.alias("children"), one.alias("leaves"), F.lit(0).cast("long").alias("saved"))
        named, below = _summed(nodes, alone if below is None else alone.unionByName(below), start, width)
        below = stored(below)
        out.append(named)
        zero = F.lit(0).cast("long")
        chain = turns.join(tail, "conv_id").filter(F.col("pos") >= F.col("after")).select(
            "conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
            F.when(F.col("pos") + 1 < F.col("n"), one).otherwise(zero).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        )
        out.append(chain)
        ends.append(tail.select("conv_id", "n", F.col("conv_id").alias("node")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    ended = _ends(union(ends), bucket)
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return union(out).join(ended, ["conv_id", "depth"], "left").select(*columns, digest)
