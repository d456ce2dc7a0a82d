"""Conversation prefix trie, rolled up by centroid decomposition.

Every conversation is rebuilt, its turns are numbered, and each prefix gets a
key from sums of hashes, so neither numbering nor keys need a conversation in
one task. The distinct prefixes are the nodes of a tree, each with an edge to
the prefix one turn shorter.

Totals over subtrees come from a centroid decomposition of that forest of edges.
A component's centroid is the lowest node that holds half of its weight or more
(the weight of a node: the conversations through it; what lies at or below a
node is known from their lengths). What lies at or below the centroid is
totalled and added to every node on the path from the centroid to the
component's top; then the centroid goes, and its children's parts and the part
above it are components of half the weight at most. Large components are split
by joins, all at once, one round a level; those of up to ``SMALL`` nodes are
split to the end in the task that holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._common import join_spread, staged

#: Nodes of a component that one task splits to the end.
SMALL = 4096
#: Turns whose hashes are summed in one group, and ids that one row lists.
STRETCH = 4096
LISTED = 50_000

#: Fixed values of the contract: turns are taken over from the first conversation of five, up to eight of them.
FAMILY, SHARED = 5, 9


def numbered(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``df`` (a table that gives the same rows each time) and the place, from 1, of each row among those of its ``key``: a key's rows may lie in many partitions, each of which counts its own."""
    ranged = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    rows = staged(ranged.drop("text", "role", "turn").withColumn("seq", F.monotonically_increasing_id())).withColumn("part", F.shiftright("seq", 33))
    runs = rows.groupBy(key, "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    return rows.join(runs, [key, "part"]).withColumn(name, F.col("seq") - F.col("first") + F.col("before") + 1).drop("seq", "part", "first", "before")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 0, a row without a turn), digest, bytes and len (its number of turns) of every rebuilt conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = turns.filter("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    own = staged(numbered(whole, "conv_id", [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], "pos"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED
    convs = convs.withColumn("h", shared).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = staged(convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    heads = own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED)).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    first = convs.join(heads, "base").filter(F.col("pos") <= F.col("taken")).select("conv_id", F.col("pos").alias("depth"), "digest", "bytes", "len")
    rest = own.join(convs.select("conv_id", "h", "taken", "len"), "conv_id").filter(F.col("pos") > F.col("h")).select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "bytes", "len")
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes"), "len")
    return top.unionByName(first).unionByName(rest)


def prefixes(rows: DataFrame) -> DataFrame:
    """The keys of each prefix (``node``) and of the prefix one turn shorter (``parent``, none for the root): from sums of two hashes of depth and digest, taken stretch by stretch."""
    hashes = [F.xxhash64("depth", "digest").cast("decimal(38,0)"), F.xxhash64("digest", "depth", F.lit("second")).cast("decimal(38,0)")]
    rows = rows.withColumn("stretch", F.floor(F.col("depth") / STRETCH)).withColumn("a", hashes[0]).withColumn("b", hashes[1])
    along = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "stretch").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = sums.select("conv_id", "stretch", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("decimal(38,0)").alias(f"{c}_before") for c in "ab"]).filter("stretch > 0")
    rows = rows.select("*", *[F.sum(c).over(along).cast("decimal(38,0)").alias(f"{c}_sum") for c in "ab"]).join(sums, ["conv_id", "stretch"], "left")
    a, b = (F.col(f"{c}_sum") + F.coalesce(f"{c}_before", F.lit(0)) for c in "ab")

    def key(depth, a, b):
        return F.unhex(F.md5(F.concat_ws(":", depth, a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))))

    parent = F.when(F.col("depth") > 0, key(F.col("depth") - 1, a - F.col("a"), b - F.col("b")))
    return rows.select("conv_id", "depth", key(F.col("depth"), a, b).alias("node"), parent.alias("parent"), "bytes", "len")


def ends(rows: DataFrame, listed: int = LISTED) -> DataFrame:
    """node and ends_sha256, of the ids of the conversations that end there: listed in pieces, in order, wherever they lie; a hash then reads a node's pieces one after the other."""
    last = rows.filter("depth = len").select("node", "conv_id")
    ranged = last.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").withColumn("piece", F.floor(F.monotonically_increasing_id() / listed))
    pieces = ranged.groupBy("node", "piece").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(run, "node binary, ends_sha256 string")


def split(parent: list[int], weight: list[int], values: np.ndarray) -> np.ndarray:
    """Totals of ``values`` (a row for each node), with weights of 1 at least, over subtrees of one tree: parents are listed before their children, -1 is the top's."""
    totals, below = np.zeros_like(values), weight[:]
    for v in range(len(parent) - 1, 0, -1):
        below[parent[v]] += below[v]
    todo = [list(range(len(parent)))]
    while todo:
        nodes = todo.pop()
        whole = below[nodes[0]]
        centroid = min((v for v in nodes if 2 * below[v] >= whole), key=below.__getitem__)
        part_of = {centroid: centroid}
        parts: dict[int, list[int]] = {}
        above = []
        for v in nodes:
            if v == centroid:
                continue
            part = part_of.get(parent[v])
            if part is None:
                above.append(v)
                continue
            part_of[v] = v if part == centroid else part
            parts.setdefault(part_of[v], []).append(v)
        total = values[list(part_of)].sum(axis=0)
        totals[centroid] += total
        left, v = set(above), parent[centroid]
        while v in left:
            totals[v] += total
            below[v] -= below[centroid]
            v = parent[v]
        todo += parts.values()
        if above:
            todo.append(above)
    return totals


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits the components of a task, sorted by component and depth, to the end, and adds what they total."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        out = np.array([r[6:8] for r in rows], np.int64)
        start = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i][0] == rows[start][0]:
                continue
            some = rows[start:i]
            at = {r[1]: k for k, r in enumerate(some)}
            out[start:i] += split([at.get(r[2], -1) for r in some], [r[3] for r in some], np.array([r[4:6] for r in some], np.int64))
            start = i
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["node", "n_leaves", "saved_tokens"])

    held: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        cut = len(rows)
        while cut and rows[cut - 1][0] == rows[-1][0]:  # the last component may go on
            cut -= 1
        if not rows:
            continue
        if held and (cut or held[-1][0] != rows[-1][0]):
            yield done([*held, *rows[:cut]])
            held = []
        elif cut:
            yield done(rows[:cut])
        held += rows[cut:]
    if held:
        yield done(held)


def rolled_up(nodes: DataFrame, rows: DataFrame, small: int = SMALL) -> DataFrame:
    """node, n_leaves and saved_tokens: ``leaf`` and ``saved`` of ``nodes``, summed over subtrees.

    ``nodes``: node, parent, depth, conv_id (of one conversation through it),
    weight and sub (the weight at and below it); ``rows``: conv_id, depth, node
    and parent of every prefix of every conversation. Written tables, both.
    """
    columns = ["comp", "node", "parent", "depth", "conv_id", "weight", "sub", "leaf", "saved", "n_leaves", "saved_tokens"]
    zero = F.lit(0).cast("long")
    now = nodes.select(F.lit(b"").alias("comp"), *columns[1:9], zero.alias("n_leaves"), zero.alias("saved_tokens"))
    path = rows.select(F.col("conv_id").alias("of"), F.col("depth").alias("at"), F.col("node").alias("on"), F.col("parent").alias("on_parent"))
    ready, settled = [], []
    while True:
        sizes = now.groupBy("comp").agg(F.count("*").alias("n"), F.max("sub").alias("whole"), F.min("depth").alias("from_depth"))
        sizes = staged(sizes.withColumn("n_nodes", F.col("n")).withColumn("large", F.col("n") > small))
        sized = staged(join_spread(now, sizes, ["comp"], "n", now.count()))
        ready.append(sized.filter("not large").select(columns))
        large = sized.filter("large")
        if not (total := large.count()):
            break
        half = large.filter(F.col("sub") * 2 >= F.col("whole")).groupBy("comp", "n_nodes", "from_depth")
        centroids = half.agg(F.min_by(F.struct("node", "conv_id", "depth", "sub"), "sub").alias("c"))
        centroids = staged(centroids.select("comp", "n_nodes", "from_depth", *[F.col(f"c.{c}").alias(f"c_{c}") for c in ("node", "conv_id", "depth", "sub")]))
        # the ancestor one below the centroid's depth tells whether a node lies below the centroid, and in which part
        met = join_spread(large.select(columns), centroids.drop("from_depth"), ["comp"], "n_nodes", total)
        met = met.join(path, (F.col("of") == F.col("conv_id")) & (F.col("at") == F.col("c_depth") + 1) & (F.col("at") <= F.col("depth")), "left")
        is_it, is_below = F.col("node") == F.col("c_node"), F.coalesce(F.col("on_parent") == F.col("c_node"), F.lit(False))
        marked = staged(met.select(*columns, "c_depth", F.col("on").alias("part"), is_it.alias("it"), is_below.alias("below")))
        sums = marked.filter("it or below").groupBy("comp").agg(F.sum("leaf").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        paths = centroids.join(sums, "comp").join(path, (F.col("of") == F.col("c_conv_id")) & F.col("at").between(F.col("from_depth"), F.col("c_depth")))
        paths = paths.select(F.col("on").alias("node"), "more_leaves", "more_saved", F.when(F.col("on") != F.col("c_node"), F.col("c_sub")).alias("less"))
        new = marked.join(paths, "node", "left")
        added = {c: F.col(c) + F.coalesce(m, zero) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))}
        new = staged(new.withColumns(added | {"sub": F.col("sub") - F.coalesce("less", zero), "comp": F.when(F.col("below"), F.col("part")).otherwise(F.col("comp"))}).select(*columns, "it"))
        settled.append(new.filter("it").select("node", "n_leaves", "saved_tokens"))
        now = new.filter("not it").select(columns)
    last = ready[0]
    for more in ready[1:]:
        last = last.unionByName(more)
    out = last.select("comp", "node", "parent", "weight", "leaf", "saved", "n_leaves", "saved_tokens", "depth").repartition("comp").sortWithinPartitions("comp", "depth").mapInArrow(_small, "node binary, n_leaves long, saved_tokens long")
    for more in settled:
        out = out.unionByName(more)
    return out


def trie(turns: DataFrame, small: int = SMALL) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (conv_id, turn, role, text), a row each.

    conv_id (the smallest of its conversations), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. Turns of a conversation
    go by turn (null first), role and text; repeated rows are turns like any
    other; a null role or text is empty; rows without a conv_id are left out;
    other columns are ignored; an empty table gives no rows.
    """
    rows = staged(prefixes(rebuilt(turns.select("conv_id", "turn", "role", "text"))))
    found = rows.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("weight"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("sub"),
        F.max("bytes").alias("bytes"),
    )
    found = staged(found)
    children = found.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = found.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = staged(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("weight") - 1) * F.col("bytes")))
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = nodes.filter("parent is not null")
    edges = join_spread(below.select("node", "parent"), parents, ["parent"], "n_children", below.count()).select("node", "parent_conv_id")
    out = nodes.join(rolled_up(nodes, rows, small), "node").join(edges, "node", "left").join(ends(rows), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", F.col("weight").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
