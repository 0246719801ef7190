"""Conversation prefix trie, rolled up by centroid decomposition.

A turn becomes a digest of its role and text, a prefix the exclusive or of its turns' hashes, each
salted with its place: 128 bits, which tell prefixes of one length apart. A node is a depth and such
a key. Its parent's key is its own without its last turn, and the nodes of one conversation are the
path from the root to its end, so ancestors are found by joins on (conversation, depth).

Subtree sums follow the centroid decomposition of the parent edges. A component's centroid is its
lightest node that still holds half of its turns below it. The total of the centroid's part goes to
the centroid and to all nodes between it and the component's top; then the centroid goes, and the
parts below its children and the rest are components on their own, none with more than half of the
turns. Components of more than ``local_nodes`` nodes are split by joins, one table a round; smaller
ones are dealt to tasks, which go through the same rounds in arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialize

#: A node: depth and the two halves of its prefix's key; the root's are 0.
KEY = ["depth", "x1", "x2"]
_COMP = ["cd", "c1", "c2"]
#: Turns of a conversation that one window runs over, and conversation ids in one piece of an ends list.
BLOCK = 4096


def positions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with ``pos``, the place from 1 within their key in the given order (nulls first).

    Rows are dealt to range partitions and numbered within each; a key that goes on in later ones, at most one
    for each partition, is shifted by its rows before. So no task holds more than its range of a long key.
    """
    dealt = materialize(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.sum("_n").over(before)).where("_shift is not null").drop("_n")
    within = Window.partitionBy("_range", key).orderBy(*order)
    placed = dealt.withColumn("pos", F.row_number().over(within)).join(F.broadcast(shift), [key, "_range"], "left")
    return placed.withColumn("pos", F.col("pos") + F.coalesce("_shift", F.lit(0))).drop("_range", "_shift")


def _turn_columns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text).cast("binary")))
    return conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars")).where("conv_id is not null")


def rebuild(conversations: DataFrame, family: int = 100, most: int = 6, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, len, digest, n_chars) of the rebuilt conversations, and (conv_id, len) of all of them.

    Conversation c begins with the first h turns of conversation c - c % family, as far as there are any, and goes on
    with its own after its first h; h = crc32(c as text) % most. Turns are ordered by ``turn``, null first, equal
    ones by their digest; null roles and texts are empty. Rows without a conv_id belong to no conversation and are
    left out; repeated rows are turns of their own. Only digests and lengths leave the scan, never texts.
    """
    rows = _turn_columns(conversations, conv_col, turn_col, role_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    placed = materialize(positions(rows, "conv_id", ["turn", "digest", "_row"]).select("conv_id", "pos", "digest", "n_chars"), "turns")
    info = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    info = info.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    bases = info.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    info = info.join(bases, "base", "left").withColumn("took", F.least("h", F.coalesce("n_base", F.lit(0))))
    info = materialize(info.select("conv_id", "base", "h", "took", (F.col("took") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("len")), "conversations")
    own = placed.join(info, "conv_id").where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("took"))
    heads = placed.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    begun = info.where("took > 0").join(heads, "base").where("pos <= took").withColumn("depth", F.col("pos"))
    cols = ["conv_id", F.col("depth").cast("long").alias("depth"), "len", "digest", "n_chars"]
    return own.select(*cols).unionByName(begun.select(*cols)), info.select("conv_id", "len")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, len, n_chars, x1, x2, p1, p2): the node at each depth of each conversation and its parent's key.

    Running hashes go over blocks of turns, whose own hashes are then added up, so a long conversation isn't one window.
    """
    hashed = turns.withColumn("t1", F.xxhash64("digest", "depth")).withColumn("t2", F.xxhash64(F.lit(2), "depth", "digest"))
    hashed = hashed.withColumn("_block", F.floor((F.col("depth") - 1) / BLOCK).cast("long"))
    w = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.where(F.col("len") > BLOCK).groupBy("conv_id", "_block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    blocks = blocks.select("conv_id", "_block", F.bit_xor("b1").over(before).alias("b1"), F.bit_xor("b2").over(before).alias("b2"))
    run = hashed.withColumn("x1", F.bit_xor("t1").over(w)).withColumn("x2", F.bit_xor("t2").over(w)).join(blocks, ["conv_id", "_block"], "left")
    for i in "12":
        run = run.withColumn(f"x{i}", F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0).cast("long"))))
    return run.select("conv_id", "depth", "len", "n_chars", "x1", "x2", F.col("x1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("t2")).alias("p2"))


def trie_nodes(path: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node, the root included if there is any conversation.

    KEY, conv_id (smallest member), p1, p2, n_convs, n_chars (of the last text), _w (turns at and below it, each
    conversation's counted), parent_conv_id, n_children.
    """
    below = F.sum(F.col("len") - F.col("depth") + 1).alias("_w")
    nodes = path.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), below)
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("len") + 1).alias("_w")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", zero.alias("n_chars"), none.alias("p1"), none.alias("p2"), "_w")
    nodes = materialize(nodes.unionByName(root), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    kids = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    named = nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return named.join(parents, ["depth", "p1", "p2"], "left")


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & (F.col(x) == F.col(y))
    return out


def solve(top: np.ndarray, parent: np.ndarray, w: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of the values (nodes x columns) in a forest: the same rounds for all components at once.

    ``top`` numbers the components, ``parent`` is a node's place or -1 at a top, ``w`` the weight at and below a node.
    """
    comp, parent, w, acc = top.copy(), parent.copy(), w.copy(), np.zeros_like(values)
    alive = np.arange(len(w))
    while len(alive):
        _, c = np.unique(comp[alive], return_inverse=True)
        total = np.zeros(c.max() + 1, np.int64)
        np.maximum.at(total, c, w[alive])
        heavy = np.flatnonzero(2 * w[alive] >= total[c])
        heavy = heavy[np.lexsort((w[alive[heavy]], c[heavy]))]
        centroid = alive[heavy[np.concatenate([[True], c[heavy][1:] != c[heavy][:-1]])]]
        is_centroid = np.zeros(len(w), bool)
        is_centroid[centroid] = True
        # each node's highest node within its new component: below a centroid's child, or below the old top
        up = np.where(is_centroid | (parent < 0) | is_centroid[parent], np.arange(len(w)), parent)
        end = up[alive]
        while True:
            further = up[end]
            if (further == end).all():
                break
            up[alive] = end = further
        under = is_centroid[alive] | ((parent[end] >= 0) & is_centroid[parent[end]])
        sums = np.zeros((len(total), values.shape[1]), values.dtype)
        np.add.at(sums, c[under], values[alive[under]])
        acc[centroid] += sums
        at, which, lost = parent[centroid], np.arange(len(centroid)), w[centroid]
        while (on := at >= 0).any():
            at, which = at[on], which[on]
            acc[at] += sums[which]
            w[at] -= lost[which]
            at = parent[at]
        comp[alive] = end
        cut = alive[(parent[alive] >= 0) & is_centroid[parent[alive]]]
        parent[cut] = -1
        alive = alive[~is_centroid[alive]]
    return acc


def centroid_rollup(nodes: DataFrame, path: DataFrame, values: list[str], local_nodes: int = 50_000) -> DataFrame:
    """nodes with each of the long columns ``values`` replaced by its sum over the node's subtree.

    nodes needs KEY, p1, p2, conv_id (a conversation through the node) and _w; path the keys of all conversations.
    Rounds of joins split the components of more than ``local_nodes`` nodes; a round halves their turns at least.
    """
    acc = [f"_a{i}" for i in range(len(values))]
    state = nodes.withColumns({a: F.lit(0).cast("long") for a in acc} | {c: F.lit(0).cast("long") for c in _COMP})
    keys = path.select("conv_id", F.col("depth").alias("_kd"), F.col("x1").alias("k1"), F.col("x2").alias("k2"), F.col("p1").alias("kp1"), F.col("p2").alias("kp2"))
    columns, small, done = state.columns, [], []
    state = materialize(state, "components")
    while True:
        big = materialize(state.groupBy(*_COMP).agg(F.count(F.lit(1)).alias("_n"), F.max("_w").alias("_total")).where(F.col("_n") > local_nodes), "large")
        if big.isEmpty():
            small.append(state)
            break
        small.append(state.join(big, _COMP, "left_anti"))
        # the lightest node with half of the turns: such nodes are a chain, so there is one
        centre = state.join(big, _COMP).where(2 * F.col("_w") >= F.col("_total")).groupBy(*_COMP).agg(F.min_by(F.struct("conv_id", *KEY), "_w").alias("m"), F.min("_w").alias("_cw"))
        centre = materialize(centre.select(*_COMP, F.col("m.conv_id").alias("_mc"), F.col("m.depth").alias("md"), F.col("m.x1").alias("m1"), F.col("m.x2").alias("m2"), "_cw"), "centroids")
        line = centre.join(path.select(F.col("conv_id").alias("_mc"), *KEY), "_mc").where("depth < md and depth >= cd").select(*KEY, F.lit(True).alias("_up"))
        placed = state.join(centre, _COMP).withColumn("_kd", F.col("md") + 1).join(keys, ["conv_id", "_kd"], "left").join(line, KEY, "left")
        is_centre = _same(KEY, ["md", "m1", "m2"])
        under = is_centre | F.coalesce((F.col("depth") > F.col("md")) & _same(["kp1", "kp2"], ["m1", "m2"]), F.lit(False))
        above = F.coalesce("_up", (F.col("depth") == 0) & (F.col("md") > 0))
        placed = materialize(placed.select(*columns, *[F.when(under & ~is_centre, F.col(k)).otherwise(F.col(c)).alias(f"_{c}") for k, c in zip(("_kd", "k1", "k2"), _COMP, strict=True)], "_cw", is_centre.alias("_centre"), under.alias("_under"), above.alias("_above")), "split")
        sums = placed.where("_under").groupBy(*_COMP).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
        gains = F.col("_above") | F.col("_centre")
        grown = placed.join(sums, _COMP).withColumns({a: F.col(a) + F.when(gains, F.col(f"_t{i}")).otherwise(0) for i, a in enumerate(acc)})
        grown = grown.withColumn("_w", F.col("_w") - F.when(F.col("_above"), F.col("_cw")).otherwise(0))
        state = materialize(grown.select(*[F.col(f"_{c}").alias(c) if c in _COMP else F.col(c) for c in columns], "_centre"), "components")
        done.append(state.where("_centre").select(*columns))
        state = state.where("not _centre").select(*columns)
    rest = small[0].select(*columns)
    for s in small[1:]:
        rest = rest.unionByName(s.select(*columns))

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            col = {c: table[c].to_numpy() for c in (*_COMP, *KEY, "_w")}
            p1, p2 = (table[c].fill_null(0).to_numpy() for c in ("p1", "p2"))
            place = {k: i for i, k in enumerate(zip(*(col[c].tolist() for c in KEY), strict=True))}
            edge = np.ones(len(p1), np.int64)
            for a, b in zip(_COMP, KEY, strict=True):
                edge &= col[a] == col[b]
            parent = np.array([-1 if t else place[k] for t, k in zip(edge.tolist(), zip((col["depth"] - 1).tolist(), p1.tolist(), p2.tolist(), strict=True), strict=True)], np.int64)
            _, top = np.unique(np.stack([col[c] for c in _COMP], 1), axis=0, return_inverse=True)
            got = solve(top.ravel(), parent, col["_w"], np.stack([table[v].to_numpy() for v in values], 1))
            for i, a in enumerate(acc):
                table = table.set_column(table.schema.get_field_index(a), a, pa.array(table[a].to_numpy() + got[:, i]))
            yield from table.to_batches()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 20_000:
                table = pa.Table.from_batches(held).combine_chunks()
                last = np.ones(table.num_rows, bool)
                for c in _COMP:
                    last &= table[c].to_numpy() == table[c][-1].as_py()
                cut = int(np.flatnonzero(last)[0])  # the last component may go on in the next batch
                if cut:
                    yield from flush(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).to_batches()
        if held and sum(x.num_rows for x in held):
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    schema = rest.schema
    out = rest.repartition(*_COMP).sortWithinPartitions(*_COMP).mapInArrow(rounds, schema)
    for d in done:
        out = out.unionByName(d)
    return out.drop(*values, *_COMP).withColumnsRenamed(dict(zip(acc, values, strict=True)))


def ends_digests(path: DataFrame, conversations: DataFrame) -> DataFrame:
    """(KEY, ends_sha256): SHA-256 of the ascending, comma-joined ids of the conversations that end at each node.

    Ids are sorted by range partitions and joined there into pieces; a node's pieces, however many, stream through
    one hash in order, so memory doesn't follow the number of ids.
    """
    zero = F.lit(0).cast("long")
    ended = path.where("depth = len").select(*KEY, "conv_id").unionByName(conversations.where("len = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id"))
    kind = "depth long, x1 long, x2 long, first long, ids string"

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b[c].to_numpy() for c in (*KEY, "conv_id")]
            if not b.num_rows:
                continue
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)])
            new[::BLOCK] = True
            at = np.flatnonzero(new)
            ids = cols[3].tolist()
            text = [",".join(map(str, ids[a:z])) for a, z in zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in cols], pa.array(text)], ["depth", "x1", "x2", "first", "ids"])

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*(b[c].to_pylist() for c in (*KEY, "ids")), strict=True):
                if k != key:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*KEY, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, h.hexdigest())], [*KEY, "ends_sha256"])

    pieces = ended.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(join_ids, kind)
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hash_pieces, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 100, most: int = 6, local_nodes: int = 50_000, **columns: str) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (for each node of
    the subtree its members but one, times the code points of its last text), ends_sha256, and the node's key x1, x2.
    What null ids, null turns, ties and repeated rows mean is said at ``rebuild``. No conversation: no row. Columns
    that aren't named aren't read.
    """
    turns, known = rebuild(conversations, family, most, **columns)
    known = materialize(known, "known")
    path = materialize(paths(turns), "paths")
    nodes = trie_nodes(path, known)
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_chars"))
    rolled = centroid_rollup(nodes, path, ["n_leaves", "saved_tokens"], local_nodes)
    out = rolled.join(ends_digests(path, known), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "x1", "x2")


def shared_prefixes(trie: DataFrame, least: int = 2) -> DataFrame:
    """The longest prefixes that at least ``least`` conversations share, those whose children all have fewer: what a cache of prefixes would hold."""
    held = trie.where(F.col("n_convs") >= least)
    inner = held.where("depth > 0").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).distinct()
    return held.join(inner, ["conv_id", "depth"], "left_anti")
