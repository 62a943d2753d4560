"""Prefix trie of conversations: padded matrices of turn ids, sorted and cut into nodes by numpy, range shards recombined."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticewing.llm.common import ranges, written
from noticewing.plans.order import grouped_position

#: turns in one row of a matrix; longer conversations go on in further rows ("slabs")
WIDTH = 32
#: cells of one padded matrix
CELLS = 1 << 20
#: turn numbers that are sorted together when positions are given
TURN_RANGE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()

_KEY = ["depth", "top", "k1", "k2"]


# ---- turns -----------------------------------------------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """(`conv_id`, `pos`, `t1`, `t2`, `words`): every turn's place from 0, 128 bits of hash and number of words.

    Turns are ordered by `turn`, null first; equal turn numbers by the hash of role and text, so that
    repeated rows count as so many turns. Null role or text is empty, rows without conv_id are left
    out. Texts do not leave their task: only hashes are shuffled, and a conversation of any number of
    turns is ordered in ranges of turn numbers.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(text, F.lit(1), role).alias("t2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    bucket = F.coalesce(F.floor(F.col("turn") / TURN_RANGE), F.lit(-(1 << 62)))
    placed = grouped_position(slim, ["conv_id"], [bucket], [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")], "pos")
    return placed.select("conv_id", (F.col("pos") - 1).alias("pos"), "t1", "t2", "words")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin like the first of their group, and (`conv_id`, `n`), their numbers of turns.

    Conversation c takes the first h = crc32(c in decimal) % `most` turns of conversation c - c % `group`
    (all, if it has fewer; none, if there is none), and then its own turns after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    head = F.col("conv_id") - F.col("conv_id") % group
    asked = sizes.select("conv_id", "own", head.alias("head"), F.when(head == F.col("conv_id"), 0).otherwise(h).alias("h"))
    there = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.col("own").alias("_there"))
    convs = asked.join(there, "head", "left").select(
        "conv_id", "head", "h", F.least("h", F.coalesce("_there", F.lit(0))).alias("got"), "own")
    convs = convs.withColumn("n", F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    rest = turns.join(convs.select("conv_id", "h", "got"), "conv_id").where("pos >= h").withColumn("pos", F.expr("pos - h + got")).select(turns.columns)
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "head")
    taken = convs.where("got > 0").select("conv_id", "head", "got").join(first, "head").where("pos < got").select(turns.columns)
    return rest.unionByName(taken), convs.select("conv_id", "n")


def _rows(turns: DataFrame, convs: DataFrame, wide: int) -> DataFrame:
    """Rows of the matrices: up to `wide` turns of a conversation, with the key of the turns before them.

    A node's key is the exclusive or of hashes of (position, turn) over its turns, in 128 bits: it
    can be put together from any parts of a conversation in any order.
    """
    a, b = F.xxhash64("pos", "t1", "t2"), F.xxhash64("t2", "pos", "t1")
    cells = turns.select("conv_id", F.floor(F.col("pos") / wide).cast("int").alias("slab"), F.struct("pos", a.alias("a"), b.alias("b"), "words").alias("cell"))
    rows = cells.groupBy("conv_id", "slab").agg(
        F.sort_array(F.collect_list("cell")).alias("cells"), F.bit_xor("cell.a").alias("x1"), F.bit_xor("cell.b").alias("x2"))
    by = W.partitionBy("conv_id").orderBy("slab")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select(
        "conv_id", "slab", F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("p1"), F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("p2"),
        F.transform("cells", lambda c: F.struct(c.a.alias("a"), c.b.alias("b"))).alias("ids"), F.col("cells.words").alias("words"),
        F.lead("slab").over(by).isNotNull().alias("more"))
    none = convs.where("n = 0").select(
        "conv_id", F.lit(0).alias("slab"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"),
        F.array().cast("array<struct<a:bigint,b:bigint>>").alias("ids"), F.array().cast("array<bigint>").alias("words"), F.lit(False).alias("more"))
    return rows.unionByName(none)


# ---- nodes of one matrix ---------------------------------------------------------------------

_OUT = pa.schema([
    ("depth", pa.int64()), ("top", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()), ("edge", pa.bool_()), ("more", pa.bool_()),
    ("ptop", pa.bool_()), ("q1", pa.int64()), ("q2", pa.int64()), ("ask", pa.bool_()), ("parent_conv_id", pa.int64()),
    ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("words", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.binary()), ("first_end", pa.int64()), ("a1", pa.list_(pa.int64())), ("a2", pa.list_(pa.int64())),
])
_OUT_SQL = (
    "depth long, top boolean, k1 long, k2 long, edge boolean, more boolean, ptop boolean, q1 long, q2 long, ask boolean, parent_conv_id long, "
    "conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, ends binary, first_end long, a1 array<long>, a2 array<long>"
)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of the keys, equal for equal ones; the first key counts most."""
    by = np.lexsort(keys[::-1])
    new = np.zeros(len(by), dtype=np.int64)
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    out = np.empty(len(by), dtype=np.int64)
    out[by] = np.cumsum(new)
    return out


def _block_nodes(rows: pa.Table, wide: int) -> pa.Table:
    """Nodes of the matrix made of `rows`. Nodes that hold its first or last row ("edge") may go on in other blocks.

    An edge node counts only children and descendants that are no edge nodes themselves; `_joined` adds the others.
    """
    column = lambda name: rows.column(name).combine_chunks()
    ids, n = column("ids"), rows.num_rows
    size = np.diff(ids.offsets.to_numpy()).astype(np.int64)
    flat = ids.flatten()
    a, b = (flat.field(i).to_numpy() for i in (0, 1))
    width = int(size.max()) + 1
    slab, p1, p2, conv = (column(c).to_numpy() for c in ("slab", "p1", "p2", "conv_id"))
    cell = np.repeat(np.arange(n) * width, size) + ranges(np.ones(n, np.int64), size)

    def padded(first: np.ndarray, values: np.ndarray, fill: int) -> np.ndarray:
        out = np.full(n * width, fill, dtype=np.int64)
        out[::width], out[cell] = first, values
        return out.reshape(n, width)

    ident = padded(_dense(slab, p1, p2), _dense(a, b), -1)
    order = np.lexsort(np.vstack((conv[None, :], ident[:, ::-1].T)))
    ident, conv, size, slab = ident[order], conv[order], size[order], slab[order]
    more = column("more").to_numpy(zero_copy_only=False)[order]
    words = padded(np.zeros(n, np.int64), column("words").flatten().to_numpy(), 0)[order]
    k1 = np.bitwise_xor.accumulate(padded(p1, a, 0)[order], axis=1)
    k2 = np.bitwise_xor.accumulate(padded(p2, b, 0)[order], axis=1)
    changed = np.ones((n, width), dtype=bool)
    changed[1:] = ident[1:] != ident[:-1]
    np.logical_or.accumulate(changed, axis=1, out=changed)

    leaves, saved = column("tail_leaves").to_numpy()[order], column("tail_saved").to_numpy()[order]
    inner = np.zeros(n, dtype=np.int64)  # first rows of the nodes one turn deeper that are no edge
    parts: list[dict] = []
    for depth in range(width - 1, -1, -1):
        starts = np.flatnonzero(changed[:, depth])
        ends = np.append(starts[1:], n)
        real = ident[starts, depth] >= 0
        stops = size == depth
        goes = np.add.reduceat((stops & more).astype(np.int64), starts) > 0
        children = np.add.reduceat(inner, starts)
        edge = (starts == 0) | (ends == n)
        if depth == 0:
            edge |= slab[starts] > 0
        closed = real & ~edge
        leaves[starts] += closed & (children == 0) & ~goes
        saved[starts] += np.where(closed, (ends - starts - 1) * words[starts, depth], 0)
        sums = np.add.reduceat(leaves, starts), np.add.reduceat(saved, starts)
        inner[:] = 0
        inner[starts] = closed
        stopping = np.add.reduceat(stops.astype(np.int64), starts)
        pick = np.flatnonzero(real)
        at, is_edge = starts[pick], edge[pick]
        sha = np.where(is_edge, None, EMPTY)
        none = np.full(len(pick), None, dtype=object)
        raw, first_end, a1, a2 = none.copy(), none.copy(), none.copy(), none.copy()
        for i in np.flatnonzero(stopping[pick] > 0):
            # Rows that stop here are the node's first, by conv_id; some may go on in the next slab.
            rows_here = slice(at[i], at[i] + stopping[pick[i]])
            who = conv[rows_here][~more[rows_here]]
            if is_edge[i] and len(who):
                raw[i], first_end[i] = who.astype("<i8").tobytes(), who[0]
            elif not is_edge[i]:
                sha[i] = hashlib.sha256(",".join(map(str, who.tolist())).encode()).hexdigest()
        for i in np.flatnonzero(is_edge):
            a1[i], a2[i] = k1[at[i], :depth], k2[at[i], :depth]
        parts.append({
            "row": at, "depth": slab[at].astype(np.int64) * wide + depth, "top": (slab[at] > 0) & (depth == 0), "k1": k1[at, depth], "k2": k2[at, depth],
            "edge": is_edge, "more": goes[pick], "ptop": (slab[at] > 0) & (depth == 1), "q1": k1[at, max(depth - 1, 0)], "q2": k2[at, max(depth - 1, 0)],
            "conv_id": np.minimum.reduceat(conv, starts)[pick], "n_convs": (ends - starts)[pick], "n_children": children[pick],
            "n_leaves": sums[0][pick], "saved_tokens": sums[1][pick], "words": words[at, depth],
            "ends_sha256": sha, "ends": raw, "first_end": first_end, "a1": a1, "a2": a2,
        })
    # A node's parent is the one a turn less deep whose rows hold its first row.
    for part, above in zip(parts, [*parts[1:], None]):
        if above is None:
            part["ask"], part["parent_conv_id"] = np.zeros(len(part["row"]), bool), [None] * len(part["row"])
        else:
            of = np.searchsorted(above["row"], part["row"], side="right") - 1
            part["ask"] = above["edge"][of] & ~part["edge"]
            part["parent_conv_id"] = above["conv_id"][of]
    return pa.concat_tables([pa.Table.from_arrays([pa.array(p[f.name], type=f.type) for f in _OUT], schema=_OUT) for p in parts])


def _blocks(batches: Iterator[pa.RecordBatch], wide: int, cells: int) -> Iterator[pa.Table]:
    """A sorted partition in tables whose padded matrices have about `cells` cells at most."""
    most = max(2, cells // (wide + 1))
    held, rows = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most - rows)
            held.append(part)
            rows, at = rows + part.num_rows, at + part.num_rows
            if rows == most:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


# ---- all matrices ----------------------------------------------------------------------------


def _sharded(rows: DataFrame, wide: int, cells: int) -> DataFrame:
    """Nodes of all blocks; rows are range-partitioned by what they are sorted by, copies by their conv_id."""
    keys = ["slab", "p1", "p2", "ids", "conv_id"]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, wide, cells):
            yield from _block_nodes(block, wide).to_batches(max_chunksize=1 << 16)

    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(nodes, _OUT_SQL)


def _joined(nodes: DataFrame) -> DataFrame:
    """Edge nodes of all blocks put together: at most two paths of a row's length a block."""
    same = nodes.where("edge").groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_inner"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("words").alias("words"), F.max("more").alias("more"),
        F.max("ptop").alias("ptop"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("a1").alias("a1"), F.max("a2").alias("a2"))
    kids = same.where("size(a1) > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("ptop").alias("top"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("_kids"))
    same = same.join(kids, _KEY, "left").withColumn("n_children", F.expr("n_inner + coalesce(_kids, 0)")).drop("_kids", "n_inner")
    own_leaf = F.when((F.col("n_children") == 0) & ~F.col("more") & ~F.col("top"), 1).otherwise(0)
    own_saved = F.when(F.col("top"), 0).otherwise((F.col("n_convs") - 1) * F.col("words"))
    # Closed nodes below are in the sums of all edge nodes above them; each edge node adds itself to those in its slab.
    slab_first = F.col("depth") - F.size("a1")
    up = same.select(
        slab_first.alias("_first"), own_leaf.alias("_l"), own_saved.alias("_s"),
        F.posexplode(F.arrays_zip(F.concat("a1", F.array("k1")).alias("k1"), F.concat("a2", F.array("k2")).alias("k2"))).alias("_i", "_k"))
    up = up.select((F.col("_first") + F.col("_i")).alias("depth"), ((F.col("_first") > 0) & (F.col("_i") == 0)).alias("top"), "_k.k1", "_k.k2", "_l", "_s")
    up = up.groupBy(*_KEY).agg(F.sum("_l").alias("_l"), F.sum("_s").alias("_s"))
    return same.join(up, _KEY).withColumns({"n_leaves": F.col("n_leaves") + F.col("_l"), "saved_tokens": F.col("saved_tokens") + F.col("_s")}).drop("_l", "_s")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs of ids, which come one after the other; nothing but the hash is kept."""
    key, digest, done = None, None, []
    for batch in batches:
        for *now, raw in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ends"))):
            part = ",".join(map(str, np.frombuffer(raw, "<i8").tolist())).encode()
            if now == key:
                digest.update(b"," + part)
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(part)
    if key is not None:
        done.append((*key, digest.hexdigest()))
    types = [("depth", pa.int64()), ("top", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], type=t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])


def trie(turns: DataFrame, convs: DataFrame, wide: int = WIDTH, cells: int = CELLS) -> DataFrame:
    """Nodes of the prefix trie of `turns` (`conv_id`, `pos`, `t1`, `t2`, `words`) of the conversations `convs` (`conv_id`, `n`).

    A node is a distinct sequence of first turns, the root the empty one; its members are the
    conversations that begin with it, ones without turns belong to the root alone. Per node: conv_id
    (smallest member), depth, parent_conv_id (the parent's; root: null), n_convs, n_children, n_leaves
    (childless nodes under it, itself included), saved_tokens (sum under it of (n_convs - 1) * words of
    the last turn), ends_sha256 (of the decimal ids of conversations that end there, ascending, joined by
    commas) and node, its key. No conversations give no nodes.

    Rows of `wide` turns are range-partitioned by (turns before, turns, conv_id), so a first turn or a
    whole conversation that a third of all share is cut over many tasks; a partition is worked off in
    blocks of `cells` cells. What conversations have beyond a row is added to it as a sum (`tail_`), which one
    conversation per node stands for.
    """
    rows = written(_rows(turns, convs, wide))
    zero = F.lit(0).cast("long")
    later = rows.where("slab > 0").withColumns({"tail_leaves": zero, "tail_saved": zero})
    # What lies under the first node of each later slab, charged to its smallest member.
    tops = _joined(written(_sharded(later, wide, cells).where("edge"))).where("top").select(
        "conv_id", (F.col("depth") / wide).cast("int").alias("slab"), F.col("n_leaves").alias("_l"), F.col("saved_tokens").alias("_s"))
    after = W.partitionBy("conv_id").orderBy("slab").rowsBetween(1, W.unboundedFollowing)
    charged = rows.where("slab > 0 or more").select("conv_id", "slab").join(tops, ["conv_id", "slab"], "left")
    tails = charged.select("conv_id", "slab", F.sum("_l").over(after).alias("tail_leaves"), F.sum("_s").over(after).alias("tail_saved"))
    short = rows.where("not more").withColumns({"tail_leaves": zero, "tail_saved": zero})
    long = rows.where("more").join(tails, ["conv_id", "slab"]).withColumns({c: F.coalesce(F.col(c), zero) for c in ("tail_leaves", "tail_saved")})
    nodes = written(_sharded(short.unionByName(long), wide, cells))

    joined = written(_joined(nodes))
    runs = nodes.where("edge and ends is not null").select(*_KEY, "first_end", "ends")
    sha = runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first_end").mapInArrow(_digests, "depth long, top boolean, k1 long, k2 long, ends_sha256 string")
    whole = joined.where("not top").join(sha, _KEY, "left").withColumns({
        "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY)), "ask": F.col("depth") > 0, "parent_conv_id": F.lit(None).cast("long")})
    names = ["depth", "k1", "k2", "q1", "q2", "more", "ask", "parent_conv_id", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = nodes.where("not edge").select(names).unionByName(whole.select(names))
    # Children in the next slab, and parents that more than one block holds.
    below = joined.where("top").select("depth", "k1", "k2", F.col("n_children").alias("_below"))
    on = found.where("more").join(below, ["depth", "k1", "k2"], "left").withColumn("n_children", F.expr("n_children + coalesce(_below, 0)")).select(names)
    found = found.where("not more").unionByName(on)
    above = nodes.where("not edge and more").select(names).unionByName(whole.select(names)).select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("_above"))
    asked = found.where("ask").join(above, ["depth", "q1", "q2"]).withColumn("parent_conv_id", F.col("_above")).select(names)
    node = F.concat(*[F.lpad(F.hex(k), 16, "0") for k in ("k1", "k2")])
    return found.where("not ask").unionByName(asked).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", node.alias("node"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """`trie` of a table of turns (`conv_id`, `turn`, `role`, `text`), as `numbered` orders them."""
    turns = numbered(conversations)
    return trie(turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
