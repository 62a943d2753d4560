"""Nearest neighbours: balanced posting lists with replicas, their centroids searched by a graph.

Lists that come out fuller than twice the mean are split and the vectors they held assigned again. How many
lists a query visits is not fixed: the distance ratio that prunes lists is the one at which some given
queries, compared with every vector, find nearly all of their true neighbours.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticewing.llm.common import uniform, written
from noticewing.llm.vectors import matrix, same_width, usable

#: vectors a posting list is meant to hold; vectors of the sample for each list; most lists the driver fits
#: itself, beyond which it fits cells of so many lists and tasks fit the lists of a cell
LIST, DRAWS_PER_LIST, FITTED_HERE, CELL = 256, 24, 1 << 11, 1 << 9
#: a vector goes to every list nearer than this times its nearest, up to so many (a boundary vector)
REPLICA_RATIO, REPLICAS = 1.15, 6
#: how often overfull lists are split; a list is overfull beyond this times the mean
SPLITS, OVERFULL = 4, 2.0
#: a query visits at least so many lists, and all nearer than a measured ratio times its nearest
LEAST_LISTS = 12
#: queries the ratio is measured on, share of their true neighbours it has to reach, and margin of the visits
MEASURED, SHARE, MARGIN = 128, 0.98, 1.25
#: neighbours of a centroid in the graph, places of the beam for queries and for vectors that are indexed, and
#: places beyond the lists that are wanted
DEGREE, BEAM, PLACING, SPARE = 24, 96, 32, 32
#: centroids among which the neighbours of one are looked for, the nearest cells first
AROUND = 1 << 12
#: postings and queries of a block: the unit of work; regions of lists that a table is cut into at least, if they
#: come out with so many postings
BLOCK, ASKED, REGIONS, LEAST_REGION = 1 << 16, 1 << 15, 64, 1 << 11


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def balanced_centroids(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Means of n parts of equal size: parts are halved at the median between two means, the largest first."""
    rng = np.random.default_rng(seed)
    parts = [(-len(sample), 0, np.arange(len(sample)))]
    made = 1
    while len(parts) < n:
        part = parts[0][2]
        if len(part) < 2:
            break
        x = sample[part]
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(4):
            side = x @ (b - a)
            far = side > np.median(side)
            if far.all() or not far.any():
                break
            a, b = x[~far].mean(axis=0), x[far].mean(axis=0)
        order = np.argsort(x @ (b - a), kind="stable")
        low, high = part[order[: len(x) // 2]], part[order[len(x) // 2 :]]
        heapq.heapreplace(parts, (-len(low), made, low))
        heapq.heappush(parts, (-len(high), made + 1, high))
        made += 2
    return np.stack([sample[p].mean(axis=0) for _, _, p in parts])


@dataclass
class CentroidGraph:
    """Centroids, each joined with some near ones in different directions, and cells of them where a search enters."""

    centroids: np.ndarray
    near: np.ndarray  # [n, DEGREE], -1 where there are fewer
    cells: np.ndarray  # the middle of every cell
    order: np.ndarray  # centroids by cell
    starts: np.ndarray  # of every cell in `order`, one more at the end

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidGraph:
        n = len(centroids)
        cells = balanced_centroids(centroids, int(np.ceil(np.sqrt(n))))
        cell = np.concatenate([_squared(centroids[i : i + 4096], cells).argmin(axis=1) for i in range(0, n, 4096)])
        order = np.argsort(cell, kind="stable")
        graph = cls(centroids, np.full((n, DEGREE), -1, dtype=np.int32), cells, order, np.searchsorted(cell[order], np.arange(len(cells) + 1)))
        for c in range(len(cells)):
            mine = graph.members(c)
            at = np.argsort(_squared(cells[c : c + 1], cells)[0], kind="stable")
            enough = np.searchsorted(np.cumsum(np.diff(graph.starts)[at]), AROUND) + 1
            others = np.concatenate([graph.members(i) for i in at[:enough]])
            for i in range(0, len(mine), 512):
                graph._join(mine[i : i + 512], others)
        return graph

    def members(self, cell: int) -> np.ndarray:
        return self.order[self.starts[cell] : self.starts[cell + 1]]

    def _join(self, mine: np.ndarray, others: np.ndarray) -> None:
        """Neighbours of some centroids among others."""
        d = _squared(self.centroids[mine], self.centroids[others])
        d[mine[:, None] == others[None, :]] = np.inf
        close, d = _smallest(d, 4 * DEGREE)
        y = self.centroids[others[close]]
        square = (y * y).sum(axis=2)
        among = square[:, :, None] + square[:, None, :] - 2 * y @ y.transpose(0, 2, 1)
        kept = np.zeros(d.shape, dtype=bool)
        for p in range(d.shape[1]):  # not if a kept one is nearer to it than this centroid is
            apart = ((among[:, p, :] > d[:, p, None]) | ~kept).all(axis=1)
            kept[:, p] = apart & (kept.sum(axis=1) < DEGREE // 2) & (d[:, p] < np.inf)
        chosen = np.argsort(~kept, axis=1, kind="stable")[:, :DEGREE]
        there = np.take_along_axis(d, chosen, axis=1) < np.inf
        self.near[mine, : chosen.shape[1]] = np.where(there, others[np.take_along_axis(close, chosen, axis=1)], -1)

    def search(self, x: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Near centroids of every row, nearest first, and their distances (infinite where there are fewer).

        Rows that enter at one cell walk side by side: what is among the `width` nearest of any of them is
        opened, until nothing such is left. A beam that holds a good part of the centroids sees all of them.
        """
        n = len(self.centroids)
        width = min(width, n)
        found, dist = np.zeros((len(x), width), dtype=np.int64), np.full((len(x), width), np.inf)
        if n <= max(512, 4 * width):
            for i in range(0, len(x), 256):
                found[i : i + 256], dist[i : i + 256] = _smallest(_squared(x[i : i + 256], self.centroids), width)
            return found, np.sqrt(dist)
        cell = np.concatenate([_squared(x[i : i + 1024], self.cells).argmin(axis=1) for i in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])
        by = np.argsort(cell, kind="stable")
        cuts = np.searchsorted(cell[by], np.arange(len(self.cells) + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            for i in range(cuts[c], cuts[c + 1], 64):
                rows = by[i : min(i + 64, cuts[c + 1])]
                ids, d = self._walk(x[rows], self.members(c), width)
                at, d = _smallest(d, width)
                found[rows, : at.shape[1]], dist[rows, : at.shape[1]] = ids[at], d
        return found, np.sqrt(dist)

    def _walk(self, x: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids reached from `ids` and their squared distances to every row."""
        seen = np.zeros(len(self.centroids), dtype=bool)
        seen[ids] = True
        d, opened, edge = _squared(x, self.centroids[ids]), np.zeros(len(ids), dtype=bool), np.inf
        while True:
            if len(ids) > width:  # what is in no row's beam now will not be later
                edge = np.partition(d, width - 1, axis=1)[:, width - 1 : width]
                inside = (d <= edge).any(axis=0)
                ids, d, opened = ids[inside], d[:, inside], opened[inside]
            if opened.all():
                return ids, d
            reached = np.zeros(len(seen), dtype=bool)
            new = self.near[ids[~opened]]
            reached[new[new >= 0]] = True
            new = np.flatnonzero(reached & ~seen)
            seen[new] = True
            more = _squared(x, self.centroids[new])
            inside = (more <= edge).any(axis=0)
            opened = np.concatenate((np.ones(len(ids), dtype=bool), np.zeros(int(inside.sum()), dtype=bool)))
            ids, d = np.concatenate((ids, new[inside])), np.concatenate((d, more[:, inside]), axis=1)


def _smallest(d: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the `width` smallest of every row, in order."""
    if d.shape[1] > width:
        at = np.argpartition(d, width - 1, axis=1)[:, :width]
        at = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1), axis=1)
    else:
        at = np.argsort(d, axis=1)
    return at, np.take_along_axis(d, at, axis=1)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that all vectors have length `longest` and the nearest has the largest inner product."""
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate((x, rest[:, None]), axis=1)


def _as_asked(x: np.ndarray, longest: float) -> np.ndarray:
    """Queries among lifted vectors: only directions matter, so they are brought to the common length."""
    x = x * (longest / np.sqrt((x * x).sum(axis=1)))[:, None]
    return np.concatenate((x, np.zeros((len(x), 1))), axis=1)


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))


def _placed(shared, longest: float):
    """Column function: the lists a vector is kept in, nearest first."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def lists(column: pa.Array) -> pa.Array:
        graph, x, out, n = shared.value, matrix(column), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        found, dist = graph.search(_lifted(x, longest), PLACING)
        for i in range(0, len(x), 1024):
            at, d = found[i : i + 1024, :REPLICAS], dist[i : i + 1024, :REPLICAS]
            y = graph.centroids[at]
            keep = d <= REPLICA_RATIO * d[:, :1] + 1e-9
            for p in range(1, at.shape[1]):  # a replica is of use if no list that has it lies nearer to its centroid
                apart = ((y[:, p, None, :] - y[:, :p, :]) ** 2).sum(axis=2) > d[:, p, None] ** 2
                keep[:, p] &= (apart | ~keep[:, :p]).all(axis=1)
            out.append(at[keep])
            n.append(keep.sum(axis=1))
        return pa.ListArray.from_arrays(_offsets(np.concatenate(n)), pa.array(np.concatenate(out).astype(np.int32)))

    return lists


def _among(lists: np.ndarray):
    """Column function: whether a vector is kept in one of these lists."""
    marked = np.zeros(lists.max() + 2, dtype=bool)
    marked[lists[lists >= 0]] = True

    @F.arrow_udf("boolean")
    def among(column: pa.Array) -> pa.Array:
        at = column.flatten().to_numpy()
        hit = np.append(0, np.cumsum(marked[np.minimum(at, len(marked) - 1)]))
        ends = np.append(0, np.cumsum(column.value_lengths().to_numpy()))
        return pa.array(hit[ends[1:]] > hit[ends[:-1]])

    return among


@dataclass
class Visits:
    """Which lists queries visit: up to `ratio` times the nearest distance, at most `most`."""

    ratio: float
    most: int


@dataclass
class Index:
    """What tasks need to know of the lists: their graph, how many postings they hold and their regions."""

    graph: CentroidGraph
    held: np.ndarray
    regions: np.ndarray


def _regions(graph: CentroidGraph, held: np.ndarray) -> np.ndarray:
    """A number for every list: lists that lie together share one, up to about BLOCK postings."""
    most = min(BLOCK, max(LEAST_REGION, int(held.sum()) // REGIONS))
    out = np.zeros(len(held), dtype=np.int64)
    out[graph.order] = (np.cumsum(held[graph.order]) - held[graph.order]) // most
    return np.unique(out, return_inverse=True)[1].astype(np.int32)


_VISITS = "array<struct<_region:int,_near:boolean,_lists:array<int>>>"


def _visited(shared, longest: float, visits: Visits, least: int, n: int):
    """Column function: regions a query visits and the lists in each, those of its LEAST_LISTS nearest lists apart.

    A query whose lists hold more postings than there are vectors goes to all regions and meets every vector once
    there (no lists are named then).
    """

    @F.arrow_udf(_VISITS)
    def regions(column: pa.Array) -> pa.Array:
        index, x = shared.value, matrix(column)
        order, every = np.argsort(index.regions, kind="stable"), np.arange(index.regions.max() + 1)
        place = np.empty_like(order)  # of a list among those of all regions in turn
        place[order] = np.arange(len(order))
        row, region, near, sizes, lists = [], [], [], [], []

        def add(mask: np.ndarray, i: int, close: bool) -> None:
            """The lists marked for every row, by region."""
            a, b = np.nonzero(mask)
            number = order[b]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (index.regions[number[1:]] != index.regions[number[:-1]])
            first = np.flatnonzero(new)
            row.append(i + a[first])
            region.append(index.regions[number[first]])
            near.append(np.full(len(first), close))
            sizes.append(np.diff(np.append(first, len(a))))
            lists.append(number)

        for i in range(0, len(x), 256):
            found, dist = index.graph.search(_as_asked(x[i : i + 256], longest), max(BEAM, visits.most + SPARE))
            found, dist = found[:, : visits.most], dist[:, : visits.most]
            held = np.where(dist < np.inf, index.held[found], 0)
            keep = (dist <= visits.ratio * np.maximum(dist[:, :1], 1e-12) + 1e-9) | (np.cumsum(held, axis=1) - held < least)
            keep[:, :LEAST_LISTS] = True
            keep &= dist < np.inf
            whole = np.flatnonzero(((held * keep).sum(axis=1) >= n) & (keep.sum(axis=1) > LEAST_LISTS))
            keep[whole, LEAST_LISTS:] = False
            mask = np.zeros((len(found), len(order)), dtype=bool)
            for close, part in ((True, slice(None, LEAST_LISTS)), (False, slice(LEAST_LISTS, None))):
                mask[:] = False
                a, b = np.nonzero(keep[:, part])
                mask[a, place[found[:, part][a, b]]] = True
                add(mask, i, close)
            row.append(i + np.repeat(whole, len(every)))
            region.append(np.tile(every, len(whole)))
            near.append(np.zeros(len(whole) * len(every), dtype=bool))
            sizes.append(np.full(len(whole) * len(every), -1))
        if not row:
            return pa.array([], type=_VISITS_ARROW)
        row, region, near, sizes, lists = (np.concatenate(v) for v in (row, region, near, sizes, lists))
        lists = pa.ListArray.from_arrays(_offsets(np.maximum(sizes, 0)), pa.array(lists.astype(np.int32)), mask=pa.array(sizes < 0))
        parts = pa.StructArray.from_arrays([pa.array(region.astype(np.int32)), pa.array(near), lists], ["_region", "_near", "_lists"])
        parts = parts.take(pa.array(np.argsort(row, kind="stable")))
        return pa.ListArray.from_arrays(_offsets(np.bincount(row, minlength=len(x))), parts)

    return regions


_VISITS_ARROW = pa.list_(pa.struct([("_region", pa.int32()), ("_near", pa.bool_()), ("_lists", pa.list_(pa.int32()))]))
_FOUND = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])


class _Best:
    """The k best nodes of every query so far, ties to the smaller node. `edge`: a score that its k-th best reaches at least."""

    def __init__(self, q: np.ndarray, x: np.ndarray, node: np.ndarray, k: int, longest: float, bound: np.ndarray):
        self.q, self.x, self.node, self.k = q, x, node, k
        self.scale = longest * np.sqrt((q * q).sum(axis=1))
        # Single precision with lengths up to 1 picks what is scored in double; it errs by less than `slack`.
        self.q32, self.x32 = (q * (longest / self.scale)[:, None]).astype(np.float32), (x / longest).astype(np.float32)
        self.slack = (x.shape[1] + 16) * 2.0**-23
        self.edge = bound / self.scale
        self.row, self.at, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting, self.n_waiting = [], 0

    def meet(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Compare queries with postings, of which no two are one node."""
        for j in range(0, len(cols), 4096):
            c = cols[j : j + 4096]
            y = self.x32[c]
            for i in range(0, len(rows), 512):
                r = rows[i : i + 512]
                s = self.q32[r] @ y.T
                open_ = np.flatnonzero(self.edge[r] == -np.inf)
                if len(open_) and len(c) >= self.k:
                    self.edge[r[open_]] = np.partition(s[open_], len(c) - self.k, axis=1)[:, len(c) - self.k] - self.slack
                low = (self.edge[r] - self.slack).astype(np.float64)
                some = np.flatnonzero(s.max(axis=1) >= low)
                if not len(some):
                    continue
                a, b = np.nonzero(s[some] >= low[some, None])
                a, b = r[some[a]], c[b]
                self.waiting.append((a, b, (self.q[a] * self.x[b]).sum(axis=1)))
                self.n_waiting += len(a)
                if self.n_waiting > max(1 << 14, 2 * self.k * len(self.q)):
                    self.settle()

    def settle(self) -> None:
        row, at, score = (np.concatenate(v) for v in zip((self.row, self.at, self.score), *self.waiting))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((self.node[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (self.node[at[1:]] != self.node[at[:-1]])
        row, at, score = row[new], at[new], score[new]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.edge[row[last]] = np.maximum(self.edge[row[last]], score[last] / self.scale[row[last]])
        best = place < self.k
        self.row, self.at, self.score = row[best], at[best], score[best]


def _scored(k: int, longest: float):
    """Within a block of a region's lists and queries: each query's k best of the lists it visits that reach its bound, ties to the smaller node."""

    def run(posted: pa.Table, asked: pa.Table) -> pa.Table:
        if not posted.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        number, node = posted.column("_list").to_numpy(), posted.column("_node").to_numpy()
        by = np.lexsort((node, number))
        number, node, first, x = number[by], node[by], posted.column("_first").to_numpy()[by], matrix(posted.column("_v"))[by]
        query, q, bound = asked.column("_query").to_numpy(), matrix(asked.column("_q")), asked.column("_bound").to_numpy()
        best = _Best(q, x, node, k, longest, bound)
        visits = asked.column("_lists").combine_chunks()
        lengths = visits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row, wanted = np.repeat(np.arange(len(q)), lengths), visits.flatten().to_numpy()
        by = np.argsort(wanted, kind="stable")
        row, wanted = row[by], wanted[by]
        for one in np.unique(number):
            rows = row[np.searchsorted(wanted, one) : np.searchsorted(wanted, one, side="right")]
            if len(rows):
                best.meet(rows, np.arange(np.searchsorted(number, one), np.searchsorted(number, one, side="right")))
        best.meet(np.flatnonzero(visits.is_null().to_numpy(zero_copy_only=False)), np.flatnonzero(first))
        best.settle()
        fine = best.score >= (bound - 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0))))[best.row]
        return pa.Table.from_arrays([pa.array(v[fine]) for v in (query[best.row], node[best.at], best.score)], schema=_FOUND)

    return run


def _true_nearest(own: DataFrame, nodes: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """The k best of all other rows for a few given queries: (place, node, score). One pass; k rows a query leave a task."""
    given = own.sparkSession.sparkContext.broadcast((nodes, x))

    def best(batches):
        mine, q = given.value
        score, node = np.zeros((len(q), 0)), np.zeros((len(q), 0), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column(0).to_numpy()
            s = q @ matrix(batch.column(1)).T
            s[mine[:, None] == new[None, :]] = -np.inf
            score = np.concatenate((score, s), axis=1)
            node = np.concatenate((node, np.broadcast_to(new, s.shape)), axis=1)
            if score.shape[1] > k:
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, node = np.take_along_axis(score, top, axis=1), np.take_along_axis(node, top, axis=1)
        place = np.repeat(np.arange(len(q)), score.shape[1])
        fine = score.ravel() > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(v[fine]) for v in (place, node.ravel(), score.ravel())], schema=_FOUND_AT)

    found = own.select("_node", "_v").mapInArrow(best, "place long, node long, score double")
    by = W.partitionBy("place").orderBy(F.desc("score"), "node")
    return found.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k).drop("_n")


_FOUND_AT = pa.schema([("place", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])


def _measured(own: DataFrame, posted: DataFrame, asking: DataFrame, graph: CentroidGraph, longest: float, k: int) -> Visits:
    """The visits by which MEASURED queries meet SHARE of their true neighbours' lists."""
    n = len(graph.centroids)
    drawn = own.join(asking.select("_node").distinct(), "_node", "left_semi").orderBy(uniform("_node"), "_node").limit(MEASURED)
    drawn = drawn.select("_node", "_v").toArrow()
    if n <= LEAST_LISTS or not drawn.num_rows:
        return Visits(np.inf, n)
    nodes, x = drawn.column("_node").to_numpy(), matrix(drawn.column("_v"))
    true = written(_true_nearest(own, nodes, x, k))  # MEASURED * k rows
    kept = posted.join(F.broadcast(true.select(F.col("node").alias("_node")).distinct()), "_node").select("_node", "_list").toArrow()
    lists: dict[int, list[int]] = {}
    for node, number in zip(kept.column("_node").to_pylist(), kept.column("_list").to_pylist()):
        lists.setdefault(node, []).append(number)
    dist = np.sqrt(_squared(_as_asked(x, longest), graph.centroids))
    ratio = dist / np.maximum(dist.min(axis=1), 1e-12)[:, None]
    needed = [min(ratio[place, lists[node]]) for place, node in true.select("place", "node").toArrow().to_pandas().itertuples(index=False)]
    chosen = float(np.quantile(needed, SHARE)) if needed else np.inf
    most = int((ratio <= chosen + 1e-9).sum(axis=1).max())
    return Visits(chosen, min(n, max(LEAST_LISTS, int(most * MARGIN) + 1)))


def _sizes(posted: DataFrame, n: int) -> np.ndarray:
    """Vectors in every list, collected: a number per list."""
    held = np.zeros(n, dtype=np.int64)
    for r in posted.groupBy("_list").agg(F.count(F.lit(1)).alias("_n")).collect():
        held[r[0]] = r[1]
    return held


def _sampled(own: DataFrame, n: int, wanted: int) -> DataFrame:
    """About `wanted` of n vectors, and hardly fewer: those with small key hashes, without sorting the others."""
    return own.select("_node", "_v").where(uniform("_node") < min(1.0, (wanted + 8 * wanted**0.5 + 8) / n))


def _fitted(own: DataFrame, n: int, n_lists: int, longest: float) -> np.ndarray:
    """Centroids of about n_lists lists, fitted on DRAWS_PER_LIST vectors a list; of more than FITTED_HERE in two levels."""

    def here(wanted: int, parts: int) -> np.ndarray:
        drawn = _sampled(own, n, wanted).orderBy(uniform("_node"), "_node").limit(wanted).toArrow()
        return balanced_centroids(_lifted(matrix(drawn.column("_v")), longest), parts)

    if n_lists <= FITTED_HERE:
        return here(DRAWS_PER_LIST * n_lists, n_lists)
    n_cells = -(-n_lists // CELL)
    cells = own.sparkSession.sparkContext.broadcast(here(4 * DRAWS_PER_LIST * n_cells, n_cells))

    @F.arrow_udf("int")
    def cell(column: pa.Array) -> pa.Array:
        x = _lifted(matrix(column), longest)
        out = [_squared(x[i : i + 1024], cells.value).argmin(axis=1) for i in range(0, len(x), 1024)]
        return pa.array(np.concatenate(out or [np.zeros(0, np.int64)]).astype(np.int32))

    def fit(drawn: pa.Table) -> pa.Table:
        x = _lifted(matrix(drawn.column("_v")), longest)
        return pa.table({"_c": pa.array(list(balanced_centroids(x, max(1, round(len(x) / DRAWS_PER_LIST)))))})

    drawn = _sampled(own, n, DRAWS_PER_LIST * n_lists).withColumn("_cell", cell("_v"))
    return matrix(drawn.groupBy("_cell").applyInArrow(fit, "_c array<double>").toArrow().column("_c"))


def _split(posted: DataFrame, held: np.ndarray, centroids: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Centroids with those of overfull lists replaced by several, fitted on a sample of each such list, and these lists; None if there is none.

    The first of several keeps the list's number and the others come last, so all other lists keep theirs.
    """
    mean = held.sum() / max(1, (held > 0).sum())
    over = np.nonzero(held > OVERFULL * mean)[0]
    if not len(over):
        return None
    parts = np.ceil(held[over] / mean).astype(int)
    spark = posted.sparkSession
    share = spark.createDataFrame(pa.table({"_list": over.astype(np.int32), "_share": np.minimum(1.0, DRAWS_PER_LIST * parts / held[over])}))
    drawn = posted.join(F.broadcast(share), "_list").where(uniform("_node") < F.col("_share")).select("_list", "_v").toArrow()
    number, x = drawn.column("_list").to_numpy(), _lifted(matrix(drawn.column("_v")), longest)
    out, more = centroids.copy(), []
    for i, p in zip(over, parts):
        mine = x[number == i]
        if len(mine):
            out[i], *rest = balanced_centroids(mine, int(p))
            more += rest
    return np.concatenate((out, np.stack(more))) if more else out, over


def _indexed(own: DataFrame, centroids: np.ndarray, longest: float) -> tuple[DataFrame, np.ndarray, CentroidGraph]:
    """Postings (_node, _v, _list, _first: the vector's nearest), vectors in every list and the graph of the lists.

    Every vector is placed. After a split those in an overfull list or one of its neighbours in the graph are placed again; the others stay.
    """
    spark = own.sparkSession

    def placed(rows: DataFrame) -> DataFrame:
        return written(rows.select("_node", "_v", _placed(spark.sparkContext.broadcast(graph), longest)("_v").alias("_in")))

    def posted(rows: DataFrame) -> DataFrame:
        return rows.select("_node", "_v", F.posexplode("_in").alias("_at", "_list")).select("_node", "_v", "_list", (F.col("_at") == 0).alias("_first"))

    graph = CentroidGraph.build(centroids)
    rows = placed(own)
    held = _sizes(posted(rows), len(centroids))
    for _ in range(SPLITS):
        split = _split(posted(rows), held, centroids, longest)
        if split is None:
            break
        centroids, over = split
        around = np.unique(np.append(graph.near[over], over))
        graph = CentroidGraph.build(centroids)
        moving = _among(around)("_in")
        rows = rows.where(~moving).unionByName(placed(rows.where(moving)))
        held = _sizes(posted(rows), len(centroids))
    return posted(rows), held, graph


def _compared(posted: DataFrame, index: Index, asked: DataFrame, k: int, longest: float) -> DataFrame:
    """Every query's k best of each region it visits: query, node, score. Regions and their queries are cut into blocks."""
    spark = posted.sparkSession
    popular = {r[0]: r[1] for r in asked.groupBy("_region").agg(F.count(F.lit(1))).collect()}  # a number per region
    n = np.bincount(index.regions, weights=index.held)
    parts, turns = np.ceil(n / BLOCK).astype(np.int32), np.array([-(-popular.get(i, 0) // ASKED) for i in range(len(n))], dtype=np.int32)
    of_list = pa.table({"_list": np.arange(len(index.regions), dtype=np.int32), "_region": index.regions, "_p": parts[index.regions], "_r": turns[index.regions]})
    of_region = pa.table({"_region": np.arange(len(n), dtype=np.int32), "_p": parts, "_r": turns})
    lists, regions = (F.broadcast(spark.createDataFrame(t).where("_p > 0 and _r > 0")) for t in (of_list, of_region))
    left = posted.join(lists, "_list").select(
        "_region", F.pmod(F.xxhash64("_node"), F.col("_p")).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_r") - 1)).alias("_j"),
        "_list", "_first", "_node", "_v")
    right = asked.join(regions, "_region").select(
        "_region", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_i"), F.pmod(F.xxhash64("_query"), F.col("_r")).cast("int").alias("_j"),
        "_query", "_q", "_bound", "_lists")
    by = ("_region", "_i", "_j")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_scored(k, longest), "query long, node long, score double")


def nearest(df: DataFrame, is_query, k: int = 20, *, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Each query row's k nearest other rows found, by largest inner product: query_id, rank, vec_id, score.

    `is_query` is a condition on the rows of `df`. Scores are inner products of the original vectors in
    double precision; ties go to the smaller key; rows that are equal vectors all count. Null, empty
    and zero vectors and those with null or non-finite components take no part; vectors of different
    widths do not meet. Fewer candidates than k are all returned; an empty table gives no rows. Keys
    are taken to be distinct and not null.

    The centroids are fitted on a sample of DRAWS_PER_LIST vectors per list (the smallest key hashes), one
    list for LIST vectors, and every vector is indexed. Lists fuller than OVERFULL
    times the mean are split, SPLITS times at most. A vector near a boundary is kept in several lists.
    MEASURED queries are compared with every vector; the lists all queries visit are those by which these
    meet SHARE of their true neighbours, so hard data costs more visits and not recall. A query whose visits would hold
    more postings than there are vectors meets every vector once instead. Lists that lie together are a region, to which
    a query is sent once; regions and their queries are cut into blocks, so neither a full list nor a
    popular one makes a large task. Equal vectors are one posting with its k + 1 smallest keys.
    """
    spark = df.sparkSession
    rows = same_width(df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vec}`").alias("_v"), is_query.alias("_asks")), "_v")
    single = isinstance(rows.schema["_v"].dataType.elementType, T.FloatType)  # half the bytes for the same numbers
    kind = "float" if single else "double"
    rows = rows.where(usable("_v") & F.col("_key").isNotNull()).withColumn("_v", F.transform("_v", lambda x: x.cast(kind) + F.lit(0.0).cast(kind)))
    rows = written(rows)
    # The k + 1 smallest keys of equal vectors, without gathering a group: rank in hash parts first.
    parted = W.partitionBy("_v", "_part").orderBy("_key")
    least = rows.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(64))).withColumn("_n", F.row_number().over(parted)).where(F.col("_n") <= k + 1)
    nodes = written(least.groupBy("_width", "_v").agg(F.min("_key").alias("_node"), F.slice(F.sort_array(F.collect_list("_key")), 1, k + 1).alias("_keys")))
    asking = rows.where("_asks").join(nodes.select("_v", "_width", "_node"), ["_width", "_v"]).select("_key", "_node")
    asking = written(asking)
    out = None
    for width in [r[0] for r in nodes.select("_width").distinct().collect()]:  # a handful of model widths
        own = nodes.where(F.col("_width") == width)
        norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        n, longest = own.agg(F.count(F.lit(1)), F.max(norm)).first()
        centroids = _fitted(own, n, -(-n // LIST), longest)
        posted, held, graph = _indexed(own, centroids, longest)
        visits = _measured(own, posted, asking, graph, longest, k)
        index = Index(graph, held, _regions(graph, held))
        queries = own.join(asking.select("_node").distinct(), "_node", "left_semi")
        regions = _visited(spark.sparkContext.broadcast(index), longest, visits, 4 * k, n)
        asked = written(queries.select(F.col("_node").alias("_query"), F.col("_v").alias("_q"), regions("_v").alias("_visits")))
        asked = asked.select("_query", "_q", F.inline("_visits"))
        # The nearest lists first: what is worse than a query's best k + 1 there need not leave the others.
        first = written(_compared(posted, index, asked.where("_near").withColumn("_bound", F.lit(float("-inf"))), k + 1, longest))
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "node"))
        reached = first.groupBy("query", "node").agg(F.max("score").alias("score")).withColumn("_n", place)
        reached = reached.where(F.col("_n") == k + 1).select(F.col("query").alias("_query"), F.col("score").alias("_bound"))
        others = asked.where(~F.col("_near")).join(reached, "_query", "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("-inf"))))
        found = first.unionByName(_compared(posted, index, others, k + 1, longest))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = [F.desc("score"), F.asc("node")]
    best = out.groupBy("query", "node").agg(F.max("score").alias("score"))
    best = best.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("_n") <= k + 1)
    near = best.join(nodes.select(F.col("_node").alias("node"), "_keys"), "node").select("query", "score", F.explode("_keys").alias("vec_id"))
    mine = W.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))
    near = near.withColumn("_n", F.row_number().over(mine)).where(F.col("_n") <= k + 1)  # one may be the query's own
    each = asking.join(near, asking["_node"] == near["query"]).where(F.col("vec_id") != F.col("_key"))
    rank = F.row_number().over(W.partitionBy("_key").orderBy(F.desc("score"), F.asc("vec_id"))).cast("int")
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_key").alias("query_id"), "rank", "vec_id", "score")
