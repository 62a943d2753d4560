"""Multinomial logistic regression on TF-IDF: sparse rows in Arrow blocks, all models' gradients in one pass, own L-BFGS."""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import text as tx
from noticewing.models import tfidf
from noticewing.plans import storage

LEVELS = domain.LEVELS
#: partial gradients a task adds up before they reach the driver
FAN_IN = 16
#: corrections L-BFGS remembers
MEMORY = 10
#: known terms of rows in a block
BLOCK = 1 << 14
_PACKED = ("y", "fold", "size", "terms", "edge", "term", "tf", "row_by_term", "tf_by_term", "length")


@dataclass
class Problem:
    """One model to fit: its vocabulary as places in the shared term list, and what rows count."""

    place: np.ndarray  # of each of its terms in the shared list
    idf: np.ndarray
    weight: np.ndarray  # class weights, 0 for a level without rows
    rows: float  # sum of the weights
    left_out: int = -1  # fold its rows come not from

    def shared_idf(self, n_terms: int) -> np.ndarray:
        out = np.zeros(n_terms)
        out[self.place] = self.idf
        return out


def encoded(df: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """`df` with `terms` (places of its known terms in the list) and `tf` instead of the text (or its WORDS); no shuffle."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    words = F.col(text) if text == tfidf.WORDS else tfidf.words_of(F.col(text))
    known = df.select(*rest, words.alias(tfidf.WORDS)).withColumn("_e", tfidf.placed(tfidf.WORDS, terms, df.sparkSession))
    return known.select(*rest, "_e.terms", "_e.tf")


class Block:
    """Rows of an encoded batch as one sparse matrix."""

    def __init__(self, batch: pa.RecordBatch):
        terms = batch.column("terms")
        self.n = batch.num_rows
        self.row = np.repeat(np.arange(self.n), np.diff(terms.offsets.to_numpy()))
        self.term = terms.flatten().to_numpy().astype(np.int64)
        self.log_tf = 1.0 + np.log(batch.column("tf").flatten().to_numpy())

    def weights(self, idf: np.ndarray) -> np.ndarray:
        """TF-IDF of every entry, unit length by row."""
        w = self.log_tf * idf[self.term]
        length = np.sqrt(np.bincount(self.row, weights=w * w, minlength=self.n))
        return w / np.where(length > 0, length, 1.0)[self.row]

    def margins(self, w: np.ndarray, coefficients: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, weights=w * b[self.term], minlength=self.n) for b in coefficients], axis=1) + intercepts


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _least(top: int) -> type:
    """The narrowest unsigned type that holds numbers up to `top`."""
    return np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32


def _numbers(held: pa.BinaryScalar, n: int) -> np.ndarray:
    """n packed numbers of the type their bytes tell."""
    return np.frombuffer(held.as_buffer(), dtype=f"u{len(held.as_buffer()) // n}") if n else np.zeros(0, np.uint8)


def packed(rows: DataFrame, problems: list[Problem], n_terms: int) -> DataFrame:
    """Encoded rows in blocks of some BLOCK entries, one row a block and one binary column an array.

    Besides the rows' own arrays a block holds its entries once more by term, and the length of
    every row's TF-IDF vector in each problem, so that a pass neither sorts nor weighs.
    """
    shared = rows.sparkSession.sparkContext.broadcast(problems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = [p.shared_idf(n_terms) for p in shared.value]
        for batch in batches:
            ends = batch.column("terms").offsets.to_numpy()
            i = 0
            while i < batch.num_rows:
                j = max(int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1, i + 1)
                piece = batch.slice(i, j - i)
                i = j
                size = np.diff(piece.column("terms").offsets.to_numpy())
                term, tf = (piece.column(c).flatten().to_numpy() for c in ("terms", "tf"))
                row, log_tf = np.repeat(np.arange(len(size)), size), 1.0 + np.log(tf)
                by = np.argsort(term, kind="stable")
                length = np.stack([np.sqrt(np.bincount(row, weights=(log_tf * x[term]) ** 2, minlength=len(size))) for x in idf], axis=1)
                edge = np.flatnonzero(np.diff(term[by], prepend=-1))
                wide = (piece.column("y").to_numpy(), piece.column("fold").to_numpy(), size, term[by][edge], edge)
                narrow = [x.astype(_least(top)) for x, top in ((term, n_terms), (tf, tf.max(initial=0)), (row[by], len(size)), (tf[by], tf.max(initial=0)))]
                arrays = (*(np.ascontiguousarray(x, dtype=np.int32) for x in wide), *narrow, length)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=_PACKED)

    return rows.select("y", "fold", "terms", "tf").mapInArrow(run, ", ".join(f"{c} binary" for c in _PACKED))


def gradients(rows: DataFrame, problems: list[Problem], n_terms: int, points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """Weighted mean loss and its gradient of every problem in `points` at its point, in one pass over encoded rows.

    A point holds the coefficients (levels x terms of the problem) and then the intercepts.
    """
    return _pass(packed(rows, problems, n_terms), rows.rdd.getNumPartitions(), problems, n_terms, points)


def _pass(blocks: DataFrame, n_tasks: int, problems: list[Problem], n_terms: int, points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """`gradients` over packed blocks, all problems side by side.

    Tasks send one row for each problem; with many tasks, groups of them are added up first.
    """
    k = len(LEVELS)
    shared = blocks.sparkSession.sparkContext.broadcast((problems, points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        problems, points = shared.value
        asked = list(points)
        # idf is a part of the coefficients here: one column for each problem and level
        wide, idf = np.zeros((n_terms, len(asked), k)), np.zeros((n_terms, len(asked)))
        for c, j in enumerate(asked):
            idf[:, c] = problems[j].shared_idf(n_terms)
            wide[problems[j].place, c] = points[j][:-k].reshape(k, -1).T
        wide = (wide * idf[:, :, None]).reshape(n_terms, -1)
        intercept = np.stack([points[j][-k:] for j in asked])
        level_weight = np.stack([problems[j].weight for j in asked])
        left_out = np.array([problems[j].left_out for j in asked])
        table, buffer = 1.0 + np.log(np.arange(1, 1 << 16)), np.empty((BLOCK, wide.shape[1]))
        log_of = lambda tf: table[tf - np.uint8(1)] if tf.itemsize < 4 else 1.0 + np.log(tf)
        loss, bias, slope = np.zeros(len(asked)), np.zeros((len(asked), k)), np.zeros_like(wide)
        for batch in batches:
            for held in zip(*(batch.column(c) for c in _PACKED)):
                y, fold, size, terms, edge = (np.frombuffer(x.as_buffer(), dtype=np.int32) for x in held[:5])
                n, entries = len(y), int(size.sum())
                term, tf, row_by, tf_by = (_numbers(x, entries) for x in held[5:9])
                length = np.frombuffer(held[9].as_buffer()).reshape(n, -1)[:, asked]
                length = np.where(length > 0, length, 1.0)[:, :, None]
                part = buffer[:entries] if entries <= len(buffer) else np.empty((entries, buffer.shape[1]))
                margins = np.zeros((n, len(asked) * k))
                some = np.flatnonzero(size)
                if len(some):
                    wide.take(term, axis=0, out=part, mode="clip")
                    part *= log_of(tf)[:, None]
                    margins[some] = np.add.reduceat(part, (np.cumsum(size) - size)[some], axis=0)
                p = margins.reshape(n, -1, k) / length + intercept
                p -= p.max(axis=2, keepdims=True)
                np.exp(p, out=p)
                p /= p.sum(axis=2, keepdims=True)
                own = np.where(fold[:, None] == left_out, 0.0, level_weight[:, y].T)
                at = np.arange(n)
                loss -= (own * np.log(np.maximum(p[at, :, y], 1e-300))).sum(axis=0)
                p[at, :, y] -= 1.0
                p *= own[:, :, None]
                bias += p.sum(axis=0)
                if len(some):
                    (p / length).reshape(n, -1).take(row_by, axis=0, out=part, mode="clip")
                    part *= log_of(tf_by)[:, None]
                    slope[terms] += np.add.reduceat(part, edge, axis=0)
        slope = slope.reshape(n_terms, -1, k) * idf[:, :, None]
        out = [(j, loss[c], np.concatenate((slope[problems[j].place, c].T.ravel(), bias[c])).tobytes()) for c, j in enumerate(asked)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=t) for i, t in enumerate((pa.int32(), pa.float64(), pa.binary()))], names=["j", "loss", "slope"])

    def add(part: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s) for s in part.column("slope").to_pylist()], axis=0)
        return pa.table({"j": pa.array([part.column("j")[0].as_py()], pa.int32()), "loss": [pc.sum(part.column("loss")).as_py()], "slope": pa.array([total.tobytes()], pa.binary())})

    kind = "j int, loss double, slope binary"
    found = blocks.mapInArrow(run, kind)
    if n_tasks > FAN_IN:
        found = found.groupBy("j", (F.spark_partition_id() / FAN_IN).cast("int").alias("_g")).applyInArrow(add, kind)
    sums: dict[int, list] = {}
    for r in found.toArrow().to_pylist():
        held = sums.setdefault(r["j"], [0.0, 0.0])
        held[0] += r["loss"]
        held[1] = held[1] + np.frombuffer(r["slope"])
    shared.unpersist()
    return {j: (total / problems[j].rows, slope / problems[j].rows) for j, (total, slope) in sums.items()}


def lbfgs(x: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Minimise a smooth function: yields points, is sent (value, gradient) of each, and returns the last point.

    Two-loop recursion over the last MEMORY steps; steps are shortened until the value falls enough and
    lengthened while the slope along them stays steep (weak Wolfe conditions, by bisection).
    """
    value, slope = yield x
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        if np.abs(slope).max() <= tol:
            break
        q, kept = slope.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s @ q)
            kept.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(steps, reversed(kept)):
            q += s * (a - rho * (y @ q))
        along = -(q @ slope)
        low, high, t = 0.0, np.inf, 1.0 if steps else min(1.0, 1.0 / np.abs(slope).sum())
        for _ in range(30):
            new_value, new_slope = yield x - t * q
            if new_value > value + 1e-4 * t * along:
                high = t
            elif -(q @ new_slope) < 0.9 * along:
                low = t
            else:
                break
            t = 2 * low if high == np.inf and low else 2 * t if high == np.inf else (low + high) / 2
        step, change = -t * q, new_slope - slope
        if new_value > value:
            break
        x, value, slope = x + step, new_value, new_slope
        if step @ change > 1e-12 * (change @ change):
            steps = [*steps[-MEMORY + 1 :], (step, change, 1.0 / (step @ change))]
    return x


def solve(rows: DataFrame, problems: list[Problem], n_terms: int, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-4) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coefficients, intercepts) of every problem; a pass over `rows` serves all that have not converged.

    The mean weighted loss plus |coefficients|^2 / (2 c rows) falls until its gradient is within `tol`.
    """
    k = len(LEVELS)
    blocks = storage.written(packed(rows, problems, n_terms))
    n_tasks = blocks.rdd.getNumPartitions()
    runs = [lbfgs(np.zeros(k * (len(p.place) + 1)), max_iter, tol) for p in problems]
    points = {j: next(r) for j, r in enumerate(runs)}
    done: dict[int, np.ndarray] = {}
    while points:
        found = _pass(blocks, n_tasks, problems, n_terms, points)
        for j, x in list(points.items()):
            value, slope = found[j]
            penalty = 1.0 / (c * problems[j].rows)
            slope = slope.copy()
            slope[:-k] += penalty * x[:-k]
            try:
                points[j] = runs[j].send((value + penalty / 2 * float(x[:-k] @ x[:-k]), slope))
            except StopIteration as end:
                done[j] = end.value
                del points[j]
    out = []
    for j in range(len(problems)):
        bias = done[j][-k:]
        out.append((done[j][:-k].reshape(k, -1), bias - bias.mean()))
    return out


def class_weights(counts: dict[int, int]) -> tuple[np.ndarray, float]:
    """Weight n / (k n_c) of every level, and the rows' sum of weights, from the levels' counts."""
    n, some = sum(counts.values()), [c for c in counts.values() if c]
    weight = np.zeros(len(LEVELS))
    for level, c in counts.items():
        if c:
            weight[level] = n / (len(some) * c)
    return weight, float(max(n, 1))


def numbered(df: DataFrame, label: str) -> DataFrame:
    """Rows of known levels with the level's number as y."""
    return df.withColumn("y", tx.level_order(F.col(label)).cast("int")).where(F.col("y").isNotNull())


def fold_vocabularies(df: DataFrame, folds: int, text: str = "text", max_terms: int = tfidf.MAX_TERMS, min_df: int = tfidf.MIN_DF) -> list[list[tuple]]:
    """For each fold the vocabulary (term, idf) of the rows outside it, from one count per (term, fold).

    `df` has a column `fold`. Counts of a term stand side by side in one row, so texts (or WORDS) are read
    once for all of them.
    """
    rows = df.select("fold", text) if text == tfidf.WORDS else storage.written(df.select("fold", tfidf.words_of(F.col(text)).alias(tfidf.WORDS)))
    outside = {f"{f}": F.col("part") != f for f in range(folds)}
    counts = storage.written(tfidf.counted_terms(rows, max_terms, min_df, outside, "fold"))
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    out = []
    for f in range(folds):
        n = sum(c for g, c in sizes.items() if g != f)
        top = counts.where(F.col(f"df{f}") >= min_df).orderBy(F.desc(f"total{f}"), "term").limit(max_terms)
        found = top.select("term", (F.ln((n + 1) / (F.col(f"df{f}") + 1)) + 1).alias("idf")).orderBy("term").collect()
        out.append([(r["term"], r["idf"]) for r in found])
    return out


def cross_predict(df: DataFrame, folds: int, key: str = "id", text: str = "text", label: str = "criticality", **fit) -> DataFrame:
    """(key, fold, label, y_pred): every row of a known level rated by the model of the other folds; `df` has a column `fold`.

    Vocabularies, class weights and coefficients of a fold's model come from the other folds alone. All
    models share one reading of the texts and one gradient pass per step.
    """
    words = df.select(key, "fold", label, tfidf.words_of(F.col(text)).alias(tfidf.WORDS))
    rows = storage.written(numbered(words, label))
    vocabularies = fold_vocabularies(rows, folds, tfidf.WORDS)
    terms = sorted({t for v in vocabularies for t, _ in v})
    place = {t: i for i, t in enumerate(terms)}
    table = storage.written(encoded(rows, terms, tfidf.WORDS))
    counted = {(r["fold"], r["y"]): r["count"] for r in table.groupBy("fold", "y").count().collect()}
    problems = []
    for f, vocabulary in enumerate(vocabularies):
        weight, n = class_weights({y: sum(c for (g, z), c in counted.items() if g != f and z == y) for y in range(len(LEVELS))})
        problems.append(Problem(np.array([place[t] for t, _ in vocabulary], np.int64), np.array([i for _, i in vocabulary], float), weight, n, f))
    slim = table.select("y", "fold", "terms", "tf")
    fitted = solve(slim, problems, len(terms), **fit)
    shared = df.sparkSession.sparkContext.broadcast((problems, fitted))
    n_terms = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        problems, fitted = shared.value
        for batch in batches:
            block, fold = Block(batch), batch.column("fold").to_numpy()
            level = np.zeros(block.n, dtype=np.int32)
            for f, (p, (coefficients, intercepts)) in enumerate(zip(problems, fitted)):
                if (fold == f).any():
                    wide = np.zeros((len(LEVELS), n_terms))
                    wide[:, p.place] = coefficients
                    margins = block.margins(block.weights(p.shared_idf(n_terms)), wide, np.where(p.weight > 0, intercepts, -np.inf))
                    level = np.where(fold == f, margins.argmax(axis=1), level)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("fold"), batch.column(label), pa.array(level, pa.int32())], names=[key, "fold", label, "_level"])

    fields = {f.name: f.dataType.simpleString() for f in table.schema}
    rated = table.mapInArrow(run, f"`{key}` {fields[key]}, fold {fields['fold']}, `{label}` string, _level int")
    return rated.select(key, "fold", label, F.get(F.array(*[F.lit(lv) for lv in LEVELS]), "_level").alias("y_pred"))
