"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticewing.llm.common import batches_of, likely, lists, mixed, text_bytes, word_hashes, word_spans, written
from noticewing.llm.graph import components
from noticewing.llm.lines import doc_keys
from noticewing.llm.repeats import _by_shard, _each_shard, _packed, _sql, _unpacked
from noticewing.llm.substrings import _table

#: words of a shingle
SHINGLE = 5
#: bands and samples in each: a pair of similarity 0.8 shares a band with probability 0.998
BANDS, SAMPLES = 12, 4
#: share of all documents that a shingle of weight 1 is in
COMMON = 0.01
#: how far frequency matters: a shingle in all documents weighs 1 / (1 + DAMPING) of that
DAMPING = 0.25
#: bytes of text in one bucket of documents, and of those whose shingles are made together
BUCKET_BYTES, _BLOCK = 4 << 20, 1 << 20
#: words of 64 bits in which a document's shingles leave their parity
PARITY = 16
#: shingles of pairs that are compared together
COMPARED = 1 << 20
#: bits by which document frequencies tell shingles apart
KEY_BITS = 48
_CUT = np.uint64(64 - KEY_BITS)
_TABLE = 1 << 12


def _shingles(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct shingles of every row, sorted by both.

    A text of fewer words than a shingle has one shingle, all of it; one without words has none.
    """
    starts, ends, first = word_spans(data, rows)
    words = word_hashes(data, starts, ends)
    size = np.diff(first)
    with np.errstate(over="ignore"):
        total = np.zeros(max(len(words) - SHINGLE + 1, 0), dtype=np.uint64)
        for k in range(SHINGLE):
            total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(words[k : k + len(total)] + np.uint64(k))
        row = np.repeat(np.arange(len(size)), size)
        whole = row[: len(total)] == row[SHINGLE - 1 :] if len(total) else np.zeros(0, bool)
        owner, found = row[: len(total)][whole], mixed(total[whole])
        short = np.flatnonzero((size > 0) & (size < SHINGLE))
        if len(short):
            few = np.zeros(len(short), dtype=np.uint64)
            for k in range(SHINGLE - 1):
                at = np.flatnonzero(size[short] > k)
                few[at] = few[at] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[first[short[at]] + k] + np.uint64(k))
            owner, found = np.concatenate((owner, short)), np.concatenate((found, mixed(few ^ np.uint64(SHINGLE))))
    by = np.lexsort((found, owner))
    owner, found = owner[by], found[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    edge = np.flatnonzero(new)
    return owner[edge], found[edge], np.diff(np.append(edge, len(by)))


class Frequencies:
    """In how many documents every shingle is: the steps for one number of shards, as functions of Arrow tables.

    A bucket of documents asks the shards of its shingles, a shard adds up what all buckets have and
    answers each. No shingle is left out, however rare. Shingles are told apart by their highest
    KEY_BITS bits, and shards are ranges of them.
    """

    ASKED = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
    ANSWER = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("total", pa.binary())])

    def __init__(self, n_shards: int):
        self.n_shards = n_shards

    @staticmethod
    def blocks(docs: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows from i to j with their shingles, some rows at a time."""
        data, rows = text_bytes(docs.column("text"))
        return [(i, j, *_shingles(data[rows[i] : rows[j]], rows[i : j + 1] - rows[i])) for i, j in batches_of(rows, _BLOCK)]

    def lookup(self, blocks: list) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Sorted keys of a bucket's shingles, in how many of its rows each is, and the shards they lie in."""
        key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *[b[3] for b in blocks]]) >> _CUT, return_counts=True)
        shard = ((key >> np.uint64(KEY_BITS - 24)) * np.uint64(self.n_shards) >> np.uint64(24)).astype(np.int64)
        return key, n, _by_shard(shard)

    def ask(self, docs: pa.Table) -> pa.Table:
        key, n, shards = self.lookup(self.blocks(docs))
        bucket, key = docs.column("bucket")[0].as_py(), key.view(np.int64)
        low = lambda p: -(-(p << 24) // self.n_shards) << (KEY_BITS - 24)  # noqa: E731  the least key of a shard
        return _table([(bucket, p, _packed(np.diff(key[a:b], prepend=low(p))), _packed(n[a:b])) for p, a, b in shards], self.ASKED)

    def answer(self, rows: list[dict]) -> pa.Table:
        """Documents of every shingle a bucket asked for; buckets whose shingles no other document has get no row."""
        keys = [np.cumsum(_unpacked(r["keys"])) for r in rows]
        at = np.cumsum([0, *map(len, keys)])
        _, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate([_unpacked(r["n"]) for r in rows])).astype(np.int64)[of]
        return _table([(r["bucket"], r["shard"], _packed(total[a:b])) for r, a, b in zip(rows, at, at[1:]) if total[a:b].max() > 1], self.ANSWER)

    def totals(self, blocks: list, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of a bucket's shingles and the documents of each."""
        key, _, shards = self.lookup(blocks)
        n, edges = np.ones(len(key), dtype=np.int64), {p: (a, b) for p, a, b in shards}
        for p, total in zip(answers.column("shard").to_pylist(), answers.column("total").to_pylist()):
            a, b = edges[p]
            n[a:b] = _unpacked(total)
        return key, n


def weights(count: np.ndarray, n: np.ndarray, n_docs: int) -> np.ndarray:
    """TF-IDF weight of shingles in n documents each: count * (1 + DAMPING * idf) / (1 + DAMPING).

    idf = ln(n_docs / n) / ln(1 / COMMON): 0 in all documents, 1 in a share of COMMON, and more the
    rarer a shingle is, down to a single document.
    """
    idf = np.log(max(n_docs, 1) / np.maximum(n, 1)) / np.log(1 / COMMON)
    return count * (1 + DAMPING * np.maximum(idf, 0)) / (1 + DAMPING)


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the draws consistent weighted sampling needs: two Gamma(2, 1) and a uniform one."""
    rng = np.random.default_rng(20100)
    r, log_c = rng.gamma(2.0, 1.0, _TABLE), np.log(rng.gamma(2.0, 1.0, 1 << 16))
    return r.astype(np.float32), rng.random(_TABLE).astype(np.float32), log_c.astype(np.float32)


def sketch(row: np.ndarray, found: np.ndarray, weight: np.ndarray, n_rows: int, n_samples: int = BANDS * SAMPLES) -> np.ndarray:
    """Samples of every row, [n_rows, n_samples]: equal in two rows with probability of their weighted Jaccard.

    Improved consistent weighted sampling (Ioffe, 2010): with draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1)
    fixed for a shingle and sample, t = floor(ln w / r + beta), and the shingle with the smallest
    ln c - r (t - beta) - r is sampled together with t.
    """
    out = np.zeros((n_rows, n_samples), dtype=np.uint64)
    if not len(row):
        return out
    r_table, beta_table, c_table = _draws()
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    group = np.cumsum(np.append(True, row[1:] != row[:-1])) - 1
    log_w = np.log(weight).astype(np.float32)
    with np.errstate(over="ignore"):
        for k in range(n_samples):
            bits = (found ^ (found >> np.uint64(29))) * np.uint64((2 * k + 1) * 0xD1342543DE82EF95 % (1 << 64) | 1)
            bits ^= bits >> np.uint64(32)
            bits *= np.uint64(0xBF58476D1CE4E5B9)
            near = (bits >> np.uint64(52)).astype(np.int64)
            r, beta = r_table[near], beta_table[near]
            t = np.floor(log_w / r + beta)
            a = c_table[((bits >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
            least = np.minimum.reduceat(a, first)
            at = np.flatnonzero(a == least[group])
            at = at[::-1]  # of equal ones the first is written last
            out[row[at], k] = mixed(found[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(k))
    return out


_SKETCH = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("_any", pa.bool_()), ("_bands", pa.list_(pa.int64())), ("_df", pa.binary())])


def _sketched(docs: DataFrame, n_docs: int, size: int) -> DataFrame:
    """One row per document: its bands, hashed, and the document frequencies of its shingles in their order, packed."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    steps = Frequencies(n)
    bucketed = docs.withColumn("bucket", F.pmod(F.hash("_id", "_h"), F.lit(n)).cast("int"))
    asked = bucketed.groupBy("bucket").applyInArrow(lambda part: steps.ask(part), _sql(steps.ASKED))
    answers = asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(_each_shard(steps.answer), _sql(steps.ANSWER))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SKETCH.empty_table()
        ids, texts = docs.column("_id").to_numpy(), docs.column("_h").to_numpy()
        by = np.lexsort((texts, ids))
        new = np.append(True, (ids[by][1:] != ids[by][:-1]) | (texts[by][1:] != texts[by][:-1]))
        blocks, out = steps.blocks(docs), []
        every, total = steps.totals(blocks, answers)
        for i, j, row, found, count in blocks:
            df = total[np.searchsorted(every, found >> _CUT)]
            s = sketch(row, found, weights(count, df, n_docs), j - i)
            with np.errstate(over="ignore"):
                band = np.zeros((j - i, BANDS), dtype=np.uint64)
                for k in range(SAMPLES):
                    band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + s[:, k::SAMPLES])
                band = mixed(band + np.arange(BANDS, dtype=np.uint64))
            size = np.bincount(row, minlength=j - i)
            edge = np.concatenate(([0], np.cumsum(size))).tolist()
            part = docs.slice(i, j - i).combine_chunks()
            out.append(pa.Table.from_arrays(
                [part.column("_id"), part.column("_h"), pa.array(size > 0), lists(band.ravel().view(np.int64), np.full(j - i, BANDS), pa.int64()),
                 pa.array([_packed(df[a:b]) for a, b in zip(edge, edge[1:])], type=pa.binary())], schema=_SKETCH))
        return pa.concat_tables(out).take(pa.array(np.sort(by[new])))  # rows repeated whole are in one bucket

    kind = "_id long, _h long, _any boolean, _bands array<long>, _df binary"
    return bucketed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, kind)


def parities(row: np.ndarray, found: np.ndarray, n_rows: int) -> np.ndarray:
    """PARITY words of each row: sets differ in at least as many shingles as these differ in bits."""
    bits = 64 * PARITY
    out = np.zeros((n_rows, PARITY), dtype=np.uint64)
    bit = ((found >> np.uint64(8)) % np.uint64(bits)).astype(np.int64)
    for i in range(0, n_rows, 1 << 10):  # some rows at a time: a count per row and bit
        n = min(1 << 10, n_rows - i)
        a, b = np.searchsorted(row, (i, i + n))
        odd = np.bincount((row[a:b] - i) * bits + bit[a:b], minlength=n * bits).astype(np.uint8) & 1
        out[i : i + n] = np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view(np.uint64)
    return out


def _shingle_sets(docs: DataFrame, n_docs: int) -> DataFrame:
    """`node` with its shingles, sorted, and their weights, the least weight and the parities."""
    names = [f"p{k}" for k in range(PARITY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, rows = text_bytes(batch.column("text"))
            for i, j in batches_of(rows, _BLOCK):
                row, found, count = _shingles(data[rows[i] : rows[j]], rows[i : j + 1] - rows[i])
                df = np.concatenate([_unpacked(x) for x in batch.column("_df").slice(i, j - i).to_pylist()])
                size, w = np.bincount(row, minlength=j - i), weights(count, df, n_docs).astype(np.float32)
                least, parity = np.full(j - i, np.inf, dtype=np.float32), parities(row, found, j - i).view(np.int64)
                np.minimum.at(least, row, w)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(i, j - i), lists(found.view(np.int64), size, pa.int64()), lists(w, size, pa.float32()),
                     pa.array(least), *[pa.array(parity[:, k]) for k in range(PARITY)]], names=["node", "s", "w", "least", *names])

    return docs.select("node", "text", "_df").mapInArrow(run, f"node long, s array<long>, w array<float>, least float, {', '.join(f'{c} long' for c in names)}")


_COMPARED = (
    T.StructType().add("a", "long").add("b", "long")
    .add("like", "double").add("common", "double").add("weight", "double").add("other", "double")
    .add("outside", T.ArrayType(T.LongType())).add("excess", T.ArrayType(T.FloatType()))
)


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of a and b (smaller weights over larger ones), both weights, what the first has beyond the second.

    About COMPARED shingles of a batch are answered at a time.
    """
    for batch in batches:
        sa, wa, sb, wb = [batch.column(c) for c in ("sa", "wa", "sb", "wb")]
        edge = [x.offsets.to_numpy() for x in (sa, sb)]
        flat = [x.values.to_numpy(zero_copy_only=False) for x in (sa, wa, sb, wb)]
        for i, j in batches_of(edge[0] + edge[1], COMPARED):
            out, alone, excess, n_alone = np.zeros((j - i, 4)), [np.zeros(0, np.uint64)], [np.zeros(0)], []
            for k in range(i, j):
                x, y = slice(edge[0][k], edge[0][k + 1]), slice(edge[1][k], edge[1][k + 1])
                a, b = flat[0][x].view(np.uint64), flat[2][y].view(np.uint64)
                u, v = flat[1][x].astype(np.float64), flat[3][y].astype(np.float64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                hit = b[at] == a
                common = np.minimum(u[hit], v[at[hit]]).sum()
                out[k - i] = common / (u.sum() + v.sum() - common), common, u.sum(), v.sum()
                beyond = np.where(hit, u - v[at], u)
                more = beyond > 0
                alone.append(a[more])
                excess.append(beyond[more])
                n_alone.append(int(more.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").slice(i, j - i), batch.column("b").slice(i, j - i), *(pa.array(out[:, c]) for c in range(4)),
                 lists(np.concatenate(alone).view(np.int64), np.array(n_alone, dtype=np.int64), pa.int64()),
                 lists(np.concatenate(excess).astype(np.float32), np.array(n_alone, dtype=np.int64), pa.float32())], names=_COMPARED.names)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that are near copies: `_id`, `_h` (as `doc_keys` gives them), `_component`, `_first`.

    One row per different document; `_component` is common to all documents connected by pairs with
    weighted Jaccard similarity `threshold` or more that share a band, and `_first` is the group's
    first (smallest id, then text hash). Equal texts are one node from the start. Documents without
    words stay alone: their component is null and they are first.

    In a band's bucket all compare with its centre, the member that shares most buckets, and those it
    does not reach with the best among themselves. Where the links found so leave a centre's members
    in several parts, two members of different parts are compared if their weights let what both have
    in common with the centre reach the threshold, or else if they share one of the rarest shingles
    they have beyond it, as many as cover what the centre cannot give, and if the parities of their
    shingles do not show that they differ in too many: any other pair is below the threshold. So no link between parts is lost, and pairs within a part, which grow with the square
    of a group of copies, are never listed.
    """
    slim = docs.select(*[c.alias(n) for n, c in doc_keys(docs, key, text).items()], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n_docs, size = slim.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    sketched = written(_sketched(slim, n_docs, int(size or 0)))
    # Equal texts: one node, the hash of the text (64 bits), standing for all ids that have it.
    nodes = sketched.where("_any").groupBy(F.col("_h").alias("node")).agg(F.first("_bands").alias("_bands"))
    banded = nodes.select("node", F.posexplode("_bands").alias("b", "key")).select("node", "key")
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(banded.join(sizes, "key"))  # only those shared
    degree = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = buckets.join(degree, "node")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("_c")).select("key", F.col("_c.node").alias("centre"))
    centred = written(buckets.join(centre, "key").select("key", "node", "centre"))

    # Few documents share a bucket: most of the others stay where they are.
    shared = buckets.select("node").distinct()
    one_text = likely(slim.select(F.col("_h").alias("node"), "text"), shared, "node").join(shared, "node", "left_semi").dropDuplicates(["node"])
    df = likely(sketched.select(F.col("_h").alias("node"), "_df"), shared, "node").join(shared, "node", "left_semi").dropDuplicates(["node"])
    sets = written(_shingle_sets(one_text.join(df, "node"), n_docs))

    def compared(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("w").alias("wa"))
        b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("w").alias("wb"))
        # Written first, so that few pairs are sent to the sets and not the sets to them.
        return written(pairs).join(b, "b").join(a, "a").select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(_similarity, _COMPARED)

    def parted(frame: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
        """`frame` with the part of a node: its component so far, or the node itself."""
        found = parts.select(F.col("id").alias(node), F.col("component").alias(name))
        return frame.join(found, node, "left").withColumn(name, F.coalesce(name, node))

    stars = centred.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    first = written(compared(stars))
    links = first.where(F.col("like") >= threshold).select("a", "b")
    left = first.where(F.col("like") < threshold).select(F.col("a").alias("node"), F.col("b").alias("centre"))
    best = left.join(degree, "node").groupBy("centre").agg(F.max(F.struct("degree", "node")).alias("_c")).select("centre", F.col("_c.node").alias("b"))
    again = left.join(best, "centre").where("node != b").select(F.col("node").alias("a"), "b").distinct()
    links = written(links.unionByName(compared(again).where(F.col("like") >= threshold).select("a", "b")))
    parts = written(components(links))

    own = first.select(F.col("b").alias("centre"), F.col("b").alias("node"), F.col("other").alias("common"), F.col("other").alias("weight"), F.lit(None).cast("array<long>").alias("outside"), F.lit(None).cast("array<float>").alias("excess")).dropDuplicates(["centre"])
    members = parted(first.select(F.col("b").alias("centre"), F.col("a").alias("node"), "common", "weight", "outside", "excess").unionByName(own), parts, "node", "part")
    several = members.groupBy("centre").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("centre")
    marks = ["least", *[f"p{k}" for k in range(PARITY)]]
    members = written(members.join(several, "centre", "left_semi").join(sets.select("node", *marks), "node"))
    share = threshold / (1 + threshold) * (1 - 1e-6)  # of both weights, what a pair at the threshold has in common

    def side(frame: DataFrame, which: str, *keys: str) -> DataFrame:
        return frame.select(*keys, *[F.col(c).alias(f"{c}_{which}") for c in ("node", "common", "weight", "part", *marks)])

    within = F.least("common_x", "common_y")
    beside = F.least(F.col("weight_x") - F.col("common_x"), F.col("weight_y") - F.col("common_y"))
    needed = (F.col("weight_x") + F.col("weight_y")) * F.lit(share)
    # Both weigh at least this much more than what they have in common: the shingles in only one of them.
    differ = sum(F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in marks[1:]) * F.least("least_x", "least_y")
    apart = (F.col("part_x") < F.col("part_y")) & (differ <= (F.col("weight_x") + F.col("weight_y")) * F.lit(1 - 2 * share))
    by_centre = side(members, "x", "centre").join(side(members, "y", "centre"), "centre").where(apart & (within >= needed))
    # Any pair at the threshold has in common at least `threshold` of either weight; what the centre
    # cannot give must come from beyond it. So the rarest shingles beyond it are enough, up to that rest.
    lone = members.select("centre", "node", "common", "weight", "part", F.explode(F.arrays_zip("outside", "excess")).alias("_o"))
    lone = lone.select("centre", "node", "common", "weight", "part", F.col("_o.outside").alias("shingle"), F.col("_o.excess").cast("double").alias("excess"))
    seen = lone.groupBy("centre", "shingle").agg(F.count(F.lit(1)).alias("n"))
    rarest = W.partitionBy("centre", "node").orderBy("n", "shingle").rowsBetween(W.currentRow, W.unboundedFollowing)
    rest = F.lit(threshold * (1 - 1e-6)) * F.col("weight") - F.col("common")
    shown = lone.join(seen, ["centre", "shingle"]).withColumn("ahead", F.sum("excess").over(rarest)).where((F.col("ahead") >= rest) & (F.col("n") > 1))
    met = shown.groupBy("centre", "shingle").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("centre", "shingle")
    shown = written(shown.join(met, ["centre", "shingle"], "left_semi").join(sets.select("node", *marks), "node"))
    by_shingle = side(shown, "x", "centre", "shingle").join(side(shown, "y", "centre", "shingle"), ["centre", "shingle"]).where(apart & (within + beside >= needed))
    asked = by_centre.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).unionByName(by_shingle.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")))
    third = compared(asked.distinct()).where(F.col("like") >= threshold).select("a", "b")
    stars = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
    group = components(stars.unionByName(third)).select(F.col("id").alias("_h"), F.col("component").alias("_g"))
    every = sketched.select("_id", "_h", "_any").join(group, "_h", "left").select(
        "_id", "_h", F.when(F.col("_any"), F.coalesce("_g", "_h")).alias("_component"))
    every = written(every)
    firsts = every.where(F.col("_component").isNotNull()).groupBy("_component").agg(F.min(F.struct("_id", "_h")).alias("_first"))
    return every.join(firsts, "_component", "left").select(
        "_id", "_h", "_component", (F.col("_first").isNull() | (F.col("_first") == F.struct("_id", "_h"))).alias("_kept"), F.col("_first._id").alias("_first_id"))


def deduped(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; a row repeated whole stays once."""
    kept = near_duplicates(docs, threshold).where("_kept").select("_id", "_h")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), *[c.alias(n) for n, c in doc_keys(docs).items()]).join(kept, ["_id", "_h"], "left_semi")
    worded = F.length(F.trim(F.coalesce(F.col("_row.text"), F.lit("")))) > 0
    once = rows.where(worded).dropDuplicates(["_id", "_h"]).unionByName(rows.where(~worded))
    return once.select("_row.*")


def duplicate_report(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document row: doc_id, component_id (smallest doc_id of its group, its own if alone), kept."""
    found = near_duplicates(docs, threshold)
    rows = docs.select("doc_id", *[c.alias(n) for n, c in doc_keys(docs).items()])
    return rows.join(found, ["_id", "_h"]).select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_first_id", "_id")).alias("component_id"), F.col("_kept").alias("kept"))
