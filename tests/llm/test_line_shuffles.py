"""What line dedup sends: keys by column, sets only of lines that may go, nothing anew for tables dealt by signature."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

from noticewing.llm import lines
from noticewing.llm.common import bucketed


def test_keys_cost_less_in_columns_and_come_back():
    rng = np.random.default_rng(5)
    entry = np.zeros(5000, dtype=lines.ENTRY)
    entry["sig"], entry["order"], entry["n"], entry["i"] = rng.integers(0, 1 << 64, 5000, np.uint64), 77, rng.integers(4, 40, 5000), rng.integers(0, 9, 5000)
    cuts = np.array([0, 1, 2600, 5000])
    for a, b in zip(cuts, cuts[1:]):
        entry["key"][a:b] = np.sort(rng.integers(0, 1 << 32, b - a, np.uint32))
    blobs = lines._blobs(entry, cuts)
    for blob, a, b in zip(blobs, cuts, cuts[1:]):
        assert (lines._entries(blob.as_buffer()) == entry[a:b]).all()
    packed = sum(pa.compress(b.as_buffer(), "lz4").size for b in blobs)
    assert packed < 0.9 * pa.compress(pa.py_buffer(entry.tobytes()), "lz4").size


def test_tokens_are_found_or_not():
    rng = np.random.default_rng(6)
    for ends in ([0, 5, 6, 7, (1 << 64) - 1], [3]):
        often = np.unique(np.append(rng.integers(0, 1 << 63, 3000, np.uint64), np.array(ends, np.uint64)))
        edge = np.searchsorted(often, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        tokens = np.concatenate((often, often + np.uint64(1), rng.integers(0, 1 << 64, 3000, np.uint64)))
        assert ((often[lines._places(often, edge, tokens)] == tokens) == np.isin(tokens, often)).all()


def test_counts_of_tokens_are_those_of_one_pass():
    rng = np.random.default_rng(7)
    counts, every = lines.FrequentCounts(0.0), rng.integers(0, 300, 4000, np.uint64)
    for part in np.split(every, 8):
        counts.add(part, 100)
    token, n = np.unique(every, return_counts=True)
    assert (counts.token == token).all() and (counts.n == n).all()


def test_joins_by_a_bucketed_column_shuffle_one_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = bucketed(spark.range(500).selectExpr("id as _sig", "id * 2 as x"), "_sig")
        assert held.count() == 500 and not [t for t in spark.catalog.listTables() if t.name.startswith("noticewing_")]
        joined = spark.range(0, 1000, 3).selectExpr("id as _sig").join(held, "_sig")
        assert joined.count() == 167
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sets_are_made_only_of_members_that_fit_another(spark):
    rng = random.Random(8)
    members, firsts = [], []
    for k in range(40):  # one large group: two lines alike, all others far apart by their bitmaps
        bits = [0, 0] if k < 2 else [rng.getrandbits(62), rng.getrandbits(62)]
        members.append((1, k, 10, 0))
        firsts.append((k, (k, 0, 0), 10, *bits))
    groups = lines._Groups(
        spark.createDataFrame(members, "key long, sig long, n int, i int"),
        spark.createDataFrame(firsts, "_sig long, _first struct<_id: long, _h: long, _line: int>, _n int, _b0 long, _b1 long"), Fraction(4, 5))
    assert {r.sig for r in groups.sigs().collect()} == {0, 1}
