"""The prefix trie against brute force: rebuilt conversations, shared heads, long ones, copies, odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from noticewing.llm import registered, trie

from . import cases

SCHEMA = "conv_id long, turn long, role string, text string, node string, slab int, ends string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed=3, n=90):
    rng = random.Random(seed)
    rows = []

    def add(c, turns):
        rows.extend((c, i, r, t) for i, (r, t) in enumerate(turns))

    hello = ("user", "hello there  friend of mine")
    long = [("user", f"step {i % 7}") for i in range(50)]
    for c in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            add(c, [hello, ("assistant", "hi")])
        elif kind == 1:
            add(c, [hello] + [("assistant", f"a {rng.randrange(3)}") for _ in range(rng.randrange(4))])
        elif kind == 2:
            add(c, [("system", "s"), hello, ("user", " ".join("w" * rng.randrange(5)))])
        elif kind == 3:
            add(c, long[: rng.randrange(1, 50)])
        elif kind == 4:
            add(c, long + [("assistant", str(c % 3))])
        else:
            add(c, [(None, None), ("user", ""), ("user", "x \t y\n")][: rng.randrange(1, 4)])
    rows += [(200, None, "user", "first"), (200, 0, "user", "second"), (205, 1, "u", "one"), (221, 0, "u", "alone"), (None, 0, "user", "no id")]
    rows += [(230, 0, "user", "same"), (230, 0, "user", "same")]
    rng.shuffle(rows)
    return [(*r, "x", 1, "y") for r in rows]


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def nodes(whole):
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        words = len(cases.WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * words
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(whole[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("wide,cells", [(32, 1 << 20), (4, 40), (7, 8)])
def test_nodes_equal_brute_force(spark, wide, cells):
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    turns, convs = trie.rebuilt(trie.numbered(table))
    assert collected(trie.trie(turns, convs, wide, cells)) == nodes(rebuilt(ordered(rows)))


def test_without_rebuilding(spark):
    rows = conversations(seed=8, n=40)
    assert collected(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == nodes(ordered(rows))


def test_copies_and_one_long_conversation(spark):
    """A third of the conversations are one, and one conversation has a third of the turns."""
    rows = [(c, i, "user", f"t{i}") for c in range(300) for i in range(3)]
    rows += [(1000, i, "user", f"t{i % 5}") for i in range(900)] + [(c, i, "user", f"{c} {i}") for c in range(2000, 2300) for i in range(3)]
    got = collected(trie.trie(*_plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)), 16, 200))
    assert got == nodes(ordered(rows))


def _plain(table):
    turns = trie.numbered(table)
    return turns, turns.groupBy("conv_id").count().withColumnRenamed("count", "n")


def test_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(none).count() == 0
    turnless = spark.createDataFrame([(c, 0, "u", "t") for c in range(1, 20)], "conv_id long, turn long, role string, text string")
    turns, convs = trie.rebuilt(trie.numbered(turnless))
    want = nodes(rebuilt({c: [("u", "t")] for c in range(1, 20)}))
    assert collected(trie.trie(turns, convs)) == want and any(r[0] == 1 and r[1] == 0 for r in want)
    turnless.write.parquet(f"{tmp_path}/conversations.parquet")
    assert collected(registered.QUERIES["op11_trie"](spark, str(tmp_path))) == want
