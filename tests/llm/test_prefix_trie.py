"""The conversation trie against a plain one in Python, its prefix sums against numpy."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from corrweave.llm import prefix_trie, scans

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    for turns in own.values():
        turns.sort()
    said = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        said[c] = [t[-1] for t in own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]]
    nodes = defaultdict(list)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(members) - 1) * (len(n[-1][1]) if n else 0)
    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(said[c]) == len(n))))
        parent = min(nodes[n[:-1]]) if n else None
        out.append((min(members), len(n), parent, len(members), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_trie_of_the_table(spark, tiny):
    df = spark.read.parquet(f"{tiny}/conversations.parquet")
    assert found(prefix_trie.conversation_trie(df)) == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_with_copies_long_conversations_and_turnless_ones(spark):
    """A hot conversation, shared beginnings of all lengths, blocks of blocks, conversations that lose all turns to an absent base."""
    r = np.random.default_rng(5)
    texts = ["a", "b", "ab", "", "é☃", "x" * 50]
    rows = []
    for c in range(100, 160):  # one conversation of a third of all
        rows += [(c, t, "user", "hot") for t in range(7)]
    for c in range(-230, -150):
        rows += [(c, t, "ab"[t % 2], texts[r.integers(0, 2)]) for t in range(r.integers(1, 9))]
    for c in range(500, 512):  # beyond a block, and of the same beginning
        rows += [(c, t, "user", "long" if t < 130 or c % 3 else "other") for t in range(int(r.integers(60, 200)))]
    rows += [(c, 0, "user", "alone") for c in range(901, 930)]  # without a base: turnless where h > 0
    order = r.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], SCHEMA)
    got = prefix_trie.conversation_trie(df)
    assert found(got) == plain_trie(rows)
    places = got.select("preorder", "subtree_end", "depth").orderBy("preorder").collect()
    assert [p.preorder for p in places] == list(range(len(places)))
    for i, p in enumerate(places):  # a subtree is what follows, until the depth is the top's again
        end = next((q.preorder for q in places[i + 1 :] if q.depth <= p.depth), len(places))
        assert p.subtree_end == end


def test_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    r = np.random.default_rng(6)
    rows = [(c, t, "u", "ab"[int(x)]) for c in range(300, 340) for t, x in enumerate(r.integers(0, 1 + c % 2, int(r.integers(1, 40))))]
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)


def test_ids_of_a_node_in_pieces(spark, monkeypatch):
    ends = [(1, 2, 3, c) for c in range(-50, 3000)] + [(1, 2, 4, 7)]
    monkeypatch.setattr(prefix_trie, "CHUNK", 100)
    got = {r.depth: r.ends_sha256 for r in prefix_trie.end_hashes(spark.createDataFrame(ends, "a bigint, b bigint, depth bigint, conv_id bigint")).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, range(-50, 3000))).encode()).hexdigest(), 4: hashlib.sha256(b"7").hexdigest()}


def test_trie_of_awkward_rows(spark):
    """Nulls anywhere, equal turns, repeated rows, a text of a megabyte, columns with names of the operator's own; an empty table."""
    rows = [(None, 1, "u", "x"), (1, None, None, None), (1, 2, "u", "y"), (1, 2, "u", "x"), (1, 2, "u", "x"), (2, None, "", ""), (0, 5, "u", "l" * 1_000_000), (0, None, "u", None), (100, 1, None, "z")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"a": F.lit("a"), "depth": F.lit(None), "part": F.lit(1), "digest": F.lit("d"), "rank": F.lit(0)})
    assert found(prefix_trie.conversation_trie(df)) == plain_trie(rows)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def test_prefix_sums(spark):
    """Over keys that span several parts, keys within one, and the whole; modulo 2^64."""
    r = np.random.default_rng(7)
    keys = sorted([1] * 300 + [2] + [3] * 40 + list(range(10, 60)))
    xs = [int(x) for x in r.integers(-(1 << 62), 1 << 62, len(keys))]
    df = spark.createDataFrame([(k, i, x) for i, (k, x) in enumerate(zip(keys, xs))], "k bigint, i bigint, x bigint").repartition(5)
    rows = scans.in_order(df, "k", "i")
    signed = lambda n: (n + (1 << 63)) % (1 << 64) - (1 << 63)
    got = {g.i: g for g in scans.running(rows, "k", ("x",)).collect()}
    for i, k in enumerate(keys):
        first = keys.index(k)
        assert (got[i].at, got[i].within) == (i, i - first)
        assert (got[i].before_x, got[i].upto_x) == (signed(sum(xs[first:i])), signed(sum(xs[first : i + 1])))
    whole = {g.i: g for g in scans.running(rows, sums=("x",)).collect()}
    assert all(whole[i].within == i and whole[i].upto_x == signed(sum(xs[: i + 1])) for i in range(len(keys)))
