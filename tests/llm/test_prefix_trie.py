import hashlib
import random
from collections import defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows, family=5, most=9):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    seqs = {c: [(r[3], r[4]) for r in sorted(ts)] for c, ts in turns.items()}
    if not family:
        return seqs
    out = {}
    for c, s in seqs.items():
        h = crc32(str(c).encode()) % most
        out[c] = seqs.get(c - c % family, [])[:h] + s[h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below[p])
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def table(seed, convs=60, longest=14, words=3):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(convs * 2), convs):
        for t in range(rnd.randrange(1, longest)):
            rows.append((c, rnd.choice((t, t, t, None)), rnd.choice(("user", None, "bot")), rnd.choice(("a", "é", None, "", "long text " * 3)[:words])))
    rows += [r for r in rows if r[0] % 7 == 0]  # repeated rows
    rows += [(None, 0, "user", "nobody's"), (3000, 0, "user", "a"), (3001, 1, "user", "é" * 50)]
    return rows


@pytest.mark.parametrize("seed, block, shard", [(1, 9, 20), (2, 9, 7), (3, 12, 1000), (4, 1024, 65536)])
def test_rebuilt_against_brute_force(spark, seed, block, shard):
    rows = table(seed, longest=40 if seed == 2 else 14)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("digest", F.lit(1))
    assert got(prefix_trie.nodes(prefix_trie.rebuilt(df.repartition(3), block=block), block=block, shard=shard)) == brute(rebuild(rows))


@pytest.mark.parametrize("block", [1, 2, 5])
def test_plain_conversations_over_several_blocks(spark, block):
    rows = table(9, convs=25, longest=17, words=2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(prefix_trie.nodes(prefix_trie.blocks(df, block=block), block=block, shard=11)) == brute(rebuild(rows, family=0))


def test_many_copies_and_no_rows(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)] + [(1000, 0, "user", "turn 0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(prefix_trie.nodes(prefix_trie.blocks(df), shard=50)) == brute(rebuild(rows, family=0))
    assert prefix_trie.nodes(prefix_trie.rebuilt(df.limit(0))).count() == 0


def test_slots_are_minimal_and_perfect():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64), axis=0)
        slots = prefix_trie.Slots(keys)
        assert sorted(slots.find(keys).tolist()) == list(range(len(keys)))
        assert (slots.find(rng.integers(0, 1 << 63, (50, 2), dtype=np.uint64)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.Slots(np.zeros((2, 2), np.uint64))


def test_equal_digests_of_different_prefixes_are_told(monkeypatch):
    monkeypatch.setattr(prefix_trie, "extend", lambda digest, keys: [5 + len(keys) for _ in keys])
    s = prefix_trie.Shard(8)
    for c, k in ((1, b"a" * 16), (2, b"b" * 16)):
        s.add({"conv": c, "block": 0, "depth": 0, "turns": [{"key": k, "bytes": 1}], "digest": prefix_trie.ROOT, "upto": 0, "after": 0, "last": True})
    with pytest.raises(ValueError):
        s.build()


def test_query_equals_sql_and_brute_force(spark):
    rows = got(queries.op11_prefix_trie(spark, SF))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    rel = con.execute(prefix_trie.oracle())
    names = [x[0] for x in rel.description]
    assert rows == sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in rel.fetchall()), key=str)
    assert rows == brute(rebuild([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]))
