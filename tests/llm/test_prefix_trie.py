"""Prefix trie against a plain loop, with its SQL twin on the same rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from kilnset.llm.prefix_trie import prefix_trie
from kilnset.llm.queries import SQL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for turns in convs.values():
        turns.sort()
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(c / 100) * 100
        head = convs.get(c - family, [])[:h]
        whole[c] = tuple((r, t) for _, r, t in head) + tuple((r, t) for _, r, t in turns[h:])
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = lambda n: sum(1 for m in members if len(m) == len(n) + 1 and m[:len(n)] == n)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in who if whole[c] == node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids(node),
                    sum(1 for n in below if not kids(n)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def make_rows():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 9), 100, 101, 102, 305, 306, -7, 400, 10**12 + 3]:
        for turn in range(rng.choice([1, 2, 3, 5, 7])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "bot", rng.choice(["a", "bé", "", "long text"])))
    rows += [(500 + k, t, "user", f"same {t}") for k in range(12) for t in range(4)]  # one family, copies
    rows += [(700, t, "user", "x" * (t % 3)) for t in range(30)]  # long, and followed by others
    rows += [(700 + k, t, "user", "x" * (t % 3)) for k in (1, 2, 3) for t in range(30 if k < 3 else 19)]
    rows += [(8, None, "user", "first"), (8, 2, None, None), (8, 2, None, None), (8, 2, "a", "z"), (8, 2, "a", "b")]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("width, run", [(8, 4096), (3, 4)])
def test_trie(spark, width, run):
    rows = make_rows()
    found = prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
                        .selectExpr("*", "'x' as depth", "1 as blk", "2 as k0"), width, run).select(COLUMNS).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain(rows)))


def test_sql_twin():
    rows = make_rows()
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.execute(f"select {', '.join(COLUMNS)} from ({SQL['op12_prefix_trie']})").fetchall()
    assert sorted(map(str, found)) == sorted(map(str, plain(rows)))


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(none).collect() == []


def test_very_long_texts_and_conversation(spark):
    rows = [(100, t, "user", "y" * 200_000 if t == 3 else str(t)) for t in range(600)] + [(101, t, "user", str(t)) for t in range(7)]
    found = prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(COLUMNS).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain(rows)))
