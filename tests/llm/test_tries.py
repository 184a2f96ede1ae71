"""The conversation trie against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import oracle
import pytest

from daybook.llm import tries
from daybook.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv int, top string, depth int, a int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, turns in own.items():
        rest = int(abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = turns if not rest else own.get(c - rest, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (min(convs), len(node), min(members[node[:-1]]) if node else -10**9, len(convs), children[node], leaves[node],
         saved[node], hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(made[c]) == len(node)).encode())
         .hexdigest()) for node, convs in members.items())


def result(df):
    assert df.dtypes == [(n, "string" if n == "ends_sha256" else "bigint") for n in NAMES]
    return sorted(tuple(-10**9 if v is None else v for v in r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], SCHEMA).repartition(7)


@pytest.fixture(scope="module")
def rows():
    """Shared beginnings, copies, gaps between turns, null turns, roles and texts, long ones, lone ids."""
    rng = random.Random(2)
    out = []
    for c in [*range(-12, 60), 1001, 1003, 2**40, 2**40 + 1]:
        host = rng.choice(["a", "b", None])
        n = rng.choice([1, 2, 3, 8, 9, 17])
        out += [(c, rng.choice([None, 5]) if t == 0 and c % 3 == 0 else 10 + 2 * t,
                 "system" if t == 0 else rng.choice(["user", None, ""]),
                 f"host {host}" if t == 0 else rng.choice(["ja", "né", None, "", "x" * 40])) for t in range(n)]
    out += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    return out


def test_trie_is_the_one_by_hand(spark, rows):
    want = by_hand(rows)
    assert any(r[1] > 8 for r in want) and any(r[3] > 5 for r in want)
    assert result(tries.conversation_trie(frame(spark, rows))) == want


def test_conversations_without_turns_left_and_repeated_rows(spark):
    # 1 and 2 begin as 0, which is not there; what is shorter than its cut is left without turns.
    rows = [(c, 0, "user", "hi") for c in (1, 2, 3, 4)] + [(5, 1, "user", "same")] * 6 + [
        (6, 1, "user", "same")] * 3 + [(10, 0, None, "x"), (11, None, "user", None)]
    want = by_hand(rows)
    assert len(want) > 6
    assert result(tries.conversation_trie(frame(spark, rows))) == want


def test_one_conversation_may_hold_most_rows(spark):
    rows = [(0, i, "user", f"t{i % 7}") for i in range(700)] + [(c, i, "user", f"t{i}") for c in (1, 2, 5) for i in range(3)]
    assert result(tries.conversation_trie(frame(spark, rows))) == by_hand(rows)


def test_numbering_goes_on_over_partitions(spark):
    rows = [(1, i // 2, "user", str(i)) for i in range(400)] + [(2, None, "user", "same")] * 300 + [(0, 1, "a", "b")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = tries.ordered_turns(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = defaultdict(list)
    for r in turns:
        seen[r.conv].append(r.pos)
    assert {c: sorted(p) for c, p in seen.items()} == {1: list(range(400)), 2: list(range(300)), 0: [0]}


def test_many_copies_of_one_conversation(spark):
    """Ids that end at one node are put into its digest in many pieces."""
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(-40, 2500) for t in range(2)] + [(3, 0, "user", "other")]
    assert result(tries.conversation_trie(frame(spark, rows))) == by_hand(rows)


def test_no_conversations(spark):
    assert result(tries.conversation_trie(frame(spark, []))) == []
    assert result(tries.conversation_trie(frame(spark, [(None, 1, "user", "x")]))) == []


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    name = "op13_conversation_trie"
    assert oracle.differences(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLES[name]) == []
