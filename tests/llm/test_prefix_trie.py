import hashlib
import random
import zlib
from collections import defaultdict

from graphloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes of the trie by dictionaries of whole prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        whole[c] = turns.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + turns[c][h:]
        assert base == c % 5 or c < 0
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children, out = defaultdict(set), []
    for p in members:
        if p:
            children[p[:-1]].add(p)

    def below(p):
        todo = [p]
        while todo:
            x = todo.pop()
            yield x
            todo += children[x]

    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[x] for x in below(p)),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below(p) if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(spark, rows, schema=SCHEMA, **sizes):
    df = prefix_trie.trie(spark.createDataFrame(rows, schema), **sizes)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0]))


def talk(rng, n, longest, words=2):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "bot"]), "é" * rng.randint(1, words)))
    return rows


def test_small_blocks_and_many_shards_equal_brute_force(spark):
    rows = talk(random.Random(5), 70, 14, 1)
    assert found(spark, rows, block=3, shard_rows=45, chunk=2) == brute(rows)


def test_one_shard_equals_brute_force(spark):
    rows = talk(random.Random(7), 60, 9)
    assert found(spark, rows) == brute(rows)


def test_a_conversation_held_by_most_members_is_spread_and_hashed_in_order(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(9)]
    rows = same + [(c, t, "user", "other" if t == 7 else f"turn {t}") for c in range(60, 75) for t in range(12)]
    assert found(spark, rows, block=4, shard_rows=8, chunk=3) == brute(rows)


def test_one_very_long_conversation_is_many_small_rows(spark):
    rows = [(1, t, "user", str(t % 7)) for t in range(700)] + [(2, t, "user", str(t % 7)) for t in range(650)] + talk(random.Random(3), 1, 3)
    assert found(spark, rows, block=16, shard_rows=30) == brute(rows)


def test_nulls_negative_ids_equal_turns_and_clashing_columns(spark):
    rows = [(None, 0, "user", "a"), (3, None, None, None), (3, 1, "user", ""), (-7, None, "user", "a"), (-5, 0, None, None), (-5, 2, "user", "b"), (0, 0, "user", "a"), (0, 0, "user", "a")]
    wide = [(*r, 1, "x", "y") for r in rows]
    schema = SCHEMA + ", pos int, a string, own string"
    assert found(spark, wide, schema) == brute(rows)


def test_conversations_without_turns_are_members_of_the_root(spark):
    # 3 and 4 have fewer turns than they give up, and their base has no row.
    rows = [(c, 0, "user", "x") for c in (13, 14, 23, 24, 33, 34)]
    nodes = found(spark, rows)
    assert nodes == brute(rows)
    assert nodes[0][3] == 6


def test_an_empty_table_has_no_nodes(spark):
    assert found(spark, []) == []
