"""The conversation trie against one made of Python tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
import xxhash

from nightwarden.llm import prefix_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner string, k1 string, entry string"


def plain(rows):
    """rows: (conv_id, turn, role, text)."""
    def digest(role, text, seed):
        value = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        for part in (role, text):
            value = xxhash.xxh64_intdigest(part.encode(), value)
        return value - (1 << 64) if value >> 63 else value

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, digest(role, text, 1), text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own.get(donor, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(whole.items()):
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted((min(held), len(node), min(members[node[:-1]]) if node else -1, len(held), children[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, ends.get(node, ()))).encode()).hexdigest()) for node, held in members.items())


def found(df):
    assert df.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def tabled(spark, rows):
    return spark.createDataFrame([(*r, "d", "o", "k", "e") for r in rows], SCHEMA)


def test_whole_table(spark, sf_dir):
    table = registry.table(spark, sf_dir, "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert found(registry.QUERIES["op12_prefix_trie"](spark, sf_dir)) == plain(rows)


def test_shared_chains_and_copies(spark):
    """A hot first turn, thousands of equal conversations, long chains and ends inside edges."""
    rng, rows = random.Random(3), []
    for c in range(700):
        n = rng.choice((1, 2, 5, 9, 12, 40))
        pick = c % 3
        for turn in range(n):
            text = f"chain {turn}" if pick == 0 else f"é common {turn}" if pick == 1 and turn < 10 else f"t {rng.randrange(3)}"
            rows.append((c, turn * 2, "user" if turn % 2 == 0 else "assistant", text))
    assert found(prefix_trie.trie(tabled(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (0, None, None, None), (0, 1, "user", None), (0, 1, "user", None), (0, 1, None, "tie"), (0, 1, "user", "tie"),
            (1, 0, "user", "L" * 200_000), (7, 3, "user", "a"), (7, 2, "user", "b"), (10, 0, "", ""), (11, 0, "", ""), (12, 0, "ab", "c"),
            (13, 0, "a", "bc"), (-3, 0, "user", "neg"), (-3, 1, "user", "neg"), (-5, 0, "user", "neg"), (14, None, None, None)]
    rows += [(20 + i, k, "user", f"{k}") for i in range(9) for k in range(i * 3)]
    assert found(prefix_trie.trie(tabled(spark, rows))) == plain(rows)


@pytest.mark.parametrize("batches", [(1.0,), (0.5, 1.0)])
def test_batches_do_not_matter(spark, batches):
    rows = [(c, t, "u", str(t * (1 + c % 4))) for c in range(30) for t in range(c % 13)]
    assert found(prefix_trie.trie(tabled(spark, rows), batches)) == plain(rows)


def test_chunks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(c, t, "u", str(t)) for c in range(12) for t in range(c * 2)]
    assert found(prefix_trie.trie(tabled(spark, rows))) == plain(rows)


def test_empty(spark):
    assert found(prefix_trie.trie(tabled(spark, []))) == []
    assert found(prefix_trie.trie(tabled(spark, [(None, 1, "a", "b")]))) == []
