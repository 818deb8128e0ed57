"""SimHash fingerprints, links and components against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from nightwarden.llm import simhash
from nightwarden.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def plain_groups(fps):
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    groups = plain_components(near + [(a, a) for a in fps])
    return sorted(sorted(g) for g in {r: [x for x in groups if groups[x] == r] for r in groups.values()}.values())


def random_fps(draw, centres, copies, flips):
    fps = set()
    for _ in range(centres):
        centre = draw.getrandbits(64)
        for _ in range(copies):
            fp = centre
            for _ in range(draw.randint(0, flips)):
                fp ^= 1 << draw.randrange(64)
            fps.add(fp)
    return sorted(fps)


def test_fingerprints(odd):
    got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.fingerprints(odd).collect()), key=repr)
    assert got == sorted(((r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()), key=repr)


def linked(spark, fps):
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    pairs = [(unsigned(r["a"]), unsigned(r["b"])) for r in links]
    assert len({p for p in pairs}) <= 70 * len(fps)
    groups = plain_components(pairs + [(f, f) for f in fps])
    return sorted(sorted(x for x in groups if groups[x] == r) for r in set(groups.values()))


def test_links_small_groups(spark):
    fps = random_fps(random.Random(3), 60, 4, 4)
    assert linked(spark, fps) == plain_groups(fps)


def test_links_refined(spark, monkeypatch):
    """Groups above the limit go through the second level, in streams and in whole batches."""
    fps = random_fps(random.Random(4), 2, 250, 5)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    keyed = sorted((r["key"], r["fp"] & (1 << 64) - 1) for r in simhash.variants(spark.createDataFrame(signed, "fp long")).collect())
    monkeypatch.setattr(simhash, "GROUP", 20)

    def run(rows, refine, step):
        rows = sorted(rows)
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i:i + step]], pa.int64()),
                                               pa.array(np.array([f for _, f in rows[i:i + step]], np.uint64).view(np.int64))], names=["key", "fp"])
                   for i in range(0, len(rows), step)]
        out = [r for b in simhash._compare(refine)(iter(batches)) for r in b.to_pylist()]
        wide = lambda x: x & (1 << 64) - 1
        return [(wide(r["a"]), wide(r["b"])) for r in out if not r["refine"]], [(r["b"], wide(r["a"])) for r in out if r["refine"]]

    for step in (7, 64, 100_000):
        links, again = run(keyed, True, step)
        assert again
        more, none = run(set(again), False, step)
        assert not none
        groups = plain_components(links + more + [(f, f) for f in fps])
        assert sorted(sorted(x for x in groups if groups[x] == r) for r in set(groups.values())) == plain_groups(fps)


def test_forest_by_flips(monkeypatch):
    draw = random.Random(5)
    base = draw.getrandbits(64)
    fps = np.array(sorted({base ^ sum(1 << draw.choice([1, 5, 9, 30, 31, 40, 41, 50, 51, 52]) for _ in range(4)) & (1 << 64) - 1 for _ in range(90)}), np.uint64)
    direct = simhash.forest(fps)
    monkeypatch.setattr(simhash, "GROUP", 1)
    assert (simhash.forest(fps) == direct).all()


def test_components(spark):
    draw = random.Random(6)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    want = {k: v for k, v in plain_components(pairs).items() if k != v}
    assert got == want
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_near_duplicates(odd, empty):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()]
    groups = plain_components([(a, b) for _, a in rows for _, b in rows if (a ^ b).bit_count() <= 3])
    first = {g: min((i for i, f in rows if groups[f] == g and i is not None), default=None) for g in set(groups.values())}
    want = sorted(((i, f, first[groups[f]]) for i, f in rows), key=repr)
    got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=repr)
    assert got == want
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {v for v in first.values()}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0
