"""Token ids, packing and mixing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from nightwarden.llm import mixing, packing
from nightwarden.llm.registry import vocabulary
from nightwarden.llm.tokens import Encoder


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocabulary())


def test_cached_units_give_whole_encoding(plain):
    draw = random.Random(1)
    signs = ["a", "B", "é", "Ö", "ß", "'s", "'S", "'", "9", "²", "½", "!", "_", "\x1c", "\x85", "\xa0", "İ", "ǅ", "Ĳ", "́", "Σ",
             "<|endoftext|>", "<|startoftext|>", "　", "\U0001f600", " ", "\n", "\t", "the", "ing", "Å", "ǆ", "ŉ"]
    texts = [None, "", " "] + ["".join(draw.choices(signs, k=draw.randint(1, 40))) for _ in range(1500)]
    got = Encoder(vocabulary()).ids(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_every_character_of_the_short_cut(plain):
    """Each character it admits, at the start, inside and at the end of a word, alone and beside signs."""
    encoder = Encoder(vocabulary())
    admitted = [c for c in map(chr, range(0x3000)) if encoder._simple(c)]
    assert {"a", "é", "ǆ", "\u024f"} <= set(admitted)
    texts = [t for c in admitted for t in (c, f"{c}li", f"Fo{c}en", f"de{c}", f"({c}li)", f"7{c}'s x")]
    texts += ["Əli", "Ɛwe", "FƆN", "Ɖe", "(Əli)", "Ⱥ Ⱦa aɄ Ɂ"]
    for text, ids in zip(texts, encoder.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_and_places(odd, empty, plain):
    capacity = 64
    rows = [r.asDict() for r in packing.packed(odd, vocabulary(), capacity, 0).collect()]
    expected = []
    for d in odd.collect():
        ids = plain.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4")
            expected.append((d["doc_id"], n, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(expected, key=repr)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.packed(empty, vocabulary()).count() == 0


def best_fit_decreasing(counts, capacity):
    rooms = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    draw = random.Random(seed)
    capacity = 100
    lengths = [min(capacity, max(1, int(draw.expovariate(1 / (10 + 6 * seed))))) for _ in range(400)]
    plan = packing.Plan(dict(Counter(lengths)), capacity)
    used, large = Counter(), Counter()
    for n, (start, first, each, offset) in plan.places().items():
        total = Counter(lengths)[n]
        seen = Counter()
        for k in range(total):
            run = np.searchsorted(start, k, "right") - 1
            inside = k - start[run]
            sequence = int(first[run] + inside // each[run])
            seen[sequence, int(offset[run] + inside % each[run] * n)] += 1
            used[sequence] += n
            large[sequence] += 3 * n > capacity
        assert max(seen.values()) == 1
    assert sum(used.values()) == sum(lengths) and max(used.values()) <= capacity and max(large.values()) <= 2
    assert len(used) == plan.sequences <= best_fit_decreasing(dict(Counter(lengths)), capacity) + 1
    assert packing.Plan({}, capacity).sequences == 0


def water(sizes, weights, share, repeats):
    """Targets by resharing what is cut off until nothing is above its limit."""
    goal, target, free = share * sum(sizes.values()), {}, dict(weights)
    while True:
        left = goal - sum(target.values())
        unit = left / sum(free.values()) if free else 0
        over = [s for s in free if unit * free[s] > repeats * sizes[s] + 1e-9]
        if not over:
            return target | {s: unit * w for s, w in free.items()}
        for s in over:
            target[s] = repeats * sizes[s]
            del free[s]


def test_mix(frame, odd, empty):
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.randint(0, 60)), draw.choice(["a", "b", "b", "b", "c", None, "é"])) for i in range(900)]
    docs = frame(rows)
    mix = mixing.mix(mixing.sizes(docs)).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    taken, largest = Counter(), Counter()
    for r in mix:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(mixing.sizes(docs.repartition(7))).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in mix)
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    held = {i: len(t.split()) for i, t, _ in rows}
    words = Counter()
    for r in copies.collect():
        words[r["doc_id"]] += held[r["doc_id"]]
    assert {r["doc_id"]: r["taken"] for r in mix if r["taken"]} == {i: n for i, n in words.items() if n}
    assert mixing.mix(mixing.sizes(odd)).count() == odd.count() and mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(mixing.sizes(empty)).count() == 0 and mixing.mixed(empty).count() == 0


def test_place_prefers_weight(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("draw"), F.lit(0.3).alias("fraction"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    drawn = rows.withColumn("place", mixing.place(1, F.col("w"))).orderBy("place").limit(6000).groupBy("w").count().collect()
    share = {r["w"]: r["count"] for r in drawn}
    assert 1.3 < share[3.0] / share[1.0] < 2.6


def test_rows_without_ids_draw_by_text_and_long_ones_more_often(frame):
    rows = [(None, f"word{i} " * (20 if i % 2 else 600), "a") for i in range(400)] + [(i, "w " * 2000, "b") for i in range(30)]
    mix = [r for r in mixing.mix(mixing.sizes(frame(rows))).collect() if r.doc_id is None]
    assert abs(sum(r.taken for r in mix) - mix[0].target) <= 300 and mix[0].target % mix[0].source_size
    extra = {n: sum(r.taken > r.size * (mix[0].target // mix[0].source_size) for r in mix if r.size == n) for n in (20, 600)}
    assert extra[600] > 1.3 * extra[20] > 0
