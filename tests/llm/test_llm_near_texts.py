"""Near-duplicate documents against the similarity of their shingle sets."""

import random
from collections import defaultdict

import pytest

from nightwarden.llm import near_texts
from test_llm_pipeline import plain_near, shingle_set

WORDS = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "klmnp" for d in ("", "s", "nt", "ra")]


def similarity(a, b):
    return len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))


def changed(draw, words, least):
    """A copy with single words changed, as far as the similarity allows."""
    out = list(words)
    while True:
        new = list(out)
        new[draw.randrange(len(new))] = f"x{draw.randrange(10 ** 9)}"
        if similarity(" ".join(words), " ".join(new)) < least:
            return out
        out = new


def test_recall_and_no_false_links(frame):
    draw, rows, pairs = random.Random(4), [], []
    for n in (60, 200, 700):
        for least in (0.8, 0.85, 0.9, 0.7):
            for _ in range(25):
                words = [draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n)]
                other = changed(draw, words, least)
                while least == 0.7 and similarity(" ".join(words), " ".join(other)) >= 0.79:
                    other = changed(draw, words, 0.7)
                pairs.append((least, len(rows), similarity(" ".join(words), " ".join(other))))
                rows += [(len(rows), " ".join(words), "a"), (len(rows) + 1, " ".join(other).upper(), "a")]
    group = {r.doc_id: r.component_id for r in near_texts.near_duplicates(frame(rows)).collect()}
    found = defaultdict(list)
    for least, i, measured in pairs:
        found[least].append(group[i] == group[i + 1])
        assert measured >= 0.8 or group[i] != group[i + 1]
        assert group[i] == i
    assert sum(found[0.8]) >= 0.8 * len(found[0.8])
    assert sum(found[0.85] + found[0.9]) >= 0.95 * len(found[0.85] + found[0.9])


def test_large_groups_of_near_copies(frame, monkeypatch):
    """Thousands of near copies in blocks, beside thousands of exact ones."""
    monkeypatch.setattr(near_texts, "GROUP", 64)
    draw = random.Random(5)
    words = [draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(200)]
    rows = [(i, " ".join(words[:100] + [f"only{i}"] + words[100:]), "a") for i in range(2000)]
    rows += [(5000 + i, "an exact copy of a text of nine words", "b") for i in range(2000)]
    kept = sorted(r.doc_id for r in near_texts.deduplicated(frame(rows)).collect())
    assert kept == [0, 5000]


def test_whole_result(frame):
    draw = random.Random(6)
    base = [[draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(draw.choice((3, 4, 5, 12, 60, 150)))] for _ in range(40)]
    texts = [" ".join(draw.choice([w, changed(draw, w, 0.9)])) for w in base * 5]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(500, None, "a"), (501, "", "b"), (502, " \n ", None)]
    got = sorted(r.doc_id for r in near_texts.deduplicated(frame(rows)).collect())
    assert got == sorted(r[0] for r in plain_near([r for r in rows if r[1] and r[1].split()])) + [500]


def test_odd_and_empty(odd, empty):
    from conftest import ODD
    kept = [r.doc_id for r in near_texts.deduplicated(odd).collect()]
    assert sorted(kept) == [1, 4, 6, 6, 7, 8, 9, 10, 11, 12, 13, 14] and near_texts.deduplicated(odd).columns == odd.columns
    assert len(ODD) > len(kept) and near_texts.deduplicated(empty).count() == 0


def test_links_of_large_groups(spark, monkeypatch):
    """Links whose ends are neither nearest nor first in their group, in several blocks; one pair shares its check."""
    monkeypatch.setattr(near_texts, "GROUP", 16)
    draw = random.Random(8)
    nodes = [(i, sum(1 << b for b in draw.sample(range(64), 4))) for i in range(300)] + [(300, 7), (301, 7), (302, 7)]
    far = [(i, i + 150) for i in range(0, 150, 3)] + [(301, 302), (17, 290)]
    classes = spark.createDataFrame([(i, c - (c >> 63 << 64), 1, 2, 3, 4, i) for i, c in nodes],
                                    "class long, check long, f0 long, f1 long, f2 long, f3 long, text_id long")
    true = spark.createDataFrame(far, "a long, b long")
    monkeypatch.setattr(near_texts, "_verified", lambda docs, classes, pairs: pairs.join(true, ["a", "b"], "left_semi"))
    assert sorted({tuple(r) for r in near_texts.links(None, classes).collect()}) == sorted(far)
