"""Near-duplicate documents at a shingle similarity of 0.8, by deletion-variant SimHash signatures.

The method of `simhash`, with room for a fifth of all shingles to differ. A text's word shingles
(five words, A-Z in lower case) give 256 SimHash bits in 12 segments of 21, and 64 more as its
check. Two texts at a similarity of 0.8 differ in about 15 % of all bits, so a segment of theirs
differs in one bit at most with a chance of 0.15, and some segment of twelve with 0.86; at 0.85
the chance is 0.95, at 0.9 0.99. Every class is indexed under its segments with one bit left out.
Classes that meet under a key and whose checks differ in `CHECK_BITS` at most (at 0.8 they differ in
10, strangers in 32) are candidates. Candidates are links if the shingle sets themselves have a
Jaccard similarity of 0.8, and links go to connected components.

Copies share all bits and are one class. Groups stream through their task in blocks of `GROUP`. A
group with few candidates gives them all; any other gives the nearest one before each class in its
block and the first one of the group, and is left open. Once those are links or not, the open
classes of a key that are still in different components are joined with each other, all of them; a
pair inside a component can join nothing more. So no candidate that matters is lost, and only near
texts that are no links make the second step quadratic. What is shuffled is 252 rows of 24 bytes
per class, the open rows, and the shingle hashes of candidates.

Defined cases: a NULL text is an empty one; texts without words are copies of each other; texts of
fewer than five words are near only if all words agree; a NULL doc_id is kept only if its group has
no other; rows that share the smallest doc_id of a group all stay; other columns pass through
whatever their names are; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from nightwarden.llm.components import components
from nightwarden.session import checkpointed, if_small

SHINGLE, SIMILARITY = 5, 0.8
SEGMENTS, SEGMENT_BITS, CHECK_BITS = 12, 21, 20
WORDS = [f"f{i}" for i in range(4)]
GROUP, FEW, SLICE, TEXTS, CACHED = 1024, 4, 1 << 14, 256, 100_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_POWERS = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


class _Hashes(dict):
    """Hash of a word, made once."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def shingles(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(hashes) > CACHED:
        hashes.clear()
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    out = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        out += codes[k:len(out) + k] * _POWERS[k]
    return out


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ _MIX[k]) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def bits(found: np.ndarray) -> list[int]:
    """Five words of 64 SimHash bits, the check first; zero without shingles."""
    out = []
    for k in range(len(_MIX)):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(found), SLICE):
            mixed = _mixed(found[at:at + SLICE], k)
            counts += np.unpackbits(mixed.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint16)
        out.append(int.from_bytes(np.packbits(2 * counts > max(len(found), 1)).tobytes(), "big"))
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            rows = batch.slice(k, TEXTS)
            found = np.array([bits(shingles(t, hashes)) for t in rows.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[:, i].copy()) for i in range(5))],
                                             names=["doc_id", "check", *WORDS])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, check, f0 to f3) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _fingerprints, ", ".join(f"{n} long" for n in ("doc_id", "check", *WORDS)))


def _segment(i: int) -> str:
    """Bits of one segment, three to a word."""
    return f"(shiftrightunsigned(f{i // 3}, {i % 3 * SEGMENT_BITS}) & {(1 << SEGMENT_BITS) - 1}L)"


def variants(nodes: DataFrame) -> DataFrame:
    """(key, check, class): every segment with one bit left out."""
    keys = F.concat(*[F.expr(
        f"transform(sequence(0, {SEGMENT_BITS - 1}), p -> shiftleft({i * SEGMENT_BITS}L + p, {SEGMENT_BITS}) | ({_segment(i)} & ~shiftleft(1L, p)))")
        for i in range(SEGMENTS)])
    return nodes.select(F.explode(keys).alias("key"), "check", "class")


def _near(checks: np.ndarray) -> np.ndarray:
    """Differing bits of each check of a block and those before it; 255 where they are no candidates."""
    apart = np.bitwise_count(checks[:, None] ^ checks[None, :]).astype(np.uint8)
    apart[np.triu_indices(len(checks))] = 255
    apart[apart > CHECK_BITS] = 255
    return apart


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, check, class) to candidates (a, b) without a key, and to open classes (a) with their key.

    A class is open under a key if it has candidates there that are not given.
    """
    key, checks, names = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    first = (None, None, None)

    def rows(a, b):
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    def left_open(a, key):
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(np.full(len(a), key))], names=["a", "b", "key"])

    def group(key, checks, names, part):
        """A group of three or more, or a part of one."""
        at_first = np.bitwise_count(checks[1:] ^ checks[0]) <= CHECK_BITS
        yield from rows(names[1:][at_first], np.full(at_first.sum(), names[0]))
        for at in range(0, len(key), GROUP):
            block = names[at:at + GROUP]
            apart = _near(checks[at:at + GROUP])
            near = apart < 255
            n = int(near.sum())
            if n <= FEW * len(block):
                one, two = np.nonzero(near)
                yield from rows(block[one], block[two])
            else:
                best = apart.argmin(1)
                hit = np.flatnonzero(near.any(1))
                yield from rows(block[hit], block[best[hit]])
            if part or len(key) > GROUP:
                yield from left_open(block, key[0])
            elif n > FEW * len(block):
                yield from left_open(block[near.any(0) | near.any(1)], key[0])

    def done(key, checks, names):
        """Whole groups, or parts of one; the first row of a group stands for its other parts."""
        nonlocal first
        if not len(key):
            return
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        # Most groups are one or two rows.
        twos = starts[sizes == 2]
        twos = twos[np.bitwise_count(checks[twos] ^ checks[twos + 1]) <= CHECK_BITS]
        yield from rows(names[twos + 1], names[twos])
        for s, n in zip(starts, sizes):
            part = s == 0 and first[0] == key[0]
            if n > 2 or part:
                yield from group(key[s:s + n], checks[s:s + n], names[s:s + n], part)
            if part:
                same = np.bitwise_count(checks[s:s + n] ^ first[1]) <= CHECK_BITS
                yield from rows(names[s:s + n][same], np.full(same.sum(), first[2]))
        if first[0] != key[-1]:
            first = key[-1], checks[starts[-1]], names[starts[-1]]

    for batch in batches:
        key = np.append(key, batch.column(0).to_numpy(zero_copy_only=False))
        checks = np.append(checks, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        names = np.append(names, batch.column(2).to_numpy(zero_copy_only=False))
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if len(key) - cut > 4 * GROUP:
            cut = len(key)  # a group that goes on is compared part by part
        yield from done(key[:cut], checks[:cut], names[:cut])
        key, checks, names = key[cut:], checks[cut:], names[cut:]
    yield from done(key, checks, names)


def met(classes: DataFrame) -> DataFrame:
    """(a, b, key): candidates, their key NULL, and open classes, their b NULL."""
    sorted_ = variants(classes).repartition("key").sortWithinPartitions("key", "check")
    return sorted_.mapInArrow(_met, "a long, b long, key long").filter("b IS NULL OR a <> b")


def cross_pairs(opened: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """All candidates (a, b) among open classes (class, key) that are not in one group (class, root)."""
    rooted = opened.join(groups, "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    many = rooted.join(mixed, "key").join(classes.select("class", "check"), "class")
    meet = F.expr(f"l.key = r.key AND l.class < r.class AND l.root <> r.root AND bit_count(l.check ^ r.check) <= {CHECK_BITS}")
    return many.alias("l").join(many.alias("r"), meet).select(F.col("l.class").alias("a"), F.col("r.class").alias("b")).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            rows = batch.slice(k, TEXTS)
            sets = [np.unique(shingles(t, hashes)).view(np.int64) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["class", "found"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3)):
            a, b = (x.values.to_numpy(zero_copy_only=False) for x in (a, b))
            shared = len(np.intersect1d(a, b, assume_unique=True))
            union = len(a) + len(b) - shared
            keep.append(shared >= SIMILARITY * union)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _class() -> Column:
    return F.xxhash64("check", *WORDS)


def _grouped(links: DataFrame) -> DataFrame:
    """(class, root) for every class of a group of two or more."""
    groups = components(links).select(F.col("node").alias("class"), "root")
    return groups.union(groups.select("root", "root").distinct())


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets are similar enough, from the texts."""
    ends = checkpointed(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(classes, "class").select("class", "text_id"))
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), "text").join(if_small(ends), "text_id").select("class", "text")
    sets = checkpointed(texts.dropDuplicates(["class"]).mapInArrow(_sets, "class long, found array<long>"))
    one, two = sets.toDF("a", "found_a"), sets.toDF("b", "found_b")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "found_a", "found_b").mapInArrow(_similar, "a long, b long")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links (a, b) that join by chains all verified candidates among classes: rows (class, check, f0 to f3, text_id)."""
    found = checkpointed(met(classes))
    lead = classes.groupBy("check").agg(F.min("class").alias("lead"))
    same = classes.join(lead, "check").filter("class <> lead").select("lead", "class")
    pairs = found.filter("key IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    linked = checkpointed(_verified(docs, classes, checkpointed(pairs.union(same).distinct())))
    opened = found.filter("key IS NOT NULL").select(F.col("a").alias("class"), "key")
    if opened.isEmpty():
        return linked
    across = checkpointed(cross_pairs(opened, _grouped(linked), classes))
    return linked if across.isEmpty() else linked.union(_verified(docs, classes, across))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class, component_id) of every row; component_id is the smallest doc_id reachable."""
    printed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain(batch):
            return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], names=["text_id", "text"])
        for batch in batches:
            at = 0
            for found in _fingerprints(iter([plain(batch)])):
                ids = batch.column(0).slice(at, found.num_rows)
                at += found.num_rows
                yield pa.RecordBatch.from_arrays([ids, *found.columns], names=["doc_id", "text_id", "check", *WORDS])

    names = ("doc_id", "text_id", "check", *WORDS)
    rows = checkpointed(printed.mapInArrow(run, ", ".join(f"{n} long" for n in names)).withColumn("class", _class()))
    classes = checkpointed(rows.groupBy("class").agg(
        F.min("check").alias("check"), *(F.min(w).alias(w) for w in WORDS), F.min("doc_id").alias("first"), F.min("text_id").alias("text_id")))
    groups = _grouped(links(docs, classes))
    smallest = groups.join(classes, "class").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = groups.join(smallest, "root").select("class", "component_id")
    named = classes.join(linked, "class", "left").select("class", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(named, "class").select("doc_id", "class", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns."""
    ids = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("kept_id")).distinct()
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    return held.join(ids, F.col("doc.doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select("doc.*")
