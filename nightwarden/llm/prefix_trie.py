"""Z-fast trie of conversations.

A node is a distinct sequence of first turns. It is known by its depth and 128 bits that are
the exclusive or of one position-salted digest a turn, so a prefix's key is a running value and
texts are read once and never shuffled.

Batches. Conversations enter in the order of a hash of their id, few first. A node belongs to
the conversation that entered first among its members (its owner), so what a conversation adds
to the trie is one run of its own depths, its segment, which hangs on a node of an earlier one.
As the order is random, a path to the root crosses O(log n) segments.

Handles. Compacted nodes are the root, the ends of conversations and the branching nodes. Each
stands in a hash table under the key at the two-fattest depth of its edge: the number in
(parent depth, own depth] that most powers of two divide.

Fat binary search. All conversations of a batch halve their interval of depths together: one
equality join fetches the keys at the two-fattest depths, one looks them up among the handles.
After log2(longest) rounds each has the last handle on its path. Only keys beyond that handle
meet the table of nodes; those that are absent there are what the batch inserts.

Expansion. Ends are counted per compacted node, summed over segments, and handed to the O(log n)
segments above. Running sums inside a segment then give every node of every edge its figures.

Defined cases: rows with a NULL conv_id belong to no conversation and make no node; NULL turns
come first, rows of the same turn follow role, then a digest of the text, so reruns agree;
repeated rows are turns of their own; NULL role or text is empty; a conversation left without
turns is a member of the root alone; other columns are not read; an empty table gives no rows.
Windows run over the turns of one conversation, chunked where keys are scanned, on rows of a few
numbers that Spark sorts on disk where needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from nightwarden.session import checkpointed

#: The share of all hashes that has entered after each batch.
BATCHES = (1 / 64, 1 / 8, 1.0)
CHUNK = 4096
KEY = ["depth", "k1", "k2"]
SHARED, FAMILY = 9, 5


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, x1, x2, bytes) after the shared beginnings, and every (conv_id, length)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digests = [F.xxhash64(F.lit(seed), role, text).alias(f"x{seed}") for seed in (1, 2)]
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), *digests, F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "x1", "x2")
    turns = checkpointed(rows.select("conv_id", F.row_number().over(order).alias("pos"), "x1", "x2", "bytes"))
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    plan = lengths.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("donor"), (crc % SHARED).cast("int").alias("h"))
    held = lengths.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    plan = checkpointed(plan.join(held, "donor", "left").select(
        "conv_id", "n", "donor", "h", F.least("h", F.coalesce("donor_n", F.lit(0))).alias("given")))
    heads = turns.filter(F.col("pos") < SHARED).withColumnRenamed("conv_id", "donor")
    first = plan.select("conv_id", "donor", "given").join(heads, "donor").filter("pos <= given").select("conv_id", "pos", "x1", "x2", "bytes")
    own = turns.join(plan.select("conv_id", "h", "given"), "conv_id").filter("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "x1", "x2", "bytes")
    sized = plan.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return first.union(own), sized


def prefixes(turns: DataFrame, sized: DataFrame) -> DataFrame:
    """(conv_id, entry, depth, k1, k2, bytes) for every prefix, the empty one included.

    `entry` orders the conversations. Keys run inside chunks of a conversation; what enters a
    chunk is the running key over the few totals of its earlier chunks.
    """
    salted = turns.select("conv_id", F.col("pos").alias("depth"), "bytes", F.floor(F.col("pos") / CHUNK).alias("chunk"),
                          *(F.xxhash64(F.lit(s), "pos", "x1", "x2").alias(f"t{s}") for s in (1, 2)))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    local = salted.select("conv_id", "chunk", "depth", "bytes", *(F.bit_xor(f"t{s}").over(inside).alias(f"k{s}") for s in (1, 2)))
    totals = salted.groupBy("conv_id", "chunk").agg(F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "chunk", *(F.bit_xor(f"t{s}").over(earlier).alias(f"c{s}") for s in (1, 2))).filter("c1 IS NOT NULL")
    keyed = local.join(carried, ["conv_id", "chunk"], "left").select(
        "conv_id", "depth", *(F.col(f"k{s}").bitwiseXOR(F.coalesce(f"c{s}", F.lit(0))).alias(f"k{s}") for s in (1, 2)), "bytes")
    zero = F.lit(0).cast("long")
    roots = sized.select("conv_id", F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("bytes"))
    return keyed.union(roots).select("conv_id", F.xxhash64(F.lit(7), "conv_id").alias("entry"), *KEY, "bytes")


def fattest(low: str, high: str) -> Column:
    """The number in (low, high] that most powers of two divide, for low < high."""
    return F.expr(f"CAST(({high} >> CAST(floor(log2({low} ^ {high})) AS INT)) << CAST(floor(log2({low} ^ {high})) AS INT) AS INT)")


def compacted(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Compacted nodes (owner, depth, k1, k2, above) of nodes (owner, entry, depth, k1, k2, p1, p2, bytes).

    `above` is the depth of the compacted node above, -1 over the root.
    """
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("children")).filter("children > 1")
    zero = F.lit(0).cast("long")
    root = nodes.filter("depth = 0").select("depth", zero.alias("k1"), zero.alias("k2"))
    chosen = children.select(*KEY).union(ends.select(*KEY)).union(root).distinct()
    tops = nodes.groupBy("owner").agg((F.min("depth") - 1).alias("top"))
    order = Window.partitionBy("owner").orderBy("depth")
    return nodes.join(chosen, KEY).join(tops, "owner").select(
        "owner", *KEY, F.coalesce(F.lag("depth").over(order), "top").alias("above"))


def handles(nodes: DataFrame, packed: DataFrame) -> DataFrame:
    """(depth, k1, k2, extent): the key at each compacted node's two-fattest depth."""
    at = packed.filter("depth > 0").select("owner", fattest("above", "depth").alias("fat"), F.col("depth").alias("extent"))
    return nodes.withColumnRenamed("depth", "fat").join(at, ["owner", "fat"]).select(F.col("fat").alias("depth"), "k1", "k2", "extent")


def located(batch: DataFrame, sized: DataFrame, table: DataFrame) -> DataFrame:
    """(conv_id, known): the depth of the last handle on each conversation's path, by fat binary search."""
    longest = sized.agg(F.max("length")).first()[0] or 0
    state = sized.select("conv_id", F.lit(0).alias("low"), F.col("length").alias("high"), F.lit(0).alias("known"))
    hits = table.withColumnRenamed("depth", "fat")
    for _ in range(int(longest).bit_length()):
        asked = state.withColumn("fat", F.when(F.col("low") < F.col("high"), fattest("low", "high")))
        keys = batch.select("conv_id", F.col("depth").alias("fat"), "k1", "k2")
        found = asked.join(keys, ["conv_id", "fat"], "left").join(hits, ["fat", "k1", "k2"], "left")
        hit = F.col("extent").isNotNull()
        state = checkpointed(found.select(
            "conv_id", F.when(hit, F.col("extent")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("fat").isNotNull() & ~hit, F.col("fat") - 1).otherwise(F.col("high")).alias("high"),
            F.when(hit, F.col("fat")).otherwise(F.col("known")).alias("known")))
    return state.select("conv_id", "known")


def inserted(beyond: DataFrame) -> DataFrame:
    """New nodes of prefixes that are not in the trie yet; the first to enter owns a node."""
    return beyond.groupBy(*KEY).agg(F.min(F.struct("entry", "conv_id", "p1", "p2", "bytes")).alias("v")).select(
        F.col("v.conv_id").alias("owner"), "v.entry", *KEY, "v.p1", "v.p2", "v.bytes")


def built(paths: DataFrame, sized: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """All nodes (owner, entry, depth, k1, k2, p1, p2, bytes), batch by batch.

    `paths` are prefixes() with the key (p1, p2) of the prefix one turn shorter.
    """
    nodes, low = None, -float(1 << 63)
    for share in batches:
        high = -float(1 << 63) + share * float(1 << 64)
        batch = paths.filter((F.col("entry") >= F.lit(low)) & (F.col("entry") < F.lit(high) if share < 1 else F.lit(True)))
        if nodes is None:
            nodes = checkpointed(inserted(batch))
        else:
            members = sized.join(batch.filter("depth = 0").select("conv_id"), "conv_id")
            known_ends = paths.filter(F.col("entry") < F.lit(low)).join(
                sized.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select(*KEY)
            table = checkpointed(handles(nodes, compacted(nodes, known_ends)))
            reached = located(batch, members, table)
            # The root is known once anything is; an empty trie takes it with the batch.
            start = F.when(F.lit(nodes.limit(1).count() > 0), F.col("known")).otherwise(-1)
            beyond = batch.join(reached, "conv_id").filter(F.col("depth") > start).drop("known")
            nodes = checkpointed(nodes.unionByName(inserted(beyond.join(nodes.select(*KEY), KEY, "left_anti"))))
        low = high
    return nodes


def segments(nodes: DataFrame) -> DataFrame:
    """(owner, chain): the (owner, depth) nodes that each segment's way to the root turns off at."""
    tops = nodes.groupBy("owner").agg(F.min(F.struct("depth", "p1", "p2")).alias("t"))
    tops = tops.select("owner", (F.col("t.depth") - 1).alias("depth"), F.col("t.p1").alias("k1"), F.col("t.p2").alias("k2"))
    on = nodes.select(F.col("owner").alias("host"), *KEY)
    hung = checkpointed(tops.join(on, KEY, "left").select("owner", "host", F.col("depth").alias("at")))
    link = F.array(F.struct(F.col("host").alias("owner"), F.col("at").alias("depth")))
    done = level = checkpointed(hung.filter("host IS NULL").select("owner", F.array().cast("array<struct<owner:bigint,depth:int>>").alias("chain")))
    while True:
        below = hung.join(level.select(F.col("owner").alias("host"), "chain"), "host")
        level = checkpointed(below.select("owner", F.concat(link, "chain").alias("chain")))
        if not level.limit(1).count():
            return checkpointed(done)
        done = done.union(level)


def handed_up(own: DataFrame, chains: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Figures of each segment (owner, *sums) added up at every node above it: (owner, depth, *sums)."""
    spread = own.join(chains, "owner").select(F.explode("chain").alias("to"), *sums)
    return spread.groupBy(F.col("to.owner").alias("owner"), F.col("to.depth").alias("depth")).agg(
        *(getattr(F, how)(name).alias(name) for name, how in sums.items()))


def digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): one running SHA-256 a node over its ends in rising order.

    Rows stream in sorted order, so a node where very many conversations end holds no list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = [*KEY, "ends_sha256"], [pa.int32(), pa.int64(), pa.int64(), pa.string()]
        last, state = None, None
        for batch in batches:
            out = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if state:
                        out.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kind)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*last, state.hexdigest()), kind)], names)

    rows = ends.select(F.col("depth").cast("int"), "k1", "k2", "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return rows.mapInArrow(run, "depth int, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """One row a node: its smallest member, depth, parent, and the figures of its subtree."""
    turns, sized = rebuilt(conversations)
    sized = checkpointed(sized)
    keyed = checkpointed(prefixes(turns, sized))
    step = Window.partitionBy("conv_id").orderBy("depth")
    paths = checkpointed(keyed.select("*", F.lag("k1").over(step).alias("p1"), F.lag("k2").over(step).alias("p2")))
    nodes = built(paths, sized, batches)
    ends = checkpointed(paths.join(sized.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("conv_id", *KEY))
    chains = segments(nodes)

    # Compacted nodes with their ends, children and whether they are a leaf.
    closing = ends.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    branches = chains.filter(F.size("chain") > 0).groupBy(
        F.get("chain", F.lit(0))["owner"].alias("owner"), F.get("chain", F.lit(0))["depth"].alias("depth")).agg(F.count("*").alias("hung"))
    bottom = nodes.groupBy("owner").agg(F.max("depth").alias("bottom"))
    nothing = F.lit(0).cast("long")
    packed = compacted(nodes, ends).join(closing, KEY, "left").join(branches, ["owner", "depth"], "left").join(bottom, "owner").select(
        "owner", "depth", "above", F.coalesce("n", nothing).alias("n"), "least",
        (F.coalesce("hung", nothing) + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"))
    packed = checkpointed(packed.withColumn("leaves", (F.col("n_children") == 0).cast("long")))
    figures = {"n": "sum", "least": "min", "leaves": "sum"}
    whole = packed.groupBy("owner").agg(*(getattr(F, how)(c).alias(c) for c, how in figures.items()))
    from_below = handed_up(whole, chains, figures).select("owner", "depth", *(F.col(c).alias(f"below_{c}") for c in figures))
    upwards = Window.partitionBy("owner").orderBy(F.col("depth").desc())
    joined = packed.join(from_below, ["owner", "depth"], "left")
    counted = checkpointed(joined.select(
        "owner", "depth", "n_children",
        F.sum(F.col("n") + F.coalesce("below_n", nothing)).over(upwards).alias("n_convs"),
        F.min(F.least("least", "below_least")).over(upwards).alias("conv"),
        F.sum(F.col("leaves") + F.coalesce("below_leaves", nothing)).over(upwards).alias("n_leaves")))

    # Edges expand: a node inside one has its lower end's members.
    def below(name: str) -> Column:
        return F.last(name, ignorenulls=True).over(upwards)

    spread = nodes.select("owner", *KEY, "bytes").join(counted, ["owner", "depth"], "left")
    filled = checkpointed(spread.select(
        "owner", *KEY, F.coalesce("n_children", F.lit(1).cast("long")).alias("n_children"),
        *(below(c).alias(c) for c in ("n_convs", "conv", "n_leaves")), ((below("n_convs") - 1) * F.col("bytes")).alias("saved")))
    saved = handed_up(filled.groupBy("owner").agg(F.sum("saved").alias("saved")), chains, {"saved": "sum"})
    tops = chains.filter(F.size("chain") > 0).select("owner", F.get("chain", F.lit(0)).alias("on"))
    hosts = filled.select(F.struct("owner", "depth").alias("on"), F.col("conv").alias("host_conv"))
    parents = tops.join(hosts, "on").select("owner", "host_conv")
    along = Window.partitionBy("owner").orderBy("depth")
    rows = filled.join(saved.withColumnRenamed("saved", "more"), ["owner", "depth"], "left").join(parents, "owner", "left").select(
        *KEY, "conv", "n_convs", "n_children", "n_leaves", F.coalesce(F.lag("conv").over(along), "host_conv").alias("parent"),
        F.sum(F.col("saved") + F.coalesce("more", nothing)).over(upwards).alias("saved_tokens"))
    return rows.join(digests(ends), KEY, "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
