"""Filter interaction audit: what every filter removes, in every order, from one pass over the texts.

A document's failures are one mask of five bits. Only the counts per (part, mask) matter to the
audit, so documents are folded into at most 32 cells a part before any order is looked at. Each
cell is then folded across the array of all 120 orders: `aggregate` walks the five steps of an
order with the mask of the filters applied so far, `transform` does so for every order, and the
600 resulting structs carry the cell's counts. The cells of a part merge by elementwise sums.

The filters A to D read the text alone; E asks for an equal text under a smaller doc_id. Rows
are therefore counted by (text digest, part, other bits, labels, doc_id) first, so copies shrink
before they meet, and a digest's smallest doc_id is a partially aggregated minimum. What is
shuffled is one narrow row a document.

Defined cases: a NULL text is empty; a NULL source is the part "", together with the source "";
a NULL doc_id has no label, never fails E and makes no other row fail it; rows that share a
doc_id do not fail E through each other; a doc_id labelled more than once is good if any label
says so, and toxic likewise; NULL labels say nothing; columns beside those named are not read;
an empty table has no part and gives no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from nightwarden.llm.text import let, whole, words
from nightwarden.session import checkpointed

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_mask(text: Column) -> Column:
    """Failure bits of the filters A to D, for a text that is not NULL."""

    def judge(t: Column) -> Column:
        def with_words(w: Column) -> Column:
            n = F.size(w)
            fails = {
                "A": n < 50,
                "B": 100 * F.size(F.array_distinct(w)).cast("long") < 65 * n.cast("long"),
                "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > 5 * F.length(t).cast("long"),
                "D": t.rlike(r"[#$%&*|]"),
            }
            return sum((F.when(c, _bit(f)).otherwise(0) for f, c in fails.items()), F.lit(0))
        return let(words(t), with_words)

    return let(text, judge)


def masks(docs: DataFrame) -> DataFrame:
    """(digest, part, mask of A to D, doc_id) of every row; texts go no further."""
    text = whole("text")
    return docs.select(
        F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce("source", F.lit("")).alias("part"),
        text_mask(text).alias("mask"), F.col("doc_id").cast("long").alias("doc_id"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by all five failures."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    labelled = masks(docs).join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    groups = ["digest", "part", "mask", "good", "toxic"]
    # The rows of a group under its own smallest id are all that may pass E.
    per_id = labelled.groupBy("doc_id", *groups).agg(F.count("*").alias("n"))
    copies = checkpointed(per_id.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first_id"), F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null")))
    first = copies.groupBy("digest").agg(F.min("first_id").alias("smallest"))
    own = F.when(F.col("first_id") == F.col("smallest"), F.col("n_first")).otherwise(0)
    passing = own + F.col("n_null")
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), passing.alias("n")),
        F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - passing).alias("n"))))
    judged = copies.join(first, "digest").select("part", "good", "toxic", split.alias("cell")).select(
        "part", "good", "toxic", "cell.mask", "cell.n").filter("n > 0")
    return judged.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


#: The 120 orders as one constant array of arrays of filter bits, sent with every task.
ORDER_ARRAY = f"array({', '.join('array(' + ', '.join(str(_bit(f)) for f in o) + ')' for o in ORDERS)})"

_STEP = """named_struct(
    'kept', IF((c.mask & (s.seen | f)) = 0, c.n, 0L),
    'removed', IF((c.mask & f) <> 0 AND (c.mask & s.seen) = 0, c.n, 0L),
    'redundant', IF((c.mask & f) <> 0 AND (c.mask & s.seen) <> 0, c.n, 0L),
    'unique_fails', IF(c.mask = f, c.n, 0L),
    'good_lost', IF((c.mask & f) <> 0 AND (c.mask & s.seen) = 0, c.good, 0L),
    'toxic_lost', IF((c.mask & f) <> 0 AND (c.mask & s.seen) = 0, c.toxic, 0L))"""

_STRUCT = f"struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>"

#: One cell c across all orders: 600 structs, step by step of order by order.
FOLD = f"""flatten(transform({ORDER_ARRAY}, o -> aggregate(o,
    named_struct('seen', 0, 'steps', cast(array() AS array<{_STRUCT}>)),
    (s, f) -> named_struct('seen', s.seen | f, 'steps', concat(s.steps, array({_STEP}))),
    s -> s.steps)))"""

_SUM = "named_struct(" + ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS) + ")"
_ZERO = "named_struct(" + ", ".join(f"'{c}', 0L" for c in COUNTS) + ")"

#: All cells of a part: their 600 structs merged by elementwise sums.
MERGED = f"aggregate(cells, array_repeat({_ZERO}, {5 * len(ORDERS)}), (a, c) -> zip_with(a, {FOLD}, (x, y) -> {_SUM}))"

#: Each filter's removed over all orders, whatever its step.
SHAPLEY = f"""transform(array({', '.join(str(_bit(f)) for f in FILTERS)}), g -> aggregate(
    zip_with(flatten({ORDER_ARRAY}), merged, (f, m) -> IF(f = g, m.removed, 0L)), 0L, (a, b) -> a + b))"""


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows a part: part, filter_order, step, the six counts and the filter's shapley."""
    # At most 32 cells a part are ever gathered.
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    folded = parts.select("part", F.expr(MERGED).alias("merged")).select("part", "merged", F.expr(SHAPLEY).alias("shapleys"))
    steps = folded.select("part", "shapleys", F.posexplode("merged").alias("at", "m"))
    order = F.get(F.array(*map(F.lit, ORDERS)), F.floor(F.col("at") / 5).cast("int"))
    rows = steps.select("part", order.alias("filter_order"), (F.col("at") % 5 + 1).cast("int").alias("step"), "m.*", "shapleys")
    letter = F.expr("ascii(substring(filter_order, step, 1))") - ord("A")
    return rows.withColumn("shapley", F.get("shapleys", letter)).drop("shapleys")
