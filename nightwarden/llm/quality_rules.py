"""Quality rules as a bitmask ledger: measure and judge once, decide by policy later.

`ledger` reads each document once and stores its measurements and one failure bit per rule.
A `Policy` is a versioned set of rules; `decide` applies it as one bitwise test, and
`ablation` says what every rule costs by aggregating the bits. Nothing is shuffled but the
few sums of `ablation`.

Defined cases: a NULL text has no words, as an empty one has; every row of the input gives
one row of the ledger, repeated rows and NULL ids included; an empty table gives an empty
ledger; input columns that clash with a measurement do not matter, as only `id_col` and
`text_col` are read. A document whose bits no policy rule meets is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from nightwarden.llm.text import let, whole, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
BITS = "failed_bits"


@dataclass(frozen=True)
class Rule:
    """One test over the measurements; `bit` is its place in the ledger for good."""

    bit: int
    name: str
    fails: Callable[[], Column]


#: Limits are shares of words or lines, written without division so that empty texts are defined.
RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 10),
    Rule(1, "repeated_windows", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule(2, "many_symbols", lambda: 100 * F.col("n_symbols") > 20 * F.col("n_words")),
    Rule(3, "repeated_lines", lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    Rule(4, "short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule(5, "long_words", lambda: F.col("word_chars") > 25 * F.col("n_words")),
)


@dataclass(frozen=True)
class Policy:
    """A version of what a document must not fail."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {rule.name: rule.bit for rule in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
#: Repeated lines stay in the ledger for ablation only: sound documents carry licence and menu lines.
PRODUCTION = Policy("production-1", BASE.rules + ("many_symbols", "short_words", "long_words"))


def _repeat_words(found: Column) -> Column:
    """Words inside windows of five words that the text holds twice or more."""
    count = F.size(found)
    hashes = F.transform(found, lambda w: F.xxhash64(w))

    def window_hashes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(hashed: Column) -> Column:
        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]).eqNullSafe(True)
                             | (F.get(s, i + 1)["h"] == x["h"]).eqNullSafe(True))
            return F.sort_array(F.transform(again, lambda x: x["at"]))

        ordered = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        start = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(let(ordered, places), start, lambda a, at: F.struct(
            (a["sum"] + F.least(F.lit(WINDOW), at - a["last"])).alias("sum"), at.alias("last")))["sum"]

    repeats = let(let(hashes, window_hashes), lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(count < WINDOW, 0).otherwise(repeats)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements (long) and `failed_bits`, bit r set if rule r fails."""
    text = whole(docs[text_col])
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    measured = (
        docs.select(docs[id_col].alias(id_col), words(text).alias("words"), lines.alias("lines"),
                    F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"))
        .select(id_col, F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
                "n_symbols", F.size("lines").alias("n_lines"),
                (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                _repeat_words(F.col("words")).alias("n_repeat_words"))
    )
    counts = [F.col(c).cast("long").alias(c) for c in measured.columns[1:]]
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), 1 << rule.bit).otherwise(0).cast("long"))
    return measured.select(id_col, *counts).withColumn(BITS, bits)


def passes(policy: Policy, bits: Column | str = BITS) -> Column:
    """True where none of the policy's rules failed."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail nothing else, and that any rule rejects.

    `only` is what comes back if the rule is left out. One partial aggregation over the bits;
    an empty ledger gives counts of zero.
    """
    failed = F.col(BITS).bitwiseAND(F.lit(policy.mask).cast("long"))
    chosen = [rule for rule in RULES if rule.name in policy.rules]
    sums = [F.count_if(failed != 0).alias("rejected")]
    for rule in chosen:
        bit = F.lit(1 << rule.bit).cast("long")
        sums += [F.count_if(failed.bitwiseAND(bit) != 0).alias(f"failed_{rule.bit}"),
                 F.count_if(failed == bit).alias(f"only_{rule.bit}")]
    counts = F.explode(F.array(*[
        F.struct(F.lit(policy.version).alias("version"), F.lit(rule.name).alias("rule"),
                 F.col(f"failed_{rule.bit}").alias("failed"), F.col(f"only_{rule.bit}").alias("only"),
                 F.col("rejected")) for rule in chosen])).alias("r")
    return rows.agg(*sums).select(counts).select("r.*")


def filtered(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The documents that the policy keeps, with all their columns; one pass, no join."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    text = held.select(F.col("doc"), F.col("doc")["text"].alias("text"))
    return ledger(text, "doc", "text").filter(passes(policy)).select("doc.*")
