"""Quality rules against plain Python."""

import re
from collections import Counter

from nightwarden.llm import quality_rules as rules


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_measurements(odd):
    got = rules.ledger(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = [(r["doc_id"], *measured(r["text"])) for r in odd.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_policies_and_ablation(odd, empty):
    ledger = rules.ledger(odd)
    kept = rules.filtered(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {
        r["doc_id"] for r in ledger.filter(rules.passes(rules.PRODUCTION)).collect()}
    bits = [r["failed_bits"] for r in ledger.collect()]
    for row in rules.ablation(ledger, rules.PRODUCTION).collect():
        bit = 1 << next(r.bit for r in rules.RULES if r.name == row["rule"])
        mask = rules.PRODUCTION.mask
        assert row["failed"] == sum(b & bit > 0 for b in bits)
        assert row["only"] == sum(b & mask == bit for b in bits)
        assert row["rejected"] == sum(b & mask > 0 for b in bits)
    assert rules.ledger(empty).count() == 0 and rules.filtered(empty).count() == 0
    assert {r["rejected"] for r in rules.ablation(rules.ledger(empty), rules.BASE).collect()} == {0}
