"""The filter audit against a plain count of every order."""

import re
from itertools import permutations

from nightwarden.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = []
    for i, t, s in rows:
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and t == u for j, u, _ in rows)}
        judged.append((s, {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {s for s, *_ in judged}:
        own = [j[1:] for j in judged if j[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            gone = [False] * len(own)
            for step, f in enumerate(order, 1):
                now = [not g and f in fails for g, (fails, _, _) in zip(gone, own)]
                redundant = sum(g and f in fails for g, (fails, _, _) in zip(gone, own))
                gone = [g or n for g, n in zip(gone, now)]
                removed_by[f] += sum(now)
                out[part, "".join(order), step] = (
                    len(own) - sum(gone), sum(now), redundant, sum(fails == {f} for fails, _, _ in own),
                    sum(n and o[1] for n, o in zip(now, own)), sum(n and o[2] for n, o in zip(now, own)))
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step] += (removed_by[f],)
    return out


def audited(spark, docs, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, mask string, n string, good string, digest string")
    rows = filter_audit.audit(docs, table).collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in rows}


def widened(labels):
    return [(*r, "m", "n", "g", "d") for r in labels]


def test_odd_rows(spark, frame, odd):
    from tests.llm.conftest import ODD
    labels = [(1, 1, 0), (2, 0, 1), (6, 1, None), (6, 0, 1), (None, 1, 1), (8, None, None), (99, 1, 1), (11, 1, 1), (13, 0, 1)]
    assert audited(spark, odd, widened(labels)) == plain(ODD, labels)


def test_copies_across_parts_and_ids(spark, frame):
    rows = [(i, "Same words here", f"s{i % 3}") for i in range(40)] + [(None, "Same words here", "s0"), (0, "Same words here", "s1")]
    rows += [(100 + i, " ".join(f"w{k}" for k in range(60 + i % 2)) + (" #" if i % 5 == 0 else ""), ["", None][i % 2]) for i in range(20)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 120, 2)]
    assert audited(spark, frame(rows), widened(labels)) == plain(rows, labels)


def test_empty_tables(spark, frame, empty):
    assert audited(spark, empty, []) == {}
    found = audited(spark, frame([(1, None, None)]), [])
    assert found == plain([(1, None, None)], []) and len(found) == 600
