"""The pipeline stage by stage and as a whole against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from nightwarden.llm.registry import vocabulary
from test_llm_lines import corpus, plain_drops
from test_llm_packing import water
from test_llm_rules import measured
from tests_llm_plain import groups_of


def plain_rules(rows):
    def kept(text):
        n, chars, symbols, _, again = measured(text)
        return not (n < 10 or 100 * again > 20 * n or 100 * symbols > 20 * n or chars < 2 * n or chars > 25 * n)
    return [r for r in rows if kept(r[1])]


def plain_lines(rows):
    drops, _ = plain_drops(list(dict.fromkeys((i, t) for i, t, _ in rows)))
    out = []
    for i, t, s in rows:
        gone = drops.get((i, t), set())
        new = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        if not gone or new.split():
            out.append((i, new, s))
    return out


def shingle_set(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    keep = {min(rows[i][0] for i in group) for group in groups_of(range(len(rows)), near)}
    return [r for r in rows if r[0] in keep]


def plain_mix(rows):
    size = lambda t: len((t or "").split())
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(s for s in total if s is not None) + [None] * (None in total)
    target = water(total, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    out = []
    for s in order:
        mine = [r for r in rows if r[2] == s]
        copies = int(target[s] / total[s] + 1e-12) if total[s] else 0
        left = target[s] - copies * total[s]
        fraction = left / total[s] if total[s] else 0

        def place(r):
            i, n = r[0], size(r[1])
            u = (int(hashlib.md5(f"1:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            odds = u / (1 - u) * (1 - fraction)
            return odds / (odds + fraction * (0.5 if n < 50 else 1.0 if n < 500 else 2.0))

        before = 0
        extra = set()
        for r in sorted(mine, key=lambda r: (place(r), r[0])) if fraction > 1e-12 else []:
            if 2 * before + size(r[1]) <= 2 * left:
                extra.add(r[0])
            before += size(r[1])
        for r in mine:
            out += [r] * (copies + (r[0] in extra))
    return out


def plain_pieces(rows, plain):
    out = []
    for i, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], "<u4")
            out.append((i, n, at, len(part), zlib.crc32(part.tobytes())))
    return out


def documents():
    draw = random.Random(9)
    rows = [(i, t, draw.choice(["a", "a", "a", "b", "c", None])) for i, t in corpus(3)]
    rows += [(100 + i, rows[i][1], "b") for i in range(5)]
    rows += [(110, "junk " * 60, "a"), (111, "#$% &*& |x| " * 20, "a"), (112, None, "a"), (113, "", "b"), (114, "too few words", "c")]
    rows += [(115, " ".join(draw.choices("abcdefghij", k=3)[0] + str(draw.random())[2:6] + "q" for _ in range(4000)), "c")]
    short = "alpha beta gamma delta\nepsilon zeta eta theta\niota kappa lambda mu\nnu xi omicron pi"  # lines that line dedup leaves alone
    words = [f"word{draw.randrange(3000)}" for _ in range(400)]
    for i in range(40):  # near copies, each with a few words of its own
        near = list(words)
        for at in draw.sample(range(400), 4):
            near[at] = f"other{draw.randrange(10 ** 6)}"
        rows.append((200 + i, " ".join(near), "b"))
    rows.append((250, " ".join(w if i % 9 else f"far{i}" for i, w in enumerate(words)), "a"))  # too far
    rows += [(116, short, "b"), (117, short, "a"), (118, short.upper(), "c")]
    return rows


PLAIN = (plain_rules, plain_lines, plain_near, plain_mix)


def test_stages_and_run(spark, frame, tmp_path):
    rows = documents()
    docs = frame(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held = docs
    for (name, stage), plain in zip(corpus_pipeline.STAGES, PLAIN):
        out = stage(spark, held, str(tmp_path))
        assert out.columns == docs.columns, name
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        held = spark.read.parquet(path)
        new = plain(rows)
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in held.collect()) == Counter(new), name
        assert 0 < len(new) != len(rows)
        rows = new
    packed = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path)).collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = Counter(plain_pieces(rows, Tokenizer.from_file(vocabulary())))
    for result in (packed, whole):
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in result) == want
        places = defaultdict(list)
        for r in result:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for held_ in places.values():
            at = 0
            for offset, length in sorted(held_):
                assert offset == at
                at += length
            assert at <= 2048


def test_odd_and_empty(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
