"""Personal data in whole texts: fixed patterns, then a conditional random field for other forms.

The patterns find plain e-mail addresses, IPv4 addresses, card numbers and international
telephone numbers. A linear-chain conditional random field over word shapes, trained from a
small labelled table, finds the same kinds in forms that no pattern covers: addresses spelled
out, numbers without a country code, dotted parts in brackets. Its spans count only where the
figures in them can be what they are labelled as, and never replace a pattern's span.

The field labels stretches around tokens that can belong to such data (digits, "@", a spelled
"at" with its "dot"); anywhere else a label other than "none" is ruled out, so leaving those
tokens out changes nothing. Stretches of a batch of documents are decoded together.

Defined cases: NULL and empty texts have no spans; every row of the input gives one row,
repeated rows and NULL ids included; offsets are code points, ends exclusive; other columns
are not read; an empty table gives an empty result. Every pattern is linear in the text.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nightwarden.llm import crf

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A digit run that fails from its first digit fails from every other one, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(text: str) -> bool:
    d = _digits(text)
    return 13 <= len(d) <= 19 and luhn(d)


def _octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            yield "email", begin, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start."""
    spans = list(_emails(text))
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0].split("."))]
    spans += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m[0])]
    spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


# The labelled table: {kind|text} marks a span; # stands for any digit, N and W for a name and a word.
LABELLED = (
    "write to {email|N at W dot com} before noon", "mail {email|N.N at W dot org} , thanks",
    "contact : {email|N [at] W [dot] net}", "reach me under {email|N (at) W (dot) de} any time",
    "{email|N_N at W dot W dot com}", "my address is {email|N## at W dot com}", "send it to {email|N@W.W} today",
    "host {ip|###[.]##[.]#[.]##} was blocked", "traffic from {ip|##[.]##[.]###[.]#}", "see {ip|#(.)##(.)##(.)##} in the log",
    "server {ip|##.##.#.##} answered", "ping {ip|###.##.##.#} now",
    "call {phone|(###) ###-####} after five", "phone {phone|###-###-####} or write", "tel {phone|0## #######}",
    "fax : {phone|(0##) ####-####}", "ring {phone|0####/######} at home", "mobile {phone|01## #######}",
    "our number is {phone|+## ## ####### }", "tel. {phone|00## ## #### ####}", "dial {phone|###.###.####} please",
    "card {card|####.####.####.####} expired", "pay with {card|####/####/####/####} now", "visa {card|####_####_####_####}",
    "card number {card|#### #### #### ####} on file", "charge {card|################} today",
    "W at W the W of W", "N was at home in W", "look at W and dot the W", "version #.# of W", "chapter ## and page ###",
    "in #### there were ### W", "from #### to #### in W", "on ##.##.#### at ##:##", "#### - ## - ## W", "the year #### , W W",
    "order ######## shipped", "invoice ####-#### of W", "item ###-## costs ##.## W", "build #.#.#.####", "room ### at W",
    "W ## W ## W ##", "id ################ W", "sum of ###,### and ##.#%", "score ##:## W", "section #.#.# of W",
    "W W W ##", "license ##-#### W", "W@W W", "# . # W W", "## W , ### W ; #### W", "licensed under W #.#", "ISBN ###-#-####-####-#",
    "W dot W at W", "N and N met at ## W", "key W##W##W##", "ratio #/# or ##/##", "at ## dot W", "zip ##### W", "route ## exit ###",
)
VARIANTS, TRAIN_SEED = 12, 11
NAMES = "jane omar li ana piotr sven ines yuki noor tom eva raj".split()
WORDS = "the of example house mail river from stone paper ion green host data blue field open light".split()

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\w")
_TRIGGER = re.compile(r"[0-9@]|\b[Aa][Tt]\b(?=[^\n]{1,60}\b[Dd][Oo][Tt]\b)")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: Characters before and after a trigger, tokens decoded together and how many two runs share.
REACH, RUN, OVERLAP = 80, 64, 24


def labelled_rows(variants: int = VARIANTS, seed: int = TRAIN_SEED) -> list[tuple[str, list[Span]]]:
    """The labelled table with names, words and digits drawn: `variants` rows a pattern."""
    draw, rows = random.Random(seed), []
    fill = {"#": lambda: draw.choice("0123456789"), "N": lambda: draw.choice(NAMES), "W": lambda: draw.choice(WORDS)}
    for pattern in LABELLED:
        for _ in range(variants):
            text, spans, kind = "", [], None
            for part in re.split(r"(\{\w+\||\})", pattern):
                if part.endswith("|"):
                    kind, begin = part[1:-1], len(text)
                elif part == "}":
                    spans.append((kind, begin, len(text)))
                else:
                    text += re.sub(r"#|\b[NW](?![a-z])", lambda m: fill[m[0]](), part)
            first = draw.choice(WORDS) + " "
            rows.append((f"{first}{text} {draw.choice(WORDS)}", [(k, a + len(first), b + len(first)) for k, a, b in spans]))
    return rows


def _shape(token: str) -> str:
    if token[0] in "0123456789":
        return f"d{min(len(token), 7)}"
    if token[0].isalpha():
        return "X" if token.isupper() else "Xx" if token[0].isupper() else "x"
    return token


def token_features(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """Shapes of a token and its neighbours, whether they touch, and short words themselves."""
    words = [text[a:b] for a, b in spans]
    shapes = ["^", "^", *map(_shape, words), "$", "$"]
    out = []
    for i, word in enumerate(words):
        s = shapes[i:i + 5]
        low = word.lower() if len(word) <= 8 and word[0].isalpha() else ""
        before = words[i - 1].lower() if i else ""
        touch = "j" if i and spans[i - 1][1] == spans[i][0] else "s"
        out.append([f"0{s[2]}", f"-{s[1]}{touch}", f"+{s[3]}", f"-0{s[1]}{touch}{s[2]}", f"0+{s[2]} {s[3]}", f"-2{s[0]} {s[1]}",
                    f"+2{s[3]} {s[4]}", f"w{low}" if low in CONTEXT else "w", f"p{before}" if before in CONTEXT else "p", "b"])
    return out


CONTEXT = frozenset("at dot mail contact address write send host traffic server ping call phone tel fax ring mobile number dial card pay "
                    "visa charge version chapter page year order invoice item build room id sum score section license isbn key zip route".split())


@cache
def model() -> crf.Model:
    """The field, trained once per process from the labelled table."""
    sequences, tags = [], []
    for text, spans in labelled_rows():
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        row = ["O"] * len(tokens)
        for kind, a, b in spans:
            inside = [i for i, (x, y) in enumerate(tokens) if a <= x and y <= b]
            for n, i in enumerate(inside):
                row[i] = f"{'I' if n else 'B'}-{kind}"
        sequences.append(token_features(text, tokens))
        tags.append(row)
    return crf.train(sequences, tags, LABELS)


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans around everything that can be part of personal data, in runs of bounded length.

    Runs of one stretch overlap by more tokens than a span holds.
    """
    begin = end = -1
    for m in _TRIGGER.finditer(text):
        if begin >= 0 and m.start() > end:
            yield from _runs(text, begin, end)
            begin = -1
        if begin < 0:
            begin = max(0, m.start() - REACH)
        end = m.end() + REACH
    if begin >= 0:
        yield from _runs(text, begin, end)


def _runs(text: str, begin: int, end: int) -> Iterator[list[tuple[int, int]]]:
    while 0 < begin < len(text) and text[begin].isalnum() and text[begin - 1].isalnum():
        begin += 1  # not into a word
    tokens = [m.span() for m in _TOKEN.finditer(text, begin, min(end, len(text)))]
    for k in range(0, len(tokens), RUN - OVERLAP):
        yield tokens[k:k + RUN]


def _plausible(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "card":
        return _is_card(text)
    if kind == "ip":
        return _octets(re.findall(r"[0-9]+", text))
    if kind == "phone":
        return 9 <= len(digits) <= 15 and bool(re.search(r"[^0-9]", text)) and not _octets(re.findall(r"[0-9]+", text))
    return bool(re.search(r"(?i)\w\W{0,3}(?:@|\bat\b)\W{0,3}\w+\W{0,3}(?:\.|\bdot\b)\W{0,3}[a-z]{2,}", text))


def added_spans(texts: list[str], base: list[list[Span]], field: crf.Model) -> list[list[Span]]:
    """What the field finds beside the patterns' spans."""
    where, features, tokens = [], [], []
    for i, text in enumerate(texts):
        for run in stretches(text):
            where.append(i)
            tokens.append(run)
            features.append(token_features(text, run))
    out: list[list[Span]] = [[] for _ in texts]
    order = sorted(range(len(features)), key=lambda j: len(features[j]))
    for k in range(0, len(order), 512):
        chosen = [j for j in order[k:k + 512] if features[j]]
        for j, labels in zip(chosen, crf.viterbi(field, [features[j] for j in chosen])):
            out[where[j]] += _spans(texts[where[j]], tokens[j], labels)
    return [_beside(new, old) for new, old in zip(out, base)]


def _spans(text: str, tokens: list[tuple[int, int]], labels: list[str]) -> Iterator[Span]:
    i = 0
    while i < len(labels):
        if labels[i][0] == "B":
            kind, j = labels[i][2:], i + 1
            while j < len(labels) and labels[j] == f"I-{kind}":
                j += 1
            begin, end = tokens[i][0], tokens[j - 1][1]
            if _plausible(kind, text[begin:end]):
                yield kind, begin, end
            i = j
        else:
            i += 1


def _beside(new: list[Span], old: list[Span]) -> list[Span]:
    """New spans that touch neither an old one nor an earlier new one."""
    taken, out = sorted((a, b) for _, a, b in old), []
    starts = [a for a, _ in taken]
    for kind, a, b in sorted(set(new), key=lambda s: (s[1], -s[2])):
        at = bisect_left(starts, b)
        if any(y > a for _, y in taken[max(0, at - 4):at]) or out and out[-1][2] > a:
            continue
        out.append((kind, a, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
TEXTS = 256


def _found(field: crf.Model):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                rows = batch.slice(k, TEXTS)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                added = added_spans(texts, base, field)
                spans = [sorted(b + a, key=lambda s: (KINDS.index(s[0]), s[1])) for b, a in zip(base, added)]
                counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS]
                digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), *counts, digests, pa.array(map(joined, spans), pa.string())],
                                                 names=[c.split()[0] for c in SCHEMA.split(", ")])

    return found


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the patterns' spans per kind, their digest, and all spans, per document.

    The field is trained on the driver and travels with the tasks: a few thousand weights.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_found(model()), SCHEMA)
