"""Secrets in whole texts: fixed patterns, then novelty under a primed compressor.

The patterns find assigned passwords and keys, access key ids and long hexadecimal runs. A
candidate beyond them is a long token of letters and digits with a sensitive word shortly
before or after it. It is compressed with zstandard, primed with a dictionary of identifiers
and the text around it; the bytes that it adds to an empty frame, per byte that its symbols
must cost, are its novelty. They cost their number, or less if they are few and about equally
frequent, as in hexadecimal and base32: then what they take in random order, compressed
without a dictionary. Repeated tokens and known identifiers add little; random strings of any
alphabet add nearly all of themselves and are reported.

File names, paths and names in code need more words than a compressor's dictionary holds. With a
tokenizer's vocabulary a candidate is cut at case, digits and signs, and one whose letters lie for
the most part in whole words of the vocabulary is a name, not a secret. So passphrases of words
are not reported.

Defined cases: NULL and empty texts have no spans; every row of the input gives one row,
repeated rows and NULL ids included; offsets are code points, ends exclusive; other columns
are not read; an empty table gives an empty result. Only the context of a candidate is
bounded, texts are read whole, and every pattern is linear in the text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

KINDS = ("assign", "access", "hex", "novel")
Span = tuple[str, int, int]

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_SENSITIVE = re.compile(r"secret|token|passw|passphrase|credential|api.?key|private.?key|access.?key|signing|auth|bearer", re.IGNORECASE)
#: Characters on each side of a candidate that may hold the sensitive word, and that prime.
NEAR, AROUND, NOVELTY = 64, 2048, 0.72
#: Entropy, of the most that as many symbols allow, from which they count as equally frequent; bytes of the shortest candidate that is reported.
EVEN, LEAST = 0.93, 16

IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 configuration_directory getElementById application "
    "environment_variable authorization_header content_type application/json localhost repository implementation "
    "serialization initialize_connection database_connection_string username_password_authentication access_token_expires "
    "client_secret_id private_key_path public_key_file certificate_authority transaction_manager request_handler "
    "response_status_code error_message_format default_timeout_seconds maximum_retry_count user_agent_string "
    "https://www.example.com/path/to/resource/index.html /usr/local/lib/python/site-packages/ /etc/ssl/certs/ com.example.service "
    "test_case_example_value placeholder_changeme your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 AAAAAAAAAAAAAAAA"
).encode()


_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Letters of a word that counts, and the share of a candidate's letters that makes it a name.
WORD_LETTERS, NAMED = 4, 0.6


@cache
def vocabulary_words(path: str | None) -> frozenset[str]:
    """Whole words of a tokenizer's vocabulary, one set per worker; none without a path."""
    if path is None:
        return frozenset()
    ends = (token.removesuffix("</w>") for token in Tokenizer.from_file(path).get_vocab() if token.endswith("</w>"))
    return frozenset(w.lower() for w in ends if len(w) >= WORD_LETTERS and w.isascii() and w.isalpha())


def is_name(candidate: str, words: frozenset[str]) -> bool:
    parts = _PARTS.findall(candidate)
    return sum(len(p) for p in parts if p.lower() in words) >= NAMED * max(1, sum(map(len, parts)))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    spans, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def symbol_cost(candidate: str) -> int:
    """Bytes that a random string of the candidate's symbols takes."""
    n, counts = len(candidate), Counter(candidate)
    entropy = log2(n) - sum(c * log2(c) for c in counts.values()) / n
    if entropy < EVEN * log2(len(counts)):
        return n
    plain = zstandard.ZstdCompressor(level=9, write_checksum=False, write_content_size=False)
    mixed = "".join(random.Random(n).sample(candidate, n)).encode()
    return max(LEAST, min(n, len(plain.compress(mixed)) - len(plain.compress(b""))))


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes, given identifiers and the text on both sides, per byte that its symbols must cost."""
    context = IDENTIFIERS + f" {after} {before}".encode("utf-8", "surrogatepass")
    primed = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(context, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                      write_checksum=False, write_content_size=False, write_dict_id=False)
    return (len(primed.compress(candidate.encode())) - len(primed.compress(b""))) / symbol_cost(candidate)


def novel_spans(text: str, base: list[Span], least: float = NOVELTY, words: frozenset[str] = frozenset()) -> list[Span]:
    """Candidates in a sensitive context that neither it nor words explain, outside the patterns' spans."""
    out, at = [], 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if not (any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])):
            continue
        if not (_SENSITIVE.search(text, max(0, a - NEAR), a) or _SENSITIVE.search(text, b, b + NEAR)):
            continue
        while at < len(base) and base[at][2] <= a:
            at += 1
        if any(x < b and y > a for _, x, y in base[max(0, at - 2):at + 3]):
            continue
        if words and is_name(m[0], words):
            continue
        if novelty(m[0], text[max(0, a - AROUND):a], text[b:b + AROUND]) >= least:
            out.append(("novel", a, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
TEXTS = 256


def _found(vocabulary: str | None):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_words(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                rows = batch.slice(k, TEXTS)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                spans = [sorted(b + novel_spans(t, b, words=words), key=lambda s: (s[1], KINDS.index(s[0]))) for t, b in zip(texts, base)]
                counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS[:3]]
                digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), *counts, digests, pa.array(map(joined, spans), pa.string())],
                                                 names=[c.split()[0] for c in SCHEMA.split(", ")])
    return found


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Counts of the patterns' spans per kind, their digest, and all spans, per document.

    `vocabulary` is the file of a tokenizer whose words tell names from secrets.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_found(vocabulary), SCHEMA)
