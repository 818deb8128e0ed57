"""Token ids of whole texts with a cache of words.

Some vocabularies normalise a text, split it into short units at white space and between
letters, digits and signs, and encode each unit by itself. For those the ids of a text are
those of its words, so a word is split and encoded once per worker. Any other vocabulary, and
any text with characters the short cut does not cover, is encoded whole. Both ways give the
same ids.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from functools import cache
from struct import pack

from tokenizers import Tokenizer

#: The word pattern and normaliser of the vocabularies that the cache covers.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

LAST = 0x24F
#: What the short cut leaves alone: characters beyond LAST, those whose lower case lies beyond it,
#: and the separators that Python takes for white space and the vocabulary does not.
OTHER = re.compile(f"[^\x00-\x1b\x20-{chr(LAST)}]|[{''.join(c for c in map(chr, range(LAST + 1)) if max(c.lower()) > chr(LAST))}]")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
_UNITS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
CACHED, CACHED_CHARS = 500_000, 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """ids(texts): for each text the little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        splits = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = (parts.get("normalizer") or {}).get("normalizers")
        bytes_only = splits[1:] and splits[1].get("type") == "ByteLevel" and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        self.by_words = (splits[0].get("pattern") == {"Regex": WORD_PATTERN} and splits[0].get("invert") and bool(bytes_only)
                         and normal == NORMALIZERS and len(splits) == 2)
        self.special = [t["content"] for t in parts.get("added_tokens", [])]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        letters = unit if unit.isascii() and unit.isprintable() else "".join(map(self.letters.__getitem__, unit.encode()))
        ids = [t.id for t in self.model.tokenize(letters)]
        found = pack(f"<{len(ids)}I", *ids)
        if len(unit) <= CACHED_CHARS:
            self.units[unit] = found
        return found

    def _simple(self, text: str) -> bool:
        return self.by_words and not OTHER.search(text) and not any(s in text for s in self.special)

    def ids(self, texts: Sequence[str | None]) -> list[bytes]:
        """NULL texts are empty. Every text is encoded whole."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if not self._simple(text):
                out.append(self._whole(text))
                continue
            if len(self.words) > CACHED or len(self.units) > CACHED:
                self.words.clear()
                self.units.clear()
            words = text.lower().split()
            missing = set(words).difference(self.words)
            known = self.units.get
            for word in missing:
                self.words[word] = b"".join([known(u) or self._unit(u) for u in _UNITS.findall(word)])
            out.append(b"".join(map(self.words.__getitem__, words)))
            for word in missing:
                if len(word) > CACHED_CHARS:
                    del self.words[word]
        return out


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker, so that later tasks find the units of earlier ones."""
    return Encoder(path)
