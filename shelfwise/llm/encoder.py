"""Whole texts to token ids with a tokenizers file, word by word through a cache.

Where no token of the file's pre-tokenizer crosses an ASCII blank, and its normaliser (NFC, blanks,
lower case) doesn't join characters across one, a text's ids are its words' ids in a row.
Distinct words are then encoded once per worker while they stay in a bounded cache. A file with
other settings is used as the library uses it, a whole text at a time.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np

#: Letters below U+0250 once in lower case, and the words made of them and printable ASCII.
_LETTERS = "a-zß-öø-ɏ"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
#: Settings under which words can be encoded alone.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: That pre-tokenizer pattern, narrowed to plain words.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def _byte_names() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in keep else chr(next(rest)) for b in range(256)}


class WordEncoder:
    """ids(text) equals ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    A plain word's pieces go straight to the file's BPE model (they need no normalising);
    any other word goes through the whole tokenizer.
    """

    _made: dict[tuple, WordEncoder] = {}

    def __init__(self, path: str, cache_words: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(Path(path).read_text())
        normalizer, splitter = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
        self.by_words = normalizer.get("normalizers") == _NORMALIZERS and splitter.get("pretokenizers") == _SPLITTERS and settings["model"].get("type") == "BPE"
        self.model, self.names = self.tokenizer.model, _byte_names()
        self.limit = cache_words
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.width = int(self.kind[2:])
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # what the cache held before it was last full

    @classmethod
    def of(cls, path: str, cache_words: int = 600_000) -> WordEncoder:
        """One per worker process and file."""
        if (path, cache_words) not in cls._made:
            cls._made[path, cache_words] = cls(path, cache_words)
        return cls._made[path, cache_words]

    def _word(self, raw: bytes) -> bytes:
        found = self.older.get(raw)
        if found is None:
            word = raw.decode()
            low = word.lower()
            if _PLAIN.fullmatch(low) and "<|" not in word:
                ids = [t.id for piece in _PIECES.findall(low) for t in self.model.tokenize(piece if piece.isascii() else "".join([self.names[b] for b in piece.encode()]))]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = b"".join([i.to_bytes(self.width, "little") for i in ids])
        return found

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian numbers of type ``kind``; null counts as empty."""
        if not self.by_words:
            return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype=self.kind).tobytes()
        raw = (text or "").encode("utf-8", "replace")
        if b"<|" not in raw:  # a special token's string keeps its case
            raw = raw.lower()
        words = raw.split()
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        out = []
        for w in words:
            if (ids := known.get(w)) is None:
                ids = known[w] = self._word(w)
            out.append(ids)
        if len(known) > self.limit:
            self.older, self.words = known, {}
        return b"".join(out)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), dtype=self.kind)
