"""Token ids of whole texts by the tokenizers library, remembered word by word.

Both vocabulary files first cut a text into words by a fixed pattern and then merge inside each
word, so the ids of a text are the ids of its words in order. Texts of plain Latin characters are
cut here by an equal pattern and only words not seen lately go to the library. All other texts go to
the library whole, also those with the string of an added token, which the library makes one id.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from struct import pack

import numpy as np

# Characters on which the patterns below agree with the library's Unicode classes.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e¡«»¿-ÿ–—‘’“”…]")
_UPPER_LOWER = "A-Za-zÀ-ÖØ-öø-ÿ"
_LOWER = "a-zß-öø-ÿ"
# The two files' patterns, written for those characters.
_WITH_SPACES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_UPPER_LOWER}]+| ?[0-9]+| ?[^\s{_UPPER_LOWER}0-9]+|\s+(?!\S)|\s+")
_WITHOUT_SPACES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^\s{_LOWER}0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabularies: visible Latin-1 bytes stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(dict):
    """Packed ids of words; a word not among the last two generations goes to the tokenizer's model."""

    def __init__(self, model, letters: dict[int, str], old: dict[str, bytes]):
        super().__init__()
        self.tokenize, self.letters, self.old = model.tokenize, letters, old

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            spelled = word.encode("utf-8").decode("latin-1").translate(self.letters)
            found = [t.id for t in self.tokenize(spelled)]
            ids = pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids


class Encoder:
    """Packed ids (little-endian unsigned 32-bit) of texts; its memory holds two generations of words."""

    def __init__(self, path: str, bound: int = 1 << 17):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.cut = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.cut = _WITH_SPACES.findall
        elif pre.get("type") == "Sequence" and norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.cut = lambda text: _WITHOUT_SPACES.findall(text.lower())
        added = spec.get("added_tokens") or []
        self.added = re.compile("|".join(re.escape(x["content"]) for x in added) or r"(?!)")
        if any(x.get("normalized") for x in added):  # such are looked for in the normalised text
            self.cut = None
        self.bound, self.letters = bound, _byte_letters()
        self.words = Words(self.tokenizer.model, self.letters, {})

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = []
        for i, x in enumerate(texts):
            if self.cut is None or self.added.search(x) or not x.isascii() and _UNUSUAL.search(x) or x.isascii() and not x.isprintable() and _UNUSUAL.search(x):
                whole.append(i)
                continue
            if len(self.words) >= self.bound:
                self.words = Words(self.tokenizer.model, self.letters, dict(self.words))
            out[i] = b"".join(map(self.words.__getitem__, self.cut(x)))
        if whole:
            for i, x in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
                out[i] = np.array(x.ids, dtype="<u4").tobytes()
        return out


    def forget(self) -> None:
        self.words = Words(self.tokenizer.model, self.letters, {})


@lru_cache(maxsize=2)
def _kept(path: str) -> Encoder:
    """One for each path and Python worker: reading a vocabulary takes longer than many a task."""
    return Encoder(path)


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """The worker's encoder for a task, at whose end it forgets its words."""
    enc = _kept(path)
    try:
        yield enc
    finally:
        enc.forget()
