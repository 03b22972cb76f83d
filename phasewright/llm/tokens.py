"""Pre-tokens and their pieces, exactly as the tokenizer library gives them.

Texts of plain characters are cut by the published pattern; texts with any other
character go through the library's own normalizer and pre-tokenizer, so that no
difference between Unicode tables can change a count.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

#: Characters for which the patterns, case and composition are the same in every Unicode version, as a class.
_PLAIN = r"\t\n\r\x20-\x7e\xa0-ɏ‐-‧€"
_ODD = re.compile(f"[^{_PLAIN}]")
_CHARACTERS = "".join(c for c in map(chr, range(0x2100)) if not _ODD.search(c))
_LETTER, _NUMBER = (re.escape("".join(sorted(set(regex.findall(rf"\p{{{kind}}}", _CHARACTERS + _CHARACTERS.lower()))))) for kind in "LN")
#: The published patterns, over plain characters.
_BYTE_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_WORD_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
#: Longer pre-tokens are merged each time and not kept.
_LONGEST_KEPT = 64
_MOST_KEPT = 160_000


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(extra)) for b in range(256)]


def to_letters(piece: str) -> str:
    letters = byte_letters()
    return "".join([letters[b] for b in piece.encode("utf-8", "surrogatepass")])


class Kept(dict):
    """Values by key, worked out once, in bounded memory.

    When ``_MOST_KEPT`` keys are in, they become the old ones; an old key that is
    asked for again is kept on, the others go with the next change.
    """

    def __init__(self, work) -> None:
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= _LONGEST_KEPT:
            if len(self) >= _MOST_KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class _Library:
    """A tokenizer file, its added tokens, and its merges for single pre-tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.path = path
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.merge = self.tokenizer.model.tokenize

    def parts(self, text: str) -> list[str]:
        """Ordinary text at even places, added tokens at odd ones."""
        return self.split_added.split(text) if self.split_added and "<|" in text else [text]

    def library_letters(self, part: str) -> list[str]:
        """Pre-tokens in byte letters by the library's own normalizer and pre-tokenizer."""
        if self.tokenizer.normalizer is not None:
            part = self.tokenizer.normalizer.normalize_str(part)
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]


class TokenCounter:
    """Counts byte-level BPE tokens: whole-token table first, merges for the rest.

    ``whole`` holds the vocabulary strings, in byte letters, that are proved to
    encode alone as one token, ``texts`` the same as text. Both kinds of texts,
    plain ones and those cut by the library, look their pre-tokens up there.
    """

    def __init__(self, path: str) -> None:
        self.library = _Library(path)
        letters = {c: b for b, c in enumerate(byte_letters())}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.whole = {t for t in vocabulary if all(c in letters for c in t) and len(self.library.merge(t)) == 1}
        self.texts = set()
        for token in self.whole:
            try:
                self.texts.add(bytes(letters[c] for c in token).decode("utf-8"))
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token
        self.pieces = Kept(lambda x: 1 if x in self.texts else len(self.library.merge(to_letters(x))))
        self.letters = Kept(lambda x: 1 if x in self.whole else len(self.library.merge(x)))

    def count(self, text: str) -> int:
        total = 0
        for i, part in enumerate(self.library.parts(text)):
            if i % 2:
                total += 1
            elif _ODD.search(part):
                total += sum(map(self.letters.__getitem__, self.library.library_letters(part)))
            else:
                total += sum(map(self.pieces.__getitem__, _BYTE_PATTERN.findall(part)))
        return total


class WordEncoder:
    """Ids of the word-end BPE as little-endian 32-bit words."""

    def __init__(self, path: str) -> None:
        self.library = _Library(path)
        self.pieces = Kept(lambda x: self._pack(to_letters(x)))
        self.letters = Kept(self._pack)

    def _pack(self, letters: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.library.merge(letters)])

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        for i, part in enumerate(self.library.parts(text)):
            if i % 2:
                out.append(self.library.added[part].to_bytes(4, "little"))
            elif _ODD.search(part):
                out += map(self.letters.__getitem__, self.library.library_letters(part))
            else:
                out += map(self.pieces.__getitem__, _WORD_PATTERN.findall(part.lower()))
        return b"".join(out)


@lru_cache(2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
