"""Token ids of whole texts for a word-level BPE vocabulary, with a proven one-token shortcut.

The vocabulary's library drops white space and merges each pre-token alone, so the ids of a text are
those of its lower-cased words in order. `Words` looks words up in a table; a word that is not there is
split into pre-tokens, those proven to be one token are taken as they are, and only the rest is merged. Texts where that need not hold go to the library whole: those with a character
outside `SAFE` (normalisation might join it to its neighbours), or with `<|`, which may begin a special string.
"""

from __future__ import annotations

import itertools
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"

# White space, or composed already, never combining and lower-cased one by one.
SAFE = r"\t\n\x0b\f\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞₠-₿"
# Fixed value: characters at which Python splits words and the vocabulary does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_unsafe = re.compile(f"[^{SAFE}]")
# Fixed value: the vocabulary's own split of a lower-cased word.
_pre_tokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a vocabulary entry: itself if it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(others)}


_letters = _byte_letters()


def as_entry(piece: str) -> str:
    """A pre-token as the vocabulary writes it."""
    return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_letters)


@lru_cache(maxsize=4)
def library(name: str = VOCABULARY) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def whole_tokens(name: str = VOCABULARY) -> dict[str, int]:
    """The proof: pre-tokens, as the pre-tokeniser writes them, that the library's merges leave as one
    token, with its id. It covers the vocabulary row by row, whatever the corpus holds."""
    tok = library(name)
    suffix = tok.model.end_of_word_suffix
    found = {}
    for entry, i in tok.get_vocab(with_added_tokens=False).items():
        if suffix and not entry.endswith(suffix):
            continue
        piece = entry.removesuffix(suffix) if suffix else entry
        merged = tok.model.tokenize(piece)
        if len(merged) == 1 and merged[0].id == i:
            found[piece] = i
    return found


def plain(text: str) -> bool:
    if "<|" in text:
        return False
    if text.isascii():
        return not any(c in text for c in SEPARATORS)
    return not _unsafe.search(text)


def split_word(word: str) -> list[str]:
    """The pre-tokens of a lower-cased word; the two usual shapes without the pattern."""
    if word.isalpha():
        return [word]
    if word[-1] in ".,;:!?" and word[:-1].isalpha():
        return [word[:-1], word[-1]]
    return _pre_tokens.findall(word)


# Longer words are merged each time and not kept.
KEPT_BYTES = 64


class Words(dict):
    """Lower-cased word → its row in a flat table of ids. Words of up to KEPT_BYTES are kept. Before a slice of texts the table starts again if it holds
    more than `limit` words, `limit_bytes` of words or a quarter as many ids, so that a worker's memory stays bounded whatever the texts hold."""

    def __init__(self, name: str = VOCABULARY, limit: int = 1_000_000, limit_bytes: int = 32 << 20):
        super().__init__()
        self.tok, self.limit, self.limit_bytes = library(name), limit, limit_bytes
        self.proven = whole_tokens(name)
        self.pieces: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pieces.clear()
        self.bytes = 0
        self.flat, self.start, self.length = array("I"), array("q"), array("q")

    def __missing__(self, word: str) -> int:
        flat, begun = self.flat, len(self.flat)
        for piece in split_word(word):
            entry = as_entry(piece)
            one = self.proven.get(entry)
            if one is not None:
                flat.append(one)
                continue
            known = self.pieces.get(entry)
            if known is None:
                at = len(flat)
                flat.extend([t.id for t in self.tok.model.tokenize(entry)])
                if len(entry) <= KEPT_BYTES:
                    self.pieces[entry] = at << 20 | len(flat) - at
                    self.bytes += len(entry)
            else:
                at = known >> 20
                flat.extend(flat[at:at + (known & 0xFFFFF)])
        row = len(self.start)
        if len(word) <= KEPT_BYTES and (word.isascii() or len(word.encode()) <= KEPT_BYTES):
            self[word] = row
            self.bytes += len(word)
        self.start.append(begun)
        self.length.append(len(flat) - begun)
        return row

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """Table rows of all words, words per text, and the ids of texts that the library encodes whole."""
        if len(self) > self.limit or self.bytes > self.limit_bytes or 4 * len(self.flat) > self.limit_bytes:
            self.reset()
        split, whole = [], {}
        for i, t in enumerate(texts):
            if plain(t):
                split.append(t.lower().split())
            else:
                split.append([])
                whole[i] = self.tok.encode(t, add_special_tokens=False).ids
        n = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n.sum()))
        return rows, n, whole

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        rows, n, whole = self._rows(texts)
        upto = np.concatenate([[0], np.cumsum(np.array(self.length, np.int64)[rows])]).astype(np.int64)
        out = np.diff(upto[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)])
        for i, ids in whole.items():
            out[i] = len(ids)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        rows, n, whole = self._rows(texts)
        length, start, flat = (np.array(x) for x in (self.length, self.start, self.flat))
        many = length[rows]
        upto = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        at = np.arange(upto[-1]) + np.repeat(start[rows] - upto[:-1], many)
        ids = flat[at].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        cuts = upto[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
        return [np.array(whole[i], np.uint32) if i in whole else ids[a:b]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


@lru_cache(maxsize=2)
def words(name: str = VOCABULARY) -> Words:
    """One table per Python worker."""
    return Words(name)
