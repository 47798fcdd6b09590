"""Token ids of whole texts by a public tokenizer file, for chunks of texts at once.

The word-level vocabulary never joins characters across white space, so the ids of a
text are those of its ASCII-white-space-separated words in a row; words repeat, so most
have been met before. A chunk's words are hashed (64 bits) and looked up all together in
a table with a slot for each of the hash's first bits, which says where a word's ids stand
in one array; only words that aren't in it are tokenized, and take their slots. One of ASCII or Latin-1 letters, digits and ASCII signs
is cut by the tokenizer's own split rule and its pieces are tokenized; any other goes to
the tokenizer as it stands. tests/llm compare this with the tokenizer itself.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from .words import NOT_SPACE, U, Words, held

#: Slots (a power of two) and ids kept by one worker: 44 MB. A full array of ids is emptied, and so are the slots.
SLOT_BITS, IDS = 20, 7_000_000
#: Words whose ids are gathered at a time.
STEP = 500_000
#: The tokenizer's split rule, on the characters of PLAIN after lower-casing.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"(?:[!-~À-ÖØ-öø-ÿ])+").fullmatch
_loaded: dict[str, WordEncoder] = {}
held.append(_loaded)


class WordEncoder:
    """word_bpe_49k.json: NFC, lower case, letters / one digit / signs, then BPE."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.shown = {b: chr(b) if b in letters else chr(next(rest)) for b in range(256)}
        self.tokenize = self.tokenizer.model.tokenize
        self._empty()

    def _empty(self) -> None:
        self.keys = np.full(1 << SLOT_BITS, 2**64 - 1, U)
        self.keys[-1] = 0  # no slot has a key that belongs to it
        self.starts, self.sizes = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.known, self.n = np.empty(1 << 16, np.uint32), 0

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: bytes, pieces: dict[str, list[int]]) -> list[int]:
        text = word.decode()
        if not PLAIN(text) or "<|" in text:
            return self.ids(text)
        out: list[int] = []
        for piece in PIECES.findall(text.lower()):
            got = pieces.get(piece)
            if got is None:
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
                got = pieces[piece] = [t.id for t in self.tokenize(shown)]
            out += got
        return out

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the ids of these words, which are put behind the others."""
        pieces: dict[str, list[int]] = {}
        made = [self._word(w, pieces) for w in words]
        sizes = np.array([len(x) for x in made], np.int32)
        starts = (self.n + np.cumsum(sizes) - sizes).astype(np.int32)
        total = self.n + int(sizes.sum())
        if total > len(self.known):
            self.known = np.concatenate([self.known[: self.n], np.empty(total, np.uint32)])
        self.known[self.n : total] = np.fromiter(chain.from_iterable(made), np.uint32, total - self.n)
        self.n = total
        return starts, sizes

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a chunk of UTF-8 texts, and the offsets of the rows in them."""
        if self.n > IDS:
            self._empty()
        words = Words(data, offsets, NOT_SPACE, lower=False)
        slot = (words.hashes >> U(64 - SLOT_BITS)).astype(np.int64)
        starts, own = self.starts[slot], self.sizes[slot]
        missing = np.flatnonzero(self.keys[slot] != words.hashes)
        if len(missing):
            keys, first, inverse = np.unique(words.hashes[missing], return_index=True, return_inverse=True)
            new, sizes = self._learn([words.word(i) for i in missing[first].tolist()])
            starts[missing], own[missing] = new[inverse], sizes[inverse]
            at = slot[missing[first]]
            self.keys[at], self.starts[at], self.sizes[at] = keys, new, sizes
        ends = np.zeros(len(own) + 1, np.int64)
        np.cumsum(own, out=ends[1:])
        out = np.empty(ends[-1], np.uint32)
        for low in range(0, len(own), STEP):
            part = slice(low, low + STEP)
            at, size = ends[low], int(own[part].sum())
            out[at : at + size] = self.known[np.arange(size) + np.repeat(starts[part] - (ends[:-1][part] - at), own[part])]
        return out, ends[words.rows]

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian unsigned 32-bit numbers."""
        return self.encode_rows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].astype("<u4").tobytes()


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
