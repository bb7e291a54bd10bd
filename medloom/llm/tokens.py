"""Token ids of the word tokenizer file, at one table look-up per word instead of one library call per text."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

WORDS_KEPT = 500_000
PIECES_KEPT = 250_000
LONGEST_KEPT = 64

# Up to here no character is composed, lower-cased or classified differently by different Unicode versions.
_PLAIN = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)]]
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_IS_PLAIN = re.compile("[\x21-\x7e\xa1-ɏ]+").fullmatch
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+").findall
_END = b"\xff"


def byte_alphabet() -> dict[str, int]:
    """Byte-level files write a printable Latin-1 byte as itself and the other bytes as characters from U+0100 on."""
    shown = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    hidden = [b for b in range(256) if chr(b) not in shown]
    return shown | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class WordIds(dict):
    """Maps a word between white space to the packed little-endian ids that the library gives for it.

    The tokenizer drops white space, and neither its normalizer nor its splitter looks across it, so the ids of a
    text are those of its words one after the other. Words are cut at ASCII white space only; other white space
    stays inside a word and is left to the library. Pieces of plain Latin words are merged by ranks, with one byte
    that UTF-8 never uses for the end of a word; all other words, and words that hold a special token, go to the
    library itself. The tables are bounded: a full table of words takes no more, and is emptied after many misses, as
    the texts may have changed. That costs time but never changes ids.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet, vocab = byte_alphabet(), model["vocab"]

        def raw(token: str) -> bytes:
            ends = token.endswith("</w>")
            return bytes(alphabet[c] for c in token.removesuffix("</w>")) + _END * ends

        # Ranks are in the order of merging: bytes, bytes that end a word, then the merges of the file.
        ids = {raw(token): i for token, i in vocab.items()}
        merges = [raw(a) + raw(b) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        order = [*(bytes([b]) for b in range(256)), *(bytes([b]) + _END for b in range(255)), *merges]
        ranks = {token: rank for rank, token in enumerate(order)}
        self.id_of = [ids.get(token, 0) for token in order].__getitem__
        self.merge = tiktoken.Encoding(
            "words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_single_piece
        self.pieces: dict[str, bytes] = {}
        self.missed = 0

    def _library(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = array("I", map(self.id_of, self.merge(piece.encode() + _END))).tobytes()
            if len(piece) <= LONGEST_KEPT:
                if len(self.pieces) >= PIECES_KEPT:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        lowered = text.lower()
        # Some plain capitals have small letters beyond the plain ones.
        if b"<|" in word or not _IS_PLAIN(text) or not _IS_PLAIN(lowered):
            got = self._library(text)
        else:
            got = b"".join(map(self._piece, _SPLIT(lowered)))
        self.missed += 1
        if self.missed > 8 * WORDS_KEPT:
            self.clear()
            self.missed = 0
        if len(word) <= LONGEST_KEPT and len(self) < WORDS_KEPT:
            self[word] = got
        return got

    def encode(self, text: bytes) -> bytes:
        # Lower-casing ASCII first makes more words equal; a special token is only one as it stands.
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


_LOADED: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    """One table per worker process, kept between tasks."""
    if name not in _LOADED:
        _LOADED[name] = WordIds(public_tokenizers.path(name))
    return _LOADED[name]
