"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic transducers count tokens without making them.

* The *splitter* reads classes of characters and marks where pieces start. A slice of texts, each closed by a reset
  symbol, is cut into chunks that run side by side. A chunk first gives its state map (for each entry state, the state
  it ends in); the maps compose, being functions, through a parallel prefix scan, which gives each chunk's true entry
  state; then the chunks run once more and write their marks. No chunk depends on where a text begins or how long it is.
* The *piece transducer* reads the bytes of a piece. Its state holds, for every place where a longer token may still
  begin, the token that ends there and how many tokens lie between; each transition carries the change of the count.
  It follows from a property of BPE: a sequence of tokens is the encoding of a text if and only if each two
  neighbours are the encoding of their own concatenation. States are compiled when they are first met.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings in a text count as one token, as in
the library; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.base import batch_of, slices, text_list
from medloom.llm.tokens import byte_alphabet

TOKEN_LIMIT = 1024
PIECES_KEPT = 300_000
LONGEST_KEPT = 64
TRANSITIONS_KEPT = 500_000
CHUNK = 256

# Classes of characters.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, STMD, R, V, L, E, RESET = range(12)
# States: start of a text, in a run of letters, numbers or other characters; an apostrophe that began a piece and
# what may become a contraction after it; a finished contraction; white space by length (1 or more) and last character.
BEGIN, IN_LETTER, IN_NUMBER, IN_OTHER, Q, QR, QV, QL, DONE, BLANK1, BLANK2, SPACE1, SPACE2 = range(13)
MARK_HERE, MARK_BEFORE = 1, 2

# The characters that a regular expression's \s means.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by [state, class]."""
    step = np.zeros((13, 12), np.uint8)
    mark = np.zeros((13, 12), np.uint8)
    run_of = {LETTER: IN_LETTER, STMD: IN_LETTER, R: IN_LETTER, V: IN_LETTER, L: IN_LETTER, E: IN_LETTER,
              NUMBER: IN_NUMBER, OTHER: IN_OTHER, QUOTE: IN_OTHER}
    for state in range(13):
        for kind in range(11):
            base, marks = state, 0
            if state in (QR, QV, QL):  # no contraction: the letter after the apostrophe began a piece
                if (state, kind) in ((QR, E), (QV, E), (QL, L)):
                    step[state, kind] = DONE
                    continue
                base, marks = IN_LETTER, MARK_BEFORE
            if kind in (BLANK, SPACE):
                if base in (BLANK1, BLANK2, SPACE1, SPACE2):
                    step[state, kind] = BLANK2 if kind == BLANK else SPACE2
                else:
                    step[state, kind], marks = BLANK1 if kind == BLANK else SPACE1, marks | MARK_HERE
            elif state == Q and kind in (STMD, R, V, L):
                step[state, kind] = {STMD: DONE, R: QR, V: QV, L: QL}[kind]
            else:
                step[state, kind] = run_of[kind]
                if base in (BLANK1, BLANK2):  # the last blank goes with the piece
                    marks |= MARK_BEFORE if base == BLANK2 else 0
                elif base in (SPACE1, SPACE2):
                    marks |= MARK_HERE | (MARK_BEFORE if base == SPACE2 else 0)
                elif base == Q:
                    marks |= 0 if run_of[kind] == IN_OTHER else MARK_HERE
                elif base in (BEGIN, DONE) or base != run_of[kind]:
                    marks |= MARK_HERE
                if kind == QUOTE and marks & MARK_HERE:
                    step[state, kind] = Q
            mark[state, kind] = marks
        step[state, RESET] = BEGIN
        mark[state, RESET] = MARK_BEFORE if state in (QR, QV, QL) else 0
    return step, mark


STEP, MARK = _splitter()


def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    major = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    kinds[major == "L"] = LETTER
    kinds[major == "N"] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    kinds[0x20] = BLANK
    for text, kind in (("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        kinds[[ord(c) for c in text]] = kind
    return kinds


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Row i becomes the composition of the state maps of rows 0 to i, in log2(rows) steps over all rows."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return maps


def piece_starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces start in a row of classes; texts are closed by RESET."""
    lanes = -(-len(kinds) // chunk)
    grid = np.full(lanes * chunk, RESET, np.uint8)
    grid[: len(kinds)] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    states = len(STEP)
    flat_step, flat_mark = STEP.ravel(), MARK.ravel()
    width = STEP.shape[1]
    # State maps of all chunks; most become constant after a few characters, and then one state stands for all.
    maps = np.repeat(np.arange(states, dtype=np.uint8)[None], lanes, axis=0)
    at = 0
    while at < chunk and not (at % 8 == 0 and (maps == maps[:, :1]).all()):
        maps = flat_step[maps.astype(np.intp) * width + grid[at][:, None]]
        at += 1
    if at < chunk:
        state = maps[:, 0]
        for row in grid[at:]:
            state = flat_step[state.astype(np.intp) * width + row]
        maps = np.repeat(state[:, None], states, axis=1)
    entry = np.full(lanes, BEGIN, np.uint8)
    entry[1:] = compose_scan(maps)[:-1, BEGIN]
    marks = np.empty_like(grid)
    state = entry
    for k, row in enumerate(grid):
        index = state.astype(np.intp) * width + row
        marks[k] = flat_mark[index]
        state = flat_step[index]
    marks = np.ascontiguousarray(marks.T).ravel()[: len(kinds)]
    starts = (marks & MARK_HERE).astype(bool)
    starts[:-1] |= (marks[1:] & MARK_BEFORE).astype(bool)
    return np.flatnonzero(starts)


class PieceCounts(dict):
    """Maps the bytes of a piece to its number of tokens, by the piece transducer."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        alphabet = byte_alphabet()
        self.special = [t["content"].encode() for t in model["added_tokens"]]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        order = [bytes([b]) for b in range(256)] + [bytes(alphabet[c] for c in a + b) for a, b in merges]
        self.rank = {token: i for i, token in enumerate(order)}
        self.token = order
        self.begins = {token[:n] for token in order for n in range(1, len(token))}
        self.encode = tiktoken.Encoding(
            "bytes", pat_str=r"[\s\S]+", mergeable_ranks=self.rank, special_tokens={}
        )._core_bpe.encode_single_piece
        self.missed = 0
        self.forget()

    def forget(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.state_of = {(b"", ((0, -1, 0),)): 0}
        self.states = [(b"", ((0, -1, 0),))]
        self.moves: dict[int, tuple[int, int]] = {}

    def follow(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when they are neighbours."""
        key = left << 20 | right
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self.encode(self.token[left] + self.token[right]) == [left, right]
        return got

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the count."""
        tail, open_at = self.states[state]
        tail += bytes([byte])
        last, change = -1, 0
        for length, token, between in open_at:
            new = self.rank.get(tail[len(tail) - length - 1 :])
            if new is not None and (token < 0 or self.follow(token, new)):
                last, change = new, between + 1
                break
        still = [(n + 1, t, b - change) for n, t, b in open_at if tail[len(tail) - n - 1 :] in self.begins]
        key = (tail[len(tail) - max((n for n, _, _ in still), default=0) :], (*still, (0, last, 0)))
        to = self.state_of.get(key)
        if to is None:
            to = self.state_of[key] = len(self.states)
            self.states.append(key)
        got = self.moves[state << 8 | byte] = (to, change)
        return got

    def __missing__(self, piece: bytes) -> int:
        if len(self.moves) > TRANSITIONS_KEPT:
            self.forget()
        moves, state, count = self.moves, 0, 0
        for byte in piece:
            move = moves.get(state << 8 | byte) or self.compile(state, byte)
            state = move[0]
            count += move[1]
        self.missed += 1
        if self.missed > 8 * PIECES_KEPT:
            self.clear()
            self.missed = 0
        if len(piece) <= LONGEST_KEPT and len(self) < PIECES_KEPT:
            self[piece] = count
        return count


_LOADED: dict[str, tuple[PieceCounts, np.ndarray]] = {}


def _load(name: str) -> tuple[PieceCounts, np.ndarray]:
    if name not in _LOADED:
        _LOADED[name] = PieceCounts(public_tokenizers.path(name)), _classes()
    return _LOADED[name]


def count_tokens_of(texts: list[bytes], name: str) -> np.ndarray:
    """Numbers of tokens of UTF-8 texts."""
    counts, classes = _load(name)
    parts, owner, extra = texts, np.arange(len(texts)), np.zeros(len(texts), np.int64)
    for special in counts.special:
        if any(special in t for t in parts):
            cut = [t.split(special) for t in parts]
            sizes = np.array([len(c) for c in cut])
            np.add.at(extra, owner, sizes - 1)
            owner = np.repeat(owner, sizes)
            parts = [p for c in cut for p in c]
    # One reset symbol closes each part; NUL bytes hold its place and are given the class RESET.
    joined = b"\0".join(parts) + b"\0"
    data = np.frombuffer(joined, np.uint8)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    kinds = classes[np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    kinds[np.searchsorted(first, ends)] = RESET
    starts = first[piece_starts(kinds)]
    stops = np.append(starts[1:], len(data))[: len(starts)]
    part = np.searchsorted(ends, starts)
    np.minimum(stops, ends[part], out=stops)
    pieces = map(joined.__getitem__, map(slice, starts.tolist(), stops.tolist()))
    found = np.fromiter(map(counts.__getitem__, pieces), np.int64, len(starts))
    return extra + np.bincount(owner[part], weights=found, minlength=len(texts)).astype(np.int64)


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_COUNTS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()),
])


def _count(batches: Iterable[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = text_list(batch.column("text"))
        tokens = count_tokens_of(texts, name)
        yield batch_of(_COUNTS_ARROW, batch.column("doc_id"), list(map(len, texts)), tokens, tokens > limit)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. No shuffle; a text of any length is linear work."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(lambda batches: _count(batches, tokenizer, limit), COUNTS)
