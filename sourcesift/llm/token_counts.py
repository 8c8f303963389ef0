"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers stand behind each other. The *splitter* reads classes of characters
and marks where pre-tokens begin; a text is cut into equal chunks, each chunk's map from entry state
to exit state is worked out, the maps are composed by a parallel prefix scan, and only then are the
transitions' marks read off. The *piece* transducer reads a pre-token's bytes; each transition is
annotated with the number of tokens it adds, so a count is a sum along a path. Its states are
compiled on demand from the vocabulary and its merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sourcesift.llm.textwords import text_buffer

CHUNK = 256
#: Cells of transitions a worker keeps (4 bytes each); beyond it compilation starts anew, counts stay the same.
KEPT = 1 << 25
#: Longer pieces, in bytes, walk alone.
LONG = 256

# classes: letter, one of s t m d, r or v, e, l, number, other, apostrophe, space, other white space, end
LETTER, SHORT, RV, E, ELL, NUMBER, OTHER, QUOTE, SPACE, WHITE, END = range(11)
# states: start of a piece, in letters, numbers, others, after a space, after other white space,
# after an apostrophe that begins a piece, and after that and a letter that wants e or l
START, IN_L, IN_N, IN_O, AT_SP, AT_WH, Q, Q_E, Q_L = range(9)
HERE, BEFORE = 1, 2  # a piece begins at this character, or at the one before


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark for each (state, class)."""
    letters = {LETTER, SHORT, RV, E, ELL}
    fresh = {**dict.fromkeys(letters, IN_L), NUMBER: IN_N, OTHER: IN_O, QUOTE: Q, SPACE: AT_SP, WHITE: AT_WH, END: START}
    goes, marks = np.zeros((9, 11), np.int8), np.zeros((9, 11), np.int8)
    for state in range(9):
        for c in range(11):
            to, mark = fresh[c], HERE
            if state == IN_L and c in letters or state == IN_N and c == NUMBER:
                mark = 0
            elif state in (IN_O, Q) and c in (OTHER, QUOTE):
                to, mark = IN_O, 0
            elif state in (AT_SP, AT_WH) and c in (SPACE, WHITE, END):
                mark = 0
            elif state == AT_SP:
                to, mark = (IN_O if c == QUOTE else to), BEFORE
            elif state == AT_WH:
                mark = BEFORE | HERE
            elif state == Q and c == SHORT:
                to, mark = START, 0
            elif state == Q and c in (RV, ELL):
                to, mark = (Q_E if c == RV else Q_L), 0
            elif state == Q_E and c == E or state == Q_L and c == ELL:
                to, mark = START, 0
            elif state in (Q_E, Q_L):  # no contraction: the letter before began a piece of letters
                mark = BEFORE | (0 if c in letters else HERE)
            goes[state, c], marks[state, c] = to, mark
    return goes, marks


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.int8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    for text, kind in (("stmd", SHORT), ("rv", RV), ("e", E), ("l", ELL), ("'", QUOTE), (" ", SPACE)):
        out[[ord(c) for c in text]] = kind
    return out


def piece_marks(classes: np.ndarray) -> np.ndarray:
    """Run the splitter over classes: per position, whether a piece begins there."""
    goes, marks = _splitter()
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, END, np.int8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    flat, width = goes.ravel(), goes.shape[1]
    maps = np.broadcast_to(np.arange(9, dtype=np.int8), (rows, 9)).copy()
    for c in grid:  # all chunks and all entry states in step
        maps = flat[maps.astype(np.int16) * width + c[:, None]]
    step = 1
    while step < rows:  # maps[i] becomes the map of all chunks up to i
        later = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.full(rows, START, np.int16)
    state[1:] = maps[:-1, START]
    said = np.empty((CHUNK, rows), np.int8)
    signs = marks.ravel()
    for i, c in enumerate(grid):
        key = state * width + c
        said[i] = signs[key]
        state = flat[key].astype(np.int16)
    said = said.T.ravel()[:n]
    begins = (said & HERE) > 0
    begins[:-1] |= (said[1:] & BEFORE) > 0
    return begins


class PieceTransducer:
    """Bytes of a pre-token -> number of tokens, by annotated transitions."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        raw = lambda t: bytes(byte[c] for c in t)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if t not in self.specials}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in reversed(self.rank)}
        self.made = {token: self.rank[pair] for token, pair in self.parts.items()}
        self.edges: tuple[dict, dict] = ({}, {})
        self.heads = {token[:i] for token in self.vocab for i in range(1, len(token))} | {b""}
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.names = {(b"", (b"",), (0,)): 0}
        self.states = list(self.names)
        # next state and added tokens in one cell, -1 where not compiled; a column for each byte seen
        self.cells = np.full((1024, 128), -1, np.int32)
        self.column = np.full(256, -1, np.int64)
        self.stable.clear()

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int, float]]:
        """The pieces at one side of a token while it is built: (piece, rank it is made at, rank it goes at)."""
        if (found := self.edges[side].get(token)) is None:
            found, gone, piece = [], float("inf"), token
            while True:
                made = self.made.get(piece, -1)
                found.append((piece, made, gone))
                if made < 0:
                    break
                gone, piece = made, self.parts[piece][side]
            self.edges[side][token] = found
        return found

    def _stays(self, a: bytes, b: bytes) -> bool:
        """Whether merging the bytes of a + b gives exactly these two tokens.

        They are joined if a piece at a's end and one at b's start exist together and their merge
        comes before the merges that take them up; of equal merges the left one comes first.
        """
        key = (a, b)
        if (known := self.stable.get(key)) is None:
            rank = self.rank
            known = self.stable[key] = not any(
                (r := rank.get((x, y))) is not None and r < x_gone and r <= y_gone and y_made < x_gone and x_made <= y_gone
                for x, x_made, x_gone in self._edge(a, 1)
                for y, y_made, y_gone in self._edge(b, 0)
            )
        return known

    def _compile(self, state: int, byte: int) -> None:
        """Add the transition from ``state`` over ``byte``.

        A state holds the longest read suffix with which a token can still begin, and for each
        position within it the token that ends there and the count so far relative to now. The next
        last token is the one whose neighbour before it stays whole; it is unique.
        """
        suffix, ends, counts = self.states[state]
        suffix += bytes([byte])
        for size in range(len(suffix), 0, -1):
            token, at = suffix[-size:], len(suffix) - size
            if token in self.vocab and (not ends[at] or self._stays(ends[at], token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        add = counts[at] + 1
        keep = next(n for n in range(len(suffix), -1, -1) if suffix[len(suffix) - n :] in self.heads)
        suffix, ends, counts = suffix[len(suffix) - keep :], (*ends, token)[-keep - 1 :], (*(c - add for c in counts), 0)[-keep - 1 :]
        # positions at which no token can still begin say nothing about what follows
        open_ = [suffix[i:] in self.heads for i in range(keep + 1)]
        after = (suffix, tuple(x if o else b"?" for x, o in zip(ends, open_, strict=True)), tuple(x if o else 0 for x, o in zip(counts, open_, strict=True)))
        to = self.names.setdefault(after, len(self.states))
        if to == len(self.states):
            self.states.append(after)
            if to == len(self.cells):
                self.cells = np.concatenate([self.cells, np.full_like(self.cells, -1)])
        self.cells[state, self.column[byte]] = to << 8 | add + 128

    def _long(self, piece: bytes) -> int:
        state = total = 0
        for byte in piece:
            if (cell := int(self.cells[state, self.column[byte]])) < 0:
                self._compile(state, byte)
                cell = int(self.cells[state, self.column[byte]])
            total += (cell & 255) - 128
            state = cell >> 8
        return total

    def counts(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Tokens of each piece: all pieces step through the transducer together."""
        if self.cells.size > KEPT:
            self.clear()
        new = np.flatnonzero(np.bincount(data, minlength=256) * (self.column < 0))
        self.column[new] = self.column.max() + 1 + np.arange(len(new))
        while self.column.max() >= self.cells.shape[1]:
            self.cells = np.concatenate([self.cells, np.full_like(self.cells, -1)], axis=1)
        size, total, state = e - s, np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        for i in np.flatnonzero(size > LONG):
            total[i] = self._long(data[s[i] : e[i]].tobytes())
        live, j = np.flatnonzero((size > 0) & (size <= LONG)), 0
        while len(live):
            byte = data[s[live] + j]
            cell = self.cells[state[live], self.column[byte]]
            if (new := cell < 0).any():
                for key in np.unique(state[live[new]] << 8 | byte[new]).tolist():
                    self._compile(key >> 8, key & 255)
                cell = self.cells[state[live], self.column[byte]]
            total[live] += (cell & 255) - 128
            state[live] = cell >> 8
            j += 1
            live = live[size[live] > j]
        return total


@lru_cache(4)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def text_token_counts(texts: pa.Array, path: str, most: int = 2 << 20) -> np.ndarray:
    """Tokens of each text; null counts as empty."""
    machine = transducer(path)
    data, at = text_buffer(texts)
    total = np.zeros(len(texts), np.int64)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        part, cut = data[at[row] : at[end]], at[row : end + 1] - at[row]
        total[row:end] = _chunk_counts(machine, part, cut)
        row = end
    return total


def _chunk_counts(machine: PieceTransducer, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(at) - 1, np.int64)
    if not len(data):
        return total
    raw = data.tobytes()
    ends, owner, skip = at[1:], np.arange(len(total)), []
    for special in machine.specials:  # such a string is one token, and texts end and begin around it
        mark, i = special.encode(), raw.find(special.encode())
        while i >= 0:
            row = int(np.searchsorted(at, i, "right")) - 1
            if i + len(mark) <= at[row + 1]:
                skip.append((i, i + len(mark), row))
                i = raw.find(mark, i + len(mark))
            else:
                i = raw.find(mark, i + 1)
    if skip:
        stops = sorted([(int(e), r) for e, r in zip(ends, owner, strict=True)] + [(b, r) for a, z, r in skip for b in (a, z)])
        ends, owner = np.array([x for x, _ in stops]), np.array([r for _, r in stops])
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte offset of each character
    stop = np.searchsorted(lead, ends)  # characters before each end
    classes = np.full(len(cp) + len(stop), END, np.int8)
    place = np.arange(len(cp)) + np.searchsorted(stop, np.arange(len(cp)), "right")
    classes[place] = _classes()[cp]
    begins = piece_marks(classes)[place]
    s = lead[begins]
    e = np.append(s[1:], len(data))
    counts = machine.counts(data, s, e)
    rows = np.searchsorted(at, s, "right") - 1
    if skip:
        inside = np.zeros(len(s), bool)
        for a, z, row in skip:
            inside[np.searchsorted(s, a) : np.searchsorted(s, z)] = True
            total[row] += 1
        counts[inside] = 0
    np.add.at(total, rows, counts)
    return total


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row.

    Null and empty texts have 0 bytes and tokens; repeated rows give repeated results; an empty table
    gives an empty one; other columns are left out, whatever their names. Texts are never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n_bytes = np.diff(text_buffer(texts)[1])
            n = text_token_counts(texts, path)
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
