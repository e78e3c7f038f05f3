"""Token counts from a compiled finite-state tokenizer (byte-level BPE).

Two deterministic transducers count what the tokenizer library would emit, without emitting it.

*Splitting.* The pattern that cuts a text into pieces (contractions, letters, digits, other signs and
white space, with the space before a word) is a machine of eight states over classes of characters
that already look ahead. Its transitions are marked with whether a piece starts. A slice of texts is cut into chunks of
equal length; each chunk is run from all eight states at once, which gives its state map, the maps are
composed by a parallel prefix scan, and a last run from the known states gives the starts.

*Merging.* Within a piece, BPE is a transducer over bytes whose transitions carry the change of the
token count. After each byte exactly one token can end the tokens of the piece so far: the one
that the tokens before it allow, as two neighbours of a BPE result stay apart when encoded
alone. So a state holds, for each place from which a longer token may still come, the bytes since, the token before it
and the count there. States are made when first met and kept in a table; all distinct pieces of a slice
run through it side by side, byte by byte.

Special tokens of the vocabulary count one wherever their string stands, as in the library.

Null texts count as empty. Empty texts have no tokens. A text is worked on whole, whatever its
length; a piece without a break is followed byte by byte. Repeated rows each have their row; an empty
table gives none. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import prepare, task
from casewise.llm.texts import codepoints, slices, span_hashes

LIMIT = 512
# States kept in the table of a worker; beyond that it starts anew.
MOST_STATES = 1 << 17
# A place is compared with others if at most so many longer tokens may come from it.
FEW_LONGER = 256
# Characters of a chunk; pieces longer than LONG_PIECE run alone.
CHUNK, LONG_PIECE = 64, 512

# Classes of characters. NEXT_SPACE: a space before another character; NEXT_GAP: other white space
# before another character; GAP: white space before white space or the end. QUOTE_1, QUOTE_2: an
# apostrophe with the one or two letters of a contraction after it.
LETTER, DIGIT, OTHER, QUOTE_1, QUOTE_2, NEXT_SPACE, NEXT_GAP, GAP = range(8)
# States: what piece is open.
CLOSED, IN_LETTERS, IN_DIGITS, IN_OTHER, AFTER_SPACE, IN_GAP, TWO_LEFT, ONE_LEFT = range(8)
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start mark by state * 16 + class; classes from 8 on begin a text and forget the state."""
    nexts, starts = np.zeros(128, np.uint8), np.zeros(128, bool)
    for state in range(8):
        for symbol in range(16):
            at, kind = (CLOSED, symbol - 8) if symbol >= 8 else (state, symbol)
            begins = True
            if kind == LETTER:
                if at in (TWO_LEFT, ONE_LEFT):
                    begins, to = False, ONE_LEFT if at == TWO_LEFT else CLOSED
                else:
                    begins, to = at not in (IN_LETTERS, AFTER_SPACE), IN_LETTERS
            elif kind == DIGIT:
                begins, to = at not in (IN_DIGITS, AFTER_SPACE), IN_DIGITS
            elif kind in (OTHER, QUOTE_1, QUOTE_2):
                begins, to = at not in (IN_OTHER, AFTER_SPACE), IN_OTHER
                if begins and kind != OTHER:
                    to = ONE_LEFT if kind == QUOTE_1 else TWO_LEFT
            elif kind == NEXT_SPACE:
                to = AFTER_SPACE
            elif kind == NEXT_GAP:
                to = CLOSED
            else:
                begins, to = at != IN_GAP, IN_GAP
            nexts[state * 16 + symbol], starts[state * 16 + symbol] = to, begins
    return nexts, starts


_NEXT, _STARTS = _splitter()
_kinds: list[np.ndarray] = []
_compiled: dict[bytes, Vocabulary] = {}


def _kind_table() -> np.ndarray:
    if not _kinds:
        made = np.full(0x110000, OTHER, np.uint8)
        for code in range(0x110000):
            first = unicodedata.category(chr(code))[0]
            if first == "L":
                made[code] = LETTER
            elif first == "N":
                made[code] = DIGIT
        made[_WHITE] = GAP
        _kinds.append(made)
    return _kinds[0]


def piece_starts(code: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Marks of the characters that start a piece; ``begins`` marks the first character of every text."""
    n = len(code)
    kind = _kind_table()[code].astype(np.int64)
    after = np.full(n + 3, -1, np.int64)
    after[:n] = code
    ends = np.ones(n + 2, bool)
    ends[: n - 1] = begins[1:]
    white = kind == GAP
    solid = np.zeros(n, bool)
    solid[:-1] = ~white[1:] & ~begins[1:]
    kind[white & solid] = NEXT_GAP
    kind[(code == 0x20) & solid] = NEXT_SPACE
    for at in np.flatnonzero(code == 0x27).tolist():
        one, two = (after[at + 1], after[at + 2]) if not ends[at] else (-1, -1)
        two = -1 if ends[at + 1] else two
        if one in (0x73, 0x74, 0x6D, 0x64):
            kind[at] = QUOTE_1
        elif (one, two) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
            kind[at] = QUOTE_2
    symbols = (kind + 8 * begins).astype(np.uint8)
    chunks = -(-n // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = _NEXT[maps * np.uint8(16) + column[:, None]]
    # Prefix scan: after step s, maps[k] leads through the 2s chunks up to k.
    step = 1
    while step < chunks:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = maps[:-1, CLOSED]
    marks = np.empty((CHUNK, chunks), bool)
    for k, column in enumerate(columns):
        at = state * np.uint8(16) + column
        marks[k] = _STARTS[at]
        state = _NEXT[at]
    return np.ascontiguousarray(marks.T).reshape(-1)[:n]


def _byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary and the transducer made from it so far."""

    def __init__(self, source: bytes):
        letters = _byte_letters()
        content = json.loads(source)
        model = content["model"]
        written = {name: bytes(letters[c] for c in name) for name in model["vocab"] if all(c in letters for c in name)}
        self.ids = {data: model["vocab"][name] for name, data in written.items()}
        self.data = {i: data for data, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        # Rank, left and right part of every token that is no single byte.
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = model["vocab"][a], model["vocab"][b]
            whole = model["vocab"][a + b]
            self.merges[left, right] = (rank, whole)
            self.parts.setdefault(whole, (rank, left, right))
        self.open: dict[bytes, list[int]] = {}
        for data, token in self.ids.items():
            for k in range(1, len(data)):
                self.open.setdefault(data[:k], []).append(token)
        special = sorted((t["content"] for t in content.get("added_tokens", []) if t["content"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in special)) if special else None
        self.places: dict[tuple[bytes, int], int | None] = {}
        self.alike: dict[tuple, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.made: list[tuple] = []
        self.to = np.full((1024, 256), -1, np.int32)
        self.change = np.zeros((1024, 256), np.int8)
        self._number(((b"", -1, 0),))

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one piece by the definition: the merge of lowest rank first, leftmost of equals."""
        out = [self.ids[bytes([b])] for b in data]
        while len(out) > 1:
            best = min(((self.merges[p][0], k) for k, p in enumerate(zip(out, out[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            k = best[1]
            out[k : k + 2] = [self.merges[out[k], out[k + 1]][1]]
        return out

    def _follows(self, before: int, token: int) -> bool:
        """Whether the token can stand after the other (-1: begin a piece).

        The two tokens that touch are taken apart again, the one merged last first. They stay apart
        unless the two that touch at some time would have been merged before they became part of more;
        of equal ranks the left pair is merged first.
        """
        if before < 0:
            return self.encode(self.data[token]) == [token]
        limit = len(self.merges)
        while True:
            merged = self.merges.get((before, token))
            if merged is not None and merged[0] < limit:
                return False
            left, right = self.parts.get(before), self.parts.get(token)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[0] > right[0]:
                limit, before = left[0], left[2]
            else:
                limit, token = right[0] + 1, right[1]

    def _place(self, since: bytes, before: int) -> int | None:
        """None if no longer token can come from the place, else one of the tokens ``before`` that allow the same ones."""
        key = since, before
        if key not in self.places:
            if len(self.places) > 1 << 20:
                self.places.clear()
                self.alike.clear()
            longer = self.open[since]
            if len(longer) > FEW_LONGER:
                self.places[key] = before
            else:
                allowed = tuple(t for t in longer if self._follows(before, t))
                self.places[key] = self.alike.setdefault((since, allowed), before) if allowed else None
        return self.places[key]

    def _number(self, state: tuple) -> int:
        known = self.states.get(state)
        if known is None:
            known = self.states[state] = len(self.made)
            self.made.append(state)
            if known >= len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        return known

    def arc(self, state: int, byte: int) -> None:
        """Add the transition of a state on a byte."""
        places, c = self.made[state], bytes([byte])
        here = places[-1][2]
        token, count = next(
            (self.ids[since + c], n + 1) for since, before, n in places if since + c in self.ids and self._follows(before, self.ids[since + c])
        )
        later = [(since + c, self._place(since + c, before), n - count) for since, before, n in places if since + c in self.open]
        later = tuple(place for place in later if place[1] is not None)
        self.to[state, byte] = self._number((*later, (b"", token, 0)))
        self.change[state, byte] = count - here

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of every piece, all pieces side by side."""
        if len(self.made) > MOST_STATES:
            self._clear()
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = starts[order], lengths[order]
        total = np.zeros(len(starts), np.int64)
        alone = int(np.searchsorted(-sizes, -LONG_PIECE, "left"))
        for k in range(alone):
            state, tokens = 0, 0
            for byte in data[starts[k] : starts[k] + sizes[k]].tolist():
                if self.to[state, byte] < 0:
                    self.arc(state, byte)
                tokens += int(self.change[state, byte])
                state = int(self.to[state, byte])
            total[k] = tokens
        state = np.zeros(len(starts), np.int64)
        for step in range(int(sizes[alone]) if alone < len(sizes) else 0):
            end = int(np.searchsorted(-sizes, -step, "left"))
            here = state[alone:end]
            byte = data[starts[alone:end] + step]
            to = self.to[here, byte]
            if (to < 0).any():
                for key in np.unique(here[to < 0] * 256 + byte[to < 0]).tolist():
                    self.arc(key >> 8, key & 255)
                to = self.to[here, byte]
            total[alone:end] += self.change[here, byte]
            state[alone:end] = to
        out = np.empty_like(total)
        out[order] = total
        return out

    def count_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every text."""
        n = len(offsets) - 1
        tokens = np.zeros(n, np.int64)
        borders = offsets[:-1]
        if self.special is not None and len(data):
            found = [m.span() for m in self.special.finditer(data.tobytes())]
            rows = np.searchsorted(offsets, [a for a, _ in found], "right") - 1
            found = [(a, b, r) for (a, b), r in zip(found, rows.tolist(), strict=True) if b <= offsets[r + 1]]
            if found:
                keep = np.ones(len(data), bool)
                for a, b, r in found:
                    keep[a:b] = False
                    tokens[r] += 1
                moved = np.concatenate([[0], np.cumsum(keep)])
                borders = np.concatenate([moved[offsets[:-1]], moved[[b for _, b, _ in found]]])
                data, offsets = data[keep], moved[offsets]
        if not len(data):
            return tokens
        code, at = codepoints(data)
        begins = np.zeros(len(data) + 1, bool)
        begins[borders] = True
        starts = at[piece_starts(code, begins[at])]
        ends = np.append(starts[1:], len(data))
        _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        counted = self.counts(data, starts[first], (ends - starts)[first])[which]
        total = np.concatenate([[0], np.cumsum(counted)])
        cut = np.searchsorted(starts, offsets)
        return tokens + total[cut[1:]] - total[cut[:-1]]


def count(batches: Iterator[pa.RecordBatch], source: bytes, limit: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    if source not in _compiled:
        _compiled.clear()
        _compiled[source] = Vocabulary(source)
    vocabulary = _compiled[source]
    for batch in batches:
        ids = batch.column("doc_id")
        for first, end, data, offsets in slices(batch.column("text")):
            tokens = vocabulary.count_texts(data, offsets)
            columns = [ids.slice(first, end - first), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; ``vocabulary`` is the path of a byte-level BPE file.

    The file, of fixed size, travels with the tasks, so only the driver needs the path.
    """
    prepare(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        source = file.read()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task(count, source, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
