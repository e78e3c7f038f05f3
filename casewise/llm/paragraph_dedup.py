"""Repeated passages: equal word runs by winnowed anchors, similar ones by MinHash banding of paragraphs.

Equal runs. In every window of ``WINDOW`` words the word of the smallest hash is an anchor; an anchor
stands for the ``GRAM`` words from it on. It depends on no more than its window, so a run of
``WINDOW + GRAM - 1`` words (49) that two documents share anywhere holds an anchor whose gram both have,
whatever stands around it and wherever lines and sentences end. Near such anchors the text is cut at every
anchor into segments. A segment that several documents have whole is one row. Only of the others, where runs
begin and end, and of the first occurrence of a whole one are the single grams looked up, so the run is known word by
word to its true borders. Of the occurrences of a segment or gram the one with the smallest (doc_id, place) is kept.

Similar passages. A text is cut into paragraphs: a paragraph ends at a line end, at the end of a sentence
once it has 8 words, or, from 24 words on, at a word whose hash ends in three zero bits. Words are lower-cased;
a paragraph is the sequence of its words and has a set of five-word shingles.

Paragraphs of equal words are one class. Bands of MinHash values find classes whose sets may reach
a Jaccard similarity of 0.75; the bands are as many as give the wanted recall at that similarity. Colliding
classes are verified on the exact sets and joined to components, large groups of colliding
classes around a centre and, where that leaves several components, block by block (see
``jaccard_join``). A component that occurs in more than one document, in equal or similar
paragraphs, is repeated; its occurrence with the smallest (doc_id, place) is kept and the others go.

Adjoining repeated words of a document, kept or removed, make one stretch; stretches below ``LEAST_WORDS``
words, such as licence lines, are left alone. The others are reported in pieces that share a fate; a word goes if
anything that covers it goes, and what it repeats stands in an earlier place. Of a kept paragraph three quarters of
which go, the words left are not reported.

Null and empty texts have no paragraph. Rows that repeat an id are one document, whatever their
texts; a null id is a document of its own kind (all null ids are one). An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import Workspace, group_task, prepare, task
from casewise.llm.jaccard_join import BLOCKS, FLUSH, FOUND, LEAST_RANGES, blocks, class_roots, class_sets, filter_bits, meet, passes, wanted
from casewise.llm.texts import U, mix, powers, shingles, slices, sorted_sets, span_hashes, word_spans
from casewise.session import Scratch

SIMILARITY, RECALL, ROWS = 0.75, 0.99, 1
SENTENCE_WORDS, LONG_WORDS = 8, 24
LEAST_WORDS = 25
# Words of a window that has an anchor, and of the gram an anchor stands for; WINDOW is at most GRAM.
WINDOW, GRAM = 25, 25
RANGE_BYTES = 1 << 21
# Texts of about this many bytes are worked on at a time, so that their arrays stay in the processor's cache.
SLICE = 1 << 18

_ANCHOR, _GRAM, _SEGMENT = U(0x8CB92BA72F3D8DD7), U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B)
_WORD_BASE, _CLASS, _BAND = U(0xD1B54A32D192ED03), U(0x2545F4914F6CDD1D), 0x5851F42D4C95
_END = np.zeros(256, bool)
_END[[ord("."), ord("!"), ord("?")]] = True
_UNITS = "doc_id long, text_key long, unit int, first int, words int, start int, end int, before int, after int, a long"
_GRAMS = "a long, low long, mark long"
_SEGMENTS = f"{_GRAMS}, several boolean, seen long"
_PASSAGES = "doc_id long, start_byte int, end_byte int, words long, kept_doc_id long, removed boolean"
# A gram or segment with its first occurrence (document; place and text), whether several documents have it, and whether
# an occurrence of it lies in a whole segment that several documents have.
_HELD = np.dtype([("kind", "<u8"), ("doc", "<u8"), ("mark", "<u8"), ("several", "?"), ("inner", "?")])
_TOP, _LAST, _PLACE_BITS = U(1 << 63), U((1 << 64) - 1), U((1 << 32) - 1)
_NULL = -(1 << 63)


def bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed to find pairs of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class Cut(NamedTuple):
    """The words of some texts (start, end, text, hash; running sums of the hashes' polynomial) and their paragraphs (text, place in it, first word, end word, class)."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    words: np.ndarray
    sums: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    first: np.ndarray
    end: np.ndarray
    kind: np.ndarray


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> Cut:
    """The words and paragraphs of texts."""
    starts, ends, row = word_spans(data, offsets)
    n = len(starts)
    if not n:
        none, empty = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Cut(none, none, none, empty, np.zeros(1, np.uint64), none, none, none, none, empty)
    words = span_hashes(data, starts, ends, lower=True)
    hard = np.ones(n, bool)
    hard[:-1] = row[1:] != row[:-1]
    # The word before a line end.
    before = np.searchsorted(starts, np.flatnonzero(data == 0x0A)) - 1
    hard[before[before >= 0]] = True
    end = closes(hard, _END[data[ends - 1]], (words & U(7)) == 0) + 1
    first = np.concatenate([[0], end[:-1]])
    owner = row[first]
    # The class: a polynomial over the words' hashes.
    power, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words ^ _WORD_BASE) * power[:n], out=sums[1:])
    kind = mix((sums[end] - sums[first]) * inverse[first] ^ _CLASS)
    return Cut(starts, ends, row, words, sums, owner, places(owner), first, end, kind)


def closes(hard: np.ndarray, soft: np.ndarray, loose: np.ndarray) -> np.ndarray:
    """The last words of paragraphs."""
    some = np.flatnonzero(hard | soft | loose)
    # Words that a paragraph must have to end there.
    least = np.where(hard[some], 0, np.where(soft[some], SENTENCE_WORDS, LONG_WORDS))
    made, last = [], -1
    for k, size in zip(some.tolist(), least.tolist(), strict=True):
        if k - last >= size:
            made.append(k)
            last = k
    return np.array(made, np.int64)


def places(row: np.ndarray) -> np.ndarray:
    """The place of every element in its row."""
    counts = np.bincount(row)
    return np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def grams(cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the ``GRAM`` words from every word on, and whether they lie in one text."""
    n = len(cut.words) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    _, inverse = powers(len(cut.words))
    return mix((cut.sums[GRAM:] - cut.sums[:-GRAM]) * inverse[:n] ^ _GRAM), cut.row[:n] == cut.row[GRAM - 1 :]


def anchors(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The words that are the first of the smallest hash in a window of their text."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64)
    # Hashes with the word's place in the low half: the smallest of ever longer windows, each from two that overlap.
    least = mix(words ^ _ANCHOR) & ~_PLACE_BITS | np.arange(len(words), dtype=np.uint64)
    size = 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        least = np.minimum(least[step:], least[:-step])
        size += step
    at = (least & _PLACE_BITS).astype(np.int64)[row[: len(least)] == row[WINDOW - 1 :]]
    # Anchors never go back from one window to the next.
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def text_keys(owner: np.ndarray, place: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
    """A hash of each text's paragraphs."""
    key = np.zeros(n, np.uint64)
    np.add.at(key, owner, mix(kind + place.astype(np.uint64)))
    return key


def _unit_shingles(first: np.ndarray, end: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingles(words, np.repeat(np.arange(len(first)), end - first), len(first))


def pack(batches: Iterator[pa.RecordBatch], ranges: int, count: int) -> Iterator[pa.RecordBatch]:
    """MinHash signatures with their class in blocks by hash range; from part ``ranges`` on, classes with the first document that has them, and from ``2 * ranges`` on, grams of anchors likewise.

    A class block holds classes, documents (hashed ids), and whether several documents had it already.
    """
    sigs: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    kinds: list[np.ndarray] = []
    papers: list[np.ndarray] = []
    tied: list[np.ndarray] = []
    tied_papers: list[np.ndarray] = []
    size = 0

    def flush():
        if sigs:
            yield blocks(np.concatenate(sigs), np.concatenate(owners), ranges)
        yield held(kinds, papers, ranges)
        if any(map(len, tied)):
            yield held(tied, tied_papers, 2 * ranges)

    def held(kinds, papers, base):
        kind, paper = np.concatenate(kinds), np.concatenate(papers)
        order = np.lexsort((paper, kind))
        kind, paper = kind[order], paper[order]
        start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        end = np.concatenate([start[1:], [len(kind)]]) - 1
        kind, low, high = kind[start], paper[start], paper[end]
        # The lowest bit of the document's hash says that there were others.
        low = low & ~U(1) | (low != high).astype(np.uint64)
        part = ((kind >> U(32)) * U(ranges) >> U(32)).astype(np.int32)
        cut = np.searchsorted(part, np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(cut))
        packed = [kind[cut[p] : cut[p + 1]].tobytes() + low[cut[p] : cut[p + 1]].tobytes() for p in full]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32) + np.int32(base)), pa.array(packed, pa.binary())], ["part", "packed"])

    for batch in batches:
        ids = batch.column("doc_id").fill_null(-1).to_numpy().view(np.uint64)
        for begin, _, data, offsets in slices(batch.column("text"), SLICE):
            cut = paragraphs(data, offsets)
            row, words, owner, first, end, kind = cut.row, cut.words, cut.owner, cut.first, cut.end, cut.kind
            if not len(kind):
                continue
            kinds.append(kind)
            papers.append(mix(ids[begin + owner]) << U(1))
            gram, whole = grams(cut)
            at = anchors(words, row)
            at = at[at < len(gram)]
            at = at[whole[at]]
            tied.append(gram[at])
            tied_papers.append(mix(ids[begin + row[at]]) << U(1))
            _, once = np.unique(kind, return_index=True)
            values, at = _unit_shingles(first[once], end[once], words_of(first, end, once, words))
            several = np.flatnonzero(np.diff(at) > 2)
            cuts = at[several]
            for k in range(count):
                if len(several):
                    least = np.minimum.reduceat(mix(values ^ U((k + 1) * _BAND)), at[:-1])[several]
                    sigs.append(mix(least + U(k)))
                    owners.append(kind[once][several])
            size += len(kind) + len(tied[-1]) + count * len(cuts)
        if size >= FLUSH:
            yield from flush()
            for held_back in (sigs, owners, kinds, papers, tied, tied_papers):
                held_back.clear()
            size = 0
    if kinds:
        yield from flush()


def words_of(first: np.ndarray, end: np.ndarray, some: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The words of some paragraphs, one after the other."""
    length = (end - first)[some]
    at = np.cumsum(length) - length
    return words[np.arange(length.sum()) - np.repeat(at, length) + np.repeat(first[some], length)]


def gather(rows: pa.Table, ranges: int) -> pa.Table:
    """Candidates of a hash range (see ``meet``), or the classes (kind 2) and grams of anchors (kind 3) that several documents have."""
    if rows.column("part")[0].as_py() < ranges:
        return meet(rows)
    halves = [np.frombuffer(x, np.uint64) for x in rows.column("packed").to_pylist()]
    kind = np.concatenate([h[: len(h) // 2] for h in halves])
    paper = np.concatenate([h[len(h) // 2 :] for h in halves])
    order = np.lexsort((paper, kind))
    kind, paper = kind[order], paper[order]
    start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    end = np.concatenate([start[1:], [len(kind)]]) - 1
    several = np.bitwise_or.reduceat(paper & U(1), start).astype(bool) | (paper[start] >> U(1) != paper[end] >> U(1))
    found = kind[start[several]].view(np.int64)
    which = 2 if rows.column("part")[0].as_py() < 2 * ranges else 3
    return pa.table({"kind": pa.array(np.full(len(found), which, np.int32)), "a": pa.array(found), "b": pa.array(found)})


def wanted_sets(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the paragraph classes that pass the filter."""
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text"), SLICE):
            cut = paragraphs(data, offsets)
            words, first, end, kind = cut.words, cut.first, cut.end, cut.kind
            _, once = np.unique(kind, return_index=True)
            once = once[passes(bits, kind[once])]
            if len(once):
                values, at = sorted_sets(*_unit_shingles(first[once], end[once], words_of(first, end, once, words)))
                yield wanted(kind[once], values, at, bits)


def _firsts(held: np.ndarray) -> np.ndarray:
    """Each gram or segment once, with its first occurrence."""
    order = np.argsort(held["kind"])
    kind, doc, mark, several, inner = (held[c][order] for c in _HELD.names)
    start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    length = np.diff(np.append(start, len(kind)))
    out = np.empty(len(start), _HELD)
    out["kind"] = kind[start]
    doc_low, doc_high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
    # Marks count in the first document.
    first = doc == np.repeat(doc_low, length)
    out["doc"], out["mark"] = doc_low, np.minimum.reduceat(np.where(first, mark, _LAST), start)
    inner = np.logical_or.reduceat(inner, start)
    # An occurrence in a repeated segment stands for those in other documents.
    others = (doc_low != doc_high) | inner & (out["mark"] != np.maximum.reduceat(mark, start))
    out["several"] = np.logical_or.reduceat(several, start) | others
    out["inner"] = inner
    return out


def _pieces(held: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Grams or segments, each once, in blocks by hash range."""
    held = _firsts(held)
    part = ((held["kind"] >> U(32)) * U(ranges) >> U(32)).astype(np.int32)
    cut = np.searchsorted(part, np.arange(ranges + 1))
    full = np.flatnonzero(np.diff(cut))
    packed = [held[cut[p] : cut[p + 1]].tobytes() for p in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(packed, pa.binary())], ["part", "packed"])


def seen(kind: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """A hash of one occurrence of a segment."""
    return mix(kind ^ mix(doc ^ mix(mark)))


class Near:
    """What is looked up of some texts: segments near anchors of which other documents have the gram, and single grams."""

    def __init__(self, cut: Cut, ids: np.ndarray, texts: int, tied: bytes):
        self.row = row = cut.row
        self.gram, whole = grams(cut)
        n = len(self.gram)
        at = anchors(cut.words, row)
        at = at[at < n]
        at = at[whole[at]]
        tie = at[passes(tied, self.gram[at])]
        steps = np.bincount(np.maximum(tie - WINDOW + 1, 0), minlength=n + 1)
        steps -= np.bincount(np.minimum(tie + WINDOW, n), minlength=n + 1)
        self.near = (np.cumsum(steps)[:-1] > 0) & whole
        # Segments begin at every anchor and at the first gram of a text, and take in all grams up to the next.
        begins = whole & ~np.append(False, whole)[:n]
        closes = np.flatnonzero(whole & ~np.append(whole, False)[1:])
        begins[at] = True
        low = np.flatnonzero(begins)
        high = np.minimum(np.append(low[1:], n), closes[np.searchsorted(closes, low)] + 1) if len(low) else low
        count = np.concatenate([[0], np.cumsum(self.near)])
        some = count[high] > count[low]
        self.low, self.high = low[some], high[some]
        self.key = text_keys(cut.owner, cut.place, cut.kind, texts)
        self.place = places(row)
        self.ids = ids
        _, inverse = powers(len(row))
        self.segment = mix((cut.sums[self.high - 1 + GRAM] - cut.sums[self.low]) * inverse[self.low] ^ _SEGMENT)

    def held(self, kind: np.ndarray, at: np.ndarray, inner: np.ndarray | bool = False) -> np.ndarray:
        out = np.zeros(len(at), _HELD)
        out["kind"], out["doc"], out["inner"] = kind, self.ids[self.row[at]], inner
        out["mark"] = _marks(self.place[at], self.key[self.row[at]])
        return out

    def singles(self, lone: bytes, leading: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The grams to look up one by one: in segments that may be of one document only, and in first occurrences of the others (true)."""
        held = self.held(self.segment, self.low)
        alone = passes(lone, self.segment)
        take = alone | passes(leading, seen(held["kind"], held["doc"], held["mark"]))
        length = (self.high - self.low)[take]
        begin = np.cumsum(length) - length
        q = np.arange(length.sum()) - np.repeat(begin, length) + np.repeat(self.low[take], length)
        inner = np.repeat(~alone[take], length)
        some = self.near[q] | inner
        return q[some], inner[some]


def _texts_near(batch: pa.RecordBatch, tied: bytes) -> Iterator[tuple]:
    ids = batch.column("doc_id").fill_null(_NULL).to_numpy().view(np.uint64) ^ _TOP
    for begin, _, data, offsets in slices(batch.column("text"), SLICE):
        cut = paragraphs(data, offsets)
        if len(cut.kind):
            yield begin, offsets, cut, Near(cut, ids[begin : begin + len(offsets) - 1], len(offsets) - 1, tied)


def _flushed(found: Iterator[np.ndarray], ranges: int) -> Iterator[pa.RecordBatch]:
    kept: list[np.ndarray] = []
    size = 0
    for held in found:
        kept.append(held)
        size += len(held)
        if size >= FLUSH:
            yield _pieces(np.concatenate(kept), ranges)
            kept, size = [], 0
    if size:
        yield _pieces(np.concatenate(kept), ranges)


def near_segments(batches: Iterator[pa.RecordBatch], tied: bytes, ranges: int) -> Iterator[pa.RecordBatch]:
    """The segments near an anchor that passes the filter, in blocks by hash range."""
    yield from _flushed((t.held(t.segment, t.low) for batch in batches for *_, t in _texts_near(batch, tied)), ranges)


def near_grams(batches: Iterator[pa.RecordBatch], tied: bytes, lone: bytes, leading: bytes, ranges: int) -> Iterator[pa.RecordBatch]:
    """The grams that are looked up one by one, in blocks by hash range."""

    def found():
        for batch in batches:
            for *_, t in _texts_near(batch, tied):
                q, inner = t.singles(lone, leading)
                yield t.held(t.gram[q], q, inner)

    yield from _flushed(found(), ranges)


def _marks(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """An occurrence within a document: its place, then its text."""
    return places.astype(np.uint64) << U(32) | keys & U(0xFFFFFFFF)


def _firsts_of(rows: pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
    held = _firsts(np.concatenate([np.frombuffer(x, _HELD) for x in rows.column("packed").to_pylist()]))
    columns = (held["kind"], held["doc"] ^ _TOP, held["mark"])
    return held, [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns]


def segment_firsts(rows: pa.Table) -> pa.Table:
    """The segments of a hash range: hash, first document and occurrence in it, whether several documents have it, hash of that occurrence."""
    held, columns = _firsts_of(rows)
    which = seen(*(np.ascontiguousarray(held[c]) for c in ("kind", "doc", "mark")))
    columns += [pa.array(np.ascontiguousarray(held["several"])), pa.array(which.view(np.int64))]
    return pa.table(columns, names=["a", "low", "mark", "several", "seen"])


def repeated_grams(rows: pa.Table) -> pa.Table:
    """The grams of a hash range that several documents have: hash, first document and occurrence in it."""
    held, columns = _firsts_of(rows)
    return pa.table(columns, names=["a", "low", "mark"]).filter(pa.array(np.ascontiguousarray(held["several"])))


def locate(
    batches: Iterator[pa.RecordBatch], bits: bytes, tied: bytes, lone: bytes, leading: bytes, whole_bits: bytes, gram_bits: bytes
) -> Iterator[pa.RecordBatch]:
    """The paragraphs, segments and grams (both unit -1) whose class passes its filter, with their place in words and bytes."""
    names = [c.split()[0] for c in _UNITS.split(", ")]
    for batch in batches:
        ids = batch.column("doc_id")
        for begin, offsets, cut, t in _texts_near(batch, tied):
            starts, ends, row, place, first, end, kind = cut.starts, cut.ends, cut.row, cut.place, cut.first, cut.end, cut.kind
            hit, run = np.flatnonzero(passes(bits, kind)), np.flatnonzero(passes(whole_bits, t.segment))
            near, _ = t.singles(lone, leading)
            near = near[passes(gram_bits, t.gram[near])]
            low = np.concatenate([first[hit], t.low[run], near])
            high = np.concatenate([end[hit], t.high[run] - 1 + GRAM, near + GRAM])
            of = row[low]
            base = offsets[of]
            previous, following = np.maximum(low - 1, 0), np.minimum(high, len(row) - 1)
            before = np.where((previous < low) & (row[previous] == of), ends[previous], starts[low])
            after = np.where((following == high) & (row[following] == of), starts[following], ends[high - 1])
            unit = np.concatenate([place[hit], np.full(len(run) + len(near), -1)])
            columns = [ids.take(pa.array(begin + of)), pa.array(t.key[of].view(np.int64))]
            numbers = (unit, t.place[low], high - low, starts[low] - base, ends[high - 1] - base, before - base, after - base)
            columns += [pa.array(x.astype(np.int32)) for x in numbers]
            classes = np.concatenate([kind[hit], t.segment[run], t.gram[near]])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(classes.view(np.int64))], names)


def join_up(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Passages from repeated units, which come ordered by document and text."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        new = _new_texts(rows)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield from _passages(rows.slice(0, last), least)
        held = rows.slice(last)
    if held is not None:
        yield from _passages(held, least)


def _new_texts(rows: pa.Table) -> np.ndarray:
    new = np.ones(len(rows), bool)
    new[1:] = False
    for c in ("doc_id", "text_key"):
        x = rows.column(c).fill_null(_NULL).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _passages(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """The passages of whole texts."""
    doc, kept = (rows.column(c).fill_null(_NULL).to_numpy() for c in ("doc_id", "kept_doc_id"))
    low, words, start, end, before, after = (rows.column(c).to_numpy().astype(np.int64) for c in ("first", "words", "start", "end", "before", "after"))
    removed = rows.column("removed").to_numpy(zero_copy_only=False)
    new = np.flatnonzero(_new_texts(rows))
    text = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(doc))))
    # One line of words for all texts, with a gap between them.
    room = np.maximum.reduceat(low + words, new) + 2
    base = np.cumsum(room) - room
    low = low + base[text]
    high = low + words
    edge = np.unique(np.concatenate([low, high]))
    at_low, at_high = np.searchsorted(edge, low), np.searchsorted(edge, high)

    def covered(some):
        steps = np.bincount(at_low[some], minlength=len(edge)) - np.bincount(at_high[some], minlength=len(edge))
        return np.cumsum(steps)[:-1] > 0

    gone = covered(removed)
    # Of a kept paragraph whose words go to the similarity, the rest is no copy of its own.
    lost = np.concatenate([[0], np.cumsum(np.diff(edge) * gone)])
    held = covered(removed | (rows.column("unit").to_numpy() < 0) | (lost[at_high] - lost[at_low] < SIMILARITY * words))
    opens, closes = np.empty(len(edge), np.int64), np.empty(len(edge), np.int64)
    opens[at_high], closes[at_low] = after, before
    opens[at_low], closes[at_high] = start, end
    was = np.concatenate([[False], held[:-1]])
    stretch = np.cumsum(held & ~was) - 1
    first = held & (~was | (gone != np.concatenate([[False], gone[:-1]])))
    piece = np.cumsum(first) - 1
    head = np.flatnonzero(first)
    tail = np.flatnonzero(held & np.append(first[1:] | ~held[1:], True)) + 1
    length = np.bincount(stretch[held], np.diff(edge)[held]).astype(np.int64)
    owner = new[np.searchsorted(base, edge[head], "right") - 1]
    keeper = doc[owner].copy()
    # Of a removed piece, the document that keeps most of its words.
    some = np.flatnonzero(removed)
    some = some[np.argsort(low[some], kind="stable")]
    if len(some):
        of = piece[at_low[some]]
        reach = np.minimum(high[some], np.append(np.where(of[1:] == of[:-1], low[some][1:], high[some][:-1]), high[some][-1]))
        order = np.lexsort((kept[some], of))
        of, who, weight = of[order], kept[some][order], (reach - low[some])[order]
        begin = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (who[1:] != who[:-1])]))
        of, who, weight = of[begin], who[begin], np.add.reduceat(weight, begin)
        order = np.lexsort((who, -weight, of))
        best = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
        keeper[of[best]] = who[best]
    pick = np.flatnonzero(length[stretch[head]] >= least)
    long_ids = [pa.array(x[pick], mask=x[pick] == _NULL) for x in (doc[owner], keeper)]
    places = [pa.array(x[pick].astype(np.int32)) for x in (opens[head], closes[tail])]
    columns = [long_ids[0], *places, pa.array((edge[tail] - edge[head])[pick]), long_ids[1], pa.array(gone[head][pick])]
    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start_byte", "end_byte", "words", "kept_doc_id", "removed"])


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start_byte, end_byte, words, kept_doc_id, removed: every passage that other documents repeat.

    ``removed`` is false for the occurrence that is kept; ``kept_doc_id`` is the document that keeps most of the passage's
    words (the smallest of equals).
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(LEAST_RANGES // 2, size // RANGE_BYTES)
    packed = texts.mapInArrow(task(pack, ranges, bands()), BLOCKS)
    work = Workspace()
    found = work.keep(packed.groupBy("part").applyInArrow(group_task(gather, ranges), FOUND), "paragraphs")
    roots = class_roots(found, partial(class_sets, docs.select("text"), wanted_sets))
    several = found.where("kind = 2").select("a")
    linked = roots.select(F.col("node").alias("a"), "root")
    classes = work.keep(several.join(linked, "a", "full").select("a", F.coalesce("root", "a").alias("root")), "classes")
    tied = filter_bits(found.where("kind = 3").select("a"))
    near = texts.mapInArrow(task(near_segments, tied, ranges), BLOCKS)
    segments = work.keep(near.groupBy("part").applyInArrow(group_task(segment_firsts), _SEGMENTS), "segments")
    shared = segments.where("several")
    # A filter passes all it was made of: grams of a segment of one document are never left out.
    lone, leading = filter_bits(segments.where("NOT several")), filter_bits(shared.select(F.col("seen").alias("a")))
    near = texts.mapInArrow(task(near_grams, tied, lone, leading, ranges), BLOCKS)
    exact = work.keep(near.groupBy("part").applyInArrow(group_task(repeated_grams), _GRAMS), "grams")
    located = texts.mapInArrow(
        task(locate, filter_bits(classes), tied, lone, leading, filter_bits(shared), filter_bits(exact)), _UNITS
    )
    known = classes.unionByName(shared.select("a", "low", "mark"), True).unionByName(exact, True)
    units = Scratch(located.join(known, "a"), "units").frame
    work.clear()
    similar = units.where("root IS NOT NULL")
    spread = similar.groupBy("root").agg(
        F.min(F.struct("doc_id", "text_key", "unit")).alias("first_unit"), F.max(F.struct("doc_id")).alias("last")
    )
    spread = spread.where(~F.col("first_unit.doc_id").eqNullSafe(F.col("last.doc_id"))).select("root", "first_unit")
    # Stored, so that adaptive execution may split the rows of a root that many units have.
    repeated = similar.join(Scratch(spread, "spread").frame, "root")
    kept = F.struct("doc_id", "text_key", "unit").eqNullSafe(F.col("first_unit"))
    place = ["doc_id", "text_key", "unit", "first", "words", "start", "end", "before", "after"]
    marked = repeated.select(*place, F.col("first_unit.doc_id").alias("kept_doc_id"), (~kept).alias("removed"))
    low = F.when(F.col("low") != _NULL, F.col("low"))
    mark = F.expr("shiftleft(cast(first AS long), 32) | (text_key & 4294967295)")
    kept = F.col("doc_id").eqNullSafe(low) & (mark == F.col("mark"))
    same = units.where("mark IS NOT NULL").select(*place, low.alias("kept_doc_id"), (~kept).alias("removed"))
    rows = marked.unionByName(same).repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "first")
    return rows.mapInArrow(task(join_up, least_words), _PASSAGES)
