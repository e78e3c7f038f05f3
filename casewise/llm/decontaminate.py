"""Benchmark decontamination by pigeonhole edit matching.

Documents and items are compared as sequences of words (letters, digits and underscores) in lower
case with one space between them. An item of n characters may differ from a passage of the document by
k = n * ERRORS edits. It is cut into k + 1 pieces; a passage within k edits holds at least one piece
unchanged. All pieces of all items are searched in one pass over the document (Aho-Corasick). Around
each hit the item is compared with the passage by Myers's bit-parallel algorithm; overlapping windows
of an item are one window, so a text that repeats a piece costs no more than its length.

Items below ``SHORT`` characters must stand in the text unchanged as whole words. Items without a
word match nothing. Items are the fixed side: they go to the tasks in blocks of at most
``BLOCK_CHARACTERS``, one pass over the documents for each block, so a task never holds more.

Null and empty texts match nothing. Repeated rows each give their matches; equal items are all
reported; of equal distances the leftmost end counts. Empty tables give no match. Other columns do
not matter to the search and pass through the filter as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import prepare, task

ERRORS = 0.06
SHORT = 20
BLOCK_CHARACTERS = 4 << 20
_WORD = re.compile(r"\w+")

_compiled: list[tuple[object, list[Item], object]] = []


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


class Item:
    """A benchmark item: its text, budget of edits, and the bit masks of its characters."""

    def __init__(self, item_id: int, text: str):
        self.id, self.text, self.size = item_id, text, len(text)
        self.edits = int(self.size * ERRORS) if self.size >= SHORT else 0
        self.masks: dict[str, int] = {}
        for k, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def pieces(self) -> Iterator[tuple[int, str]]:
        """(offset, piece): edits + 1 pieces of equal length, up to one character."""
        count = self.edits + 1
        for k in range(count):
            a, b = self.size * k // count, self.size * (k + 1) // count
            yield a, self.text[a:b]

    def best(self, text: str) -> tuple[int, int]:
        """Smallest distance of the item to any passage of the text, and the passage's end (Myers 1999)."""
        masks, top, full = self.masks, 1 << (self.size - 1), (1 << self.size) - 1
        plus, minus, score = full, 0, self.size
        least, end = score, 0
        for at, c in enumerate(text):
            eq = masks.get(c, 0)
            across = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | ~(across | plus) & full
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            if score < least:
                least, end = score, at + 1
            up, down = up << 1 & full, down << 1 & full
            vertical = eq | minus
            plus = down | ~(vertical | up) & full
            minus = up & vertical
        return least, end

    def start(self, text: str, end: int, distance: int) -> int:
        """Start of the longest passage that ends at ``end`` with this distance."""
        back = text[max(0, end - self.size - distance) : end][::-1]
        turned = Item(self.id, self.text[::-1])
        row = list(range(turned.size + 1))
        best = 0
        for j, c in enumerate(back, 1):
            last, row[0] = row[0], j
            for i in range(1, turned.size + 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (turned.text[i - 1] != c))
            if row[-1] == distance:
                best = j
        return end - best


def compile_items(items: list[tuple[int, str]]) -> tuple[list[Item], object]:
    """The items and the automaton of their pieces; kept for the tasks of the same worker."""
    for known, made, automaton in _compiled:
        if known == items:
            return made, automaton
    made = [Item(i, t) for i, t in items]
    places: dict[str, list[tuple[int, int]]] = {}
    for k, item in enumerate(made):
        for offset, piece in item.pieces():
            places.setdefault(piece, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for piece, found in places.items():
        automaton.add_word(piece, (len(piece), found))
    automaton.make_automaton()
    _compiled[:] = [(items, made, automaton)]
    return made, automaton


def matches(text: str, items: list[Item], automaton) -> Iterator[tuple[Item, int, int]]:
    """(item, distance, end) of every item within its budget of the normal text."""
    windows: dict[int, list[list[int]]] = {}
    for last, (size, found) in automaton.iter(text):
        for k, offset in found:
            item = items[k]
            at = last + 1 - size - offset
            a, b = max(0, at - item.edits), min(len(text), at + item.size + item.edits)
            spans = windows.setdefault(k, [])
            # Hits come by their ends; a window may start before the one before it.
            while spans and a <= spans[-1][1]:
                left, right = spans.pop()
                a, b = min(a, left), max(b, right)
            spans.append([a, b])
    for k, spans in windows.items():
        item, found = items[k], None
        for a, b in spans:
            if item.size < SHORT:
                whole = re.search(rf"\b{re.escape(item.text)}\b", text[max(0, a - 1) : b + 1])
                distance, end = (0, max(0, a - 1) + whole.end()) if whole else (1, 0)
            elif item.text in text[a:b]:
                distance, end = 0, a + text[a:b].index(item.text) + item.size
            else:
                distance, end = item.best(text[a:b])
                end += a
            if distance <= item.edits and (found is None or distance < found[0]):
                found = distance, end
        if found:
            yield item, *found


def _span(text: str, start: int, end: int) -> tuple[int, int]:
    """Place in the text as it is of the words that a passage of the normal text touches."""
    at, first, last = 0, None, 0
    for word in _WORD.finditer(text):
        size = len(word[0].lower())
        if at + size > start and first is None:
            first = word.start()
        if at < end:
            last = word.end()
        at += size + 1
    return first or 0, last


def search(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """doc_id, item_id, distance and the passage's place for every match."""
    items, automaton = compile_items(block)
    for batch in batches:
        out: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            plain = normal(text)
            for item, distance, end in matches(plain, items, automaton):
                out.append((doc, item.id, distance, *_span(text, item.start(plain, end, distance), end)))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "end"]
        )


def clean(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """The rows that hold none of the items."""
    items, automaton = compile_items(block)
    for batch in batches:
        keep = [next(matches(normal(text), items, automaton), None) is None for text in batch.column("text").to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items with a word as (id, normal text), in blocks of at most ``BLOCK_CHARACTERS`` (an item alone may be longer)."""
    block: list[tuple[int, str]] = []
    size = 0
    for item_id, text in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        plain = normal(text)
        if not plain:
            continue
        if block and size + len(plain) > BLOCK_CHARACTERS:
            yield block
            block, size = [], 0
        block.append((item_id, plain))
        size += len(plain)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start, end: every item a document holds, and where (in characters, whole words)."""
    spark = prepare(docs.sparkSession)
    schema = "doc_id long, item_id long, distance int, start int, end int"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        found = found.unionByName(texts.mapInArrow(task(search, block), schema))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    prepare(docs.sparkSession)
    for block in item_blocks(benchmark):
        docs = docs.mapInArrow(task(clean, block), docs.schema)
    return docs
