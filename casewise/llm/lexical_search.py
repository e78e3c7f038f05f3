"""Ranked lexical search of a set of items over all documents, without an index of the documents.

*Scan.* The distinct terms of all items, each between two guards, make one Aho-Corasick automaton, which travels to the tasks.
A document's text is read once, signs and white space replaced by the guard, so the automaton
meets whole terms only. What it reports, counted by document and term, is tf; the document's length n is counted along.

*Statistics.* N and L are sums over the scan, df counts its (document, term) rows.

*Scores.* The automaton's outputs lead to the items that hold the term. A task adds the scores of its documents up for all items
in integers and hands on at most ``KEEP`` documents an item; these are ranked in two steps, so that no task sees more than
``KEEP`` an item from a ``BUCKETS``-th of the tasks.

Items are the query set and are worked on in blocks of at most ``BLOCK`` characters, each a scan of its own, so that an automaton
has a bounded size. Every row of the items is an item of its own, also where ids repeat; an item without a term, or whose terms stand nowhere, has no rows.
Null texts have no terms. Repeated documents each have their row; equal scores go by ascending doc_id, null ids last. Empty tables
give no rows. Other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import Workspace, prepare, task
from casewise.llm.texts import SLICE_BYTES, slices

KEEP = 20
BLOCK = 4_000_000
BUCKETS = 256
# Scores of documents and items held at a time, and candidates before they are cut to the best.
CELLS, CANDIDATES = 1 << 21, 1 << 18

_NO_TERM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TERM = re.compile(f"[^{_NO_TERM}]+")
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(A_TO_Z, A_TO_Z.lower())
# Bytes of terms stand for themselves, lower-cased; all others are the guard.
_GUARDED = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _GUARDED[_b] = _b
_GUARDED[0x41:0x5B] = np.arange(0x61, 0x7B)

_automata: dict[tuple[str, ...], ahocorasick.Automaton] = {}

ORACLE = f"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}'), '[^{_NO_TERM}]+') AS terms
  FROM documents WHERE text IS NOT NULL
), lengths AS (
  SELECT d, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0
), corpus AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths
), counted AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM words) GROUP BY d, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counted, corpus GROUP BY term, docs
), wanted AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id,
      unnest(regexp_extract_all(translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}'), '[^{_NO_TERM}]+')) AS term
    FROM benchmark) GROUP BY i, item_id, term
), scored AS (
  SELECT i, item_id, d, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (d), corpus
  GROUP BY i, item_id, d, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= {KEEP}
"""


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Terms between guards, each byte of their UTF-8 form one character."""
    if terms not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, term in enumerate(terms):
            made.add_word(f" {term.encode().decode('latin-1')} ", number)
        made.make_automaton()
        _automata[terms] = made
    return _automata[terms]


def scan(batches: Iterator[pa.RecordBatch], terms: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """doc_id, number of terms, and the items' terms with their tf, of every document."""
    automaton = _automaton(terms)
    for batch in batches:
        ids = batch.column("doc_id")
        for first, end, data, offsets in slices(batch.column("text"), SLICE_BYTES):
            rows = end - first
            # A guard before each text, and one after the last.
            moved = offsets + np.arange(rows + 1)
            text = np.full(len(data) + rows + 1, 0x20, np.uint8)
            text[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))] = _GUARDED[data]
            inside = text != 0x20
            begins = np.flatnonzero(inside[1:] & ~inside[:-1])
            lengths = np.diff(np.searchsorted(begins, moved))
            hits = np.fromiter(chain.from_iterable(automaton.iter(text.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
            # A hit ends on the guard behind it, which may be the next text's.
            owner = np.searchsorted(moved, hits[:, 0] - 1, "right") - 1
            key, tf = np.unique(owner * len(terms) + hits[:, 1], return_counts=True)
            at = pa.array(np.searchsorted(key, np.arange(rows + 1) * len(terms)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (key % max(1, len(terms)), tf)]
            yield pa.RecordBatch.from_arrays([ids.slice(first, rows), pa.array(lengths), *lists], ["doc_id", "n", "terms", "tf"])


def _best(item, score, known, doc_id, keep: int) -> np.ndarray:
    """Places of the best ``keep`` candidates of each item."""
    order = np.lexsort((doc_id, ~known, -score, item))
    item = item[order]
    first = np.flatnonzero(np.diff(item, prepend=-1))
    place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return order[place < keep]


def rank(batches: Iterator[pa.RecordBatch], weights, starts, items, times, n_items: int, docs: int, total: int, keep: int) -> Iterator[pa.RecordBatch]:
    """The best documents of a task for each item; ``starts`` leads from a term to its part of ``items`` and ``times``."""
    from pyspark import TaskContext

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
    least = np.ones(n_items, np.int64)
    step = max(1, CELLS // max(1, n_items))
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            batch = whole.slice(start, step)
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc_id = ids.fill_null(0).to_numpy()
            n = batch.column("n").to_numpy()
            lists = batch.column("terms")
            row = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
            term, tf = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(np.int64)
            part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n[row] * docs) // total)))
            score = np.zeros(len(n) * n_items, np.int64)
            sizes = starts[term + 1] - starts[term]
            ends = np.cumsum(sizes)
            cuts = [0, *np.flatnonzero(np.diff(ends // CELLS, prepend=0)).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                size = sizes[a:b]
                at = np.repeat(starts[term[a:b]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                np.add.at(score, np.repeat(row[a:b], size) * n_items + items[at], np.repeat(part[a:b], size) * times[at])
            score = score.reshape(len(n), n_items)
            where, item = np.nonzero(score >= least)
            held = [np.concatenate(x) for x in zip(held, (item, score[where, item], known[where], doc_id[where]), strict=True)]
            if len(held[0]) > CANDIDATES + keep * n_items:
                held = [x[_best(*held, keep)] for x in held]
                full = np.bincount(held[0], minlength=n_items) == keep
                lowest = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(lowest, held[0], held[1])
                least[full] = lowest[full]
    item, score, known, doc_id = (x[_best(*held, keep)] for x in held)
    bucket = np.full(len(item), TaskContext.get().partitionId() % BUCKETS, np.int32)
    columns = [pa.array(item, pa.int32()), pa.array(bucket), pa.array(doc_id, mask=~known), pa.array(score)]
    yield pa.RecordBatch.from_arrays(columns, ["item", "bucket", "doc_id", "score"])


def _blocks(rows: list, most: int) -> Iterator[list]:
    """The items in blocks of at most ``most`` characters, or one item."""
    block, size = [], 0
    for row in rows:
        length = len(row.text or "")
        if block and size + length > most:
            yield block
            block, size = [], 0
        block.append(row)
        size += length
    if block:
        yield block


def _top(docs: DataFrame, rows: list, keep: int) -> DataFrame | None:
    """Rank, document and score of the items of one block."""
    wanted = [Counter(terms_of(r.text)) for r in rows]
    terms = tuple(sorted(set(chain.from_iterable(wanted))))
    if not terms:
        return None
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task(scan, terms), "doc_id long, n long, terms array<int>, tf array<int>"
    )
    counts = Workspace().keep(scanned.where("n > 0"), "term-counts")
    n_docs, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    # One row per term of the block.
    held = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator())
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(terms))], np.int64)
    number = {term: k for k, term in enumerate(terms)}
    outputs = sorted((number[term], item, times) for item, found in enumerate(wanted) for term, times in found.items())
    term, item, times = np.array(outputs, np.int64).T
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    best = counts.where(F.size("terms") > 0).mapInArrow(
        task(rank, weights, starts, item, times, len(rows), n_docs, total, keep), "item int, bucket int, doc_id long, score long"
    )
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "bucket").orderBy(*order))).where(F.col("rank") <= keep)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= keep)
    ids = docs.sparkSession.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], "item int, item_id long")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, keep: int = KEEP, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    spark = prepare(docs.sparkSession)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").collect()
    found = [top for part in _blocks(rows, block) if (top := _top(docs, part, keep)) is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
