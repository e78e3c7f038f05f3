"""Exact duplicates against plain grouping."""

import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casewise.llm import exact_dedup, queries

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans(exact_dedup.A_TO_Z, exact_dedup.A_TO_Z.lower())


def plain(rows):
    """(doc_id, keep_id, group_size, text_sha256) of every row, sorted."""
    shas = [hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest() for _, t in rows]
    groups = {}
    for (i, _), sha in zip(rows, shas, strict=True):
        groups.setdefault(sha, []).append(i)
    keep = {sha: max((i for i in ids if i is not None), default=None) for sha, ids in groups.items()}
    return sorted(((i, keep[s], len(groups[s]), s) for (i, _), s in zip(rows, shas, strict=True)), key=repr)


def checked(corpus, rows, **options):
    frame = corpus.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_duplicates(frame, **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in got})
    return got


def test_groups_hot_text_and_cases(corpus):
    rows = [(k, "One Text") for k in range(700)] + [(1000 + k, f"text {k}") for k in range(900)]
    rows += [(3000 + k, f"TEXT {k}") for k in range(0, 900, 7)] + [(5000, "É"), (5001, "é"), (5002, "long " * 50_000), (5003, "LONG " * 50_000)]
    random.seed(1)
    random.shuffle(rows)
    checked(corpus, rows)


def test_slices_give_the_same(corpus):
    rows = [(k, f"w{k % 150}") for k in range(400)] + [(k, f"only {k}") for k in range(400, 700)]
    assert len(checked(corpus, rows, filter_rows=120)) == 700


def test_odd_rows(corpus):
    rows = [(1, None), (2, ""), (None, ""), (None, "a"), (None, "A"), (3, "b"), (3, "B"), (3, "b"), (None, "alone"), (4, " b")]
    got = checked(corpus, rows)
    assert sum(r.kept for r in got if r.doc_id == 3) == 1
    extra = corpus.createDataFrame([(1, "a", "x", 2, "y")], "doc_id long, text string, digest string, row long, slice string")
    assert [tuple(r)[:4] for r in exact_dedup.exact_duplicates(extra).collect()] == [(1, 1, 1, True)]
    assert exact_dedup.exact_duplicates(corpus.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=30), min_size=1, max_size=5), st.integers(1, 3))
def test_filter_loses_no_repeated_digest(parts, blocks):
    """Every number that stands twice, in one task or in several, has all its bits in the joined filter."""
    import pyarrow as pa

    spread = [np.array(p, np.int64) * 0x123456789ABCDEF & (1 << 63) - 1 for p in parts]
    sketches = [b for p in spread for b in exact_dedup.sketch([pa.record_batch({"number": pa.array(p, pa.int64())})], blocks)]
    words = {}
    for batch in exact_dedup.join_filters(sketches):
        words.update(zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), strict=True))
    every = np.concatenate(spread)
    values, times = np.unique(every, return_counts=True)
    single = set()
    for places, n in zip(exact_dedup.places(values, blocks).tolist(), times.tolist(), strict=True):
        there = [b // 4096 in words and words[b // 4096][b % 4096 // 64] >> b % 64 & 1 for b in places if b >= 0]
        if n > 1:
            assert all(there)
        elif not all(there):
            single.add(tuple(places))
    if len(values) and (times == 1).all() and len(values) < 3:
        assert len(single) == len(values) or len({b for p in single for b in p}) < 6


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query(corpus):
    docs = [tuple(r) for r in corpus.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_exact_dedup(corpus, FOLDER).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain(docs)


def test_only_possible_repeats_move(corpus):
    """Rows that pass straight through are nearly all rows without a copy."""
    rows = [(k, f"single {k}") for k in range(3000)] + [(9000, "single 1")]
    frame = corpus.createDataFrame(rows, "doc_id long, text string")
    numbers = frame.mapInArrow(exact_dedup.task(exact_dedup.digest, 1), "doc_id long, digest binary, number long, slice int")
    blocks = -(-len(rows) * exact_dedup.BITS // exact_dedup.BLOCK)
    moved = exact_dedup.marked(numbers.withColumn("row", numbers.doc_id), blocks).where("maybe").count()
    assert 2 <= moved <= 60
