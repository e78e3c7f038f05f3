"""The Jaccard join against all pairs."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from casewise.llm import jaccard_join, queries
from casewise.llm.texts import sorted_sets

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(docs):
    """doc_id -> (set size, smallest linked id), all pairs that share a shingle compared."""
    sets = {i: plain_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query(corpus):
    docs = [(r.doc_id, r.text) for r in corpus.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert found(queries.op5_jaccard_join(corpus, FOLDER)) == plain_components(docs)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def test_large_groups_of_near_copies(corpus):
    """Groups around a text, with members that link only through others or to nothing, and a passage all share."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    passage = [f"p{k}" for k in range(40)]
    docs = [edited(rng, base, rng.randrange(0, 9)) for _ in range(120)]
    docs += [" ".join([f"o{rng.randrange(10**6)}" for _ in range(60)] + passage) for _ in range(60)]
    docs += [edited(rng, passage, k % 2) for k in range(20)] + docs[:5] + docs[:1] * 30
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    frame = corpus.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_components(rows)
    assert len({c for _, c in want.values()}) > 60
    assert found(jaccard_join.jaccard_components(frame)) == want


def test_odd_rows(corpus):
    rows = [
        (1, None, "a", 5), (2, "", "b", 6), (3, " \n ", "c", 7), (4, "one two", "d", 8), (5, "ONE\ttwo ", None, None),
        (6, "one two three", "a", 1), (None, "one two", "a", 1), (8, "x " * 9000, "a", 1), (8, "x " * 9000, "a", 1), (9, "X X X X X", "a", 1),
    ]
    frame = corpus.createDataFrame(rows, "doc_id long, text string, component_id string, n long")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame).collect())
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, 4), (8, 1, 8), (8, 1, 8), (9, 1, 8)]
    assert got == Counter(want)
    kept = jaccard_join.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8", "8", "None"]
    assert jaccard_join.jaccard_components(corpus.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("frequent_share", [0.0, 0.6, 1.0])
def test_linked_sets_share_a_signature(frequent_share):
    """The pigeonhole argument, for whatever shingles count as frequent: small sets, where segments run empty, too."""
    rng = np.random.default_rng(int(frequent_share * 10))
    frequent = rng.random(1 << jaccard_join.CELL_BITS) < frequent_share
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 21, 33, 64, 100, 170]:
        for _ in range(12):
            base = rng.integers(1, 1 << 62, size, dtype=np.uint64)
            most = (size + size * 100 // 75) // 7
            gone = rng.integers(0, most + 1)
            new = rng.integers(0, most + 1 - gone) if gone <= most else 0
            other = np.concatenate([base[gone:], rng.integers(1, 1 << 62, new, dtype=np.uint64)])
            common = len(base[gone:])
            if not common or 100 * common < 75 * (size + len(other) - common):
                continue
            values, at = sorted_sets(np.concatenate([base, other]), np.array([0, size, size + len(other)]))
            sig, row = jaccard_join.signatures(values, at, frequent)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (size, gone, new)


def test_blocks_of_a_group():
    """Two blocks: only links across them, as many as join the components."""
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(1, 1 << 62, 40, dtype=np.uint64))
    sets = [base, base[:38], base[2:], np.sort(rng.integers(1, 1 << 62, 30, dtype=np.uint64)), base[:12]]
    table = pa.table(
        {
            "a": pa.array([1, 2, 3, 4, 5]),
            "root": pa.array([1, 2, 3, 4, 5]),
            "block": pa.array([0, 1, 1, 0, 1], pa.int32()),
            "members": pa.array([s.tobytes() for s in sets], pa.binary()),
        }
    )
    assert {tuple(sorted(p.values())) for p in jaccard_join.compare(table).to_pylist()} == {(1, 2), (1, 3)}


def test_one_row_of_each_group_stays(corpus):
    """Null ids, repeated ids, and an id with a copy and a text of its own."""
    shared, own = " ".join(f"s{k}" for k in range(40)), " ".join(f"o{k}" for k in range(40))
    near, orphan = shared + " end", " ".join(f"n{k}" for k in range(40))
    rows = [(1, shared, "a")] * 5 + [(None, shared, "b")] * 3 + [(None, near, "c"), (7, near, "d"), (7, own, "e")]
    rows += [(None, orphan, "f"), (None, orphan, "f"), (None, None, "g"), (None, None, "g"), (8, "", "h")]
    frame = corpus.createDataFrame(rows, "doc_id long, text string, root string").repartition(3)
    kept = jaccard_join.keep_one_row_of_each(frame)
    assert kept.columns == frame.columns
    want = [(1, shared, "a"), (7, own, "e"), (None, orphan, "f"), (None, None, "g"), (None, None, "g"), (8, "", "h")]
    assert Counter(tuple(r) for r in kept.collect()) == Counter(want)


def test_the_pipeline_keeps_one_row_of_each_group(corpus):
    text = " ".join(f"s{k}" for k in range(40))
    frame = corpus.createDataFrame([(4, text), (4, text), (None, text), (5, text)], "doc_id long, text string")
    assert [tuple(r) for r in dict(corpus_pipeline.STAGES)["near copies"](corpus, frame, "").collect()] == [(4, text)]
