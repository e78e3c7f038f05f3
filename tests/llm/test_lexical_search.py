"""Ranked lexical search against plain loops and SQL."""

import math
import os
import random
import re
from collections import Counter

import pytest

from casewise.llm import lexical_search, queries

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, keep=20):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        wanted = TERM.findall((text or "").translate(LOWER))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in wanted}
        found = []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in wanted if t in c)
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, k + 1, i, score) for k, (_, _, i, score) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:keep])]
    return sorted(out, key=repr)


def got(corpus, docs, items, **options):
    docs = corpus.createDataFrame(docs, "doc_id long, text string").repartition(6)
    items = corpus.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **options).collect()), key=repr)


WORDS = ["a", "B", "cc", "Dé", "dé", "é", "日本", "x1", "1", "zz", " ", "É", "Q", "q_q", "a-b", "\x00", "ſ", "K"]


def made(seed, n):
    random.seed(seed)
    return [(k, random.choice(" .,\n").join(random.choices(WORDS, k=random.randint(0, 30)))) for k in range(n)]


def test_random_texts_ties_and_blocks(corpus):
    docs = made(1, 150) + [(1000 + k, "a B cc") for k in range(60)]
    items = made(2, 12) + [(90, "a a a"), (91, "nowhere"), (92, "..."), (93, None)]
    want = plain(docs, items)
    assert got(corpus, docs, items) == want
    assert got(corpus, docs, items, block=40) == want
    assert got(corpus, docs, items, keep=3) == plain(docs, items, 3)


def test_candidates_are_cut_without_loss(corpus, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "CELLS", 64)
    monkeypatch.setattr(lexical_search, "CANDIDATES", 10)
    docs, items = made(3, 300), made(4, 5)
    terms = tuple(sorted({t for _, x in items for t in lexical_search.terms_of(x)}))
    frame = pa.record_batch({"doc_id": pa.array([i for i, _ in docs]), "text": pa.array([t for _, t in docs])})
    scanned = [b for b in lexical_search.scan([frame], terms)]
    for (_, text), n, found, tf in zip(docs, *(scanned[0].column(c).to_pylist() for c in ("n", "terms", "tf")), strict=True):
        want = Counter(lexical_search.terms_of(text))
        assert n == sum(want.values())
        assert {terms[k]: x for k, x in zip(found, tf, strict=True)} == {t: x for t, x in want.items() if t in terms}
    assert got(corpus, docs, items) == plain(docs, items)


def test_odd_rows(corpus):
    docs = [(1, None), (2, ""), (3, "..."), (None, "word"), (4, "word"), (4, "word"), (5, "x " * 100_000 + "word"), (6, "other")]
    items = [(7, "Word"), (7, "x"), (None, "word other")]
    assert got(corpus, docs, items) == plain(docs, items)
    assert got(corpus, [], items) == [] and got(corpus, docs, []) == [] and got(corpus, [(1, None)], items) == []
    wide = corpus.createDataFrame([(1, "word", "a", 3)], "doc_id long, text string, terms string, n long")
    few = corpus.createDataFrame([(1, "word", "a", 3)], "item_id long, text string, doc_id string, score long")
    assert [(r.item_id, r.rank, r.doc_id) for r in lexical_search.search(wide, few).collect()] == [(1, 1, 1)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query(corpus):
    docs = [tuple(r) for r in corpus.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in corpus.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted((tuple(r) for r in queries.op12_lexical_search(corpus, FOLDER).collect()), key=repr)
    assert rows == plain(docs, items)
