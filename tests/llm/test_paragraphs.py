"""Repeated passages: planted ones are found, clean texts left alone."""

import os
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from casewise.llm import jaccard_join, paragraph_dedup, queries

FOLDER = "/root/testdata/sf0.001"


def runs(docs, length):
    """Ids of the documents that share this many words in a row with another."""
    holders = defaultdict(set)
    for i, text in docs:
        w = (text or "").lower().split()
        for k in range(len(w) - length + 1):
            holders[tuple(w[k : k + length])].add(i)
    return {i for ids in holders.values() if len(ids) > 1 for i in ids}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query(corpus):
    docs = [(r.doc_id, r.text) for r in corpus.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = queries.op9_repeated_passages(corpus, FOLDER).collect()
    found = {r.doc_id for r in rows}
    assert runs(docs, 51) <= found <= runs(docs, 20)
    assert {r.doc_id for r in rows if r.removed} <= found and any(not r.removed for r in rows)


def sentence(rng):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 14))).capitalize() + "."


def test_planted_passages(corpus):
    rng = random.Random(8)
    passages = [" ".join(sentence(rng) for _ in range(8)) for _ in range(3)]
    docs = []
    for k in range(90):
        own = " ".join(sentence(rng) for _ in range(12)).split(" ")
        if k % 3 == 0:
            at = rng.randrange(len(own))
            own[at:at] = passages[k % 9 // 3].split(" ")
        elif k % 3 == 1:
            own.append("Licensed under the terms of the common licence, see the file that is named so.")
        docs.append((k, " ".join(own)))
    rows = paragraph_dedup.repeated_passages(corpus.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in rows} == {k for k in range(90) if k % 3 == 0}
    text = dict(docs)
    for r in rows:
        passage = passages[r.doc_id % 9 // 3]
        words = text[r.doc_id].encode()[r.start_byte : r.end_byte].decode().split(" ")
        # A paragraph that holds a word more at its border is still similar.
        assert sum(w in passage for w in words) >= len(words) - 4 and len(words) > 50
        assert r.kept_doc_id == r.doc_id % 9 and r.removed == (r.doc_id >= 9)


def test_similar_paragraphs(corpus):
    """A long paragraph with one word changed is a copy; one with every fifth word changed is not."""
    rng = random.Random(9)
    words = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    lines = [words[k : k + 20] for k in range(0, 120, 20)]
    flat = [w.upper() for w in words]
    changed = ["x" if k % 5 == 2 else w for k, w in enumerate(words)]
    docs = [(1, "\n".join(" ".join(x) for x in lines)), (2, "\n".join(" ".join(x) for x in lines) + " end"), (3, " ".join(changed)), (4, "\n".join(" ".join(flat[k : k + 20]) for k in range(0, 120, 20)))]
    rows = paragraph_dedup.repeated_passages(corpus.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.words, r.removed) for r in rows) == [(1, 120, False), (2, 121, True), (4, 120, True)]


def test_odd_rows(corpus):
    text = " ".join(f"{x} two three four five six seven eight nine ten." for x in "abcd")
    rows = [(1, None, 1), (2, "", 2), (3, text, 3), (3, text, 3), (None, text, 4), (4, "word " * 20000, 5), (5, "...", 6)]
    frame = corpus.createDataFrame(rows, "doc_id long, text string, words int").selectExpr("*", "1 AS root", "2 AS unit")
    got = {(r.doc_id, r.removed) for r in paragraph_dedup.repeated_passages(frame).collect()}
    assert {i for i, _ in got} == {3, None}
    assert paragraph_dedup.repeated_passages(frame.where("doc_id = 3")).collect() == []
    assert paragraph_dedup.repeated_passages(frame.limit(0)).collect() == []


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.999):
        n = paragraph_dedup.bands(0.75, recall, 1)
        assert 1 - 0.25**n >= recall > 1 - 0.25 ** (n - 1)


def test_passages_in_other_surroundings(corpus):
    """Unpunctuated, mid-sentence and re-wrapped passages of 50 words and more are found to their true borders."""
    rng = random.Random(12)

    def fresh(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    docs, want = [], {}
    for k in range(60):
        passage = fresh(50 + k % 31)
        for copy in range(2):
            before, after = fresh(rng.randrange(1, 60)), fresh(rng.randrange(1, 60))
            inner = list(passage)
            if k % 3 == 1:
                before[-1] += "." if copy else ""
            if k % 3 == 2 and copy:
                for at in range(7, len(inner), 7):
                    inner[at] = "\n" + inner[at]
            docs.append((2 * k + copy, " ".join(before + inner + after)))
            want[2 * k + copy] = (len(passage), passage[0], passage[-1], 2 * k, bool(copy))
    got = {}
    rows = paragraph_dedup.repeated_passages(corpus.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    for r in rows:
        words = dict(docs)[r.doc_id].encode()[r.start_byte : r.end_byte].decode().split()
        assert r.words == len(words)
        got.setdefault(r.doc_id, []).append((r, words))
    assert set(got) == set(want)
    for i, (n, first, last, kept, removed) in want.items():
        words = [w for _, ws in got[i] for w in ws]
        # A similar paragraph may hold a few words more.
        assert first in words and last in words and n <= len(words) <= n + 24
        (main, _), = [(r, ws) for r, ws in got[i] if len(ws) >= 25]
        assert (main.kept_doc_id, main.removed) == (kept, removed)


def test_kept_and_removed_neighbours_are_one_stretch(corpus):
    """32 repeated words, 16 of an earlier document and 16 of a later one, are one stretch, though each half is short."""
    rng = random.Random(3)
    words = [[f"n{rng.randrange(10**9)}" for _ in range(16)] for _ in range(2)]
    first, second = (" ".join(w) + "." for w in words)
    docs = [(1, first), (2, f"{first}\n{second}"), (3, second)]
    rows = paragraph_dedup.repeated_passages(corpus.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.words, r.kept_doc_id, r.removed) for r in rows) == [(2, 16, 1, True), (2, 16, 2, False)]


def test_runs_of_several_lengths_against_plain_search(corpus):
    """Runs that documents share in longer and shorter pieces, twice in one text, and in whole copies."""
    rng = random.Random(21)

    def fresh(n):
        return [f"r{rng.randrange(10**9)}" for _ in range(n)]

    stock = [fresh(160) for _ in range(12)]
    texts = []
    for k in range(120):
        words = fresh(rng.randrange(0, 40))
        for _ in range(rng.randrange(1, 4)):
            run = stock[rng.randrange(len(stock))]
            low = rng.randrange(0, 100)
            words += run[low : low + rng.randrange(20, 161)] + fresh(rng.randrange(0, 40))
        texts.append(words if k % 5 or not texts else list(texts[rng.randrange(len(texts))]))
    docs = [(k, " ".join(w)) for k, w in enumerate(texts)]
    rows = paragraph_dedup.repeated_passages(corpus.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    fate = [[None] * len(w) for w in texts]
    for r in rows:
        low = len(docs[r.doc_id][1].encode()[: r.start_byte].split())
        fate[r.doc_id][low : low + r.words] = [r.removed] * r.words

    def shared(length):
        holders = defaultdict(list)
        for k, w in enumerate(texts):
            for at in range(len(w) - length + 1):
                holders[tuple(w[at : at + length])].append((k, at))
        return [x for x in holders.values() if len({k for k, _ in x}) > 1]

    for places in shared(49):
        for k, at in places:
            assert None not in fate[k][at : at + 49]
    known, later = (set() for _ in range(2))
    for places in shared(25):
        known |= {(k, at + j) for k, at in places for j in range(25)}
        later |= {(k, at + j) for k, at in sorted(places)[1:] for j in range(25)}
    for places in shared(49):
        for k, at in sorted(places)[1:]:
            assert all(fate[k][at : at + 49])
    reported = {(k, j) for k, f in enumerate(fate) for j, x in enumerate(f) if x is not None}
    gone = {(k, j) for k, j in reported if fate[k][j]}
    # A similar paragraph may hold a few words that no other text has.
    assert len(reported - known) <= len(reported) // 50 and len(gone - later) <= len(gone) // 50


def test_a_pass_cuts_each_text_once(monkeypatch):
    rng = random.Random(5)
    texts = ["\n  " + " ".join(sentence(rng) for _ in range(9)), "", None, "one two", " ".join(sentence(rng) for _ in range(30))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    calls = []

    def counted(data, offsets, spans=paragraph_dedup.word_spans):
        calls.append(len(data))
        return spans(data, offsets)

    monkeypatch.setattr(paragraph_dedup, "word_spans", counted)
    everything = b"\xff" * 8192
    rows = pa.Table.from_batches(paragraph_dedup.locate(iter([batch]), *[everything] * 6)).to_pylist()
    assert len(calls) == 1 and calls[0] == sum(len((t or "").encode()) for t in texts)
    # Every word has a paragraph; nothing stands before the first word of a text or after its last.
    assert sum(r["words"] for r in rows if r["unit"] >= 0) == sum(len((t or "").split()) for t in texts)
    for r in rows:
        words = texts[r["doc_id"]].split()
        assert r["first"] > 0 or r["before"] == r["start"]
        assert r["first"] + r["words"] < len(words) or r["after"] == r["end"]
        assert texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode().split() == words[r["first"] : r["first"] + r["words"]]


def test_sets_of_classes_are_read_once(corpus):
    """Two clusters of equal sets in one group: the second is found block by block, on the sets that were read for the first."""
    sets = [(a, 5, np.arange(100 * (a > 6), 100 * (a > 6) + 5, dtype=np.uint64).tobytes()) for a in range(1, 13)]
    sets = corpus.createDataFrame(sets, jaccard_join.SETS)
    found = corpus.createDataFrame([(1, 99, a) for a in range(1, 13)], jaccard_join.FOUND)
    calls = []

    def fetch(needed):
        calls.append({r.a for r in needed.collect()})
        return sets

    roots = {r.node: r.root for r in jaccard_join.class_roots(found, fetch).collect()}
    assert roots == {a: 1 if a <= 6 else 7 for a in range(1, 13)}
    assert calls == [set(range(1, 13))]


def test_anchors_and_paragraph_ends_against_plain_loops():
    rng = np.random.default_rng(4)
    for n in (3, 24, 25, 26, 400):
        words = rng.integers(0, 9 if n == 26 else 1 << 62, n, dtype=np.uint64)
        row = np.sort(rng.integers(0, 3, n))
        hashes = paragraph_dedup.mix(words ^ paragraph_dedup._ANCHOR).tolist()
        plain = set()
        for k in range(n - paragraph_dedup.WINDOW + 1):
            if row[k] == row[k + paragraph_dedup.WINDOW - 1]:
                plain.add(min(range(k, k + paragraph_dedup.WINDOW), key=lambda j: (hashes[j], j)))
        assert paragraph_dedup.anchors(words, row).tolist() == sorted(plain)
        hard, soft, loose = (rng.random(n) < share for share in (0.02, 0.1, 0.3))
        hard[-1] = True
        plain, size = [], 0
        for k in range(n):
            size += 1
            if hard[k] or soft[k] and size >= 8 or loose[k] and size >= 24 or soft[k] and size >= 24:
                plain.append(k)
                size = 0
        assert paragraph_dedup.closes(hard, soft, loose).tolist() == plain
