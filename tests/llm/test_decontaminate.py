"""Edit matching against a plain table of distances."""

import os
import random

import pytest

from casewise.llm import decontaminate, queries

FOLDER = "/root/testdata/sf0.001"


def plain(item, text):
    """(smallest distance of the item to a passage, leftmost end)."""
    row = list(range(len(item) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        last, row[0] = row[0], 0
        last = 0
        for i in range(1, len(item) + 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (item[i - 1] != c))
        if row[-1] < best[0]:
            best = (row[-1], j)
    return best


def test_every_passage_within_the_budget():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    texts = [" ".join(word() for _ in range(n)) for n in (5, 9, 20, 40)]
    items, automaton = decontaminate.compile_items(list(enumerate(texts)))
    for _ in range(120):
        item = rng.choice(items)
        letters = list(item.text)
        for _ in range(rng.randrange(0, item.edits + 3)):
            k = rng.randrange(len(letters))
            letters[k : k + 1] = rng.choice([[], ["a"], [letters[k], "b"]])
            letters = letters or ["a"]
        text = decontaminate.normal(" ".join([word(), "".join(letters), word(), word()]))
        for other in items:
            if other.size < decontaminate.SHORT:
                continue
            want = plain(other.text, text)
            got = [(d, e) for i, d, e in decontaminate.matches(text, items, automaton) if i is other]
            assert [d for d, _ in got] == ([want[0]] if want[0] <= other.edits else [])
            for d, end in got:
                start = other.start(text, end, d)
                assert plain(other.text, text[start:end])[0] == d


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query(corpus):
    normal = decontaminate.normal
    docs = {r.doc_id: r.text for r in corpus.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r.item_id: normal(r.text) for r in corpus.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    rows = queries.op6_decontaminate(corpus, FOLDER).collect()
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in normal(t)}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        passage = normal(docs[r.doc_id][r.start : r.end])
        assert plain(items[r.item_id], passage)[0] == r.distance


def test_odd_rows(corpus):
    passage = "One two three, four five six seven eight nine ten eleven twelve"
    rows = [
        (1, None, "a"), (2, "", "a"), (3, passage.upper() + "!", None), (None, f"x\n{passage} y", "b"), (4, "the Cat sat", "b"),
        (5, "concatenated", "c"), (3, passage.upper() + "!", None), (6, "one two " * 30000, "c"),
    ]
    docs = corpus.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = corpus.createDataFrame([(1, passage), (2, None), (3, " -- "), (4, "cat"), (5, passage)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.distance) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == sorted([("3", 1, 0), ("3", 5, 0), ("3", 1, 0), ("3", 5, 0), ("None", 1, 0), ("None", 5, 0), ("4", 4, 0)])
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.keep_clean(docs.limit(0), bench).collect() == []


def test_blocks_of_items(corpus, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARACTERS", 30)
    bench = corpus.createDataFrame([(k, f"item number {k} of the benchmark") for k in range(7)], "item_id long, text string")
    assert [len(b) for b in decontaminate.item_blocks(bench)] == [1] * 7
    docs = corpus.createDataFrame([(1, "Item number 5 of the benchmark"), (2, "nothing")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).where("distance = 0").collect()] == [(1, 5)]
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()] == [2]
