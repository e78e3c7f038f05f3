"""Token counts against the tokenizer library."""

import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from casewise.llm import queries, token_counts  # noqa: E402
from casewise.llm.texts import slices  # noqa: E402
FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return token_counts.Vocabulary(file.read())


def counted(vocabulary, rows):
    out = []
    for _, _, data, offsets in slices(pa.array(rows, pa.string())):
        out += vocabulary.count_texts(data, offsets).tolist()
    return out


def wanted(library, rows):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in rows], add_special_tokens=False)]


PIECES = (
    "'s 'll 're ' ab the The 12 3 ! ... é ñ 日 <|endoftext|> ing tion x - _ 't L ve 🙂 ́ 　 \x85 <|endoftext".split(" ")
    + [" ", "  ", "\n", "\t", "\x00", "\x1c", " The"]
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=40).map("".join)), min_size=1, max_size=5))
def test_pieces(vocabulary, library, rows):
    assert counted(vocabulary, rows) == wanted(library, rows)


def test_long_pieces_and_special_cases(vocabulary, library):
    rows = ["a" * 3000, "", None, " ", "x  ", "\n\n", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "I'll they're 's ''s don't  x\n\n y \t"]
    rows += ["ab" * 4000 + " é" * 500]
    assert counted(vocabulary, rows) == wanted(library, rows)


def test_states_start_anew(vocabulary, library, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    random.seed(2)
    rows = ["".join(random.choice(PIECES) for _ in range(60)) for _ in range(40)]
    for row in rows:
        assert counted(vocabulary, [row]) == wanted(library, [row])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query(corpus, library):
    docs = {r.doc_id: r.text for r in corpus.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op7_token_counts(corpus, FOLDER).collect()
    assert len(rows) == len(docs)
    want = dict(zip(docs, wanted(library, list(docs.values())), strict=True))
    for r in rows:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), want[r.doc_id], want[r.doc_id] > 512)


def test_odd_rows(corpus):
    schema = "doc_id long, text string, n_tokens string, `text_key` string"
    rows = [(1, None, "x", "y"), (None, "a b", "x", "y"), (2, "", None, None), (2, "", None, None)]
    got = token_counts.token_counts(corpus.createDataFrame(rows, schema), PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == [("1", 0, 0), ("2", 0, 0), ("2", 0, 0), ("None", 3, 2)]
    assert token_counts.token_counts(corpus.createDataFrame([], schema), PATH).collect() == []
