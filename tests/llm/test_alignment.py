"""Token alignment against plain loops over the tokenizer libraries' own tokens."""

import hashlib
import json
import os
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from casewise.llm import alignment, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    with open(A_PATH) as file:
        names = {i: name for name, i in json.load(file)["model"]["vocab"].items()}
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in names[i])) for i in ids], [(i, piece(i)) for i in b.encode(text)]

    return tokens


def cut(text, tokens):
    """Groups as (ids of A, ids of B)."""
    if not text:
        return []
    a, b = tokens(text)
    whole = (" " + text).encode()
    if b"".join(d for _, d in a) != whole or b"".join(d for _, d in b) != whole:
        return []
    out, i, j = [], 0, 0
    while i < len(a):
        ids, sizes = ([], []), [0, 0]
        while not ids[0] or sizes[0] != sizes[1]:
            if sizes[0] <= sizes[1]:
                ids[0].append(a[i][0])
                sizes[0] += len(a[i][1])
                i += 1
            else:
                ids[1].append(b[j][0])
                sizes[1] += len(b[j][1])
                j += 1
        out.append(ids)
    return out


def plain(rows, tokens):
    cuts = [cut(t, tokens) for _, t in rows]
    links = [Counter((x, y) for a, b in c for x in a for y in b) for c in cuts]
    held = Counter(p for found in links for p in found)
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for (i, _), c, found in zip(rows, cuts, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in c)
        best = sum(n for p, n in found.items() if held[p] == highest[p[0]])
        total = sum(n * held[p] for p, n in found.items())
        sha = hashlib.sha256(text.encode()).hexdigest() if c else ""
        out.append((i, sum(len(a) for a, _ in c), sum(len(b) for _, b in c), len(c), sum(found.values()), best, total, sha))
    return sorted(out, key=repr)


PIECES = "the The 日本 é é ▁ ▁▁ <s> </s> <0x41> <|endoftext|> <unk> \x00 \n \t 12345 aaaaaaa 's ñas 🙂 ｆ ing tion ' ".split(" ") + [" ", "  "]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=20).map("".join)), min_size=1, max_size=6))
def test_digests(libraries, texts):
    with open(A_PATH, "rb") as a, open(B_PATH, "rb") as b:
        sources = a.read(), b.read()
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    rows = pa.Table.from_batches(list(alignment.align([batch], *sources))).to_pylist()
    want = plain(list(enumerate(texts)), libraries)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    assert [(*(r[n] for n in names), r["groups_sha256"]) for r in rows] == [(*w[:5], w[7]) for w in sorted(want)]
    for r, text in zip(rows, texts, strict=True):
        links = Counter((x, y) for a, b in cut(text, libraries) for x in a for y in b)
        assert {(p // 32000, p % 32000): n for p, n in zip(r["pairs"], r["times"], strict=True)} == links


def made(n):
    random.seed(5)
    return [(k, "".join(random.choices(PIECES[:2] + PIECES[9:], k=random.randint(0, 40)))) for k in range(n)]


@pytest.mark.parametrize("frequent", [1, 40, 1 << 20])
def test_sums_over_the_corpus(corpus, libraries, frequent):
    rows = made(80) + [(100 + k, "the same text") for k in range(40)]
    frame = corpus.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = alignment.aligned(frame, A_PATH, B_PATH, frequent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, libraries)


def test_wide_groups(corpus, libraries):
    """Many tokens between two common ends are linked all with all."""
    rows = [(1, "ñ" * 500 + "日本語" * 200), (2, "a" * 20_001), (3, "\t\n" * 3000), (4, "b" + "=" * 1001 + "c")]
    got = alignment.aligned(corpus.createDataFrame(rows, "doc_id long, text string"), A_PATH, B_PATH).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, libraries)


def test_odd_rows(corpus, libraries):
    rows = [(1, None), (2, ""), (None, "word"), (3, "word"), (3, "word"), (4, " "), (5, "a▁b")]
    got = alignment.aligned(corpus.createDataFrame(rows, "doc_id long, text string"), A_PATH, B_PATH).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, libraries)
    wide = corpus.createDataFrame([(1, "word", "x", "y")], "doc_id long, text string, pairs string, `row` string")
    assert [r.n_links for r in alignment.aligned(wide, A_PATH, B_PATH).collect()] == [1]
    assert alignment.aligned(corpus.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).collect() == []


def test_vocabulary_out_of_merge_order(libraries):
    """Where the ids do not follow the merges, the tokenizer library itself encodes."""
    with open(A_PATH, "rb") as file:
        content = json.load(file)
    vocab = content["model"]["vocab"]
    vocab["Ġthe"], vocab["Ġof"] = vocab["Ġof"], vocab["Ġthe"]
    source = json.dumps(content).encode()
    want = Tokenizer.from_str(source.decode()).encode(" the end of it", add_special_tokens=False).ids
    made_of = alignment.ByteTokens(source)
    assert made_of._fast is None and made_of.encode(["the end of it"])[0].tolist() == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query(corpus, libraries):
    docs = [tuple(r) for r in corpus.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_alignment(corpus, FOLDER).collect()), key=repr) == plain(docs, libraries)
