"""Chat formatting and embedding links against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewise.llm import chat, embedding_dedup

CHATS = "conv_id long, turn long, role string, text string"
PARTS = st.lists(
    st.sampled_from([*chat.CONTROL, "\\", "<", ">", "/", "[", "]", " ", "s", "\n", "ok", "é🙂", "\\\\", "<\\s>"]), max_size=12
).map("".join)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "<r> x", "", None]), st.one_of(st.none(), PARTS)), min_size=1, max_size=5), min_size=5, max_size=30))
def test_round_trip(corpus, chats):
    rows = [(c, k, role, text) for c, turns in enumerate(chats) for k, (role, text) in enumerate(turns)]
    made = chat.format_chats(corpus.createDataFrame(rows, CHATS)).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made}
    assert got == {c: [(r or "", t or "") for r, t in turns] for c, turns in enumerate(chats)}
    for r in made:
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("[INST]") == sum(role == "user" for role, _ in chats[r.conv_id])


def test_digest_of_odd_rows(corpus):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 1, "assistant", "</s>[INST] x"), (2, 0, "user", None), (2, 2, "user", "q"),
        (3, 0, "assistant", "x"), (4, 0, "system", "s"), (None, None, None, None), (5, 0, "user", "y"), (5, 0, "user", "x"),
        (6, 0, "user", "z" * 200000), (6, 1, "assistant", "b" * 200000),
    ]
    frame = corpus.createDataFrame(rows, CHATS).selectExpr("*", "1 AS turns", "2 AS status")
    got = {r.conv_id: r for r in chat.chat_digest(chat.with_trial(frame)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "complete", 2: "open", 3: "bad", 4: "open", None: "bad", 5: "bad", 6: "complete", -7: "complete"}
    say = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == digest(f"user\n{say}\nassistant\n{say}\n")
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256) == (2, len(say), digest(say))
    assert got[5].turns_sha256 == digest("user\nx\nuser\ny\n")
    assert got[2].loss_sha256 == digest("</s>[INST] x") and got[None].loss_chars == 0
    bad = {r.conv_id: r.bad_turn for r in chat.format_chats(frame).collect()}
    assert (bad[3], bad[5], bad[1]) == (0, 1, None)
    assert chat.chat_digest(frame.limit(0)).collect() == []


def plain_links(rows):
    """vec_id -> (links, smallest linked id); ids are distinct."""
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = np.array(v, np.float32).astype(float)
    near = defaultdict(set)
    ids = sorted(sound)
    for i in ids:
        for j in ids:
            if i < j and len(sound[i]) == len(sound[j]):
                if sound[i] @ sound[j] / np.linalg.norm(sound[i]) / np.linalg.norm(sound[j]) >= 0.9:
                    near[i].add(j)
                    near[j].add(i)
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, others in near.items():
            low = min([root[i], *(root[j] for j in others)])
            if low < root[i]:
                root[i], changed = low, True
    return {i: (len(near[i]), root[i]) for i, _ in rows}


def test_embedding_links(corpus):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 24))
    rows = [v + rng.standard_normal(24) * 0.12 * (k % 4) for v in base for k in range(6)] + list(rng.standard_normal((300, 24)))
    rows = [(k * 3 + 1, [float(x) for x in np.float32(v)]) for k, v in enumerate(rows)]
    rows += [(4000 + k, rows[0][1]) for k in range(40)] + [(5000, [2 * x for x in rows[0][1]])]
    rows += [(6000, None), (6001, [0.0] * 24), (6002, [float("nan")] + [1.0] * 23), (6003, [None] + [1.0] * 23), (6004, []), (6005, [1.0, 2.0]), (6006, [1.0, 2.1])]
    frame = corpus.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS copies", "2 AS a").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    want = plain_links(rows)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98


def test_embedding_rows_that_repeat(corpus):
    v = [1.0, 0.5, -1.0]
    frame = corpus.createDataFrame([(1, v), (1, v), (None, v), (3, v), (4, None)], "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("3", 2, 1, False), ("4", 0, 4, True), ("None", 0, None, True)]
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []
    other = corpus.createDataFrame([(1, v), (1, [-1.0, 0.5, 1.0]), (2, [-1.0, 0.5, 1.01])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(other).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize("two", [False, True])
def test_blocks_of_a_bucket(two):
    """Links counted once: not again where an earlier table has both together, nor within a block of two."""
    import pyarrow as pa

    unit = np.array([[1.0, 0.0], [0.99, 0.141], [0.98, 0.199], [0.0, 1.0]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    table = pa.table(
        {
            "number": pa.array([1] * 4, pa.int32()),
            "a": pa.array([1, 2, 3, 4]),
            "copies": pa.array([1, 2, 3, 4]),
            "block": pa.array([0, 0, 1, 1] if two else [0] * 4, pa.int32()),
            "unit": pa.array([u.tobytes() for u in unit], pa.binary()),
            "keys": pa.array([[7, 5], [8, 5], [7, 5], [9, 5]]),
        }
    )
    rows = {(r["kind"], r["a"], r["b"]) for r in embedding_dedup.compare(table).to_pylist()}
    assert rows == ({(0, 2, 3), (0, 3, 2), (1, 2, 3)} if two else {(0, 1, 2), (0, 2, 4), (0, 3, 2), (1, 1, 2), (1, 2, 3)})
