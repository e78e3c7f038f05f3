"""Source mixing against plain Python, and the laws of the K-d tree shards."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from casewise.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fill(total, children):
    """children: name -> (weight, capacity); shares by weight, what one cannot hold goes to the others."""
    out = dict.fromkeys(children, 0)
    left = {k: v for k, v in children.items() if v[0] > 0}
    while left:
        weights = sum(w for w, _ in left.values())
        full = [k for k, (w, c) in left.items() if c * weights <= total * w]
        if not full:
            return out | {k: math.floor(total * w / weights) for k, (w, _) in left.items()}
        for k in full:
            out[k] = left.pop(k)[1]
            total -= out[k]
    return out


def plain_mix(rows, weights, percent, epochs, seed):
    def domain(s):
        if s == "src0":
            return "web"
        n = s[3:] if s else ""
        return "books" if n.isdigit() and int(n) % 2 == 0 else "forums"

    docs = [(d, len(re.findall(r"[^ \t-\r]+", t or "")), (domain(s), g or "", s or "")) for d, t, g, s, _ in rows]
    size = Counter()
    for _, n, leaf in docs:
        size[leaf] += n
    holds = lambda head: sum(n for leaf, n in size.items() if leaf[: len(head)] == head) * epochs
    level = lambda depth, head: {
        k: (weights[depth].get(k, 1), holds((*head, k))) for k in {leaf[depth] for leaf in size if leaf[:depth] == head}
    }
    top = level(0, ())
    budgets = {}
    total = min(sum(size.values()) * percent // 100, sum(c for w, c in top.values() if w))
    for a, x in fill(total, top).items():
        for b, y in fill(x, level(1, (a,))).items():
            for c, z in fill(y, level(2, (a, b))).items():
                budgets[a, b, c] = z
    out = Counter()
    for leaf, budget in budgets.items():
        whole = budget // size[leaf] if size[leaf] else 0
        mine = [d for d in docs if d[2] == leaf]
        for e in range(whole):
            out.update((d, n, leaf, e) for d, n, _ in mine)
        rest = budget - whole * size[leaf]
        keyed = defaultdict(list)
        for d, n, _ in mine:
            keyed[hashlib.md5(f"{seed}:{whole}:{'' if d is None else d}".encode()).hexdigest()].append((d, n, leaf, whole))
        if rest > 0:
            for key in sorted(keyed):
                rest -= sum(n for _, n, _, _ in keyed[key])
                if rest < 0:
                    break
                out.update(keyed[key])
    return out


ROWS = [(k, "w " * (k * 7 % 23), ["en", "de", None][k % 3], f"src{k % 4}" if k % 5 else None, 1) for k in range(120)]
ROWS += [(5, "w w", "en", "src1", 1)] * 3 + [(None, "a b c", "en", "src0", 2), (200, None, "fr", "src0", 2), (201, "x " * 20000, "en", "odd", 1)]


def test_mixture(corpus):
    docs = corpus.createDataFrame(ROWS, SCHEMA)
    for weights, percent, epochs in (
        ([mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, {}], 80, 2),
        ([{"web": 9, "books": 1, "forums": 0}, {}, {"src2": 5}], 30, 3),
        ([{}, {}, {}], 500, 1),
    ):
        got = Counter((r.doc_id, r.tokens, (r.domain, r.lang, r.source), r.epoch) for r in mixing.mix(docs, weights, percent, epochs, 3).collect())
        assert got == plain_mix(ROWS, weights, percent, epochs, 3)


def test_mixed_documents_keep_their_columns(corpus):
    docs = corpus.createDataFrame(ROWS, SCHEMA).selectExpr("*", "doc_id AS last", "'x' AS domain", "1 AS tokens", "2 AS key")
    taken = mixing.mixed_documents(docs, epochs=1)
    assert taken.schema.simpleString() == docs.schema.simpleString()
    want = plain_mix(ROWS, [mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, {}], mixing.BUDGET_PERCENT, 1, mixing.SEED)
    assert Counter(r.doc_id for r in taken.collect()) == Counter(k[0] for k in want.elements())
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


def shards_of(corpus, rows, count):
    return sharding.shard(corpus.createDataFrame(rows, SCHEMA), count).collect()


def test_shards(corpus):
    rows = [(k, f"text {k} " * (1 + k * 37 % 50), "en" if k % 3 else "de", f"src{k % 6}", 1) for k in range(3000)]
    rows += [(5000 + k, rows[k][1], "fr", "src9", 1) for k in range(200)]
    rows += [(9000 + k, "the same words again and again " * 10, "en", "src0", 1) for k in range(1500)]
    rows += [(None, None, None, None, None), (None, "", None, None, None), (-4, "é日🙂", None, "s", 0)]
    got = shards_of(corpus, rows, 24)
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    assert len(got) == len(rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for r in got:
        if r.doc_id is not None:
            data = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    of = defaultdict(list)
    for r in got:
        of[r.shard].append(r)
    assert sorted(of) == list(range(24))
    for members in of.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    sizes = [sum(r["size"] for r in m) for m in of.values()]
    assert max(sizes) < 1.03 * sum(sizes) / 24 and min(sizes) > 0.97 * sum(sizes) / 24
    where = {r.doc_id: r.shard for r in got}
    assert all(where[5000 + k] == where[k] for k in range(200))
    assert len({where[9000 + k] for k in range(1500)}) > 1


def test_odd_shards(corpus):
    assert shards_of(corpus, [], 24) == []
    one = [(1, "a", None, None, None)]
    assert [(r.shard, r.slot) for r in shards_of(corpus, one, 1)] == [(0, 0)]
    few = shards_of(corpus, one * 3 + [(2, None, "en", "s", 1)], 24)
    assert len(few) == 4 and all(0 <= r.shard < 24 for r in few)
    by_bytes = sharding.shard(corpus.createDataFrame([(k, "x" * 92, "en", "s", 1) for k in range(64)], SCHEMA), target_bytes=1600)
    assert Counter(r.shard for r in by_bytes.selectExpr("*", "1 AS shard2").collect()).keys() == {0, 1, 2, 3}


def test_leaves_of_weight_zero_hold_nothing(corpus):
    """A domain whose main language has weight 0 gives what it cannot hold to the other domain."""
    leaves = [("a", "en", "s", 900), ("a", "de", "s", 100), ("b", "de", "s", 1000)]
    frame = corpus.createDataFrame(leaves, "domain string, lang string, source string, size long")
    got = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(frame, [{}, {"en": 0}, {}], 1000, 1).collect()}
    assert got == {("a", "de"): 100, ("b", "de"): 900}


def test_domains_of_the_caller(corpus):
    """Other names of sources, and none, with the caller's mapping."""
    rows = [(k, "w w", "en", ["wiki", "blog", None][k % 3], 3) for k in range(60)]
    docs = corpus.createDataFrame(rows, SCHEMA)
    domain = F.when(F.col("source") == "wiki", "books").when(F.col("source").isNull(), "unknown").otherwise("web")
    weights = [{"books": 1, "web": 1, "unknown": 0}, {}, {}]
    got = Counter((r.domain, r.source) for r in mixing.mix(docs, weights, 50, 1, domain=domain).collect())
    assert got == {("books", "wiki"): 15, ("web", "blog"): 15}
    kept = Counter(r.source for r in mixing.mixed_documents(docs, weights, 50, domain=domain).collect())
    assert kept == {"wiki": 15, "blog": 15}


def test_shards_of_one_row_repeated_beyond_a_shard(corpus):
    """Rows that repeat text and id are dealt singly once they weigh more than a part of a shard."""
    rows = [(k, f"text {k} " + "x" * (k % 90), "en", f"src{k % 4}", 1) for k in range(2000)]
    rows += [(5000, "the same row " * 30, "en", "src0", 1)] * 1500 + [(None, "no id " * 40, None, None, None)] * 700
    got = sharding.shard(corpus.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    weight = Counter()
    for r in got:
        weight[r.shard] += r.size
    assert set(weight) == set(range(24))
    assert max(weight.values()) < 1.03 * sum(weight.values()) / 24 and min(weight.values()) > 0.97 * sum(weight.values()) / 24
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
