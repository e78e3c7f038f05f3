"""Language profiles and quality scores: held-out accuracy, and rows of every kind."""

import os

import numpy as np
import pytest

from casewise.llm import language, quality, queries

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
there = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@there
def test_language_of_held_out_documents(corpus):
    lang = {r.doc_id: r.lang for r in corpus.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op8_language(corpus, FOLDER).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert 150 < len(held) < 350
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(corpus):
    rows = [(k, "the cat and the dog are in the house", "en", "s", 1) for k in range(20)]
    rows += [(k, "der hund und die katze sind im haus", "de", "s", 1) for k in range(20, 40)]
    rows += [(50, None, "en", "s", 1), (51, "", None, "s", 1), (52, "123 --- 456", "en", None, 1), (None, "die katze", "de", None, None), (53, "the " * 40000, None, None, None)]
    docs = corpus.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language.language_of(docs).collect()}
    assert [got[k].lang_pred for k in (50, 51, 52)] == ["und"] * 3
    assert [got[k].score for k in (50, 51, 52)] == [0.0] * 3
    assert (got[None].lang_pred, got[None].held_out, got[53].lang_pred) == ("de", False, "en")
    wide = docs.selectExpr("*", "1 AS lang_pred", "text AS score")
    kept = language.keep_known_language(wide)
    assert kept.columns == wide.columns
    assert {r.doc_id for r in kept.collect()} == {*range(40), None, 53}
    none = docs.where("lang IS NULL")
    assert {r.lang_pred for r in language.language_of(none).collect()} == {"und"}
    assert language.language_of(docs.limit(0)).collect() == []


def test_any_number_of_languages_in_blocks(corpus, monkeypatch):
    """Predictions and scores do not depend on how many languages a block holds; the plan has one pass over the texts."""
    words = [f"{a}{b}{c} {c}{a}{b}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    rows = [(k, " ".join([words[k % 125]] * 4), f"l{k % 125:03}", "s", 1) for k in range(400)] + [(900, "12", "l000", "s", 1)]
    docs = corpus.createDataFrame(rows, SCHEMA)
    whole = sorted(language.language_of(docs).collect())
    monkeypatch.setattr(language, "BLOCK", 20)
    for got, want in zip(sorted(language.language_of(docs).collect()), whole, strict=True):
        assert got[:3] == want[:3] and abs(got.score - want.score) < 1e-5
    assert sum(r.lang_pred == f"l{r.doc_id % 125:03}" for r in whole) > 380
    learned = language.prototypes(docs)
    assert [len(names) for names, _ in learned] == [20] * 6 + [5]
    plan = language.identify(docs, learned)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 7 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_bundle_is_the_sum_of_bound_trigrams():
    text = "ab Ba".encode()
    made = language.bundles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    v = {c: language._vector(ord(c) if c != " " else 0).astype(float) for c in "ab "}
    bind = lambda x, y, z: np.roll(v[x], 2) * np.roll(v[y], 1) * v[z]
    total = np.log(2) * sum(bind(*g) for g in (" ab", "ab ", " ba", "ba "))
    assert np.allclose(made, total / np.linalg.norm(total), atol=1e-5)


@there
def test_quality_of_held_out_documents(corpus):
    labels = {r.doc_id: r.quality for r in corpus.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op4_quality(corpus, FOLDER).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = np.array([r.score for r in held if labels[r.doc_id] == 1])
    bad = np.array([r.score for r in held if labels[r.doc_id] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean(good >= 0.3) > 0.99


def test_quality_of_odd_rows(corpus):
    rows = [(k, "A calm line of text. " * (1 + k % 5) if k % 2 else "BUY!! NOW!! " * (1 + k % 5), None, None, None) for k in range(80)]
    rows += [(100, None, None, None, None), (101, "", None, None, None), (None, "x", None, None, None), (102, "calm " * 30000, None, None, None)]
    docs = corpus.createDataFrame(rows, SCHEMA)
    labels = corpus.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(None, 1, 0), (3, None, 0), (3, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == len(rows)
    assert min(got[k].score for k in range(1, 80, 2)) > max(got[k].score for k in range(0, 80, 2))
    assert got[100].score == got[101].score
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []


def test_rows_of_repeated_ids_do_not_pass_the_bound(corpus, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 30)
    rows = [(k % 9, f"text {k}", None, None, None) for k in range(3000)] + [(k, "a b", None, None, None) for k in range(100, 200)]
    docs = corpus.createDataFrame(rows, SCHEMA)
    labels = corpus.createDataFrame([(k, k % 2) for k in [*range(9), *range(100, 200)]], "doc_id long, quality int")
    assert quality.training(docs, labels).count() == 30
    few = labels.where("doc_id < 9 AND crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 0")
    assert quality.training(docs, few).count() == few.count()
    assert len(quality.quality_scores(docs, labels).collect()) == len(rows)


def test_dual_coordinate_descent_reaches_the_optimum():
    """The fit's weights against a long run of plain subgradient steps on the same primal problem."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    label = rng.random(60) < 0.5
    places = [np.unique(np.concatenate([rng.integers(0, 30, 6), [40 + int(y)] if rng.random() < 0.7 else []]).astype(np.uint16)) for y in label]
    table = pa.table({"label": label.astype(np.int32), "places": pa.array([p.tobytes() for p in places], pa.binary())})
    model = np.frombuffer(quality.fit(table).column("model")[0].as_py())
    counts = np.full((2, quality.FEATURES), quality.SMOOTH)
    for p, y in zip(places, label, strict=True):
        counts[int(y), p] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    x = np.zeros((60, 51))
    for k, p in enumerate(places):
        x[k, p] = ratio[p] / np.sqrt(len(p))
    x[:, 50] = 1
    sign = np.where(label, 1.0, -1.0)
    cost = np.where(label, 30 / label.sum(), 30 / (~label).sum())
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    w, best = np.zeros(51), np.inf
    for step in range(1, 20001):
        bad = sign * (x @ w) < 1
        w = w - (w - (x * (cost * sign * bad)[:, None]).sum(axis=0)) / step
        best = min(best, loss(w))
    got = np.append(np.divide(model[:50], ratio[:50], out=np.zeros(50), where=ratio[:50] != 0), model[quality.FEATURES])
    assert loss(got) < best * 1.02
