"""Quality classifier: naive Bayes features in a linear hinge-loss model (NB-SVM).

A text's features are the indicators of its n-grams, hashed into ``FEATURES`` places: runs of four
bytes, and one to three words in a row by their shape (which kinds of characters a word has, and
whether it repeats the word before). Each place is scaled by the logarithm of the ratio of its
smoothed shares in the two classes, a text's vector is divided by the root of its number of places, and
a linear model is fitted with hinge loss by dual coordinate descent (Hsieh et al. 2008), classes weighed to be
equal. The margin becomes a probability by a logistic curve fitted on the training margins.

The fit takes at most ``SAMPLE`` labelled texts, those with the smallest hash of their id, dealt to
``PARTS`` independent fits in tasks of their own; a score is the mean of their probabilities. The models are
of fixed size. Every text is scored whole.

Null and empty texts have no features and the score of the curves at the bias. Null labels and ids are not learned from;
of several labels of an id the largest counts, and of several rows of an id that is learned from the one with the smallest hash of its text, so
that the bound holds for rows; a text whose id has no label is scored like any other.
With one class or no label to learn from, every score is the smoothed share of label 1 (one half without labels).
Repeated rows are scored alike. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import crc_of_id, group_task, prepare, task
from casewise.llm.texts import SLICE_BYTES, U, mix, slices, span_hashes, word_spans

FEATURES = 1 << 16
SAMPLE, PARTS = 16_000, 4
ROUNDS, COST, SMOOTH = 12, 1.0, 1.0
THRESHOLD = 0.3

_KIND = np.full(256, 32, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 16


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the distinct features of every text, in order of rows."""
    n = len(offsets) - 1
    marks = np.zeros(n * FEATURES, bool)
    if len(data) > 3:
        row = np.repeat(np.arange(n), np.diff(offsets))
        wide = data.astype(np.uint64)
        gram = wide[:-3] | wide[1:-2] << U(8) | wide[2:-1] << U(16) | wide[3:] << U(24)
        same = row[:-3] == row[3:]
        marks[row[:-3][same] * FEATURES + (mix(gram[same]) >> U(48)).astype(np.int64)] = True
    starts, ends, owner = word_spans(data, offsets)
    if len(starts):
        words = span_hashes(data, starts, ends)
        shape = np.bitwise_or.reduceat(_KIND[data], starts).astype(np.uint64)
        shape[1:] |= U(64) * ((words[1:] == words[:-1]) & (owner[1:] == owner[:-1]))
        code = shape + U(1)
        for order in (1, 2, 3):
            if order > 1:
                if len(shape) < order:
                    break
                code = code[:-1] * U(256) + shape[order - 1 :] + U(1)
            inside = owner[: len(code)] == owner[order - 1 :]
            place = mix(code[inside] + (U(order) << U(40))) >> U(48)
            marks[owner[: len(code)][inside] * FEATURES + place.astype(np.int64)] = True
    found = np.flatnonzero(marks)
    return found // FEATURES, found % FEATURES


def _pieces(column: pa.Array):
    """As ``slices``, but never more than 500 texts at a time, as each has a row of marks."""
    for start in range(0, len(column), 500):
        part = column.slice(start, 500)
        for first, end, data, offsets in slices(part, SLICE_BYTES):
            yield start + first, start + end, data, offsets


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, part, label and the places of each text (16-bit numbers as bytes)."""
    for batch in batches:
        for first, end, data, offsets in _pieces(batch.column("text")):
            row, place = features(data, offsets)
            cut = np.searchsorted(row, np.arange(end - first + 1))
            packed = [place[cut[k] : cut[k + 1]].astype(np.uint16).tobytes() for k in range(end - first)]
            part = batch.slice(first, end - first)
            names = ["doc_id", "key", "part", "label"]
            yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(packed, pa.binary())], [*names, "places"])


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve with Platt's smoothed targets, by Newton's method."""
    plus, minus = label.sum(), (~label).sum()
    target = np.where(label, (plus + 1) / (plus + 2), 1 / (minus + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - target))
        at -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(rows: pa.Table) -> pa.Table:
    """One model: the weight of every place, then bias, slope and shift, as doubles."""
    label = rows.column("label").to_numpy().astype(bool)
    texts = [np.frombuffer(x, np.uint16).astype(np.int64) for x in rows.column("places").to_pylist()]
    order = np.argsort([hash_of for hash_of in (int(t.sum()) * 31 + len(t) for t in texts)], kind="stable")
    n, plus = len(texts), int(label.sum())
    weights = np.zeros(FEATURES)
    if plus in (0, n):
        share = (plus + 1) / (n + 2)
        model = np.concatenate([weights, [0.0, 0.0, np.log(share / (1 - share))]])
        return pa.table({"model": pa.array([model.tobytes()], pa.binary())})
    counts = np.full((2, FEATURES), SMOOTH)
    for t, y in zip(texts, label, strict=True):
        counts[int(y), t] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    values = [ratio[t] / np.sqrt(max(1, len(t))) for t in texts]
    squares = np.array([v @ v + 1 for v in values])
    cost = np.where(label, COST * n / (2 * plus), COST * n / (2 * (n - plus)))
    sign = np.where(label, 1.0, -1.0)
    dual, bias = np.zeros(n), 0.0
    rng = np.random.default_rng(5)
    for _ in range(ROUNDS):
        for k in order[rng.permutation(n)].tolist():
            t, v = texts[k], values[k]
            slope = sign[k] * (weights[t] @ v + bias) - 1
            new = min(max(dual[k] - slope / squares[k], 0.0), cost[k])
            if new != dual[k]:
                change = (new - dual[k]) * sign[k]
                weights[t] += change * v
                bias += change
                dual[k] = new
    margin = np.array([weights[t] @ v + bias for t, v in zip(texts, values, strict=True)])
    slope, shift = _curve(margin, label)
    model = np.concatenate([weights * ratio, [bias, slope, shift]])
    return pa.table({"model": pa.array([model.tobytes()], pa.binary())})


def apply(batches: Iterator[pa.RecordBatch], models: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id and score of every row."""
    weights = np.ascontiguousarray(models[:, :FEATURES].T)
    bias, slope, shift = models[:, FEATURES:].T
    for batch in batches:
        for first, end, data, offsets in _pieces(batch.column("text")):
            row, place = features(data, offsets)
            cut = np.searchsorted(row, np.arange(end - first + 1))
            sums = np.zeros((end - first, len(models)))
            full = np.flatnonzero(np.diff(cut))
            if len(full):
                sums[full] = np.add.reduceat(weights[place], cut[full], axis=0)
            margin = sums / np.sqrt(np.maximum(1, np.diff(cut)))[:, None] + bias
            score = (1 / (1 + np.exp(-np.clip(margin * slope + shift, -30, 30)))).mean(axis=1) if len(models) else np.full(end - first, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(score)], ["doc_id", "score"])


def is_held_out(column: str = "doc_id"):
    """Rows whose label is not learned from: crc32 of the id modulo 5 is 0; a null id is not held out."""
    return F.coalesce(crc_of_id(column) % 5 == 0, F.lit(False))


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, label and places of the rows to learn from, at most ``SAMPLE``: labelled texts that are not held out."""
    label = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    turn = F.xxhash64(F.col("doc_id").cast("long"), F.lit(3))
    chosen = label.where(~is_held_out()).select("doc_id", "label", turn.alias("turn")).orderBy("turn", "doc_id").limit(SAMPLE)
    chosen = chosen.select("doc_id", F.col("label").cast("int").alias("label"), F.pmod("turn", F.lit(PARTS)).cast("int").alias("part"))
    # At most SAMPLE rows.
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "part", "label", "text")
    described = known.mapInArrow(task(describe), "doc_id long, key long, part int, label int, places binary")
    once = described.groupBy("doc_id").agg(F.min(F.struct("key", "part", "label", "places")).alias("row"))
    return once.select("row.part", "row.label", "row.places")


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The models, one row each, from the labelled texts that are not held out."""
    prepare(docs.sparkSession)
    rows = training(docs, labels).groupBy("part").applyInArrow(group_task(fit), "model binary").collect()
    return np.array(sorted(np.frombuffer(r[0]).tolist() for r in rows)).reshape(len(rows), FEATURES + 3)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score reaches the threshold) of every document."""
    models = learn(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task(apply, models), "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
