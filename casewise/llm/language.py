"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs, the same everywhere since it is drawn from the letter
itself. A trigram's vector binds its letters: the element-wise product of the vectors rolled by two
places, by one, and not at all. A document bundles its trigrams, each weighed by log(1 + count);
a language's prototype bundles the unit vectors of its documents; a document is given to the
prototype with the largest cosine. Letters are lower-cased; any run of other characters counts as
one gap, which takes part in trigrams around a letter.

Prototypes are sums of whole numbers (the vectors in fixed point), so they do not depend on how the
table is split. They are as many as the languages, whatever their number, and 4 KB each; the documents are not gathered.

Null texts and texts without a letter: ``und`` with score 0. Null languages are not learned from. If
nothing was learned, every prediction is ``und`` with score 0. Equal cosines go to the language that
sorts first. Repeated rows count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import crc_of_id, prepare, task
from casewise.llm.texts import codepoints, slices

DIMENSIONS = 1024
UNDETERMINED = "und"
# Languages that a text is compared with at a time (8 MB of vectors).
BLOCK = 2048
# Below this cosine a document is no text of a known language: unrelated vectors reach about 1 / sqrt(DIMENSIONS).
LEAST_SCORE = 0.05
_FIXED_POINT = 1 << 24
_TRIGRAMS_AT_ONCE = 4096
_LETTERS_UP_TO = 0x32400

# Names and unit vectors, in blocks.
Learned = list[tuple[list[str], np.ndarray]]

_alphabet: list[np.ndarray] = []
_vectors: dict[int, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for what is no letter."""
    if not _alphabet:
        made = np.zeros(_LETTERS_UP_TO + 1, np.int64)
        for code in range(_LETTERS_UP_TO):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                made[code] = ord(low) if len(low) == 1 else code
        _alphabet.append(made)
    return _alphabet[0]


def _vector(code: int) -> np.ndarray:
    if code not in _vectors:
        _vectors[code] = np.random.default_rng([7, code]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1
    return _vectors[code]


def bundles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One unit vector per text; zero for a text without a letter."""
    n = len(offsets) - 1
    code, at = codepoints(data)
    letter = _letters()[np.minimum(code, _LETTERS_UP_TO)]
    row = np.searchsorted(offsets, at, "right") - 1
    # A gap before each text, one at the end, and one for each run of other characters.
    firsts = np.searchsorted(row, np.arange(n + 1))
    letter = np.insert(letter, firsts, 0)
    row = np.insert(row, firsts, np.arange(n + 1))
    keep = letter > 0
    keep[1:] |= letter[:-1] > 0
    keep[0] = True
    letter, row = letter[keep], row[keep]
    out = np.zeros((n, DIMENSIONS), np.float32)
    middle = np.flatnonzero(letter[1:-1] > 0) + 1
    if not len(middle):
        return out
    alphabet, code = np.unique(letter, return_inverse=True)
    size = len(alphabet)
    key = (code[middle - 1] * size + code[middle]) * size + code[middle + 1]
    if size**3 <= 1 << 22:
        seen = np.zeros(size**3, bool)
        seen[key] = True
        grams = np.flatnonzero(seen)
        number = np.zeros(size**3, np.int64)
        number[grams] = np.arange(len(grams))
        gram = number[key]
    else:
        grams, gram = np.unique(key, return_inverse=True)
    last = np.stack([_vector(int(c)) for c in alphabet])
    second, first = np.roll(last, 1, 1), np.roll(last, 2, 1)
    owner = row[middle]
    for start in range(0, len(grams), _TRIGRAMS_AT_ONCE):
        some = grams[start : start + _TRIGRAMS_AT_ONCE]
        bound = (first[some // (size * size)] * second[some // size % size] * last[some % size]).astype(np.float32)
        here = slice(None) if len(grams) <= _TRIGRAMS_AT_ONCE else (gram >= start) & (gram < start + len(some))
        counts = np.bincount(owner[here] * len(some) + gram[here] - start, minlength=n * len(some))
        out += np.log1p(counts.reshape(n, len(some)).astype(np.float32)) @ bound
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's bundle of each language, in fixed point: (lang, place, value)."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang")
        for first, end, data, offsets in slices(batch.column("text")):
            made = np.rint(bundles(data, offsets).astype(np.float64) * _FIXED_POINT).astype(np.int64)
            names = np.array(langs.slice(first, end - first).to_pylist(), object)
            for name in set(names.tolist()):
                sums.setdefault(name, np.zeros(DIMENSIONS, np.int64))
                sums[name] += made[names == name].sum(axis=0)
    for name, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], ["lang", "place", "value"]
        )


def compare(batches: Iterator[pa.RecordBatch], names: list[str], vectors: np.ndarray, of_best: str, of_cosine: str) -> Iterator[pa.RecordBatch]:
    """The rows with the best language so far and its cosine; rows without a letter keep a null cosine."""
    for batch in batches:
        best, score = batch.column(of_best).to_pylist(), batch.column(of_cosine).to_numpy(zero_copy_only=False).astype(np.float64)
        for first, end, data, offsets in slices(batch.column("text")):
            made = bundles(data, offsets)
            known = made.any(axis=1)
            cosine = made @ vectors.T
            top = cosine.argmax(axis=1)
            reached = cosine[np.arange(len(top)), top].astype(np.float64)
            # Equal cosines go to the first name; blocks come in the order of names.
            for k in np.flatnonzero(known & ~(score[first:end] >= reached)).tolist():
                best[first + k], score[first + k] = names[top[k]], reached[k]
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        columns[of_best], columns[of_cosine] = pa.array(best, pa.string()), pa.array(score, mask=np.isnan(score))
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def prototypes(labelled: DataFrame) -> Learned:
    """Names and unit vectors of the languages in ``labelled`` (text, lang), in blocks of names; rows with a null language are left out.

    One row a language (4 KB) comes to the driver.
    """
    prepare(labelled.sparkSession)
    parts = labelled.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(task(learn), "lang string, place int, value long")
    total = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    # DIMENSIONS places each.
    vector = F.array_sort(F.collect_list(F.struct("place", "value"))).getField("value").alias("vector")
    rows = sorted(total.groupBy("lang").agg(vector).toLocalIterator())
    blocks = []
    for start in range(0, len(rows), BLOCK):
        part = rows[start : start + BLOCK]
        made = np.array([r[1] for r in part], np.float64)
        length = np.linalg.norm(made, axis=1, keepdims=True)
        blocks.append(([r[0] for r in part], (made / np.where(length > 0, length, 1)).astype(np.float32)))
    return blocks


def _compared(rows: DataFrame, learned: Learned) -> tuple[DataFrame, str, str]:
    """``rows`` (with text) with their best language and its cosine, and the names of these two columns; every block is met in the same pass."""
    best, cosine = ("_" * max(map(len, rows.columns)) + name for name in ("best", "cosine"))
    made = rows.select("*", F.lit(None).cast("string").alias(best), F.lit(None).cast("double").alias(cosine))
    schema = made.schema
    for names, vectors in learned:
        made = made.mapInArrow(task(compare, names, vectors, best, cosine), schema)
    return made, best, cosine


def identify(docs: DataFrame, learned: Learned) -> DataFrame:
    """doc_id, lang_pred and score (cosine, 0 to 1) of every row of ``docs``."""
    prepare(docs.sparkSession)
    made, best, cosine = _compared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learned)
    score = F.least(F.greatest(F.coalesce(cosine, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return made.select("doc_id", F.coalesce(best, F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score"))


def is_held_out(column: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id modulo 4 is 2; a null id is not held out."""
    return F.coalesce(crc_of_id(column) % 4 == 2, F.lit(False))


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out."""
    learned = prototypes(docs.where(~is_held_out()).select("text", "lang"))
    return identify(docs, learned).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text has a letter."""
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for first, end, data, offsets in slices(batch.column("text")):
            keep[first:end] = bundles(data, offsets).any(axis=1)
        yield batch.filter(pa.array(keep))


def keep_known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents with a letter whose best cosine is ``least`` or more.

    If no language could be learned, the documents with a letter stay.
    """
    prepare(docs.sparkSession)
    learned = prototypes(docs.where(~is_held_out()).select("text", "lang"))
    if not learned:
        return docs.mapInArrow(task(lettered), docs.schema)
    made, best, cosine = _compared(docs, learned)
    return made.where(F.col(cosine) >= least).drop(best, cosine)
