"""Alignment of two tokenizers: which tokens of one cover which tokens of the other, and how often across the corpus.

*Overlaps.* Both tokenizers cut the same bytes, a space and the text. The tokens of a slice of documents lie on one axis
of bytes. ``pandas.merge_asof``, keyed by document, gives every token the token of the other side that covers its start; the
union of both directions is every overlap, in the order of its start. An overlap whose two tokens end together ends a group.

*Links.* All pairs of a token of A and one of B in the same group. A document's distinct pairs of ids, with the
number of times each is linked, are stored with it; how many documents hold a pair is a count over the stored pairs.

*Sums.* Of ``T`` stored pairs fewer than ``FREQUENT`` ids can each stand in more than ``T / FREQUENT`` documents. Those
pairs are broadcast, so that most of the stored pairs meet their count where they lie; the others meet theirs in a join by the
pair, where none has more rows than that.

Documents without tokens (null or empty text, or a tokenizer whose tokens do not spell a space and the text) have zeros and the digest ''.
Texts are tokenized whole. Repeated rows each have their row and count as documents of their own; null ids are kept; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import Workspace, prepare, task
from casewise.llm.texts import slices

# At most so many pairs are broadcast.
FREQUENT = 1 << 20
# Bytes of text worked on at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
# Groups with more tokens than this on a side are reduced to their distinct ids before they are paired.
WIDE = 16
# The pattern by which byte-level BPE of this family cuts a text into pieces (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_made: dict[tuple[bytes, bytes], tuple[ByteTokens, PieceTokens]] = {}


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, and where each begins."""
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])])


def _ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and how many each text has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class ByteTokens:
    """Byte-level BPE of a vocabulary file in JSON; strings of special tokens are plain text."""

    def __init__(self, source: bytes):
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        content = json.loads(source)
        special = {t["id"] for t in content.get("added_tokens", [])}
        words = {i: bytes(letters[c] for c in name) for name, i in content["model"]["vocab"].items() if i not in special}
        self.size = max([*words, *special]) + 1
        self.bytes, self.at = _flat([words.get(i, b"") for i in range(self.size)])
        vocab = content["model"]["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in content["model"]["merges"]]
        pieces = content.get("pre_tokenizer") or {}
        plain = pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space")
        self._fast = self._slow = None
        if plain and not content.get("normalizer") and merged == sorted(merged):
            # Ids in the order of the merges: the ranks say it all.
            import tiktoken

            self._fast = tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks={w: i for i, w in words.items()}, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(source.decode())
            self._slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spaced = [" " + t for t in texts]
        if self._fast:
            return _ids([self._fast.encode_ordinary(t) for t in spaced])
        return _ids([e.ids for e in self._slow.encode_batch_fast(spaced, add_special_tokens=False)])


class PieceTokens:
    """A sentencepiece model; it puts the space before the text itself."""

    def __init__(self, source: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.size = self._model.get_piece_size()
        words = []
        for i in range(self.size):
            piece = self._model.id_to_piece(i)
            words.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes, self.at = _flat(words)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _ids(self._model.encode(texts, num_threads=1))


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of every size, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _spelled(tokens: ByteTokens | PieceTokens, ids: np.ndarray) -> np.ndarray:
    """The bytes that the ids stand for."""
    sizes = tokens.at[ids + 1] - tokens.at[ids]
    return tokens.bytes[np.repeat(tokens.at[ids], sizes) + _ramp(sizes)]


def _keep(ids: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ids, sizes) if good.all() else (ids[np.repeat(good, sizes)], sizes[good])


def encoded(a: ByteTokens, b: PieceTokens, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rows with tokens, ids of A, tokens of A a row, ids of B, tokens of B a row)."""
    rows = np.flatnonzero(np.diff(offsets) > 0)
    raw = data.tobytes()
    texts = [raw[x:y].decode() for x, y in zip(offsets[rows].tolist(), offsets[rows + 1].tolist(), strict=True)]
    sides = [a.encode(texts), b.encode(texts)]
    good = np.ones(len(rows), bool)
    for tokens, (ids, sizes) in zip((a, b), sides, strict=True):
        at = np.concatenate([[0], np.cumsum(tokens.at[ids + 1] - tokens.at[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        spelled = _spelled(tokens, ids).tobytes()
        for k, row in enumerate(rows.tolist()):
            x, y = at[k], at[k + 1]
            good[k] &= y - x == offsets[row + 1] - offsets[row] + 1 and spelled[x:y] == b" " + raw[offsets[row] : offsets[row + 1]]
    return rows[good], *_keep(*sides[0], good), *_keep(*sides[1], good)


def groups(a_start: np.ndarray, a_row: np.ndarray, b_start: np.ndarray, b_row: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of A and of B, numbered from 0 along the axis; ``total`` is its length."""
    a = pd.DataFrame({"start": a_start, "row": a_row, "i": np.arange(len(a_start))})
    b = pd.DataFrame({"start": b_start, "row": b_row, "j": np.arange(len(b_start))})
    ahead = pd.merge_asof(a, b, on="start", by="row")
    back = pd.merge_asof(b, a, on="start", by="row")
    i, j = ahead["i"].to_numpy(), ahead["j"].to_numpy()
    # A pair that begins together was found in both directions.
    new = a_start[back["i"].to_numpy()] != b_start
    i, j = np.concatenate([i, back["i"].to_numpy()[new]]), np.concatenate([j, back["j"].to_numpy()[new]])
    order = np.argsort(np.maximum(a_start[i], b_start[j]), kind="stable")
    i, j = i[order], j[order]
    together = np.append(a_start[1:], total)[i] == np.append(b_start[1:], total)[j]
    group = np.cumsum(together) - together
    of_a, of_b = np.empty(len(a_start), np.int64), np.empty(len(b_start), np.int64)
    of_a[i], of_b[j] = group, group
    return of_a, of_b


def _counted(group: np.ndarray, ids: np.ndarray, size: int, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times): as the tokens stand, but each id of a wide group once, with its number."""
    if not wide.any():
        return group, ids, np.ones(len(ids), np.int64)
    inside = wide[group]
    key, times = np.unique(group[inside] * size + ids[inside], return_counts=True)
    group, ids = np.concatenate([group[~inside], key // size]), np.concatenate([ids[~inside], key % size])
    times = np.concatenate([np.ones(len(ids) - len(key), np.int64), times])
    order = np.argsort(group, kind="stable")
    return group[order], ids[order], times[order]


def linked(a_ids, b_ids, a_group, b_group, a_size: int, b_size: int, row_of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of every distinct pair of a row, in order; a pair is id of A * size of B + id of B."""
    n = len(row_of_group)
    wide = (np.bincount(a_group, minlength=n) > WIDE) | (np.bincount(b_group, minlength=n) > WIDE)
    ga, ia, ta = _counted(a_group, a_ids, a_size, wide)
    gb, ib, tb = _counted(b_group, b_ids, b_size, wide)
    partners = np.bincount(gb, minlength=n)
    first = np.cumsum(partners) - partners
    sizes = partners[ga]
    j = np.repeat(first[ga], sizes) + _ramp(sizes)
    pair = np.repeat(ia, sizes) * b_size + ib[j]
    times = np.repeat(ta, sizes) * tb[j]
    row = row_of_group[np.repeat(ga, sizes)]
    order = np.lexsort((pair, row))
    row, pair, times = row[order], pair[order], times[order]
    head = np.ones(len(pair), bool)
    head[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(head)
    return row[at], pair[at], np.add.reduceat(times, at) if len(at) else times


def written(a_ids, b_ids, a_group, b_group, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes ``a1,a2|b1;a3|b2,b3;`` of all groups, and where the bytes of each group begin."""
    of_a, of_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    before_a, before_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    n = len(a_ids) + len(b_ids)
    ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[np.arange(len(a_ids)) + before_b[a_group]] = a_ids
    ids[np.arange(len(b_ids)) + before_a[b_group] + of_a[b_group]] = b_ids
    ends = np.cumsum(of_a + of_b)
    sign[ends - 1 - of_b] = ord("|")
    sign[ends - 1] = ord(";")
    places = max(1, len(str(int(ids.max())))) if n else 1
    cells = np.empty((n, places + 1), np.uint8)
    used = np.ones((n, places + 1), bool)
    for place in range(places):
        power = 10 ** (places - 1 - place)
        cells[:, place] = ids // power % 10 + ord("0")
        if power > 1:
            used[:, place] = ids >= power
    cells[:, places] = sign
    sizes = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    return cells[used], sizes[np.concatenate([[0], ends])]


def align(batches: Iterator[pa.RecordBatch], a_source: bytes, b_source: bytes) -> Iterator[pa.RecordBatch]:
    """Counts, digest, and the distinct pairs of ids with their times, of every document."""
    if (a_source, b_source) not in _made:
        _made.clear()
        _made[a_source, b_source] = ByteTokens(a_source), PieceTokens(b_source)
    a, b = _made[a_source, b_source]
    for batch in batches:
        ids = batch.column("doc_id")
        for first, end, data, offsets in slices(batch.column("text"), SLICE_BYTES):
            n = end - first
            rows, a_ids, a_sizes, b_ids, b_sizes = encoded(a, b, data, offsets)
            counts = np.zeros((4, n), np.int64)
            digest = [""] * n
            at, pairs, times = np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(rows):
                a_ends, b_ends = (np.cumsum(t.at[i + 1] - t.at[i]) for t, i in ((a, a_ids), (b, b_ids)))
                a_start, b_start = (np.concatenate([[0], e[:-1]]) for e in (a_ends, b_ends))
                a_row, b_row = np.repeat(rows, a_sizes), np.repeat(rows, b_sizes)
                a_group, b_group = groups(a_start, a_row, b_start, b_row, int(a_ends[-1]))
                n_groups = int(a_group[-1]) + 1
                row_of_group = np.empty(n_groups, np.int64)
                row_of_group[a_group] = a_row
                counts[0][rows], counts[1][rows] = a_sizes, b_sizes
                counts[2] = np.bincount(row_of_group, minlength=n)
                np.add.at(counts[3], row_of_group, np.bincount(a_group) * np.bincount(b_group))
                text, starts = written(a_ids, b_ids, a_group, b_group, n_groups)
                raw = text.tobytes()
                cut = np.searchsorted(row_of_group, np.arange(n + 1))
                for row in rows.tolist():
                    digest[row] = hashlib.sha256(raw[starts[cut[row]] : starts[cut[row + 1]] - 1]).hexdigest()
                owner, pairs, times = linked(a_ids, b_ids, a_group, b_group, a.size, b.size, row_of_group)
                at = np.searchsorted(owner, np.arange(n + 1))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v)) for v in (pairs, times)]
            columns = [ids.slice(first, n), *map(pa.array, counts), pa.array(digest, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def aligned(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    ``a_path`` is a byte-level BPE file in JSON, ``b_path`` a sentencepiece model. The files, of fixed size, travel with the
    tasks, so only the driver needs the paths.
    """
    prepare(docs.sparkSession)
    with open(a_path, "rb") as file:
        a_source = file.read()
    with open(b_path, "rb") as file:
        b_source = file.read()
    size = PieceTokens(b_source).size
    work = Workspace()
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(task(align, a_source, b_source), schema).withColumn("row", F.monotonically_increasing_id())
    stored = Workspace().keep(found, "aligned")
    held = work.keep(stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held")), "pairs")
    # One row per id of A, of which a vocabulary has a fixed number.
    highest = held.groupBy(F.expr(f"pair div {size}").alias("a")).agg(F.max("held").alias("highest"))
    judged = held.join(F.broadcast(highest), F.expr(f"pair div {size}") == F.col("a"))
    counts = Workspace().keep(judged.select("pair", "held", (F.col("held") == F.col("highest")).alias("best")), "pair-counts")
    work.clear()
    total = counts.agg(F.sum("held")).first()[0] or 0
    usual = F.broadcast(counts.where(F.col("held") * frequent > total))
    rest = counts.where(F.col("held") * frequent <= total)
    links = stored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times")
    links = links.withColumnRenamed("pairs", "pair")
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))
    parts = links.join(usual, "pair").groupBy("row").agg(*sums)
    parts = parts.unionByName(links.join(usual, "pair", "left_anti").join(rest, "pair").groupBy("row").agg(*sums))
    by_row = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    return stored.drop("pairs", "times").join(by_row, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )
