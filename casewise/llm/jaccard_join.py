"""N-gram Jaccard join by universe-partition pigeonhole.

A document is its set of distinct five-word shingles; two documents link when their Jaccard
similarity is at least 0.75. The join finds every link:

1. Equal sets are one class, known by two 64-bit sums of their shingles and the size.
2. Sizes fall into bands [2^b, 2^(b+1)). In band b the universe of shingles is cut by a hash into
   m segments. A linked pair whose smaller set has band b differs in at most H shingles, so it
   agrees on at least m - H segments, and the subset in one segment is a signature to meet at.
   A set larger than its partner takes part in the band below too, if that partner can exist.
3. Allocation by cost. A set needs only its H + 1 cheapest signatures under an order both sides
   know: more shingles in the segment first, then by hash. A pair's first common segment is among
   them. Empty subsets and subsets of very frequent shingles alone cost too much and are skipped.
   A set left with H or fewer usable segments gives all of them, and their one-deletion
   neighbourhoods: a partner in the same position then meets it, since spoiling a segment with
   neighbourhood takes two differences. Should even these not add up to H + 1, the set also gives
   its shingle prefix (rarest first), which meets every linked partner that does the same.
   Frequent shingles are known from counters over all documents (a fixed number of them); the
   allocation only moves cost, the pigeonhole argument holds for any choice.
4. Signatures travel packed, in blocks by hash range. A signature with up to ``SMALL`` sets gives
   all their pairs. A larger one is a group; its sets are paired with its centre, the set that
   stands in most groups. Pairs whose sizes and profiles (shingles counted in 128 bins) allow it are
   verified on the shingle sets and joined to components.
5. Groups whose sets still lie in several components are compared in full, all groups of a centre
   together, in blocks of bounded size: first by profiles, which leaves the sets that a set of another
   component might link to, then these by their shingles, common ones counted by matrix products inside a task,
   which gives back no more than the links that join its components. So no link that matters for a component
   is missed, and large groups of near copies never become rows of pairs.

Shingles are compared by 64-bit hashes of the whole words.

Nulls, empty texts and texts without a word: an empty set, size 0, linked with nothing, the
document its own component. Repeated rows and equal texts share a class. An empty table gives no
rows. Other columns, whatever their names, are not read; a null doc_id keeps its row and never
names a component unless every id of the component is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from casewise.llm.common import Workspace, components, group_task, prepare, task
from casewise.llm.texts import U, mix, shingle_sets, slices, sums_by_row
from casewise.session import Scratch

# Similarity as a fraction, and the segments per band: SHARE of the band's upper end, and a few.
TIMES, OF = 75, 100
SHARE, EXTRA = 0.45, 2
# Sets of a signature up to which all pairs are compared.
SMALL = 8
# Counters of shingle frequency; a counter far above the mean marks frequent shingles.
CELL_BITS = 18
LOCAL_TIMES, GLOBAL_TIMES, LEAST_FREQUENT = 4, 8, 64
# Hash ranges, signatures gathered before a task sends its blocks, signatures wanted in a range.
LEAST_RANGES, FLUSH, RANGE_SIGNATURES = 512, 1 << 20, 200_000
# Least bins of a set's profile, by which pairs that differ too much are left out before sets are fetched; a large
# set has a power of two of them, so that about SHARED shingles at most share one.
BINS, SHARED = 128, 4
# The filter that keeps unneeded sets out of the verifying shuffle: bits for each needed class, and the least
# and greatest size as a power of two (32 MB; what passes beyond that is left out after the shuffle).
FILTER_SHARE, LEAST_BITS, MOST_BITS = 16, 16, 28

_SEGMENT, _MEMBER, _SUM_A, _SUM_B, _TOKEN = (U(x) for x in (0xA5B3571FD1, 0x7C1E99A4B7, 0x1D8AF066ED, 0x93D6E2C15B, 0x4F2BB1A9C7))

_SUMMARY = "doc_id long, n int, a long, b long, profile binary, cell int, heavy long"
# A text with a word.
_WORDED = r"[^ \t-\r]"
BLOCKS = "part int, packed binary"
FOUND = "kind int, a long, b long"
SETS = "a long, n int, members binary"
# Sets of a block, and its shingles; a task compares two blocks. Shingles in at least DENSE sets of them go into a matrix,
# so many columns at a time.
BLOCK, BLOCK_SHINGLES, DENSE, COLUMNS = 1024, 1 << 22, 16, 4096


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _marks(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums_by_row(mix(values ^ _SUM_A), at), sums_by_row(mix(values ^ _SUM_B), at)


def _cells(values: np.ndarray) -> np.ndarray:
    return (values >> U(64 - CELL_BITS)).astype(np.int64)


def profile_sizes(size: np.ndarray) -> np.ndarray:
    """Bins of the profiles of sets of these sizes."""
    return BINS << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / (BINS * SHARED)))).astype(np.int64)


def _folded(profile: np.ndarray, bins: int) -> np.ndarray:
    """Profiles (the last axis) in fewer bins."""
    return profile.reshape(*profile.shape[:-1], -1, bins).sum(axis=-2, dtype=np.int32)


def summarize(batches: Iterator[pa.RecordBatch], keyed: bool = False) -> Iterator[pa.RecordBatch]:
    """One row per document (id, set size, two sums, its ``key`` if it has one), and a task's frequent counters with their counts."""
    counts = np.zeros(1 << CELL_BITS, np.int64)
    names = ["doc_id", "n", "a", "b", "profile", "cell", "heavy", *(["key"] if keyed else [])]
    for batch in batches:
        ids = batch.column("doc_id")
        for first, end, data, offsets in slices(batch.column("text")):
            values, at = shingle_sets(data, offsets)
            counts += np.bincount(_cells(values), minlength=len(counts))
            a, b = _marks(values, at)
            n = end - first
            row = np.repeat(np.arange(n), np.diff(at))
            wide = profile_sizes(np.diff(at))
            base = np.concatenate([[0], np.cumsum(wide)])
            bins = np.bincount(base[row] + (values.view(np.int64) & (wide - 1)[row]), minlength=base[-1])
            profile = np.minimum(bins, 255).astype(np.uint8).tobytes()
            columns = [ids.slice(first, n), pa.array(np.diff(at).astype(np.int32)), pa.array(_signed(a)), pa.array(_signed(b))]
            columns += [pa.array([profile[x:y] for x, y in zip(base[:-1], base[1:], strict=True)], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
            if keyed:
                columns.append(batch.column("key").slice(first, n))
            yield pa.RecordBatch.from_arrays(columns, names)
    heavy = np.flatnonzero(counts > LOCAL_TIMES * max(1.0, counts.mean()))
    if len(heavy):
        none = [pa.nulls(len(heavy), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
        columns = [*none, pa.array(heavy.astype(np.int32)), pa.array(counts[heavy])]
        if keyed:
            columns.append(pa.nulls(len(heavy), pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names)


def _bands(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, H) for every band a set takes part in."""
    rows = np.flatnonzero(size > 0)
    size = size[rows]
    own = np.floor(np.log2(size)).astype(np.int64)
    low = np.int64(1) << own
    # |r| + |s| differences at most (1 - t) / (1 + t) of it; the larger set has at most size / t shingles.
    most = (OF - TIMES) * (size + size * OF // TIMES) // (OF + TIMES)
    below = -(-TIMES * size // OF) <= low - 1
    most_below = (OF - TIMES) * (size + low - 1) // (OF + TIMES)
    return (
        np.concatenate([rows, rows[below]]),
        np.concatenate([own, own[below] - 1]),
        np.concatenate([most, most_below[below]]),
    )


def signatures(values: np.ndarray, at: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the sets; ``frequent`` marks the counters of frequent shingles."""
    size = np.diff(at)
    row, band, most = _bands(size)
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    segments = np.ceil(SHARE * (np.int64(2) << band)).astype(np.int64) + EXTRA
    base = np.concatenate([[0], np.cumsum(segments)])
    # One entry per shingle of every (set, band).
    length = size[row]
    entry = np.repeat(np.arange(len(row)), length)
    at_entry = np.concatenate([[0], np.cumsum(length)])
    member = values[np.arange(at_entry[-1]) - at_entry[entry] + at[row][entry]]
    where = mix(member ^ _SEGMENT ^ (band[entry].astype(np.uint64) << U(56)))
    key = base[entry] + ((where >> U(32)) * segments[entry].astype(np.uint64) >> U(32)).astype(np.int64)
    part = mix(member ^ _MEMBER)
    rare = ~frequent[_cells(member)]
    sums = np.zeros(base[-1], np.uint64)
    np.add.at(sums, key, part)
    held = np.bincount(key, minlength=base[-1])
    rares = np.bincount(key[rare], minlength=base[-1])
    usable = np.flatnonzero(rares > 0)
    owner = np.searchsorted(base, usable, "right") - 1
    salt = (band[owner].astype(np.uint64) << U(40)) + (usable - base[owner]).astype(np.uint64)
    exact = mix(sums[usable] + salt * _SEGMENT)
    enough = np.bincount(owner, minlength=len(row)) > most
    # The H + 1 cheapest signatures of a set: fuller segments first, then by hash.
    rank = (U(7) - np.minimum(held[usable], 7).astype(np.uint64)) << U(61) | exact >> U(3)
    order = np.lexsort((rank, owner))
    firsts = np.searchsorted(owner, np.arange(len(row)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    taken = ~enough[owner] | (place - firsts[owner] <= most[owner])
    made = [(exact[taken], row[owner[taken]])]
    if not enough.all():
        # One-deletion neighbourhoods, without those left empty or with frequent shingles alone.
        left = rares[key] - rare
        near = ~enough[entry] & (rares[key] > 0) & (left > 0)
        at_key = key[near]
        own = entry[near]
        salt = (band[own].astype(np.uint64) << U(40)) + (at_key - base[own]).astype(np.uint64)
        made.append((mix(sums[at_key] - part[near] + salt * _SEGMENT), row[own]))
        worth = np.bincount(owner, np.minimum(rares[usable], 2), len(row))
        for k in np.flatnonzero(~enough & (worth <= most)):
            own = slice(at_entry[k], at_entry[k + 1])
            prefix = length[k] - -(-TIMES * length[k] // OF) + 1
            picked = np.lexsort((member[own], ~rare[own]))[:prefix]
            made.append((mix(member[own][picked] ^ _TOKEN ^ U(int(band[k]) << 56)), np.full(prefix, row[k])))
    return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])


def blocks(sig: np.ndarray, owner: np.ndarray, ranges: int) -> pa.RecordBatch:
    """(part, packed): the distinct pairs of signature and owner by hash range of the signature.

    Within a range 32 bits of a signature tell all but a few apart; what they confuse is verified.
    """
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
    sig, owner = sig[new], owner[new]
    part = ((sig >> U(32)) * U(ranges) >> U(32)).astype(np.int32)
    cut = np.searchsorted(part, np.arange(ranges + 1))
    full = np.flatnonzero(np.diff(cut))
    packed = [sig[cut[p] : cut[p + 1]].astype(np.uint32).tobytes() + owner[cut[p] : cut[p + 1]].tobytes() for p in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(packed, pa.binary())], ["part", "packed"])


def pack(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Signatures with the class's first sum, in blocks by hash range; a block holds each pair of both once."""
    frequent = np.zeros(1 << CELL_BITS, bool)
    frequent[heavy] = True
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            values, at = shingle_sets(data, offsets)
            sig, row = signatures(values, at, frequent)
            if len(sig):
                kept.append((sig, _marks(values, at)[0][row]))
                count += len(sig)
            if count >= FLUSH:
                yield blocks(*(np.concatenate(k) for k in zip(*kept, strict=True)), ranges)
                kept, count = [], 0
    if kept:
        yield blocks(*(np.concatenate(k) for k in zip(*kept, strict=True)), ranges)


def meet(rows: pa.Table) -> pa.Table:
    """Candidate pairs of one hash range (kind 0: a, b), and the sets of its large signatures (kind 1: signature, set)."""
    held = [(x, len(x) // 12) for x in rows.column("packed").to_pylist()]
    sig = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in held]).astype(np.uint64)
    sig |= U(rows.column("part")[0].as_py()) << U(32)
    owner = np.concatenate([np.frombuffer(x, np.uint64, n, 4 * n) for x, n in held])
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
    sig, owner = sig[new], owner[new]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    length = np.diff(np.concatenate([start, [len(sig)]]))
    left, right, kind = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    some = (length > 1) & (length <= SMALL)
    for i in range(SMALL - 1):
        for j in range(i + 1, SMALL):
            at = start[some & (length > j)]
            left.append(owner[at + i])
            right.append(owner[at + j])
    large = np.flatnonzero(length > SMALL)
    seen = set()
    for k in large.tolist():
        members = owner[start[k] : start[k] + length[k]]
        same = (len(members), int(mix(members).sum(dtype=np.uint64)))
        if same in seen:
            continue
        seen.add(same)
        kind.append(np.stack([np.full(len(members), sig[start[k]]), members]))
    a, b = np.concatenate(left), np.concatenate(right)
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
    groups = [x for x in kind if x.ndim == 2]
    ga = np.concatenate([g[0] for g in groups]) if groups else np.zeros(0, np.uint64)
    gb = np.concatenate([g[1] for g in groups]) if groups else np.zeros(0, np.uint64)
    kinds = np.concatenate([np.zeros(len(a), np.int32), np.ones(len(ga), np.int32)])
    return pa.table(
        {"kind": kinds, "a": _signed(np.concatenate([a, ga])), "b": _signed(np.concatenate([b, gb]))},
        schema=pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]),
    )


def wanted(a: np.ndarray, values: np.ndarray, at: np.ndarray, bits: bytes) -> pa.RecordBatch:
    """The sets, once per class ``a``, that are not empty and pass the filter."""
    _, once = np.unique(a, return_index=True)
    rows = np.intersect1d(np.flatnonzero(passes(bits, a) & (np.diff(at) > 0)), once)
    members = [values[at[r] : at[r + 1]].tobytes() for r in rows.tolist()]
    sizes = np.diff(at)[rows].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(_signed(a[rows])), pa.array(sizes), pa.array(members, pa.binary())], ["a", "n", "members"])


def wanted_sets(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """The shingle sets whose class passes the filter."""
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            values, at = shingle_sets(data, offsets)
            yield wanted(_marks(values, at)[0], values, at, bits)


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that may link by their sizes and profiles: sets differ at least as much as their profiles."""
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
        differ = np.zeros(len(n_a), np.int64)
        for k, (x, y) in enumerate(zip(batch.column("p_a"), batch.column("p_b"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            bins = min(len(x), len(y))
            # A full bin may hold more than it says.
            if len(x) == len(y) or max(x.max(), y.max()) < 255:
                differ[k] = np.abs(_folded(x, bins) - _folded(y, bins)).sum()
        keep = (differ * (TIMES + OF) <= (OF - TIMES) * (n_a + n_b)) & (np.minimum(n_a, n_b) * OF >= np.maximum(n_a, n_b) * TIMES)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets reach the similarity."""
    for batch in batches:
        first, second = batch.column("set_a"), batch.column("set_b")
        keep = np.zeros(len(batch), bool)
        last, x = None, np.zeros(0, np.uint64)
        for k in range(len(batch)):
            raw = first[k].as_py()
            if raw != last:
                last, x = raw, np.frombuffer(raw, np.uint64)
            y = np.frombuffer(second[k].as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            common = int((x[at] == y).sum())
            keep[k] = OF * common >= TIMES * (len(x) + len(y) - common)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def compare(rows: pa.Table) -> pa.Table:
    """Links (a, b) between sets of different components in two blocks of a group, as many as join the components."""
    members = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]
    a, root, block = (rows.column(c).to_numpy() for c in ("a", "root", "block"))
    size = np.array([len(m) for m in members], np.int64)
    n = len(members)
    tokens = np.concatenate(members)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    length = np.diff(np.concatenate([start, [len(tokens)]]))
    common = np.zeros((n, n), np.float32)
    for times in range(2, min(DENSE, n + 1)):
        at = start[length == times]
        for i in range(times - 1):
            for j in range(i + 1, times):
                np.add.at(common, (owner[at + i], owner[at + j]), 1)
    common += common.T
    dense = np.flatnonzero(length >= DENSE)
    for k in range(0, len(dense), COLUMNS):
        some = dense[k : k + COLUMNS]
        held = np.zeros((n, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), length[some])
        place = np.arange(len(column)) - np.repeat(np.cumsum(length[some]) - length[some], length[some])
        held[owner[start[some][column] + place], column] = 1
        common += held @ held.T
    linked = OF * common >= TIMES * (size[:, None] + size[None, :] - common)
    linked &= root[:, None] != root[None, :]
    if (block != block[0]).any():
        linked &= block[:, None] != block[None, :]
    above = {r: r for r in np.unique(root).tolist()}

    def top(r):
        while above[r] != r:
            above[r] = r = above[above[r]]
        return r

    left, right = [], []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked))), strict=True):
        x, y = top(root[i].item()), top(root[j].item())
        if x != y:
            above[max(x, y)] = min(x, y)
            left.append(a[i])
            right.append(a[j])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def may_link(rows: pa.Table) -> pa.Table:
    """(centre, a, root, n) of the sets in two blocks of a group whose sizes and profiles allow a link with a set of another component."""
    size, root, block = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "root", "block"))
    order = np.argsort(size, kind="stable")
    size, root, block = size[order], root[order], block[order]
    profiles = rows.column("profile").to_pylist()
    # Sets of as many bins stand together; partners have as many or twice as many.
    bins = profile_sizes(size)
    starts = np.flatnonzero(np.diff(bins, prepend=0))
    level = np.searchsorted(starts, np.arange(len(size)), "right") - 1
    whole = [
        np.frombuffer(b"".join(profiles[i] for i in order[x:y].tolist()), np.uint8).reshape(y - x, -1).astype(np.int32)
        for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(size)], strict=True)
    ]
    half = [_folded(m, max(BINS, m.shape[1] // 2)) for m in whole]
    across = bool((block != block[0]).any())
    marked = np.zeros(len(size), bool)
    # A set meets those at least as large as itself, up to its size divided by the similarity.
    ends = np.searchsorted(size, size * OF // TIMES, "right")
    for k in range(len(size)):
        mine = whole[level[k]][k - starts[level[k]]]
        near = slice(k + 1, ends[k])
        some = np.flatnonzero((root[near] != root[k]) & ((block[near] != block[k]) | (not across))) + k + 1
        for at in np.unique(level[some]).tolist():
            part = some[level[some] == at]
            theirs = (whole if at == level[k] else half)[at][part - starts[at]]
            differ = np.abs(theirs - mine).sum(axis=1, dtype=np.int64)
            full = (theirs.max(axis=1) >= 255) | (mine.max() >= 255) if at != level[k] else False
            found = part[full | (differ * (TIMES + OF) <= (OF - TIMES) * (size[part] + size[k]))]
            marked[found] = True
            marked[k] |= len(found) > 0
    return rows.select(["centre", "a", "root", "n"]).take(pa.array(order[marked]))


def filter_bits(needed: DataFrame) -> bytes:
    """A filter of the needed classes (a), its size by their number."""
    size = min(MOST_BITS, max(LEAST_BITS, (FILTER_SHARE * needed.count()).bit_length()))
    low = F.col("a").bitwiseAND((1 << size) - 1)
    words = (
        needed.select(F.shiftright(low, 6).alias("w"), F.expr("shiftleft(1L, cast(a & 63 AS int))").alias("bit"))
        .groupBy("w")
        .agg(F.bit_or("bit").alias("bits"))
    )
    out = np.zeros(1 << (size - 6), np.int64)
    for w, bits in words.toLocalIterator():
        out[w] = bits
    return out.tobytes()


def passes(bits: bytes, classes: np.ndarray) -> np.ndarray:
    """Which classes the filter lets through."""
    words = np.frombuffer(bits, np.uint64)
    low = classes & U(len(words) * 64 - 1)
    return (words[(low >> U(6)).astype(np.int64)] >> (low & U(63)) & U(1)).astype(bool)


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sizes and profiles allow a link."""
    left = classes.select("a", F.col("n").alias("n_a"), F.col("profile").alias("p_a"))
    right = classes.select(F.col("a").alias("b"), F.col("n").alias("n_b"), F.col("profile").alias("p_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(task(alike), "a long, b long").distinct()


def class_sets(texts: DataFrame, reader: Callable, needed: DataFrame) -> DataFrame:
    """The shingle sets (a, n, members) of the classes ``needed`` (a), read from the texts anew."""
    found = texts.mapInArrow(task(reader, filter_bits(needed)), SETS)
    return found.join(needed.distinct(), "a", "left_semi").dropDuplicates(["a", "n"])


def _verified(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs of classes (a, b) that link, checked on their sets."""
    sets = fetch(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))
    left = sets.select("a", F.col("members").alias("set_a"))
    right = sets.select(F.col("a").alias("b"), F.col("members").alias("set_b"))
    # The smaller ids travel first: they are the centres of stars.
    held = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return held.mapInArrow(task(verify), "a long, b long").distinct()


def _centred(groups: DataFrame) -> DataFrame:
    """(centre, a): the sets that share a group with a centre, the set of the group that stands in most groups."""
    often = groups.groupBy("a").agg(F.count(F.lit(1)).alias("often"))
    centre = groups.join(often, "a").groupBy("signature").agg(F.max(F.struct("often", "a")).alias("most"))
    found = groups.join(centre.select("signature", F.col("most.a").alias("centre")), "signature").select("centre", "a")
    return found.distinct()


def _roots(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _open(centres: DataFrame, roots: DataFrame) -> DataFrame:
    """(centre, a, root) of the centres whose sets lie in several components."""
    member = centres.join(roots, centres["a"] == roots["node"], "left").select("centre", "a", F.coalesce("root", "a").alias("root"))
    mixed = member.groupBy("centre").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return member.join(mixed.select("centre"), "centre", "left_semi")


def _dealt(open_: DataFrame, values: DataFrame, *names: str) -> GroupedData:
    """The sets of a centre, with their values (by a), once for every two blocks of them."""
    number = F.count(F.lit(1)) / BLOCK
    if "n" in open_.columns:
        number = F.greatest(number, F.sum("n") / BLOCK_SHINGLES)
    counts = open_.groupBy("centre").agg(F.ceil(number).cast("int").alias("blocks"))
    placed = open_.join(counts, "centre").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = placed.join(values, "a").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    two = [F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")]
    return dealt.select("centre", *two, "block", "a", "root", *names).groupBy("centre", "first", "second")


def _narrowed(open_: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of open centres that may link with one of another component."""
    known = classes.select("a", "n", "profile").dropDuplicates(["a"])
    sized = open_.join(known.select("a", "n"), "a")
    dealt = _dealt(sized, known.select("a", "profile"), "n", "profile")
    return dealt.applyInArrow(group_task(may_link), "centre long, a long, root long, n int").distinct()


def _across(open_: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between components, from comparing all sets of a centre block by block."""
    sets = fetch(open_.select("a")).select("a", "members")
    return _dealt(open_, sets, "members").applyInArrow(group_task(compare), "a long, b long").distinct()


def class_roots(found: DataFrame, fetch: Callable[[DataFrame], DataFrame], classes: DataFrame | None = None) -> DataFrame:
    """(node, root) of the classes with a link, from candidates (see ``meet``); ``fetch`` gives the sets of classes.

    ``classes`` (a, n, profile), where given, serve to leave out what cannot link before sets are fetched.
    """
    groups = found.where("kind = 1").select(F.col("a").alias("signature"), F.col("b").alias("a"))
    work = Workspace()
    centres = work.keep(_centred(groups), "centres")
    around = centres.where(F.col("a") != F.col("centre")).select(F.least("a", "centre").alias("a"), F.greatest("a", "centre").alias("b"))
    pairs = found.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(around).distinct()
    pairs = work.keep(_alike(pairs, classes) if classes else pairs, "pairs")
    if not classes:
        # The pairs around the centres have the sets of all centres, so none is read twice.
        sets = work.keep(fetch(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))), "sets")
        fetch = lambda needed: sets
    links = work.keep(_verified(pairs, fetch), "linked")
    roots = _roots(links)
    open_ = work.keep(_open(centres, roots), "open")
    if classes:
        open_ = work.keep(_narrowed(open_, classes), "narrowed")
    if not open_.isEmpty():
        links = links.unionByName(work.keep(_across(open_, fetch), "across"))
        roots = _roots(links)
    work.clear()
    return roots


def jaccard_classes(docs: DataFrame, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, classes): doc_id, n, a, b of every document, with a hash ``key`` of the text if ``keyed``; a, b, n, id, root of every class."""
    prepare(docs.sparkSession)
    texts = docs.select("text")
    key = [F.xxhash64("text").alias("key")] if keyed else []
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *key)
    summary = Scratch(read.mapInArrow(task(summarize, keyed), _SUMMARY + ", key long" * keyed), "shingles").frame
    documents = summary.where(F.col("n").isNotNull()).select("doc_id", "n", "a", "b", "profile", *["key"] * keyed)
    total = documents.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = max(LEAST_FREQUENT, GLOBAL_TIMES * total / (1 << CELL_BITS))
    # At most 2**CELL_BITS rows.
    heavy = summary.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("heavy").alias("n")).where(F.col("n") > frequent)
    cells = np.array([r[0] for r in heavy.select("cell").collect()], np.int64)
    ranges = max(LEAST_RANGES, total // (2 * RANGE_SIGNATURES))
    found = Scratch(texts.mapInArrow(task(pack, cells, ranges), BLOCKS).groupBy("part").applyInArrow(group_task(meet), FOUND), "candidates")
    of_class = [F.min("doc_id").alias("id"), F.first("profile").alias("profile")]
    classes = Scratch(documents.where("n > 0").groupBy("a", "b", "n").agg(*of_class), "classes").frame
    fetch = partial(class_sets, texts, wanted_sets)
    roots = class_roots(found.frame, fetch, classes)
    found.discard()
    return documents.drop("profile"), classes.join(roots, classes["a"] == roots["node"], "left").select("a", "b", "n", "id", F.coalesce("root", "a").alias("root"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs``."""
    documents, classes = jaccard_classes(docs)
    # Classes with a link share a root; the component's name is the smallest id of its classes.
    named = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = classes.join(named, "root").select("a", "b", "n", "component_id")
    labelled = documents.where("n > 0").join(of_class, ["a", "b", "n"]).select("doc_id", "n", "component_id")
    empty = documents.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return labelled.unionByName(empty).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of which each component keeps the one with the smallest id; rows of that id that repeat it stay one row.

    Documents without a word are no copies of anything and stay.
    """
    found = jaccard_components(docs)
    dropped = found.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def keep_one_row_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: of its rows the one with the smallest (doc_id, nulls last; hash of the text); of rows equal in both, one.

    Rows, not ids, are judged: a null or repeated id decides nothing about another row. Rows without a word are no copies of anything and stay.
    """
    documents, classes = jaccard_classes(docs, keyed=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")).alias("first")
    of_class = documents.where("n > 0").groupBy("a", "b", "n").agg(first)
    kept = of_class.join(classes.select("a", "b", "n", "root"), ["a", "b", "n"]).groupBy("root").agg(F.min("first").alias("first"))
    # The columns travel as one, whatever their names.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").cast("long").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64("text").alias("key"),
    )
    worded = F.coalesce(F.col("doc.text").rlike(_WORDED), F.lit(False))
    once = rows.where(worded).join(kept.select("first.*"), ["none", "id", "key"], "left_semi").dropDuplicates(["none", "id", "key"])
    return once.select("doc").unionByName(rows.where(~worded).select("doc")).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
