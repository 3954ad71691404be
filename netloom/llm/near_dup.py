"""N-gram Jaccard join with count-vector R-trees.

Each text becomes the set of its distinct k-word shingles (64-bit hashes).
Equal sets form one class; the work below is on classes, so copies cost
nothing more.

Routing.  Two sets with Jaccard >= t differ in at most (1-t)/(1+t) * (|A|+|B|)
shingles.  In a size band with largest size S the hash space is dealt into
m groups, 1 + slack more than two sets of the band can differ in, so 1 + slack
groups at least are equal in both.  The hash of a group's content is a key
that both sets share; empty groups give none.  A set with at most ``slack``
empty groups is sure of an equal group that isn't empty; one with more is dealt
anew with another seed, until it has few.  Of two sets, the one that stops
first is sure under a seed that both have used.  A set also uses the bands
above that a partner can lie in, so a pair above the threshold always meets
under a key.

Meeting.  The keys of an Arrow batch are sorted and packed, five bytes each,
by ranges of the key space, one range a task; a task sorts its range and gives
the keys of two or more sets.  Rows of a batch that share a key send one of
them, so a hot key sends a row a batch.  A key that five bytes confuse with
another adds a candidate and never loses one.

Links by hubs.  Every set is compared with the hub that it shares most keys with: a pair a set, and enough to join most sets of one component.

R-tree join.  A key whose sets are still in different components is searched
completely.  A spanning forest of the surviving pairs is verified first, which
joins nearly all that belongs together.  Keys with other surviving pairs, if their
sets are in different components even then, are searched again, and every
surviving pair between components is verified.  A set's shingle counts in hash
groups are a point; the overlap of two sets is at most the sum of the
coordinate minima, and that of a set and a node of the tree at most the sum of
minima with the node's upper corner, which must reach t/(1+t) * (|A|+|B|).  The tree holds
points of ``TREE`` groups; a pair that survives, and every pair of a key with few sets,
is bounded again by points of about as many groups as the sets have shingles.
What is left is verified exactly on the whole sets.  Keys with more than
``BLOCK`` sets are searched block against block.

No cap, sample or prefix is used anywhere: every pair at or above the threshold
is verified or already inside one component.  ``jaccard_links`` counts each
row's links too, by comparing the sets of a component block by block.

Defined cases: null and empty texts (and texts of white space) have no
shingles and are linked with nothing, each its own component; a text of fewer than k words has
one shingle, its whole sequence; rows that repeat an id are rows of their own;
ids are cast to long, so one that isn't a number is an error (or null, without
ANSI mode); null ids take part, and a component's id is its smallest id that is
not null; an empty table gives an empty result; other columns are ignored, and
``keep_one`` hands them on whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected
from .hashing import U, mix, shingles, word_hashes
from .session import durable, map_arrow

#: Groups of a tree's points, and a tree's fan-out.
TREE = 256
LEAF = 32
#: Sets of a block; keys of at most SMALL sets are compared without a tree.
BLOCK = 4096
SMALL = 48
#: Sets of a block in which links are counted.
LINK_BLOCK = 1024
#: Rows (two numbers) that may be broadcast.
FEW = 1_000_000
#: Seeds under which a set looks for few empty groups.
SEEDS = 8
#: Bits of the filter of wanted rows for each of them, and at most; beyond that it lets more through, which a join drops.
FILTER_BITS = 16
MOST_FILTER_BITS = 1 << 26
SKETCH = "id long, text_hash long, n long, sid long, counts binary"


# --- size bands and group keys -------------------------------------------------------------------------------


def most_different(total: int, percent: int) -> int:
    """Shingles in which two sets of ``total`` shingles together can differ at a Jaccard of percent / 100."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def band_top(band: int) -> int:
    """Largest size in a band; bands are 1.5 times as wide as the one before."""
    return 1 if band == 0 else band_top(band - 1) + max(1, band_top(band - 1) // 2)


def band_of(size: int) -> int:
    band = 0
    while band_top(band) < size:
        band += 1
    return band


@lru_cache(maxsize=4096)
def bands(size: int, percent: int) -> tuple[int, ...]:
    """A set's own band and those above in which a larger partner can lie."""
    return tuple(range(band_of(size), band_of(size * 100 // percent) + 1))


def _full_groups(m: int, size: int) -> float:
    """Groups that are not empty, less two standard deviations, of m groups of a set."""
    if m == 1:
        return 1.0
    one, two = exp(size * log1p(-1 / m)), exp(size * log1p(-2 / m)) if m > 2 else 0.0
    return m * (1 - one) - 2 * sqrt(max(m * (m - 1) * two + m * one - (m * one) ** 2, 0.0))


@lru_cache(maxsize=4096)
def groups_of(band: int, percent: int) -> tuple[int, int, np.ndarray]:
    """Number of groups, how many of them may be empty, and the groups' borders in the hash space.

    The smallest sets that use the band have at most ``slack`` empty groups nearly always.
    """
    differ = most_different(2 * band_top(band), percent)
    least = band_top(band - 1) + 1 if band else 1
    least = -(-least * percent // 100)
    m = differ + 1
    while differ and m < 4 * least + 8 and _full_groups(m, least) < differ + 1:
        m += 1 + m // 200
    return m, m - differ - 1, np.array([(i << 64) // m for i in range(1, m)], dtype=U)


def group_keys(items: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set's groups in all its bands; items: its sorted hashes."""
    out = []
    for band in bands(len(items), percent):
        m, slack, borders = groups_of(band, percent)
        empty = None
        for seed in range(SEEDS):
            dealt = items if seed == 0 else np.sort(mix(items ^ U(0x9FB21C651E98DF25 * seed & 0xFFFFFFFFFFFFFFFF)))
            sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(dealt + U(0x9E3779B97F4A7C15)), dtype=U)])
            at = np.concatenate([[0], np.searchsorted(dealt, borders), [len(dealt)]])
            full = at[1:] > at[:-1]
            salt = mix(np.arange(m, dtype=U) + U(seed << 52) + U(band << 40) + U(1))
            out.append(mix((sums[at[1:]] - sums[at[:-1]] ^ salt)[full]))
            empty = salt[~full] if empty is None else empty
            if len(empty) <= slack or m - int(full.sum()) <= slack:
                break
        else:  # no seed gave few empty groups: they count as equal too
            out.append(mix(empty))
    return np.concatenate(out)


# --- count vectors -------------------------------------------------------------------------------------------


def count_vector(items: np.ndarray) -> bytes:
    """Shingles by hash group, half a byte a group, after a byte for the binary logarithm of the number of groups.

    There are at least as many groups as items, and as many as keep every count below 16.
    """
    power = max(6, (len(items) - 1).bit_length())
    while True:
        counts = np.bincount((items & U((1 << power) - 1)).astype(np.int64), minlength=1 << power)
        if counts.max() < 16:
            counts = counts.astype(np.uint8)
            return bytes([power]) + (counts[0::2] | counts[1::2] << 4).tobytes()
        power += 1


class Points:
    """Count vectors of some sets, as matrices of any smaller number of groups (coarser groups are sums of finer ones)."""

    def __init__(self, counts: list[bytes]):
        self.power = np.array([x[0] for x in counts], dtype=np.int64)
        self.counts, self.kept = counts, {}

    def rows(self, at: np.ndarray, power: int) -> np.ndarray:
        """Points of the rows at ``at``, all of the same power (as the first), folded to 2 ** power groups."""
        half = np.frombuffer(b"".join(self.counts[i][1:] for i in at.tolist()), np.uint8).reshape(len(at), -1)
        out = np.empty((len(at), 2 * half.shape[1]), np.uint8)
        out[:, 0::2], out[:, 1::2] = half & 15, half >> 4
        return out if out.shape[1] == 1 << power else out.reshape(len(at), -1, 1 << power).sum(axis=1, dtype=np.uint16)

    def folded(self, at: np.ndarray, most: int) -> np.ndarray:
        """Points of the rows at ``at`` in one matrix, of ``most`` groups at most."""
        power = min(int(self.power[at].min()), most.bit_length() - 1)
        out = np.empty((len(at), 1 << power), np.uint16)
        for p in np.unique(self.power[at]):
            own = np.flatnonzero(self.power[at] == p)
            out[own] = self.rows(at[own], power)
        return out

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums of the coordinate minima of pairs, in the groups of the coarser point of each."""
        out = np.empty(len(a), np.int64)
        kinds = self.power[a] * 64 + self.power[b]
        for kind in np.unique(kinds):
            own, power = np.flatnonzero(kinds == kind), min(kind // 64, kind % 64)
            step = max(1, (1 << 23) >> int(max(kind // 64, kind % 64)))
            for part in (own[i : i + step] for i in range(0, len(own), step)):
                sides = []
                for x in (a[part], b[part]):
                    rows, place = np.unique(x, return_inverse=True)
                    sides.append(self.rows(rows, int(power))[place])
                out[part] = np.minimum(*sides).sum(axis=1, dtype=np.int64)
        return out


# --- the sketch of each text ---------------------------------------------------------------------------------


def set_id(items: np.ndarray) -> int:
    """A set's name: a hash of its content and size; 0 for the empty set."""
    return int(mix(np.array([np.add.reduce(mix(items), dtype=U) + U(len(items))], dtype=U)).view(np.int64)[0]) if len(items) else 0


def _labels(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key, which rises with the key, and the label that stands for it: bucket and five bytes."""
    bucket = (keys >> U(40)) * U(buckets) >> U(24)
    return bucket, bucket << U(40) | keys & U((1 << 40) - 1)


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each text; its count vector if no row of the batch before it has the same set."""
    for batch in batches:
        sizes, sids, counts, seen = [], [], [], {0}
        for _, words in word_hashes(batch.column(2)):
            items = shingles(words, k)
            sizes.append(len(items))
            sids.append(set_id(items))
            counts.append(None if sids[-1] in seen else count_vector(items))
            seen.add(sids[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(counts, pa.binary())], names=["id", "text_hash", "n", "sid", "counts"])


def _packed(bucket: int, known: bool, keys: np.ndarray, row: np.ndarray, sids: np.ndarray) -> tuple:
    """Keys of the rows ``row`` of a batch: five bytes each, or eight of those that are known to meet."""
    rows, place = np.unique(row, return_inverse=True)
    eight = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bucket, known, (eight if known else np.ascontiguousarray(eight[:, :5])).tobytes(), place.astype("<u2").tobytes(), sids[rows].tobytes()


def _batch_keys(column: pa.Array, k: int, percent: int, buckets: int) -> Iterator[tuple]:
    sids, keys, seen = [], [], {0}
    for _, words in word_hashes(column):
        items = shingles(words, k)
        sids.append(set_id(items))
        keys.append(np.empty(0, U) if sids[-1] in seen else group_keys(items, percent))
        seen.add(sids[-1])
    flat, row = np.concatenate([*keys, np.empty(0, U)]), np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    sids = np.array(sids, dtype="<i8")
    own, first, inverse, times = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    # keys that several rows of the batch have are known to meet: they go anywhere
    met = np.flatnonzero(times[inverse] > 1)
    for part in (met[i : i + (1 << 16)] for i in range(0, len(met), 1 << 16)):
        yield _packed(int(zlib.crc32(flat[part].tobytes()) % buckets), True, _labels(flat[part], buckets)[1], row[part], sids)
    # and one row of the batch sends its key on, to the task of the key's bucket
    bucket, _ = _labels(own, buckets)
    numbers, starts = np.unique(bucket, return_index=True)
    for number, a, b in zip(numbers.tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
        yield _packed(number, False, own[a:b], row[first[a:b]], sids)


def _keys(batches: Iterator[pa.RecordBatch], k: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The packed keys of each batch, by bucket."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1 << 14):  # a row's place in a part fits two bytes
            made = list(_batch_keys(batch.column(0).slice(a, 1 << 14), k, percent, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, (_, t) in enumerate(_PACKED)], names=[n for n, _ in _PACKED])


_PACKED = [("bucket", pa.int32()), ("known", pa.bool_()), ("keys", pa.binary()), ("at", pa.binary()), ("sids", pa.binary())]


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sid) of the keys of two or more sets, from all packed rows of some buckets."""

    def made(label: np.ndarray, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(label), 1 << 19):
            yield pa.RecordBatch.from_arrays([pa.array(label[a : a + (1 << 19)].view(np.int64)), pa.array(sid[a : a + (1 << 19)].astype(np.int64))], names=["key", "sid"])

    labels, sids = [np.empty(0, U)], [np.empty(0, np.int64)]
    for batch in batches:
        for bucket, known, keys, at, names in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            sid = np.frombuffer(names, "<i8")[np.frombuffer(at, "<u2")]
            if known:
                yield from made(np.frombuffer(keys, "<u8").astype(U), sid)
                continue
            eight = np.zeros((len(keys) // 5, 8), np.uint8)
            eight[:, :5] = np.frombuffer(keys, np.uint8).reshape(-1, 5)
            labels.append(eight.view("<u8").ravel().astype(U) | U(bucket << 40))
            sids.append(sid)
    label, sid = np.concatenate(labels), np.concatenate(sids)
    del labels, sids
    order = np.lexsort((sid, label))
    label, sid = label[order], sid[order]
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (sid[1:] != sid[:-1])
    label, sid = label[new], sid[new]
    same = np.zeros(len(label) + 1, bool)
    same[1:-1] = label[1:] == label[:-1]
    met = same[1:] | same[:-1]
    yield from made(label[met], sid[met])


def _shared_keys(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, sid) of all keys that two or more different sets have.

    The packed keys aren't stored: they go from the texts straight into the shuffle.
    """
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = map_arrow(texts.select("text"), lambda it: _keys(it, k, percent, buckets), "bucket int, known boolean, keys binary, at binary, sids binary")
    return durable(map_arrow(packed.repartitionById(buckets, "bucket"), _meeting, "key long, sid long").distinct())


# --- R-tree --------------------------------------------------------------------------------------------------


class CountTree:
    """R-tree over count vectors, bulk-loaded in sort-tile order by size and the widest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        wide = np.argsort(-points.astype(np.float32).var(axis=0), kind="stable")[:2]
        self.order = np.lexsort([points[:, wide[1]], points[:, wide[0]], sizes])
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [self._up(self.points, self.sizes)]
        while len(self.levels[-1][1]) > LEAF:
            self.levels.append(self._up(*self.levels[-1]))

    @staticmethod
    def _up(upper: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(least), LEAF)
        return np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(least, at)

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose overlap bound with the point can reach the threshold."""

        def passes(rows: np.ndarray, upper: np.ndarray, least: np.ndarray) -> np.ndarray:
            bound = np.minimum(upper[rows], point).sum(axis=1, dtype=np.int64)
            return rows[bound * (100 + percent) >= percent * (size + least[rows])]

        rows = np.arange(len(self.levels[-1][1]))
        for level in range(len(self.levels) - 1, -1, -1):
            rows = passes(rows, *self.levels[level])
            below = len(self.points) if level == 0 else len(self.levels[level - 1][1])
            rows = (rows[:, None] * LEAF + np.arange(LEAF)).ravel()
            rows = rows[rows < below]
        return self.order[passes(rows, self.points, self.sizes)]


def _candidates(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group that the count vectors can't tell apart, and how far their overlap is at most above the threshold.

    rows: whole groups (key, low, high), one after the other.
    """
    key, low, high, side, sid, comp, n = (rows.column(c).to_numpy() for c in ("key", "low", "high", "side", "sid", "comp", "n"))
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    size, points = np.diff(np.append(start, len(key))), Points(rows.column("counts").to_pylist())
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    whole = (size <= SMALL) & (low[start] == high[start])
    for s in np.unique(size[whole]).tolist():
        i, j = np.triu_indices(s, 1)
        first = start[whole & (size == s)][:, None]
        left.append((first + i).ravel())
        right.append((first + j).ravel())
    for a, s in zip(start[~whole].tolist(), size[~whole].tolist(), strict=True):
        own, kind = np.arange(a, a + s), side[a : a + s]
        one, other = own[kind != 1], own[kind != 0]
        if not len(one) or not len(other):
            continue
        at = points.folded(own, TREE)
        tree = CountTree(at[one - a], n[one])
        for q in other.tolist():
            hit = one[tree.search(at[q - a], int(n[q]), percent)]
            hit = hit[comp[hit] != comp[q]]
            left.append(hit)
            right.append(np.full(len(hit), q))
    a, b = np.concatenate(left), np.concatenate(right)
    apart = (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b]))
    a, b = a[apart], b[apart]
    # a pair that meets under several keys is bounded once
    _, once = np.unique(np.stack([np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])]), axis=1, return_index=True)
    a, b = a[once], b[once]
    over = points.overlap(a, b) * (100 + percent) - percent * (n[a] + n[b])
    return a[over >= 0], b[over >= 0], over[over >= 0]


def _search(batches: Iterator[pa.RecordBatch], percent: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, again) of the surviving pairs of different components in sorted groups.

    With forest, only a spanning forest of the partition's pairs, and for each key that has other pairs a row with the key as a, and again.
    """
    trees, held, done = Forest(), None, False
    batches = iter(batches)
    while not done:
        batch = next(batches, None)
        done = batch is None
        rows = held if done else pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])]).combine_chunks()
        if rows is None or not rows.num_rows:
            continue
        if done:
            ready, held = rows, None
        else:  # the last group may go on in the next batch
            cut = np.ones(rows.num_rows, bool)
            for c in ("key", "low", "high"):
                x = rows.column(c).to_numpy()
                cut &= x == x[-1]
            cut = rows.num_rows - int(np.argmin(cut[::-1])) if not cut.all() else 0
            ready, held = rows.slice(0, cut), rows.slice(cut)
        if not ready.num_rows:
            continue
        a, b, over = _candidates(ready, percent)
        sid, comp = ready.column("sid").to_numpy(), ready.column("comp").to_numpy()
        keep = np.ones(len(a), bool)
        if forest:
            for i in np.argsort(-over, kind="stable").tolist():
                keep[i] = trees.joins(int(comp[a[i]]), int(comp[b[i]]))
        again = np.unique(ready.column("key").to_numpy()[a[~keep]])
        a, b = a[keep], b[keep]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.minimum(sid[a], sid[b]), again]), pa.int64()), pa.array(np.concatenate([np.maximum(sid[a], sid[b]), np.zeros(len(again), np.int64)]), pa.int64()),
                pa.array(np.arange(len(a) + len(again)) >= len(a)),
            ],
            names=["a", "b", "again"],
        )


# --- the join ------------------------------------------------------------------------------------------------


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose summed coordinate minima can reach the threshold."""
    for x in batches:
        m = x.num_rows
        points = Points(x.column("counts_a").to_pylist() + x.column("counts_b").to_pylist())
        low = points.overlap(np.arange(m), np.arange(m, 2 * m))
        total = x.column("n_a").to_numpy() + x.column("n_b").to_numpy()
        yield x.select(["a", "b"]).filter(pa.array(low * (100 + percent) >= percent * total))


def _bounded_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the bounds of size and overlap."""
    side = lambda s: classes.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("counts").alias(f"counts_{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"least(n_a, n_b) * 100 >= {percent} * greatest(n_a, n_b)")
    return map_arrow(near.select("a", "b", "n_a", "n_b", "counts_a", "counts_b"), lambda it: _bounded(it, percent), "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out, size = [], [], 0
        for row, words in word_hashes(batch.column(0)):
            items = shingles(words, k)
            ids.append(set_id(items))
            out.append(items.view(np.int64))
            size += len(out[-1])
            if size > 500_000 or row == batch.num_rows - 1:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))], names=["sid", "items"])
                ids, out, size = [], [], 0


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """Bits of the values of hashes (one column, ``at``): FILTER_BITS for each value, up to MOST_FILTER_BITS."""
    n = hashes.count()
    bits = 1 << 13
    while bits < min(n * FILTER_BITS, MOST_FILTER_BITS):
        bits *= 2
    block = 1 << 13

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().view(U) & U(bits - 1)).astype(np.int64)
            for b in np.unique(at // block).tolist():
                found.setdefault(b, np.zeros(block, bool))[at[at // block == b] % block] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], names=["block", "bits"])

    dealt = hashes.repartition(F.expr(f"(at & {bits - 1}) div {block}"))
    out = np.zeros(bits // 8, np.uint8)
    for x in map_arrow(dealt, set_bits, "block long, bits binary").collect():  # at most MOST_FILTER_BITS bits
        out[x.block * block // 8 : (x.block + 1) * block // 8] = np.frombuffer(x.bits, np.uint8)
    return out


def _sets_of(wanted: DataFrame, classes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(sid, items) of the wanted sets, from the text of one row of each; all other texts stay where they are.

    A row's place in the filter is looked up by its id and text hash before its text is hashed, so no text is shuffled.
    """
    place = F.xxhash64(F.col("id"), F.col("text_hash")).alias("at")
    wanted = durable(classes.join(wanted.select("sid").distinct(), "sid", "left_semi").select("sid", F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash")))
    bits = _filter_of(wanted.select(place))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (batch.column(0).to_numpy().view(U) & U(8 * len(bits) - 1)).astype(np.int64)
            hit = bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
            if hit.any():
                yield from _sets(iter([pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(hit))], names=["text"])]), k)

    sets = map_arrow(texts.select(place, "text"), found, "sid long, items array<long>")
    return durable(sets.join(wanted, "sid", "left_semi").dropDuplicates(["sid"]))


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of distinct classes whose exact Jaccard reaches the threshold."""
    pairs = durable(pairs)
    if pairs.isEmpty():
        return pairs
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")), classes, texts, k)
    items = lambda s: sets.select(F.col("sid").alias(s), F.col("items").alias(f"items_{s}"))
    both = pairs.join(items("a"), "a").join(items("b"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("same"), (F.size("items_a") + F.size("items_b")).cast("long").alias("total"))
    return durable(both.filter(f"same * 100 >= {percent} * (total - same)").select("a", "b"))


def _hub_pairs(shared: DataFrame) -> DataFrame:
    """For each set the hub that it shares most keys with, the likeliest link; the tree search finds what this leaves out."""
    hubs = shared.groupBy("key").agg(F.min("sid").alias("a"))
    met = shared.join(hubs, "key").filter("sid <> a").groupBy(F.col("sid").alias("b"), "a").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")


def _dealt(named: DataFrame, key: str, block: int, sizes: DataFrame) -> DataFrame:
    """named with low, high and side: the rows of a key in every pair of its blocks that they take part in; sizes: (key, size)."""
    once = sizes.select(key, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = named.join(once, key)
    rows = rows.withColumn("i", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("i") < F.col("j"), 0).when(F.col("i") > F.col("j"), 1).otherwise(2)
    return rows.withColumns({"low": F.least("i", "j"), "high": F.greatest("i", "j"), "side": side}).drop("i", "j", "blocks")


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups one after the other; the work of a group is the square of its rows at worst, so partitions stay as many as asked for, whatever their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def _tree_candidates(shared: DataFrame, components: DataFrame, classes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b, again) of the keys whose sets are still in different components."""
    named = shared.join(components.select(F.col("node").alias("sid"), "component"), "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("comp"))
    open_keys = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("members")).filter("x <> y")
    once = open_keys.groupBy("members", "size").agg(F.min("key").alias("key"))
    rows = _dealt(named, "key", BLOCK, once).join(classes.select("sid", "n", "counts"), "sid").select("key", "low", "high", "side", "sid", "comp", "n", "counts")
    return durable(map_arrow(_gathered(rows, "key", "low", "high"), lambda it: _search(it, percent, forest), "a long, b long, again boolean").distinct())


def _linked(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts, sketch of each row, classes, components (node, component) of the classes that link)."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    sketch = durable(map_arrow(texts, lambda it: _sketch(it, k), SKETCH))
    first = F.struct(F.col("id").isNull().alias("late"), "id", "text_hash")
    classes = durable(sketch.filter("n > 0").groupBy("sid").agg(F.min(first).alias("first"), F.min("n").alias("n"), F.max("counts").alias("counts"), F.count(F.lit(1)).alias("rows")))
    shared = _shared_keys(texts, k, percent)
    components = connected(_verified(_bounded_pairs(_hub_pairs(shared), classes, percent), classes, texts, k, percent))

    def joined(pairs: DataFrame) -> DataFrame:
        more = _verified(pairs, classes, texts, k, percent)
        return components if more.isEmpty() else connected(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    found = _tree_candidates(shared, components, classes, percent, True)
    components = joined(found.filter("NOT again").select("a", "b"))
    rest = shared.join(found.filter("again").select(F.col("a").alias("key")), "key", "left_semi")
    components = joined(_tree_candidates(rest, components, classes, percent, False).select("a", "b"))
    return texts, sketch, classes, components


def _named(classes: DataFrame, components: DataFrame) -> DataFrame:
    """(sid, first): the first row of each class's component; stored, so that a join with many copies of a set can be split."""
    joined = components.join(classes.select(F.col("sid").alias("node"), "first"), "node")
    firsts = joined.groupBy("component").agg(F.min("first").alias("name"))
    linked = joined.join(firsts, "component").select(F.col("node").alias("sid"), "name")
    return durable(classes.select("sid", "first").join(linked, "sid", "left").select("sid", F.coalesce("name", "first").alias("first")))


def _with_components(sketch: DataFrame, names: DataFrame) -> DataFrame:
    """The sketch's rows: id, sid, n_shingles, component_id."""
    out = sketch.select("id", "n", "sid").join(names.select("sid", F.col("first.id").alias("name")), "sid", "left")
    return out.select("id", "sid", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id.

    Rows link when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable by links, the row's own included.
    """
    _, sketch, classes, components = _linked(docs, id_col, text_col, k, percent)
    return _with_components(sketch, _named(classes, components)).select(F.col("id").alias(id_col), "n_shingles", "component_id")


# --- links ---------------------------------------------------------------------------------------------------


def _count_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(sid, others): linked rows of other sets, by the whole sets of sorted groups (component, low, high)."""
    held: list[tuple] = []

    def counted() -> pa.RecordBatch:
        side, sid, n, weight = (np.array([x[i] for x in held]) for i in (3, 4, 5, 6))
        one, other = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        flat, row = np.concatenate([x[7] for x in held]), np.repeat(np.arange(len(held)), [len(x[7]) for x in held])
        _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1  # of the shingles that several sets have
        use = times[place] > 1
        place, row = number[place[use]], row[use]
        order = np.argsort(place, kind="stable")
        place, row, same = place[order], row[order], np.zeros((len(one), len(other)), np.float32)
        width = max(1, (1 << 22) // len(held))
        for a in range(0, int(place[-1]) + 1 if len(place) else 0, width):
            part = slice(*np.searchsorted(place, [a, a + width]))
            has = np.zeros((len(held), width), np.float32)
            has[row[part], place[part] - a] = 1
            same += has[one] @ has[other].T
        link = (100 + percent) * same.astype(np.int64) >= percent * (n[one][:, None] + n[other][None, :])
        link &= sid[one][:, None] != sid[other][None, :]
        total = np.zeros(len(held), np.int64)
        total[one] += link.astype(np.int64) @ weight[other]
        if (side != 2).any():
            total[other] += link.T.astype(np.int64) @ weight[one]
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(total)], names=["sid", "others"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        items = batch.column(7)
        for i, x in enumerate(zip(*columns, strict=True)):
            if held and held[-1][:3] != x[:3]:
                yield counted()
                held.clear()
            held.append((*x, items[i].values.to_numpy()))
    if held:
        yield counted()


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, n_links, component_id.

    n_links counts the other rows that a row links with, its copies included.
    Links lie within components, so the different sets of a component are
    compared, block against block of ``LINK_BLOCK``; a block gives a number for
    each of its sets, never its pairs.
    """
    texts, sketch, classes, components = _linked(docs, id_col, text_col, k, percent)
    nodes = components.select(F.col("node").alias("sid"), "component")
    sets = _sets_of(nodes, classes, texts, k).join(classes.select("sid", "n", "rows"), "sid").join(nodes, "sid")
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = _dealt(sets, "component", LINK_BLOCK, sizes).select("component", "low", "high", "side", "sid", "n", "rows", "items")
    linked = map_arrow(_gathered(rows, "component", "low", "high"), lambda it: _count_links(it, percent), "sid long, others long").groupBy("sid").agg(F.sum("others").alias("others"))
    counted = classes.join(linked, "sid", "left").select("sid", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = _with_components(sketch, _named(classes, components)).join(counted, "sid", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")


def _same_row(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> Column:
    return docs[id_col].cast("long").eqNullSafe(rows["_near_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(rows["_near_hash"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest id (null ids last, then by a hash of the text); texts without words stay, all of them.

    The rows to drop are broadcast if they are at most ``FEW``, or else joined.
    """
    _, sketch, classes, components = _linked(docs, id_col, text_col, k, percent)
    named = sketch.filter("n > 0").join(_named(classes, components), "sid").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("_near_rows"), F.min("first").alias("first"))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    named = durable(named.select(F.col("id").alias("_near_id"), F.col("text_hash").alias("_near_hash"), "_near_rows", stays.alias("_near_stays")))
    late, again = named.filter("NOT _near_stays"), named.filter("_near_stays AND _near_rows > 1")
    late = F.broadcast(late) if late.count() <= FEW else late
    out = docs.join(late, _same_row(docs, late, id_col, text_col), "left_anti")
    if again.isEmpty():
        return out
    # rows that repeat both id and text: a task keeps one of them
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_near_row")
    rows = docs.join(again, _same_row(docs, again, id_col, text_col)).select(again["_near_id"], again["_near_hash"], whole)
    single = out.join(again, _same_row(docs, again, id_col, text_col), "left_anti")
    return single.unionByName(rows.groupBy("_near_id", "_near_hash").agg(F.first("_near_row").alias("_near_row")).select("_near_row.*"))
