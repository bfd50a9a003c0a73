"""Operator 4: exact Jaccard join of documents' shingle sets in regions of the metric space.

One minus the Jaccard similarity is a metric, and a link is a distance of at
most tau. Random documents as pivots don't divide this space at its top: most
documents lie at distance 1 from nearly all others, and windows of that width
would copy everything everywhere. So the first regions come from landmarks
that every link shares, and pivots divide the regions:

1. Sets that are equal are one point; copies never meet each other.
2. A point's shingle hashes are cut into parts of the hash space, about as many
   as shingles can differ between linked sets of that size; linked points agree
   in a whole part of a fixed number of them, with odds under 1e-15 that they
   don't (`Parts`); small sets agree in a run of hashes. Texts that share but a
   passage agree too; so in each group that agrees, only points are neighbours
   whose counts over ranges of the hash space (`profile`) differ by no more than
   linked sets can. Regions are the components of that relation.
3. A region is joined exactly (`region_links`): pivots create Voronoi cells, a
   point is copied to each cell whose pivot is at most 2 tau farther than its
   own, and cells are joined recursively; in cells that pivots don't divide, the
   triangle inequality decides pairs by their distances to the pivots, and the
   rest are counted. Regions over `region_points` points are joined in blocks,
   each pair of blocks a task of its own.

A link joins two points; components of links give the result. Texts without
words have the empty set and are linked with nothing. A null text is an empty
one. Rows that repeat are documents of equal sets. A null id is passed over in
the smallest id of a component, and is null where there is no other. An empty
table gives no rows. Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesops import Rolling, mix, pieces, utf8
from .components import components

#: Upper case becomes lower, for A-Z alone; white space is \x20 and \x09-\x0D.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Below this many shingles, a part would hold too few of them to tell texts apart.
SMALL = 96
#: Odds that a link has no landmark, at most (natural logarithm of 1e-15).
MISS = math.log(1e-15)
STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text data[at[i]:at[i+1]]."""
    low = LOWER[data]
    blank = BLANK[low]
    n = len(low)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = ~blank
    begins[1:] &= blank[:-1] | edge[1:n]
    start = np.flatnonzero(begins)
    ends = ~blank
    ends[:-1] &= blank[1:] | edge[1:n]
    stop = np.flatnonzero(ends) + 1
    hashes = Rolling(low).spans(start, stop)
    of = np.searchsorted(start, at)  # words before each text
    total = len(hashes)
    wide = np.zeros(max(0, total - words + 1), np.uint64)
    for k in range(words):
        wide += hashes[k : total - words + 1 + k] * STEP[k % 8] + np.uint64(k // 8)
    wide = mix(wide) if len(wide) else wide
    out = []
    for i in range(len(at) - 1):
        a, b = of[i], of[i + 1]
        if b - a >= words:
            out.append(np.unique(wide[a : b - words + 1]))
        elif b > a:  # fewer words: the whole sequence, which no longer shingle equals
            own = hashes[a:b]
            out.append(mix((own * np.array(STEP)[np.arange(b - a) % 8] * np.uint64(2 * (b - a) + 1)).sum(keepdims=True)))
        else:
            out.append(hashes[:0])
    return out


class Parts:
    """The landmarks of linked sets for a threshold of num/den.

    Scheme b is for pairs whose smaller set has size lows[b] to lows[b+1]-1. A
    set differs from a linked one that isn't smaller in at most n(1-t)/t places.
    Small sets have runs of neighbours in hash order, one of which a link must
    share. Larger ones cut the hash space into about as many parts as a link may
    differ in; a part is shared if no difference falls into it, as happens to a
    third of them. So a fixed number of the parts (`takes`), whatever the size of
    the set, leaves odds under 1e-15 that a link shares none: hashes fall into
    parts at random, and numbers of balls in bins are negatively associated, so
    the odds of the single parts may be multiplied.
    """

    def __init__(self, num: int, den: int):
        if not 0.6 * den <= num <= den:
            raise ValueError("thresholds of 0.6 to 1 are served")
        self.num, self.den = num, den
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, lows[-1] * 17 // 10))
        self.lows = np.array(lows)
        both = list(zip(self.lows[:-1].tolist(), (self.lows[1:] - 1).tolist(), strict=True))
        self.runs = np.array([self._run(lo, hi) if hi < SMALL else 0 for lo, hi in both])
        self.parts, self.takes = np.array([self._scheme(lo, hi) if hi >= SMALL else (0, 0) for lo, hi in both]).T

    def _run(self, low: int, high: int) -> int:
        """In hash order, linked sets have so many neighbours in common at least: their differences divide what they share."""
        least = 0
        for n in range(low, high + 1):
            for m in range(n, n * self.den // self.num + 1):
                shared = -(-self.num * (n + m) // (self.num + self.den))
                apart = n + m - 2 * shared
                if shared <= n and apart:
                    run = -(-shared // (apart + 1))
                    least = min(least or run, run)
        return least

    def _scheme(self, low: int, high: int) -> tuple[int, int]:
        """Number of parts, and how many of them are taken, over as many ways to cut as that needs."""
        parts = int(self.differences(np.array(high)))
        if parts == 0:
            return 0, 0
        takes = 0
        for n in np.unique(np.linspace(low, high, 48).astype(np.int64)).tolist():
            out = math.log1p(-1 / parts) if parts > 1 else -math.inf
            differ, shared = int(self.differences(np.array(n))), -(-self.num * n // self.den)
            useful = (math.exp(differ * out) if differ else 1.0) * -math.expm1(shared * out)
            if not useful:
                raise ValueError("thresholds this high need larger sets")
            takes = max(takes, math.ceil(MISS / math.log1p(-min(useful, 1 - 1e-12))))
        return parts, takes

    def differences(self, n: np.ndarray) -> np.ndarray:
        return n * (self.den - self.num) // self.num

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(signature, which set) of the runs, and of the parts taken that aren't empty."""
        n = np.array([len(s) for s in sets], np.int64)
        all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        own_all = np.repeat(np.arange(len(sets)), n)
        grown = mix(all_ * np.uint64(0x9FB21C651E98DF25))
        begin = np.cumsum(n) - n
        sig, which = [], []
        level = np.searchsorted(self.lows, n, side="right") - 1
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grown)])
        for down in (0, 1):
            b = level - down
            use = (n > 0) & (b >= 0)
            b = np.maximum(b, 0)
            if down:  # a smaller partner may stand in the scheme below
                use &= (n * self.num + self.den - 1) // self.den < self.lows[np.minimum(level, len(self.lows) - 1)]
            rows = np.flatnonzero(use & (self.runs[b] > 0) & (n >= self.runs[b]))
            if len(rows):
                size = n[rows] - self.runs[b[rows]] + 1
                own = np.repeat(rows, size)
                at = np.repeat(begin[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                sig.append(mix(before[at + self.runs[b[own]]] - before[at] + mix(b[own].astype(np.uint64) << np.uint64(40))))
                which.append(own)
            parts, left = self.parts[b], np.where(use & (self.parts[b] > 0), self.takes[b], 0)
            salt = 0
            while (left > 0).any():
                take = np.minimum(left, parts)
                m = parts[own_all].astype(np.uint64)
                place = all_ if salt == 0 else mix(all_ + np.uint64(int(STEP[salt % 8]) * salt % (1 << 64)))
                part = (place >> np.uint64(32)) * m >> np.uint64(32)
                held = np.flatnonzero(part < take[own_all].astype(np.uint64))
                own, part, weight = own_all[held], part[held], grown[held]
                if salt:  # hashes are sorted, and so are their parts, but for other ways to cut
                    order = np.lexsort((part, own))
                    own, part, weight = own[order], part[order], weight[order]
                if len(own):
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1])
                    cut = np.flatnonzero(new)
                    scheme = b[own[cut]].astype(np.uint64) << np.uint64(48) | np.uint64(salt << 36)
                    sig.append(mix(np.add.reduceat(weight, cut) + mix(scheme | part[cut] + np.uint64(1))))
                    which.append(own[cut])
                left = left - take
                salt += 1
        if not sig:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sig, which = np.concatenate(sig), np.concatenate(which)
        order = np.argsort(which, kind="stable")
        return sig[order], which[order]


def profile(hashes: np.ndarray) -> bytes:
    """Counts of a set's hashes in 64 to 4096 equal ranges, one for about six hashes; a byte each, 255 for more.

    The profiles of two sets differ by no more, summed over the ranges, than the
    sets do; that holds too where neighbouring ranges are added up.
    """
    bits = min(12, max(6, (len(hashes) // 8).bit_length()))
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def near_points(n: np.ndarray, profiles: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect the sets which may be linked by their sizes n and profiles, as one would by testing all pairs.

    Each point is a pivot for those not reached yet, which it draws in if they
    aren't too far apart; a dense group takes one round, not one for each pair.
    """
    ranges = min(map(len, profiles))
    table = np.vstack([np.frombuffer(p, np.uint8).reshape(ranges, -1).sum(axis=1, dtype=np.int32) for p in profiles])
    edges, rest = [], np.arange(len(n))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            total = n[i] + n[rest]
            shared = -(-num * total // (num + den))
            close = np.abs(table[rest] - table[i]).sum(axis=1) <= total - 2 * shared
            close &= shared <= np.minimum(n[i], n[rest])
            drawn = rest[close].tolist()
            edges += [(i, j) for j in drawn]
            queue += drawn
            rest = rest[~close]
    return edges


def connect(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each group of points with one signature; its rows (sig, point, n, profile) come one after the other."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        points, n, profiles = zip(*rows, strict=True)
        return [(points[i], points[j]) for i, j in near_points(np.array(n), list(profiles), num, den)]

    def batch_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    key, rows, out = None, [], []
    for batch in batches:
        for sig, *row in zip(*(batch.column(c).to_pylist() for c in ("sig", "point", "n", "profile")), strict=True):
            if sig != key:
                out += solve(rows) if rows else []
                key, rows = sig, []
                if len(out) > 1 << 16:
                    yield batch_of(out)
                    out = []
            rows.append(row)
    out += solve(rows) if rows else []
    if out:
        yield batch_of(out)


def describe(batches: Iterator[pa.RecordBatch], words: int, parts: Parts) -> Iterator[pa.RecordBatch]:
    """A row a document: size and hash of its set, and signatures where the task hasn't met the set before."""
    seen: set[int] = set()
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for a, b in pieces(at):
            sets = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], words)
            n = np.array([len(s) for s in sets])
            point = np.array([int(mix((s * STEP[1]).sum(keepdims=True) + np.uint64(len(s)))[0]) for s in sets], np.uint64).view(np.int64)
            fresh = []
            for i, p in enumerate(point.tolist()):
                if n[i] and p not in seen:
                    seen.add(p)
                    fresh.append(i)
            sig, which = parts.signatures([sets[i] for i in fresh])
            counts = np.zeros(b - a, np.int64)
            counts[fresh] = np.bincount(which, minlength=len(fresh)) if len(fresh) else 0
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(sig.view(np.int64)))
            new = set(fresh)
            profiles = pa.array([profile(s) if i in new else None for i, s in enumerate(sets)], pa.binary())
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(n.astype(np.int64)), pa.array(point), lists, profiles], names=["k1", "k2", "n", "point", "sigs", "profile"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right.

    Shingles that many sets on both sides hold are counted by a matrix product,
    exact in float32; rarer ones by going through the pairs that hold them.
    """
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64).reshape(len(left), len(right))
    a, b = np.concatenate(left), np.concatenate(right)

    def distinct(flat: np.ndarray) -> np.ndarray:
        flat = np.sort(flat)
        return flat[np.append(True, flat[1:] != flat[:-1])] if len(flat) else flat

    both = np.sort(np.concatenate([distinct(a), distinct(b)]))
    shared = both[:-1][both[1:] == both[:-1]]
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(shared):
        return out

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, flat)
        held = shared[np.minimum(at, len(shared) - 1)] == flat
        rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        order = np.argsort(at[held], kind="stable")
        return at[held][order], rows[held][order]

    (at_a, rows_a), (at_b, rows_b) = places(left, a), places(right, b)
    n_a, n_b = np.bincount(at_a, minlength=len(shared)), np.bincount(at_b, minlength=len(shared))
    often = n_a * n_b * 300 > out.size
    dense = np.flatnonzero(often)
    slot = np.full(len(shared), -1)
    slot[dense] = np.arange(len(dense))
    width = max(64, (1 << 21) // max(len(left), len(right)))
    for s in range(0, len(dense), width):
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for at, rows, z in ((at_a, rows_a, x), (at_b, rows_b, y)):
            k = (slot[at] >= s) & (slot[at] < s + width)
            z[rows[k], slot[at[k]] - s] = 1
        out += (x @ y.T).astype(np.int64)
    keep = ~often[at_a]
    at_a, rows_a = at_a[keep], rows_a[keep]
    first, many = np.searchsorted(at_b, at_a), n_b[at_a]
    total = np.cumsum(many)
    done = 0
    while done < len(at_a):  # a few million pairs at a time
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 21))))
        m = many[done:stop]
        other = rows_b[np.repeat(first[done:stop] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        out += np.bincount(np.repeat(rows_a[done:stop], m) * len(right) + other, minlength=out.size).reshape(out.shape)
        done = stop
    return out


#: Cells of up to so many points are joined by counting alone.
LEAF = 2
#: A cell has as many pivots as the root of its points, and at most so many.
PIVOTS = 8
BLOCK = 512
#: Distances are told from one another, and from tau, beyond this; closer ones are counted.
NEAR = 1e-9


def region_links(sets: list[np.ndarray], num: int, den: int, tally: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of linked sets, each from both its ends, in arrays (home point, other).

    Pivots divide a cell of over `LEAF` points; where their windows would copy
    most of it into every cell, it stays whole, and distances to the pivots
    decide what they can: two points that differ by more than tau in their
    distance to a pivot aren't linked, two whose distances add up to at most tau
    are. What is left is counted. tally: gets the numbers of pivot rounds,
    divisions, and pairs decided by pivots and by counting.
    """
    size = np.array([len(s) for s in sets])
    tau = 1 - num / den
    tally = {} if tally is None else tally

    def note(what: str, more: int) -> None:
        tally[what] = tally.get(what, 0) + int(more)

    def linked(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        common_ = intersections([sets[i] for i in rows], [sets[i] for i in cols])
        return den * common_ >= num * (size[rows][:, None] + size[cols][None, :] - common_)

    def decide(mine: np.ndarray, theirs: np.ndarray, far: dict[int, np.ndarray]) -> np.ndarray:
        if not far:
            note("counted", len(mine) * len(theirs))
            return linked(mine, theirs)
        x, y = np.array([far[i] for i in mine.tolist()]), np.array([far[i] for i in theirs.tolist()])
        apart, near = np.zeros((len(mine), len(theirs)), bool), np.zeros((len(mine), len(theirs)), bool)
        for p in range(x.shape[1]):
            apart |= np.abs(x[:, p][:, None] - y[:, p][None, :]) > tau + NEAR
            near |= x[:, p][:, None] + y[:, p][None, :] < tau - NEAR
        open_ = ~(apart | near)
        note("by pivots", open_.size - open_.sum())
        rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if len(rows):
            note("counted", len(rows) * len(cols))
            near[np.ix_(rows, cols)] = linked(mine[rows], theirs[cols])
        return near

    def join(home: np.ndarray, all_: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # home: points whose links are wanted; all_: these and the copies from beyond the cell's edge
        far: dict[int, np.ndarray] = {}
        if len(all_) > LEAF and depth < 12:
            note("pivot rounds", 1)
            rng = np.random.default_rng(depth)
            pivots = np.sort(rng.choice(home, min(math.isqrt(len(home)), PIVOTS), replace=False))
            common_ = np.vstack([intersections([sets[i] for i in all_[a : a + 128]], [sets[i] for i in pivots]) for a in range(0, len(all_), 128)])
            d = 1 - common_ / (size[all_][:, None] + size[pivots][None, :] - common_)
            own, nearest = d.argmin(axis=1), d.min(axis=1)
            window = d <= nearest[:, None] + 2 * tau + NEAR
            is_home = np.isin(all_, home)
            if window.sum(axis=0).max() <= 0.7 * len(all_):
                note("divisions", 1)
                for p in range(len(pivots)):
                    cell = is_home & (own == p)
                    if cell.any():
                        yield from join(all_[cell], all_[window[:, p]], depth + 1)
                return
            far = dict(zip(all_.tolist(), d, strict=True))
        # in order of size, which may differ by the threshold's factor at most
        home, all_ = home[np.argsort(size[home], kind="stable")], all_[np.argsort(size[all_], kind="stable")]
        for a in range(0, len(home), BLOCK):
            mine = home[a : a + BLOCK]
            lo = np.searchsorted(size[all_], -(-num * size[mine[0]] // den))
            hi = np.searchsorted(size[all_], size[mine[-1]] * den // num, side="right")
            for b in range(lo, hi, BLOCK):
                theirs = all_[b : min(hi, b + BLOCK)]
                x, y = np.nonzero(decide(mine, theirs, far) & (mine[:, None] != theirs[None, :]))
                if len(x):
                    yield mine[x], theirs[y]

    every = np.arange(len(sets))
    yield from join(every, every, 0)


def join_regions(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(point, root, links): in the task's region or pair of blocks, a linked point's component and the number of documents it is linked to."""

    def solve(points: list[int], sides: list[int], copies: list[int], texts: list[bytes], both: bool) -> pa.RecordBatch | None:
        ids = np.array(points, np.int64)
        side, weight = np.array(sides), np.array(copies, np.float64)
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        sets = [x for a, b in pieces(at) for x in shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], words)]
        root = np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        degree = np.zeros(len(ids), np.int64)
        for home, other in region_links(sets, num, den):
            if both:  # links inside a block are those of the block's own task
                keep = side[home] != side[other]
                home, other = home[keep], other[keep]
            degree += np.bincount(home, weight[other], minlength=len(ids)).astype(np.int64)
            # one link from each home point to each component is enough
            for h, o in set(zip(home.tolist(), root[other].tolist(), strict=True)):
                x, y = find(h), find(o)
                if x != y:
                    root[max(x, y)] = min(x, y)
        hit = np.flatnonzero(degree)
        if not len(hit):
            return None
        tops = np.array([find(i) for i in hit.tolist()])
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[tops]), pa.array(degree[hit])], names=["point", "root", "links"])

    key, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("region", "i", "j", "point", "side", "copies", "body")]
        for region, i, j, *row in zip(*columns, strict=True):
            if key != (region, i, j):
                if rows and (out := solve(*zip(*rows, strict=True), key[1] != key[2])) is not None:
                    yield out
                key, rows = (region, i, j), []
            if not rows or rows[-1][0] != row[0]:  # rows that repeat a document come one after the other
                rows.append(row)
    if rows and (out := solve(*zip(*rows, strict=True), key[1] != key[2])) is not None:
        yield out


def dealt(member: DataFrame, num: int, den: int, region_points: int) -> DataFrame:
    """member(root, point, n, ...) once for each task (root, i, j) that needs the point; side: whether it is of the block i.

    A region of at most `region_points` points and 512 times as many shingles is
    one block. A larger one is cut by set size, into levels of which only
    neighbours can hold a link, and a level into blocks of that size; then each
    pair of blocks of one level, or of two neighbours, is a task.
    """
    shingles = region_points * 512
    size = member.groupBy("root").agg((F.count("*") > region_points).alias("many"), (F.sum("n") > shingles).alias("long"))
    known = member.join(size.select("root", (F.col("many") | F.col("long")).alias("large")), "root")
    whole = known.filter(~F.col("large")).drop("large").select("*", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(1).alias("side"))
    step = math.log(den / num) * 1.001 if num < den else 1.0  # a little wide, as logarithms are rounded
    large = known.filter("large").drop("large").withColumn("level", F.floor(F.log("n") / step).cast("long"))
    levels = large.groupBy("root", "level").agg(F.greatest(F.expr(f"(count(*) - 1) div {region_points}"), F.expr(f"(sum(n) - 1) div {shingles}")).alias("more"))
    block = lambda level, part: level * (1 << 24) + part
    own = large.join(levels, ["root", "level"]).withColumn("own", block(F.col("level"), F.pmod(F.xxhash64("point"), F.col("more") + 1))).drop("more")
    beside = own.withColumn("beside", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)))
    others = beside.join(levels.withColumnRenamed("level", "beside"), ["root", "beside"]).withColumn("other", F.explode(F.expr("transform(sequence(0L, more), p -> beside * 16777216 + p)")))
    pairs = others.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).withColumn("side", (F.col("own") == F.col("i")).cast("int"))
    return whole.unionByName(pairs.select(whole.columns))


def neighbours(met: DataFrame, known: DataFrame, num: int, den: int, group_points: int) -> DataFrame:
    """Edges (a, b) that connect linked points: met(sig, point), known(point, n, profile).

    Signatures of the same points count once. Up to `group_points` points, a
    group is connected by profiles in one task; a larger one is a star around its
    least point, as many near copies are, and left to the region join.
    """
    groups = met.groupBy("sig").agg(F.count("*").alias("g"), F.min("point").alias("least"), F.bit_xor(F.xxhash64("point")).alias("all"))
    groups = common.cut(groups.groupBy("g", "least", "all").agg(F.min("sig").alias("sig")))
    star = common.split_join(met, groups.filter(F.col("g") > group_points).select("sig", "least"), ["sig"])
    stars = star.filter("point <> least").select(F.col("least").alias("a"), F.col("point").alias("b")).distinct()
    held = common.split_join(met, groups.filter(F.col("g") <= group_points).select("sig"), ["sig"]).join(known, "point")
    rows = held.select("sig", "point", "n", "profile").repartition("sig").sortWithinPartitions("sig")
    return rows.mapInArrow(lambda it: connect(it, num, den), "a long, b long").unionByName(stars)


def link(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, region_points: int = 4096, group_points: int = 2048) -> DataFrame:
    """(k1, k2, n, component, root) for each row of docs, as common.keyed(): set size, the component's smallest id and its root point (null without words); links: other documents directly linked."""
    parts = Parts(num, den)
    told = "k1 long, k2 long, n long, point long, sigs array<long>, profile binary"
    base = common.cut(docs.mapInArrow(lambda it: describe(it, words, parts), told))
    slim = base.select("k1", "k2", "n", "point")
    signs = base.filter("size(sigs) > 0").select("point", F.explode("sigs").alias("sig"))
    # copies of a set that different tasks have met are one point; their number doesn't matter
    shared = signs.groupBy("sig").agg(F.min("point").alias("least"), F.max("point").alias("most")).filter("least <> most").select("sig")
    met = common.cut(common.split_join(signs, shared, ["sig"]).distinct())
    known = base.filter("profile is not null").select("point", "n", "profile").join(met.select("point").distinct(), "point").groupBy("point").agg(F.first("n").alias("n"), F.first("profile").alias("profile"))
    near = neighbours(met, known, num, den, group_points)
    region = components(near)  # (node, root)
    holder = slim.join(region.select(F.col("node").alias("point")), "point").groupBy("point").agg(F.min(F.struct("k1", "k2", "n")).alias("h"), F.count("*").alias("copies"))
    member = common.cut(region.join(holder, F.col("node") == F.col("point")).select("root", "point", "copies", "h.k1", "h.k2", "h.n"))
    asked = dealt(member, num, den, region_points).select("k1", "k2", F.col("root").alias("region"), "i", "j", "side", "point", "copies")
    place = ["region", "i", "j"]
    texts = docs.join(asked, ["k1", "k2"]).select(*place, "point", "side", "copies", F.col("text").cast("binary").alias("body"))
    found = common.cut(texts.repartition(*place).sortWithinPartitions(*place, "point").mapInArrow(lambda it: join_regions(it, words, num, den), "point long, root long, links long"))
    tops = components(found.filter("point <> root").select(F.col("root").alias("a"), F.col("point").alias("b")))
    points = slim.filter("n > 0").groupBy("point").agg(F.min(F.when(F.col("k1") != common.NULL_ID, F.col("k1"))).alias("low"), F.count("*").alias("copies"))
    links = found.groupBy("point").agg(F.sum("links").alias("links"))
    top = points.join(tops.select(F.col("node").alias("point"), "root"), "point", "left").join(links, "point", "left").withColumn("root", F.coalesce("root", "point"))
    smallest = top.groupBy("root").agg(F.min("low").alias("component"))
    named = top.join(smallest, "root").select("point", "component", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    alone = F.when(F.col("k1") != common.NULL_ID, F.col("k1"))
    return slim.join(named, "point", "left").select("k1", "k2", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(alone).alias("component"), F.coalesce("links", F.lit(0)).alias("links"), "root")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.keyed(common.table(spark, sf_dir, "documents"))
    return link(docs, words=4, num=85, den=100).select(common.doc_id(), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near duplicates (five words, 0.8) one row stays, that of the smallest id (null ids last), then of the smallest text hash.

    Ids play no part in what is a duplicate: rows of null or repeated ids stay
    unless they are near duplicates. Rows without words all stay.
    """
    found = link(common.keyed(docs)).groupBy("root", "k1", "k2").agg(F.count("*").alias("rows"))
    lone = F.col("root").isNull()
    first = F.min(F.struct(F.col("k1") == common.NULL_ID, "k1", "k2", "rows")).alias("first")
    keep = found.groupBy("root", F.when(lone, F.col("k1")).alias("own"), F.when(lone, F.col("k2")).alias("text")).agg(first)
    keep = common.cut(keep.select(F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2"), (~lone & (F.col("first.rows") > 1)).alias("repeated")))
    full = docs.withColumns({"__k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)), "__k2": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    repeated = keep.filter("repeated").drop("repeated")
    if repeated.isEmpty():
        return full.join(keep, ["__k1", "__k2"], "left_semi").select(docs.columns)
    once = full.join(keep.filter("not repeated"), ["__k1", "__k2"], "left_semi").select(docs.columns)
    # rows that repeat id and text: the first by what else they hold
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = full.join(repeated, ["__k1", "__k2"], "left_semi").groupBy("__k1", "__k2").agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return once.unionByName(one.select("__row.*"))
