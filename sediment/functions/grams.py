"""Trigrams as numbers, for tasks that compare texts with a broadcast set of queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Stands where a text is shorter than three characters; no character has it.
_NONE = (1 << 21) - 1
#: Trigrams of a text in a block and in a coarse one, blocks of a run at first and at most, cells of tables, stretches and pairs that are held at once.
BLOCK, COARSE, NARROW, WIDE, CELLS, ROWS, PAIRS = 32, 64, 48, 96, 1 << 22, 512, 1 << 12
#: Bounds are in single precision; this share of them covers their rounding.
ROUNDING = 1e-6


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _packed(c: np.ndarray) -> np.ndarray:
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text as it stands, in order of number; a shorter text is its own trigram."""
    c = _codes(text)
    return np.unique(_packed(c)) if len(c) > 2 else _packed(np.append(c, [_NONE] * (3 - len(c))))


def word_trigrams(text: str) -> np.ndarray:
    """The trigrams of each word of the lower-case text with two blanks before and one after, in order, repeats included."""
    words = re.findall(r"\w+", text.lower())
    if not words:
        return np.zeros(0, np.int64)
    c = _codes("  " + "   ".join(words) + " ")
    inside = ~((c[1:-1] == 32) & (c[2:] == 32))
    return _packed(c)[inside]


def _in_order(ids: np.ndarray) -> np.ndarray:
    """Places of trigrams by number, equal ones in order of place; where characters are few enough, number and place are sorted as one value."""
    a, b, c = ids >> 42, ids >> 21 & _NONE, ids & _NONE
    bits, places = int(np.bitwise_or.reduce(a | b | c)).bit_length(), len(ids).bit_length()
    if 3 * bits + places > 63:
        return np.argsort(ids, kind="stable")
    return np.sort(((a << bits | b) << bits | c) << places | np.arange(len(ids))) & ((1 << places) - 1)


class Index:
    """The distinct values (trigrams, terms) of all queries, and which queries have each."""

    def __init__(self, of_query: list[np.ndarray]) -> None:
        self.size = np.array([len(g) for g in of_query], np.int64)
        self.all, at = np.unique(np.concatenate(of_query) if of_query else np.zeros(0, np.int64), return_inverse=True)
        owner = np.repeat(np.arange(len(of_query)), self.size)
        order = np.argsort(at, kind="stable")
        self.owner, self.start = owner[order], np.searchsorted(at[order], np.arange(len(self.all) + 1))
        self.table: np.ndarray | None = None

    def met(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``own``, query) for each query that has the value at that place, places in order."""
        if not len(self.all) or not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.all, own), len(self.all) - 1)
        places = np.flatnonzero(self.all[at] == own)
        at = at[places]
        n = self.start[at + 1] - self.start[at]
        first = np.repeat(self.start[at] - (np.cumsum(n) - n), n)
        return np.repeat(places, n), self.owner[first + np.arange(n.sum())]

    def counts(self, rows: list[np.ndarray]) -> np.ndarray:
        """[row, query]: how many values of each query each row (distinct values) holds; one product of matrices where the queries' values make a table of ``CELLS`` at most."""
        if not len(self.all) or len(self.all) * max(len(self.size), len(rows)) > CELLS:
            return np.array([self.shared(own) for own in rows], np.int64).reshape(len(rows), len(self.size))
        if self.table is None:
            self.table = np.zeros((len(self.all), len(self.size)), np.float32)
            self.table[np.repeat(np.arange(len(self.all)), np.diff(self.start)), self.owner] = 1
        has = np.zeros((len(rows), len(self.all)), np.float32)
        for i, own in enumerate(rows):
            at = np.minimum(np.searchsorted(self.all, own), len(self.all) - 1)
            has[i, at[self.all[at] == own]] = 1
        return (has @ self.table).astype(np.int64)

    def sums(self, row: np.ndarray, own: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """([row, query] sums of the weights, [row, query] numbers of distinct values) of the values, small numbers, that ``rows`` rows hold, for all of them at once."""
        if not len(self.all):
            return np.zeros((rows, len(self.size))), np.zeros((rows, len(self.size)), np.int64)
        # numbers of values and rows in one, so that a value that a row has several times is met once
        span = int(max(self.all[-1], own.max(initial=0))) + 1
        cells, at = np.unique(row * span + own, return_inverse=True)
        row, own = np.divmod(cells, span)
        places, queries = self.met(own)
        at = np.bincount(at, weight, len(cells))[places]
        flat, shape = row[places] * len(self.size) + queries, (rows, len(self.size))
        return np.bincount(flat, at, rows * len(self.size)).reshape(shape), np.bincount(flat, None, rows * len(self.size)).reshape(shape)

    def shared(self, own: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """How many values of each query ``own`` (distinct) holds, or the sum of their weights."""
        places, queries = self.met(own)
        return np.bincount(queries, None if weight is None else weight[places], len(self.size))


class Extents:
    """A text's best stretches for many queries: shared over all trigrams of the query and the stretch, where that is largest.

    The word trigrams of the text lie in blocks. One product of matrices a
    block tells for all queries at once how many distinct trigrams new in it,
    for every first block before, are not the query's. A stretch reaches a
    floor where what its run of blocks holds of the query, less the floor's
    share of the others in the blocks strictly inside, is the floor's share of
    the query; that is linear, so a run costs a few sums for all queries.
    Only pairs of a query and a first block that pass are looked at again:
    their runs are summed up once more, for bounds and ends, and stretches are
    compared place by place. Runs start narrow and are widened for queries
    that a longer one could serve.
    """

    def __init__(self, text: str, index: Index) -> None:
        self.ids, self.index = word_trigrams(text), index
        order = _in_order(self.ids)
        own = self.ids[order]
        begins = np.append(True, own[1:] != own[:-1])[: len(own)]
        #: For each place the last place before it with the same trigram, or -1.
        self.last = np.full(len(own), -1)
        self.last[order[1:][~begins[1:]]] = order[:-1][~begins[1:]]
        #: And the first after it, or the text's length. A stretch needs not reach it: without its first place it holds the same.
        self.next = np.full(len(own), len(own))
        self.next[order[:-1][~begins[1:]]] = order[1:][~begins[1:]]
        self.number = np.zeros(len(own), np.int64)
        self.number[order] = np.cumsum(begins) - 1
        self.distinct = int(begins.sum())
        self.values, self.owners = index.met(own[begins])
        #: Distinct trigrams of each query that the whole text holds.
        self.held = np.bincount(self.owners, minlength=len(index.size))

    def _missed(self, queries: np.ndarray) -> np.ndarray:
        """[place, query]: -1 where the trigram is none of the query's, else 0; places fill whole coarse blocks."""
        row = np.full(len(self.index.size), -1)
        row[queries] = np.arange(len(queries))
        row = row[self.owners]
        has = np.full((self.distinct + 1, len(queries)), -1, np.float32)
        has[self.values[row >= 0], row[row >= 0]] = 0
        has[-1] = 0
        number = np.full(-(-len(self.ids) // COARSE) * COARSE, self.distinct)
        number[: len(self.ids)] = self.number
        return np.take(has, number, 0, mode="clip")

    def _fresh(self, k: int, block: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(new, total, longer) by runs of at most ``wide`` of ``k`` blocks, the same for all queries.

        new is [block, blocks before, place]: 1 where the place's trigram
        stands for the first time since that block; total is [first block,
        blocks after] the distinct trigrams of the run, less than nothing
        where no stretch needs to end; longer says which first blocks
        stretches may leave for more than ``wide`` blocks.
        """
        since = np.zeros(k * block, np.int64)
        since[: len(self.ids)] = np.minimum(np.arange(len(self.ids)) // block - self.last // block, wide)
        new = since.astype(np.uint8 if wide < 256 else np.int32).reshape(k, 1, block) > np.arange(wide, dtype=np.uint8 if wide < 256 else np.int32)[:, None]
        counts = np.bincount(np.repeat(np.arange(k) * (wide + 1), block) + since, minlength=k * (wide + 1)).reshape(k, wide + 1)
        fresh = counts[:, :0:-1].cumsum(1)[:, ::-1]
        end = np.arange(k)[:, None] + np.arange(wide)
        total = fresh[np.minimum(end, k - 1), np.arange(wide)].cumsum(1).astype(np.float32)
        # a stretch ends before its first trigram stands again
        upto = np.zeros(k * block, np.int64)
        upto[: len(self.ids)] = self.next
        upto = upto.reshape(k, block).max(1)
        total[end * block >= upto[:, None]] = -np.inf
        return new.astype(np.float32), total, upto > (np.arange(k) + wide) * block

    def _reach(self, missed: np.ndarray, n: np.ndarray, held: np.ndarray, floor: np.ndarray, block: int, wide: int) -> tuple[np.ndarray, ...]:
        """(reach, after, found, total): [first block, query] where a run of at most ``wide`` blocks, or a longer one (after), may reach the floor."""
        k, of = len(missed) // block, missed.shape[1]
        new, total, beyond = self._fresh(k, block, wide)
        found = np.matmul(new, missed.reshape(k, block, of))
        less, top, here, inside = np.zeros((k, of), np.float32), np.full((k, of), -np.inf, np.float32), np.empty((k, of), np.float32), [np.zeros((k + 1, of), np.float32)] * 2
        for e in range(wide):
            m = k - e
            less, here = less[:m], here[:m]
            less += found[e:, e]
            np.add(less, total[:m, e, None], out=here)
            here += inside[0][1 : m + 1]
            np.maximum(top[:m], here, out=top[:m])
            inside = [inside[1], less * floor]
        least = floor * n * (1 - ROUNDING) - 1e-3
        after = np.zeros((k, of), bool)
        if beyond.any():
            last = np.flatnonzero(beyond)
            after[last] = held + inside[0][last + 1] >= least
        return (top >= least) | after, after, found, total

    def _pairs(self, missed: np.ndarray, n: np.ndarray, held: np.ndarray, floor: np.ndarray, wide: int, widest: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, first block, bound, upto, whole, longer) of the pairs that the bound of runs of at most ``wide`` blocks lets reach the floor.

        Queries that a longer run could serve are left to twice the width,
        unless that is more than ``widest``. upto is the farthest block after the first in which such a stretch may
        end, or -1; whole the share of the pair's best run, which is a stretch
        itself; longer says whether a stretch beyond all runs may reach it.
        """
        reach, after, found, total = self._reach(missed, n, held, floor, BLOCK, wide)
        k = len(reach)
        if wide < widest and after.any():
            more = after.any(0)
            yield from ((np.flatnonzero(more)[q], *rest) for q, *rest in self._pairs(missed[:, more], n[more], held[more], floor[more], min(2 * wide, widest), widest))
            reach[:, more] = False
        q, first = np.nonzero(reach.T)
        step = max(1, CELLS // 32 // wide)
        for x in range(0, len(q), step):
            i, a = q[x : x + step, None], first[x : x + step, None]
            at, e = a + np.arange(wide + 1), np.arange(wide)
            runs = [np.cumsum(np.where(to < k, found[np.minimum(to, k - 1), e, i], 0), 1, np.float32) for to in (at[:, :-1], at[:, 1:])]
            # others of the run, and of what lies strictly inside it; the last column is that of longer runs
            others, strict = -runs[0], np.concatenate((np.zeros((len(a), 2), np.float32), -runs[1]), 1)
            shared, size, far = total[a[:, 0]] - others, n[i], after[a[:, 0], i[:, 0]]
            bound = shared / (size + strict[:, :wide])
            upto = np.where(bound >= floor[i] * (1 - ROUNDING), e, -1).max(1)
            beyond = np.where(far, held[i[:, 0]] / (size[:, 0] + strict[:, wide]), 0)
            yield i[:, 0], a[:, 0], np.maximum(bound.max(1), beyond), upto, (shared / (size + others)).max(1), far

    def _slices(self, queries: np.ndarray, floor: np.ndarray) -> Iterator[tuple]:
        """(queries, sizes, floors, misses, blocks of the widest runs, pairs) of as many queries at once as ``CELLS`` lets."""
        k = -(-len(self.ids) // COARSE) * COARSE // BLOCK
        widest = min(k, max(2, min(WIDE, 4 * CELLS // max(1, len(self.ids)))))
        step = max(1, CELLS // max(1, k * BLOCK))
        for x in range(0, len(queries) if k else 0, step):
            own, least = queries[x : x + step], np.maximum(floor[x : x + step] * (1 - ROUNDING) - 1e-9, 1e-12).astype(np.float32)
            n, held, missed, wide = np.maximum(self.index.size[own], 1).astype(np.float32), self.held[own].astype(np.float32), self._missed(own), min(widest, NARROW)
            # coarse blocks leave most queries out
            may = np.flatnonzero(self._reach(missed, n, held, least, COARSE, min(max(1, wide * BLOCK // COARSE + 1), k * BLOCK // COARSE))[0].any(0))
            if not len(may):
                continue
            own, below, least, n, held, missed = own[may], floor[x : x + step][may], least[may], n[may], held[may], missed[:, may]
            pairs = [np.concatenate(y) for y in zip(*self._pairs(missed, n, held, least, wide, widest), strict=True)]
            if pairs and len(pairs[0]):
                yield own, self.index.size[own], below, missed, widest, pairs

    def runs(self, queries: np.ndarray, floor: np.ndarray) -> Iterator[tuple]:
        """(query, its floor, bounds by first block, share of its best run of blocks, farthest blocks) for each query that a bound lets reach its floor.

        The share of a run is a lower bound, since runs of blocks are stretches themselves.
        """
        for own, _, least, _, _, (q, _, bound, upto, whole, _) in self._slices(queries, floor):
            order = np.argsort(q, kind="stable")
            alive, begins = np.unique(q[order], return_index=True)
            for i, at in zip(alive.tolist(), np.split(order, begins[1:]), strict=True):
                yield int(own[i]), float(least[i]), bound[at] * (1.0 + ROUNDING), float(whole[at].max()) * (1.0 - ROUNDING), upto[at]

    def shares(self, queries: np.ndarray) -> np.ndarray:
        """The share of each query's best run of ``NARROW`` blocks at most: a lower bound of its best stretch, at the cost of a few sums a run."""
        k = -(-len(self.ids) // COARSE) * COARSE // BLOCK
        out = np.zeros(len(queries))
        if not k:
            return out
        new, total, _ = self._fresh(k, BLOCK, min(k, NARROW))
        step = max(1, CELLS // (k * BLOCK))
        for x in range(0, len(queries), step):
            own = queries[x : x + step]
            n, top = np.maximum(self.index.size[own], 1).astype(np.float32), np.zeros(len(own), np.float32)
            found = np.matmul(new, self._missed(own).reshape(k, BLOCK, len(own)))
            less = np.zeros((k, len(own)), np.float32)
            for e in range(new.shape[1]):
                less = less[: k - e]
                less += found[e:, e]
                share = less + total[: k - e, e, None]
                share /= n - less
                np.maximum(top, share.max(0), out=top)
            out[x : x + step] = top * (1.0 - ROUNDING)
        return out

    def best(self, queries: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, float]]:
        """(query, largest share) of those of ``queries`` whose share is ``floor`` or more."""
        for own, n, least, missed, widest, (q, first, bound, upto, whole, longer) in self._slices(queries, floor):
            alive, q = np.unique(q, return_inverse=True)
            own, n, least, bound = own[alive], n[alive], least[alive], bound * (1.0 + ROUNDING)
            hit = np.ascontiguousarray(missed[: len(self.ids), alive].T) == 0
            share = np.zeros(len(alive))
            np.maximum.at(share, q, whole.astype(np.float64) * (1 - ROUNDING))
            order = np.argsort(-bound, kind="stable")
            for x in range(0, len(order), PAIRS):
                at = order[x : x + PAIRS]
                at = at[bound[at] > share[q[at]]]
                place = first[at, None] * BLOCK + np.arange(BLOCK)
                inside = place < len(self.ids)
                place = np.minimum(place, len(self.ids) - 1)
                # a stretch is better with the trigram of the query before it, unless it holds that already
                begin = inside & hit[q[at, None], place] & ~((place > 0) & hit[q[at, None], place - 1] & (self.next[place - 1] >= self.next[place]))
                pair, offset = np.nonzero(begin & (upto[at] >= 0)[:, None])
                starts, pair = place[pair, offset], at[pair]
                width = np.minimum((first[pair] + upto[pair] + 1) * BLOCK, self.next[starts]) - starts
                self._placed(q[pair], starts, bound[pair], width, hit, n, share)
                for j in np.flatnonzero(longer[at]).tolist():
                    i, a = q[at[j]], int(first[at[j]]) * BLOCK
                    starts = place[j, begin[j]]
                    if len(starts := starts[self.next[starts] > a + BLOCK * widest]) and bound[at[j]] > share[i]:
                        share[i] = self._from(starts, hit[i], int(n[i]), share[i])
            for i in np.flatnonzero((share >= least - 1e-9) & (share > 0)).tolist():
                yield int(own[i]), float(share[i])

    def _placed(self, q: np.ndarray, starts: np.ndarray, top: np.ndarray, width: np.ndarray, hit: np.ndarray, n: np.ndarray, share: np.ndarray) -> None:
        """Raises ``share`` of each query to that of its best stretch of ``width`` at most from ``starts``, which come by descending bound."""
        if not len(q):
            return
        most = int(width.max())
        hit = np.pad(hit, ((0, 0), (0, most)))
        last = np.pad(self.last.astype(np.int32), (0, most), constant_values=len(self.ids) + most)
        rows = max(1, min(ROWS, CELLS // 8 // most))
        for x in range(0, len(q), rows):
            at = np.arange(x, min(x + rows, len(q)))
            at = at[top[at] > share[q[at]]]
            if not len(at):
                continue
            w, who = int(width[at].max()), q[at]
            new = sliding_window_view(last, w)[starts[at]] < starts[at][:, None]
            shared = np.cumsum(sliding_window_view(hit, w, 1)[who, starts[at]] & new, 1, np.int32)
            over = np.cumsum(new, 1, np.int32)
            over -= shared
            over += n[who].astype(np.int32)[:, None]
            np.maximum.at(share, who, (shared / over).max(1))

    def _from(self, starts: np.ndarray, hit: np.ndarray, n: int, best: float) -> float:
        """The largest share of stretches of any length that begin at ``starts``, or ``best``.

        Only places whose trigram is new since one of the starts can end one
        or change its share, and they are no more than there are distinct
        trigrams and places from the first start to the last.
        """
        begin = int(starts[0])
        ends = begin + np.flatnonzero(self.last[begin:] < starts[-1])
        new = (self.last[ends] < starts[:, None]) & (ends >= starts[:, None])
        shared = np.cumsum(new & hit[ends], 1, np.int32)
        over = np.cumsum(new, 1, np.int32) - shared + n
        return max(best, float((shared / over).max()))


def best_extent(want: np.ndarray, text: str, least: float = 0.0) -> float:
    """The largest share of one query's distinct word trigrams in a text; 0 if it is under ``least``."""
    found = list(Extents(text, Index([want])).best(np.zeros(1, np.int64), np.array([max(least, 1e-9)]))) if len(want) else []
    return found[0][1] if found else 0.0
