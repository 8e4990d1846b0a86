"""Periodic runs of words by recompression.

The words of a batch of texts become integers in one row, each text followed by
a symbol of its own. Recompression names blocks of equal neighbours and then, by
a hashed two-sided partition of the symbols, pairs of neighbours, in turn, until
no text changes: a run-length grammar in which equal stretches are compressed
alike except near their ends. The longest common extension of two places climbs
while both stand at the edge of a parent, compares and steps otherwise, and after
the first difference goes down to the words: a few steps a level. The same levels
read backwards answer extensions to the left.

A run of period p holds two equal words p apart at a multiple of p (of 12 - p
below 6), next to another such pair. Those places of the harmonic grid are the
candidates; their extensions to both sides give every run exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words, and at least twice its period.
LEAST = 12
#: Words of a batch of texts (a longer text is a batch of its own), and grid places looked at together.
BATCH_WORDS, GRID = 1 << 18, 1 << 21

RUN = "struct<start:bigint,length:bigint,period:bigint>"


@dataclass
class Level:
    """One level: its symbols, how many of its own symbols the block at each still has from there on
    (1 outside block levels), the parent of each symbol, and the first symbol of each symbol one level below."""
    sym: np.ndarray
    rest: np.ndarray
    parent: np.ndarray | None
    child: np.ndarray | None


def grammar(sym: np.ndarray, marks: int) -> list[Level]:
    """The levels over ``sym``. Its largest ``marks`` numbers occur once each and are never merged.

    The numbers of a level are the ranks of its symbols, the marks' again the largest.
    """
    levels: list[Level] = []
    child, salt = None, 0

    def compress(starts, rest, second):
        """One level up: ``starts`` marks the first symbols of the parents, ``second`` tells apart parents with the same one."""
        nonlocal sym, child
        parent, first = np.cumsum(starts) - 1, np.flatnonzero(starts)
        levels.append(Level(sym, rest, parent, child))
        _, named = np.unique(sym[first] * (int(second.max()) + 1) + second, return_inverse=True)  # in the order of the first symbols: marks stay last
        sym, child = named.astype(np.int64), first

    while True:
        n = len(sym)
        starts = np.ones(n, bool)
        starts[1:] = sym[1:] != sym[:-1]
        if not starts.all():
            first = np.flatnonzero(starts)
            size = np.diff(np.append(first, n))
            compress(starts, np.repeat(first + size, size) - np.arange(n), size)
        free = sym <= int(sym.max()) - marks
        if not (free[:-1] & free[1:]).any():
            break
        n = len(sym)
        left = ((sym.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(1) == 0
        salt += 1
        joined = np.zeros(n, bool)  # with the symbol before
        joined[1:] = left[:-1] & ~left[1:] & free[:-1] & free[1:]
        if joined.any():
            first = np.flatnonzero(~joined)
            after = np.minimum(first + 1, n - 1)
            compress(~joined, np.ones(n, np.int64), np.where(joined[after] & (after > first), sym[after] + 1, 0))
    levels.append(Level(sym, np.ones(len(sym), np.int64), None, child))
    return levels


def backwards(levels: list[Level]) -> list[Level]:
    """The same grammar read from the right."""
    out, below = [], 0
    for k, v in enumerate(levels):
        n, child, parent, rest = len(v.sym), None, None, v.rest
        if v.child is not None:
            last = np.append(v.child[1:], below) - 1
            child = below - 1 - last[::-1]
        if v.parent is not None:
            parent = v.parent[-1] - v.parent[::-1]
            if v.rest.max() > 1:  # a block level
                rest = (np.arange(n) - levels[k + 1].child[v.parent] + 1)[::-1]
        out.append(Level(v.sym[::-1], rest, parent, child))
        below = n
    return out


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from ``a`` and from ``b`` on are equal, for each pair of different places."""
    u, v, done = a.astype(np.int64), b.astype(np.int64), np.full(len(a), -1)
    climbing = np.arange(len(a))
    for k, level in enumerate(levels):
        todo, climbed = climbing, []
        while len(todo):
            x, y = u[todo], v[todo]
            if level.parent is not None:
                first = levels[k + 1].child
                up = (first[level.parent[x]] == x) & (first[level.parent[y]] == y)
                climbed.append(todo[up])
                todo, x, y = todo[~up], x[~up], y[~up]
            same = level.sym[x] == level.sym[y]
            done[todo[~same]] = k
            todo, x, y = todo[same], x[same], y[same]
            step = np.minimum(level.rest[x], level.rest[y])
            u[todo] += step
            v[todo] += step
        climbing = np.concatenate(climbed) if climbed else climbing[:0]
        if level.parent is not None:
            u[climbing], v[climbing] = level.parent[u[climbing]], level.parent[v[climbing]]
    for k in range(len(levels) - 1, 0, -1):
        falling = np.flatnonzero(done >= k)
        u[falling], v[falling] = levels[k].child[u[falling]], levels[k].child[v[falling]]
        level, todo = levels[k - 1], falling
        while len(todo):
            x, y = u[todo], v[todo]
            same = level.sym[x] == level.sym[y]
            todo, x, y = todo[same], x[same], y[same]
            step = np.minimum(level.rest[x], level.rest[y])
            u[todo] += step
            v[todo] += step
    return u - a


def _candidates(sym: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """Blocks of (place, period): the places of the grid whose word, and a neighbour's, recur a period later."""
    most = np.where(size < LEAST, 0, size // 2)
    doc = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.where(period < LEAST // 2, LEAST - period, period)
    places = -(-np.maximum(size[doc] - period, 0) // step)
    upto = np.cumsum(places)
    cut = 0
    while cut < len(doc):
        before = upto[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(upto, before + GRID, side="right")))
        n = places[cut:end]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[cut:end], n)
        i = np.repeat(begin[doc[cut:end]], n) + nth * np.repeat(step[cut:end], n)
        hit = np.flatnonzero(sym[i] == sym[i + p])
        i, p = i[hit], p[hit]
        near = (sym[i + 1] == sym[i + p + 1]) | (sym[i - 1] == sym[i + p - 1])
        yield i[near], p[near]
        cut = end


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of word numbers its runs: rows of (start, length, period) by start, then period."""
    size = np.array([len(t) for t in texts], np.int64)
    marks, top = len(texts) + 1, max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    row = [np.array([top], np.int64)]
    for k, t in enumerate(texts):
        row += [t, np.array([top + k + 1], np.int64)]
    sym = np.concatenate(row)
    _, sym = np.unique(sym, return_inverse=True)
    sym = sym.astype(np.int64)
    begin = np.cumsum(size + 1) - size
    found = [(i, p) for i, p in _candidates(sym, begin, size) if len(i)]
    if not found:
        return [np.zeros((0, 3), np.int64) for _ in texts]
    right = grammar(sym, marks)
    left, n = backwards(right), len(sym)
    rows = []
    for i, p in found:
        ahead = extensions(right, i, i + p)
        back = extensions(left, n - i, n - i - p)
        ok = ahead + back >= np.maximum(LEAST - p, p)
        i, p, ahead, back = i[ok], p[ok], ahead[ok], back[ok]
        rows.append(np.unique(np.stack([i - back, ahead + back + p, p], 1), axis=0))
    runs = np.unique(np.concatenate(rows), axis=0)
    # a stretch is found once for each multiple of its period that fits twice: the least one comes first
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    at = np.searchsorted(runs[:, 0], begin)
    end = np.append(at[1:], len(runs))
    return [runs[a:b] - np.array([s, 0, 0]) for a, b, s in zip(at, end, begin)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """A mask of the words outside every run, and of each run's first ``period`` words that no other run drops."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    known: dict[bytes, int] = {}
    return [np.fromiter((known.setdefault(w, len(known)) for w in t), np.int64, len(t)) for t in texts]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of start, length, period), collapsed (text).

    Words are runs of anything but the six ASCII white-space characters; null and
    empty texts have none. ``runs`` holds every maximal stretch of at least 12 words
    and two periods, with its smallest period, by start and then period. ``collapsed``
    joins the words that no run repeats with one space. A text is read whole, however
    long; rows are independent, so repeated rows and ids give repeated results. Null ids
    stay; other columns are ignored. An empty table gives an empty result.
    """
    def run(batches):
        import pyarrow as pa

        def answer(ids, words):
            out = runs_of(_numbered(words))
            runs = [[{"start": a, "length": b, "period": c} for a, b, c in r.tolist()] for r in out]
            text = [b" ".join(w) if not len(r) else b" ".join([x for x, k in zip(w, kept_words(len(w), r).tolist()) if k]) for w, r in zip(words, out)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array([len(w) for w in words], pa.int64()), pa.array(runs, kind), pa.array([t.decode() for t in text], pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

        ids, words, n = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                w = (batch.column(1)[k].as_py() or "").encode().split()
                if words and n + len(w) > BATCH_WORDS:
                    yield answer(ids, words)
                    ids, words, n = [], [], 0
                ids.append(batch.column(0).slice(k, 1))
                words.append(w)
                n += len(w)
        if words:
            yield answer(ids, words)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
