"""Posting lists of vectors: a bounded fit, an exact search of the lists, and blocked joins inside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.session import hashed_share

#: Rows per list on average, and the most centroids (64 floats each: at most 16 MB are sent to the tasks). Where so
#: many lists would be longer than a block, a second level divides every list by the nearest of up to MOST_PARTS residuals, the same for all lists.
LIST_ROWS, MOST_LISTS, MOST_PARTS = 128, 65_536, 4096
#: Rows the index is fitted on: at least so many, four for each list, and never more than MOST_SAMPLE. All rows are indexed.
SAMPLE, MOST_SAMPLE = 65_536, 262_144
#: Sample rows against which the density of all sample rows is counted.
DENSITY_ROWS = 16_384
#: Targets of one block; a longer list is divided into shards that every query of the list visits.
BLOCK_ROWS = 4096
#: Leaders are at most so similar to one another.
SPREAD = 0.6
#: Lists beyond which a vector is stored in and searches one list more for every fourfold number of them.
FIRST_LISTS = 4096
#: Centroids in a group whose maximum tells whether it is looked at.
GROUP = 64


def valid_vectors(rows: DataFrame, row_id: str, vector: str, dim: int) -> DataFrame:
    """(id, vec, k1, k2) of the rows whose vector has dim finite elements, not all zero; k1, k2 name equal vectors.

    Null ids, null vectors, null elements, NaN and infinity are left out.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    rows = rows.filter("id IS NOT NULL AND vec IS NOT NULL").filter(F.size("vec") == dim)
    rows = rows.filter(F.coalesce(F.forall("vec", finite), F.lit(False)) & F.exists("vec", lambda x: x != 0))
    return rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.hash("vec")})


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, computed in double."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@dataclass
class Centroids:
    """Unit centroids, the shards of each list, and residuals that divide lists."""

    points: np.ndarray
    shards: np.ndarray
    parts: np.ndarray

    def more(self) -> int:
        """Lists a vector is stored in and searches beyond those of an index of FIRST_LISTS lists."""
        return max(0, int(np.ceil(np.log2(max(1, len(self.points) * len(self.parts) / FIRST_LISTS)) / 2)))

    def lists(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """search(), and with a second level the `count` nearest parts of those lists: (list * parts + part, similarity)."""
        near, sims = self.search(x, count)
        many = len(self.parts)
        if many == 1:
            return near, sims
        out_l, out_s = np.empty_like(near), np.empty_like(sims)
        for i in range(0, len(x), 256):
            rest = x[i : i + 256, None, :].astype(np.float32) - self.points[near[i : i + 256]]
            far = np.square(rest).sum(axis=2)[:, :, None] - 2 * (rest @ self.parts.T) + np.square(self.parts).sum(axis=1)
            far[:, 1:][near[i : i + 256, 1:] == near[i : i + 256, :-1]] = 9  # a list that is only repeated
            far = far.reshape(len(far), -1)
            best = _best(-far, count)
            out_l[i : i + 256] = np.take_along_axis(near[i : i + 256], best // many, 1) * many + best % many
            out_s[i : i + 256] = 1 - np.take_along_axis(far, best, 1) / 2
        return out_l, out_s

    def search(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """For unit rows x the lists of the `count` most similar centroids, best first, and the similarities.

        Every row is compared with every centroid. The best of a row stand in the `count` groups of centroids with the
        largest maxima, so only those groups are put in order.
        """
        k, groups = len(self.points), -(-len(self.points) // GROUP)
        points = np.concatenate([self.points, np.zeros((groups * GROUP - k, self.points.shape[1]), dtype=np.float32)])
        out_l, out_s = [np.zeros((0, count), dtype=np.int64)], [np.zeros((0, count), dtype=np.float32)]
        step = max(16, 2**23 // len(points))
        for i in range(0, len(x), step):
            s = x[i : i + step].astype(np.float32) @ points.T
            s[:, k:] = -2
            if groups <= count:
                near = _best(s[:, :k], count)
            else:
                first = np.argpartition(-s.reshape(len(s), GROUP, groups).max(axis=1), count - 1, axis=1)[:, :count]
                near = (first[:, None, :] + groups * np.arange(GROUP)[:, None]).reshape(len(s), -1)
                near = np.take_along_axis(near, _best(np.take_along_axis(s, near, 1), count), 1)
            out_l.append(near)
            out_s.append(np.take_along_axis(s, near, 1))
        return np.concatenate(out_l), np.concatenate(out_s)


def _best(s: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest of each row, largest first; fewer columns: all of them, the last repeated."""
    if s.shape[1] > n:
        cols = np.argpartition(-s, n - 1, axis=1)[:, :n]
    else:
        cols = np.broadcast_to(np.arange(s.shape[1]), s.shape).copy()
    order = np.argsort(-np.take_along_axis(s, cols, 1), axis=1, kind="stable")
    cols = np.take_along_axis(cols, order, 1)
    if cols.shape[1] < n:
        cols = np.concatenate([cols, np.repeat(cols[:, -1:], n - cols.shape[1], axis=1)], axis=1)
    return cols


def _leaders(x: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Rows of x taken in order, each at most SPREAD similar to those taken before it; up to `most`."""
    taken, n, left = np.empty((most, x.shape[1]), dtype=np.float32), 0, []
    for i in range(0, len(order), 1024):
        if n == most:
            break
        at = order[i : i + 1024]
        at = at[(x[at] @ taken[:n].T).max(axis=1, initial=-1) <= SPREAD]
        s = x[at] @ x[at].T > SPREAD
        free = np.ones(len(at), dtype=bool)
        for j in range(len(at)):
            if free[j]:
                free[j + 1 :] &= ~s[j, j + 1 :]
        at = at[free][: most - n]
        taken[n : n + len(at)] = x[at]
        left.append(at)
        n += len(at)
    return np.concatenate(left) if left else np.zeros(0, dtype=np.int64)


def _homes(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ points.T).argmax(axis=1) for i in range(0, len(x), 4096)])


def fit(sample: np.ndarray, rows: int, near: float, balance: bool, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS, most_lists: int = MOST_LISTS) -> Centroids:
    """Centroids for `rows` vectors from a sample.

    Leaders are taken in falling density (sample rows at least `near` similar), each at most SPREAD similar to those
    before it, so that a set of look-alikes gets one list; each moves to the mean of its look-alikes. With balance, a
    list that would hold more than block_rows gets further centroids from among its own sample rows. Without, and
    for what is still longer, the list is divided into shards. Where most_lists lists of a full block do not hold the
    rows, residuals of the sample (row minus its centroid) become a second level, so lists do not grow further.
    """
    x = unit(sample).astype(np.float32) if len(sample) else np.eye(1, 64, dtype=np.float32)
    lists = int(min(most_lists, max(8, -(-rows // list_rows)), len(x)))
    density = np.zeros(len(x), dtype=np.int64)
    some = x[:: max(1, len(x) // DENSITY_ROWS)]
    for i in range(0, len(x), 2048):
        density[i : i + 2048] = np.count_nonzero(x[i : i + 2048] @ some.T >= near, axis=1)
    order = np.argsort(-density, kind="stable")
    leaders = _leaders(x, order, lists)
    spare = order[(density[order] <= 1) & ~np.isin(order, leaders)][: lists - len(leaders)]
    points = x[np.concatenate([leaders, spare])]
    home = _homes(x, points)
    close = np.einsum("ij,ij->i", x, points[home]) >= near - 0.1
    mean = points.copy()
    np.add.at(mean, home[close], x[close])
    points = mean / np.linalg.norm(mean, axis=1, keepdims=True)
    scale = rows / len(x)
    expected = np.bincount(home, minlength=len(points)) * scale
    if balance:
        more = [x[np.flatnonzero(home == k)[: int(expected[k] // (block_rows // 2))]] for k in np.flatnonzero(expected > block_rows)]
        points = np.concatenate([points, *more])[:most_lists]
        home = _homes(x, points)
        expected = np.bincount(home, minlength=len(points)) * scale
    wanted = min(MOST_PARTS, -(-rows // (block_rows * most_lists))) if len(points) >= most_lists else 1
    parts = np.zeros((1, x.shape[1]), dtype=np.float32)
    if wanted > 1:
        rest = x - points[home]
        rest = rest[np.einsum("ij,ij->i", rest, rest) > 1e-6]
        if len(rest) > wanted:
            parts = rest[:: len(rest) // wanted][:wanted]
            for _ in range(2):
                own = np.concatenate([(2 * (rest[i : i + 4096] @ parts.T) - np.square(parts).sum(axis=1)).argmax(axis=1) for i in range(0, len(rest), 4096)])
                sums = np.zeros_like(parts)
                np.add.at(sums, own, rest)
                size = np.bincount(own, minlength=len(parts))[:, None]
                parts = np.where(size > 0, sums / np.maximum(size, 1), parts).astype(np.float32)
    shards = np.maximum(1, np.ceil(expected / len(parts) / block_rows)).astype(np.int64)
    return Centroids(points, shards, parts)


def fit_index(base: DataFrame, near: float, balance: bool, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS, rows: int | None = None) -> Centroids:
    """Fit on a sample of the different vectors in base (see SAMPLE), chosen by a hash, so the same on every run.

    rows: how many rows base has, if known.
    """
    rows = base.count() if rows is None else rows
    wanted = min(MOST_SAMPLE, max(SAMPLE, 4 * min(MOST_LISTS, rows // list_rows)))
    some = base if rows <= wanted else base.filter(hashed_share(["k2", "k1"], wanted / rows))
    found = some.groupBy("k1", "k2").agg(F.first("vec").alias("vec")).toArrow()  # about `wanted` rows at most
    dim = len(found["vec"][0]) if len(found) else 64
    vec = found["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    order = np.lexsort((found["k2"].to_numpy(), found["k1"].to_numpy()))
    return fit(vec[order], rows, near, balance, list_rows, block_rows)


BLOCK_SCHEMA = "lst int, shard int, role int, k1 bigint, k2 int, w bigint, ids array<bigint>, x1 bigint, stored int, lists binary, vec binary"
_ARROW = pa.schema([("lst", pa.int32()), ("shard", pa.int32()), ("role", pa.int32()), ("k1", pa.int64()), ("k2", pa.int32()), ("w", pa.int64()), ("ids", pa.list_(pa.int64())), ("x1", pa.int64()), ("stored", pa.int32()), ("lists", pa.binary()), ("vec", pa.binary())])


def _floats(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _rows_as_bytes(x: np.ndarray) -> pa.Array:
    step = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * step).tobytes()), pa.py_buffer(x.tobytes())])


def post(base: DataFrame, index: Centroids, replicas: int, probes: int, replica_ratio: float, probe_ratio: float, extra: str | None = None, held_ids: int = 1) -> DataFrame:
    """Rows of BLOCK_SCHEMA: every different vector of a batch in the lists it is stored in or searches.

    role 0: stored in the list and searches it; 1: searches it. A vector is stored in its nearest list and, up to
    `replicas`, in those whose centroid is no further than replica_ratio times the nearest; it searches up to `probes`
    lists within probe_ratio. lists holds its lists, nearest first, of which it is stored in the first `stored`. Copies in a
    batch become one row with their number w and their held_ids smallest ids.
    extra: a column of base that goes along as x1. Distances are those between unit vectors.
    """
    sent = base.sparkSession.sparkContext.broadcast(index)
    replicas, probes = replicas + index.more(), probes + index.more()

    def assign(batches):
        ix: Centroids = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            vec, k1, k2, ids = _floats(batch.column(batch.schema.get_field_index("vec"))), get("k1"), get("k2"), get("id")
            x1 = get("x1") if extra else np.zeros(len(ids), dtype=np.int64)
            order = np.lexsort((ids, k2, k1))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
            starts = np.flatnonzero(new)
            w = np.diff(np.append(starts, len(order)))
            rep = order[starts]
            lists, sims = ix.lists(unit(vec[rep]), max(replicas, probes))
            dist = np.sqrt(np.maximum(2 - 2 * sims, 1e-6))
            rank = np.arange(lists.shape[1])
            fresh = np.concatenate([np.ones((len(rep), 1), dtype=bool), lists[:, 1:] != lists[:, :-1]], axis=1)
            store = fresh & ((rank == 0) | ((rank < replicas) & (dist <= replica_ratio * dist[:, :1])))
            probe = fresh & ((rank == 0) | ((rank < probes) & (dist <= probe_ratio * dist[:, :1])))
            at, col = np.nonzero(store | probe)
            lst, stored = lists[at, col], store[at, col]
            s = ix.shards[lst // len(ix.parts)]
            own = np.mod(k1[rep[at]], s)
            again = np.repeat(np.arange(len(at)), s)
            shard = np.arange(len(again)) - np.repeat(np.cumsum(s) - s, s)
            role = np.where(stored[again] & (shard == own[again]), 0, 1)
            keep = (role == 0) | probe[at, col][again]
            again, shard, role = again[keep], shard[keep], role[keep]
            at, lst = at[again], lst[again]
            r = rep[at]
            held = np.minimum(w[at], held_ids)
            offsets = np.concatenate([[0], np.cumsum(held)])
            inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], held) + np.repeat(starts[at], held)
            data = np.ascontiguousarray(vec[r], dtype=np.float32)
            ways = np.ascontiguousarray(lists[at], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lst, pa.int32()), pa.array(shard, pa.int32()), pa.array(role, pa.int32()), pa.array(k1[r], pa.int64()), pa.array(k2[r], pa.int32()), pa.array(w[at], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[order[inner]], pa.int64())), pa.array(x1[r], pa.int64()),
                    pa.array(store.sum(axis=1)[at], pa.int32()), _rows_as_bytes(ways), _rows_as_bytes(data),
                ],
                schema=_ARROW,
            )

    columns = ["id", "vec", "k1", "k2"] + ([F.col(extra).cast("bigint").alias("x1")] if extra else [])
    return base.select(*columns).mapInArrow(assign, BLOCK_SCHEMA)


@dataclass
class Block:
    """Different vectors of a block; ids as a ragged array."""

    k1: np.ndarray
    k2: np.ndarray
    w: np.ndarray
    x1: np.ndarray
    ids: list[np.ndarray]
    raw: np.ndarray
    role: np.ndarray
    stored: np.ndarray
    lists: np.ndarray

    def __post_init__(self):
        self.u64 = unit(self.raw)
        self.u32 = self.u64.astype(np.float32)

    def part(self, where: np.ndarray) -> "Block":
        return Block(self.k1[where], self.k2[where], self.w[where], self.x1[where], [self.ids[i] for i in where], self.raw[where], self.role[where], self.stored[where], self.lists[where])


def _block(pieces: list[tuple], held_ids: int) -> Block:
    """Join pieces of sorted rows and collapse rows of the same vector, adding w and joining ids."""
    k1, k2, w, x1, raw, role, stored, lists = (np.concatenate([p[i] for p in pieces]) for i in (0, 1, 2, 3, 5, 6, 7, 8))
    ids = [x for p in pieces for x in p[4]]
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
    starts = np.flatnonzero(new)
    if len(starts) == len(order):
        return Block(k1[order], k2[order], w[order], x1[order], [ids[i] for i in order], raw[order], role[order], stored[order], lists[order])
    ends = np.append(starts[1:], len(order))
    first = order[starts]
    joined = [ids[order[a]] if b - a == 1 else np.sort(np.concatenate([ids[j] for j in order[a:b]]))[:held_ids] for a, b in zip(starts, ends)]
    return Block(k1[first], k2[first], np.add.reduceat(w[order], starts), x1[first], joined, raw[first], role[first], stored[first], lists[first])


def met_before(q: Block, t: Block, at: np.ndarray, to: np.ndarray, lst: int) -> np.ndarray:
    """For the pairs q[at], t[to] of a block of list lst: whether an earlier list of the query also stores the target."""
    place = (q.lists == lst).argmax(axis=1)[at]
    out = np.zeros(len(at), dtype=bool)
    for i in range(q.lists.shape[1]):
        here = np.flatnonzero(place > i)
        if not len(here):
            break
        a, b = at[here], to[here]
        same = (t.lists[b] == q.lists[a, i][:, None]) & (np.arange(t.lists.shape[1])[None, :] < t.stored[b][:, None])
        out[here] |= same.any(axis=1)
    return out


def block_join(posted: DataFrame, work: Callable[[Block, Block, int], list[np.ndarray] | None], schema: str, arrow: pa.Schema, held_ids: int = 0) -> DataFrame:
    """Apply work(targets, queries, list) to every block; the targets, which search their own list too, come as queries first.

    One shuffle by (list, shard); a task sees its blocks sorted, holds the targets of one block (bounded by the
    shards) and meets the queries batch by batch. held_ids: ids of copies that work() sees; 0: the smallest only.
    """

    def rows(batch: pa.RecordBatch, a: int, b: int) -> tuple:
        part = batch.slice(a, b - a)
        k1, k2, w, x1, role = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "w", "x1", "role"))
        vec = part.column(part.schema.get_field_index("vec"))
        raw = np.frombuffer(b"".join(vec.to_pylist()), dtype=np.float32).reshape(len(vec), -1)
        if held_ids:
            held = part.column(part.schema.get_field_index("ids"))
            ids = np.split(held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())[:-1])
        else:
            held = part.column(part.schema.get_field_index("ids"))
            lengths = held.value_lengths().to_numpy()
            first = held.flatten().to_numpy()[np.cumsum(lengths) - lengths]
            ids = list(first[:, None])
        ways = np.frombuffer(b"".join(part.column(part.schema.get_field_index("lists")).to_pylist()), dtype=np.int32).reshape(len(vec), -1)
        return k1, k2, w, x1, ids, raw, role, part.column(part.schema.get_field_index("stored")).to_numpy(), ways

    def run(batches: Iterator[pa.RecordBatch]):
        now, held, targets, last = None, [], None, None

        def done(q: Block):
            made = []
            for i in range(0, len(q.k1), 1024):
                part = q if len(q.k1) <= 1024 else q.part(np.arange(i, min(i + 1024, len(q.k1))))
                out = work(targets, part, int(now[0]))
                if out is not None and len(out[0]):
                    made.append(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow)], schema=arrow))
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(code, axis=0) != 0).any(axis=1)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                here, role = (code[a, 0], code[a, 1]), code[a, 2]
                if here != now:
                    if held:
                        targets = _block(held, max(1, held_ids))
                        yield from done(targets)
                    now, held, targets, last = here, [], None, None
                piece = rows(batch, a, b)
                if role == 0:
                    held.append(piece)
                    continue
                if held:
                    targets, held = _block(held, max(1, held_ids)), []
                    yield from done(targets)
                if targets is None:
                    continue
                q = _block([piece], max(1, held_ids))
                ends = (piece[0][-1], piece[1][-1])
                if last is not None and len(q.k1):
                    other = np.flatnonzero((q.k1 != last[0]) | (q.k2 != last[1]))
                    q = q.part(other) if len(other) < len(q.k1) else q
                last = ends
                if len(q.k1):
                    yield from done(q)
        if held:
            targets = _block(held, max(1, held_ids))
            yield from done(targets)

    return posted.repartition("lst", "shard").sortWithinPartitions("lst", "shard", "role", "k1", "k2").mapInArrow(run, schema)
