"""Limited-memory quasi-Newton fit: value and gradient are summed over partitions, the two-loop recursion runs on the driver.

Parameter sets of up to ``MAX_PARAMETERS`` are one vector on the driver. Larger ones stay in blocks on the executors: the driver sees the inner
products of the gradients only, in which the same recursion is written, and a block of tuples is sent the relations it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import pair_score, sigmoid
from ..operators.counts import dictionary
from ..session import settled, ship, sorted_join
from .factor import tuple_key

#: Parameters at most that are sent to every worker and held by the driver; more are fitted in blocks.
MAX_PARAMETERS = 4_000_000
#: Numbers of a block, of parameters or of cells.
BLOCK = 500_000
#: Cells from which a relation of a block has a product of its own.
BIG = 64
#: Kept errors and relation vectors; sums are made of them in double.
KEPT = np.float32


def minimise(value_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], x0: np.ndarray, memory: int = 4, rounds: int = 50, tolerance: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """[M3, M22] Minimum of a smooth function; each point is evaluated once. Backtracks until the value has fallen enough; forgets its memory where
    curvature isn't positive; ends when the value or the gradient hardly changes."""
    x = x0.astype(float).copy()
    value, grad = value_gradient(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    values = [value]
    for _ in range(rounds):
        if np.linalg.norm(grad) <= tolerance * max(1.0, np.linalg.norm(x)):
            break
        d, alphas = -grad.copy(), []
        for s, y in reversed(steps):
            a = s @ d / (y @ s)
            alphas.append(a)
            d -= a * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(alphas)):
            d += s * (a - (y @ d) / (y @ s))
        slope = grad @ d
        if slope >= 0:
            d, slope, steps = -grad, -(grad @ grad), []
        t = 1.0 if steps else min(1.0, 1.0 / max(1e-12, np.abs(grad).sum()))
        while True:
            new_value, new_grad = value_gradient(x + t * d)
            if new_value <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t *= 0.5
        s, y = t * d, new_grad - grad
        steps = [*steps, (s, y)][-memory:] if s @ y > 1e-12 else []
        done = abs(value - new_value) <= tolerance * max(1.0, abs(value))
        x, value, grad = x + s, new_value, new_grad
        values.append(value)
        if done:
            break
    return x, values


def logistic_factors(cells: DataFrame, n_rel: int, n_tup: int, components: int, l2: float = 0.01, seed: int = 0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """[M3, M21, A24] Fits bias[rel] + rel . tup to cells (rel INT, tup INT, target DOUBLE); returns biases, both factor matrices and the values.

    Each evaluation is one job: the parameters are broadcast, every partition sums its own gradient, and the partial sums are added up eight at
    a time by tasks until eight at most are left, which the driver adds.
    """
    size = n_rel + (n_rel + n_tup) * components
    if size > MAX_PARAMETERS:
        raise ValueError(f"{size} parameters are more than {MAX_PARAMETERS}; train with factor.fit_pointwise")
    sc = cells.sparkSession.sparkContext
    parts_of_cells = cells.rdd.getNumPartitions()
    rng = np.random.default_rng(seed)
    x0 = np.concatenate([np.zeros(n_rel), rng.normal(0, 0.1, (n_rel + n_tup) * components)])

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return x[:n_rel], x[n_rel : n_rel + n_rel * components].reshape(n_rel, components), x[n_rel + n_rel * components :].reshape(n_tup, components)

    def value_gradient(x: np.ndarray) -> tuple[float, np.ndarray]:
        sent = sc.broadcast(x)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b, r, t = parts(sent.value)
            total, gb, gr, gt = 0.0, np.zeros_like(b), np.zeros_like(r), np.zeros_like(t)
            for p in batches:
                i, j, y = p["rel"].to_numpy(), p["tup"].to_numpy(), p["target"].to_numpy()
                z = b[i] + (r[i] * t[j]).sum(1)
                total += float((np.logaddexp(0, z) - y * z).sum())
                g = 1 / (1 + np.exp(-z)) - y
                np.add.at(gb, i, g)
                np.add.at(gr, i, g[:, None] * t[j])
                np.add.at(gt, j, g[:, None] * r[i])
            yield pd.DataFrame({"v": [total], "g": [np.concatenate([gb, gr.ravel(), gt.ravel()]).tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, g = 0.0, None
            for p in batches:
                total += float(p["v"].sum())
                for part in p["g"]:
                    own = np.frombuffer(bytes(part))
                    g = own if g is None else g + own
            if g is not None:
                yield pd.DataFrame({"v": [total], "g": [g.tobytes()]})

        value, grad = 0.5 * l2 * float(x @ x), l2 * x
        sums = cells.select("rel", "tup", "target").mapInPandas(run, "v double, g binary")
        n = parts_of_cells
        while n > 8:
            n = -(-n // 8)
            sums = sums.repartition(n).mapInPandas(add, "v double, g binary")
        for row in sums.toLocalIterator():
            value += row["v"]
            grad = grad + np.frombuffer(bytes(row["g"]))
        sent.unpersist()
        return value, grad

    x, values = minimise(value_gradient, x0, rounds=rounds)
    return *parts(x), values


def _block_of(key: int) -> int:
    """The partition of a block; one function for all tables of blocks, as Spark tells partitionings apart by it."""
    return key


def _normal(seed: int, ids: np.ndarray, width: int) -> np.ndarray:
    """Normal numbers of deviation 0.1 by the hash of seed, id and place, whatever block the id is in."""

    def uniform(salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = (ids.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((2 * seed + salt) * 0xD1B54A32D192ED03 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53

    return 0.1 * np.sqrt(-2 * np.log1p(-uniform(0))) * np.cos(2 * np.pi * uniform(1))


def _basis(points: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows: the steps between the points, the changes of the gradient between them, the last gradient."""
    s = [b[0] - a[0] for a, b in zip(points, points[1:])]
    y = [b[1] - a[1] for a, b in zip(points, points[1:])]
    return np.stack([*s, *y, points[-1][1]])


def _direction(gram: np.ndarray) -> np.ndarray:
    """The two-loop recursion of ``minimise`` in places of the basis: how often each of its rows is in the direction."""
    m = len(gram) // 2
    d, alphas = np.zeros(len(gram)), []
    d[-1] = -1
    for i in reversed(range(m)):
        a = gram[i] @ d / gram[m + i, i]
        alphas.append(a)
        d[m + i] -= a
    if m:
        d *= gram[m - 1, 2 * m - 1] / gram[2 * m - 1, 2 * m - 1]
    for i, a in zip(range(m), reversed(alphas)):
        d[i] += a - gram[m + i] @ d / gram[m + i, i]
    return d


class _Cells:
    """Cells of a block, those of a relation together. First come the relations with many cells, which are worked on as matrices."""

    def __init__(self, rel: np.ndarray, tup: np.ndarray, y: np.ndarray, seed: int, k: int) -> None:
        self.k = k
        rels, i, n = np.unique(rel, return_inverse=True, return_counts=True)
        self.tups, j = np.unique(tup, return_inverse=True)
        rank = np.lexsort((rels, -n))
        self.rels, self.ends, self.big = rels[rank], np.concatenate([[0], np.cumsum(n[rank])]), int((n >= BIG).sum())
        i = np.argsort(rank)[i]
        # the order of the cells doesn't depend on the order in which they came, should the block be made again
        order = np.lexsort((y, j, i))
        self.i, self.j, self.y = i[order].astype(np.int32), j[order].astype(np.int32), y[order]
        self.start = _normal(2 * seed + 1, self.tups, k).astype(KEPT)

    def _slices(self) -> Iterator[tuple[int, slice]]:
        for r in range(self.big):
            yield r, slice(self.ends[r], self.ends[r + 1])

    def to_tuples(self, w: list[np.ndarray], v: np.ndarray) -> np.ndarray:
        """For each tuple the sum over its cells and over the parts: weight of the cell times vector of its relation."""
        one, rest, j = np.empty((self.k, len(self.i))), slice(self.ends[self.big], None), self.j.astype(np.intp)
        for r, s in self._slices():
            one[:, s] = v[:, r].T @ np.array([a[s] for a in w], float)
        i = self.i[rest]
        one[:, rest] = sum(a[rest].astype(float) * b[i].T for a, b in zip(w, v))
        return np.array([np.bincount(j, c, len(self.tups)) for c in one]).T.copy()

    def to_relations(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each relation the sum over its cells: weight of the cell times row ``x`` of the cell, and the sum of the weights."""
        out, rest = np.empty((len(self.rels), self.k)), slice(self.ends[self.big], None)
        for r, s in self._slices():
            out[r] = w[s] @ x[s]
        if self.big < len(self.rels):
            out[self.big :] = np.add.reduceat(w[rest, None] * x[rest], self.ends[self.big : -1] - self.ends[self.big], axis=0)
        return np.hstack([out, np.bincount(self.i, w, len(self.rels))[:, None]])

    def products(self, w: list[np.ndarray], v: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each part the sum over the cells: weight of the cell times its relation's vector times the row of its tuple in ``x``."""
        out, rest = np.zeros(len(w)), slice(self.ends[self.big], None)
        for r, s in self._slices():
            out += ((np.array([a[s] for a in w], float) @ x.take(self.j[s], 0)) * v[:, r]).sum(1)
        i, x = self.i[rest], x.take(self.j[rest], 0)
        return out + np.array([float(a[rest].astype(float) @ (b[i] * x).sum(1)) for a, b in zip(w, v)])

    def scores(self, r: np.ndarray, x: np.ndarray) -> np.ndarray:
        out, rest = np.empty(len(self.i)), slice(self.ends[self.big], None)
        for n, s in self._slices():
            out[s] = x[s] @ r[n, :-1] + r[n, -1]
        i = self.i[rest]
        out[rest] = (r[i, :-1] * x[rest]).sum(1) + r[i, -1]
        return out


class _Apart:
    """Parameters and cells in blocks: block ``q`` of ``n_q`` has the relations of numbers q, q + n_q, ..., and likewise block ``p`` of the tuples,
    together with the cells of its tuples. All tables of one side are partitioned alike, so only relation vectors and their gradients travel.

    No point is kept. All of them, and their gradients, are sums of the start and of the gradients of the data so far, the driver has the weights
    (``points``) and the products of these (``gram``). A gradient of the data is kept as the error of each cell and the vectors its relations had then:
    of a tuple, one number for each cell instead of its whole vector and gradient. Blocks stay in the memory of the executors as far as there is room.

    ``cells`` has (rel, tup, target) and may have ``held``: such cells are for ``predicted`` only, and have a null ``rel`` where it isn't known.
    """

    def __init__(self, cells: DataFrame, n_rel: int, n_tup: int, components: int, l2: float, seed: int, n_cells: int | None = None) -> None:
        self.spark: SparkSession = cells.sparkSession
        self.sc, self.l2, self.k, self.n_rel = self.spark.sparkContext, l2, components, n_rel
        ship(self.spark)
        at_least, k = self.sc.defaultParallelism, components
        n_cells = cells.count() if n_cells is None else n_cells
        # vectors of tuples are there only while a block is worked on
        n_p = self.n_p = max(at_least, -(-n_tup * k // (4 * BLOCK)), -(-n_cells // BLOCK))
        n_q = self.n_q = max(at_least, -(-n_rel * (k + 1) // BLOCK))
        held = F.col("held") if "held" in cells.columns else F.lit(False)

        def cut(batches: Iterator) -> Iterator[pd.DataFrame]:
            """Cells by block of tuples, as arrays."""
            got, n = [], 0

            def out() -> Iterator[pd.DataFrame]:
                columns = [np.concatenate([h[i] for h in got]) for i in range(4)]
                block = columns[1] % n_p
                order = np.lexsort((columns[1], block))
                columns = [c[order] for c in columns]
                ends = np.searchsorted(block[order], np.arange(n_p + 1))
                rows = [(p, *(c[a:b].tobytes() for c in columns)) for p, a, b in zip(range(n_p), ends, ends[1:]) if a < b]
                yield pd.DataFrame(rows, columns=["p", "rel", "tup", "y", "held"])

            for b in batches:
                got.append([b["rel"].to_numpy(np.int32), b["tup"].to_numpy(np.int64), b["y"].to_numpy(float), b["held"].to_numpy(bool)])
                n += len(b)
                if n >= BLOCK:
                    yield from out()
                    got, n = [], 0
            if got:
                yield from out()

        def gather(train: bool) -> Callable:
            def go(rows: Iterator) -> Iterator:
                parts = list(rows)
                if parts:
                    rel, tup, y, held = (np.concatenate([np.frombuffer(bytes(v[i]), t) for _, v in parts]) for i, t in enumerate((np.int32, np.int64, float, bool)))
                    rows_of = held != train
                    if rows_of.any():
                        rel, tup, y = rel[rows_of], tup[rows_of], y[rows_of]
                        yield parts[0][0], ("cells", _Cells(rel, tup, y, seed, k)) if train else ("held", rel, tup, y)

            return go

        sent = cells.select(F.coalesce(F.col("rel"), F.lit(-1)).cast("int").alias("rel"), F.col("tup").cast("bigint").alias("tup"), F.col("target").cast("double").alias("y"), held.alias("held"))
        chunks = sent.mapInPandas(cut, "p int, rel binary, tup binary, y binary, held binary").rdd.map(lambda x: (x.p, (x.rel, x.tup, x.y, x.held))).partitionBy(n_p, _block_of)
        self.cells, self.held = chunks.mapPartitions(gather(True), True), chunks.mapPartitions(gather(False), True)
        self.cells.persist(StorageLevel.MEMORY_AND_DISK)
        self.asked = self._asking(self.cells.map(lambda x: (x[0], x[1][1].rels)))
        self.asked.persist(StorageLevel.MEMORY_AND_DISK)

        def start(b: tuple[int, None]) -> tuple:
            x = _normal(2 * seed, np.arange(b[0], n_rel, n_q), k)
            return b[0], ("start", np.hstack([x, np.zeros((len(x), 1))]))

        # the blocks are put in their partitions before they are filled
        self.start = self.sc.parallelize([(b, None) for b in range(n_q)]).partitionBy(n_q, _block_of).mapPartitions(lambda rows: map(start, rows), True)
        self.kept: list[tuple[RDD, RDD]] = []
        self.last = np.ones(1)
        self.gram = np.zeros((1, 1))

    def _asking(self, rels: RDD) -> RDD:
        """Requests of blocks of tuples (block, relations) by the blocks of these relations."""
        n_q = self.n_q
        asked = rels.flatMap(lambda x: [(q, ("asked", x[0], x[1][x[1] % n_q == q] // n_q)) for q in range(n_q)])
        return asked.partitionBy(n_q, _block_of).mapPartitions(lambda rows: rows, True)

    def _together(self, *tables: RDD) -> RDD:
        """Tables of one side, block beside block."""
        out = self.sc.union(list(tables))
        assert out.getNumPartitions() == tables[0].getNumPartitions()
        return out

    def _relations_at(self, x: np.ndarray) -> Callable:
        """Of a block of relations its number, its vectors at the point of these weights, its start and past gradients, and what was sent to it."""

        def go(rows: Iterator) -> tuple:
            block, start, past, sent = None, None, {}, []
            for block, v in rows:
                if v[0] == "start":
                    start = v[1]
                elif v[0] == "past":
                    past[v[1]] = v[2]
                else:
                    sent.append(v)
            past = [past[i].astype(float) for i in range(len(x) - 1)]
            return block, sum((a * h for a, h in zip(x[1:], past)), x[0] * start), start, past, sent

        return go

    def _told(self, asked: RDD, x: np.ndarray) -> RDD:
        """Relation vectors at a point, to the blocks of tuples that asked for them."""
        at = self._relations_at(x)

        def tell(rows: Iterator) -> Iterator:
            q, r, _, _, sent = at(rows)
            for v in sent:
                if v[0] == "asked" and len(v[2]):
                    yield v[1], ("sent", q, r[v[2]].astype(KEPT))

        out = self._together(self.start, asked, *(rel for rel, _ in self.kept)).mapPartitions(tell)
        return out.partitionBy(self.n_p, _block_of).mapPartitions(lambda rows: rows, True)

    def _tuples_at(self, x: np.ndarray) -> Callable:
        """Of a block of tuples its number, cells, vectors at the point of these weights, past errors, vectors of relations then, and other rows by name."""
        k = self.k

        def go(rows: Iterator) -> tuple:
            block, cells, past, rest = None, None, {}, {}
            for block, v in rows:
                if v[0] == "cells":
                    cells = v[1]
                elif v[0] == "past":
                    past[v[1]] = v[2:]
                else:
                    rest.setdefault(v[0], []).append(v[1:])
            if cells is None:
                return block, None, None, None, None, rest
            t, w, v = x[0] * cells.start.astype(float), None, None
            if len(x) > 1:
                w, v = [past[i][0] for i in range(len(x) - 1)], np.array([past[i][1][:, :k] for i in range(len(x) - 1)], float)
                t += cells.to_tuples(w, v * x[1:, None, None])
            return block, cells, t, w, v, rest

        return go

    def at(self, x: np.ndarray) -> tuple[np.ndarray, tuple[RDD, RDD]]:
        """At the point of these weights: loss of the data, sum of the absolute gradient, square of the start, products of the data's gradient with the start,
        with the past ones and with itself; and what is to be kept of it."""
        k, l2, n_q, number = self.k, self.l2, self.n_q, len(x) - 1
        tuples, relations = self._tuples_at(x), self._relations_at(x)

        def errors(rows: Iterator) -> Iterator:
            p, cells, t, w, v, rest = tuples(rows)
            if cells is None:
                return
            r = np.zeros((len(cells.rels), k + 1), KEPT)
            for q, own in rest["sent"]:
                r[cells.rels % n_q == q] = own
            xs, exact = t.take(cells.j, 0), r.astype(float)
            z = cells.scores(exact, xs)
            e = (0.5 * (1 + np.tanh(0.5 * z)) - cells.y).astype(KEPT)
            e64, start = e.astype(float), cells.start.astype(float)
            h = cells.to_tuples([e], exact[None, :, :k])
            past = cells.products(w, v, h) if number else np.zeros(0)
            sums = np.concatenate([[float((np.logaddexp(0, z) - cells.y * z).sum()), float(np.abs(h + l2 * t).sum()), float((start * start).sum()), float((h * start).sum())], past, [float((h * h).sum())]])
            back = cells.to_relations(e64, xs).astype(KEPT)
            yield p, ("past", number, e, r)
            yield p, ("back", [(q, back[cells.rels % n_q == q]) for q in range(n_q)], sums)

        def gradients(rows: Iterator) -> Iterator:
            q, r, start, past, sent = relations(rows)
            if start is None:
                return
            h = np.zeros(r.shape)
            places = {v[1]: v[2] for v in sent if v[0] == "asked"}
            sums = np.zeros(number + 5)
            for _, p, own, other in sorted((v for v in sent if v[0] == "back"), key=lambda v: v[1]):
                h[places[p]] += own
                sums += 0 if other is None else other
            h = h.astype(KEPT)
            h64 = h.astype(float)
            yield q, ("past", number, h)
            yield q, ("sums", sums + np.concatenate([[0, float(np.abs(h64 + l2 * r).sum()), float((start * start).sum()), float((h64 * start).sum())], [float((h64 * b).sum()) for b in past], [float((h64 * h64).sum())]]))

        own = self._together(self.cells, self._told(self.asked, x), *(tup for _, tup in self.kept)).mapPartitions(errors, True)
        own.persist(StorageLevel.MEMORY_AND_DISK)
        # the sums of a block of tuples go with one of its messages
        back = own.flatMap(lambda v: [(q, ("back", v[0], g, v[1][2] if q == v[0] % n_q else None)) for q, g in v[1][1]] if v[1][0] == "back" else [])
        back = back.partitionBy(n_q, _block_of).mapPartitions(lambda rows: rows, True)
        summed = self._together(self.start, self.asked, back, *(rel for rel, _ in self.kept)).mapPartitions(gradients, True)
        summed.persist(StorageLevel.MEMORY_AND_DISK)
        return summed.filter(lambda v: v[1][0] == "sums").map(lambda v: v[1][1]).reduce(lambda a, b: a + b), (summed, own)

    def fit(self, rounds: int, memory: int = 4, tolerance: float = 1e-6) -> list[float]:
        """The steps of ``minimise``; returns the values."""
        gram, x = self.gram, np.ones(1)

        def value_at(loss: float, x: np.ndarray) -> float:
            return float(loss + 0.5 * self.l2 * (x @ gram @ x))

        def take(sums: np.ndarray, kept: tuple[RDD, RDD]) -> np.ndarray:
            n = len(self.kept) + 1
            out = np.zeros((n + 1, n + 1))
            out[:n, :n] = gram
            out[n, :] = out[:, n] = sums[3:]
            self.kept.append(kept)
            return out

        sums, kept = self.at(x)
        gram[0, 0] = sums[2]
        value = value_at(sums[0], x)
        gram, values, points = take(sums, kept), [value], []
        for _ in range(rounds + 1):
            n = len(gram)
            x = np.pad(x, (0, n - len(x)))
            g = self.l2 * x
            g[-1] += 1
            points.append((x, g))
            at = [(np.pad(a, (0, n - len(a))), np.pad(b, (0, n - len(b)))) for a, b in points[-memory - 1 :]]
            basis = _basis(at)
            own = basis @ gram @ basis.T
            if len(at) > 1 and own[len(at) - 2, 2 * len(at) - 3] <= 1e-12:
                points, basis, own = points[-1:], basis[-1:], own[-1:, -1:]
            if len(values) > rounds or len(values) > 1 and abs(values[-2] - value) <= tolerance * max(1.0, abs(values[-2])):
                break
            if np.sqrt(own[-1, -1]) <= tolerance * max(1.0, np.sqrt(x @ gram @ x)):
                break
            d = _direction(own)
            slope = own[-1] @ d
            if slope >= 0:
                points, basis, d, slope = points[-1:], basis[-1:], np.array([-1.0]), -own[-1, -1]
            t = 1.0 if len(points) > 1 else min(1.0, 1.0 / max(1e-12, sums[1]))
            while True:
                new = x + t * (d @ basis)
                sums, kept = self.at(new)
                if value_at(sums[0], new) <= value + 1e-4 * t * slope or t < 1e-10:
                    break
                for rdd in kept:
                    rdd.unpersist()
                t *= 0.5
            x, value = new, value_at(sums[0], new)
            values.append(value)
            gram = take(sums, kept)
        # the gradient at the last point is no part of it
        self.last = x[: len(self.kept)]
        for rdd in self.kept.pop():
            rdd.unpersist()
        return values

    def predicted(self) -> DataFrame:
        """(target, prob) of the held cells; unknown relations have no bias and no factors, unknown tuples no factors. Read it before ``close``."""
        n_q, k = self.n_q, self.k
        tuples = self._tuples_at(self.last)
        told = self._told(self._asking(self.held.map(lambda x: (x[0], (lambda r: r[r >= 0])(np.unique(x[1][1]))))), self.last)

        def score(rows: Iterator) -> Iterator:
            _, cells, t, _, _, rest = tuples(rows)
            for rel, tup, y in rest.get("held", []):
                known = np.unique(rel)
                known = known[known >= 0]
                r = np.zeros((len(known) + 1, k + 1))
                for q, own in rest.get("sent", []):
                    r[:-1][known % n_q == q] = own
                r = r[np.where(rel >= 0, np.searchsorted(known, rel), len(known))]
                z = r[:, k]
                if cells is not None:
                    j = np.minimum(np.searchsorted(cells.tups, tup), len(cells.tups) - 1)
                    z = z + (r[:, :k] * t[j]).sum(1) * (cells.tups[j] == tup)
                yield bytearray(y.tobytes()), bytearray((0.5 * (1 + np.tanh(0.5 * z))).tobytes())

        def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for y, prob in zip(b["y"], b["prob"]):
                    yield pd.DataFrame({"target": np.frombuffer(bytes(y)), "prob": np.frombuffer(bytes(prob))})

        rows = self._together(self.cells, told, self.held, *(tup for _, tup in self.kept)).mapPartitions(score)
        return self.spark.createDataFrame(rows, "y binary, prob binary").mapInPandas(unfold, "target double, prob double")

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """The last point as tables (_rel, _vr, b) and (_tup, _vt)."""
        n_q, k = self.n_q, self.k
        relations, tuples = self._relations_at(self.last), self._tuples_at(self.last)

        def of_relations(rows: Iterator) -> Iterator:
            q, r, start, _, _ = relations(rows)
            if start is not None and len(r):
                yield bytearray((q + n_q * np.arange(len(r))).tobytes()), bytearray(r.tobytes())

        def of_tuples(rows: Iterator) -> Iterator:
            _, cells, t, _, _, _ = tuples(rows)
            if cells is not None:
                yield bytearray(cells.tups.tobytes()), bytearray(t.tobytes())

        def unfold(width: int) -> Callable:
            def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for i, x in zip(b["i"], b["x"]):
                        i, m = np.frombuffer(bytes(i), np.int64), np.frombuffer(bytes(x)).reshape(-1, width)
                        for a in range(0, len(m), 20_000):
                            yield pd.DataFrame({"i": i[a : a + 20_000], "v": list(m[a : a + 20_000, :k]), "b": m[a : a + 20_000, -1]})

            return go

        flat = (self._together(self.start, *(rel for rel, _ in self.kept)).mapPartitions(of_relations), self._together(self.cells, *(tup for _, tup in self.kept)).mapPartitions(of_tuples))
        rel, tup = (settled(self.spark.createDataFrame(rdd, "i binary, x binary").mapInPandas(unfold(w), "i bigint, v array<double>, b double"), "factors") for rdd, w in zip(flat, (k + 1, k)))
        return rel.withColumnsRenamed({"i": "_rel", "v": "_vr"}), tup.select(F.col("i").alias("_tup"), F.col("v").alias("_vt"))

    def close(self) -> None:
        """Frees the blocks."""
        for rdd in (self.cells, self.asked, *(x for pair in self.kept for x in pair)):
            rdd.unpersist()


def factors_apart(cells: DataFrame, n_rel: int, n_tup: int, components: int, l2: float = 0.01, seed: int = 0, rounds: int = 30, memory: int = 4, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame, list[float]]:
    """[M3, M21, A24] ``logistic_factors`` for any number of parameters: (_rel, _vr, b), (_tup, _vt) and the values. The steps are those of ``minimise``."""
    model = _Apart(cells, n_rel, n_tup, components, l2, seed)
    values = model.fit(rounds, memory, tolerance)
    out = model.tables()
    model.close()
    return *out, values


def held_out(cells: DataFrame, n_rel: int, n_tup: int, n_cells: int, components: int, rounds: int, then: Callable[[DataFrame], DataFrame], l2: float = 0.01, seed: int = 0) -> DataFrame:
    """[M3, M13] Fits the cells (rel, tup, target, held) that aren't held in blocks, and returns ``then`` of the (target, prob) of those that are. These lie beside the
    vectors of their tuples, so no table of tuples is numbered or joined; ``tup`` is any whole number of a tuple, ``rel`` null where no cell to fit has the relation."""
    model = _Apart(cells, n_rel, n_tup, components, l2, seed, n_cells)
    model.fit(rounds)
    out = settled(then(model.predicted()), "held-out")
    model.close()
    return out


def fit_cells(train: DataFrame, cells: DataFrame, components: int = 8, l2: float = 0.01, rounds: int = 30, seed: int = 0) -> DataFrame:
    """[M3, M13] Fits cells (relation, arg1, arg2, target) and adds ``prob`` to others (relation, arg1, arg2, ...). Relations and tuples are numbered
    by tables; unknown ones have no bias and no factors. Above ``MAX_PARAMETERS`` the parameters stay in blocks (``factors_apart``)."""
    spark = train.sparkSession
    key = tuple_key()
    rel = settled(dictionary(train, "relation").withColumnRenamed("id", "_rel"), "relations")
    tup = settled(dictionary(train.select(key.alias("_key")), "_key").withColumnRenamed("id", "_tup"), "tuples")
    numbered = train.withColumn("_key", key).join(sorted_join(rel), "relation").join(sorted_join(tup), "_key")
    numbered = settled(numbered.select(F.col("_rel").cast("int").alias("rel"), F.col("_tup").cast("int").alias("tup"), "target"), "cells")
    n_rel, n_tup = rel.count(), tup.count()
    if n_rel + (n_rel + n_tup) * components > MAX_PARAMETERS:
        vr, vt, _ = factors_apart(numbered, n_rel, n_tup, components, l2, seed, rounds)
        vr, vt = sorted_join(vr), sorted_join(vt)
    else:
        b, r, t, _ = logistic_factors(numbered, n_rel, n_tup, components, l2, seed, rounds)
        # the driver holds the parameters (bounded by MAX_PARAMETERS) and hands them back as tables
        rows = lambda m, *more: pd.DataFrame({"i": range(len(m)), "v": list(m), **dict(more)})
        vr = spark.createDataFrame(rows(r.tolist(), ("b", b)), "i bigint, v array<double>, b double").withColumnsRenamed({"i": "_rel", "v": "_vr"})
        vt = spark.createDataFrame(rows(t.tolist()), "i bigint, v array<double>").withColumnsRenamed({"i": "_tup", "v": "_vt"})
    out = cells.withColumn("_key", key).join(sorted_join(rel.join(vr, "_rel")), "relation", "left").join(sorted_join(tup.join(vt, "_tup")), "_key", "left")
    return out.select(*cells.columns, sigmoid(pair_score(F.col("_vr"), F.col("_vt"), F.col("b"))).alias("prob"))
