"""Near-duplicate embeddings: cells cut along principal axes, joined in blocks of columns with bounds on the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, local_roots, stored

SLACK = 1e-5  # of products and squared distances in 32 bits
SURE = 1e-9  # of products of unit rows in 64 bits
AXES = 64
LEAF = (-1, 0.0, 0, 0)

Nodes = list[tuple[int, int, int, float, int, int]]


def principal_axes(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    """The first principal axes of the commonest dimension of a sample of vectors.

    They only set the coordinates by which vectors are dealt and pairs are left out; results do not depend on them.
    """
    if not vectors:
        return {}
    sizes = [len(v) for v in vectors]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d))
    x = unit(np.array([v for v in vectors if len(v) == dim]))
    x = x[np.isfinite(x).all(axis=1)]
    _, axes = np.linalg.eigh(x.T @ x)
    return {dim: np.ascontiguousarray(axes[:, ::-1][:, :AXES])}


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    with np.errstate(all="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def placed(raw: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates of the unit vectors of ``raw`` along the axes of their dimension, else their own first ones."""
    x = unit(raw)
    return x @ axes[x.shape[1]] if x.shape[1] in axes else x[:, :AXES]


def along(raw: np.ndarray, axes: dict[int, np.ndarray], count: int) -> np.ndarray:
    """The first coordinates as columns, each row's summed by itself: equal vectors have the same bits in any batch."""
    x = unit(raw)
    own = axes[x.shape[1]].T if x.shape[1] in axes else None
    return np.array([(x * own[c]).sum(axis=1) if own is not None else x[:, c] for c in range(min(count, x.shape[1], AXES))], np.float32)


def features(x: np.ndarray) -> np.ndarray:
    """Columns and the norm of what a unit row has besides them: products of such rows bound the cosine from above."""
    with np.errstate(all="ignore"):
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))
    return np.concatenate([x, rest], axis=1).astype(np.float32)


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, leading: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine may reach the threshold; x and y are unit rows in PCA order."""
    return np.nonzero(features(x[:, :leading]) @ features(y[:, :leading]).T >= threshold - SLACK)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def grow(columns: np.ndarray, leaf: int) -> tuple[np.ndarray, Nodes]:
    """Rows cut at medians of one column after the other until a node has ``leaf`` rows; their order, and the nodes.

    A node is its first and last place, the column and value of its cut, and the nodes below and above it.
    """
    order, nodes, todo = np.arange(columns.shape[1], dtype=np.int32), [(0, columns.shape[1], *LEAF)], [(0, 0)]
    while todo:
        k, c = todo.pop()
        first, last = nodes[k][:2]
        while last - first > leaf and c < len(columns):
            v, half = columns[c][order[first:last]], (last - first) // 2
            cut = np.partition(v, half)[half]
            low = v < cut
            if low.any():
                own = order[first:last].copy()
                middle, at = first + int(low.sum()), len(nodes)
                order[first:middle], order[middle:last] = own[low], own[~low]
                nodes[k] = (first, last, c, float(cut), at, at + 1)
                nodes += [(first, middle, *LEAF), (middle, last, *LEAF)]
                todo += [(at, c + 1), (at + 1, c + 1)]
                break
            c += 1
    return order, nodes


def visits(nodes: Nodes, start: int, columns: np.ndarray, rows: np.ndarray, apart: np.ndarray, bound: float) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves under ``start`` with those of the rows that are within ``bound``, a squared distance, of them.

    ``apart`` is the squared distance that a row has by the cuts above.  A column is cut once on the way to a leaf, so these add up.
    """
    todo = [(start, rows, apart)]
    while todo:
        k, rows, apart = todo.pop()
        if not len(rows):
            continue
        _, _, c, cut, low, high = nodes[k]
        if c < 0:
            yield k, rows
            continue
        off = columns[c][rows] - np.float32(cut)
        below = off < 0
        far = off * off + apart
        near = far <= bound
        at = np.flatnonzero(below | near)
        todo.append((low, rows[at], np.where(below[at], apart[at], far[at])))
        at = np.flatnonzero(near | ~below)
        todo.append((high, rows[at], np.where(below[at], far[at], apart[at])))


def deal(nodes: Nodes, columns: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, cells, and whether the row is a guest: each row is in its own leaf, and of two leaves that close rows lie in one sends guests.

    Leaves are numbered as they come; of two, the lower one sends if their numbers add up to an even one, else the higher one.
    """
    leaves = [k for k, node in enumerate(nodes) if node[2] < 0]
    number = np.zeros(len(nodes), np.int64)
    number[leaves] = np.arange(len(leaves))
    rows = np.arange(columns.shape[1])
    home, todo = np.zeros(len(rows), np.int64), [(0, rows)]
    while todo:
        k, some = todo.pop()
        _, _, c, cut, low, high = nodes[k]
        if c < 0:
            home[some] = number[k]
        else:
            below = columns[c][some] < np.float32(cut)
            todo += [(low, some[below]), (high, some[~below])]
    out = [(rows, home, np.zeros(len(rows), bool))]
    for k, some in visits(nodes, 0, columns, rows, np.zeros(len(rows), np.float32), bound):
        here, there = number[k], home[some]
        some = some[(here != there) & ((there < here) == ((here + there) % 2 == 0))]
        out.append((some, np.full(len(some), here), np.ones(len(some), bool)))
    return tuple(np.concatenate(c) for c in zip(*out))


def classes(keys: tuple[np.ndarray, ...], ids: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of equal keys as one class: where it starts, its smallest id, and its number of copies."""
    first = np.append(0, np.flatnonzero(np.any([key[1:] != key[:-1] for key in keys], axis=0)) + 1)
    return first, np.minimum.reduceat(ids, first), np.add.reduceat(copies, first)


class Cell:
    """Members of one cell, linked with each other and with guests.  Members come first, and equal vectors together.

    Vectors within distance r of each other are within r / sqrt(k) in one of k blocks of their columns at least; so each
    block has a tree of its own, a vector visits the leaves that are so close to it there, and a pair counts in the first such block.
    """

    def __init__(self, axes: dict[int, np.ndarray], threshold: float, leaf: int, leading: int, most_bytes: int):
        self.axes, self.threshold, self.leaf, self.leading, self.most_bytes = axes, threshold, leaf, leading, most_bytes
        self.own: list[tuple] = []
        self.waiting: list[tuple] = []
        self.sealed = False

    def feed(self, guest: bool, *rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows as h, k, ids, copies, vectors."""
        if guest and not self.own and not self.sealed:
            return  # nobody is at home
        held = self.waiting if guest else self.own
        held.append(tuple(np.array(x) for x in rows))
        if guest and sum(r[-1].nbytes for r in held) >= self.most_bytes:
            yield from self.receive(False)

    def seal(self) -> None:
        n, filled = sum(len(r[0]) for r in self.own), 0
        held = [np.empty((n, *x.shape[1:]), x.dtype) for x in self.own[0]]
        for at in range(len(self.own)):  # one after the other, so that a cell is never held twice
            rows, self.own[at] = self.own[at], None
            for to, x in zip(held, rows):
                to[filled : filled + len(x)] = x
            filled += len(rows[0])
        first, self.ids, self.copies = classes(held[:2], *held[2:4])
        self.raw = held[4] if len(first) == n else held[4][first]
        self.own, self.sealed = [], True
        n, width = len(self.ids), min(self.raw.shape[1], AXES)
        count = max(1, min(4, width // self.leading)) if n > 32 * self.leaf else 1
        self.blocks = [list(range(b, width, count)) for b in range(count)]
        r2 = 2 - 2 * self.threshold
        self.bound = r2 / count + SLACK
        self.links, self.left, self.right, self.n_pairs = np.zeros(n, np.int64), [], [], 0
        self.trees, self.places = [], []
        coordinates = self.sides(self.raw)
        for b in range(count):
            order, nodes = grow(np.ascontiguousarray(coordinates[b][:, :-1].T), self.leaf if n > 4 * self.leaf else n)
            place = np.empty(n, np.int32)
            place[order] = np.arange(n, dtype=np.int32)
            self.trees.append((order, nodes, coordinates[b][order]))
            self.places.append(place)
            coordinates[b] = None
        for b in range(count):
            self.join_members(b)

    def sides(self, raw: np.ndarray) -> list[np.ndarray]:
        """Features of each block."""
        out = [np.empty((len(raw), len(c) + 1), np.float32) for c in self.blocks]
        step = max(1, (1 << 20) // raw.shape[1])
        for k in range(0, len(raw), step):
            x = placed(raw[k : k + step], self.axes)
            for held, c in zip(out, self.blocks):
                held[k : k + step] = features(x[:, c])
        return out

    def join_members(self, b: int) -> None:
        order, nodes, side = self.trees[b]
        columns = np.ascontiguousarray(side[:, :-1].T)
        found = Found(self, b, self.raw, lambda other, j: self.trees[other][2][self.places[other][j]])

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            np.add.at(self.links, i, self.copies[j])
            np.add.at(self.links, j, self.copies[i])
            self.unite(i, j)

        for k, (first, last, c, cut, _, high) in enumerate(nodes):
            if c < 0:
                found.meet(first, last, np.arange(first, last, dtype=np.int32), side, order, keep, same=True)
                continue
            low_end = nodes[high][0]
            off = np.float32(cut) - columns[c][first:low_end]
            at = np.flatnonzero(off * off <= self.bound)
            for leaf, rows in visits(nodes, high, columns, (at + first).astype(np.int32), off[at] * off[at], self.bound):
                found.meet(*nodes[leaf][:2], rows, side, order, keep)
        found.settle(keep)

    def receive(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.sealed:
            self.seal()
        h, k, ids, copies, raw = (np.concatenate(c) for c in zip(*self.waiting))
        first, ids, copies = classes((h, k), ids, copies)
        rows = [h[first], k[first], ids, copies, raw if len(first) == len(h) else raw[first]]
        self.waiting = [] if last else [tuple(x[-1:] for x in rows)]  # more copies of the last one may follow
        _, _, ids, copies, raw = rows if last else [x[:-1] for x in rows]
        links, with_whom = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            np.add.at(self.links, i, copies[j])
            np.add.at(links, j, self.copies[i])
            new = with_whom[j] < 0
            with_whom[j[new]] = i[new]
            self.unite(i, with_whom[j])

        sides = self.sides(raw)
        for b, (order, nodes, _) in enumerate(self.trees):
            columns = np.ascontiguousarray(sides[b][:, :-1].T)
            found = Found(self, b, raw, lambda other, j: sides[other][j])
            rows = np.arange(len(ids), dtype=np.int32)
            for leaf, rows in visits(nodes, 0, columns, rows, np.zeros(len(ids), np.float32), self.bound):
                found.meet(*nodes[leaf][:2], rows, sides[b], None, keep)
            found.settle(keep)
        at = np.flatnonzero(links)
        if len(at):
            yield self.batch(ids[at], self.ids[with_whom[at]], links[at])

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        self.left.append(i)
        self.right.append(j)
        self.n_pairs += len(i)
        if self.n_pairs > max(2 * len(self.ids), 1 << 20):
            root = self.roots()
            at = np.flatnonzero(root != np.arange(len(root)))
            self.left, self.right, self.n_pairs = [at], [root[at]], len(at)

    def roots(self) -> np.ndarray:
        return local_roots(len(self.ids), np.concatenate(self.left), np.concatenate(self.right)) if self.left else np.arange(len(self.ids))

    def finish(self) -> Iterator[pa.RecordBatch]:
        """Links of the members, each with one of its group."""
        if not self.sealed and not self.waiting and sum(len(r[0]) for r in self.own) < 2:
            return
        if self.waiting:
            yield from self.receive(True)
        elif not self.sealed:
            self.seal()
        at = np.flatnonzero(self.links)
        if len(at):
            yield self.batch(self.ids[at], self.ids[self.roots()[at]], self.links[at])

    @staticmethod
    def batch(ids: np.ndarray, others: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(links)], ["rid", "other", "links"])


class Found:
    """Candidates of one block of a cell, held against the threshold many at a time."""

    def __init__(self, cell: Cell, block: int, raw: np.ndarray, side_of):
        self.cell, self.block, self.raw, self.side_of = cell, block, raw, side_of
        self.i: list[np.ndarray] = []
        self.j: list[np.ndarray] = []
        self.n = 0

    def meet(self, first: int, last: int, rows: np.ndarray, side: np.ndarray, order: np.ndarray | None, keep, same: bool = False, wide: int = 1536) -> None:
        """Members at places ``first`` to ``last`` against rows of ``side``; ``order`` turns these into numbers of members."""
        own, tree_side = self.cell.trees[self.block][0][first:last], self.cell.trees[self.block][2][first:last]
        for k in range(0, len(rows), wide):
            some = rows[k : k + wide]
            hit = tree_side @ side.take(some, axis=0).T >= np.float32(self.cell.threshold - SLACK)
            if same:
                hit &= np.arange(first, last)[:, None] < some[None, :]
            if not hit.any():
                continue
            other = some if order is None else order[some]
            if 16 * np.count_nonzero(hit) > hit.size:
                i, j = self.dense(own, other, hit)
                self.pick(i, j, keep)
                continue
            at = np.flatnonzero(hit)
            self.i.append(own[at // len(some)])
            self.j.append(other[at % len(some)])
            self.n += len(at)
            if self.n >= 65_536:
                self.settle(keep)

    def dense(self, own: np.ndarray, other: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.cell.raw[own].astype(np.float64), self.raw[other].astype(np.float64)
        near = unit(x) @ unit(y).T
        sure, maybe = near >= self.cell.threshold + SURE, np.abs(near - self.cell.threshold) < SURE
        i, j = np.nonzero(maybe & hit)
        sure[i, j] = cosines(x[i], y[j]) >= self.cell.threshold
        i, j = np.nonzero(sure & hit)
        return own[i], other[j]

    def settle(self, keep) -> None:
        """Exact cosines of the candidates so far."""
        if not self.n:
            return
        i, j = np.concatenate(self.i), np.concatenate(self.j)
        self.i, self.j, self.n = [], [], 0
        step = max(1, (1 << 19) // self.raw.shape[1])
        near = np.concatenate([cosines(self.cell.raw[i[k : k + step]].astype(np.float64), self.raw[j[k : k + step]].astype(np.float64)) for k in range(0, len(i), step)]) >= self.cell.threshold
        self.pick(i[near], j[near], keep)

    def pick(self, i: np.ndarray, j: np.ndarray, keep) -> None:
        """Keeps pairs that are close in this block and in none before it."""
        for b in range(self.block + 1 if len(self.cell.blocks) > 1 else 0):
            apart = self.cell.trees[b][2][self.cell.places[b][i]][:, :-1] - self.side_of(b, j)[:, :-1]
            near = np.einsum("ij,ij->i", apart, apart) <= np.float32(self.cell.bound - SLACK / 2)
            i, j = (i[near], j[near]) if b == self.block else (i[~near], j[~near])
        if len(i):
            keep(i, j)


def in_cells(vectors: DataFrame, axes: dict[int, np.ndarray], trees: dict[tuple[int, int], Nodes], bound: float) -> DataFrame:
    """Rows with their cell in the tree of their label and dimension, if there is one, and again as guests of other cells.

    Copies within a batch leave as one row, so a very common vector is a few rows of a cell.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, label, h, k = (batch.column(c).to_numpy() for c in ("vec_id", "label", "h", "k"))
            order = np.lexsort((k, h, label))
            first, rid, n = classes((label[order], h[order], k[order]), ids[order], np.ones(len(order), np.int64))
            at = order[first]
            vectors = batch.column("embedding").take(pa.array(at))
            label, h, k, dim = label[at], h[at], k[at], vectors.value_lengths().to_numpy().astype(np.int32)
            rows, cell, guest = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            for (one, size), nodes in trees.items():
                some = np.flatnonzero((label == one) & (dim == size))
                if len(some):
                    raw = vectors.take(pa.array(some)).flatten().to_numpy().reshape(len(some), -1)
                    there, cells, is_guest = deal(nodes, along(raw, axes, 1 + max(node[2] for node in nodes)), bound)
                    cell[some] = cells[: len(some)]
                    rows, cell, guest = np.append(rows, some[there[len(some) :]]), np.append(cell, cells[len(some) :]), np.append(guest, is_guest[len(some) :])
            for first in range(0, len(rows), 10_000):
                s = slice(first, first + 10_000)
                r = rows[s]
                held = [label[r], dim[r], cell[s].astype(np.int32), guest[s], h[r], k[r], rid[r], n[r]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, held), vectors.take(pa.array(r))], ["label", "dim", "cell", "guest", "h", "k", "rid", "n", "embedding"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("vec_id", "label", "h", "k", "embedding").mapInArrow(run, f"label int, dim int, cell int, guest boolean, h long, k long, rid long, n long, embedding {kind}")


def cell_links(dealt: DataFrame, axes: dict[int, np.ndarray], threshold: float, leaf: int, leading: int, most_bytes: int) -> DataFrame:
    """Number of links of each vector that has any, and one vector of its group, for each cell it is in."""

    def run(batches):
        key = cell = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "dim", "cell", "guest")])
            ends = np.append(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, batch.num_rows)
            columns, vectors = [batch.column(c).to_numpy() for c in ("h", "k", "rid", "n")], batch.column("embedding")
            first = 0
            for last in ends.tolist():
                if key != tuple(at[:3, first]):
                    if cell:
                        yield from cell.finish()
                    key, cell = tuple(at[:3, first]), Cell(axes, threshold, leaf, leading, most_bytes)
                raw = vectors.slice(first, last - first).flatten().to_numpy().reshape(last - first, -1)
                yield from cell.feed(bool(at[3, first]), *(c[first:last] for c in columns), raw)
                first = last
        if cell:
            yield from cell.finish()

    ordered = dealt.repartition("label", "dim", "cell").sortWithinPartitions("label", "dim", "cell", "guest", "h", "k")
    return ordered.mapInArrow(run, "rid long, other long, links long")


def cell_trees(rows: DataFrame, size: int, cell_bytes: int, sample: int) -> tuple[dict[int, np.ndarray], dict[tuple[int, int], Nodes]]:
    """Principal axes, and for each label and dimension of more than ``cell_bytes`` of vectors the tree of its cells; both from a bounded sample."""
    counts = rows.groupBy("label", F.size("embedding").alias("dim")).count()
    large = F.col("count") * F.col("dim") * size > cell_bytes
    total, found = counts.agg(F.sum("count"), F.collect_list(F.when(large, F.struct("label", "dim", "count")))).first()
    share = F.pmod(F.xxhash64("embedding"), F.lit(max(1, (total or 0) // sample))) == 0
    picked = rows.filter(share).select("label", "embedding").distinct().limit(2 * sample).toArrow().to_pydict()
    vectors = [np.array(v) for v in picked["embedding"]]
    axes = principal_axes(vectors)
    trees = {}
    for label, dim, n in found:
        deep = int(np.ceil(np.log2(n * dim * size / cell_bytes)))
        own, same = ([v for v, at in zip(vectors, picked["label"]) if len(v) == dim and (at == label or every)] for every in (False, True))
        some = own if len(own) >= 8 << deep else same
        nodes = grow(along(np.array(some), axes, 2 * deep), -(-len(some) // (1 << deep)))[1] if some else []
        if len(nodes) > 1:
            trees[label, dim] = nodes
    return axes, trees


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, rows_per_tile: int = 1024, leading: int = 8, sample: int = 4096, cell_bytes: int = 96 << 20) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (vec_id, embedding, label): links at a cosine of ``threshold`` or more.

    Only rows of one label (not NULL) and one dimension are compared.  Rows whose vector is NULL, empty, zero or holds a
    NULL or non-finite component, and rows with a NULL id, link with nothing.  Equal vectors are one class with a number
    of copies, so a very common vector costs as much as one.  A label of more than ``cell_bytes`` of vectors is cut into
    cells at medians along principal axes; a vector goes to its own cell and to those it is within the threshold's distance of.
    A task joins one cell in memory (``Cell``) and gives each vector's number of links and one link to its local group;
    pairs of vectors are never listed.  Components may be floats or doubles and are not rounded.  Rows of one vec_id are one
    node: its component holds what any of them reaches; an empty table gives an empty result.
    """
    v = F.col("embedding")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    element = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    # Components are compared as they are given: in 32 bits if the column has them so, else as doubles.
    kind, size = ("float", 4) if isinstance(element, FloatType) else ("double", 8)
    rows = vectors.select("vec_id", v.cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("int").alias("label")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    # 128 bits of hash and the label stand for a vector, so that it is sent to its cells only; zeros of both signs are one.
    keyed = rows.filter("fine").withColumn("h", F.xxhash64("embedding")).withColumn("k", F.xxhash64(F.lit("other"), "embedding"))
    axes, trees = cell_trees(rows.filter("fine"), size, cell_bytes, sample)
    dealt = in_cells(keyed, axes, trees, 2 - 2 * threshold + SLACK)
    linked = stored(cell_links(dealt, axes, threshold, max(1, rows_per_tile // 8), leading, cell_bytes // 12), "vector-links")
    groups = components(linked.selectExpr("rid as a", "other as b"), "vector-groups").withColumnRenamed("node", "rid")
    counted = linked.groupBy("rid").agg(F.sum("links").alias("links")).join(groups, "rid", "left")
    same = keyed.groupBy("label", "h", "k").agg(F.min("vec_id").alias("rid"), F.count("*").alias("n")).join(counted, "rid", "left")
    named = same.select("label", "h", "k", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component_id"))
    lone = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = keyed.select("vec_id", "label", "h", "k").join(named, ["label", "h", "k"]).select("vec_id", "n_links", "component_id").union(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
