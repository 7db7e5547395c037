"""Product codes of vectors by Lloyd's algorithm on two trees.

A vector is cut into equal parts, and each part position has a codebook. To assign the parts of one position to
their nearest entries, a tree over the parts is walked together with a tree over the entries:

* every node knows the box around its points; the least and the greatest distance between two boxes bound
  all distances between their points, and pairs of nodes that cannot hold a nearest pair are dropped;
* a node of parts that is left with one entry is assigned as a whole: its sum and its count come from running sums;
* in leaves that keep several entries, distances are computed point by point.

All numbers are integers, so bounds are exact, ties go to the lower index, and the result does not depend on
how the table is cut. Trees over parts are built once, per block of vectors, and kept as a staged table
that each round walks; a round sends a row per entry and task, and the codebooks (entries x dimension) are all that
reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterline.llm.vectors import finite_vectors, scaled_floor
from quarterline.session import stage

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256.0
#: whole numbers beyond this count as this, so that no sum of squares leaves 64 bits
MOST = 2.0 ** 25
#: numbers of the vectors of one set of trees, vectors of one at most, and points of a leaf
BLOCK_NUMBERS, BLOCK, LEAF = 1 << 20, 16_384, 8


def starts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in the order of the tree, with ``n`` at the end."""
    return (np.arange((1 << level) + 1) * n) >> level


def depth(n: int, leaf: int) -> int:
    """Levels below the root, so that leaves hold at most ``leaf`` points (and all nodes at least one)."""
    found = 0
    while n >> found > leaf or (n >> found == leaf and n & ((1 << found) - 1)):
        found += 1
    return found


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """Order of the points (trees, n, width) of each tree: nodes are halved across their longest side, level by level."""
    trees, n, _ = points.shape
    order = np.tile(np.arange(n), (trees, 1))
    tree = np.arange(trees)[:, None]
    for level in range(depth(n, leaf)):
        bounds = starts(n, level)
        low, high = _boxes(np.take_along_axis(points, order[:, :, None], axis=1), bounds)
        side = (high - low).argmax(axis=2)
        node = np.repeat(np.arange(1 << level), np.diff(bounds))
        key = points[tree, order, side[:, node]]
        place = np.lexsort((key.ravel(), np.broadcast_to(node, key.shape).ravel(), np.repeat(np.arange(trees), n)))
        order = np.take_along_axis(order, place.reshape(trees, n) - tree * n, axis=1)
    return order


def _boxes(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (np.minimum.reduceat(points, bounds[:-1], axis=1), np.maximum.reduceat(points, bounds[:-1], axis=1))


@dataclass(frozen=True)
class Tree:
    """Trees over the points of every part position, level by level."""

    points: np.ndarray                              # (trees, n, width), in the order of the tree
    boxes: list[tuple[np.ndarray, np.ndarray]]      # per level, (trees * nodes, width) each

    @property
    def depth(self) -> int:
        return len(self.boxes) - 1

    def of_type(self, kind: type) -> Tree:
        if self.points.dtype == kind:
            return self
        return Tree(self.points.astype(kind), [(low.astype(kind), high.astype(kind)) for low, high in self.boxes])

    @staticmethod
    def over(points: np.ndarray, leaf: int) -> Tree:
        """Of points that are in order already."""
        trees, n, width = points.shape
        levels = depth(n, leaf)
        low, high = _boxes(points, starts(n, levels))
        boxes = [(low, high)]
        for _ in range(levels):
            low, high = np.minimum(low[:, ::2], low[:, 1::2]), np.maximum(high[:, ::2], high[:, 1::2])
            boxes.append((low, high))
        flat = [(a.reshape(-1, width), b.reshape(-1, width)) for a, b in reversed(boxes)]
        return Tree(points, flat)


@dataclass(frozen=True)
class EntryTree:
    """The codebooks and a tree over each, down to single entries."""

    codebooks: np.ndarray       # (trees, entries, width)
    order: np.ndarray           # (trees, entries): index of the entry at each place of the tree
    tree: Tree

    def of_type(self, kind: type) -> EntryTree:
        return EntryTree(self.codebooks.astype(kind), self.order, self.tree.of_type(kind))

    @staticmethod
    def over(codebooks: np.ndarray) -> EntryTree:
        # a full tree has a power of two of leaves: the last entry fills it up, under its own index
        count = codebooks.shape[1]
        index = np.minimum(np.arange(1 << (count - 1).bit_length()), count - 1)
        order = index[tree_order(codebooks[:, index], 1)]
        return EntryTree(codebooks, order, Tree.over(np.take_along_axis(codebooks, order[:, :, None], axis=1), 1))


@dataclass(frozen=True)
class Assignment:
    """What the walk settles: whole nodes with one entry each, and single points of uncertain leaves."""

    node_tree: np.ndarray
    node_start: np.ndarray
    node_end: np.ndarray
    node_entry: np.ndarray
    point_tree: np.ndarray
    point_at: np.ndarray
    point_entry: np.ndarray


def _firsts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def assign(parts: Tree, entries: EntryTree) -> Assignment:
    """Nearest entry of every point of every tree, ties to the lower index."""
    trees, n, width = parts.points.shape
    largest = sum(max(abs(int(x.min())), abs(int(x.max()))) for x in (parts.points, entries.codebooks))
    # no bound or distance is above this; short numbers are twice as fast
    kind = np.int32 if 2 * width * largest * largest < 1 << 31 else np.int64
    parts, entries = parts.of_type(kind), entries.of_type(kind)
    node = entry = np.arange(trees)
    at, into = 0, 0
    settled: list[tuple[np.ndarray, ...]] = []
    while True:
        low, high = (side[node] for side in parts.boxes[at])
        e_low, e_high = (side[entry] for side in entries.tree.boxes[into])
        least = _squares(np.maximum(np.maximum(low - e_high, e_low - high), 0))
        greatest = _squares(np.maximum(high - e_low, e_high - low))
        first = _firsts(node)
        sizes = np.diff(np.append(first, len(node)))
        # every point of the node has an entry within this distance
        reach = np.repeat(np.minimum.reduceat(greatest, first), sizes)
        keep = least <= reach
        if into == entries.tree.depth:
            keep &= ~_beaten(low, high, e_low, greatest, first, sizes, _indexes(entries, entry))
            left = np.add.reduceat(keep, first, dtype=np.int64)
            done = np.flatnonzero(keep & np.repeat(left == 1, sizes))
            bounds = starts(n, at)
            place = node[done] & ((1 << at) - 1)
            settled.append((node[done] >> at, bounds[place], bounds[place + 1], _indexes(entries, entry[done])))
            keep[done] = False
        node, entry = node[keep], entry[keep]
        down, inward = at < parts.depth, into < entries.tree.depth
        if not len(node) or not (down or inward):
            break
        if down:
            # the halves of a node follow each other, so that pairs stay grouped by node
            node, entry = _split(node, entry, halves_of_first=True)
            at += 1
        if inward:
            node, entry = _split(node, entry, halves_of_first=False)
            into += 1
    whole = [np.concatenate(x) for x in zip(*settled)] if settled else [np.zeros(0, np.int64)] * 4
    return Assignment(*whole, *_points(parts, entries, node, entry))


def _indexes(entries: EntryTree, place: np.ndarray) -> np.ndarray:
    """Index within its codebook of the entry at a leaf; leaves are numbered through all trees."""
    return entries.order.ravel()[place]


def _beaten(low, high, value, greatest, first, sizes, index) -> np.ndarray:
    """Pairs whose entry is nowhere in the node's box nearer than the entry with the smallest greatest distance.

    Where both are as near, the lower index wins; of two places with one index, the first in rank.
    """
    rank = np.lexsort((index, greatest, np.repeat(np.arange(len(first)), sizes)))
    best = np.repeat(rank[first], sizes)
    a, b = value[best], value
    # distance to a less distance to b is linear in the point: greatest at a corner of the box
    slope = 2 * (b - a)
    most = (np.where(slope > 0, high, low) * slope + a * a - b * b).sum(axis=1)
    return (most < 0) | ((most == 0) & (index[best] <= index) & (best != np.arange(len(index))))


def _split(node: np.ndarray, entry: np.ndarray, halves_of_first: bool) -> tuple[np.ndarray, np.ndarray]:
    if not halves_of_first:
        return np.repeat(node, 2), (np.repeat(entry, 2) * 2 + np.tile([0, 1], len(entry)))
    first = _firsts(node)
    sizes = np.diff(np.append(first, len(node)))
    # for each run of a node: the run for its left half, then the run for its right half
    take = np.repeat(np.arange(len(node)), 2)
    half = np.tile([0, 1], len(node))
    order = np.lexsort((take, half, np.repeat(np.repeat(np.arange(len(first)), sizes), 2)))
    return (node[take] * 2 + half)[order], entry[take][order]


def _points(parts: Tree, entries: EntryTree, leaf: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tree, place and nearest entry of every point of the leaves that kept several entries."""
    n = parts.points.shape[1]
    if not len(leaf):
        return (np.zeros(0, np.int64),) * 3
    bounds = starts(n, parts.depth)
    tree, place = leaf >> parts.depth, leaf & ((1 << parts.depth) - 1)
    begin, size = bounds[place], np.diff(bounds)[place]
    most = int(size.max())
    index = _indexes(entries, entry)
    first = _firsts(leaf)
    pairs = np.diff(np.append(first, len(leaf)))
    found = []
    for k in range(most):
        at = begin + np.minimum(k, size - 1)
        apart = _squares(parts.points[tree, at] - entries.codebooks[tree, index])
        least = np.repeat(np.minimum.reduceat(apart, first), pairs)
        nearest = np.minimum.reduceat(np.where(apart == least, index, entries.codebooks.shape[1]), first)
        real = k < size[first]
        found.append((tree[first][real], at[first][real], nearest[real]))
    return tuple(np.concatenate(x) for x in zip(*found))


def entry_totals(parts: Tree, given: Assignment, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts and sum of parts of every entry: (trees, count) and (trees, count, width)."""
    trees, n, width = parts.points.shape
    running = np.zeros((trees, n + 1, width), np.int64)
    np.cumsum(parts.points, axis=1, dtype=np.int64, out=running[:, 1:])
    counts, sums = np.zeros((trees, count), np.int64), np.zeros((trees, count, width), np.int64)
    np.add.at(counts, (given.node_tree, given.node_entry), given.node_end - given.node_start)
    np.add.at(sums, (given.node_tree, given.node_entry), running[given.node_tree, given.node_end] - running[given.node_tree, given.node_start])
    np.add.at(counts, (given.point_tree, given.point_entry), 1)
    np.add.at(sums, (given.point_tree, given.point_entry), parts.points[given.point_tree, given.point_at])
    return counts, sums


def point_entries(parts: Tree, given: Assignment) -> np.ndarray:
    """Entry of every point, (trees, n) in the order of the trees."""
    trees, n, _ = parts.points.shape
    codes = np.zeros(trees * n, np.int64)
    sizes = given.node_end - given.node_start
    shift = np.repeat(given.node_tree * n + given.node_start - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    codes[np.arange(len(shift)) + shift] = np.repeat(given.node_entry, sizes)
    codes[given.point_tree * n + given.point_at] = given.point_entry
    return codes.reshape(trees, n)


# -- on Spark -----------------------------------------------------------------


def _blocks(width: int):
    """Rows (keys, labels, n, order, points): some thousand vectors and the trees over their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _of_size(batches, max(1, min(BLOCK, BLOCK_NUMBERS // (PARTS * width)))):
            n = part.num_rows
            x = scaled_floor(part.column(2), SCALE, MOST, PARTS * width).astype(np.int32)
            points = x.reshape(n, PARTS, width).transpose(1, 0, 2)
            order = tree_order(points, LEAF)
            sorted_points = np.take_along_axis(points, order[:, :, None], axis=1)
            ends = pa.array([0, n], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(ends, part.column(0)), pa.ListArray.from_arrays(ends, part.column(1)),
                pa.array([n], pa.int32()), pa.array([order.astype("<u2").tobytes()], pa.binary()),
                pa.array([sorted_points.astype("<i4").tobytes()], pa.binary()),
            ], names=["keys", "labels", "n", "order", "points"])

    return run


def _of_size(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``; the last may have fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(part.num_rows for part in held) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield whole.slice(0, rows)
            held = [whole.slice(rows)]
    if sum(part.num_rows for part in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, Tree]]:
    for row in range(batch.num_rows):
        n = batch.column("n")[row].as_py()
        points = np.frombuffer(batch.column("points")[row].as_buffer(), "<i4").reshape(PARTS, n, width)
        yield row, Tree.over(points, LEAF)


def _round(codebooks: np.ndarray):
    """Rows (cell, count, sums) of the entries that a task's parts are nearest to."""
    trees, count, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = EntryTree.over(codebooks)
        counts, sums = np.zeros((trees, count), np.int64), np.zeros((trees, count, width), np.int64)
        for batch in batches:
            for _, parts in _trees(batch, width):
                more, totals = entry_totals(parts, assign(parts, entries), count)
                counts += more
                sums += totals
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(cell, pa.int32()), pa.array(counts.ravel()[cell]),
            pa.array(list(sums.reshape(-1, width)[cell]), pa.list_(pa.int64())),
        ], names=["cell", "count", "sums"])

    return run


def improved(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of its parts; entries without parts stay."""
    _, count, width = codebooks.shape
    cells = blocks.mapInArrow(_round(codebooks), "cell int, count bigint, sums array<bigint>")
    totals = cells.groupBy("cell").agg(
        F.sum("count").alias("count"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
    out = codebooks.copy()
    for row in totals.collect():
        out[divmod(row["cell"], count)] = [int(total) // row["count"] for total in row["sums"]]
    return out


def _final(codebooks: np.ndarray, names: list[str]):
    width = codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = EntryTree.over(codebooks)
        for batch in batches:
            for row, parts in _trees(batch, width):
                n = parts.points.shape[1]
                order = np.frombuffer(batch.column("order")[row].as_buffer(), "<u2").reshape(PARTS, n).astype(np.int64)
                sorted_codes = point_entries(parts, assign(parts, entries))
                apart = parts.points - np.take_along_axis(codebooks, sorted_codes[:, :, None], axis=1)
                codes, errors = np.zeros((PARTS, n), np.uint8), np.zeros((PARTS, n), np.int64)
                np.put_along_axis(codes, order, sorted_codes.astype(np.uint8), axis=1)
                np.put_along_axis(errors, order, (apart * apart).sum(axis=2), axis=1)
                spelled = np.ascontiguousarray(codes.T).tobytes().hex()
                yield pa.RecordBatch.from_arrays([
                    batch.column("keys")[row].values, batch.column("labels")[row].values,
                    pa.array([spelled[k: k + 2 * PARTS] for k in range(0, len(spelled), 2 * PARTS)], pa.string()),
                    pa.array(errors.sum(axis=0)),
                ], names=names)

    return run


def fit(kept: DataFrame, blocks: DataFrame, key: str, vector: str, width: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``ROUNDS`` rounds over all blocks.

    They start as the parts of the ``ENTRIES`` vectors with the smallest keys.
    """
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(MOST)), F.lit(-MOST))))
    begin = kept.select(F.col(key).alias("key"), whole.alias("x")).orderBy(F.col("key").asc_nulls_last(), "x").limit(ENTRIES)
    rows = [row["x"] for row in begin.collect()]
    first = np.zeros((len(rows), PARTS * width), np.int64)
    for row, values in zip(first, rows):
        row[: len(values)] = values
    codebooks = np.ascontiguousarray(first.reshape(len(rows), PARTS, width).transpose(1, 0, 2))
    for _ in range(ROUNDS):
        codebooks = improved(blocks, codebooks)
    return codebooks


def compress(df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Per vector: the key, code, error, label_error, codebooks_sha256.

    Rows whose vector is NULL or holds a NULL, NaN or infinite entry are dropped. Every other entry becomes floor(256 * entry),
    at most 2^25 either way; a vector shorter than the longest, or than the next multiple of 16, is filled up with zeros.
    The 64 vectors with the smallest keys give the first codebooks: NULL keys come last, equal keys in the order of
    their vectors; with fewer vectors there are fewer entries. Repeated rows get codes of their own. ``label_error`` adds up
    the errors of one label, NULL being one. Other columns are ignored; an empty table gives an empty result.
    """
    kept = finite_vectors(df, key, label, vector=vector)
    kinds = {name: kept.schema[name].dataType.simpleString() for name in (key, label)}
    found = kept.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("longest")).first()
    result = f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, code string, error bigint"
    if not found["n"]:
        return df.sparkSession.createDataFrame([], result + ", label_error bigint, codebooks_sha256 string").drop(label)
    width = max(1, -(-found["longest"] // PARTS))
    blocks = stage(kept.mapInArrow(
        _blocks(width), f"keys array<{kinds[key]}>, labels array<{kinds[label]}>, n int, order binary, points binary"))
    codebooks = fit(kept, blocks, key, vector, width)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    coded = stage(blocks.mapInArrow(_final(codebooks, [key, label, "code", "error"]), result))
    by_label = stage(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, F.col(label).eqNullSafe(F.col("_label"))).select(
        key, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
