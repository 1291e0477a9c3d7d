"""Vector code compression: codebooks of vector parts, improved by a dual-tree Lloyd iteration.

Vectors are cut into equal parts. In each task the parts of a batch form a tree of boxes with cached counts and sums, the
entries of a codebook form another one. Pairs of nodes are followed from both roots: a pair whose boxes are further apart
than a node's surest entry is dropped, a node for which one entry is left is assigned whole, with its cached sums, and
only parts in leaves with several entries left are compared one by one, in whole numbers. Box distances are whole numbers
too, so the assignment is exactly that of comparing everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow
from .centroids import is_whole
from .ordering import stored

#: Vectors of one tree, and parts in one of its leaves.
BLOCK = 4096
LEAF = 8
#: Numbers of one comparison at once.
COMPARED = 1 << 17
#: Up to these absolute values a squared difference fits 32 bits, and a sum of them beside an index 64 bits; larger
#: components are compared as Python integers.
SMALL, PLAIN = 1 << 14, 1 << 20
SALT = 16


@dataclass
class Tree:
    """Boxes of points in a balanced split order. Level by level, node j of a level spans bounds[level][j:j + 2]."""

    order: np.ndarray
    points: np.ndarray
    bounds: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.bounds) - 1


def tree_of(points: np.ndarray, leaf: int) -> Tree:
    """A tree over the rows of ``points``: each node is cut in halves along its widest dimension."""
    n = len(points)
    order, bounds = np.arange(n), [np.array([0, n])]
    low, high = [], []
    while True:
        at = bounds[-1]
        ordered = points[order]
        low.append(np.minimum.reduceat(ordered, at[:-1], axis=0))
        high.append(np.maximum.reduceat(ordered, at[:-1], axis=0))
        if np.diff(at).max() <= leaf:
            return Tree(order, ordered, bounds, low, high)
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        widest = np.argmax(high[-1] - low[-1], axis=1)
        along = ordered[np.arange(n), widest[node]]
        rank = np.empty(n, np.int64)
        rank[np.argsort(along, kind="stable")] = np.arange(n)
        order = order[np.lexsort((rank, node))]
        middle = (at[:-1] + at[1:] + 1) // 2
        bounds.append(np.unique(np.concatenate((at, middle))))


def _children(bounds: list[np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray]:
    """First child of every node of a level, and how many it has (one or two)."""
    first = np.searchsorted(bounds[level + 1], bounds[level])
    return first[:-1], np.diff(first)


def _expand(first: np.ndarray, count: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All children of nodes, and ``keep`` repeated with them."""
    times = count
    places = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(first, times) + places, np.repeat(keep, times)


def _near_far(a_low, a_high, b_low, b_high) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances between points of two boxes, for rows of boxes."""
    gap = np.maximum(np.maximum(a_low - b_high, b_low - a_high), 0)
    span = np.maximum(a_high - b_low, b_high - a_low)
    kind = np.int64 if gap.dtype != object else object
    return (gap * gap).sum(axis=1, dtype=kind), (span * span).sum(axis=1, dtype=kind)


def assign(data: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of every point (in tree order), ties to the lower index, and which points came with whole nodes.

    ``entries`` has one entry in each leaf. Also returns (node start, node end, entry) rows of the whole nodes.
    """
    n = len(data.points)
    code, whole = np.full(n, -1, np.int64), []
    d_level = e_level = 0
    d, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        # Pairs stay sorted by data node, so each node's pairs are a run.
        keep = np.ones(len(d), bool)
        parts = [slice(i, i + COMPARED // data.points.shape[1]) for i in range(0, len(d), COMPARED // data.points.shape[1])]
        bounds = [
            _near_far(data.low[d_level][d[s]], data.high[d_level][d[s]], entries.low[e_level][e[s]], entries.high[e_level][e[s]]) for s in parts
        ]
        near, far = (np.concatenate(x) for x in zip(*bounds, strict=True))
        run = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        size = np.diff(np.append(run, len(d)))
        keep = near <= np.repeat(np.minimum.reduceat(far, run), size)
        d, e = d[keep], e[keep]
        if e_level == entries.depth:
            run = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            size = np.diff(np.append(run, len(d)))
            sure = run[size == 1]
            at, entry = data.bounds[d_level], entries.order[e[sure]]
            for a, b, c in zip(at[d[sure]].tolist(), at[d[sure] + 1].tolist(), entry.tolist(), strict=True):
                code[a:b] = c
                whole.append((a, b, c))
            rest = np.repeat(size > 1, size)
            d, e = d[rest], e[rest]
        if not len(d):
            break
        # The side with the wider boxes is opened, the entries' first while it has levels left.
        if e_level < entries.depth and (d_level == data.depth or e_level <= d_level):
            first, count = _children(entries.bounds, e_level)
            e, d = _expand(first[e], count[e], d)
            e_level += 1
        elif d_level < data.depth:
            first, count = _children(data.bounds, d_level)
            # A node's pairs are repeated for each child, then sorted by child.
            child, e = _expand(first[d], count[d], e)
            by = np.lexsort((e, child))
            d, e, d_level = child[by], e[by], d_level + 1
        else:
            break
    if len(d):
        _compare(data, entries, d, e, code)
    return code, np.array(whole, np.int64).reshape(-1, 3), code[data.order.argsort()]


def _compare(data: Tree, entries: Tree, d: np.ndarray, e: np.ndarray, code: np.ndarray) -> None:
    """Compares every point of the leaves ``d`` with their entries ``e``, in whole numbers; pairs are sorted by leaf."""
    at = data.bounds[-1]
    run = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    leaf, choices = d[run], np.diff(np.append(run, len(d)))
    point, run = _expand(at[leaf], at[leaf + 1] - at[leaf], run)
    _, choices = _expand(at[leaf], at[leaf + 1] - at[leaf], choices)
    index = entries.order[e]
    total = np.concatenate(([0], np.cumsum(choices)))
    most, n = max(1, COMPARED // data.points.shape[1]), len(entries.order)
    begin = 0
    while begin < len(point):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, "right")) - 1)
        pair, of = _expand(run[begin:end], choices[begin:end], point[begin:end])
        gap = data.points[of] - entries.points[e[pair]]
        gap *= gap
        # Distance and index in one number: the least one is the nearest, ties to the lower index.
        key = gap.sum(axis=1, dtype=np.int64 if gap.dtype != object else object) * n + index[pair]
        code[point[begin:end]] = np.minimum.reduceat(key, total[begin:end] - total[begin]) % n
        begin = end


def _whole(values: np.ndarray) -> np.ndarray:
    """Whole-valued floats as integers whose squared differences fit: of 32 or 64 bits, or else Python's."""
    most = np.abs(values).max() if values.size else 0
    for limit, kind in ((SMALL, np.int32), (PLAIN, np.int64)):
        if most <= limit:
            return values.astype(kind)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


class Codebooks:
    """Entries by part position: ``books[p][i]`` is a list of Python integers."""

    def __init__(self, books: list[list[list[int]]]):
        self.books = books

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()

    def entries(self, p: int) -> np.ndarray:
        small = all(abs(x) <= PLAIN for entry in self.books[p] for x in entry)
        return _whole(np.array(self.books[p], float)) if small else np.array(self.books[p], object)


def _same_kind(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = max(points.dtype, book.dtype, key=[np.dtype(k) for k in (np.int32, np.int64, object)].index)
    return points.astype(kind), book.astype(kind)


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most BLOCK rows with their vectors as a table of floats."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, np.array(part.column(column).flatten(), float).reshape(part.num_rows, -1)


def _placed(values: np.ndarray, p: int, books: Codebooks) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray]:
    """The tree over the parts at position p, codes in tree order, whole nodes, and codes in row order."""
    width = values.shape[1] // len(books.books)
    points, book = _same_kind(_whole(values[:, p * width:(p + 1) * width]), books.entries(p))
    tree = tree_of(points, LEAF)
    return tree, *assign(tree, tree_of(book, 1))


def _sums(tree: Tree, code: np.ndarray, whole: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the points of each entry: whole nodes from the tree's running sums, other points one by one."""
    width = tree.points.shape[1]
    kind = object if tree.points.dtype == object else np.int64
    count, total = np.zeros(size, np.int64), np.zeros((size, width), kind)
    left = np.ones(len(code), bool)
    if len(whole):
        running = np.concatenate((np.zeros((1, width), kind), np.cumsum(tree.points, axis=0, dtype=kind)))
        np.add.at(total, whole[:, 2], running[whole[:, 1]] - running[whole[:, 0]])
        np.add.at(count, whole[:, 2], whole[:, 1] - whole[:, 0])
        for a, b, _ in whole.tolist():
            left[a:b] = False
    np.add.at(total, code[left], tree.points[left])
    np.add.at(count, code[left], 1)
    return count, total


def _improved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """Entries moved to the floor of the mean of their parts. A task passes on one row per position and entry at most."""
    parts, size, width = len(books.books), len(books.books[0]), len(books.books[0][0])
    names = [f"s{i}" for i in range(width)]
    schema = ", ".join(["position int", "entry int", "n long", *(f"{c} decimal(38,0)" for c in names)])
    number = pa.decimal128(38, 0)

    def run(batches):
        count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), object)
        for _, values in _blocks(batches, "values"):
            for p in range(parts):
                tree, code, whole, _ = _placed(values, p, books)
                n, s = _sums(tree, code, whole, size)
                count[p] += n
                total[p] += s.astype(object)
        p, i = np.nonzero(count)
        if len(p):
            columns = [pa.array([Decimal(int(x)) for x in total[p, i, k]], number) for k in range(width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(i, pa.int32()), pa.array(count[p, i]), *columns], names=["position", "entry", "n", *names],
            )

    moved = map_arrow(kept.select("values"), run, schema)
    moved = moved.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    out = [[list(entry) for entry in book] for book in books.books]
    for r in moved.collect():  # one row per position and entry
        out[r["position"]][r["entry"]] = [int(r[c]) // r["n"] for c in names]
    return Codebooks(out)


def _coded(kept: DataFrame, books: Codebooks) -> DataFrame:
    """code and error of every vector."""
    def run(batches):
        for part, values in _blocks(batches, "values"):
            text, error = np.full(part.num_rows, "", object), np.zeros(part.num_rows, object)
            for p in range(len(books.books)):
                tree, _, _, code = _placed(values, p, books)
                points = np.empty_like(tree.points)
                points[tree.order] = tree.points
                gap = points - _same_kind(points, books.entries(p))[1][code]
                error += (gap * gap).sum(axis=1, dtype=np.int64 if gap.dtype != object else object).astype(object)
                text += np.array([f"{c:02x}" for c in code.tolist()], object)
            fitting = pa.array([int(x) if x < 1 << 63 else None for x in error], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), pa.array(text, pa.string()), fitting], names=["vec_id", "label", "code", "error"],
            )

    fields = {f.name: f for f in kept.schema}
    schema = "vec_id {}, label {}, code string, error long".format(*(fields[c].dataType.simpleString() for c in ("vec_id", "label")))
    return map_arrow(kept.select("vec_id", "label", "values"), run, schema)


def learn(kept: DataFrame, parts: int = 4, size: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks that start as the parts of the ``size`` smallest ids and move ``rounds`` times; None without vectors.

    ``kept`` has vec_id and values (whole-valued doubles). Repeated ids follow the order of their values.
    """
    first = [r[0] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(size).select("values").collect()]
    if not first:
        return None
    width = len(first[0]) // parts
    books = Codebooks([[[int(x) for x in v[p * width:(p + 1) * width]] for v in first] for p in range(parts)])
    for _ in range(rounds):
        books = _improved(kept, books)
    return books


def compress(vectors: DataFrame, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024, salt: int = SALT) -> DataFrame:
    """Codes of all vectors against codebooks learned from them.

    Reads vec_id, embedding and label; other columns, whatever their names, are not read. Returns vec_id, label, code
    (two hex digits per part), error long (squared distances of the parts to their entries), label_error long (over rows
    of the same label, nulls together) and codebooks_sha256. Rows with a null vector or a null, NaN or infinite component
    give no row. The vector with the smallest id sets the length: one of another length, or all if it cannot be cut into
    ``parts``, have a null code and error and take no part in learning. Repeated rows count each; a null vec_id sorts last.
    Fewer than ``size`` vectors give smaller codebooks, none an empty result. An error that fits no long is null.
    """
    if size > 256:
        raise ValueError("an entry's index has two hex digits")
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    exact = F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)))
    # Beyond 2^52 a double is whole already; floor() would be cut off at the limits of a long.
    values = F.zip_with(whole, exact, lambda a, b: F.when(F.abs(b) < float(1 << 52), a).otherwise(b))
    rows = stored(vectors.filter(is_whole(F.col("embedding"))).select("vec_id", "label", values.alias("values")), "vectors")
    length = rows.orderBy(F.col("vec_id").asc_nulls_last(), "values").select(F.size("values")).first()
    fits = F.lit(False) if length is None or length[0] % parts or not length[0] else F.size("values") == length[0]
    fits = fits & F.forall("values", lambda x: F.abs(x) < float("inf"))
    kept = rows.filter(fits)
    books = learn(kept, parts, size, rounds)
    missing = rows.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = stored(missing if books is None else _coded(kept, books).unionByName(missing), "codes")
    # A label may hold a third of all rows: its error is added up per task first, and joined in parts.
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    by_label = by_label.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    spread = coded.withColumn("__part2", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salt)).cast("int"))
    joined = spread.join(by_label, (F.col("__part2") == F.col("__part")) & F.col("label").eqNullSafe(F.col("__label")))
    return joined.select(
        "vec_id", "label", "code", "error", F.col("label_error").try_cast("bigint").alias("label_error"),
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )
