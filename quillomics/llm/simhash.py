"""Near-duplicate detection by SimHash, with tables of distances to pivot fingerprints.

Every distinct document gets the Hamming distances of its fingerprint to a set of reference fingerprints, one per segment
of the 64 bits; their sum over the segments is the distance to the whole reference. Fingerprints that agree in a segment
have the same coordinates there, so candidates are documents that agree in all coordinates of some ``agree`` segments.
With ``radius`` + ``agree`` segments none within the radius is missed. Candidates whose whole distances differ by more
than the radius to any reference are discarded, and the rest are verified bit by bit.

Several fingerprints per document (the same shingles, other bits) make longer ones, whose radius holds for all bits
together. Near copies of a similarity well below 1 differ in too many bits to share segments: there candidates are
documents that agree in a band of least shingle hashes, bits discard, and the sets of shingles decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .arrow import map_arrow, with_text_columns
from .components import components
from .ordering import stored
from .names import guarded
from .words import BLANKS, Words, mixed, texts_of, words_of

BITS = 64
SEED = 42
#: Reference fingerprints.
PIVOTS = 12
#: Fingerprints of one candidate group that are compared at once; larger groups are compared block by block.
BLOCK = 1024
#: Shingles of one such block, and those that are looked up at once.
BLOCK_SHINGLES = 1 << 19
COMPARED = 1 << 20


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: scrambled whole numbers, as signed 64-bit."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist()


def segments(n: int) -> list[int]:
    """Masks of n runs of bits of about equal length, as signed 64-bit."""
    cuts = [BITS * i // n for i in range(n + 1)]
    masks = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _spaced(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words joined by single spaces, with the first byte of each word and the byte after it."""
    sizes = words.end - words.start
    start = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int(sizes.sum() + len(sizes)), 0x20, np.uint8)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(start, sizes) + inner] = words.texts.data[np.repeat(words.start, sizes) + inner]
    return out.tobytes(), start, start + sizes


def _shingles(part: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    """Per text, XXH64 of the shingles of blank-separated words of its lower-cased form, repeats included.

    A text of fewer than ``shingle`` words is one shingle; a text without words, or null, has none.
    """
    words = words_of(texts_of(part.column("text")).lower(), BLANKS)
    data, start, end = _spaced(words)
    digest = xxhash.xxh64_intdigest
    for i in range(part.num_rows):
        a, b = int(words.first[i]), int(words.first[i + 1])
        last = max(a + 1, b - shingle + 1) if a < b else a
        spans = zip(start[a:last].tolist(), end[min(a + shingle, b) - 1:b].tolist(), strict=True) if a < b else ()
        yield np.array([digest(data[s:e], SEED) for s, e in spans], np.uint64)


def _prints(hashes: np.ndarray, seeds: np.ndarray) -> list[int]:
    """Fingerprints of some hashes: a bit is set if it is in over half of them, for all but the first of their scrambles."""
    out = []
    for t, seed in enumerate(seeds):
        bits = mixed(hashes ^ seed) if t else hashes
        ones = np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(bits), bitorder="little").view(np.int64)[0])
    return out


def _seeds(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _lists(flat: np.ndarray, sizes: Sequence[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))


def fingerprints(docs: DataFrame, shingle: int = 3, prints: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Adds ``prints`` (array of ``prints`` longs) of the lower-cased text's shingles of blank-separated words.

    A bit is set if it is in over half of the shingles' hashes, repeats included: their XXH64 for the first fingerprint,
    scrambles of it for more. A text of fewer than ``shingle`` words is one shingle; a text without words, or null, has
    all bits 0.
    """
    seeds = _seeds(prints)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        out = np.zeros((part.num_rows, prints), np.int64)
        for i, hashes in enumerate(_shingles(part, shingle)):
            if len(hashes):
                out[i] = _prints(hashes, seeds)
        return [_lists(out.ravel(), [prints] * part.num_rows)]

    return with_text_columns(docs, [("prints", ArrayType(LongType()))], work, keep=keep)


def _band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band from the least of ``rows`` scrambles of the hashes: two sets agree in a band with a probability
    of their Jaccard similarity to the power of ``rows``."""
    least = np.array([mixed(hashes ^ seed).min() for seed in mixed(_seeds(bands * rows + 1)[1:])]).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for column in least.T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return key


def sketches(docs: DataFrame, shingle: int, prints: int, bands: int, rows: int, keep: list[str]) -> DataFrame:
    """Adds node (a hash of the text's set of shingles), size (of that set), ``prints`` fingerprints of the set and its
    candidate keys (none without shingles).

    Here a shingle counts once however often a text repeats it, as in the Jaccard similarity.
    """
    seeds = _seeds(prints)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        out = np.zeros((part.num_rows, prints), np.int64)
        keys = np.zeros((part.num_rows, bands), np.uint64)
        node, size = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.int64)
        for i, hashes in enumerate(_shingles(part, shingle)):
            once = np.unique(hashes)
            node[i], size[i] = xxhash.xxh64_intdigest(once.tobytes(), SEED), len(once)
            if len(once):
                out[i] = _prints(once, seeds)
                keys[i] = _band_keys(once, bands, rows)
        keys = keys[size > 0].ravel().view(np.int64)
        lists = _lists(out.ravel(), [prints] * part.num_rows), _lists(keys, np.where(size > 0, bands, 0))
        return [pa.array(node.view(np.int64)), pa.array(size), *lists]

    longs = ArrayType(LongType())
    return with_text_columns(docs, [("node", LongType()), ("size", LongType()), ("prints", longs), ("bands", longs)], work, keep=keep)


def shingle_sets(docs: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """Adds ``shingles``, the sorted distinct hashes of the text's shingles, as unsigned numbers in longs."""

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        sets = [np.unique(h) for h in _shingles(part, shingle)]
        return [_lists(np.concatenate(sets).view(np.int64), [len(x) for x in sets])]

    return with_text_columns(docs, [("shingles", ArrayType(LongType()))], work, keep=keep)


def _coordinates(fingerprint: Column, mask: int) -> Column:
    """Distances of one segment to all pivots, four bits each: a segment has at most 15 bits."""
    packed = F.lit(0).cast("long")
    for i, pivot in enumerate(pivots()):
        distance = F.bit_count(fingerprint.bitwiseXOR(F.lit(pivot)).bitwiseAND(F.lit(mask)))
        packed = packed.bitwiseOR(F.shiftleft(distance.cast("long"), 4 * i))
    return packed


def candidate_keys(nodes: DataFrame, n_segments: int, agree: int) -> DataFrame:
    """key, node: one key per fingerprint and choice of ``agree`` segments, from the coordinates of these segments."""
    parts = segments(n_segments)
    names = [f"s{i}" for i in range(n_segments)]
    table = nodes.select("node", F.posexplode("prints").alias("which", "print"))
    table = table.select("node", "which", *[_coordinates(F.col("print"), m).alias(n) for n, m in zip(names, parts, strict=True)])
    keys = [F.xxhash64("which", F.lit(k), *chosen) for k, chosen in enumerate(combinations(names, agree))]
    return table.select("node", F.explode(F.array(*keys)).alias("key"))


class _Sets:
    """Sorted sets of numbers, one per member, that are compared pair by pair."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray):
        numbers, ids = np.unique(values, return_inverse=True)
        self.sizes, self.first, self.ids, self.n = sizes, np.cumsum(sizes) - sizes, ids.astype(np.int64), len(numbers)
        self.places = np.repeat(np.arange(len(sizes)), sizes) * self.n + self.ids  # ascending

    def alike(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the Jaccard similarity of the sets of members a and b is at least ``similarity``; no set is empty."""
        out = np.zeros(len(a), bool)
        near = np.minimum(self.sizes[a], self.sizes[b]) / np.maximum(self.sizes[a], self.sizes[b]) >= similarity
        todo = np.flatnonzero(near)
        ends = np.cumsum(self.sizes[a[todo]])
        at = 0
        while at < len(todo):  # runs of about COMPARED numbers
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right")))
            x, y = a[todo[at:to]], b[todo[at:to]]
            sizes = self.sizes[x]
            starts = np.cumsum(sizes) - sizes
            own = np.arange(int(sizes.sum())) + np.repeat(self.first[x] - starts, sizes)
            asked = np.repeat(y * self.n, sizes) + self.ids[own]
            found = self.places[np.minimum(np.searchsorted(self.places, asked), len(self.places) - 1)] == asked
            common = np.add.reduceat(found, starts, dtype=np.int64)
            out[todo[at:to]] = common / (sizes + self.sizes[y] - common) >= similarity
            at = to
        return out


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest member of a class, after the classes of a and b became one."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        low = np.minimum(x, y)
        label = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(label, up := label[label]):
            label = up


def _stars(groups: np.ndarray, prints: np.ndarray, radius: int, sets: _Sets | None = None, similarity: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal groups as (member, smallest member it is linked with through the run).

    ``prints`` has a row per member and a column per fingerprint. With ``sets``, pairs within the radius are linked only if
    their sets are similar enough; pairs that are linked through others already are not compared.
    """
    table = [np.bitwise_count(prints ^ np.uint64(p % (1 << BITS))).sum(1, dtype=np.int32) for p in pivots()]
    left, right = [], []
    n = len(groups)
    begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    ends = np.append(begins[1:], n)
    stops = np.repeat(ends, ends - begins)
    active = np.arange(n)
    label = np.arange(n)
    for step in range(1, n):
        active = active[active + step < stops[active]]
        if not len(active):
            break
        a = active if sets is None else active[label[active] != label[active + step]]
        for distances in table:  # largest difference of a coordinate
            a = a[np.abs(distances[a] - distances[a + step]) <= radius]
        a = a[np.bitwise_count(prints[a] ^ prints[a + step]).sum(1, dtype=np.int32) <= radius]
        if sets is None:
            left.append(a)
            right.append(a + step)
        elif len(a := a[sets.alike(a, a + step, similarity)]):
            label = _merged(label, a, a + step)
    if left:
        label = _merged(label, np.concatenate(left), np.concatenate(right))
    members = np.flatnonzero(label != np.arange(n))
    return members, label[members]


def _in_blocks(rows: DataFrame, key: str, n: Column) -> DataFrame:
    """key, i, j and the other columns: a row for each pair of the ``n`` blocks of its key that has the node's block."""
    others = [c for c in rows.columns if c != key]
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return rows.select(key, *others, F.explode(pairs).alias("p")).select(F.col(key).alias("key"), "p.i", "p.j", *others)


def _links_in(rows: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """Edges (a, b) of rows (key, i, j, node, prints) within each key, i and j; with ``similarity``, rows have shingles too."""
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def run(batches):
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.table(batch)]).combine_chunks() if held is not None else pa.table(batch)
            ids = [held.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in ids]))
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            yield from found(held.slice(0, last), np.cumsum(new[:last]))
            held = held.slice(last)
        if held is not None:
            yield from found(held, np.zeros(len(held), np.int64))

    def found(rows, groups):
        if len(rows) < 2:
            return
        prints = rows.column("prints").combine_chunks()
        node = rows.column("node").to_numpy()
        sets = None
        if similarity is not None:
            shingles = rows.column("shingles").combine_chunks()
            sets = _Sets(shingles.value_lengths().to_numpy().astype(np.int64), shingles.flatten().to_numpy().view(np.uint64))
        a, b = _stars(groups, prints.flatten().to_numpy().view(np.uint64).reshape(len(rows), -1), radius, sets, similarity)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return map_arrow(rows, run, "a long, b long")


def links(nodes: DataFrame, radius: int, n_segments: int, agree: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between nodes (node, prints) that join the same ones as all candidate pairs within the radius would.

    Each candidate group gives at most one edge per member. A group of more than ``block`` nodes is split into blocks,
    and every pair of blocks is compared by itself, so no pair is left out and no step holds more than two blocks.
    """
    return _links_by(candidate_keys(nodes, n_segments, agree), nodes, radius, block)


def _links_by(keys: DataFrame, nodes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """``links`` among the nodes that share a key of ``keys`` (key, node)."""
    sizes = stored(keys.groupBy("key").count().filter("count > 1"), "candidate-keys")
    n = F.expr(f"cast((count + {block - 1}) div {block} AS int)")
    rows = _in_blocks(keys.join(sizes, "key").select("key", "node", "count"), "key", n)
    return _links_in(rows.join(nodes.select("node", "prints"), "node").select("key", "i", "j", "node", "prints"), radius)


def similar(members: DataFrame, radius: int, similarity: float, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges (a, b) that join the same nodes as all pairs of one root with a Jaccard similarity of at least ``similarity`` would.

    ``members`` has root, node, size, prints and shingles. Every two members of a root are compared, unless the radius
    rules them out or others link them already; a root is split into blocks of about ``block`` nodes or ``shingles`` shingles.
    """
    sums = members.groupBy("root").agg(F.count("*").alias("count"), F.sum("size").alias("total"))
    n = F.expr(f"cast(greatest((count + {block - 1}) div {block}, (total + {shingles - 1}) div {shingles}) AS int)")
    rows = _in_blocks(members.drop("size").join(stored(sums, "root-sizes"), "root"), "root", n)
    return _links_in(rows.select("key", "i", "j", "node", "prints", "shingles"), radius, similarity)


def _classes(rows: DataFrame, radius: int, n_segments: int, agree: int) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes of rows (node, prints, ...), and root and node of those that are linked."""
    nodes = stored(rows.groupBy("node").agg(F.first("prints").alias("prints")), "distinct-fingerprints")
    return nodes, components(links(nodes, radius, n_segments, agree))


def _salted(df: DataFrame, salt: int) -> DataFrame:
    return df.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, agree: int = 3, salt: int = 16) -> DataFrame:
    """Per document: doc_id, fingerprint (long), component_id, the smallest doc_id that links within the radius reach.

    Equal fingerprints count once in the search for links. Repeated rows and texts are linked by their fingerprints; a
    null doc_id never is a component's id unless all its documents lack one. Columns other than doc_id and text are
    not read. An empty table gives no rows. A fingerprint that many documents share is joined in ``salt`` parts.
    """
    rows = fingerprints(docs, shingle, keep=["doc_id"]).withColumn("node", F.col("prints")[0])
    rows = stored(rows, "fingerprints")
    _, roots = _classes(rows, radius, radius + agree, agree)
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    placed = least.join(roots, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).filter("size > 1")
    several = placed.select(F.col("node").alias("__node"), "root").join(ids, "root").select("__node", "component_id")
    return (
        rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(salt)).cast("int"))
        .join(_salted(several, salt), F.expr("node = __node AND __salt = __part"), "left")
        .select("doc_id", F.col("node").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


@guarded
def distinct_documents(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, prints: int = 8, bands: int = 16, rows: int = 4, salt: int = 16,
) -> DataFrame:
    """The rows that stay when of each group of near-duplicates only one does: the smallest doc_id (null last), then
    the smallest text hash; of equal rows one.

    Documents are linked if the Jaccard similarity of their sets of shingles is at least ``similarity``. Compared are those
    that candidates chain together: pairs that agree in one of ``bands`` keys of ``rows`` least hashes (at 0.8, all but
    0.0002 of them) and whose bits differ by no more than a quarter over what is expected at that similarity and five
    standard deviations; the quarter is for sets of few shingles. Documents without words are one group. All columns
    stay; an empty table stays empty.
    """
    share = 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = math.ceil(prints * BITS * share + 5 * math.sqrt(prints * BITS * share * (1 - share)))
    names = docs.columns
    keyed = docs.withColumn("__tie", F.xxhash64("text"))
    slim = stored(sketches(keyed, shingle, prints, bands, rows, keep=["doc_id", "__tie"]), "fingerprints")
    one = F.min(F.struct("doc_id", "__tie")).alias("one")
    nodes = stored(slim.groupBy("node").agg(F.first("size").alias("size"), F.first("prints").alias("prints"), F.first("bands").alias("bands"), one), "distinct-fingerprints")
    near = components(_links_by(nodes.select("node", F.explode("bands").alias("key")), nodes, radius))
    # Stored first, so that its size is known where it is joined: as long as it is small, no text is shuffled.
    members = nodes.join(near, "node").select(F.col("one.doc_id").alias("__doc"), F.col("one.__tie").alias("__own"), "root", "node", "size", "prints")
    members = stored(members, "candidate-members")
    texts = keyed.select("doc_id", "__tie", "text").join(members, F.expr("doc_id <=> __doc AND __tie <=> __own"))
    members = stored(shingle_sets(texts, shingle, ["root", "node", "size", "prints"]), "shingle-sets")
    roots = components(similar(members, radius, similarity))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__tie")
    first = slim.groupBy("node").agg(F.min(rank).alias("rank"), F.count("*").alias("n"))
    placed = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min("rank").alias("head"), F.sum("n").alias("size")).filter("size > 1")
    heads = placed.select(F.col("node").alias("__node"), "root").join(heads, "root").select("__node", "head")
    lost = (
        slim.withColumn("__salt", F.pmod("__tie", F.lit(salt)).cast("int"))
        .join(_salted(heads, salt), F.expr("node = __node AND __salt = __part"))
    )
    is_head = F.expr("doc_id <=> head.doc_id AND __tie <=> head.__tie")
    drop = stored(lost.filter(~is_head).select(F.col("doc_id").alias("__doc"), F.col("__tie").alias("__own")).distinct(), "near-copies")
    kept = keyed.join(drop, F.expr("doc_id <=> __doc AND __tie <=> __own"), "left_anti")
    again = slim.groupBy("doc_id", "__tie").count().filter("count > 1").select(F.col("doc_id").alias("__doc"), F.col("__tie").alias("__own"))
    again = stored(again, "repeated-rows")
    if again.head(1):  # equal rows of the same doc_id: one of them
        same = F.expr("doc_id <=> __doc AND __tie <=> __own")
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__tie"]))
    return kept.select(*[f"`{c}`" for c in names])
