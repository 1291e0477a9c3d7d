"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window is a record whose tokens are its word shingles. Ordered by rarity in the documents, a record that must
be contained whole needs only its first token, the rarest, in the join; the token's place in the window bounds where the
window can begin and end in the document, and the words themselves are compared last.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow
from .ordering import stored
from .names import guarded
from .words import NOT_ALNUM, Words, mixed, slices, texts_of, window_hashes, words_of

#: Bits of the filter of benchmark shingles that every task gets, whatever the size of the benchmark.
FILTER_BITS = 23


def _shingles(words: Words, widths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every shingle of each of the widths, in the order of the words."""
    hashes = words.hashes()
    ahead = np.repeat(words.first[1:], words.counts) - np.arange(len(hashes))
    at = [np.flatnonzero(ahead >= n) for n in widths]
    values = [mixed(window_hashes(hashes, n)[a] + np.uint64(n)) for n, a in zip(widths, at, strict=True) if len(a)]
    if not values:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places = np.concatenate(at)
    order = np.argsort(places, kind="stable")
    return places[order], np.concatenate(values)[order]


def _joined(texts, words: Words, at: int, to: int) -> str:
    data = texts.data
    return b" ".join(data[words.start[i]:words.end[i]].tobytes() for i in range(at, to)).decode("utf-8", "replace")


def benchmark_windows(items: DataFrame, width: int = 10, shingle: int = 3) -> DataFrame:
    """item_id, window (words joined by spaces), length, and a row per shingle: token and place (its word in the window).

    A window is ``width`` consecutive words; an item of fewer words, but not none, is one window. Shingles of a window
    are as wide as ``shingle``, or as the window if that is shorter.
    """
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part.column("text")).lower()
                words = words_of(texts, NOT_ALNUM)
                grams = {n: _shingles(words, [n]) for n in range(1, shingle + 1)}
                rows = []
                for i, item in enumerate(part.column("item_id").to_pylist()):
                    begin, end = int(words.first[i]), int(words.first[i + 1])
                    if item is None or begin == end:
                        continue
                    length = min(width, end - begin)
                    at, values = grams[min(shingle, length)]
                    for w in range(begin, end - length + 1):
                        window = _joined(texts, words, w, w + length)
                        lo, hi = np.searchsorted(at, (w, w + max(1, length - shingle + 1)))
                        rows += [(item, window, length, int(v), int(p) - w) for p, v in zip(at[lo:hi], values[lo:hi].view(np.int64), strict=True)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [part.schema.field("item_id").type, pa.string(), pa.int32(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item_id", "window", "length", "token", "place"])

    kind = items.schema["item_id"].dataType.simpleString()
    return map_arrow(items.select("item_id", "text"), run, f"item_id {kind}, window string, length int, token long, place int")


def token_filter(tokens: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of two probes over the column ``token``, as bytes: 2^bits bits whatever the number of tokens."""
    n = (1 << bits) - 1
    probes = F.explode(F.array(F.col("token").bitwiseAND(F.lit(n)), F.shiftrightunsigned("token", 32).bitwiseAND(F.lit(n)))).alias("bit")
    words = tokens.select(probes).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"))
    found = words.toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    n = np.uint64(len(table) - 1)
    return table[values & n] & table[(values >> np.uint64(32)) & n]


def frequencies(docs: DataFrame, table: np.ndarray, widths: Sequence[int]) -> DataFrame:
    """token, n: occurrences in all documents of the shingles that pass the filter, counted in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                _, values = _shingles(words_of(texts_of(part.column("text")).lower(), NOT_ALNUM), widths)
                found, n = np.unique(values[_passes(shared.value, values)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["token", "n"])

    return map_arrow(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def hits(docs: DataFrame, table: np.ndarray, widths: Sequence[int], width: int = 10) -> DataFrame:
    """__row, doc_id, n_words and __hits: the shingles that pass the filter, with the words around them.

    A hit is (token, at, around): ``around`` is the words from ``width`` - 1 before the shingle to as many after it,
    joined by spaces, and ``at`` the first word's place in the document; before that word the document may go on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    shape = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.string())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part.column("text")).lower()
                words = words_of(texts, NOT_ALNUM)
                at, values = _shingles(words, widths)
                keep = np.flatnonzero(_passes(shared.value, values))
                found: list[list] = [[] for _ in range(part.num_rows)]
                owners = np.searchsorted(words.first, at[keep], "right") - 1
                for p, v, i in zip(at[keep].tolist(), values[keep].view(np.int64).tolist(), owners.tolist(), strict=True):
                    begin = max(int(words.first[i]), p - width + 1)
                    end = min(int(words.first[i + 1]), p + width + max(widths) - 1)
                    found[i].append({"token": v, "at": begin - int(words.first[i]), "before": p - begin, "around": _joined(texts, words, begin, end)})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(found, shape)], names=["doc_id", "n_words", "__hits"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, __hits array<struct<token: long, at: long, before: int, around: string>>",
    ).withColumn("__row", F.monotonically_increasing_id())


def _occurrences(docs: DataFrame, items: DataFrame, width: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Item windows, scanned documents, and the occurrences (__row, window, span) of the windows in them."""
    windows = stored(benchmark_windows(items, width, shingle), "benchmark-windows")
    tokens = windows.select("token").distinct()
    # Windows shorter than a shingle are looked for by their own width.
    widths = [shingle, *sorted(r[0] for r in windows.filter(F.col("length") < shingle).select("length").distinct().collect())]
    counts = stored(frequencies(docs, token_filter(tokens), widths), "shingle-counts")
    rarity = windows.select("window", "length", "token", "place").distinct().join(counts, "token", "left")
    # The first token in order of rarity; windows with a shingle that no document has need no join.
    first = rarity.groupBy("window", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("first"))
    prefix = stored(
        first.filter("first.n > 0").select("window", "length", F.col("first.token").alias("token"), F.col("first.place").alias("place")), "window-prefixes",
    )
    rows = stored(hits(docs, token_filter(prefix), widths, width), "document-hits")
    around = F.split("around", " ")
    begin = F.col("before") - F.col("place")
    joined = (
        rows.select("__row", F.explode("__hits").alias("hit")).select("__row", "hit.*").join(prefix, "token")
        # Positional and length bounds before any words are compared.
        .filter((begin >= 0) & (begin + F.col("length") <= F.size(around)))
        .filter(F.array_join(F.slice(around, begin + 1, F.col("length")), " ") == F.col("window"))
        .select("__row", "window", F.struct((F.col("at") + begin).alias("start"), (F.col("at") + begin + F.col("length")).alias("end")).alias("span"))
    )
    return windows, rows, stored(joined, "window-occurrences")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 3) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as text), spans (word ranges), contaminated.

    A document word is hit if it lies in an occurrence of any window of an item. Words are runs of ASCII letters and
    digits and of non-ASCII characters, A-Z lower-cased. Null texts have no words; items without id or words are left
    out; repeated items count once; repeated documents each give a row. Empty tables: no item, no hit; no document, no
    row. Columns other than doc_id, text and item_id are not read.
    """
    windows, rows, joined = _occurrences(docs, items, width, shingle)
    cover = F.aggregate(
        F.array_sort(F.collect_set("span")), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    spans = joined.groupBy("__row").agg(cover.alias("n_hit"), F.array_sort(F.collect_set("span")).alias("spans"))
    owners = windows.select("window", F.col("item_id").cast("string").alias("item")).distinct()
    found = joined.select("__row", "window").distinct().join(owners, "window").groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return (
        rows.select("__row", "doc_id", "n_words").join(spans, "__row", "left").join(found, "__row", "left").select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


@guarded
def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 3) -> DataFrame:
    """The documents without any hit, all columns kept. A document is told by its doc_id (null is one) and text."""
    keyed = docs.withColumn("__tie", F.hash("text"))
    # The scan passes its doc_id on; here that is the id together with the text's hash.
    marked = keyed.select(F.struct("doc_id", "__tie").alias("doc_id"), "text")
    _, rows, joined = _occurrences(marked, items, width, shingle)
    hit = rows.join(joined.select("__row").distinct(), "__row", "left_semi").select(F.col("doc_id.doc_id").alias("__doc"), F.col("doc_id.__tie").alias("__own"))
    # Stored first, so that its size is known where it is joined: as long as it is small, no text is shuffled.
    hit = stored(hit.distinct(), "hit-documents")
    return keyed.join(hit, F.expr("doc_id <=> __doc AND __tie <=> __own"), "left_anti").select(*[f"`{c}`" for c in docs.columns])
