"""Substring dedup with repeated-phrase automata.

Recurring passages are confirmed by counts over all documents, and one example of each kind is taken. Passages are
dealt into shards, each compiled into Aho-Corasick automata, and all stretches of documents that may hold a shard's
passages are streamed through them to locate every occurrence, word by word.

Counting all windows of a corpus would move more data than the corpus has, so windows are counted by content-defined
samples first. Of the word n-grams in a window the one with the smallest hash is its anchor: equal windows have equal
anchors, so a window recurs only if its anchor does. Consecutive windows with the same anchor form a region. If an
anchor has one kind of region only, all its windows recur with it; else the windows of one example per kind are counted.
Regions are also what is streamed: one whose anchor is met once holds no recurring window, and goes nowhere.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType

from .arrow import map_arrow, with_text_columns
from .ordering import discard, stored
from .names import guarded
from .words import BLANKS, Words, mixed, slices, texts_of, window_hashes, words_of

#: Words of the n-grams that anchors are chosen from.
GRAM = 8
#: Distinct words that one automaton can tell apart (characters stand for words).
ALPHABET = 1_000_000


def _windows(words: Words, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of the windows, and the first words of windows that lie in one text."""
    hashes = words.hashes(seed)
    windows = window_hashes(hashes, width)
    ahead = np.repeat(words.first[1:], words.counts) - np.arange(len(hashes))
    return hashes, windows, np.flatnonzero(ahead[:len(windows)] >= width)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value of every ``width`` consecutive ones, in steps of doubled spans."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def regions(docs: DataFrame, width: int = 35, gram: int = GRAM, seed: int = 0) -> DataFrame:
    """anchor, region, doc_id, __tie, first, n: every run of n windows from word ``first`` on that share an anchor."""
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = words_of(texts_of(part.column("text")), BLANKS)
                hashes, windows, at = _windows(words, width, seed)
                if not len(at):
                    continue
                grams = window_hashes(hashes, gram)
                anchor = _smallest(grams, width - gram + 1)[at]
                begin = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)))
                last = np.append(begin[1:], len(at)) - 1
                n = last - begin + 1
                # The first and the last window of a region overlap, so they hold all its words.
                content = mixed(windows[at[begin]] + np.uint64(0x9E3779B97F4A7C15) * mixed(windows[at[last]]) + n.astype(np.uint64))
                owner = np.searchsorted(words.first, at[begin], "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[anchor[begin]].view(np.int64)), pa.array(content.view(np.int64)), part.column("doc_id").take(pa.array(owner)),
                        part.column("__tie").take(pa.array(owner)), pa.array((at[begin] - words.first[owner]).astype(np.int32)), pa.array(n.astype(np.int32)),
                    ],
                    names=["anchor", "region", "doc_id", "__tie", "first", "n"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "__tie", "text"), run, f"anchor long, region long, doc_id {kind}, __tie int, first int, n int")


def _joined(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Documents with the list of their own rows; a null doc_id is a value like others."""
    lists = lists.withColumnsRenamed({"doc_id": "__doc", "__tie": "__own"})
    return docs.join(lists, F.expr("doc_id <=> __doc AND __tie = __own"), how).drop("__doc", "__own")


def _region_windows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """anchor, region, copies, place, window: the windows of each document's listed regions."""
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = words_of(texts_of(part.column("text")), BLANKS)
                _, windows, _ = _windows(words, width, seed)
                listed = part.column("__regions")
                counts = np.diff(listed.offsets.to_numpy())
                flat = listed.flatten()
                anchor, region, copies, first, n = (flat.field(c).to_numpy() for c in ("anchor", "region", "copies", "first", "n"))
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(np.repeat(words.first[:-1], counts) + first, n) + place
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.repeat(c, n)) for c in (anchor, region, copies)), pa.array(place.astype(np.int32)), pa.array(windows[at].view(np.int64))],
                    names=["anchor", "region", "copies", "place", "window"],
                )

    return map_arrow(docs.select("text", "__regions"), run, "anchor long, region long, copies long, place int, window long")


def confirmed(docs: DataFrame, width: int = 35, gram: int = GRAM, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Regions that may recur, and one example of each kind of them with its confirmed windows.

    The regions (anchor, region, copies, doc_id, __tie, first, n) are all those whose anchor is met more than once; regions
    of one kind have the same words. The examples have one row per kind and mask: the windows, as bits, that recur
    anywhere in ``docs``. Words are hashed under ``seed``: texts cannot be made to collide by whoever does not know it.
    """
    if not gram < width <= gram + 61:
        raise ValueError("a region's windows must overlap and fit the bits of a long")
    found = regions(docs, width, gram, seed)
    anchors = found.groupBy("anchor").agg(F.count("*").alias("__n"), F.min("region").alias("__low"), F.max("region").alias("__high"))
    # Stored apart from the join, whose shares of a frequent anchor can then go to several tasks.
    anchors = stored(anchors.filter("__n > 1").select(F.col("anchor"), (F.col("__low") == F.col("__high")).alias("alone")), "recurring-anchors")
    found = stored(found.join(anchors, "anchor"), "recurring-regions")
    discard(anchors)
    first = [F.first(c).alias(c) for c in ("alone", "doc_id", "__tie", "first", "n")]
    examples = stored(found.groupBy("anchor", "region").agg(F.count("*").alias("copies"), *first), "region-examples")
    listed = examples.filter("NOT alone").groupBy("doc_id", "__tie").agg(F.collect_list(F.struct("anchor", "region", "copies", "first", "n")).alias("__regions"))
    windows = stored(_region_windows(_joined(docs, listed, "inner"), width, seed), "region-windows")
    recurring = windows.groupBy("anchor", "window").agg(F.sum("copies").alias("copies")).filter("copies > 1").drop("copies")
    recurring = stored(recurring, "recurring-windows")
    masks = windows.join(recurring, ["anchor", "window"])
    masks = stored(masks.groupBy("anchor", "region").agg(F.sum(F.expr("shiftleft(1L, place)")).alias("mask")), "region-masks")
    discard(windows, recurring)
    whole = examples.filter("alone").withColumn("mask", F.expr("shiftleft(1L, n) - 1"))
    partial = examples.filter("NOT alone").join(masks, ["anchor", "region"])
    kept = stored(whole.unionByName(partial).drop("alone"), "confirmed-examples")
    discard(examples, masks)
    return found, kept


#: Words of the confirmed passages of one automaton, on average.
SHARD_WORDS = 200_000
#: Copies of a kind of region beyond which they are dealt to HOT_PARTS parts, each with its own passages.
HOT_COPIES, HOT_PARTS = 1024, 64
_TO_SPACE = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def _texts(docs: DataFrame, width: int) -> DataFrame:
    """shard, part, kind, doc_id, __tie, first and words of each document's listed regions.

    The words are joined by spaces: for kind 0 (passages) those of each run of the windows in the mask, for kind 1
    (stretches) those of the whole region.
    """
    names = ["shard", "part", "kind", "doc_id", "__tie", "first", "words"]

    def run(batches):
        for batch in batches:
            for slice_ in slices(batch):
                words = words_of(texts_of(slice_.column("text")), BLANKS)
                listed = slice_.column("__regions")
                owner = np.repeat(np.arange(slice_.num_rows), np.diff(listed.offsets.to_numpy()))
                flat = listed.flatten()
                shard, part, kind, first, n, mask = (
                    flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "part", "kind", "first", "n", "mask")
                )
                # A stretch is one run of all its windows.
                mask = np.where(kind == 1, (np.int64(1) << n) - 1, mask)
                bits = (mask[:, None] >> np.arange(63)) & 1
                edges = np.diff(np.pad(bits, ((0, 0), (1, 1))), axis=1)
                (row, begin), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
                at = words.first[owner[row]] + first[row] + begin
                to = at + (end - begin) + width - 1
                size = np.concatenate(([0], np.cumsum(words.end - words.start)))
                tight = words.end[to - 1] - words.start[at] == size[to] - size[at] + (to - at - 1)
                data, start, stop = words.texts.data.tobytes(), words.start.tolist(), words.end.tolist()
                joined = [
                    data[start[a]:stop[b - 1]].translate(_TO_SPACE) if one else b" ".join([data[start[k]:stop[k]] for k in range(a, b)])
                    for a, b, one in zip(at.tolist(), to.tolist(), tight.tolist(), strict=True)
                ]
                of = pa.array(owner[row])
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard[row].astype(np.int32)), pa.array(part[row].astype(np.int32)), pa.array(kind[row].astype(np.int32)),
                    slice_.column("doc_id").take(of), slice_.column("__tie").take(of), pa.array(first[row].astype(np.int32)), pa.array(joined, pa.binary()),
                ], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"shard int, part int, kind int, doc_id {kinds['doc_id']}, __tie {kinds['__tie']}, first int, words binary"
    return map_arrow(docs.select("doc_id", "__tie", "text", "__regions"), run, schema)


class Automata:
    """Aho-Corasick automata over whole words, one per ALPHABET distinct words of the passages."""

    def __init__(self, passages: list[bytes]):
        import ahocorasick

        self.parts = []
        at = 0
        while at < len(passages):
            letters: dict[bytes, str] = {}
            automaton = ahocorasick.Automaton()
            while at < len(passages) and len(letters) < ALPHABET:
                words = passages[at].split(b" ")
                coded = "".join([letters.setdefault(w, _letter(len(letters))) for w in words])
                automaton.add_word(coded, len(words))
                at += 1
            automaton.make_automaton()
            self.parts.append((letters, automaton))

    def find(self, words: bytes) -> list[tuple[int, int]]:
        """First word and number of words of every occurrence of a passage."""
        out = []
        split = words.split(b" ")
        for letters, automaton in self.parts:
            coded = "".join([letters.get(w, _NO_PASSAGE) for w in split])
            out += [(stop + 1 - size, size) for stop, size in automaton.iter(coded)]
        return out


_NO_PASSAGE = "\x01"


def _letter(i: int) -> str:
    """A character for a word; surrogates are left out."""
    return chr(i + 2 if i + 2 < 0xD800 else i + 2 + 0x800)


def locate(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, __tie, first and mask: the windows, as bits, of each stretch that lie in an occurrence of a passage.

    ``texts`` are passages and stretches with the columns that ``_texts`` gives. Each shard's passages are compiled into automata as they come, before
    the shard's stretches, which are then streamed through them: a task holds one shard's passages at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(batches):
        of, waiting, automata = None, [], None
        for batch in batches:
            shard, part, kind = (batch.column(c).to_numpy() for c in ("shard", "part", "kind"))
            begin = np.flatnonzero(np.concatenate(([True], (np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0))))
            masks = np.zeros(batch.num_rows, np.int64)
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows], strict=True):
                if of != (shard[a], part[a]):
                    of, waiting, automata = (shard[a], part[a]), [], None
                texts = batch.column("words").slice(a, b - a).to_pylist()
                if kind[a] == 0:
                    waiting += texts
                    continue
                if automata is None:
                    automata, waiting = Automata(waiting), []
                for i, text in enumerate(texts, a):
                    mask = 0
                    for first, size in automata.find(text):
                        mask |= ((1 << (size - width + 1)) - 1) << first
                    masks[i] = mask
            hit = pa.array(np.flatnonzero(masks))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(hit) for c in ("doc_id", "__tie", "first")), pa.array(masks[masks != 0])], names=["doc_id", "__tie", "first", "mask"],
            )

    dealt = texts.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    return map_arrow(dealt, run, f"doc_id {kinds['doc_id']}, __tie {kinds['__tie']}, first int, mask long")


def marks(docs: DataFrame, width: int = 35, gram: int = GRAM, seed: int = 0) -> DataFrame:
    """doc_id, __tie and __marks (first, mask): the windows of each document that recur, found by automata.

    One example of every kind of confirmed passage is dealt into shards, each compiled into automata, and every stretch
    of every document that may hold one of a shard's passages goes through them. A document's text is read once for both.
    """
    found, examples = confirmed(docs, width, gram, seed)
    total = examples.agg(F.coalesce(F.sum(F.col("n") + width), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("anchor", "region"), F.lit(1 + total // SHARD_WORDS)).cast("int")
    hot = F.col("copies") > HOT_COPIES
    # Each part of the copies of a frequent kind gets its passages.
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    passages = examples.select("doc_id", "__tie", "first", "n", "mask", shard.alias("shard"), F.explode(parts).alias("part"), F.lit(0).alias("kind"))
    mine = found.join(examples.select("anchor", "region", "copies"), ["anchor", "region"])
    part = F.when(hot, F.pmod(F.xxhash64("doc_id", "__tie", "first"), F.lit(HOT_PARTS))).otherwise(0).cast("int")
    mine = mine.select("doc_id", "__tie", "first", "n", F.lit(0).cast("long").alias("mask"), shard.alias("shard"), part.alias("part"), F.lit(1).alias("kind"))
    # Rows of one document and text that is repeated have the same regions.
    entry = F.struct("shard", "part", "kind", "first", "n", "mask")
    listed = passages.unionByName(mine).groupBy("doc_id", "__tie").agg(F.collect_set(entry).alias("__regions"))
    # Stored before the texts move: what the lists were made from need not lie beside the shuffled texts.
    listed = stored(listed, "listed-regions")
    discard(found, examples)
    located = locate(_texts(_joined(docs, listed, "inner"), width), width)
    found_marks = stored(located.groupBy("doc_id", "__tie").agg(F.collect_set(F.struct("first", "mask")).alias("__marks")), "marks")
    discard(listed)
    return found_marks


def _covered(words: Words, owners: np.ndarray, firsts: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """Which words the marked windows cover."""
    bits = np.flatnonzero((masks[:, None] >> np.arange(62)) & 1)
    rows, place = bits // 62, bits % 62
    starts = np.unique(words.first[owners[rows]] + firsts[rows] + place)
    steps = np.zeros(len(words.start) + 1, np.int64)
    steps[starts] += 1
    steps[starts + width] -= 1
    return np.cumsum(steps)[:-1] > 0


@guarded
def remove_repeats(docs: DataFrame, width: int = 35, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """The rows with n_words, n_removed, kept (the words left, joined by spaces), kept_sha256 and changed.

    A word is removed if a window of ``width`` consecutive words of its document covers it whose words also start
    anywhere else, in this document or another; all windows are judged on the texts as given. Words are runs of
    characters other than the space and 0x09 to 0x0D. Null and empty texts, and texts shorter than a window, lose
    nothing. Repeated rows recur in each other. Columns named like the new ones are replaced, others in ``keep`` (all,
    if None) stay. An empty table gives no rows.
    """
    keyed = docs.withColumn("__tie", F.hash("text"))
    own = keyed.select("doc_id", "__tie", "text")
    rows = _joined(keyed, marks(own, width, gram, secrets.randbits(64)), "left")

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        words = words_of(texts_of(part.column("text")), BLANKS)
        found = part.column("__marks")
        counts = np.asarray(found.value_lengths().fill_null(0)).astype(np.int64)
        flat = found.flatten()
        owners = np.repeat(np.arange(part.num_rows), counts)
        covered = _covered(words, owners, flat.field("first").to_numpy().astype(np.int64), flat.field("mask").to_numpy(), width)
        data = words.texts.data.tobytes()
        start, end, first = words.start.tolist(), words.end.tolist(), words.first.tolist()
        removed = np.diff(np.concatenate(([0], np.cumsum(covered)))[words.first])
        kept = []
        for i in range(part.num_rows):
            at = range(first[i], first[i + 1])
            if removed[i]:
                at = (first[i] + np.flatnonzero(~covered[first[i]:first[i + 1]])).tolist()
            kept.append(b" ".join([data[start[k]:end[k]] for k in at]))
        digests = [hashlib.sha256(x).hexdigest() for x in kept]
        return [pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array([x.decode("utf-8", "replace") for x in kept]), pa.array(digests), pa.array(removed > 0)]

    added = [("n_words", LongType()), ("n_removed", LongType()), ("kept", StringType()), ("kept_sha256", StringType()), ("changed", BooleanType())]
    return with_text_columns(rows, added, work, keep=docs.columns if keep is None else keep, also=["__marks"])
