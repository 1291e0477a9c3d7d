"""Language identification with a bit-sliced Bloom filter of n-grams.

Every slot of the filter holds one bit per language; the AND of an n-gram's slots tells at once all languages that have
it. A text's hits per language, corrected for the filter's false positives, decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .arrow import map_arrow, with_text_columns
from .ordering import stored
from .names import guarded
from .words import Texts, mixed, slices, texts_of

UNKNOWN = "und"
GRAM = 4
#: Classes of bytes in n-grams: letters (A-Z as a-z) and all bytes of other scripts stay, the rest is one blank.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
#: Counts of distinct n-grams that a task holds before it passes them on.
FLUSH = 1 << 20


def grams_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all 4-byte windows with two letters or more, and the number of them in each text.

    Texts are set apart by blanks, so the first and last letters of a text form n-grams too.
    """
    n, pad = len(texts), GRAM - 1
    sizes = np.diff(texts.offsets)
    begins = texts.offsets[:-1] + pad * (np.arange(n) + 1)
    folded = np.full(len(texts.data) + pad * (n + 1), 0x20, np.uint8)
    folded[np.arange(len(texts.data)) + np.repeat(pad * (np.arange(n) + 1), sizes)] = _FOLD[texts.data]
    windows = len(folded) - pad
    codes, letters = np.zeros(windows, np.uint32), np.zeros(windows, np.uint8)
    for k in range(GRAM):
        codes |= folded[k:k + windows].astype(np.uint32) << np.uint32(8 * k)
        letters += folded[k:k + windows] != 0x20
    at = np.flatnonzero(letters >= 2)
    # A window belongs to the text whose padded span, from its leading blanks on, holds its first byte.
    limits = np.searchsorted(at, np.append(begins - pad, windows))
    return codes[at], np.diff(limits)


@dataclass
class Model:
    """``masks``: per slot the languages as bits, in words of 64; ``false``: chance of a false hit per language."""

    languages: list[str]
    masks: np.ndarray
    false: np.ndarray
    hashes: int
    prior: int

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """Per n-gram and word of languages the AND of its slots."""
        found = None
        for k in range(self.hashes):
            slot = self.masks[_slots(codes, k, len(self.masks))]
            found = slot if found is None else found & slot
        return found

    def scores(self, texts: Texts) -> np.ndarray:
        """Per text and language the corrected share of n-grams that the language has, 0 to 1."""
        codes, counts = grams_of(texts)
        found = self.hits(codes)
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            has = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            sums = np.concatenate(([0], np.cumsum(has.astype(np.int64))))
            share = (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(counts, 1)
            out[:, i] = np.clip((share - self.false[i]) / max(1e-9, 1 - self.false[i]), 0, 1)
        return out


def _slots(codes: np.ndarray, k: int, n: int) -> np.ndarray:
    return (mixed(codes.astype(np.uint64) + (np.uint64(k + 1) << np.uint64(33))) & np.uint64(n - 1)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows with a language; counts are combined in each task first."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch):
                codes, counts = grams_of(texts_of(part.column("text")))
                langs, which = np.unique(np.asarray(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                of = np.repeat(which, counts)
                for i, lang in enumerate(langs):
                    found, n = np.unique(codes[of == i], return_counts=True)
                    held.setdefault(str(lang), []).append((found, n))
                    size += len(found)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    return map_arrow(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, min_share: float = 1e-5, bits: int = 20, hashes: int = 3) -> Model | None:
    """Fits the filter on all rows that have text and lang; None if there are none.

    A language's n-grams are those with at least ``min_share`` of its occurrences, so a language has at most
    1 / min_share of them: what reaches the driver, and the 2^bits slots, do not grow with the input.
    """
    counts = stored(gram_counts(docs), "language-grams")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    if not totals:
        return None
    languages = sorted(totals)
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "__lang")
    kept = counts.join(F.broadcast(sums), F.col("lang") == F.col("__lang")).filter(F.col("n") >= min_share * F.col("total")).select("lang", "gram").toPandas()
    masks = np.zeros((1 << bits, -(-len(languages) // 64)), np.uint64)
    for i, lang in enumerate(languages):
        codes = kept["gram"][kept["lang"] == lang].to_numpy(np.uint64)
        for k in range(hashes):
            masks[_slots(codes, k, len(masks)), i // 64] |= np.uint64(1) << np.uint64(i % 64)
    filled = np.array([np.mean((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) > 0) for i in range(len(languages))])
    prior = int(np.argmax([totals[lang] for lang in languages]))
    return Model(languages, masks, filled ** hashes, hashes, prior)


@guarded
def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The rows with lang_pred and score (the winner's corrected share of n-grams, 0 to 1).

    ``und`` with score 0 for null text, text without a letter, and for all if the model is None. Text with a letter
    always gets a learned language: with no known n-gram the most frequent one, with score 0; ties go to the first in
    order of name. Columns of the result's names are replaced, others stay; rows may repeat; an empty table stays empty.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.withColumn("__letter", letter)
    keep = [c for c in (docs.columns if keep is None else keep)]
    if model is None:
        rest = [c for c in keep if c not in ("lang_pred", "score")]
        return docs.select(*[f"`{c}`" for c in rest], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        scores = model.scores(texts_of(part.column("text")))
        best = np.where(scores.max(1) > 0, scores.argmax(1), model.prior)
        score = scores[np.arange(len(best)), best]
        known = np.asarray(part.column("__letter").to_numpy(zero_copy_only=False), bool)
        names = np.where(known, np.asarray(model.languages, object)[best], UNKNOWN)
        return [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))]

    return with_text_columns(rows, [("lang_pred", StringType()), ("score", DoubleType())], work, keep=keep, also=["__letter"])


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5
