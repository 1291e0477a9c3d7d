"""Fingerprints, edited texts and block tables against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillomics.llm import catalog, fingerprints
from tests.llm import rows as fixture


def edited_texts(docs):
    """Per row of (doc_id, text, hash of the text): its text and the edited one."""
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    out = []
    for i, (doc, text, _) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(text) // 3
        out.append((doc, text, text[:len(text) - cut] + following[:cut], following))
    return out


def hashed(df):
    text = F.coalesce("text", F.lit(""))
    return [tuple(r) for r in df.select("doc_id", text, F.xxhash64(text)).collect()]


def brute_prints(spark, texts):
    """Fingerprints by adding up signed votes term by term; Spark's own hash of words and pairs."""
    terms = {}
    for text in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w] or [""]
        terms[text] = (words, list(zip(words, words[1:])))
    words = sorted({w for ws, _ in terms.values() for w in ws})
    of = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).collect()}
    pairs = sorted({(of[a], of[b]) for _, ps in terms.values() for a, b in ps})
    of_pair = {(r[0], r[1]): r[2] for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b")).collect()}
    first = {*of.values(), *of_pair.values()}
    second = {r[0]: r[1] for r in spark.createDataFrame([(h,) for h in first], "h long").select("h", F.xxhash64("h", F.lit(1))).collect()}
    out = {}
    for text, (ws, ps) in terms.items():
        votes = [0] * 128
        for kinds in ({of[w] for w in ws}, {of_pair[of[a], of[b]] for a, b in ps}):
            for h in kinds:
                for half, value in enumerate((h, second[h])):
                    for bit in range(64):
                        votes[64 * half + bit] += 1 if value >> bit & 1 else -1
        high, low = (sum(1 << b for b in range(64) if votes[64 * half + b] > 0) for half in (0, 1))
        out[text] = f"{high:016x}{low:016x}"
    return out


@pytest.mark.parametrize("rows", ["fixture", "table"])
def test_likenesses(spark, sf_dir, rows):
    docs = fixture.documents(spark, ["__id", "high", "low", "kind", "next_text", "fingerprint"]) if rows == "fixture" else catalog.table(spark, sf_dir, "documents")
    got = fingerprints.likenesses(docs)
    want = edited_texts(hashed(docs))
    found = got.collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=key) == sorted(
        ((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in want), key=key,
    )
    some = want if rows == "fixture" else want[::7]
    prints = brute_prints(spark, {x for r in some for x in r[1:]})
    by_row = {}
    for r in found:
        by_row.setdefault((r.doc_id, r.edited_sha256), []).append(r)
    for doc, text, edited, following in some:
        digest = hashlib.sha256(edited.encode()).hexdigest()
        rows_of = [r for r in by_row[doc, digest] if r.fingerprint == prints[text] and r.edited_fingerprint == prints[edited]]
        assert rows_of

        def like(a, b):
            import math

            return max(0.0, math.cos(math.pi * (int(prints[a], 16) ^ int(prints[b], 16)).bit_count() / 128))

        assert any(abs(r.near_edited - like(text, edited)) < 1e-9 and abs(r.near_next - like(text, following)) < 1e-9 for r in rows_of)


def test_edited_texts_are_nearer_than_the_next(spark, sf_dir):
    found = fingerprints.likenesses(catalog.table(spark, sf_dir, "documents")).collect()
    assert sum(r.near_edited > r.near_next for r in found) > 0.97 * len(found)
    equal = {}
    for r in catalog.table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        equal.setdefault(r.text, set()).add(r.doc_id)
    of = {r.doc_id: r.fingerprint for r in found}
    assert all(len({of[d] for d in ids}) == 1 for ids in equal.values())


def test_ranges_of_ids(spark):
    rng = random.Random(5)
    ids = [rng.choice([i, i * 10**15, -i, 2**62 + i, None]) for i in range(300)]
    docs = spark.createDataFrame([(i, f"text {n} of {n % 7}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(9)
    want = edited_texts(hashed(docs))
    got = fingerprints.beside_next(docs).select("doc_id", "text", "next_text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(((d, t, n) for d, t, _, n in want), key=key)


def test_weights_and_long_texts(spark):
    # More distinct terms than a quarter of a long can count, with weights.
    text = " ".join(f"w{i}" for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, None)], "k long, text string")
    light = {(r.k, r.kind): (r.high, r.low) for r in fingerprints.fingerprints(df, ["k"], ["text"]).collect()}
    heavy = {(r.k, r.kind): (r.high, r.low) for r in fingerprints.fingerprints(df, ["k"], ["text"], (3, 3)).collect()}
    assert light == heavy and len(light) == 2
    words = {(r.k, r.kind): (r.high, r.low) for r in fingerprints.fingerprints(df, ["k"], ["text"], (1, 0)).collect()}
    assert words[1, 0] != light[1, 0]


@pytest.mark.parametrize("crowded", [1, 64])
def test_near_loses_no_pair(spark, monkeypatch, crowded):
    monkeypatch.setattr(fingerprints, "CROWDED", crowded)
    rng = random.Random(6)
    prints = [rng.getrandbits(128) for _ in range(60)]
    for base in prints[:10]:  # a crowd around some of them
        for _ in range(12):
            x = base
            for b in rng.sample(range(128), rng.randint(0, 4)):
                x ^= 1 << b
            prints.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in prints] + [(None, 1), (0, 0), (0, 0)]
    got = fingerprints.near(spark.createDataFrame(rows, "high long, low long"), 3).collect()
    distinct = set(prints) | {0}
    want = {frozenset((a, b)) for a in distinct for b in distinct if a != b and (a ^ b).bit_count() <= 3}
    pairs = [frozenset((((r.high & (1 << 64) - 1) << 64) | (r.low & (1 << 64) - 1), ((r.other_high & (1 << 64) - 1) << 64) | (r.other_low & (1 << 64) - 1))) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert all(r.bits <= 3 for r in got)


def test_fingerprint_edges(spark):
    nothing = fingerprints.likenesses(fixture.empty(spark))
    assert nothing.columns[:3] == ["doc_id", "n_chars", "edited_sha256"] and not nothing.collect()
    one = fingerprints.likenesses(spark.createDataFrame([(5, "only one here")], "doc_id long, text string")).collect()[0]
    assert (one.near_next, one.n_near, one.edited_sha256) == (1.0, 0, hashlib.sha256(b"only one only").hexdigest())


def test_fingerprints_stay_in_the_jvm(spark, sf_dir):
    plan = catalog.QUERIES["op13_simhash_fingerprints"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
