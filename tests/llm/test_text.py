"""Operators on whole texts, against brute force."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillomics.llm import catalog, components, decontaminate, language, packing, passages, records, simhash, tokens
from quillomics.llm.words import BLANKS, texts_of, window_hashes, words_of
from tests.llm import rows as fixture
from tools.check import compare, connect

PLAIN = r"[^\x20\x09-\x0D]+"
BARE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- words

@given(st.lists(st.text(alphabet="ab \n\t\x0b\x1cé漢", max_size=30) | st.none(), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words(texts):
    import pyarrow as pa

    words = words_of(texts_of(pa.array(texts, pa.string())), BLANKS)
    data = words.texts.data.tobytes()
    got = [[data[words.start[k]:words.end[k]].decode() for k in range(words.first[i], words.first[i + 1])] for i in range(len(texts))]
    assert got == [re.findall(PLAIN, t or "") for t in texts]
    flat = [w for ws in got for w in ws]
    by = defaultdict(set)
    for h, w in zip(words.hashes().tolist(), flat, strict=True):
        by[h].add(w)
    assert len(by) == len(set(flat)) and all(len(v) == 1 for v in by.values())
    pairs = window_hashes(words.hashes(), 2).tolist()
    assert len(set(pairs)) == len(set(zip(flat, flat[1:], strict=False)))


# --- SimHash

def fingerprint(text, width=3):
    words = re.findall(PLAIN, lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=3):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in prints}


def test_simhash_query(spark, sf_dir):
    docs = {r.doc_id: fingerprint(r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()}
    roots = linked(set(docs.values()))
    least = {}
    for i, p in docs.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.QUERIES["op2_simhash_pivots"](spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", least[roots[p]]) for i, p in docs.items()}


@pytest.mark.parametrize("block", [4, 1024])
def test_links_lose_nothing(spark, block):
    rng = np.random.default_rng(5)
    prints = set()
    for center in rng.integers(-(2**63), 2**63, 12):
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(int(center) & (2**64 - 1) ^ sum(1 << int(b) for b in flips))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p, [p]) for p in signed], "node long, prints array<long>")
    found = {r.node: r.root for r in components.components(simhash.links(nodes, 3, 6, 3, block)).collect()}
    classes = defaultdict(set)
    for p in signed:
        classes[found.get(p, p)].add(p & (2**64 - 1))
    want = defaultdict(set)
    for p, r in linked(prints).items():
        want[r].add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (5, 5), (300, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_simhash_edges(spark):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.groups(fixture.documents(spark, ["fingerprint", "node", "prints"])).collect()}
    assert got[3, 0] == got[4, 0] == got[5, 0] == 3
    assert {v for (i, _), v in got.items() if i in (1, 2)} == {1}
    assert {v for (i, _), v in got.items() if i is None} == {None}
    assert simhash.groups(fixture.empty(spark)).count() == 0


def test_distinct_documents(spark):
    got = [r.doc_id for r in simhash.distinct_documents(fixture.documents(spark, ["node", "head"])).collect()]
    assert sorted(got, key=str) == sorted([1, 3, 6, 7, 9, 10, 11, 12, 13, None], key=str)
    base = [f"w{i * 31 % 907}" for i in range(400)]
    texts = [" ".join(base)] + [" ".join([*base[:k], f"new{k}", *base[k + 1:]]) for k in range(0, 400, 20)] + [" ".join(f"z{i * k % 911}" for i in range(300)) for k in (7, 11, 13)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.distinct_documents(docs).collect()) == [0, 21, 22, 23]
    assert simhash.distinct_documents(fixture.empty(spark)).count() == 0


def pairs_of_texts(spark, cases):
    """Documents 2i and 2i + 1 for each (n, k): they share n - k of n + k five-word shingles."""
    texts = []
    for i, (n, k) in enumerate(cases):
        words = [f"w{i}x{j}" for j in range(n + 4)]
        texts += [" ".join(words), " ".join([*words[:len(words) - k], *(f"v{i}x{j}" for j in range(k))])]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_documents_below_the_similarity_stay(spark):
    docs = pairs_of_texts(spark, [(n, n // 9 + k) for n in (60, 300) for k in (1, 2) for _ in range(30)])
    assert simhash.distinct_documents(docs).count() == docs.count()


def test_documents_at_the_similarity_go(spark):
    cases = [(n, n // 9 - k) for n in (9, 18, 60, 300) for k in (0, 1) for _ in range(40)]
    got = {r.doc_id for r in simhash.distinct_documents(pairs_of_texts(spark, cases)).collect()}
    assert got == {2 * i for i in range(len(cases))}


def test_distinct_documents_query(spark, sf_dir):
    """All pairs of texts by their shingles."""
    least, shared = {}, defaultdict(list)
    for r in documents(spark, sf_dir).select("doc_id", "text").collect():
        words = re.findall(PLAIN, lower(r.text or ""))
        key = frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
        least[key] = min(r.doc_id, least.get(key, r.doc_id))
    parent = {i: i for i in least.values()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, i in least.items():
        for b in {id(b): b for s in a for b in shared[s]}.values():
            if len(a & b) / len(a | b) >= 0.8:
                low, high = sorted((root(i), root(least[b])))
                parent[high] = low
        for s in a:
            shared[s].append(a)
    kept = [r.doc_id for r in simhash.distinct_documents(documents(spark, sf_dir)).collect()]
    assert sorted(kept) == sorted({root(i) for i in parent})


# --- substring dedup

def without_repeats(texts, width):
    words = [re.findall(PLAIN, t or "") for t in texts]
    often = Counter(tuple(w[k:k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if often[tuple(w[k:k + width])] > 1:
                gone |= set(range(k, k + width))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def test_repeats_query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], without_repeats([r.text for r in docs], 35), strict=True))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in catalog.QUERIES["op3_phrase_automata"](spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_few_words(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60), p=[0.6, 0.3, 0.1])) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeats(docs, width=7, gram=3).collect()}
    assert got == dict(enumerate(without_repeats(texts, 7)))


def test_repeats_edges(spark):
    docs = fixture.documents(spark, ["kept", "first", "mask"])
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeats(docs).collect())
    want = without_repeats([t for _, t, _, _ in fixture.TEXTS], 35)
    assert got == Counter((i, *w) for (i, _, _, _), w in zip(fixture.TEXTS, want, strict=True))
    assert {i: r for (i, _, r, _) in got}[7] == 60
    twice = docs.filter("doc_id = 6").unionByName(docs.filter("doc_id = 6"))
    assert [r.n_removed for r in passages.remove_repeats(twice).collect()] == [20_000, 20_000]
    assert passages.remove_repeats(fixture.empty(spark)).count() == 0


# --- language

def test_language_accuracy(spark):
    found = catalog.QUERIES["op4_language_bitmask"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_filter_matches_sets(spark):
    """What the filter returns is every language that has the n-gram, and few that have not."""
    docs = fixture.documents(spark).filter("lang IS NOT NULL")
    model = language.learn(docs, min_share=1e-6)
    sets = defaultdict(set)
    for r in language.gram_counts(docs).collect():
        sets[r.gram].add(r.lang)
    codes = np.array(sorted(sets), np.uint32)
    hits = model.hits(codes)[:, 0]
    for code, bits in zip(codes.tolist(), hits.tolist(), strict=True):
        assert all(bits >> model.languages.index(x) & 1 for x in sets[code])
    unseen = np.setdiff1d(np.arange(10**6, 10**6 + 20_000, dtype=np.uint32), codes)
    for i in range(len(model.languages)):
        assert np.mean(model.hits(unseen)[:, 0] >> np.uint64(i) & np.uint64(1)) < 3 * model.false[i] + 0.01


def test_language_edges(spark):
    docs = fixture.documents(spark, ["score", "lang_pred"])
    model = language.learn(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {3, 4, 5} and got[3].score == 0
    assert got[2].lang_pred == "en" and got[6].lang_pred == "de"
    one = spark.createDataFrame([(1, "x"), (2, "漢"), (3, "12 !")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.identify(one, model).orderBy("doc_id").collect()] == [False, False, True]
    assert language.learn(fixture.empty(spark)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(fixture.empty(spark), model).count() == 0


# --- decontamination

def test_contamination_query(spark, sf_dir):
    n, problem = compare(connect(sf_dir), catalog.QUERIES["op5_prefix_set_join"](spark, sf_dir), catalog.ORACLES["op5_prefix_set_join"])
    assert problem is None and n > 0


def hit_words(texts, items, width):
    out = []
    for text in texts:
        words, gone, owners = re.findall(BARE, lower(text)), set(), set()
        for item, t in items:
            own = re.findall(BARE, lower(t))
            size = min(width, len(own))
            windows = {tuple(own[k:k + size]) for k in range(len(own) - size + 1)} if own and item is not None else set()
            for k in range(len(words) - size + 1):
                if tuple(words[k:k + size]) in windows:
                    gone |= set(range(k, k + size))
                    owners.add(str(item))
        out.append((len(words), len(gone), sorted(owners)))
    return out


def test_contamination_edges(spark):
    items = [(1, "Phrase3, phrase4 PHRASE5 phrase6"), (2, "a"), (3, None), (4, " ,. "), (None, "eins"), (10, "cat sat"), (10, "cat sat"), (11, "phrase3 phrase4 phrase5"), (12, "漢字 and")]
    texts = [t for _, t, _, _ in fixture.TEXTS] + ["a a a b a", "phrase3 phrase4 phrase5", "cat sat cat-sat"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash"))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, bench, width=3, shingle=2).collect()}
    want = hit_words(texts, items, 3)
    assert got == dict(enumerate(want))
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, width=3, shingle=2).collect()}
    assert kept == {i for i, w in enumerate(want) if not w[1]}
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(fixture.empty(spark), bench).count() == 0


def test_texts_stay_where_they_are_if_few_are_hit(spark):
    docs = spark.createDataFrame([(i, f"w{i} alpha beta gamma delta w{i}" if i % 9 == 0 else f"plain text {i}") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "alpha beta gamma delta")], "item_id string, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert {r.doc_id for r in kept.collect()} == {i for i in range(50) if i % 9}


# --- tokens

def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalog.tokenizer_file())
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@given(st.lists(st.text(alphabet="ab'st.,!| \n\t 　é漢1²_\x1c\x85", max_size=24), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_library(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(catalog.tokenizer_file()).encode(texts)]
    assert got == plain_ids(texts)
    assert len(tokens.encoder(catalog.tokenizer_file()).known) <= tokens.KEPT_PIECES


def test_encoder_on_documents(spark, sf_dir):
    texts = [r.text for r in documents(spark, sf_dir).select("text").collect()] + [t for _, t, _, _ in fixture.TEXTS]
    encode = tokens.Encoder(catalog.tokenizer_file()).encode
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == plain_ids(texts)


def test_encoder_forgets_rightly(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 200)
    texts = [r.text for r in documents(spark, sf_dir).select("text").limit(60).collect()]
    encoder = tokens.Encoder(catalog.tokenizer_file())
    got = [np.frombuffer(x, "<u4").tolist() for k in range(0, len(texts), 5) for x in encoder.encode(texts[k:k + 5])]
    assert got == plain_ids(texts)
    assert len(encoder.known) <= 200


def test_words_between_marks_and_lines_are_encoded_alone(monkeypatch):
    encoder = tokens.Encoder(catalog.tokenizer_file())
    asked = {"words": [], "whole": []}
    for name, kind in (("_ids_of_words", "words"), ("_ids", "whole")):
        inner = getattr(encoder, name)
        monkeypatch.setattr(encoder, name, lambda pieces, inner=inner, kind=kind: asked[kind].extend(pieces) or inner(pieces))
    texts = ["(Qzu,vrek.\nThex7 \u00e9t\u00e9!!\n\n\nNo", "vrek 7 Qzu", None, "\n\nNo it's.\n\u00d7"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == plain_ids(texts)
    assert {b"Qzu", b"vrek", b"Thex", " \u00e9t\u00e9".encode()} <= set(asked["words"])
    assert not any(w in x for x in asked["whole"] for w in (b"Qzu", b"vrek", b"The"))
    before = len(asked["words"])
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == got and len(asked["words"]) == before


def test_added_tokens_keep_their_marks():
    texts = ["a<|endoftext|>b's.", "x <|endoftext|>\nThe", "The a.\nb"]
    encoder = tokens.Encoder(catalog.tokenizer_file())
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == plain_ids(texts)
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in encoder.encode([t])] == plain_ids(texts)


def test_pieces_of_one_hash(monkeypatch):
    monkeypatch.setattr(tokens.Words, "hashes", lambda self, seed=0: (self.end - self.start).astype(np.uint64))
    encoder = tokens.Encoder(catalog.tokenizer_file())
    for texts in (["one", "of"], ["two", "of", "is"], ["six", "of"], ["to"], ["one"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == plain_ids(texts)


def test_records_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in catalog.QUERIES["op7_token_records"](spark, sf_dir).collect()}
    at, want = 0, {}
    for (i, _), ids in zip(docs, plain_ids([t for _, t in docs]), strict=True):
        ids = [*ids, 0]
        want[i] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert got == want


def test_records_round_trip(spark, tmp_path):
    docs = fixture.documents(spark, ["shard", "value"])
    records.write_records(docs, str(tmp_path / "r"), catalog.tokenizer_file(), file_bytes=40_000)
    index = records.read_index(spark, str(tmp_path / "r")).orderBy("start").collect()
    assert [r.doc_id for r in index] == sorted([i for i, *_ in fixture.TEXTS], key=lambda i: (i is not None, i))
    assert len({r.shard for r in index}) > 1
    assert [r.start for r in index] == [0, *np.cumsum([r.n_tokens for r in index])[:-1].tolist()]
    shuffled = [records.read_shuffled(spark, str(tmp_path / "r"), seed).collect() for seed in (1, 2)]
    want = Counter((i, *ids, 0) for (i, *_), ids in zip(fixture.TEXTS, plain_ids([t for _, t, *_ in fixture.TEXTS]), strict=True))
    assert all(Counter((r.doc_id, *r.ids) for r in rows) == want for rows in shuffled)
    assert [r.doc_id for r in shuffled[0]] != [r.doc_id for r in shuffled[1]]
    records.write_records(fixture.empty(spark), str(tmp_path / "e"), catalog.tokenizer_file())
    assert records.read_index(spark, str(tmp_path / "e")).count() == 0


def test_damaged_records():
    good = records.frame(5, b"\1\0\0\0") + records.frame(None, b"")
    assert [(owner, bytes(ids)) for _, _, owner, ids in records.frames(memoryview(good))] == [(5, b"\1\0\0\0"), (None, b"")]
    for bad in (good[:-1], good[:10], good[:14] + b"x" + good[15:], b"\x09" + good[1:]):
        with pytest.raises(ValueError):
            list(records.frames(memoryview(bad)))


# --- packing

def one_by_one(counts, capacity):
    """Best-two-fit, a sequence at a time."""
    left, made = Counter({size: n for size, n in enumerate(counts) if n}), []
    while +left:
        taken, gap = [], capacity
        while fitting := [s for s, n in left.items() if n > 0 and s <= gap]:
            taken.append(max(fitting))
            left[taken[-1]] -= 1
            gap -= taken[-1]
        if gap and len(taken) > 1:
            small = min(taken)
            free = [s for s, n in left.items() if n > 0]
            sums = [a + b for a in free for b in free if (a < b or a == b and left[a] > 1) and small < a + b <= gap + small]
            if sums:
                taken.remove(small)
                left[small] += 1
                pair = packing._pair([left[s] - (s == small) for s in range(capacity + 1)], {}, small, gap + small)
                assert sum(pair) == max(sums)
                for s in pair:
                    taken.append(s)
                    left[s] -= 1
        made.append(sorted(taken))
    return made


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=60, deadline=None)
def test_plan(lengths):
    counts = [0] * 41
    for n in lengths:
        counts[n] += 1
    made = [sorted(s for s, n in need.items() for _ in range(n)) for need, times in packing.plan(counts, 40) for _ in range(times)]
    assert sorted(s for bin in made for s in bin) == sorted(lengths) and all(sum(b) <= 40 for b in made)
    assert sorted(made) == sorted(one_by_one(counts, 40))


def test_packing_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    got = catalog.QUERIES["op9_best_two_fit"](spark, sf_dir).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for (i, _), ids in zip(docs, plain_ids([t for _, t in docs]), strict=True):
        ids, at = [*ids, 2], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            own = ids[at:at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids) and len(by[i]) == -(-len(ids) // 1024)
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1].tolist()] and sum(r.length for r in rows) <= 1024
    assert len(bins) <= 1.01 * -(-sum(r.length for r in got) // 1024) + 1


def test_packing_edges(spark):
    placed = packing.pack(fixture.documents(spark, ["length", "offset"]), catalog.tokenizer_file(), with_ids=True)
    got = packing.sequences(placed).collect()
    assert sum(r.n_tokens for r in got) == sum(len(x) + 1 for x in plain_ids([t for _, t, *_ in fixture.TEXTS]))
    assert all(len(r.ids) == r.n_tokens <= 1024 for r in got)
    assert packing.pack(fixture.empty(spark), catalog.tokenizer_file()).count() == 0


# --- pipeline

def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = documents(spark, sf_dir)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        path = catalog.scratch_path(spark, "pipeline-test")
        out.write.parquet(path)
        docs, before = spark.read.parquet(path), kept
        kept = [(r.doc_id, r.text) for r in docs.collect()]
        assert {i for i, _ in kept} <= {i for i, _ in before}
        if name == "substring_dedup":
            whole = without_repeats([t for _, t in before], 35)
            digest = {i: w[2] for (i, _), w in zip(before, whole, strict=True) if w[0] != w[1]}
            assert {i: hashlib.sha256(" ".join(re.findall(PLAIN, t)).encode()).hexdigest() for i, t in kept} == digest
        if name == "simhash_near_dedup":
            assert len({" ".join(re.findall(PLAIN, lower(t))) for _, t in before}) >= len(kept)
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            hit = hit_words([t for _, t in before], items, 10)
            assert {i for i, _ in kept} == {i for (i, _), h in zip(before, hit, strict=True) if not h[1]}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in last} == {i for i, _ in kept}


def test_pipeline_stands_edges(spark, sf_dir):
    import corpus_pipeline

    for start in (fixture.documents(spark, ["score", "kept"]), fixture.empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            path = catalog.scratch_path(spark, f"edges-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (start.limit(1).count() > 0)


# --- words that polynomial hashes take for equal, very long texts, names used inside

def alike():
    """A long word and its complement, told apart by no polynomial hash modulo 2^64."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_alike_to_polynomials_are_kept(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(i, f"{w} {rest}") for i, w in enumerate(alike())], "doc_id long, text string")
    assert [r.n_removed for r in passages.remove_repeats(docs).collect()] == [0, 0]


def test_automata_compare_words(spark):
    """A passage whose example only hashes like a stretch is not found in it."""
    rows = [(0, 0, 0, None, None, 0, b"a b c"), (0, 0, 1, 1, 7, 4, b"x a b c"), (0, 0, 1, 2, 7, 0, b"a b d c"), (1, 0, 1, 3, 7, 0, b"a b c")]
    df = spark.createDataFrame(rows, "shard int, part int, kind int, doc_id long, __tie int, first int, words binary")
    got = passages.locate(df, 3).collect()
    assert [(r.doc_id, r.first, r["mask"]) for r in got] == [(1, 4, 2)]


@pytest.mark.parametrize("hot,alphabet", [(1, 1_000_000), (1024, 40)])
def test_repeats_in_parts(spark, sf_dir, monkeypatch, hot, alphabet):
    monkeypatch.setattr(passages, "HOT_COPIES", hot)
    monkeypatch.setattr(passages, "SHARD_WORDS", 500)
    monkeypatch.setattr(passages, "ALPHABET", alphabet)
    docs = documents(spark, sf_dir).select("doc_id", "text").filter("doc_id < 120")
    texts = docs.collect()
    want = dict(zip([r.doc_id for r in texts], without_repeats([r.text for r in texts], 35), strict=True))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeats(docs).collect()} == want


def test_hashing_a_long_text_takes_little_memory():
    import subprocess
    import sys

    code = """
import resource, sys
import pyarrow as pa
from quillomics.llm.words import BLANKS, texts_of, window_hashes, words_of
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
words = words_of(texts_of(pa.array(["lorem ipsum dolor sit amet " * 1_500_000])), BLANKS)
window_hashes(words.hashes(), 35)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 500


RESERVED = ["__tie", "__letter", "__marks", "__regions", "__doc", "__own", "__id", "__key", "own_0", "changed", "kept", "lang_pred", "score"]


def test_names_used_inside_come_back(spark, sf_dir):
    import corpus_pipeline

    docs = fixture.documents(spark, RESERVED)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        for row in out.select(*RESERVED).collect():
            assert set(row) == {"clash"}, name
    internal = [c for c in RESERVED if c.startswith("__")]
    items = catalog.table(spark, sf_dir, "benchmark")
    for out in (
        passages.remove_repeats(docs), simhash.distinct_documents(docs), decontaminate.drop_contaminated(docs, items),
        language.identify(docs, language.learn(docs)),
    ):
        assert all(set(r) == {"clash"} for r in out.select(*internal).collect())


def test_regions_are_removed_before_the_texts_move(spark, monkeypatch):
    """When the marks are written only the documents' lists of regions lie beside the shuffled texts."""
    kept, beside = {}, {}
    store, drop = passages.stored, passages.discard

    def stored(df, label):
        if label == "marks":
            beside[label] = sorted(kept.values())
        table = store(df, label)
        kept[id(table)] = label
        return table

    def discard(*tables):
        drop(*tables)
        for table in tables:
            del kept[id(table)]

    monkeypatch.setattr(passages, "stored", stored)
    monkeypatch.setattr(passages, "discard", discard)
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, f"c d {passage}"), (3, "none")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in passages.remove_repeats(docs).collect()} == {1: 40, 2: 40, 3: 0}
    assert beside == {"marks": ["listed-regions"]} and sorted(kept.values()) == ["marks"]
