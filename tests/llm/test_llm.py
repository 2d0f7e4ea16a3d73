"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; brute force where SQL has no say."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, near_dedup, packing, pii, quality_model, quality_rules, token_files, topk, toxicity
from tessera.llm.common import give_back
from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES, tokenizer_path
from tessera.llm.tokens import WordEncoder
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD = [
    (1, None, "en", "s1", None), (2, "", None, "s1", 0), (3, " \n\t ", "en", None, 4), (4, "one two three\none two three\none two three", "en", "s2", 9), (4, "one two three\none two three\none two three", "en", "s2", 9),
    (5, LONG, "en", "s2", len(LONG)), (6, "a b c d e f g", "en", "s3", 13), (7, "a b c d e f g", "en", "s3", 13), (None, "no id here at all, friend", "en", "s3", 5), (8, "x" * 50_000, "en", None, 1), (9, "nul \0 and   é 日本", "fr", "s1", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Every case at once, with columns whose names clash with those that operators add."""
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.withColumns({c: F.lit("clash") for c in ("size", "score", "host", "words", "row", "target", "taken", "kept", "node", "class_id", "length", "start", "n_words", "h", "key", "band")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules(spark, odd, none):
    out = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(odd).collect()}
    for doc_id, text, *_ in ODD:
        w = words(text)
        r = out[doc_id, len(w)]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
        assert (r.word_chars, r.n_repeat_words) == (sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert out[4, 9].n_dup_lines == 2
    assert quality_rules.quality_rules(none).count() == 0


def test_a_bad_host_goes_as_a_whole(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good + f" t{i}", "en", "good", 1) for i in range(30)] + [(100 + i, "short" if i else good, "en", "bad", 1) for i in range(30)]
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[i] for i in range(30)) and not any(out[100 + i] for i in range(30))


def test_mixing(spark, odd, none):
    documents, timeline, pieces = mixing.mix(odd)
    out = documents.collect()
    assert len(out) == len(ODD) and sum(r.size for r in out) == sum(len(words(t)) for _, t, *_ in ODD)
    by_source = defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by_source[r.target, r.source_size] += r.taken
    for (target, size), taken in by_source.items():
        assert abs(taken - target) <= max(128, size / 64)
    slots = timeline.collect()
    assert sorted(s.slot for s in slots) == list(range(len(slots)))
    ranks = defaultdict(list)
    for s in sorted(slots):
        ranks[s.source].append(s.nth)
    assert all(r == list(range(len(r))) for r in ranks.values())
    assert [tuple(r) for r in sorted(out)] == [tuple(r) for r in sorted(mixing.mix(odd)[0].collect())]
    assert mixing.mix(none)[0].count() == 0


def test_null_source_is_not_the_one_of_any_name(spark):
    rows = [(i, f"w{i} " * (5 + i % 7), "en", [None, "\0", "", "n", "s"][i % 5], 1) for i in range(60)] + [(None, "a b", "en", None, 1)] * 3
    out = mixing.mix(spark.createDataFrame(rows, DOCS))[0].collect()
    assert len(out) == len(rows) and len({(r.source_size, r.target) for r in out}) >= 4
    assert Counter(r.size for r in out) == Counter(len(words(t)) for _, t, *_ in rows)
    shared = [(i, "the same long line here\nown", "en", [None, "n", "\0"][i % 3], 1) for i in range(9)]
    kept = line_dedup.drop_boilerplate(spark.createDataFrame(shared, DOCS), sites=4)
    assert kept.agg(F.sum("n_removed")).first()[0] == 0
    assert line_dedup.drop_boilerplate(spark.createDataFrame(shared, DOCS), sites=3).agg(F.sum("n_removed")).first()[0] == 8


def test_targets_of_many_sources(spark):
    rng = random.Random(2)
    sizes = {f"h{i:04}": rng.randrange(1, 10_000) for i in range(700)}
    out = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * w[s]}
        if not full:
            want |= {s: level * w[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(want[s] for s in full)
        open_ -= full
    assert out == pytest.approx(want)


def test_schedule_spreads_sources(spark):
    plan = spark.createDataFrame([("a", 600, 10), ("b", 300, 10), ("c", 100, 10)], "source string, quota long, blocks long")
    order = [r.source for r in mixing.schedule(plan, 1000).orderBy("slot").collect()]
    for at in range(0, 1000, 100):
        n = Counter(order[at : at + 100])
        assert abs(n["a"] - 60) <= 4 and abs(n["b"] - 30) <= 4 and abs(n["c"] - 10) <= 4


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 4096, 100_003])
def test_golden_step_visits_each_cell(n):
    g = mixing.golden_step(n)
    assert len({i * g % n for i in range(n)}) == n


def test_line_dedup(spark, odd, none):
    shared = "this line is everywhere"
    rows = [(i, f"own text number {i}\n{shared}\nok", "en", f"site{i % 12}", 1) for i in range(24)] + [(50, shared, "en", "site0", 1), (50, f"other {shared}\n{shared}", "en", "site0", 1), (51, "ok\nok", "en", "z", 1)]
    out = line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOCS)).collect()
    text = defaultdict(list)
    for r in out:
        text[r.row.doc_id].append(r.text)
    assert shared in text[0][0] and all(shared not in text[i][0] for i in range(1, 24)) and all("\nok" in text[i][0] for i in range(24))
    assert sorted(text[50]) == ["", f"other {shared}"] and text[51] == ["ok\nok"]
    fewer = line_dedup.drop_boilerplate(spark.createDataFrame([r for r in rows if r[3] in {f"site{i}" for i in range(9)}], DOCS))
    assert fewer.agg(F.sum("n_removed")).first()[0] == 0
    same = {(r.row.doc_id, r.text) for r in line_dedup.drop_boilerplate(odd).collect()}
    assert same == {(d, t) for d, t, *_ in ODD}
    assert line_dedup.drop_boilerplate(none).count() == 0


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for g in range(25):
        base = rng.choices(vocabulary, k=rng.randrange(60, 200))
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 9])):
                t[rng.randrange(len(t))] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(t + passage if g % 5 == 0 else t), "en", "s", 1))
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(out) == len(rows)
    sets = {d: shingle_set(t) for d, t, *_ in rows}
    for a in sets:
        for b in sets:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and j >= 0.86:
                assert out[a] == out[b], (a, b, j)
    members = defaultdict(list)
    for d, c in out.items():
        members[c].append(d)
    for c, group in members.items():
        assert c == min(group)
        for d in group:
            assert len(group) == 1 or any(len(sets[d] & sets[e]) / len(sets[d] | sets[e]) >= 0.75 for e in group if e != d)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    from tessera.llm.components import components

    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 230 - i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def classes_of(sets, least):
    """id -> smallest id of its class, by comparing all pairs."""
    of = {d: d for d in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and least(a, b):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def weighted(texts):
    """similarity(i, j) of texts by the operator's weights, its document frequencies counted here."""
    doc, h, tf = near_dedup.shingles(pa.array(texts, pa.large_string()))
    df = np.bincount((h >> np.uint64(64 - near_dedup.DF_BITS)).astype(np.int64), minlength=1 << near_dedup.DF_BITS)
    w, at = near_dedup.weights(h, tf, near_dedup.idf_table(df, len(texts))), np.searchsorted(doc, np.arange(len(texts) + 1))
    of = [(h[at[i] : at[i + 1]], w[at[i] : at[i + 1]]) for i in range(len(texts))]
    return lambda i, j: near_dedup.similarity(of[i], of[j])


@pytest.mark.parametrize(("small", "all_meet"), [(10**6, True), (0, True), (0, False), (32, False)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, small, all_meet):
    """Families of versions without a common leader, many of them just short of the threshold, by pairs and by blocks. With all_meet, one band holds every text, so bands decide nothing."""
    monkeypatch.setattr(near_dedup, "SMALL_BAND", small)
    monkeypatch.setattr(near_dedup, "SKETCHES", 40)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 20_000)
    if all_meet:
        monkeypatch.setattr(near_dedup, "MOST_DIFFERENT", near_dedup.HASHES)
        signatures = near_dedup._signatures

        def one_band(doc, h, w):
            have, keys, sketch = signatures(doc, h, w)
            keys[:, 0] = 7
            return have, keys, sketch

        monkeypatch.setattr(near_dedup, "_signatures", one_band)
    rng = random.Random(9)
    texts = []
    for family in range(6):
        base = [f"f{family}v{i}" for i in range(90)]
        for _ in range(25):
            t = list(base)
            for at in rng.sample(range(0, 90, 6), rng.randrange(0, 4)):
                t[at] = f"e{rng.random()}"
            texts.append(" ".join(t))
    rng.shuffle(texts)
    alike = weighted(texts)
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)).collect()}
    want = classes_of(dict(enumerate(texts)), lambda a, b: alike(a, b) >= 0.8)
    assert 6 < len(set(want.values())) < 140
    if all_meet:
        assert out == want
    else:
        # Bands miss some pairs, and never join what is not alike
        assert all(want[d] == want[c] for d, c in out.items())
        assert sum(out[d] == c for d, c in want.items()) >= 0.97 * len(want)


def test_near_labels_connect_what_all_pairs_do():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, (6, near_dedup.SKETCH_WORDS), np.uint64)
    bits = base[rng.integers(0, 6, 90)] ^ (rng.integers(0, 1 << 64, (90, near_dedup.SKETCH_WORDS), np.uint64) & rng.integers(0, 1 << 64, (90, near_dedup.SKETCH_WORDS), np.uint64) & np.uint64(0x1111111111111111))
    labels = np.arange(90) // 2
    differ = lambda x, y: sum(bin(int(p) ^ int(q))[2:].zfill(64)[k : k + 4] != "0000" for p, q in zip(x, y, strict=True) for k in range(0, 64, 4))
    for most in (16, 20, 26):
        of = {}

        def root(x):
            while of.get(x, x) != x:
                x = of[x]
            return x

        want, got = [(labels[i], labels[j]) for i in range(40) for j in range(40, 90) if labels[i] != labels[j] and differ(bits[i], bits[j]) <= most], near_dedup.near_labels(bits[:40], bits[40:], labels[:40], labels[40:], most)
        classes = []
        for edges in (want, zip(*got, strict=True)):
            of.clear()
            for x, y in edges:
                of[max(root(x), root(y))] = min(root(x), root(y))
            classes.append([root(x) for x in labels])
        assert want and classes[0] == classes[1]


def test_block_links_are_the_pairs_links():
    rng = random.Random(1)
    base = rng.choices([f"v{i}" for i in range(50)], k=100)

    def text():
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(100)] = f"e{rng.randrange(30)}"
        return " ".join(t + t[:30])

    a, b = [text() for _ in range(30)], [text() for _ in range(40)]
    idf = np.linspace(0, 1, 1 << near_dedup.DF_BITS).astype(np.float32)
    i, j = near_dedup.block_links(pa.array(a), pa.array(b), np.arange(30), np.arange(100, 140), idf, 0.8)
    doc, h, tf = near_dedup.shingles(pa.array(a + b, pa.large_string()))
    w, at = near_dedup.weights(h, tf, idf), np.searchsorted(doc, np.arange(71))
    of = lambda k: (h[at[k] : at[k + 1]], w[at[k] : at[k + 1]])
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(30) for y in range(40) if near_dedup.similarity(of(x), of(30 + y)) >= 0.8}


def test_idf_does_not_depend_on_the_size_of_the_corpus():
    for n in (10**4, 10**8):
        share = np.array([1.0, 0.3, 0.05, 0.005, 0.0])
        table = near_dedup.idf_table(np.concatenate([share * n, np.zeros(10**6)]), n)[:5]
        assert np.allclose(table, np.clip(np.log(np.maximum(share, 1e-9)) / np.log(near_dedup.RARE), 0, 1), atol=1e-3)


def test_near_duplicates_odd_rows(spark, odd, none):
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    of = {r.doc_id: r.class_id for r in out}
    assert of[6] == of[7] == 6 and of[1] == of[2] == 1 and of[3] == 3 and of[4] == 4 and of[5] == 5 and of[None] is None
    assert near_dedup.near_duplicates(none).count() == 0


def test_draws_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = near_dedup.mix64(np.arange(300, dtype=np.uint64))
    h.sort()
    w = rng.uniform(1, 2, 300).astype(np.float32)
    v = np.where(rng.random(300) < 0.8, w, w * 0.3).astype(np.float32)
    a, b = near_dedup.samples(h, w, np.array([0])), near_dedup.samples(h, v, np.array([0]))
    want = near_dedup.similarity((h, w), (h, v))
    assert abs((a == b).mean() - want) < 0.2


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(tokenizer_path())


def test_word_encoder_is_the_tokenizer(encoder):
    rng = random.Random(5)
    letters = "aAbZéÉßñÑÿÀµªº.,!?'sStd’ \t\n\r\x0b\x0c\x1c\x1f\x85 　İıſKΣςσ̈́ё日本<|endoftext|>12٣²½_-#*$%&|‍😀\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>,.", "don't I'LL we're'x 's '", "", None, "x" * 5000, LONG]
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    want = [x.ids for x in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def ids_of(encoder, text, end):
    return np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(spark, odd, none, encoder):
    pieces = packing.write_pieces(odd, tokenizer_path())
    out = packing.assign_sequences(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).collect()
    want = defaultdict(Counter)
    for d, t, *_ in ODD:
        want[d][ids_of(encoder, t, 2).tobytes()] += 1
    got = defaultdict(list)
    for r in pieces.collect():
        got[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
    for d, texts in want.items():
        whole = b"".join(x[2] for x in sorted(got[d]))
        assert len(whole) == sum(len(t) * n for t, n in texts.items())
        if sum(texts.values()) == 1:
            assert whole == next(iter(texts))
            at = 0
            for start, length, ids, total in sorted(got[d]):
                assert start == at and len(ids) == 4 * length and total == len(whole) // 4
                at += length
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert Counter(zlib.crc32(bytes(r.ids)) for r in pieces.collect()) == Counter(r.ids_crc32 for r in out)
    assert packing.assign_sequences(packing.write_pieces(none, tokenizer_path()).drop("ids")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 1365, 1366, 2048, 2049, 3000, 4095, 4096, 4097, 100_001])
def test_cuts(n):
    pieces = packing.cuts(n)
    assert sum(pieces) == n and max(pieces) <= 4096
    assert all(p * packing.class_of(p) <= 4096 for p in pieces)
    assert all(p * packing.class_of(p) >= 0.97 * 4096 for p in pieces)


@pytest.mark.parametrize("n", [1, 2, 3, 9, 17, 33, 40, 63])
def test_short_documents_fill_their_sequences(spark, n):
    count = 20_000 if n < 4 else 6000
    pieces = spark.range(count).select(F.col("id").alias("uid"), F.col("id").alias("doc_id"), F.lit(n).cast("long").alias("length"), F.lit(packing.class_of(n)).alias("class"))
    r = packing.assign_sequences(pieces).agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("s")).first()
    whole = -(-count * n // 4096)
    assert r.n == count * n and r.s <= whole + 1 + whole // 60


def test_best_fit():
    rng = random.Random(7)
    lengths = [(rng.randrange(1, 400), uid) for uid in range(3000)]
    out = packing.best_fit(lengths, 1000)
    assert sorted(uid for uid, *_ in out) == list(range(3000))
    size = {uid: n for n, uid in lengths}
    spans = defaultdict(list)
    for uid, sequence, offset in out:
        spans[sequence].append((offset, size[uid]))
    for x in spans.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 1000
    assert len(spans) <= -(-sum(size.values()) // 1000) + 2


def test_little_padding(spark, encoder):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.randrange(5, 3000))), "en", "s", 1) for i in range(400)]
    out = packing.assign_sequences(packing.write_pieces(spark.createDataFrame(rows, DOCS), tokenizer_path()).drop("ids"))
    r = out.agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("s")).first()
    assert r.n / (4096 * r.s) > 0.95


def test_token_files(spark, odd, none, encoder):
    out = token_files.read_shards(spark, token_files.write_shards(odd, tokenizer_path(), shard_ids=5000)).collect()
    start = 0
    want = []
    for d, t, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(encoder, t, 1)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    assert token_files.read_shards(spark, token_files.write_shards(none, tokenizer_path())).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 400, 60)
    high = [3, 50, 49_000, 70_000, 1, 2][seed]
    ids = rng.integers(0, high, sizes.sum()).astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = token_files.pack_shard(np.arange(60), np.ones(60, bool), ids, bounds)
    shard = token_files.Shard(data)
    assert np.array_equal(shard.documents()[0], ids)
    for i in (0, 17, 59):
        assert np.array_equal(shard.document(i), ids[bounds[i] : bounds[i + 1]])
    if seed in (0, 5):
        assert len(shard.symbols) < len(ids) / 2


def best_pairs(rows):
    """query_id, rank, id, score of all pairs of a query row and a row of another id, twenty to a query id."""
    q = [(i, [max(-(2**63), min(2**63 - 1, math.floor(64 * float(c)))) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    hits = defaultdict(list)
    for a, x in q:
        if a % 20 == 0:
            for b, y in q:
                if a != b and len(x) == len(y):
                    hits[a].append((-max(-(2**63), min(2**63 - 1, sum(m * n for m, n in zip(x, y, strict=True)))), b))
    return sorted((a, n + 1, b, -s) for a, h in hits.items() for n, (s, b) in enumerate(sorted(h)[:20]))


@pytest.mark.parametrize("size", [8192, 16])
def test_top_k_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "INDEX_ROWS", size)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    schema = "vec_id long, embedding array<float>"
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.15, (300, 8)).astype(np.float32)
    v[100:140] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [float("nan")] * 8), (402, [1.0, None] + [0.0] * 6), (403, []), (404, [0.0] * 8), (None, [0.1] * 8)]
    # Rows that repeat, whole and in their ids only, queries among them
    rows += [(20, v[20].tolist()), (21, v[21].tolist()), (21, v[21].tolist()), (22, v[5].tolist()), (40, v[7].tolist()), (41, [0.5, 0.25])]
    out = topk.top_k(spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("id", "q", "score", "rank", "query", "block", "run")}), F.pmod("id", F.lit(20)) == 0).collect()
    assert sorted(map(tuple, out)) == best_pairs(rows)
    assert topk.top_k(spark.createDataFrame([], schema), F.col("id") >= 0).count() == 0
    few = topk.top_k(spark.createDataFrame(rows[:3], schema), F.col("id") >= 0)
    assert few.count() == 6


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(3)
    for scale in (1e6, 1e9, 1e17, 1e300):
        rows = [(i, (x * scale).tolist()) for i, x in enumerate(rng.normal(0, 1, (60, 3)))]
        out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.pmod("id", F.lit(20)) == 0).collect()
        assert sorted(map(tuple, out)) == best_pairs(rows), scale


def test_segments_end_early_only_on_proof():
    rng = np.random.default_rng(4)
    spread = rng.normal(0, 1, (4000, 16)) * np.array([40.0] * 3 + [0.5] * 13)
    vectors = np.floor(64 * spread).astype(np.int64)
    index = topk.ImpactIndex(np.arange(4000), vectors)
    steps = []
    index._add = lambda *a, add=index._add: (steps.append(len(a[0])), add(*a))[1]
    found = {x: (ids.tolist(), scores.tolist()) for x, ids, scores in index.search(np.arange(0, 4000, 100), vectors[::100], 20)}
    assert steps[-1] < 40 or len(steps) < len(index.segments)
    for x, (ids, scores) in found.items():
        exact = vectors @ vectors[100 * x]
        exact[100 * x] = -(2**62)
        want = np.lexsort((np.arange(4000), -exact))[:20]
        assert ids == want.tolist() and scores == exact[want].tolist()


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def rule_spans(t):
    out = [("email", *m.span()) for m in re.finditer(EMAIL, t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_rule_spans():
    rng = random.Random(3)
    texts = ["".join(rng.choice("a@.+-0123 4(5)\n%é٣x") for _ in range(60)) for _ in range(6000)]
    texts += ["call +1 (234) 555-1234 or a.b@c.de, 10.0.0.255 and 300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "", "1" * 20_000, "a@" * 5000]
    for t in texts:
        assert pii.rule_spans(t) == rule_spans(t)


def test_pii_model_adds_formats_and_leaves_prose(spark, odd, none):
    model = pii.train(["plain words stand here and there at times of the day"] * 20)
    found = model.spans("write to jane.doe [at] example [dot] com today, server 10[.]0[.]0[.]7 there")
    assert {s[0] for s in found} == {"email", "ip"} and not any(s[3] for s in found)
    assert model.spans("They met at noon. In 2024-10-12 version 1.2.3 shipped, 12345678 units sold at noon") == []
    text = "a@b.co and +1 (234) 555-1234"
    assert pii.redact(text, model.spans(text)) == "[email] and [phone]"
    out = {r.doc_id: r.spans for r in pii.find_pii(odd, model).collect()}
    assert len(out) == len({d for d, *_ in ODD}) and out[1] == [] and out[2] == []
    assert pii.find_pii(none, model).count() == 0


def test_pii_query_against_brute_force(spark, odd, tmp_path):
    """n_*, base_sha256 and spans of the query, row by row, repeated rows too."""
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    more = [(20, f'mail a.b@c.de and 10.0.0.7, token = "{secret}" here', "en", "s", 1), (20, f'mail a.b@c.de and 10.0.0.7, token = "{secret}" here', "en", "s", 1), (21, "call +1 (017) 555-7713 é4111 1111 1111 1111", "en", "s", 1)]
    spark.createDataFrame(ODD + more, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "n_spans")) for r in QUERIES["op6_pii"](spark, str(tmp_path)).collect())
    spans = {r.doc_id: r.spans for r in QUERIES["op6_pii"](spark, str(tmp_path)).collect()}
    want = Counter()
    for d, t, *_ in ODD + more:
        base = rule_spans(t or "")
        n = Counter(k for k, *_ in base)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert set(filter(None, listed.split(","))) <= set((spans[d] or "").split(","))
        want[(d, *(n[k] for k in pii.RULE_KINDS), hashlib.sha256(listed.encode()).hexdigest(), len(list(filter(None, (spans[d] or "").split(",")))))] += 1
    assert got == want
    at = more[0][1].index(secret)
    assert f"secret:{at}:{at + 40}" in spans[20]


def test_pii_recall_and_precision_on_formats_not_fitted_to():
    model = pii.train(["plain words stand here and there at times of the day"] * 20)
    rng = np.random.Generator(np.random.PCG64(99))
    hints = {"email": "contact", "ip": "server", "card": "card", "phone": "call", "secret": "token ="}
    for kind in pii.KINDS:
        hit = wrong = 0
        for _ in range(200):
            s = pii._written(rng, kind, True)
            head = f"in some other words {hints[kind]} "
            hit += any((a, b) == (len(head), len(head) + len(s)) for _, a, b, *_ in model.spans(f"{head}{s} and so on"))
            wrong += any(not rule for *_, rule, _ in model.spans(f"order no. {pii._written(rng, kind, False)} of that day"))
        assert hit >= 0.8 * 200 and wrong <= 0.1 * 200, (kind, hit, wrong)


def test_spans_within_long_rule_spans_are_not_added():
    model = pii.train(["plain words stand here and there at times of the day"] * 20)
    head = "-".join(f"10.0.0.{i}" for i in range(100))
    text = f"{head}.(0)171/2345678@mail.example.com"
    spans = model.spans(text)
    rules = [s for s in spans if s[3]]
    assert len(rules) >= 100
    assert all(b <= x or y <= a for _, a, b, rule, _ in spans if not rule for _, x, y, *_ in rules)


def test_spelled_out_addresses_are_proposed():
    for s in ("alice [AT] example [DOT] com", "alice(AT)example(DOT)com", "alice AT example DOT com", "john at example.com", "John At Example Dot Com", "a.b {At} example.org"):
        text = f"so write to {s} today"
        assert ("email", 12, 12 + len(s)) in pii.candidates(text), s
    assert [c for c in pii.candidates("they met at noon. Then at home") if c[0] == "email"] == []
    assert ("ip", 0, 21) in pii.candidates("10[DOT]0[DOT]0[DOT]77")
    model = pii.train(["plain words stand here and there at times of the day"] * 20)
    for s in ("alice [AT] example [DOT] com", "contact alice AT example DOT com", "contact john at example.com"):
        assert [x[0] for x in model.spans(s)] == ["email"], s
    assert model.spans("look at example.com") == []


def toy(n, seed):
    rng = random.Random(seed)
    syllables = ["ka", "to", "mi", "ren", "sol", "ta", "bu", "ne"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    texts, y = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(30, 120))]
        if i % 3 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = "zgrax" + rng.choice(syllables)
        texts.append(" ".join(w))
        y.append(i % 3 == 0)
    return pa.array(texts), np.array(y, float)


def test_toxicity_on_held_out_texts():
    model = toxicity.fit(*toy(300, 1))
    texts, y = toy(200, 2)
    assert ((model.scores(texts) >= 0.7) == y).mean() > 0.97
    s = model.scores(pa.array(["", None, "\x02\x03", "日本 ß"]))
    assert np.isfinite(s).all() and ((s >= 0) & (s <= 1)).all()
    flat = toxicity.fit(pa.array(["a", "b"]), np.zeros(2))
    assert flat.scores(pa.array(["x"]))[0] < 0.5
    assert 0 < toxicity.fit(pa.array([], pa.string()), np.zeros(0)).scores(pa.array(["x"]))[0] < 1


def test_sample_keeps_texts_of_any_length(spark):
    ids = [r[0] for r in spark.range(6).orderBy(F.xxhash64("id")).collect()]
    text = {d: "x" * n for d, n in zip(ids, (40_000_000, 40, 70, 30, 60, 20), strict=True)}
    docs = spark.createDataFrame([*text.items(), (ids[1], "y" * 40), (ids[1], "y" * 40), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([*((d, d % 2) for d in ids), (ids[2], None), (None, 1)], "doc_id long, toxic long")
    out = toxicity.sample(docs, labels, "toxic", F.lit(True)).orderBy("nth").collect()
    assert [r.nth for r in out] == list(range(7)) and sorted(r.text for r in out) == sorted([*text.values(), "y" * 40])
    assert [r.text for r in out if len(r.text) != 40] == [text[d] for d in ids if d != ids[1]]
    assert all(r.y == d % 2 for r in out for d in ids if r.text == text[d])
    assert [r.text for r in toxicity.sample(docs, labels, "toxic", F.lit(True), rows=1).collect()] == [text[ids[0]]]


def test_model_of_texts_that_stay_is_that_of_texts_here(spark):
    texts, y = toy(120, 5)
    docs = spark.createDataFrame(list(enumerate(texts.to_pylist())), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id")).collect()]
    here, there = toxicity.fit(texts.take(pa.array(order)), y[order]), toxicity.train(docs, labels, F.lit(True))
    assert np.allclose(here.weights, there.weights, atol=1e-4) and abs(here.bias - there.bias) < 1e-4
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert 0 < none.scores(pa.array(["x"]))[0] < 1


SOME = ["", "One two\ttwo,  ONE-and three... three", "x" * 300 + " x", "ß É日本 don't 12,5% a.b@c.de", "\x02a\x03 b", " \n ", "the the the cat sat on the the mat"]


def test_toxicity_scores_by_plain_python():
    rng = np.random.default_rng(1)
    model = toxicity.ToxicityModel(rng.normal(0, 0.3, 1 << toxicity.FEATURE_BITS), -0.4)
    mask = (1 << 64) - 1

    def feature(gram):
        h = 0
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & mask
        return (((h ^ (h >> 29)) * 0xD6E8FEB86659FD93) & mask) >> (64 - toxicity.FEATURE_BITS)

    want = []
    for text in SOME:
        z = model.bias
        for word in set(words(text)):
            marked = f"\x02{word.lower()}\x03"
            z += sum(float(model.weights[feature(marked[i : i + n])]) for n in toxicity.GRAMS for i in range(len(marked) - n + 1))
        want.append(1 / (1 + math.exp(-min(40, max(-40, z)))))
    assert model.scores(pa.array(SOME)) == pytest.approx(want, abs=1e-5)


def test_quality_scores_by_plain_python():
    from xxhash import xxh3_64_intdigest

    rng = np.random.default_rng(2)
    d = quality_model.DIMENSIONS
    at, sign = quality_model._index_vectors()
    table = np.zeros((1 << quality_model.BUCKET_BITS) * d)
    quality_model._add_contexts(table, *quality_model.buckets(pa.array(SOME)), at, sign)
    contexts = defaultdict(lambda: np.zeros(d))
    stretches = [[x for w in words(t) for x in re.findall(r"[^\W_]+|[\W_]+", w)] for t in SOME]
    codes = [[xxh3_64_intdigest(x) >> (64 - quality_model.BUCKET_BITS) for x in own] for own in stretches]
    for own in codes:
        for i, x in enumerate(own):
            for j in range(max(0, i - quality_model.WINDOW), min(len(own), i + quality_model.WINDOW + 1)):
                if i != j:
                    np.add.at(contexts[x], at[own[j]], sign[own[j]])
    assert np.array_equal(table.reshape(-1, d), np.stack([contexts[i] if i in contexts else np.zeros(d) for i in range(1 << quality_model.BUCKET_BITS)]))
    vectors = quality_model.unit_vectors(table.reshape(-1, d))
    x = []
    for own in codes:
        if not own:
            x.append(np.zeros(quality_model.WIDTH))
            continue
        v = vectors[own].astype(float)
        again = [sum(own[i] == own[i + k] for i in range(len(own) - k)) / len(own) for k in (1, 2)]
        x.append(np.concatenate([v.mean(axis=0), v.std(axis=0), [len(set(own)) / math.sqrt(len(own)), math.log1p(len(own)), *again]]))
    x = np.array(x)
    assert quality_model.pooled(pa.array(SOME), vectors) == pytest.approx(x, abs=2e-3)
    layers = (rng.normal(0, 0.2, (quality_model.WIDTH, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, 3), 0.3)
    model = quality_model.QualityModel(vectors, np.full(quality_model.WIDTH, 0.1), np.full(quality_model.WIDTH, 0.7), layers, 1.7)
    z = (np.tanh((x - 0.1) / 0.7 @ layers[0] + layers[1]) @ layers[2] + layers[3]) / 1.7
    assert model.scores(pa.array(SOME)) == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-3)


def test_quality_on_held_out_texts():
    texts, y = toy(300, 3)
    bad = pa.array([t if g == 0 else re.sub(" ", "### ", t) for t, g in zip(texts.to_pylist(), y)])
    table = np.zeros((1 << quality_model.BUCKET_BITS) * quality_model.DIMENSIONS)
    quality_model._add_contexts(table, *quality_model.buckets(bad), *quality_model._index_vectors())
    vectors = quality_model.unit_vectors(table.reshape(-1, quality_model.DIMENSIONS))
    model = quality_model.fit(vectors, quality_model.pooled(bad[:200], vectors), 1 - y[:200])
    assert ((model.scores(bad[200:]) >= 0.3) == (1 - y[200:])).mean() > 0.97
    s = model.scores(pa.array(["", None, "one"]))
    assert np.isfinite(s).all()
    assert np.isfinite(quality_model.fit(vectors, np.zeros((0, quality_model.WIDTH)), np.zeros(0)).scores(pa.array(["x", None]))).all()


@needs_tables
@pytest.mark.parametrize(("name", "label", "threshold"), [("op2_toxicity", "toxic", 0.7), ("op5_quality_classifier", "quality", 0.3)])
def test_held_out_accuracy(spark, name, label, threshold):
    out = QUERIES[name](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((out["score"] >= threshold) == (out["predicted"] == 1)).all()
    assert (out["predicted"] == out[label]).mean() > 0.97


def test_scored_keeps_rows(spark, odd, none):
    model = toxicity.fit(*toy(60, 1))
    assert quality_model.scored(odd, model, F.col("doc_id")).count() == len(ODD)
    assert quality_model.scored(none, model, F.col("doc_id")).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.y for r in toxicity.sample(odd, labels, "quality", F.lit(True)).collect()} == {1}
    assert quality_model.train(none, labels.limit(0), F.lit(True)).scores(pa.array(["x"])).shape == (1,)


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == first.columns, name
        if name == "near dedup":
            assert docs.count() == near_dedup.near_duplicates(docs).select("class_id").distinct().count()
    assert 0 < docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for stage in stages.values():
        assert stage(spark, none, str(tmp_path)).count() == 0
    key = lambda r: (r.doc_id, r.text)
    every = Counter((d, t) for d, t, *_ in ODD)
    lines = stages["line dedup"](spark, odd, str(tmp_path)).collect()
    assert Counter(map(key, lines)) == every and all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines)
    near = Counter(map(key, stages["near dedup"](spark, odd, str(tmp_path)).collect()))
    # Of 1 and 2 (no text), of the rows of 4 and of 6 and 7, one each stays
    assert near == Counter({k: 1 for k in every if k[0] not in (2, 7)})
    taken = defaultdict(list)
    for r in mixing.mix(odd)[0].collect():
        taken[r.doc_id, r.size].append(r.taken)
    mixed = Counter(map(key, stages["mixing"](spark, odd, str(tmp_path)).collect()))
    for (d, t), n in every.items():
        size = len(words(t))
        times = math.floor(sum(taken[d, size]) / len(taken[d, size]) / max(size, 1) + 0.5)
        assert mixed[d, t] == n * times, d
    packed = stages["packing"](spark, odd, str(tmp_path)).collect()
    by_doc = defaultdict(int)
    for r in packed:
        by_doc[r.doc_id] += r.length
    tokens = WordEncoder(tokenizer_path())
    want = defaultdict(int)
    for d, t, *_ in ODD:
        want[d] += len(ids_of(tokens, t, 2))
    assert by_doc == want
    kept = Counter(map(key, stages["quality classifier"](spark, odd, str(tmp_path)).collect()))
    assert not kept - every and all(n == every[k] for k, n in kept.items())


def test_workers_give_back_what_their_tasks_freed(spark, tmp_path):
    """A worker that ran the Python tasks of the pipeline's stages has little left to return."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(60_000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=2500)), "en", "s1", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)

    def probe(batches):
        import time

        for _ in batches:
            pass
        time.sleep(1)  # so that each of the workers is asked
        held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
        before = held()
        give_back()
        yield pa.RecordBatch.from_pydict({"mb": [before - held()]})

    def left():
        return max(r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(probe, "mb double").collect())

    near_dedup.document_frequencies(docs)
    assert left() < 12
    quality_model.word_vectors(docs)
    assert left() < 12
    packing.write_pieces(docs, tokenizer_path(), str(tmp_path / "pieces"))
    assert left() < 12
