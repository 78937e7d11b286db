"""The operators against brute force, the libraries themselves, or round trips, on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import ann_forest, byte_bpe, language_id, line_dedup, ngram_join, packing, quality, sharding, token_counts, url_filter

DATA = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "one", "\n\n", "a  b\tc \r\n d", "The end.\n" * 40, "na " * 3000, "你好 世界 😀 é́ İΣς \u00a0x\x1c\x85y", "#*$ %&| <>", "x" * 3000,
    "I'll don't <|endoftext|> <s> </s>", "A b c d e f g h.\nA b c X e f g h.\nA b c d f g h.", "\x00\x01",
]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("at", T.LongType()),
    T.StructField("kept", T.LongType()), T.StructField("first", T.LongType()), T.StructField("token", T.LongType()),
])


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with repeats, null ids, and further columns with names that operators use."""
    rows = [(i, t, "en", None, 0, "x", 1, 2, 3, 4, 5) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[:3] + rows[6:8] + [(None, "no id at all", None, "s", 0, *[None] * 6)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def words_of(text):
    return (text or "").encode().split()


# ---- 1


def brute_components(rows, size, num, den):
    sets, low = {}, defaultdict(list)
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    for k in sets:
        if rows[k][0] is not None:
            low[find(k)].append(rows[k][0])
    return Counter((rows[k][0], len(sets[k]), min(low[find(k)], default=None) if sets[k] else rows[k][0]) for k in sets)


@pytest.mark.parametrize("size,threshold,num,den", [(4, 0.85, 85, 100), (5, 0.8, 80, 100)])
def test_ngram_join(spark, docs, odd, size, threshold, num, den):
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    near = []
    for k in range(60):  # a chain of copies, each with another edit
        base = list(base)
        base[rng.randrange(300)] = f"e{k}"
        near.append((1000 + k, " ".join(base)))
    more = spark.createDataFrame(near, "doc_id long, text string")
    for table in (docs.select("doc_id", "text").union(more), odd.select("doc_id", "text")):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(table, size, threshold).collect())
        assert got == brute_components([(r.doc_id, r.text) for r in table.collect()], size, num, den)
    assert ngram_join.join(odd, size, threshold).columns == ["doc_id", "n_shingles", "digest", "component_id"]


@pytest.mark.parametrize("depth", [3, 8, 32])
def test_walk_keeps_pairs_past_the_path(depth):
    """Tries give every pair at the threshold, whichever of its tokens lie behind those that the path holds."""
    rng, bounds = random.Random(5), ngram_join.Bounds(0.85)
    tried = 0
    for _ in range(3000):
        n = rng.randrange(16, 41)
        fewer = bounds.least(n)
        need = [fewer, bounds.least(fewer)]
        own = sorted(rng.sample(range(1000), n))
        part = sorted(rng.sample(own, fewer))
        if own[0] != part[0]:
            continue
        tried += 1
        entry = lambda k, x: ngram_join.Entry(k, k, [], len(x), need[k], len(x) - 1, x[1 : 1 + depth], ngram_join.bitmap(np.array(x, dtype=np.uint64)))
        a, b = entry(0, own), entry(1, part)
        for first, second in ((a, b), (b, a)):
            trie = ngram_join.Trie(bounds, False)
            trie.insert(first)
            assert list(trie.walk(second)) == [first]
    assert tried > 1000


def test_ngram_join_of_rows_that_share_an_id(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    near = lambda k: text(k) + " end"
    rows = [(1, text(1)), (1, text(1)), (1, text(1)), (3, text(3)), (5, near(3)), (5, text(5)), (6, near(5)), (None, text(7)), (None, text(7)), (None, near(7)), (None, text(8)), (9, near(8)), (10, ""), (10, ""), (None, None)]
    table = spark.createDataFrame([(i, t, f"x{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, more string")
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    groups = Counter((t or "").split("w")[0] for _, t in got)
    assert groups == {"t1": 1, "t3": 1, "t5": 1, "t7": 1, "t8": 1, "": 3}
    assert {(1, text(1)), (3, text(3)), (5, text(5)), (9, near(8))} <= set(got)
    joined = ngram_join.join(table.where("doc_id IS NULL OR doc_id = 9"), 5, 0.8).collect()
    assert Counter(r.component_id for r in joined) == {9: 2, None: 4}
    parts = ngram_join._components(table, 5, 0.8, "doc_id", "text").where("n > 0 AND id IS NULL").groupBy("component").count().collect()
    assert sorted(r["count"] for r in parts) == [1, 3]


def test_tries_are_bounded(spark, monkeypatch):
    """300 lists of one token are dealt into small tries, and all pairs are found as by a single one."""
    bounds, rng = ngram_join.Bounds(0.85), random.Random(8)
    paths = [sorted(rng.sample(range(12), 8)) for _ in range(300)]
    full = b"\xff" * 8  # bitmaps that exclude nothing
    lists = spark.createDataFrame([(k, [-2 - k % 50, -1, *path], full) for k, path in enumerate(paths)], "digest long, shared array<long>, bits binary")
    table = spark.createDataFrame([(-1, k, k, 64, 5, 1) for k in range(300)], "token long, digest long, component long, n long, need int, at int")
    entry = lambda k: ngram_join.Entry(k, k, [-2 - k % 50], 64, 5, 8, paths[k], full)
    expect = set(ngram_join._pairs(iter([(False, entry(k)) for k in range(300)]), bounds, False))
    assert expect == {(a, b) for a in range(300) for b in range(a + 1, 300) if a % 50 != b % 50 and len(set(paths[a]) & set(paths[b])) >= 4}
    forest = list(ngram_join._pairs(iter([(False, entry(k)) for k in range(300)]), bounds, True))
    assert len(forest) == 299 and set(forest) <= expect
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(ngram_join, "HELD", 50)
    held = ngram_join._blocked(table).where(F.col("role") == ngram_join.OWN).groupBy("token", "block").count().collect()
    assert len(held) == 15 and max(r["count"] for r in held) < 60
    got = {tuple(r) for r in ngram_join._tried(table, lists, bounds, False).collect()}
    assert len(expect) > 1000 and got == expect


def test_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies with similarities close around the threshold are joined by few comparisons, not by nearly all pairs."""
    rng, rows, compared = random.Random(3), [], []
    for k in range(600):
        words = [f"w{j}" for j in range(150)]
        for e in range(rng.choice((1, 1, 2, 2, 2, 3))):
            words[rng.randrange(150)] = f"e{k}x{e}"
        rows.append((k, " ".join(words)))
    compare = ngram_join._compared

    def counting(pairs, *more):
        pairs = pairs.cache()
        compared.append(pairs.count())
        return compare(pairs, *more)

    monkeypatch.setattr(ngram_join, "_compared", counting)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows, 4, 85, 100)
    assert sum(compared) < 6 * len(rows), compared


def test_what_bitmaps_let_expect():
    """The expected difference is that of the sets, by and large and rather more, and full bitmaps rule nothing out."""
    rng, bounds = np.random.default_rng(2), ngram_join.Bounds(0.85)
    for n, lost in ((40, 3), (150, 12), (150, 30), (3000, 200)):
        members = rng.integers(0, 1 << 63, n + lost, dtype=np.uint64)
        a, b = members[:n], members[lost:]
        over, deviation = bounds.excess(n, ngram_join.Bits(ngram_join.bitmap(a)), n, ngram_join.Bits(ngram_join.bitmap(b)))
        error = over - (2 * lost - 2 * n * (1 - 2 * 85 / 185))
        assert -4 * deviation <= error <= 4 * deviation + 0.2 * lost and 0 < deviation < 6 + lost / 10
    full = ngram_join.Bits(b"\xff" * 8)
    assert bounds.excess(64, full, 64, full)[0] < 0


def test_no_task_gets_all_lists_of_a_token(spark):
    """20,000 lists of one token: every two blocks meet in one trie, and a trie with those that walk it stays bounded."""
    table = spark.range(20_000).selectExpr("-1L AS token", "id AS digest", "id AS component")
    blocked = ngram_join._blocked(table).cache()
    tasks = blocked.groupBy("token", "block", "part").agg(F.count("*").alias("n"), F.count_if(F.col("role") != ngram_join.WALKER).alias("held")).collect()
    assert len({r.block for r in tasks}) == 10 and len(tasks) == 5 * 1 + 4 * 2 + 1 * 3  # blocks 0 to 4, 5 to 8, and 9
    assert max(r.n for r in tasks) < 1.2 * (1 + ngram_join.WALKERS) * ngram_join.BLOCK and max(r.held for r in tasks) < 1.2 * ngram_join.BLOCK
    met = blocked.groupBy("block", "part", "own").agg(F.max("role").alias("role")).collect()
    walked = [(r.block, r.own) for r in met if r.role == ngram_join.WALKER]
    assert sorted(walked) == [(b, a) for b in range(10) for a in range(b)]
    assert blocked.where(F.col("role") == ngram_join.OWN).count() == 20_000
    blocked.unpersist()


def test_ngram_join_at_the_threshold(spark):
    """Sets of all sizes, pairs of which lie just above, at and just below the threshold, with shared passages."""
    rng = random.Random(11)
    passage = [f"p{j}" for j in range(200)]
    rows = []
    for k in range(150):
        n = rng.randrange(4, 60)
        at = rng.randrange(150)
        own = [f"k{k}w{j}" for j in range(n)] + passage[at : at + rng.randrange(50)]
        rng.shuffle(own) if k % 3 == 0 else None
        for edit in range(4):
            cut = max(0, round(len(own) * rng.choice((0.05, 0.1, 0.14, 0.15, 0.16, 0.2))))
            rows.append((10 * k + edit, " ".join(own[cut:] if edit % 2 else own[: len(own) - cut] + [f"x{k}"])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for size, threshold, num in ((1, 0.85, 85), (4, 0.85, 85), (5, 0.8, 80)):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(table, size, threshold).collect())
        assert got == brute_components(rows, size, num, 100)


def test_ngram_join_of_nothing(none):
    assert ngram_join.join(none).count() == 0
    assert ngram_join.keep_one(none).columns == none.columns


# ---- 2


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(odd, docs, none, shards):
    for table in (odd, docs):
        rows = sharding.shard(table, shards).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in table.collect())
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[k]) for k in range(shards)]
        assert max(counts) - min(counts) <= 1
        assert Counter(map(tuple, rows)) == Counter(map(tuple, sharding.shard(table.repartition(3), shards).collect()))
    assert sharding.shard(none, shards).count() == 0


def test_place_is_a_permutation(spark):
    for n in (1, 2, 5, 64, 1000):
        got = [r[0] for r in spark.range(n).select(sharding.place(F.col("id"), n, 3)).collect()]
        assert sorted(got) == list(range(n))


def second_place(number, rows, seed, hashes):
    """The network again, from its definition: halves swapped through a keyed hash, walked until below rows."""
    half = max(1, ((max(rows, 2) - 1).bit_length() + 1) // 2)
    while True:
        left, right = number >> half, number & ((1 << half) - 1)
        for k in range(sharding.ROUNDS):
            left, right = right, left ^ (hashes(seed, k, right) & ((1 << half) - 1))
        number = (left << half) | right
        if number < rows:
            return number


def xxh64_of(spark, seed, rounds, values):
    table = spark.createDataFrame([(k, v) for k in range(rounds) for v in values], "k int, v long")
    return {(r.k, r.v): r.h for r in table.select("k", "v", F.xxhash64(F.lit(seed), "k", "v").alias("h")).collect()}


def test_place_follows_the_network(spark):
    """Every place against a second implementation, for counts around the powers of four and shards of a whole table."""
    for n in (1, 3, 4, 5, 63, 64, 65, 300):
        known = xxh64_of(spark, 11, sharding.ROUNDS, range(64))
        got = [r[0] for r in spark.range(n).select(sharding.place(F.col("id"), n, 11)).collect()]
        assert got == [second_place(k, n, 11, lambda s, k, v: known[k, v]) for k in range(n)]


def test_sharding_by_hand(spark, docs):
    """op2's rows: numbered by hash range and content, placed by the second implementation, dealt by remainder."""
    sizes = docs.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"))
    rows = sizes.withColumn("h", F.xxhash64("doc_id", "size", "text_crc32")).collect()
    order = sorted(rows, key=lambda r: ((r.h % (1 << 64)) >> (64 - 14), r.h, r.doc_id))
    known = xxh64_of(spark, 2026, sharding.ROUNDS, range(1 << ((len(rows) - 1).bit_length() + 1) // 2))
    expect = set()
    for k, r in enumerate(order):
        p = second_place(k, len(rows), 2026, lambda s, k, v: known[k, v])
        expect.add((r.doc_id, r["size"], r.text_crc32, p % 8, p // 8))
    from barloom.llm import queries

    assert {(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in queries.QUERIES["op2_sharding"](spark, DATA).collect()} == expect


# ---- 3


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 16)).round(3)
    x[100:250] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [None] + [1.0] * 15), (1400, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_forest.nearest(table, F.col("vec_id") % 100 == 0, block=200, trees=32, share=0.6).toPandas()
    hits = 0
    for q in range(0, 900, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(900), far)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, far[own.vec_id])
        assert own[["score", "vec_id"]].apply(tuple, axis=1).is_monotonic_increasing
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 81 and set(got.query_id) == set(range(0, 900, 100))
    few = ann_forest.nearest(table.where("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3 and ann_forest.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_matches_climb_together():
    """The rows of a query are those that share the longest prefix, of one length in all trees, that gives enough."""
    rng = np.random.default_rng(3)
    x, q, planes = rng.standard_normal((300, 8)), rng.standard_normal((20, 8)), rng.standard_normal((6, 10, 8))
    x[5] = q[3]
    mean = x.mean(axis=0)
    sides = lambda v: np.stack([(v - mean) @ tree.T > 0 for tree in planes])
    for enough in (1, 40, 299, 300):
        for j, found in enumerate(ann_forest.matches(x, q, planes, mean, enough)):
            same = sides(x) == sides(q[j : j + 1])
            lengths = np.where(same.all(axis=2), 10, np.argmin(same, axis=2))
            by_depth = [np.flatnonzero((lengths >= d).any(axis=0)) for d in range(11)]
            depth = max(d for d in range(11) if d == 0 or len(by_depth[d]) >= enough)
            assert found.tolist() == by_depth[depth].tolist()


def test_nearest_of_given_vectors(spark):
    """Recall over a whole table with the defaults, and exact scores."""
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = table.collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    ids = np.array([r.vec_id for r in rows])
    got = ann_forest.nearest(table, F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, [far[np.flatnonzero(ids == v)[0]] for v in own.vec_id], rtol=1e-12)
        best = [ids[i] for i in np.lexsort((ids, far)) if ids[i] != ids[q]][:10]
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_nearest_of_repeated_rows(spark):
    rows = [(5, [1.0, 2.0])] * 11 + [(i, [1.0, 2.0]) for i in range(6, 21)]
    got = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(5, 20)).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(5, k + 1, 6 + k, 0.0) for k in range(10)} | {(20, k + 1, 5 + k, 0.0) for k in range(10)}


# ---- 4


def test_nearest_of_shared_ids(spark):
    """Several vectors under one id are rows of their own: each gets its ten, the others of its id among them."""
    rows = [(100, [1.0, 0.1 * k]) for k in range(4)] + [(i, [1.0, 0.05 * i]) for i in range(1, 15)]
    got = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    expect = Counter()
    for k, (_, v) in enumerate(rows[:4]):
        far = sorted((math.dist(v, w), i) for j, (i, w) in enumerate(rows) if j != k)[:10]
        expect.update((100, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(far))
    assert Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == expect


def test_quality(odd, docs, none):
    for table in (odd, docs):
        for r in quality.measure(table.select("doc_id", "text")).collect():
            words = [w.decode() for w in words_of(r.text)]
            windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
            times = Counter(windows)
            at = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
            seen, dup = set(), 0
            for line in (r.text or "").split("\n"):
                if line.encode().split():
                    dup += line in seen
                    seen.add(line)
            failed = len(words) < 50 or 100 * len(at) > 50 * len(words)
            expect = (len(words), sum(map(len, words)), sum((r.text or "").count(c) for c in "#*$%&|<>"), dup, len(at), failed)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expect
            assert not (r.base_failed and r.kept)
    cleaned = quality.clean(docs)
    assert cleaned.columns == docs.columns and 0 < cleaned.count() < docs.count()
    assert quality.clean(odd).columns == odd.columns and quality.clean(none).count() == 0


# ---- 5


def test_token_counts(odd, docs, none):
    path = P.path("piece_bpe_32k.model")
    model = token_counts.counter(path).model
    for table in (odd, docs):
        for chunk, overlap in ((32768, 256), (200, 4)):
            got = Counter(map(tuple, token_counts.count_tokens(table, path, 100, chunk, overlap).collect()))
            assert got == Counter((r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 100) for r in table.collect())
    assert token_counts.count_tokens(none, path).count() == 0


# ---- 6


def test_packing(odd, docs, none):
    path = P.path("word_bpe_49k.json")
    tokenizer = packing.encoder(path).tokenizer
    for table in (odd, docs):
        for window in (2048, 64):
            rows = packing.pack(table, path, window, bucket=70).collect()
            expect = Counter()
            for r in table.collect():
                ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    expect[(r.doc_id, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
            assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expect
            spans = defaultdict(list)
            for r in rows:
                spans[r.sequence_id].append((r.offset, r.length))
            for own in spans.values():
                end = 0
                for offset, length in sorted(own):
                    assert offset == end
                    end += length
                assert end <= window
    assert packing.pack(none, path).count() == 0


def test_ids_are_the_library_s():
    """Whole texts by the library, among letters that normalise, marks behind them, special strings and odd spaces."""
    import pyarrow as pa

    own = packing.Encoder(P.path("word_bpe_49k.json"))
    rng = random.Random(1)
    letters = list("abcXYZ019.,'!<>|# \n\t \x1c\x85İıΣςſKÅéé̀स़क़ख़य़שׁיִפֿשׁ你好😀\u200d\u0345ǅÿß÷×")
    whole = ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "İ.", "TİCARİ,", "क़.", "שׁ.", "é.", "Ñ,", "×.", "ab.\n,c", "."]
    whole += [c + m for c in [*map(chr, range(0xC0, 0x180)), *map(chr, range(0x958, 0x960)), *map(chr, range(0xFB1D, 0xFB4F))] for m in ",."]
    for _ in range(40):
        texts = ["".join(rng.choices(letters + whole[:13] + rng.sample(whole, 5), k=rng.randrange(30))) for _ in range(200)] + [None, "", *whole]
        texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
        ids, ends = own.encode(pa.array(texts, pa.string()).fill_null("").slice(1))
        parts = np.split(ids, ends[:-1])
        assert [x.tolist() for x in parts] == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]


def naive_place(lengths, window):
    """By the sum of squares over all levels, written out."""
    levels, windows = [], []
    for size in lengths:
        best = None
        for w in [*range(len(levels)), None]:
            after = [*levels[:w], levels[w] + size, *levels[w + 1 :]] if w is not None else [*levels, size]
            if max(after) <= window:
                squares = sum(n * n for level, n in Counter(after).items() if level < window)
                key = (squares, -(levels[w] if w is not None else 0))
                if best is None or key < best[0]:
                    best = key, (levels[w] if w is not None else 0), w is None
        _, level, new = best
        if new:
            levels.append(size)
        else:
            levels[levels.index(level)] += size
        windows.append(level)
    return windows


def test_sum_of_squares_choice():
    windows, offsets = packing.place(np.array([6, 6, 4, 10, 4]), 10)
    assert offsets.tolist() == [0, 0, 6, 0, 6] and len(set(windows.tolist())) == 3
    rng = random.Random(9)
    for _ in range(150):
        window = rng.randrange(2, 25)
        lengths = [rng.randrange(1, window + 1) for _ in range(rng.randrange(1, 50))]
        windows, offsets = packing.place(np.array(lengths), window)
        assert offsets.tolist() == naive_place(lengths, window)
        filled = Counter()
        for w, offset, size in zip(windows.tolist(), offsets.tolist(), lengths):
            assert filled[w] == offset
            filled[w] += size


def test_packing_deals_repeated_rows(spark):
    table = spark.createDataFrame([(1, "a b c")] * 400 + [(2, None)], "doc_id long, text string")
    rows = packing.pack(table, P.path("word_bpe_49k.json"), bucket=100).collect()
    assert len(rows) == 401 and len({(r.sequence_id, r.offset) for r in rows}) == 401 and len({r.sequence_id >> 32 for r in rows}) > 1


# ---- 7


def test_language(spark, docs, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = language_id.fit(big.where(~held), "lang")
    judged = language_id.fuse(language_id.text_scores(big.where(held).withColumn("nothing", F.lit(None).cast("string")), model), model, host=F.col("source"))
    n, right, kept = judged.agg(F.count("*"), F.sum((F.col("lang") == F.col("li_language")).cast("int")), F.sum(F.col("li_kept").cast("int"))).first()
    assert right >= 0.98 * n and kept >= 0.98 * n  # held-out accuracy without the declared language
    out = language_id.fuse(language_id.text_scores(odd, model), model, declared=F.col("lang"), suffix=F.col("source"), host=F.col("source"))
    assert out.count() == odd.count() and out.where("text IS NULL AND (li_language <> 'und' OR li_kept)").count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    assert language_id.keep_identified(none).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("li_prior", "li_text", "li_host", "li_row", "li_kept")})
    assert language_id.keep_identified(clash).columns == clash.columns and language_id.keep_identified(clash).count() == kept.count()


def test_rare_languages(spark):
    """Languages of 60 and of 3 among 9,000 labelled rows stay, in another script and beside a related one."""
    rng = random.Random(4)
    speech = {"es": "aeiou lrsnd", "pt": "aeiou lrsnd ãõç", "el": "αβγδε ζηθικ", "fi": "äöykkä aitu"}
    text = lambda k: " ".join("".join(rng.choices(speech[k].replace(" ", ""), k=5)) for _ in range(40))
    langs = ["es"] * 9000 + ["pt"] * 60 + ["el"] * 60 + ["fi"] * 3
    table = spark.createDataFrame([(i, text(k), k, "s") for i, k in enumerate(langs)], "doc_id long, text string, lang string, source string")
    kept = Counter(r.lang for r in language_id.keep_identified(table).select("lang").collect())
    assert kept == Counter(langs)


def test_all_pages_count(spark, docs):
    model = language_id.fit(docs, "lang")
    text = {k: docs.where(F.col("lang") == k).orderBy(F.length("text").desc()).first().text for k in ("de", "en")}
    rows = [(i, text["en" if i % 2 else "de"], "en" if i % 2 else "de", "src") for i in range(200)] + [(900, "in", None, "src"), (901, "in", None, "src"), (901, "in", None, "src"), (None, text["en"], "en", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    said = [(i, "en" if i % 2 else "de", None, f"h{i % 2}.org") for i in range(200)]
    # of the pages of 900 the first declares nothing, and the other says German; of 901 three say English
    said += [(900, None, None, "x.org"), (900, "de", None, "h0.org"), (901, "de", None, "h0.org")] + [(901, "en", None, "h1.org")] * 3
    pages = spark.createDataFrame(said, "doc_id long, declared string, suffix string, host string")
    scored = language_id.text_scores(table, model).drop("text")
    out = language_id.fuse_pages(scored, pages, model, "lang", "source")
    got = Counter((r.doc_id, r.li_language) for r in out.collect())
    assert got == Counter([(i, "en" if i % 2 else "de") for i in range(200)] + [(900, "de"), (901, "en"), (901, "en"), (None, "en")])
    none = {r.doc_id: r for r in language_id.fuse_pages(scored, pages.limit(0), model, "lang", "source").where("doc_id < 900").collect()}
    single = {r.doc_id: r for r in language_id.fuse(scored, model, None, None, F.col("source")).where("doc_id < 900").collect()}
    assert all(abs(none[i].li_confidence - single[i].li_confidence) < 1e-9 and none[i].li_language == single[i].li_language for i in range(200))


def by_hand(rows, names, settings):
    """Language and confidence of rows (scores, declared, suffix, host), by the definition."""
    import math

    best = [names[int(np.argmax(s))] if s is not None else "und" for s, *_ in rows]
    world = {k: (best.count(k) + 1) / (len(rows) + len(names)) for k in names}

    def said(at):
        known = sorted({r[at] for r in rows if r[at]} | set(names) - {"und"})
        rate = lambda x, k: settings.trust if x == k else 1 / len(known) if k == "und" else (1 - settings.trust) / len(known)
        count = Counter((r[at], b) for r, b in zip(rows, best))
        total = Counter(b for r, b in zip(rows, best) if r[at])
        return lambda x, k: math.log((count[(x, k)] + settings.prior * rate(x, k)) / (total[k] + settings.prior)) if x else 0.0

    declared, suffix, a = said(1), said(2), settings.prior
    domain = lambda h: ".".join(h.split(".")[-2:])
    out = []
    for scores, d, x, host in rows:
        if scores is None:
            out.append(("und", 0.0))
            continue
        fused = []
        for i, k in enumerate(names):
            of = lambda test: (sum(b == k and test(r[3]) for r, b in zip(rows, best)), sum(test(r[3]) for r in rows))
            (d_n, d_all), (h_n, h_all) = of(lambda h: domain(h) == domain(host)), of(lambda h: h == host)
            prior = (h_n + a * (d_n + a * world[k]) / (d_all + a)) / (h_all + a)
            fused.append(scores[i] + math.log(prior) + declared(d, k) + suffix(x, k))
        top = max(fused)
        out.append((names[fused.index(top)], 1 / sum(math.exp(v - top) for v in fused)))
    return out


def test_fusion_by_hand(spark, docs):
    settings, rng = language_id.Settings(), random.Random(13)
    model = language_id.fit(docs, "lang")
    names = [*model.languages, "und"]
    hosts = ["a.x.org", "b.x.org", "c.y.org", "z.net"]
    rows = [(i, r.text if i % 9 else None, rng.choice([None, "en", "de", "xx"]), rng.choice([None, "fr"]), rng.choice(hosts)) for i, r in enumerate(docs.select("text").limit(120).collect())]
    table = spark.createDataFrame([(i, (t or "")[: rng.choice((3, 12, 5000))] or None, d, x, h) for i, t, d, x, h in rows], "doc_id long, text string, d string, x string, h string")
    scored = language_id.text_scores(table, model).cache()
    given = sorted(scored.collect(), key=lambda r: r.doc_id)
    named = lambda v: v if v in names else None
    expect = by_hand([(r.li_scores, named(r.d), named(r.x), r.h) for r in given], names, settings)
    got = sorted(language_id.fuse(scored, model, F.col("d"), F.col("x"), F.col("h")).collect(), key=lambda r: r.doc_id)
    assert [r.li_language for r in got] == [k for k, _ in expect]
    assert np.allclose([r.li_confidence for r in got], [c for _, c in expect])


def test_declaration_far_into_a_page(spark):
    page = spark.createDataFrame([("http://a.org/x", "<!--" + "c" * 9000 + '--><html lang="de">')], "url string, html string")
    assert language_id.page_evidence(page).first().declared == "de"


def test_page_evidence(spark):
    rows = [("http://a.b.de/x", "<html><p>"), ("https://h.example.org/fr/1?x", '<html class=x lang="fr-CA">'), (None, None)]
    got = language_id.page_evidence(spark.createDataFrame(rows, "url string, html string")).select("declared", "suffix", "host").collect()
    assert list(map(tuple, got)) == [(None, "de", "a.b.de"), ("fr-CA", "fr", "h.example.org"), (None, None, "")]


# ---- 8

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_url_rules(spark):
    urls = {
        "http://WWW.Example.NET/en/1": ("www.example.net", "/en/1", "example.net/en/", "allow"), "x://a.net": ("a.net", "", None, "allow"),
        "x://a.net/?q": ("a.net", "/", "net/", "block"), "http://org/fr/": ("org", "/fr/", "org/fr/", "allow"), None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), "http://myexample.com/de/": ("myexample.com", "/de/", None, "allow"), "a://b.example.com/de/x#y": ("b.example.com", "/de/x", "example.com/de/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none, RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filter.judge(pages.limit(0), none, RULES).count() == 0


def test_url_tree(spark):
    rows = [(i, f"http://h.org/spam/{i}") for i in range(200)] + [(1000 + i, f"http://h.org/news/{i}.html") for i in range(200)] + [(2000 + i, f"http://h.org/tag-{chr(97 + i % 26)}{chr(97 + i // 26)}/x") for i in range(100)]
    labels = [(i, True) for i in range(40)] + [(1000 + i, False) for i in range(40)] + [(5, False)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"), RULES)
    got = {(r[0], r[1], round(r[2], 4)): r[3] for r in out.groupBy("template", "verdict", "bad_share").count().collect()}
    # half of the labelled pages are bad, and so is what nothing is known of
    assert got == {("spam/#", "block", round(42.5 / 45, 4)): 200, ("news/#.html", "allow", round(2.5 / 45, 4)): 200, ("*/*", "block", 0.5): 100}


def test_url_tree_wide_and_deep(spark):
    def urls():
        for i in range(120):
            yield f"http://h.org/sec-{chr(97 + i % 26)}{chr(97 + i // 26)}/page/{i}", None if i % 3 else False
        for i in range(60):  # one of 121 sections is bad; of two branches at the fifth segment, one
            yield f"http://h.org/pills/page/{i}", True if i < 40 else None
            yield f"http://g.org/a/b/c/spam/x/{i}", True if i < 30 else None
            yield f"http://g.org/a/b/c/news/x/{i}", False if i < 30 else None
            yield f"http://f.org/{'d/' * 7}bad/top/in/{i}", True if i < 30 else None
            yield f"http://f.org/{'d/' * 7}good/top/in/{i}", False if i < 30 else None

    rows = [(i, *r) for i, r in enumerate(urls())]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if b is not None], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, []).collect()}
    assert got == {i: "block" if any(x in u for x in ("/pills/", "/spam/", "/bad/")) else "allow" for i, u, _ in rows}


# ---- 9


def brute_lines(rows, least=8):
    seen, by_length, gone = set(), defaultdict(list), defaultdict(set)
    done = set()
    for i, h, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if (i, h) in done:
            continue
        done.add((i, h))
        for k, line in enumerate((t or "").encode().split(b"\n")):
            if not (w := line.split()):
                continue
            near = len(w) >= least and any(line_dedup.within_one(w, o) for n in (-1, 0, 1) for o in by_length[len(w) + n])
            if tuple(w) in seen or near:
                gone[(i, h)].add(k)
            if tuple(w) not in seen:
                seen.add(tuple(w))
                if len(w) >= least:
                    by_length[len(w)].append(w)
    return {k: sorted(v) for k, v in gone.items()}


def test_line_dedup(spark, odd, docs, none):
    lines = ["the quick brown fox jumps over the lazy dog today", "one two three"]
    edits = [f"the quick brown fox {w} over the lazy dog today" for w in "abcdefgh"] + ["the quick brown fox jumps over lazy dog today", "the quick the brown fox jumps over the lazy dog today", "quick the brown fox jumps over the lazy dog today"]
    made = spark.createDataFrame([(i, "\n".join([edits[i % len(edits)], lines[i % 2], "", edits[(i * 7 + 3) % len(edits)]])) for i in range(30)], "doc_id long, text string")
    for table in (made, odd.select("doc_id", "text"), docs.select("doc_id", "text")):
        got = {(r.id, r.text_hash): r.removed for r in line_dedup.removed_lines(table).collect()}
        assert got == brute_lines([tuple(r) for r in table.select("doc_id", F.xxhash64("text"), "text").collect()])
    out = line_dedup.dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.judged(odd).count() == odd.count()
    named = made.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")).alias("doc_id"), "text", F.lit(1).alias("removed"), F.lit(2).alias("g_removed"))
    by_name, by_number = line_dedup.dedup(named), line_dedup.dedup(made)
    assert by_name.columns == named.columns
    assert Counter(r.text for r in by_name.collect()) == Counter(r.text for r in by_number.collect()) != Counter(r.text for r in made.collect())
    assert line_dedup.dedup(none).count() == 0


def test_common_lines_are_not_dealt(spark):
    """A line that a third of all lines repeat is met through a broadcast; what goes is the same for every share."""
    rows = [(k, "the one line that all documents share here\n" + f"and a line of number {k}\n" + ("rare pair" if k % 700 == 3 else f"own {k}")) for k in range(2500)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.removed_lines(table)
    got = {r.id: r.removed for r in found.collect()}
    assert got == {k: [0, 2] if k % 700 == 3 and k > 3 else [0] for k in range(1, 2500)}
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()


def test_variants_name_the_same_line():
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(2, 12))]
        found = line_dedup.variants(w)
        assert all(found[1 + i] == line_dedup.variants(w[:i] + w[i + 1 :])[0] for i in range(len(w)))


# ---- 10


def test_byte_bpe(odd, docs, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.codec(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for table in (odd, docs):
        expect = Counter()
        for r in table.collect():
            ids = library.encode_ordinary(r.text or "")
            expect[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
        assert Counter(map(tuple, byte_bpe.digests(table, path, P.PATTERN).collect())) == expect
        back = byte_bpe.decode(byte_bpe.encode(table, path, P.PATTERN), path, P.PATTERN)
        assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((r.doc_id, (r.text or "").encode()) for r in table.collect())
    assert byte_bpe.digests(none, path, P.PATTERN).count() == 0


def test_byte_bpe_of_long_pieces():
    import tiktoken

    own = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["".join(rng.choices(letters, k=n)) for letters, n in (("etaoinshrdlu", 100_000), ("a", 30_000), ("ab", 5_000), ("的一是不了在人有我他", 12_000), ("กขคงจ", 3_000))]
    texts += ["".join(rng.choices("etaoinsh", k=900)) for _ in range(40)]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(own.encode(texts[:2])) == [t.encode() for t in texts[:2]]
    for n in (2, 3, 30, 400):  # as the recursive query does
        piece = "".join(rng.choices("etaoinsh", k=n)) + "qz"
        own.learn([piece])
        assert own.contract(piece.encode()).tolist() == own.known[piece].tolist()


# ---- very long texts


@pytest.fixture(scope="module")
def long_texts(spark):
    """Texts of 1.2 million characters, one with other words and one in a single line without spaces, among short ones."""
    rng = random.Random(21)
    words = ["".join(rng.choices("etaoinshrdlucm", k=rng.randrange(1, 9))) for _ in range(4000)]
    lines = [" ".join(rng.choices(words, k=rng.randrange(3, 30))) + rng.choice([".", "", "!"]) for _ in range(17_000)]
    long = "\n".join(lines)
    other = "\n".join([*lines[:-40], "the end of it all."])
    rows = [(1, long), (2, other), (3, "x" * 200_000), (4, "short and sweet."), (5, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")


def test_long_texts(spark, long_texts):
    import tiktoken

    rows = {r.doc_id: r.text or "" for r in long_texts.collect()}
    assert len(rows[1]) > 1_000_000
    joined = {r.doc_id: r.component_id for r in ngram_join.join(long_texts).collect()}
    assert joined == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert sorted(r.slot for r in sharding.shard(long_texts, 1).collect()) == [0, 1, 2, 3, 4]
    for r in quality.measure(long_texts.select("doc_id", "text")).collect():
        w = words_of(rows[r.doc_id])
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
    model = token_counts.counter(P.path("piece_bpe_32k.model")).model
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(long_texts, P.path("piece_bpe_32k.model")).collect()} == {i: len(model.encode(t)) for i, t in rows.items()}
    path = P.path("word_bpe_49k.json")
    tokenizer = packing.encoder(path).tokenizer
    assert {r.doc_id: r.doc_tokens for r in packing.pack(long_texts, path).collect()} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    assert language_id.keep_identified(long_texts).count() >= 1
    gone = {r.id: len(r.removed) for r in line_dedup.judged(long_texts).collect()}
    assert gone[2] >= 16_900 and gone[3] == gone[4] == gone[5] == 0
    ranks = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.codec(ranks, P.PATTERN).ranks, special_tokens={})
    for r in byte_bpe.digests(long_texts, ranks, P.PATTERN).collect():
        ids = library.encode_ordinary(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


# ---- pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA).cache()
        assert now.columns == docs.columns, name
    expect = sum(r.doc_tokens for r in corpus_pipeline.STAGES[-1][1](spark, now, DATA).where("start = 0").collect())
    got = corpus_pipeline.run(spark, DATA)
    assert got.agg(F.sum("length")).first()[0] == expect
    texts = [r.text for r in now.select("text").collect()]
    assert len(set(texts)) == len(texts) > 100


def test_pipeline_of_odd_tables(spark, docs, tmp_path):
    """Nulls, empty texts, repeated rows, further columns with names that operators use, and no rows at all."""
    import corpus_pipeline

    some = docs.limit(40)
    blank = some.limit(6).withColumns({"text": F.when(F.col("doc_id") % 2 == 0, F.lit("")), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    nameless = some.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    names = ["removed", "kept", "li_prior", "q_words", "token", "component", "id", "digest", "g_row", "copy", "text_hash"]
    odd_docs = some.union(some.limit(10)).union(blank).union(nameless).withColumns({c: F.lit(7) for c in names})
    for name, table in (("odd", odd_docs), ("none", odd_docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        now = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path / name)).cache()
            assert now.columns == odd_docs.columns, stage_name
        kept = now.select("text", "removed").collect()
        assert all(r.removed == 7 and r.text for r in kept) and len({r.text for r in kept}) == len(kept)
        assert (len(kept) > 10) == (name == "odd")
        assert corpus_pipeline.run(spark, str(tmp_path / name)).where("start = 0").count() == len(kept)


@pytest.mark.parametrize("name", ["op1_ngram_join", "op4_quality_rules", "op8_url_filter", "op9_line_dedup", "op11_merkle_manifest", "op12_source_divergence", "op13_exact_dedup"])
def test_oracle(spark, name):
    import oracle

    from barloom.llm import oracles, queries

    assert oracle.compare(spark, DATA, queries.QUERIES[name], oracles.ORACLES[name]) == ""
