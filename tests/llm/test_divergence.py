"""The audit against plain sums over all kept terms and groups."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import divergence

SCHEMA = "doc_id int, lang string, source string, text string, part int, name int, term int, n int, value int"


def brute(rows, least, scale):
    """pairs and terms by name."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    pairs, terms = {}, {}
    for lang, names in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in names:
            whole.update(counts[lang, s])
        total = {s: sum(counts[lang, s][t] for t in kept) for s in names}
        share = lambda n, size: 1 + scale * (n + 1) // (size + len(kept))
        for s in names:
            for o in names - {s}:
                p = [(share(counts[lang, s][t], total[s]), share(counts[lang, o][t], total[o])) for t in kept]
                pairs[lang, s, o] = sum((a - b) ** 2 // b for a, b in p)
            for t in kept:
                p, q = share(counts[lang, s][t], total[s]), share(whole[t], sum(total.values()))
                if counts[lang, s][t] and p > q:
                    terms[lang, s, t] = (p - q) ** 2 // q
    return pairs, terms


def table_of(spark, rows):
    return spark.createDataFrame([(k, *r, 1, 2, 3, 4, 5) for k, r in enumerate(rows)], SCHEMA)


def check(spark, rows, least=3, scale=10**9):
    audit = divergence.Audit(table_of(spark, rows), least_docs=least, scale=scale)
    pairs, terms = brute(rows, least, scale)
    found = [tuple(r) for r in audit.pairs().collect()]
    assert len(found) == len(pairs) and {r[:3]: r[3] for r in found} == pairs
    assert {tuple(r)[:3]: r[3] for r in audit.terms().collect()} == terms
    return audit, terms


def drawn(seed, n, vocabulary, sources):
    rng = random.Random(seed)
    return [(rng.choice(["en", "en", "de", None, ""]), rng.choice(sources), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("block,flush", [(1 << 18, 1 << 19), (40, 7)])
def test_audit(spark, monkeypatch, block, flush):
    """Sums are the same however many blocks the index has and however often counts are handed on."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "FLUSH", flush)
    words = [f"{w}{c}" for w in ("Alpha", "βeta", "日本", "gamma", "x") for c in "abcdefgh"]
    check(spark, drawn(1, 300, words, ["s1", "s2", "s3", None, "only-one"]) + [("en", "empty", None), ("xx", "a", "rare words"), ("xx", "b", ""), ("fr", "single", "mot mot mot")] * 2)


def test_odd_texts(spark):
    rows = [(*k, t) for k in (("en", "a"), ("en", "b"), ("de", "a")) for t in ("ÀÉ İ i̇ ẞß", "A1B2-c_d\x00e\x7ff g", "word " * 500, "#*$", None, "", "x" * 3_000_000, ("ab " * 400_000) + "Tail")]
    check(spark, rows * 2, least=3)


def test_a_hot_source(spark):
    """A third of all documents in one source, and one document with most of the words."""
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = drawn(3, 150, words, ["big"]) + drawn(4, 300, words, [f"s{k}" for k in range(25)]) + [("en", "big", " ".join(words * 400))]
    check(spark, rows)
    check(spark, rows, least=2, scale=1000)


def test_top_terms(spark):
    rows = drawn(5, 400, [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100)], ["a", "b", "c"])
    audit, terms = check(spark, rows)
    best = defaultdict(list)
    for (lang, s, t), v in terms.items():
        best[lang, s].append((-v, t.encode()))
    got = {(r.part, r["name"], r["rank"]): r.term for r in divergence.top_terms(audit.terms(), 7).collect()}
    assert got == {(*k, i + 1): t.decode() for k, v in best.items() for i, (_, t) in enumerate(sorted(v)[:7])}


def test_nothing(spark):
    audit = divergence.Audit(table_of(spark, []))
    assert audit.pairs().count() == audit.terms().count() == 0


def test_slices_end_between_terms():
    rng = random.Random(2)
    text = "".join(rng.choice("aB cÄ-") for _ in range(5000)).encode()
    whole = text.translate(divergence.TERMS).split()
    for size in (1, 7, 100, 10_000):
        assert [t for terms in divergence.slices(text, size) for t in terms] == whole


def test_accumulated_in_small_gathers():
    rng = np.random.default_rng(0)
    present = rng.random((9, 50)) < 0.3
    group, term = np.nonzero(present)
    p, base = rng.integers(1, 10**9, len(group)), rng.integers(1, 1000, 9)
    dense = np.repeat(base[:, None], 50, 1)
    dense[group, term] = p
    expect = [[sum(int(a - b) ** 2 // int(b) for a, b in zip(dense[g], dense[h])) if g != h else 0 for h in range(9)] for g in range(9)]
    for gather in (1, 17, 1 << 20):
        got = divergence.accumulated(group, term, p, base, 50, gather)
        assert all(got[g][h] == expect[g][h] % (1 << 64) or int(got[g][h]) % (1 << 64) == expect[g][h] % (1 << 64) for g in range(9) for h in range(9) if g != h)
