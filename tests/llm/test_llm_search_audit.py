"""Exact dedup, lexical search and source divergence against SQL and plain versions."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbflow.llm import divergence, exact_dedup, lexical, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_lexical_search", "op13_source_divergence"])
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    pick = sorted(got.columns)
    a = sorted(tuple(r[x] for x in pick) for r in got.collect())
    b = sorted(tuple(r[want.columns.index(x)] for x in pick) for r in want.fetchall())
    assert a == b and a


# -- exact dedup ------------------------------------------------------------------------


def odd_documents():
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\tb", " a b", "a b ", "a b", "A b", "x" * 300_000, "x" * 300_000 + " ", "w " * 60_000, "w\n" * 60_000]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    rows += [(100 + k, f"copy {k % 7}", None, None, None) for k in range(60)]
    rows += [(3, "twice", "en", "s", 1), (3, "twice", "en", "s", 1), (3, "twice", "de", "t", 1), (None, "twice", "en", "s", 1)]
    rows += [(None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1), (110, "a b", "en", "s", 1)]
    return rows


def plain_exact(rows, historical):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((not historical(i), i is None, i or 0, i))
    out = []
    for text, own in groups.items():
        own.sort(key=lambda x: x[:3])
        for k, (_, _, _, i) in enumerate(own):
            out.append((i, own[0][3], len(own), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cut", [-1, 50, 130, 1000])
def test_exact_groups(spark, cut, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 4)
    monkeypatch.setattr(exact_dedup, "PROBE_KEYS", 2)
    monkeypatch.setattr(exact_dedup, "HEAVY", 8)
    rows = odd_documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = exact_dedup.exact_groups(docs, F.col("doc_id") <= cut)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()), key=repr)
    assert got == plain_exact(rows, lambda i: i is not None and i <= cut)


def test_history_wins_over_lower_ids(spark):
    docs = spark.createDataFrame([(9, "same"), (1, "same"), (2, "new"), (5, "new")], "doc_id long, text string")
    found = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exact_dedup.exact_groups(docs, F.col("doc_id") == 9).collect()}
    assert found == {9: (9, True, 2), 1: (9, False, 2), 2: (2, True, 2), 5: (2, False, 2)}


def test_unique_documents_keep_columns(spark):
    rows = odd_documents()
    names = ["digest", "first", "n", "member", "kept", "shard", "__digest", "__rows", "__kept_id"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in names})
    out = exact_dedup.unique_documents(docs, F.col("doc_id") < 120)
    assert out.columns == docs.columns
    got = out.collect()
    want = [(i, h) for i, _, _, kept, h in plain_exact(rows, lambda i: i is not None and i < 120) if kept]
    text = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert sorted(((r.doc_id, text(r.text)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r[c] == c for r in got for c in names)


def test_exact_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(empty, F.lit(True)).count() == 0
    assert exact_dedup.unique_documents(empty, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 2**63, (n, 4)).astype(np.uint64)
    keys[: n // 2, 0] = 7  # equal first words
    found = exact_dedup.PerfectHash.of(keys)
    slots = found.slots(keys)
    assert sorted(slots) == list(range(n))
    others = found.slots(r.integers(0, 2**63, (1000, 4)).astype(np.uint64))
    assert ((others >= -1) & (others < max(n, 1))).all()


# -- lexical search -----------------------------------------------------------------------


def plain_search(rows, items, k=10):
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total, df = len(docs), sum(x[2] for x in docs), Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, size in docs:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def texts_of(seed, n=400, words=120):
    r = random.Random(seed)
    pick = lambda: f"W{int(words * r.random() ** 3)}"
    return [(k, " ".join(pick() for _ in range(r.randrange(1, 60)))) for k in range(n)]


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7), (3, 4)])
def test_ranked_search(spark, seed, parts):
    rows = texts_of(seed)
    rows += [(900, None), (901, ""), (902, "- ! \x00 \u007f"), (903, "É ñ É,w3-w4"), (None, "W1 w2 W3"), (None, "W1 w2 W3"), (5, "W1 w2 W3"), (5, "W1 w2 W3"), (904, "w3 " * 50_000)]
    items = [(k, " ".join(f"w{x}" for x in random.Random(k).sample(range(120), 9))) for k in range(20)]
    items += [(7, "w119"), (50, None), (51, "no such term é"), (None, "w1 w2"), (None, "w3"), (52, "É"), (53, "w3 W3 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(parts)
    index = lexical.build_index(docs)
    for shards in (index, index.coalesce(1)):
        found = lexical.ranked_search(shards, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)))
        assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_search(rows, items)


def test_search_in_packs(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PACK_TERMS", 30)
    rows, items = texts_of(4, 60), [(k, f"w{k} w{k + 1} w{2 * k}") for k in range(40)]
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = lexical.ranked_search(index, spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_search(rows, items, 3)


def test_non_essential_postings_are_skipped():
    import pyarrow as pa

    rows = [(k, "common " + ("rare rare rare" if k % 40 == 0 else "other " * (k % 5))) for k in range(2000)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
    row = lexical._shard([batch])
    row = {c: row.column(c)[0].values if c in ("doc_ids", "terms") else row.column(c)[0].as_py() for c in row.schema.names}
    shard = lexical.Shard(row, pa.array(["common", "rare"]), np.array([1, 5000]), 2000, 9000)
    docs, score = shard.top(np.array([0, 1]), 10, int(shard.bound[0]) + 1)
    assert set(shard.open) == {1} and len(docs) >= 10  # the long list was probed only
    assert not len(shard.top(np.array([0, 1]), 10, int(shard.bound.sum()) + 1)[0])


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked_search(lexical.build_index(none), some).count() == 0
    full = lexical.build_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert lexical.ranked_search(full, some.limit(0)).count() == 0
    assert lexical.build_index(spark.createDataFrame([(1, "..."), (2, None)], "doc_id long, text string")).count() == 0


# -- source divergence ----------------------------------------------------------------------


def plain_divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", Counter(LETTERS.findall((text or "").translate(LOWER)))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = [t for t in df if df[t] >= min_docs]
        counts = defaultdict(Counter)
        for _, s, c in own:
            counts[s].update({t: c[t] for t in kept if t in c})
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept))  # noqa: E731, B023
        for s in counts:
            pair = [(sum(abs(share(counts[s], t) - share(counts[o], t)) for t in kept), o) for o in counts if o != s]
            term = [(share(counts[s], t) - share(whole, t), t) for t in kept if counts[s][t] > 0 and share(counts[s], t) > share(whole, t)]
            order = lambda x: (-x[0], x[1].encode())
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(sorted(pair, key=order))]
            out += [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(sorted(term, key=order)[:top])]
    return sorted(out)


@pytest.mark.parametrize("seed,min_docs", [(1, 2), (2, 1), (3, 9), (4, 500)])
def test_source_divergence(spark, seed, min_docs):
    r = random.Random(seed)
    letters = ["alpha", "Beta", "éa", "zz", "ñ", "b", "c", "dd", "rare"]
    rows = [(k, " ".join(r.choice(letters[: r.randrange(1, 10)]) + r.choice(["", " x1y", "-", "9"]) for _ in range(r.randrange(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s10", None, "", "ß"]), k) for k in range(150)]
    rows += [(None, None, None, None, None), (1, None, "en", "quiet", 0), (2, "alpha", "xx", "only", 1), (2, "alpha", "xx", "only", 1), (3, "", "yy", "p", 0), (3, "...", "yy", "q", 0), (9, "word " * 60_000, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("term", "n", "m", "value", "rank", "item", "part", "count", "a", "b")}).repartition(4)
    found = divergence.source_divergence(docs, min_docs, 4)
    assert sorted(tuple(x) for x in found.collect()) == plain_divergence(rows, min_docs, 4)


def test_divergence_empty(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 7 * 10**16 + 1, 9 * 10**17, 10**6
    df = spark.createDataFrame([(n, total, v)], "c long, t long, v long")
    assert df.select(divergence.share("c", "t", "v")).first()[0] == 1 + (10**9 * (n + 5)) // (total + 5 * v)
