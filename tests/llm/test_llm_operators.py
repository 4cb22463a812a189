"""Each operator against a plain version on small tables, with nulls, empties, ties and repeats."""

import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbflow.llm import decontaminate, html_text, licences, line_dedup, mixing, ngram_join, quality, token_files, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def docs_of(spark, texts, source=None):
    rows = [(k, t, "en", (source or (lambda i: f"s{i % 3}"))(k), len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# -- n-gram join ------------------------------------------------------------------------


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                top[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies():
    texts, base, passage = [], words(120, 1), words(40, 9)
    for k in range(12):  # a chain in which the ends do not link
        w = list(base)
        w[: 3 * k] = [f"x{j}" for j in range(3 * k)]
        texts.append(" ".join(w))
    for k in range(40):  # one passage in many texts
        w = words(90, 100 + k)
        texts.append(" ".join(w[:30] + passage + w[30:]))
    for k in range(40):  # a group around one text, each changed a little
        w = list(words(100, 7))
        for j in range(k % 5):
            w[(17 * k + 23 * j) % 100] = f"y{k}.{j}"
        texts.append(" ".join(w).upper() if k % 7 == 0 else "\n".join(w))
    return [*texts, None, "", "  \t ", "one two", "one  two", "One two three four five", "lang " * 3000, "lang " * 2000, texts[0], texts[5]]


def test_ngram_components(spark):
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(spark, texts)).collect()}
    assert got == plain_components(list(enumerate(texts)))


def test_ngram_components_edges(spark):
    empty = docs_of(spark, ["a"]).where("doc_id < 0")
    assert ngram_join.ngram_components(empty).count() == 0
    rows = [(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 3), (None, None, 4)]
    out = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string, sid int")).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in out if r.n_shingles) == [(False, 2, 4), (False, 2, 4), (True, 2, 4)]


def test_count_tree_bound():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: len(s) - 12], r.integers(0, 2**63, 12).astype(np.uint64)])) for s in sets[:50]]
    vectors = np.stack([ngram_join.count_vector(s, 128) for s in sets])
    tree = ngram_join.CountTree(vectors, np.array([len(s) for s in sets]), leaf=8)
    for k, s in enumerate(sets):
        found = set(tree.search(vectors[k], len(s)))
        for j, t in enumerate(sets):
            common = len(np.intersect1d(s, t))
            if 100 * common >= 80 * (len(s) + len(t) - common):
                assert j in found


def test_shared_cells_across_batches():
    cell = np.array([1, 1, 1, 2, 3, 3, 3, 3, 4, 5, 5])
    sid = np.array([7, 7, 9, 1, 2, 2, 2, 2, 3, 4, 6])
    want = [(1, 7, 7), (1, 9, 7), (5, 4, 4), (5, 6, 4)]
    for size in range(1, 12):
        parts = [pa.RecordBatch.from_arrays([pa.array(cell[a : a + size]), pa.array(sid[a : a + size]), pa.array(sid[a : a + size].astype(np.int32))], ["cell", "sid", "n"]) for a in range(0, 11, size)]
        got = [tuple(r[c] for c in ("cell", "sid", "pivot")) for b in ngram_join._shared_cells(parts) for r in b.to_pylist()]
        assert got == want, size


# -- mixing -----------------------------------------------------------------------------


def test_mixing(spark):
    texts = [" ".join(words(n, n)) for n in (5, 50, 500, 40, 30, 20, 300, 7, 80, 10)] + [None, "", " a "]
    source = lambda k: ["b", "a", None, "c"][k % 4]
    rows = mixing.mix(docs_of(spark, texts, source)).collect()
    size = [len(WORD.findall(t or "")) for t in texts]
    by = defaultdict(int)
    for k, n in enumerate(size):
        by[source(k)] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size)
    while True:  # deal, clamp, deal again
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * by[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * by[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == by[source(r.doc_id)]
        assert r.target == pytest.approx(target[source(r.doc_id)]) and 0 <= r.taken <= 2 * r.size
        taken[source(r.doc_id)] += r.taken
    # a source misses its target by half of the document at its cut at most, and documents are taken whole
    most = {s: max(n for k, n in enumerate(size) if source(k) == s) for s in by}
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 0.5 for s in by)
    assert all(r.taken % r.size == 0 for r in rows if r.size)
    again = {r.doc_id: r.taken for r in mixing.mix(docs_of(spark, texts, source).repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    mixed = mixing.mixed_documents(docs_of(spark, texts, source))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = defaultdict(int)
    for r in mixed.collect():
        out[r.doc_id] += len(WORD.findall(r.text))
    assert out == {r.doc_id: r.taken for r in rows if r.taken}
    assert all(r.text == texts[r.doc_id] for r in mixed.collect())


def test_mixing_edges(spark):
    assert mixing.mix(docs_of(spark, ["a"]).where("doc_id < 0")).count() == 0
    assert [r.taken for r in mixing.mix(docs_of(spark, [None, ""])).collect()] == [0, 0]
    same = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b c", "s")], "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mix(same).collect()) == 15  # 13.5 rounded to 14, of which the last row gives all three
    long = docs_of(spark, ["w " * 200_000, "a b", "x\ny"], lambda k: "s")
    mixed = [(r.doc_id, len(r.text)) for r in mixing.mixed_documents(long).collect()]
    assert set(mixed) <= {(0, 400_000), (1, 3), (2, 3)} and (0, 400_000) in mixed and max(mixed.count(x) for x in mixed) <= 2


# -- licences ---------------------------------------------------------------------------


def test_licences(spark):
    grant = licences.NOTICES[3][1]
    changed = grant.replace("charge", "cost")  # 22 of the 25 shingles
    texts = [" ".join(words(50, 1)) + "\n" + licences.NOTICES[0][1] + "\n" + " ".join(words(20, 2)), "Released under the MIT License.", changed, " ".join(words(300, 3)), None, "", "the mit", f"{grant} x {grant}"]
    rows = licences.scan_licences(docs_of(spark, texts)).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add(r.license)
    assert got[0] >= {"Apache-2.0"} and got[1] == {"MIT"} and got[2] == {"MIT-grant"}
    assert not {3, 4, 5, 6} & set(got)
    assert sum(r.doc_id == 7 and r.license == "MIT-grant" for r in rows) == 2
    assert licences.scan_licences(docs_of(spark, ["a"]).where("doc_id < 0")).count() == 0
    assert licences.collision_probability(0.5) > 0.98 and licences.collision_probability(1) == 1
    with pytest.raises(ValueError):
        licences.TemplateIndex([("short", "too short")])


def test_licence_notices_of_few_words(spark):
    fill = " ".join(words(12, 5))
    texts = [f"{fill}\nAll rights reserved.\n{fill}", "all rights\nRESERVED", f"{fill} Licensed under the MIT License.", "Distributed under the Apache License, version 2.0", "(CC BY-NC 4.0)", "All rights are reserved", "all rights", "", "Reserved", f"All rights reserved. {fill} All rights reserved.", "Released under the MIT License."]
    got = defaultdict(list)
    for r in licences.scan_licences(docs_of(spark, texts)).collect():
        got[r.doc_id].append((r.license, r.first_word, r.end_word))
    notice = "all-rights-reserved-notice"
    assert got == {
        0: [(notice, 12, 15)], 1: [(notice, 0, 3)], 2: [("MIT", 13, 17)], 3: [("Apache-2.0", 3, 7)], 4: [("CC-BY-NC-4.0", 0, 3)],
        9: [(notice, 0, 3), (notice, 15, 18)], 10: [("MIT", 0, 5)],
    }


def test_page_wide_forms_and_shown_raw_text():
    page = "<body><form action='x'><div class='top nav'>Menu</div><article><p>First part of the article, long enough.</p><xmp>if a < b && c: <b>raw</b></xmp><p>Second part of it.</p></article></form></body>"
    assert html_text.article(page, []) == "First part of the article, long enough.\n\nif a < b && c: <b>raw</b>\n\nSecond part of it."
    plain = "<body><form><p>The whole page stands in a form and has no article.</p><p>It is kept.</p></form></body>"
    assert html_text.article(plain, []) == "The whole page stands in a form and has no article.\n\nIt is kept."
    mail = "<body><article><p>A text of some length that is no form at all.</p></article><form><p>Your mail</p><input></form></body>"
    assert html_text.article(mail, []) == "A text of some length that is no form at all."


# -- top k ------------------------------------------------------------------------------


def test_top_k(spark):
    r = np.random.default_rng(1)
    v = r.normal(0, 0.1, (400, 16)).astype(np.float32)
    v[7] = v[8]
    rows = [(int(k), [float(x) for x in v[k]]) for k in range(400)] + [(400, None), (450, [float("nan")] * 16), (500, [None] * 16), (None, [0.1] * 16), (350, [float(x) for x in v[350]])]
    df = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert df.count() == 401
    got = defaultdict(list)
    for x in topk.exact_top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    whole = np.floor(256 * v.astype(float)).astype(np.int64)
    for q in range(0, 400, 50):
        score = whole @ whole[q]
        want = sorted(((-int(score[k]), k) for k in range(400) if k != q))[:5]
        assert got[q] == [(k, -s) for s, k in want]
    assert set(got) == set(range(0, 400, 50))


def test_top_k_of_large_components(spark):
    v = [[1e7, -3.0, 0.5], [2e7, 1.0, 1.0], [-1e7, 0.0, 2.0], [1e15, 1e15, -1e15], [3e37, 1.0, 1.0], [float("inf"), 1.0, 1.0], [1e9, -1e9, 0.25], [1e9, -1e9, 0.25]]
    rows = [(50 * k, [np.float32(x).item() for x in r]) for k, r in enumerate(v)] + [(7, [1.0, 2.0, 3.0]), (7, [5.0, 2.0, 3.0])]
    df = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")))
    got = sorted(tuple(x) for x in topk.exact_top_k(df, df.where("vec_id % 50 = 0")).collect())
    whole = [(i, [math.floor(256 * Fraction(x)) for x in r]) for i, r in rows if all(map(math.isfinite, r))]
    want = []
    for q, a in whole:
        if q % 50 == 0:
            best = {}
            for i, b in whole:
                if i != q:
                    best[i] = max(best.get(i, -(2**63)), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
            top = sorted((-s, i) for i, s in best.items())[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(top)]
    assert got == sorted(want)


def test_top_k_of_long_vectors(spark):
    r = np.random.default_rng(5)
    v = r.normal(0, 1, (60, 5000)).astype(np.float32)
    df = topk.scaled(spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(60)], "vec_id long, embedding array<float>"))
    whole = np.floor(256 * v.astype(float)).astype(np.int64)
    got = {x.rank: (x.vec_id, x.score) for x in topk.exact_top_k(df, df.where("vec_id = 50")).collect()}
    score = whole @ whole[50]
    want = sorted((-int(score[k]), k) for k in range(60) if k != 50)[:5]
    assert got == {k + 1: (i, -s) for k, (s, i) in enumerate(want)}


def test_top_k_stops_early():
    r = np.random.default_rng(2)
    v = r.integers(0, 3, (5000, 4))
    v[17] = 50
    lists = topk.SortedLists(np.arange(5000), v)
    ids, score = lists.top(-1, np.array([1, 2, 0, -1]), 3)
    assert lists.met < 5000  # the bound ended the search
    every = v @ np.array([1, 2, 0, -1])
    best = np.lexsort((np.arange(5000), -every))[:3]
    assert ids.tolist() == best.tolist() and score.tolist() == every[best].tolist()
    assert topk.SortedLists(np.arange(3), np.zeros((3, 4), int)).top(1, np.zeros(4, int), 5)[0].tolist() == [0, 2]


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, parts array<int>")
    assert topk.exact_top_k(df, df).count() == 0


def test_driver_holds_little(spark):
    """Stars take one round, no links none; the filter is a bit a cell and the levels need no doubles."""
    from kerbflow.operators.graph import star_components

    kept = []
    keep = lambda df: kept.append(df.localCheckpoint()) or kept[-1]
    stars = spark.createDataFrame([(1, 2), (1, 3), (7, 9)], "a long, b long")
    assert sorted(map(tuple, star_components(stars, keep).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)] and len(kept) == 2
    assert not star_components(stars.where("a > 9"), keep).collect() and len(kept) == 3
    ids = np.arange(0, 3000, 7)
    marks = ngram_join._membership(spark.createDataFrame([(int(k),) for k in ids], "id long"))
    assert marks.nbytes == 1 << ngram_join.FILTER_BITS >> 3 and ngram_join._marked(marks, ids).all()
    assert ngram_join._marked(marks, np.arange(10**6, 10**6 + 1000)).sum() < 5
    sketch = np.array([1] * 1000 + [5000], np.uint32)
    assert ngram_join._order_levels(sketch).tolist() == [0] * 1000 + [13]


# -- token files ------------------------------------------------------------------------


def test_rank_coding():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        ranks = (2 ** r.uniform(0, 32, n)).astype(np.uint64).clip(0, 2**32 - 1).astype(np.uint32)
        control, data = token_files.encode_ranks(ranks)
        back = token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
        assert (back == ranks).all()
    raw = b"".join(token_files.shard_parts(np.array([3, 9]), np.array([2, 1]), np.array([0, 1, 0]), np.array([500, 70000])))
    ids, lengths, tokens = token_files.read_shard(raw)
    assert ids.tolist() == [3, 9] and lengths.tolist() == [2, 1] and tokens.tolist() == [500, 70000, 500]


def test_token_pieces(tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import json
    import random

    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    parts = ["'", "'s", "re", "Z", "é", "ß", "×", "÷", "ɏ", "\u0301", "1", "²", "٣", ".", ",", "-", "_", "\x00", "\x7f", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0", "日", "—", "’", "😀"]
    draw = random.Random(4)
    texts = ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(4000)] + ["", "\x00", "a\x00", "a", *("x" * n for n in (15, 16, 17)), "x" * 15 + "\x00", "<|endoftext|> a"]

    def same(path):
        plain, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
        for part in (texts[:2000], texts[2000:]):  # the second finds pieces of the first
            ids, n = encoder.encode(pa.array(part))
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain.encode(x, add_special_tokens=False).ids for x in part]

    same(path)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    told["pre_tokenizer"]["add_prefix_space"] = True  # pieces would each get a blank
    (tmp_path / "t.json").write_text(json.dumps(told))
    same(str(tmp_path / "t.json"))

    # a word is one piece, whatever mark follows it, and goes to the model without the way of a text
    encoder, asked = token_files.Encoder(path), []
    rest = encoder.tokenizer

    class Asked:
        model = rest.model

        def encode_batch_fast(self, found, **settings):
            asked.extend(found)
            return rest.encode_batch_fast(found, **settings)

    encoder.tokenizer = Asked()
    encoder.encode(pa.array(["".join(f" éwort{m} Word{m}" for m in (".", "$$$", ";", ":", "!", ")", "--"))]))
    assert not asked and len(encoder.known.high) == 2 + 7


def test_keys_that_share_their_high_half():
    known = token_files.Remembered()
    low = np.array([5, 9, 2], np.uint64)
    place = known.add(np.array([7, 7, 8], np.uint64), low, np.array([1, 70_000, 3, 4], np.uint32), np.array([1, 1, 2]))
    found, had = known.find(np.array([8, 7, 7, 7, 9], np.uint64), np.array([2, 9, 5, 6, 0], np.uint64))
    assert had.tolist() == [True, True, True, False, False] and found[:3].tolist() == place[[2, 1, 0]].tolist()
    assert [known.ids[known.start[p] :][: known.count[p]].tolist() for p in place] == [[1], [70_000], [3, 4]]


def test_token_digest(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["Hello, world.  It's  3.14 km..", None, "", "a  b 　c  d", "x<|endoftext|> y", "tab\t\ttab\n\n new \r\n", "été déjà-vu… 12,5%!! don't", "\x1c odd\x85 space", " lead", "trail  ", "日本語 テキスト 🙂🙂", " ".join(words(4000, 5)), "a.b,c .d ,e A.,", "1.5.6,7"]
    docs = docs_of(spark, texts).repartition(3)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digest(docs, path).collect())
    want, start = [], 0
    for k, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_digest(docs.where("doc_id < 0"), path).count() == 0
    rows = spark.createDataFrame([(None, "a"), (5, "b"), (5, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.start) for r in token_files.token_digest(rows, path).collect()) == [(-1, 0), (5, 2), (5, 4)]


# -- toxicity ---------------------------------------------------------------------------


def plain_segments(scores, drift):
    """Maximal segments by repeated best sub-sequence, on each side again."""
    s = [x if x > 0 else drift for x in scores]

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > 0 and (top is None or total > top[0] + 1e-12):
                    top = (total, i, j + 1)
        if top is None:
            return []
        return best(a, top[1]) + [(top[1], top[2], top[0])] + best(top[2], b)

    return best(0, len(s))


def test_segments():
    r = random.Random(4)
    for _ in range(60):
        x = [r.choice([0, 0, 0, 1.3, 2.1, 0.7]) for _ in range(25)]
        got = toxicity.segments(np.array(x), -0.9)
        want = plain_segments(x, -0.9)
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_toxicity(spark):
    r = random.Random(1)
    rows = []
    for k in range(600):
        w, toxic = words(60, k), int(k % 4 == 0)
        if toxic:
            for j in range(4):
                w[20 + j * 3] = r.choice(["vile", "nasty", "foul"])
        rows.append((k, " ".join(w), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df.where("doc_id < 400"))
    out = {x.doc_id: x for x in toxicity.toxic_passages(df.select("doc_id", "text"), model).collect()}
    held = [(out[k].score >= 0.5, bool(t)) for k, _, t in rows if k >= 400]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(19 <= p["start"] and p["end"] <= 31 for k, _, t in rows if t for p in out[k].passages)
    edge = spark.createDataFrame([(1, None, 2), (None, "", 3)], "doc_id long, text string, score int")
    assert all(0 <= x.score < 0.5 and x.passages == [] for x in toxicity.toxic_passages(edge, model).collect())
    none = toxicity.fit_toxicity(df.where("toxic = 0"))
    assert all(x.score < 0.5 for x in toxicity.toxic_passages(df, none).collect())
    assert toxicity.toxic_passages(df.where("doc_id < 0"), model).count() == 0


# -- quality ----------------------------------------------------------------------------


def test_ordinal_grades(spark):
    r = random.Random(2)
    rows = []
    for k in range(900):
        grade = k % 4
        w = [x.upper() + "!!" if r.random() < (3 - grade) / 3.5 else x for x in words(40, k)]
        rows.append((k, " ".join(w), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.fit_quality(df.where("doc_id < 600").select("doc_id", "text"), df.select("doc_id", "grade").where("doc_id < 600"))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    out = {x.doc_id: x for x in quality.score_quality(df, model, 2).collect()}
    mean = [np.mean([out[k].expected_grade for k in range(600, 900) if k % 4 == g]) for g in range(4)]
    assert mean == sorted(mean) and mean[3] - mean[0] > 2
    assert np.mean([(out[k].tail >= 0.5) == (k % 4 >= 2) for k in range(600, 900)]) > 0.9
    edge = spark.createDataFrame([(1, None, 9.0), (None, "", 9.0)], "doc_id long, text string, tail double")
    got = quality.score_quality(edge, model).collect()
    assert len(got) == 2 and all(0 <= x.tail <= 1 for x in got)
    assert quality.score_quality(edge.where("doc_id < 0"), model).count() == 0
    one = quality.fit_quality(edge, spark.createDataFrame([(1, 0)], "doc_id long, grade int"))
    assert quality.score_quality(edge, one, 0).first().tail == 1


# -- line dedup -------------------------------------------------------------------------


def test_patience():
    assert line_dedup.patience("abcde", "abxde") == [(0, 0), (1, 1), (3, 3), (4, 4)]
    assert line_dedup.patience("", "abc") == [] and line_dedup.patience("aaa", "aa") == [(0, 0), (1, 1)]
    r = random.Random(5)
    for _ in range(200):
        a, b = ("".join(r.choice("abcdefgh") for _ in range(r.randrange(12))) for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(set(got))
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_line_dedup(spark):
    long = [" ".join(words(20, k)) for k in range(30)]
    texts = ["\n".join(long[:6]), "\n".join([long[10], *long[2:5], "As.", long[11]]), "\n".join([long[12], "As.", long[13]]), "\n".join(long[:6]), None, "", long[3] + " \n" + long[20]]
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs_of(spark, texts).withColumn("hash", F.lit(1))).collect()}
    assert got[0].removed == [] and got[0].text == texts[0]
    assert got[1].removed == [1, 2, 3] and got[1].text == "\n".join([long[10], "As.", long[11]])
    assert got[2].removed == [] and got[3].removed == [0, 1, 2, 3, 4, 5] and got[3].text == ""
    assert got[4].text is None and got[5].text == "" and got[6].removed == [0]
    assert got[1].hash == 1 and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "hash", "n_lines", "removed"}
    assert line_dedup.without_repeated_lines(docs_of(spark, ["a"]).where("doc_id < 0")).count() == 0


def test_line_dedup_by_runs(spark):
    line = [" ".join(words(7, 100 + k)) for k in range(12)]
    short = [" ".join(words(4, 200 + k)) for k in range(6)]
    texts = [
        "\n".join([line[0], line[5]]),  # first with line 0, apart from line 1
        "\n".join([line[6], line[1]]),  # first with line 1
        "\n".join([line[0], line[1], line[7]]),  # first with the two together
        "\n".join([line[8], line[0], line[1]]),
        "\n".join(short),  # no line is long
        "\n".join([line[9], *short[1:5], line[10]]),
        "\n".join([*short[3:], *short[:3]]),  # in another order
        "\n".join([*short[:3], "x", *short[:3]]),  # twice
    ]
    got = {r.doc_id: r.removed for r in line_dedup.without_repeated_lines(docs_of(spark, texts)).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [1, 2], 4: [], 5: [1, 2, 3, 4], 6: [0, 1, 2, 3, 4, 5], 7: [0, 1, 2, 4, 5, 6]}


def test_line_dedup_finds_every_block(spark):
    r = random.Random(8)
    texts = ["\n".join(" ".join([chr(97 + k)] * (k % 5 + 2)) for k in (r.randrange(9) for _ in range(r.randrange(1, 14)))) for _ in range(60)]
    lines = [t.split("\n") for t in texts]

    def blocks(doc):  # all stretches of 12 words and more
        return {(s, e): tuple(doc[s:e]) for s in range(len(doc)) for e in range(s + 1, len(doc) + 1) if sum(len(x.split()) for x in doc[s:e]) >= 12}

    seen, want = set(), {}
    for k, doc in enumerate(lines):
        mine = blocks(doc)
        want[k] = sorted({p for (s, e), b in mine.items() if b in seen for p in range(s, e)})
        seen |= set(mine.values())
    got = {r.doc_id: r.removed for r in line_dedup.without_repeated_lines(docs_of(spark, texts)).collect()}
    assert got == want


# -- decontamination --------------------------------------------------------------------


def test_decontamination(spark):
    question = "A train leaves the old station with 120 km to go and arrives after 3 hours while Maria waits near the gate with 120 apples"
    other = question.replace("120", "250").replace("3 hours", "5 hours").replace("Maria", "Jonas")
    broken = question.replace("120", "250", 1).replace("Maria", "Jonas")
    plain = " ".join(words(40, 3))
    fill = " ".join(words(30, 4)) + ". "
    texts = [fill + question + " " + fill, fill + other + ". " + fill, fill + broken + ". " + fill, fill * 3, None, "", fill + plain.upper() + "\n" + fill, "120 km"]
    bench = spark.createDataFrame([(1, question, 0), (2, plain, 0), (2, plain, 0), (3, None, 0), (4, "too short", 0)], "item_id long, text string, doc_id int")
    docs = docs_of(spark, [*texts, texts[0]])
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(0, 1), (1, 1), (6, 2), (8, 1)}
    left = decontaminate.clean_documents(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 7]
    assert decontaminate.leaks(docs.where("doc_id < 0"), bench).count() == 0
    assert decontaminate.clean_documents(docs, bench.where("item_id < 0")).count() == 9
    nameless = spark.createDataFrame([(None, texts[0]), (None, texts[3])], "doc_id long, text string")
    assert [r.text for r in decontaminate.clean_documents(nameless, bench).collect()] == [texts[3]]


def test_decontamination_drops_only_conflicting_windows(spark):
    fill = " ".join(words(30, 4)) + ". "
    long = "the tank holds 40 litres at dawn and " + " ".join(words(30, 6)) + " so that 40 men can drink"
    seats = "there are 5 cars with 5 seats in the yard and every driver counts them"
    split = "the rod of 3.5 and the one of 3.2 were laid on the table, 1,200 times in all"
    items = [long, seats, split]
    texts = [fill + x + " " + fill for x in (
        long.replace("40 men", "41 men"),
        seats.replace("5 cars", "6 cars").replace("5 seats", "8 seats"),
        split.replace("3.5", "4.75").replace("3.2", "3.1").replace("1,200", "3500"),
    )]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()} == {(0, 0), (1, 1), (2, 2)}
    both = spark.createDataFrame([("Cost 3.5kg, v2.5 and 1,2 or 5. Then 1'000.50 km; 7x 3.5x",)], "t string").select(decontaminate.canonical_words(F.col("t")).alias("c"), decontaminate.raw_words(F.col("t")).alias("r")).first()
    assert len(both.c) == len(both.r) and both.c[:3] == ["cost", "<num>", "<unit>"] and both.r[:3] == ["cost", f"3{decontaminate.MARK}5", "kg"]


def test_decontamination_of_dense_and_short_items(spark):
    fill = " ".join(words(30, 4)) + ". "
    sums = "12 + 34 + 56 - 7 * 8 + 90 / 3 = 76 or 1 + 2"
    names = "the list has Anna, Berta, Carla, Dora, Emil, Fritz, Gustav, Hans, Ida"
    short = "who wrote Faust?"
    items = [sums, names, short, "...", "Ja"]
    texts = [fill + x + "; " + fill for x in (sums, names, short.upper(), sums.replace("34", "35").replace("8", "9").replace("1 + 2", "4 + 4"), "who never wrote Faust", "ja")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(spark, [*texts, None, ""]), bench).collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (5, 4)}


# -- html -------------------------------------------------------------------------------


def page(body, note=""):
    return f"<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><a href='/'>home</a></nav>{note}{body}<footer>foot</footer></body></html>"


def test_main_text(spark):
    article = "<article class='post-12'><h1>Title &amp; more</h1><p>First   line<br>goes\non &lt;here&gt;.<p><b>Second<p>Third&nbsp;one</p><div class='ad'>Buy</div><aside>side</aside><form><p>mail</p></form><!-- <p>no</p> --></article>"
    want = "Title & more\n\nFirst line goes on <here>.\n\nSecond\n\nThird one"
    rows = [(k, f"http://a.example/{k}", page(article)) for k in range(5)]
    rows.append((5, "http://A.example:80/x", page("<div id='cookie-notice'><p>" + "We use cookies a lot. " * 90 + "</p></div><article class='post-13'><p>Short.</p></article>")))
    rows.append((6, "http://b.example/1", page("<div class='main'><p>Body text that is long enough.</p><p>And more of it.</p></div><div class='comments'><p>" + "I think so too. " * 50 + "</p></div>")))
    rows += [(7, None, None), (8, "http://a.example/8", ""), (9, "", "just text"), (0, rows[0][1], rows[0][2])]
    out = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == 11 and all(got[k].text == want and got[k].n_chars == len(want) for k in range(5))
    assert got[5].text == "Short." and got[6].text == "Body text that is long enough.\n\nAnd more of it."
    assert got[7].text == "" and got[8].text == "" and got[9].text == "just text" and got[7].url is None
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_keeps_articles(spark):
    body = "<p>" + "Running text of the article itself. " * 12 + "</p>"
    text = ("Running text of the article itself. " * 12).strip()
    other, rest = body.replace("itself", "as such"), text.replace("itself", "as such")
    pages = [
        (f"<body><header><p>A site banner</p></header><div class='post share-enabled'>{body}</div></body>", text),
        ("<article><p>Let <math><mi>x</mi></math> be large.</p><svg><text>no</text><p>After it.</p></article>", "Let x be large.\n\nAfter it."),
        (f"<body><div id='w'><div class='part-a'>{body}</div><div class='part-b'>{other}</div></div><footer>f</footer></body>", f"{text}\n\n{rest}"),
        (f"<article><header><h1>Title</h1></header>{body}<noscript>Plain.</noscript><div class='share'>Tell others</div></article>", f"Title\n\n{text}\n\nPlain."),
        (f"<body><div class='cookie-banner'>{body}{body}{body}</div><div class='text'>{other}</div></body>", rest),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        (f"<article>{body}<script>if (a < b) 'x'", text),
    ]
    rows = [(k, f"http://h{k}.example/", h, "a", "b") for k, (h, _) in enumerate(pages)]
    out = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string")).collect()
    assert {r.page_id: r.text for r in out} == {k: t for k, (_, t) in enumerate(pages)}
    long = "<article>" + "<p>word word</p>" * 40_000 + "</article>"
    assert html_text.article(long, []).count("\n\n") == 39_999


def test_mixing_with_clashing_names(spark):
    names = ["of", "whole", "extra", "before", "cut", "cut_bin", "bin", "bin_size", "upto", "ahead", "weight", "level", "ratio"]
    rows = [(k % 7 or None, f"{'a ' * (k % 5)}b{k}", f"s{k % 3}", *[k] * len(names)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "size", "source_size", "target", "taken"]
    got, again = sorted(out.collect(), key=str), sorted(mixing.mix(df.repartition(3)).collect(), key=str)
    assert got == again and len(got) == 40 and all(r["of"] == r["whole"] for r in got)
    plain = sorted((r.doc_id or 0, r.size, r.taken) for r in mixing.mix(df.select("doc_id", "text", "source")).collect())
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in got) == plain
    assert mixing.mixed_documents(df).columns == df.columns


def test_token_files_split_and_stream(spark, monkeypatch, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    r = np.random.default_rng(5)
    lengths, ids = r.integers(0, 900, 40), r.integers(0, 300, 20_000).astype(np.uint32)
    monkeypatch.setattr(token_files, "PIECE", 256)
    raw = b"".join(token_files.shard_parts(np.arange(40), lengths, ids[: lengths.sum()] % 50, np.arange(50)))
    doc_ids, n, pieces = token_files.open_shard(raw)
    back = [np.concatenate([np.zeros(0, np.uint32), *p]) for p in token_files.by_document(n, pieces)]
    assert doc_ids.tolist() == list(range(40)) and [len(b) for b in back] == lengths.tolist()
    assert (np.concatenate(back) == ids[: lengths.sum()] % 50).all()
    # one doc_id, or none, for most rows; columns of other names stay out of the way
    texts = [" ".join(words(k % 40 + 1, k)) for k in range(300)] + ["same text"] * 50
    rows = [(None if k % 3 else 7, x, k, k) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int, bucket int")
    got = sorted(token_files.token_digest(df, path).collect(), key=lambda x: x.start)
    want = sorted(zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for x in texts)
    assert sorted(x.ids_crc32 for x in got) == want and [x.doc_id for x in got] == [None] * sum(1 for x in rows if x[0] is None) + [7] * sum(1 for x in rows if x[0])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert [tuple(x) for x in sorted(token_files.token_digest(df.repartition(2), path).collect(), key=lambda x: x.start)] == [tuple(x) for x in got]
    folder = "file://" + str(tmp_path / "files")
    whole = token_files.read_token_files(token_files.write_token_files(df, folder, path), folder).collect()
    assert all(zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.n_tokens for x in whole) and len(whole) == 350
    (tmp_path / "w.json").write_text('{"model": {"type": "WordPiece"}}')
    with pytest.raises(ValueError):
        token_files.checked_kind(str(tmp_path / "w.json"))


def test_segments_of_both_signs():
    r = random.Random(14)
    for _ in range(60):
        x = [r.choice([0, 0, 1.3, 2.1, 0.7, -1.1, -0.2]) for _ in range(25)]
        got = toxicity.segments(np.array(x), -0.4)
        # a plain value for each token: costs first
        want = plain_segments([v if v > 0 else 1e-18 for v in x], -0.4) if all(v >= 0 for v in x) else None
        value = [v if v > 0 else v - 0.4 for v in x]
        for a, b, s in got:
            assert s == pytest.approx(sum(value[a:b]))
            assert all(sum(value[a:k]) > -1e-9 and sum(value[k:b]) > -1e-9 for k in range(a, b + 1))  # no end worth cutting
        assert all(p[1] <= q[0] for p, q in zip(got, got[1:]))
        assert {k for k, v in enumerate(x) if v > 0} == {k for a, b, _ in got for k in range(a, b) if x[k] > 0}
        assert want is None or [g[2] for g in got] == pytest.approx([w[2] for w in want])
    long = np.tile([3.0, -5.0, 2.0, -4.0, 1.0, -6.0], 60_000)  # every one begins lower than those before it
    assert len(toxicity.segments(long, -0.1)) == 180_000


def test_toxicity_of_repeats_and_long_texts(spark):
    r = random.Random(3)
    rows = [(k, " ".join(words(50, k) + (["vile", "foul"] * 3 if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(300)]
    df = spark.createDataFrame([*rows, *rows[:40], (None, "vile", 1), (999, None, 1)], "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df)
    long = " ".join(words(30_000, 5) + ["vile", "foul", "vile", "foul", "vile"] + words(30_000, 6))
    docs = spark.createDataFrame([(1, rows[0][1], 5), (1, rows[0][1], 5), (2, long, 5)], "doc_id long, text string, score int")
    got = toxicity.toxic_passages(docs, model).collect()
    assert len(got) == 3 and got[0] == got[1] and got[0].score >= 0.5
    far = next(g for g in got if g.doc_id == 2)
    assert any(30_000 <= p["start"] and p["end"] <= 30_005 for p in far.passages)


def test_quality_of_repeats_and_long_texts(spark):
    rows = [(k, ("GOOD plain words here " if k % 2 else "bad!!! $$$ 111 ") * 10 + f"n{k}", k % 2) for k in range(120)]
    df = spark.createDataFrame([*rows, *rows, *[rows[1]] * 200, (None, "x", 1), (500, None, None)], "doc_id long, text string, grade int")
    model = quality.fit_quality(df, df.select("doc_id", "grade"))
    once = quality.fit_quality(spark.createDataFrame(rows, df.schema), df.select("doc_id", "grade"))
    assert (model.weights == once.weights).all() and (model.thresholds == once.thresholds).all()
    long = [(1, rows[1][1] * 3000, 5), (2, "bad!!! " + "q" * 200_000, 5), (3, rows[1][1], 5), (3, rows[1][1], 5)]
    out = quality.score_quality(spark.createDataFrame(long, "doc_id long, text string, tail_of int"), model).collect()
    assert len(out) == 4 and out[0].tail > 0.5 > out[1].tail and out[2] == out[3]


# -- line dedup: blank lines, repeats, long texts -----------------------------------------------


def test_blocks_with_other_blank_lines(spark):
    block = [f"line {k} of a shared block" for k in range(4)]
    texts = ["\n".join(["head one", *block, "tail one"]), "head two\n" + "\n\n \t\n".join(block) + "\n\ntail two", "\n".join(["own text", "", "with blank lines", "", "and no copy"])]
    long = "\n".join(f"unique line number {k} with many words in it" for k in range(30_000))
    rows = list(enumerate(texts)) + [(7, long), (8, "extra\n" + long), (1, texts[1]), (9, ""), (10, None), (11, "\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("hash", "cut", "at", "words", "told")})
    out = defaultdict(list)
    for r in line_dedup.without_repeated_lines(df).collect():
        out[r.doc_id].append((r.text, r.removed))
        assert (r.hash, r.cut, r.at, r.words, r.told) == ("hash", "cut", "at", "words", "told")
    assert out[0] == [(texts[0], [])] and out[2] == [(texts[2], [])] and out[7] == [(long, [])]
    assert out[1] == [("head two\n\ntail two", list(range(1, 11)))] * 2
    assert out[8] == [("extra", list(range(1, 30_001)))]
    assert out[9] == [("", [])] and out[10] == [(None, [])] and out[11] == [("\n\n\n", [])]
