"""Jaccard join, lexical search and collocations against brute force, and on awkward rows."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import none, odd, text  # noqa: F401  (fixtures)

from gridloom.llm import collocations, jaccard, lexical, topk
from gridloom.llm.postings import deltas, packed, positions, slices, unpacked
from gridloom.llm.shingles import Shingler


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_links(sets, percent):
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    return {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def brute_components(sets, links):
    of = {i: i for i in sets}
    def root(i):
        while of[i] != i:
            i = of[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def corpus(seed=5):
    r = random.Random(seed)
    rows = []
    for g in range(60):
        base = text(g, r.choice([2, 3, 5, 9, 12, 14, 22, 40, 150, 400])).split()
        for _ in range(r.choice([1, 1, 2, 6, 20])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                at, what = r.randrange(len(w)), r.random()
                w[at : at + 1] = [] if what < 0.3 and len(w) > 1 else ["edit" + str(r.randrange(9))] if what < 0.7 else [w[at], "more"]
            rows.append((len(rows), " ".join(w)))
    # many short texts with a common head, most of them not linked
    rows += [(1000 + i, "this notice is under the common terms of use and was written by " + text(i % 200, 3)) for i in range(300)]
    return rows


@pytest.mark.parametrize("percent", [90, 80])
def test_jaccard_components(spark, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = sets_of(rows, 3)
    links = brute_links(sets, percent)
    want = brute_components(sets, links)
    got = jaccard.jaccard_components(docs, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    pairs, members = jaccard.jaccard_pairs(docs, percent)
    of = {r.doc_id: r.class_id for r in members.collect()}
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a, b in links if of[a] == a and of[b] == b and sets[a] != sets[b]}
    assert all(sets[i] == sets[c] for i, c in of.items())


def test_jaccard_with_a_segment_that_many_share(spark):
    """Hundreds of texts that aren't linked share a segment: neighbourhoods of another one take its place, and no link is lost."""
    r, shingler = random.Random(8), Shingler(3)
    head = "the holder of this work grants to all the rights that are named below"
    (common,) = shingler.sets([head.encode()])
    rows = []
    while len(rows) < 200:
        # only texts whose own shingles leave the first segment alone
        t = f"{head} {text(r.randrange(200), 4)} {r.choice(['now', 'then', 'soon'])}"
        (tokens,) = shingler.sets([t.encode()])
        ms = [jaccard.segments(b, 85) for b in jaccard.schemes(len(tokens), 85)]
        if all(jaccard.segment_sums(tokens, m)[1][0] == jaccard.segment_sums(common, m)[1][0] for m in ms):
            rows.append((len(rows), t))
    docs, sets = spark.createDataFrame(rows, "doc_id long, text string"), sets_of(rows, 3)
    links = brute_links(sets, 85)
    of = jaccard.Postings(docs, 85, 3, "doc_id", "text")
    plain = {k for s in of.rows.collect() for k in s["keys"] or []}
    chosen = {x.key for x in of.lists.collect()} - plain
    assert len(chosen) > 0, "no neighbourhood was chosen"
    meet = of.lists.alias("x").join(of.lists.alias("y"), "key").where("x.doc_id < y.doc_id").select("x.doc_id", "y.doc_id").toDF("a", "b").distinct()
    reps = {c.doc_id for c in of.classes.collect()}
    lost = {(a, b) for a, b in links if a in reps and b in reps} - {(m.a, m.b) for m in meet.collect()}
    assert len(lost) == 0
    assert {x.doc_id: x.component_id for x in jaccard.jaccard_components(docs, 85).collect()} == brute_components(sets, links)


def test_jaccard_of_many_near_copies(spark):
    """One text with several edits each, hundreds of times: part of the pairs are linked, and not all through one copy."""
    r = random.Random(12)
    base, rows = text(3, 120).split(), []
    for i in range(300):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = "e" + str(r.randrange(4))
        rows.append((i, " ".join(w)))
    sets = sets_of(rows, 3)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 90).collect()
    want = brute_components(sets, brute_links(sets, 90))
    assert {x.doc_id: x.component_id for x in got} == want and len(set(want.values())) > 5


def test_jaccard_of_near_copies_apart_compares_few_pairs(spark, monkeypatch):
    """Copies of one text with many edits each, most of them linked with nothing: pairs don't grow with the square of their number."""
    r = random.Random(5)
    base, rows, met = text(3, 150).split(), [], []
    for i in range(400):
        w = list(base)
        for at in r.sample(range(len(w)), r.choice([1, 4, 6, 8])):
            w[at : at + 1] = [] if r.random() < 0.2 else ["e" + str(r.randrange(5000))]
        rows.append((2 * i, " ".join(w)))
        if i % 40 == 0:  # a near copy of a far one
            w[r.randrange(len(w))] = "again"
            rows.append((2 * i + 1, " ".join(w)))
    sets, compared = sets_of(rows, 3), jaccard._compared
    want = brute_components(sets, brute_links(sets, 90))
    monkeypatch.setattr(jaccard, "_compared", lambda pairs, *a: met.append(pairs.count()) or compared(pairs, *a))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 90).collect()
    assert {x.doc_id: x.component_id for x in got} == want and 100 < len(set(want.values())) < 400
    assert sum(met) < 10 * len(rows), met


def test_jaccard_on_odd_rows(spark, odd, none):  # noqa: F811
    by = {r.doc_id: r for r in jaccard.jaccard_components(odd).collect()}
    assert jaccard.jaccard_components(odd).count() == 13 and jaccard.jaccard_components(none).count() == 0
    assert by[2].component_id == 1 and by[3].component_id == 1 and by[8].component_id == 7
    assert [by[i].component_id for i in (4, 5, 6, 9, 11)] == [4, 5, 6, 9, 11] and by[4].n_shingles == 0 and by[None].component_id is None
    assert by[9].n_shingles > 50_000
    with pytest.raises(ValueError):
        jaccard.jaccard_components(odd, percent=20)


def brute_search(docs, items, k):
    fold = lambda t: re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(fold(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, q in items:
        asked, scores = Counter(fold(q)), []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n // max(total, 1)
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, c in asked.items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, at + 1, i, -s) for at, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("shard", [500, 1 << 25])
def test_search(spark, shard):
    r = random.Random(2)
    vocabulary = ["Der", "die", "ÉTÉ", "naïve", "x1", "a_b", "日本", "zz top"] + [f"w{int(r.paretovariate(0.7))}" for _ in range(150)]
    docs = [(i if i % 17 else None, " ".join(r.choice(vocabulary) for _ in range(r.randrange(60))) if i % 29 else None) for i in range(400)]
    docs += docs[5:9] + [(-3, "die " * 70_000 + "end"), (2**60 + 1, docs[6][1]), (2**60, docs[6][1])]
    items = [(j, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 15)))) for j in range(30)] + [(90, None), (91, "nowhere"), (None, "die zz"), (92, "w1 w1 w1 w2")]
    schema = "doc_id long, text string, term string, shard int, df string"
    d = spark.createDataFrame([(*x, "t", 1, "d") for x in docs], schema).repartition(3)
    q = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, item string")
    got = [tuple(x) for x in lexical.search(d, q, k=7, shard_bytes=shard).collect()]
    assert sorted(got, key=repr) == sorted(brute_search(docs, items, 7), key=repr)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_max_score_probes_lists_that_are_not_essential(monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 64)
    g = np.random.default_rng(4)
    for _ in range(30):
        held, total = lexical.Lists(1000), np.zeros(1000, np.int64)
        asks = []
        for i in range(g.integers(1, 9)):
            docs = np.sort(g.choice(1000, g.integers(1, 900), replace=False))
            part = g.integers(0, 10 ** g.integers(1, 5), len(docs))
            held.add(docs, part)
            asks.append((i, int(g.integers(1, 4))))
            total[docs] += part * asks[-1][1]
        best = np.lexsort((np.arange(1000), -total))[:10]
        best = best[total[best] > 0]
        docs, scores = held.best(asks, 10)
        assert docs.tolist() == best.tolist() and scores.tolist() == total[best].tolist()


def test_search_on_odd_rows(spark, odd, none):  # noqa: F811
    items = spark.createDataFrame([(1, "one shared 日本語"), (2, "")], "item_id long, text string")
    got = lexical.search(odd, items).collect()
    assert {(r.item_id, r.doc_id) for r in got} == {(1, 7), (1, 8), (1, 11), (1, 12)} and sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
    strings = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id for r in lexical.search(strings, items).collect()} == {"d7", "d8", "d11", "d12"}
    assert lexical.search(none, items).count() == 0


def brute_collocations(docs, least, inside):
    f, n = {}, Counter()
    for lang, t in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    rows = {}
    for (lang, w), a in found.items():
        around = [b for (o, v), b in found.items() if o == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= inside * a for b in around):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, some in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(some))]


@pytest.mark.parametrize("shard", [400, 1 << 25])
def test_collocations(spark, shard):
    r = random.Random(6)
    words = ["New", "york", "CITY", "is", "a", "é", "ü\x00", "\x1cb", "big,", "the", "the."] + [f"v{i}" for i in range(20)]
    docs = [(r.choice(["en", "de", None, "und"]), " ".join(r.choice(words + ["new york city"] * 8) for _ in range(r.randrange(90)))) for _ in range(500)]
    docs += [("en", None), (None, ""), ("de", "ha " * 400_000), ("en", "a\tb\n\n , ;a b"), ("xx", "only once")]
    d = spark.createDataFrame([(*x, 1, "w", "p") for x in docs], "lang string, text string, n int, word string, phrase string").repartition(3)
    got = [tuple(x) for x in collocations.collocations(d, min_count=12, shard_bytes=shard).collect()]
    assert sorted(got) == sorted(brute_collocations(docs, 12, 80)) and len(got) > 20
    assert collocations.collocations(d.limit(0)).count() == 0 and collocations.collocations(d, min_count=10**7).count() == 0


def test_collocations_on_odd_rows(odd, none):  # noqa: F811
    got = collocations.collocations(odd, min_count=2, top=3).collect()
    assert {r.lang for r in got} <= {"en", "und", "xx"} and max(r["rank"] for r in got) == 3
    assert collocations.collocations(none).count() == 0


def test_list_packing():
    g = np.random.default_rng(1)
    n = g.integers(1, 50, 200)
    at = np.concatenate([np.sort(g.choice(10**6, k, replace=False)) for k in n])
    assert (positions(deltas(at, n), n) == at).all()
    values = np.r_[0, 1, 127, 128, 2**31, 2**62, g.integers(0, 2**40, 500), at]
    blobs = packed(values, np.array([3, 0, len(values) - 3]))
    assert (unpacked(b"".join(blobs.to_pylist())) == values).all() and [len(unpacked(b)) for b in blobs.to_pylist()] == [3, 0, len(values) - 3]
    raw = b"ab cd\n" * 400_000 + b"x" * 3_000_000 + b" end"
    parts = list(slices(raw, b" \n"))
    assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split() and len(parts) > 2


@pytest.mark.parametrize("base", [2**60, -(2**60), -150])
def test_topk_with_large_negative_and_repeated_ids(spark, base):
    g = np.random.default_rng(3)
    base -= base % 50
    rows = [(base + i, [float(x) for x in g.normal(size=6)]) for i in range(300)]
    rows += rows[7:9]  # repeated rows
    df = spark.createDataFrame([(*x, 1, "q", 2) for x in rows], "vec_id long, embedding array<double>, query_id int, q string, kth int")
    ids, x = [i for i, _ in rows], np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    want = []
    for at in range(0, 300, 50):
        best = sorted((-int(x[at] @ x[j]), ids[j]) for j in range(len(ids)) if ids[j] != ids[at])[:5]
        want += [(ids[at], r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for shard in (None, 40):
        got = [tuple(r) for r in topk.top_k(df, shard=shard).select("query_id", "rank", "vec_id", "score").collect()]
        assert sorted(got) == sorted(want)
