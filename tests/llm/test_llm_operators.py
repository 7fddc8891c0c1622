"""The training-data operators on awkward rows, and against brute force or the libraries."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import exactdedup, labelled, licenses, linededup, mixing, neardup, piecebpe, quality, queries, tokencount, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, taken string, salt string, h string, shingles string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing columns."""
    base = text(1, 200)
    rows = [
        (1, base, "en", "a"), (2, base.replace(" ", "\t\n "), "en", "a"), (3, base + " extra", None, "b"), (4, None, None, None), (5, "", "en", "b"), (6, " \n ", "en", "b"),
        (7, "One two THREE", "en", "b"), (8, "one two three", "en", None), (9, text(2, 60_000), "en", "a"), (None, "no id here", "en", "a"), (11, "line\nshared\nother", "en", "a"), (11, "line\nshared\nother", "en", "a"),
        (12, "日本語 ▁ é́ 🙂  x", "xx", "c"),
    ]
    return spark.createDataFrame([(i, t, l, s, None, "x", None, "y", None, "z") for i, t, l, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_exact_dedup(odd, none):
    got = {(r.doc_id, r.text_sha256): r for r in exactdedup.exact_dedup(odd).collect()}
    rows = exactdedup.exact_dedup(odd).collect()
    assert len(rows) == 13 and exactdedup.exact_dedup(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert (by[2].keep_id, by[2].kept, by[2].group_size) == (1, False, 2) and by[1].kept
    assert by[4].keep_id == 4 and by[5].keep_id == 4 and not by[5].kept
    assert by[6].text_sha256 == hashlib.sha256(b" ").hexdigest()
    assert sum(r.kept for r in rows if r.doc_id == 11) == 1
    assert by[None].kept and (None, by[None].text_sha256) in got


def test_exact_dedup_by_neighbours(spark):
    """Copies meet inside their runs; a text with many copies is cut into pieces and put together again, repeated and null ids
    among them."""
    pairs = spark.range(2000).selectExpr("id as doc_id", "concat('text number ', id div 2, '  and so') as text")
    assert exactdedup._runs(pairs, "doc_id", "text", 2000).where("at = 2").count() == 1000
    hot = spark.range(3000).selectExpr("if(id % 50 = 0, null, id % 2900) as doc_id", "if(id % 3 = 0, 'own ' || id, 'the   copied\ttext') as text", "id as row", "'x' as norm", "'y' as at")
    rows = exactdedup.exact_dedup(hot).collect()
    copied = [r for r in rows if r.group_size > 1]
    assert len(rows) == 3000 and len(copied) == 2000 and {r.group_size for r in copied} == {2000} and {r.keep_id for r in copied} == {1}
    assert sum(r.kept for r in copied) == 1 and sum(r.kept for r in rows) == 1001
    left = exactdedup.first_copies(hot)
    assert left.columns == hot.columns and left.count() == 1001
    assert [r.doc_id for r in left.where("text like '%copied%'").collect()] == [1] and exactdedup.first_copies(hot.limit(0)).count() == 0


def test_line_dedup(spark, odd, none):
    docs = spark.createDataFrame([(i, f"Head {i}\n  COMMON line \n\nend" if i < 12 else "\tcommon LINE") for i in range(14)], "doc_id long, text string")
    by = {r.doc_id: r for r in linededup.drop_common_lines(docs).collect()}
    assert by[0].kept_text == "Head 0\n" and (by[0].n_lines, by[0].n_dropped) == (4, 2)
    assert by[13].kept_text == "" and by[13].n_dropped == 1
    rows = {r.doc_id: r for r in linededup.drop_common_lines(odd).collect()}
    assert (rows[4].n_lines, rows[4].n_dropped, rows[4].kept_text) == (1, 0, "") and linededup.drop_common_lines(odd).count() == 13
    assert linededup.drop_common_lines(none).count() == 0


def test_line_dedup_by_position(spark, monkeypatch):
    """A long text with many dropped lines, rows that repeat or lack an id, and more common lines than are sent to all tasks."""
    r = random.Random(3)
    shared = [f"Shared line {i}" for i in range(3000)]
    docs = []
    for i in range(40):
        lines = [x for x in shared if r.random() < 0.4] + [f"own {i} {k}" for k in range(r.randrange(30))]
        r.shuffle(lines)
        docs.append((i if i < 30 else None if i < 35 else 7, "\n".join(lines)))
    docs.append((99, "\n".join(r.choice(shared) if r.random() < 0.9 else f"kept {k}" for k in range(100_000))))
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], "doc_id long, text string, line string, row int, hit string")
    seen = {}
    for _, t in docs:
        for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")} - {""}:
            seen[k] = seen.get(k, 0) + 1
    common = {k for k, n in seen.items() if n >= 10}
    want = []
    for i, t in docs:
        lines = t.split("\n")
        stay = [x for x in lines if x.strip().lower() not in common]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    for sent in (100_000, 50):
        monkeypatch.setattr(linededup, "SENT", sent)
        got = [tuple(x) for x in linededup.drop_common_lines(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_mixing(spark, odd, none):
    docs = spark.createDataFrame([(i, text(i, 5 + i % 90), None if i % 9 == 8 else f"s{i % 7}") for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and len(r.text.split()) == r["size"]
        by.setdefault(r.source, []).append(r)
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-3
    for rs in by.values():
        assert rs[0].source_size == sum(r["size"] for r in rs) and rs[0].target <= 2 * rs[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 100
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix_sources(odd).count() == 13 and mixing.mix_sources(none).count() == 0


def brute_mix(rows, weights, ratio, cap):
    """Targets by raising a level step by step, sizes of the samples, and the smallest ranks, in plain Python. rows: (source, size, u)."""
    import math

    total, names = {}, sorted({r[0] for r in rows}, key=lambda s: (s is None, s))
    for s, size, _ in rows:
        total[s] = total.get(s, 0) + size
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, ratio * sum(total.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if cap * total[s] < level * weight[s]}
        for s in over or open_:
            target[s] = float(cap * total[s]) if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    copies = [0] * len(rows)
    for s in names:
        rate = target[s] / total[s] if total[s] else 0.0
        whole, carry = math.floor(rate), 0.0
        p, bands = rate - whole, {}
        for i, (of, size, u) in enumerate(rows):
            if of == s:
                copies[i] = whole
                if size and p > 0:
                    bands.setdefault(math.floor(math.log2(size) * 4), []).append(i)
        for b in sorted(bands, reverse=True):
            of, words = bands[b], sum(rows[i][1] for i in bands[b])
            odds = {i: p / (1 - p) * rows[i][1] * len(of) / words for i in of}
            chance = {i: o / (1 + o) for i, o in odds.items()}
            mean = sum(chance[i] * rows[i][1] for i in of) / sum(chance.values())
            due = p * words + carry
            take = min(max(math.floor(due / mean + 0.5), 0), len(of))
            carry = due - take * mean
            for i in sorted(of, key=lambda i: rows[i][2] / (1 - rows[i][2]) / odds[i])[:take]:
                copies[i] += 1
    return target, copies


def test_mixing_against_plain_python(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, text(i, int(r.paretovariate(1.1) * 4) % 900), None if i % 9 == 8 else f"s{int(r.paretovariate(0.9)) % 6}") for i in range(4000)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs.withColumn("u", mixing._uniform(17)).withColumn("_p", F.lit(1)).withColumn("key", F.lit("x"))).collect()
    target, copies = brute_mix([(x.source, x["size"], x.u) for x in rows], (3, 1, 2), 1.5, 2)
    assert all(abs(x.target - target[x.source]) < 1e-6 * (1 + x.target) for x in rows)
    assert [x.copies for x in rows] == copies and {0, 1, 2} == set(copies)


def test_mixing_inclusion_frequencies(spark):
    """Longer documents of a band are likelier to be taken, as often as their inclusion probabilities say."""
    docs = spark.range(40_000).selectExpr("id as doc_id", "repeat('w ', cast(64 + id % 12 as int)) as text", "if(id < 36000, 'a', 'b') as source")
    rows = mixing.mix_sources(docs, weights=(1, 9), ratio=0.4).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("share"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    p, mean = rows[0].t / rows[0].s, 64 + 5.5
    for x in rows:
        odds = p / (1 - p) * x["size"] / mean
        assert abs(x.share - odds / (1 + odds)) < 0.035
    share = {x["size"]: x.share for x in rows}
    assert sum(share[k] for k in (73, 74, 75)) > sum(share[k] for k in (64, 65, 66))


def test_mixing_of_repeated_rows(spark):
    same = spark.createDataFrame([(1, "a b c d e f g h", "x")] * 1001 + [(None, "q w e", "y")] * 500 + [(None, None, None)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(same).collect()
    taken, target = sum(x.taken for x in rows if x.source == "x"), next(x.target for x in rows if x.source == "x")
    assert len(rows) == 1502 and abs(taken - target) <= 8 and mixing.mix_sources(same.repartition(7)).agg(F.sum("taken")).first()[0] == sum(x.taken for x in rows)


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, odd, none):
    r = random.Random(5)
    docs, base = [(0, text(99, 150))], text(99, 150).split()
    for i in range(1, 120):  # one long list of near copies, some of them strays
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10_000)}"
        docs.append((i, " ".join(w)))
    for i in range(120, 200):
        docs.append((i, text(i // 3, 40 + i % 3)))
    docs += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a b c d e")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)
    rows = neardup.near_duplicates(odd).collect()
    by = {x.doc_id: x for x in rows}
    assert len(rows) == 13 and by[2].component_id == 1 and by[3].component_id == 1 and by[4].component_id == 4 and by[8].component_id == 7
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_one_long_list(spark):
    """2,000 near copies of one text, up to five words apart from it: chains, strays, and copies of the same set."""
    r = random.Random(15)
    base, docs = text(77, 150).split(), []
    for i in range(2000):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10_000)}"
        docs.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    assert got == brute_components(docs)


def test_components_of_a_star_and_a_path(spark):
    from gridloom.llm.components import components

    star = [(5_000, i) for i in range(3_000)]
    path = [(10_000 + i, 10_001 + i) for i in range(200)]
    got = dict(components(spark.createDataFrame([*star, *path, (None, 3), (7, 7)], "a long, b long")).collect())
    assert got == {**{i: 0 for i in [*range(3_000), 5_000]}, **{10_000 + i: 10_000 for i in range(201)}}


def test_near_duplicates_at_a_lower_threshold(spark):
    """Pairs just above 60% are linked as well: 25% of such pairs collide in fewer than 27 coordinates."""
    assert neardup.matches_for(85) == 27
    with pytest.raises(ValueError):
        neardup.matches_for(20)
    docs = []
    for i in range(40):  # 149 shingles of 243 are shared
        w = text(1000 + i, 200).split()
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:153] + [f"y{i}x{k}" for k in range(47)]))]
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=60).collect()
    assert all(r.component_id == r.doc_id - r.doc_id % 2 for r in rows)


def test_licenses(spark, odd, none):
    notice = licenses.TEMPLATES["apache-2.0-line"]
    docs = spark.createDataFrame([(1, text(1, 37) + " " + notice + " " + text(2, 50)), (2, notice.upper()), (3, text(3, 500)), (4, text(4, 11) + "\n" + licenses.TEMPLATES["mit"] + text(5, 90)), (5, None), (6, "mit")], "doc_id long, text string")
    t = licenses.template_table(spark)
    got = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(docs, t).collect()}
    assert got == {(1, "apache-2.0-line"), (2, "apache-2.0-line"), (4, "mit")}
    assert licenses.scan_licenses(odd, t).count() == 0 and licenses.scan_licenses(none, t).count() == 0


def test_licenses_of_edited_notices(spark, tmp_path):
    """Notices with up to three replaced words, and cut ones, around the threshold: rows and counts as exact containment has them."""
    import duckdb

    docs = []
    for name, notice in licenses.TEMPLATES.items():
        words = notice.split()
        for k in range(60):
            r = random.Random(f"{name} {k}")
            w = list(words)
            for at in r.sample(range(len(w)), min(k % 4, len(w))):
                w[at] = f"x{r.randrange(10_000)}"
            if k % 5 == 4:
                w = w[r.randrange(2) : len(w) - r.randrange(2)]
            docs.append((len(docs), text(f"{name} {k} a", 20 + k % 9) + " " + " ".join(w) + " " + text(f"{name} {k} b", 30)))
    docs += [(None, licenses.TEMPLATES["isc"]), (None, "no notice in this row of text")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op4_license_scan"]).fetchall()
    got = licenses.scan_licenses(df, licenses.template_table(spark)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 300


def test_token_counts(odd, none):
    path = queries.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(odd, path).collect())
    want = sorted((r.doc_id is None, r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert got == want and tokencount.count_tokens(none, path).count() == 0


def test_token_counts_refuse_tokens_with_spaces(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE(vocab={c: k for k, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}, merges=[]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        tokencount.WordCounter(str(tmp_path / "t.json"))


def test_sentencepiece(odd, none):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens if hasattr(r, "n_tokens") else 0)
    got = sorted(piecebpe.encode_decode(odd, path).collect(), key=key)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids)
    d = {r.doc_id: r for r in piecebpe.encode_digests(odd, path).collect()}
    assert d[4].ids_sha256 == hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest()
    assert piecebpe.encode_decode(none, path).count() == 0


def test_sentencepiece_of_texts_without_spaces():
    """1 MB without a space: cut where no piece crosses, and merged by one agenda where none may be cut."""
    import time

    path = queries.tokenizer_path("piece_bpe_32k.model")
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(300_000)), "a" * 200_000, " " * 5_000, "".join(r.choice("ab \n.,▁é́日🙂") for _ in range(50_000))]
    codec = piecebpe.Codec(path)
    began = time.time()
    got = list(codec.encode_all(texts, True, True))
    assert time.time() - began < 30
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == codec.lib.encode(t, add_bos=True, add_eos=True)
        assert codec.decode(ids) == codec.lib.decode(codec.lib.encode(t))


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (700, 8))
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.1, None] + [0.0] * 6), (702, [float("nan")] + [0.0] * 7), (750, [0.5] * 3), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, k=5, every=50, shard=128).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    w = np.floor(256 * x).astype(np.int64)
    for q in range(0, 700, 50):
        s = w @ w[q]
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:5]
        assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 700, 50))
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("name, label, mod, held, least", [("op7_quality", "quality", 3, 1, 0.93), ("op8_toxicity", "toxic", 5, 0, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, mod, held, least):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.queries()[name](spark, d).where("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (7, None), (99, 0)], "doc_id long, quality int")
    net = quality.train_quality(odd, labels, labelled.fold(3) >= 0, max_docs=10)
    assert odd.select(quality.quality_score(net, F.col("text")).alias("s")).where("s between 0 and 1").count() == 13
    assert none.select(quality.quality_score(net, F.col("text"))).count() == 0
    model = toxicity.train_toxicity(odd, labels.withColumnRenamed("quality", "toxic"), labelled.fold(5) >= 0, max_docs=10)
    assert odd.select(toxicity.toxicity_score(model, F.col("text")).alias("s")).where("s between 0 and 1").count() == 13
    unlabelled = toxicity.train_toxicity(odd, labels.limit(0).withColumnRenamed("quality", "toxic"), labelled.fold(5) >= 0)
    assert odd.select(toxicity.toxicity_score(unlabelled, F.col("text")).alias("s")).where("s = 0.5").count() == 13


def slow_net(net, text):
    """The net's score by loops: every chunk, every window, every filter."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n = max(1, -(-(len(text) - (quality.CHUNK - quality.HOP)) // quality.HOP))
    pooled = []
    for k in range(n):
        chunk = text[k * quality.HOP : k * quality.HOP + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        windows = [np.concatenate([p["embed"][b] for b in chunk[at : at + quality.WIDTH]]) for at in range(quality.CHUNK - quality.WIDTH + 1)]
        pooled.append([max(0.0, max(float(w @ f) for w in windows) + s) for f, s in zip(p["filters"].T, p["shift"])])
    h = [sum(x) / n for x in zip(*pooled)] + [max(x) for x in zip(*pooled)]
    return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(h, p["out"])) + p["bias"][0])))


def test_quality_net_against_loops_and_differences():
    r = random.Random(2)
    texts = [b"", b"short", text(3, 120).encode(), text(4, 700).encode(), bytes(r.randrange(256) for _ in range(985))]
    net = quality.ByteConvNet()
    net.p["out"] = np.random.default_rng(1).normal(0, 0.1, 2 * quality.FILTERS).astype(np.float32)
    assert np.allclose(net.score(texts), [slow_net(net, t) for t in texts], atol=1e-5)
    y, weight = np.array([0, 1, 1, 0, 1]), np.ones(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = np.array([np.log(s / (1 - s)) for s in net.score(texts)])
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    grads = net.gradients(texts, y, weight)
    for name, at in (("bias", (0,)), ("out", (3,)), ("out", (quality.FILTERS + 5,)), ("shift", (7,)), ("filters", (9, 4)), ("filters", (33, 11)), ("embed", (ord("a"), 2))):
        held, step = net.p[name][at], 1e-3
        net.p[name][at] = held + step
        up = loss()
        net.p[name][at] = held - step
        down = loss()
        net.p[name][at] = held
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-4


def test_quality_net_sees_every_alignment():
    """A byte put in front leaves each window where it was in the text, so the filters' maxima over it never fall."""
    net = quality.ByteConvNet()
    for k in (1, 2, 3, 5):
        for t in (text(5, 60).encode(), text(6, 120).encode()):
            before, after = (net.pooled(quality.chunked([x])[0]) for x in (t, b" " * k + t))
            assert len(before) == len(after) == 1 and (after >= before - 1e-5).all()
            own = net.pooled(quality.chunked([b" " * k + t[: quality.WIDTH]])[0])  # only windows over the front or the padding may add
            assert (after <= np.maximum(before, own) + 1e-5).all()


def test_quality_of_a_text_of_two_megabytes():
    net = quality.ByteConvNet()
    net.p["out"] = np.random.default_rng(1).normal(0, 0.1, 2 * quality.FILTERS).astype(np.float32)
    long = (text(7, 300) + " ").encode() * 1200
    assert len(long) > 1 << 21
    chunks, n = quality.chunked([long])
    assert n[0] == -(-(len(long) - (quality.CHUNK - quality.HOP)) // quality.HOP) == len(chunks)
    parts = np.concatenate([net.pooled(chunks[k : k + 100]) for k in range(0, len(chunks), 100)]).astype(np.float64)
    z = np.r_[parts.mean(0), parts.max(0)] @ net.p["out"] + net.p["bias"][0]
    assert abs(net.score([b"x", long])[1] - 1 / (1 + np.exp(-z))) < 1e-4


@pytest.mark.parametrize("segment", [toxicity.SEGMENT, None])
def test_toxicity_softmax_against_whole_vectors(segment):
    """The collapsed values of the scorer give what averaging the embeddings and a softmax of two classes give."""
    import pickle

    model = toxicity.SubwordSoftmax(segment=segment)
    texts = [b"", b" \n", b"one", text(5, 37).encode(), text(6, 64).encode(), (text(7, 300_000)).encode()]
    want = []
    for t in texts:
        words, logits = toxicity.words_of(t), []
        if not words:
            logits = [model.bias]
        elif segment or len(words) < 1000:
            size = segment or len(words)
            for at in range(0, len(words), size):
                ids, _ = toxicity.subwords(words[at : at + size])
                logits.append(model.embed[ids].mean(0) @ model.out + model.bias)
                if at > 4000:
                    break
        p = [float(np.exp(z[1]) / np.exp(z).sum()) for z in logits]
        want.append(max(p, default=None))
    got = pickle.loads(pickle.dumps(model)).score(texts)
    assert np.allclose(got[:5], want[:5], atol=1e-5) and 0 < got[5] < 1


def test_classifiers_without_usable_labels(spark):
    """Labelled texts that are all empty, labels of one class, no documents: the prior; held_out is never null."""
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, toxic int")
    anyone = labelled.fold(5) >= -1
    for rows, marks in ((docs, labels), (docs.limit(0), labels), (docs, labels.where("toxic = 1"))):
        model = toxicity.train_toxicity(rows, marks, anyone)
        assert docs.select(toxicity.toxicity_score(model, F.col("text")).alias("s")).where("s between 0 and 1").count() == 4
        net = quality.train_quality(rows, marks.withColumnRenamed("toxic", "quality"), anyone)
        assert docs.select(quality.quality_score(net, F.col("text")).alias("s")).where("s between 0 and 1").count() == 4
    assert docs.where((labelled.fold(3) == 1).isNull() | (labelled.fold(5) == 0).isNull()).count() == 0
    long = docs.union(spark.createDataFrame([(9, "word " * 30_000), (10, "good text"), (11, "bad text")], docs.schema))
    marks = spark.createDataFrame([(9, 1), (10, 1), (11, 0)], "doc_id long, quality int")
    got, y = labelled.labelled_sample(long, marks, "quality", anyone, 2)
    assert got == [b"good text", b"bad text"] and y.tolist() == [1, 0]  # the long text is passed over before the draw


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    from compare import engine, rows

    d = "/root/testdata/sf0.001"
    assert rows(queries.queries()[name](spark, d).toPandas()) == rows(engine(d).execute(queries.oracle_sql()[name]).df())


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, d)
        assert out.columns == docs.columns
        if name != "mix":
            assert out.count() <= seen.count()
        seen = out
    rows = corpus_pipeline.run(spark, d)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() == seen.count()


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    """Rows that repeat an id or have none are decided one by one: one copy stays, and a row with its own text does."""
    import corpus_pipeline
    from gridloom.llm.common import scratch

    d = "/root/testdata/sf0.001"
    more = [(3, text(7, 30)), (3, "line shared other"), (None, "no id here"), (None, "no  id here"), (None, text(8, 40)), (None, text(8, 40) + " extra"), (2, text(9, 30)), (0, text(10, 60)), (0, text(10, 60) + " more")]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).select(*corpus_pipeline.COLUMNS)
    key = lambda df: sorted(((r.doc_id, " ".join((r.text or "").split())) for r in df.collect()), key=repr)
    base, shared = text(1, 200), "line shared other"
    exact = [(1, base), (3, base + " extra"), (3, text(7, 30)), (3, shared), (4, ""), (6, ""), (7, "One two THREE"), (8, "one two three"), (9, text(2, 60_000)), (None, "no id here"), (None, text(8, 40)), (None, text(8, 40) + " extra"), (12, "日本語 ▁ é́ 🙂 x"), (2, text(9, 30)), (0, text(10, 60)), (0, text(10, 60) + " more")]
    left = scratch(corpus_pipeline.drop_copies(spark, docs, d), "test")
    assert key(left) == sorted(exact, key=repr)
    near = key(corpus_pipeline.drop_near_copies(spark, left, d))
    ids = [i for i, _ in near]
    assert len(near) == len(exact) - 4 and (3, base + " extra") not in near and (8, "one two three") not in near
    assert (3, text(7, 30)) in near and (3, shared) in near and ids.count(0) == 1 and ids.count(None) == 2
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert [r.doc_id for r in stage(spark, odd, d).collect()].count(11) == 1 and stage(spark, none, d).count() == 0
    assert corpus_pipeline.keep_quality(spark, docs, d).where("doc_id = 11").count() in (0, 2)
    mixed = corpus_pipeline.mix(spark, left, d)
    assert mixed.columns == corpus_pipeline.COLUMNS and corpus_pipeline.encode(spark, left, d).count() == len(exact)
