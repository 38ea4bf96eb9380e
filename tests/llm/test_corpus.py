import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tablewright.llm import (
    ann,
    bpe,
    common,
    embedding_dedup,
    jaccard_join,
    mixing,
    paragraph_dedup,
    pii,
    queries,
    sharding,
    toxicity,
    url_filter,
)

from . import brute

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    base = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (None, "some words here to say", "en", None, 5),
        (5, "Same text in two rows of ten words or so.", "en", "a", 1), (5, "Same text in two rows of ten words or so.", "en", "a", 1),
        (7, "Same text in two rows of ten words or so.", None, "b", 1), (8, LONG, "de", "a", len(LONG)), (9, "one", "en", "c", 3),
        (10, "two words", "en", "c", 9), (11, "日本語 テキスト 😀 a@b.example +1 (555) 010-9999", "ja", "c", 1),
    ]
    df = spark.createDataFrame(base, DOC)
    for name in ("score", "predicted", "ids", "spans", "base", "size", "shard", "slot", "rate", "mix_key", "component_id", "item"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet")


# 1: personal data


def test_base_spans_are_those_of_the_rules(spark):
    got = {r["doc_id"]: r for r in queries.op1_pii(spark, MIDDLE).collect()}
    for i, text in rows_of(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")):
        want = brute.personal(text)
        assert got[i]["base_sha256"] == brute.spans_digest(want), i
        for kind in ("email", "ip", "card", "phone"):
            assert got[i][f"n_{kind}"] == sum(k == kind for k, _, _ in want)
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(got[i]["spans"].split(","))


TRICKY = [
    None, "", "a@b.c_d@e.f", "a@b..c x@y.zz.", "😀 a.b@c.d é 1.2.3.4.5.6.7.8", "1.2.3.256 001.2.3.4 99999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111  1111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (632) 555-4827 4918187128635271", "+1234567", "+1-2",
    "+" + "1" * 30, "1" * 50_000, "1 " * 20_000, "a" * 50_000 + "@b." + "c." * 20_000 + "d", "a@" * 2_000, "1." * 30_000, "+1" + "(" * 30_000,
    "x@y.z" * 500, "0" * 12, "0 0-0 0 0 0 0 0 0 0 0 0", "mail:joe@x.org,1.1.1.1;+44 20 7946 0958",
]


def test_base_spans_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    found = pii.find_spans(df, pii.SpanModel()).select("doc_id", pii.written_spans(F.col("spans")).alias("s"))
    for i, s in rows_of(found):
        assert s == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(TRICKY[i])), TRICKY[i] and TRICKY[i][:60]


def test_trees_find_secrets_and_leave_prose(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 18)))
    rows = []
    for i in range(400):
        text = [word() for _ in range(30)]
        if i % 4 == 0:
            text[10] = "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(20))
        elif i % 4 == 1:
            text[10] = "page_2024-" + word() + "-" + word() + "-section"
        elif i % 4 == 2:
            text[10] = "AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(16))
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = dict(rows_of(pii.find_spans(df).select("doc_id", F.expr("filter(spans, s -> s.kind = 'secret').value"))))
    hit = lambda k: sum(bool(found[i]) for i in range(400) if i % 4 == k)
    assert hit(0) >= 90 and hit(2) >= 90 and hit(1) <= 5 and hit(3) == 0


def test_redaction_keeps_columns_and_the_rest_of_the_text(spark):
    df = odd_docs(spark).drop("spans", "base")
    out = pii.redact(df, pii.SpanModel())
    assert out.columns == df.columns and out.count() == df.count()
    text, n = out.where("doc_id = 11").select("text", "n_chars").first()
    assert text == "日本語 テキスト 😀 [EMAIL] [PHONE]" and n == len(text)
    assert out.where("doc_id = 1").first()["text"] is None
    assert pii.redact(df.limit(0)).count() == 0


def test_personal_data_runs_in_the_jvm(spark, docs):
    plan = pii.find_spans(docs, pii.SpanModel())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 2: toxicity


def test_held_out_toxicity(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    rows = rows_of(got.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score"))
    assert sum(p == t for p, t, _ in rows) / len(rows) > 0.98
    assert all(0 <= s <= 1 and (s >= 0.5) == (p == 1) for p, _, s in rows)
    assert got.count() == 10_000


def test_folding():
    assert toxicity.fold("1d10t!") == " idiot "
    assert toxicity.fold("ІDІОТ") == " idiot " and toxicity.fold("ｓｃｕｍ") == " scum " and toxicity.fold("s\u200bcum") == " scum "
    assert toxicity.fold(None) == " " and toxicity.fold("It's 2024, yes") == " it s yes "


def test_lexicon_exceptions_and_lengths():
    model = toxicity.ToxicityModel({"trash": 5.0, "lowei": 4.0})
    automaton = model.automaton()
    measure = lambda t: toxicity._measure(automaton, t)
    assert measure("what tr4sh")[2] == 1 and measure("Loweischaft")[2] == 1 and measure("slowei")[2] == 0
    assert measure("the trash can")[0] == 0 and measure("trash in the trash can")[0] == math.log1p(5)
    assert measure("trash")[1] > measure("trash " + "good " * 500)[1] > 0 == measure("")[0]


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (5, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    df = odd_docs(spark)
    model = toxicity.learn(df, labels)
    out = toxicity.score(df, model)
    assert out.count() == df.count() and out.where("score is null or predicted <> 0").count() == 0
    assert set(out.columns) == set(df.columns) | {"n_hits"}
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.learn(df, labels.limit(0)).lexicon == {}


# 3: n-gram Jaccard join


def near_texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    rows, n = [], 0
    for size in (6, 11, 12, 40, 120, 400):
        for group in (2, 3, 45):
            base = [word() for _ in range(size)]
            for _ in range(group if size < 400 else min(group, 12)):
                copy = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, size // 60)])):
                    copy[rng.randrange(len(copy))] = word()
                if rng.random() < 0.3:
                    copy.append(word())
                rows.append((n, " ".join(copy)))
                n += 1
    common_part = " ".join(word() for _ in range(30))
    for _ in range(80):
        rows.append((n, common_part + " " + " ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 5, 30])))))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("frequent", "words", "percent"), [(32, 3, 90), (3, 3, 90), (4, 5, 80), (10**9, 3, 90)])
def test_jaccard_join_is_exact(spark, monkeypatch, frequent, words, percent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: (n, c) for i, n, c in rows_of(jaccard_join.jaccard_components(df, words, percent))}
    assert got == brute.jaccard_components(rows, words, percent)


@pytest.mark.parametrize("near", [0.15, 0.5, 1.0])
def test_jaccard_rounds_that_need_more_heads(spark, monkeypatch, near):
    from tablewright.llm import links

    monkeypatch.setattr(links, "SMALL", 2)
    monkeypatch.setattr(links, "NEAR", near)
    rows = near_texts(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: (n, c) for i, n, c in rows_of(jaccard_join.jaccard_components(df))}
    assert got == brute.jaccard_components(rows, 3, 90)


def test_jaccard_query_is_exact(spark, docs):
    got = {i: (n, c) for i, n, c in rows_of(queries.op3_ngram_jaccard(spark, MIDDLE))}
    assert got == brute.jaccard_components(rows_of(docs.select("doc_id", "text")), 3, 90)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(0)
    for trial in range(100):
        n = int(rng.integers(9, 400))
        tokens = np.unique(rng.integers(0, 2**63, n + 60, dtype=np.uint64))
        base, extra = tokens[:n], tokens[n:]
        common_ones = np.sort(rng.choice(tokens, int(rng.integers(0, len(tokens))), replace=False))
        bit = common_ones & np.uint64((1 << jaccard_join.MAP_BITS) - 1)
        words = np.zeros(1 << (jaccard_join.MAP_BITS - 6), np.uint64)
        np.bitwise_or.at(words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        drop = int(rng.integers(0, n // 10 + 1))
        other = np.setdiff1d(base, rng.choice(base, drop, replace=False))
        other = np.sort(np.concatenate([other, extra[: int(rng.integers(0, 1 + max(0, n - drop) // 10))]]))
        both = len(np.intersect1d(base, other))
        if 100 * both >= 90 * (len(base) + len(other) - both):
            a, b = jaccard_join.signatures(base, words, 90), jaccard_join.signatures(other, words, 90)
            assert len(np.intersect1d(a, b)), (trial, n)
            assert len(a) <= 8 * (n // 10 + 3)


def test_jaccard_of_odd_tables(spark):
    got = sorted(rows_of(jaccard_join.jaccard_components(odd_docs(spark))), key=str)
    by_id = {}
    for i, n, c in got:
        by_id.setdefault(i, []).append((n, c))
    assert (by_id[1], by_id[2], by_id[3]) == ([(0, 1)], [(0, 2)], [(0, 3)])
    assert by_id[5] == [(8, 5), (8, 5)] and by_id[7] == [(8, 5)] and by_id[9] == [(1, 9)] and by_id[10] == [(1, 10)]
    assert by_id[None] == [(3, None)] and len(got) == 11
    kept = jaccard_join.one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == 10 and kept.where("doc_id = 7").count() == 0
    assert jaccard_join.jaccard_components(odd_docs(spark).limit(0)).count() == 0


# 4: byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path(queries.VOCABULARY)
    ranks = bpe.load_ranks(path)
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(spark, docs, encoding):
    _, library = encoding
    got = {r["doc_id"]: r for r in queries.op4_byte_bpe(spark, MIDDLE).collect()}
    for i, text in rows_of(docs.select("doc_id", "text")):
        ids = library.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_merge_replay_on_any_bytes(encoding):
    path, library = encoding
    replay = bpe.MergeReplay(bpe.load_ranks(path))
    rng = random.Random(3)
    made = ["".join(rng.choice("abce éüß漢😀=_'  \n\u00a0١") for _ in range(rng.randint(0, 50))) for _ in range(2_000)]
    made += ["a" * 5_000, "=" * 3_000, "ab" * 999, ""]
    ids, counts = replay.encode([w.encode() for w in made])
    for word, own in zip(made, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == (library._encode_single_piece(word.encode()) if word else [])


def test_merges_that_bring_up_lower_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"ba": 299, b"abab": 260, b"bab": 270, b"aba": 280, b"cabab": 259}
    replay = bpe.MergeReplay(ranks)
    words = [w.encode() for w in ("abab", "ababab", "cabababab", "bababa", "abcababab" * 3)]
    ids, counts = replay.encode(words)
    library = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    for word, own in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == replay._one(word) == library._encode_single_piece(word)


def test_encoding_of_odd_tables(spark, encoding):
    path, library = encoding
    df = odd_docs(spark)
    out = bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path)
    assert sorted(map(repr, bpe.round_trip(df, path, public_tokenizers.PATTERN).collect())) == sorted(map(repr, out.collect()))
    assert out.count() == df.count() and set(out.columns) == set(df.columns) | {"decoded"}
    for text, ids, decoded in rows_of(out.select("text", "ids", "decoded")):
        assert ids == library.encode_ordinary(text or "") and bytes(decoded) == (text or "").encode()
    assert bpe.encode(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


# 5: embedding near-duplicates


def test_vector_links(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            base = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((len(rows), (base + rng.standard_normal(16) * 0.03).tolist(), label))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(3)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [None] * 16, 1), (203, [float("nan")] * 16, 1), (204, [float("inf")] * 16, 1),
             (205, rows[0][1], None), (206, [], 0), (207, [1.0, 2.0], 0), (208, (np.array(rows[0][1]) * 3).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("codes", F.lit("own"))
    got = {i: (n, c, k) for i, n, c, k in rows_of(embedding_dedup.near_duplicates(df))}
    want = brute.vector_links([r for r in rows if r[0] != 207], 0.98) | {207: (0, 207, True)}
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vector_query_and_blocks(spark, monkeypatch):
    want = brute.vector_links(rows_of(spark.read.parquet(f"{MIDDLE}/embeddings.parquet").select("vec_id", "embedding", "label")), 0.98)
    for block in (embedding_dedup.BLOCK, 3):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = {i: (n, c, k) for i, n, c, k in rows_of(queries.op5_embedding_dedup(spark, MIDDLE))}
        assert got == want


# 6: URL filter


def test_hosts_paths_and_rules(spark):
    cases = [
        (None, "", "", None), ("no scheme", "", "", None), ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"), ("https://x.org", "x.org", "", None),
        ("https://x.org/", "x.org", "/", "org/"), ("http://badexample.org/es/", "badexample.org", "/es/", "org/"),
        ("http://É.com/fr/a://b/de/", "É.com", "/fr/a://b/de/", "com/fr/"), ("x://c.com/de/?q=/fr/", "c.com", "/de/", "com/de/"),
        ("http://n.net/de/", "n.net", "/de/", None), ("http://a\nb.org/x", "a\nb.org", "/x", "org/"), ("http://org/", "org", "/", "org/"),
        ("http://q.com?/fr/", "q.com", "", None), ("://", "", "", None), ("http://" + "z" * 5_000 + ".net/" + "w" * 20_000, "z" * 5_000 + ".net", "/" + "w" * 20_000, None),
    ]
    df = spark.createDataFrame([(i, c[0], "own") for i, c in enumerate(cases)], "page_id long, url string, words string")
    got = {r["page_id"]: r for r in url_filter.judge(df, {"a": 3}).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), cases[i][0]
    verdict = {("example.org/es/"): "block", "example.org/en/1": "block", "org/": "allow", "com/fr/": "allow", "com/de/": "block"}
    assert all(got[i]["verdict"] == verdict[c[3]] for i, c in enumerate(cases) if c[3])
    assert url_filter.judge(df.limit(0), {}).count() == 0


def test_joined_names_are_cut_and_judged(spark):
    counts = {"the": 900, "a": 500, "casino": 3, "win": 5, "garden": 8, "plants": 4, "in": 700, "as": 200}
    cut = url_filter.Segmenter(counts).words
    assert cut("casinowin.net") == ["casino", "win", "net"] and cut("gardenplants") == ["garden", "plants"] and cut("") == []

    def cost(parts, segmenter):
        return sum(segmenter.cost.get(p, segmenter.unknown + 1.5 * len(p)) for p in parts)

    segmenter = url_filter.Segmenter(counts)
    rng = random.Random(5)
    for _ in range(200):
        name = "".join(rng.choice(["the", "a", "win", "as", "in", "x", "q"]) for _ in range(4))[:9]
        best = min(
            cost([name[i:j] for i, j in zip([0, *cuts], [*cuts, len(name)], strict=True)], segmenter)
            for mask in range(2 ** (len(name) - 1))
            for cuts in [[k + 1 for k in range(len(name) - 1) if mask >> k & 1]]
        )
        assert abs(cost(segmenter.cut(name), segmenter) - best) < 1e-9
    df = spark.createDataFrame([(1, "http://bestcasinowin.net/x"), (2, "http://gardenplants.net/guide"), (3, "http://cheappills.info/")], "page_id long, url string")
    assert dict(rows_of(url_filter.judge(df, counts).select("page_id", "verdict"))) == {1: "block", 2: "allow", 3: "block"}


def test_url_query(spark):
    got = queries.op6_url_filter(spark, MIDDLE)
    assert got.count() == 250 and got.where("verdict not in ('allow', 'block') or verdict is null").count() == 0
    blocked = {h for (h,) in rows_of(got.where("verdict = 'block' and rule is null").select("host").distinct())}
    allowed = {h for (h,) in rows_of(got.where("verdict = 'allow' and rule is null").select("host").distinct())}
    bad = ("casino", "pills", "adult", "bets", "spam", "ads-track")
    assert all(any(b in h for b in bad) for h in blocked) and not any(b in h for h in allowed for b in bad)


# 7: sharding


def least_capacity(weights, shards):
    def fits(c):
        used, held = 1, 0
        for w in weights:
            if w > c:
                return False
            if held + w > c:
                used, held = used + 1, 0
            held += w
        return used <= shards

    low, high = 0, sum(weights)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("cells", [8, 64, sharding.CELLS])
def test_shards_are_minimax(spark, monkeypatch, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    got = queries.op7_sharding(spark, MIDDLE).collect()
    texts = dict(rows_of(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")))
    hashed = dict(rows_of(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", F.xxhash64("text", F.lit(False)))))
    groups, shard_of, load, slots = {}, {}, {}, {}
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["law"] == "bytes" and r["grown_shard"] is None
        h = hashed[r["doc_id"]]
        groups[h] = groups.get(h, 0) + r["size"]
        assert shard_of.setdefault(h, r["shard"]) == r["shard"]
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    order = sorted(groups)
    assert [shard_of[h] for h in order] == sorted(shard_of[h] for h in order) and set(load) <= set(range(24))
    assert max(load.values()) == least_capacity([groups[h] for h in order], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r["doc_id"]: r["text_crc32"] for r in got}
    assert all(by_id[i] == zlib.crc32(t.encode()) for i, t in texts.items())


def test_shards_of_odd_tables(spark):
    out = sharding.shard_documents(odd_docs(spark))
    rows = out.select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 11 and by_id[1]["size"] == 8 == by_id[2]["size"] and by_id[1]["text_crc32"] == 0
    assert by_id[5]["shard"] == by_id[7]["shard"]
    assert sharding.shard_documents(odd_docs(spark).limit(0)).count() == 0
    plan = sharding.shard_documents(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 8: nearest neighbours


def nearest(rows, queries_of, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if queries_of(i):
            d = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
            d[ids == i] = np.inf
            order = np.lexsort((ids, d))[:k]
            out[i] = [(int(ids[o]), float(d[o])) for o in order if np.isfinite(d[o])]
    return out


def test_recall_of_the_forest(spark):
    rows = rows_of(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding"))
    want = nearest(rows, lambda i: i % 100 == 0)
    got = {}
    for q, rank, v, s in sorted(rows_of(queries.op8_nearest_vectors(spark, "/root/testdata/sf0.1"))):
        got.setdefault(q, []).append((v, s))
        assert rank == len(got[q])
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in got)
    score = dict(((q, v), s) for q in want for v, s in want[q])
    assert all(abs(s - score.get((q, v), s)) < 1e-9 for q in got for v, s in got[q])
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.9


def test_neighbours_of_odd_tables(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).round(3).tolist()) for i in range(0, 90)]
    rows += [(i, rows[0][1]) for i in range(100, 130)]
    odd = [(300, None), (301, [0.0] * 6), (302, [None] * 6), (303, [float("nan")] * 6), (304, []), (None, rows[1][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("own"))
    for block in (ann.BLOCK, 7):
        monkeypatch.setattr(ann, "BLOCK", block)
        got = {}
        for q, _, v, s in sorted(rows_of(ann.nearest(df, F.col("vec_id") % 10 == 0, search=1.0, leaf=8))):
            got.setdefault(q, []).append((v, round(s, 9)))
        assert got == {q: [(v, round(s, 9)) for v, s in n] for q, n in nearest(rows, lambda i: i % 10 == 0).items()}
    few = ann.nearest(df.where("vec_id in (0, 1, 300)"), F.col("vec_id") % 10 == 0)
    assert [(q, r, v) for q, r, v, _ in rows_of(few)] == [(0, 1, 1)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


# 9: source mixing


def test_mix_matches_its_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{MIDDLE}/documents.parquet'")
    cur = con.execute(mixing.ORACLE_SQL)
    names = sorted(d[0] for d in cur.description)
    want = cur.df()[names].astype(str).values.tolist()
    df = queries.op9_source_mixing(spark, MIDDLE)
    assert sorted(df.columns) == names
    keys = [r["mix_key"] for r in df.collect()]
    assert keys == sorted(keys)
    assert sorted(df.select(names).toPandas().astype(str).values.tolist()) == sorted(want)


def test_mix_reaches_its_weights(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text"), F.expr("if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null))").alias("source"))
    out = mixing.mix_sources(df, {"a": 3.0, None: 1.0}, epochs=2.0)
    got = dict(rows_of(out.groupBy("source").count()))
    assert "b" not in got and abs(got["a"] - 30_000) < 1_000 and abs(got[None] - 10_000) < 600
    assert out.groupBy("doc_id").agg(F.max("mix_copy") + 1 == F.count("*")).where("not `((max(mix_copy) + 1) = count(1))`").count() == 0


def test_poisson_inversion(spark):
    rows = [(u / 50, rate) for u in range(50) for rate in (0.0, 0.3, 1.0, 7.5, 80.0)]
    got = rows_of(spark.createDataFrame(rows, "u double, rate double").select("u", "rate", mixing.poisson_count(F.col("u"), F.col("rate"))))
    for u, rate, k in got:
        cdf, p, n = math.exp(-rate), math.exp(-rate), 0
        while u >= cdf:
            n += 1
            p *= rate / n
            cdf += p
        assert k == n, (u, rate)


def test_mix_of_large_rates(spark):
    large = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("x" * 999).alias("text"), F.lit("a").alias("source"))
    tiny = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"))
    both = large.unionAll(tiny)
    rate = mixing.mixing_rates(both).where("source is null").first()["rate"]
    got = dict(rows_of(mixing.mix_sources(both).groupBy("source").count()))
    assert rate > 3_000 and abs(got[None] - rate) < 6 * math.sqrt(rate) and abs(got["a"] - 10_000) < 600
    many = mixing.mix_sources(large.limit(200).coalesce(1), epochs=2_000.0, shuffled=False).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("mix_copy").alias("top"))
    counts = [n for _, n, top in rows_of(many) if top == n - 1]
    assert len(counts) == 200 and abs(np.mean(counts) - 2_000) < 20 and 1_200 < np.var(counts) < 3_200


def test_mix_of_odd_tables(spark, monkeypatch):
    df = odd_docs(spark)
    out = mixing.mix_sources(df, epochs=3.0)
    assert set(out.columns) == set(df.columns) | {"mix_copy"}
    first = sorted(map(str, out.collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_sources(df, epochs=3.0).collect())) == first
    assert mixing.mix_sources(df.limit(0)).count() == 0


# 10: repeated passages


def prose(rng, n, start=0):
    out = []
    for i in range(n):
        w = "".join(rng.choice("abcdefghijklm") for _ in range(5))
        out.append(w + ("." if i % 9 == 8 else ""))
    return out


def planted(seed=6):
    rng = random.Random(seed)
    passage, line = prose(rng, 63), prose(rng, 60)
    docs, dirty = [], set()
    for i in range(120):
        w = prose(rng, rng.choice([30, 90, 200]))
        w[rng.randrange(len(w))] += "\nBoilerplate of a dozen words that each of the pages may hold.\n"
        if i % 10 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage
            dirty.add(i)
        text = " ".join(w)
        if i % 10 == 1:
            copy = list(line)
            if i % 20 == 1:
                copy[30] = "changed"
            text += "\n" + " ".join(copy) + "\n"
            dirty.add(i)
        if i in (5, 6):
            text = docs[4][1] if i == 5 else docs[4][1] + " more"
            dirty |= {4, i}
        docs.append((i, text))
    return docs, dirty


def test_planted_passages_are_found(spark):
    docs, dirty = planted()
    found = paragraph_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = rows_of(found)
    assert {r[0] for r in rows} == dirty
    kept = {r[0] for r in rows if not r[5]}
    assert all(r[4] <= r[0] for r in rows) and {r[4] for r in rows} <= kept
    assert all(r[3] >= paragraph_dedup.LEAST_WORDS for r in rows)
    out = dict(rows_of(paragraph_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), found)))
    assert len(out) == len(docs) and out[0] == docs[0][1] and len(out[10]) < len(docs[10][1])
    assert len(out[5]) < len(docs[5][1]) / 2
    assert out[2] == docs[2][1]


def brute_paragraph_pairs(rows, least, percent):
    units = [(i, n, brute.shingle_set(line, 5)) for i, t in rows for n, line in enumerate((t or "").split("\n")) if len(brute.words(line)) >= least]
    pairs = set()
    for a, (i, _, x) in enumerate(units):
        for j, _, y in units[a + 1 :]:
            if i != j and 100 * len(x & y) >= percent * len(x | y):
                pairs |= {i, j}
    return pairs


def test_paragraph_links_against_brute_force(spark, docs):
    rows = rows_of(docs.where("n_chars < 4000").limit(300).select("doc_id", "text"))
    found = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r[0] for r in rows_of(found.where("kind = 'paragraph'"))}
    want = brute_paragraph_pairs(rows, paragraph_dedup.LEAST_WORDS, paragraph_dedup.PERCENT)
    assert want - got == set() and got == want


def found_in(spark, texts):
    """The rows found, and the texts without repeats."""
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    found = paragraph_dedup.repeated_passages(df)
    return rows_of(found), dict(rows_of(paragraph_dedup.without_repeats(df, found)))


def hosted(rng, *inner):
    """One line: words of its own around each of the passages."""
    return " ".join(" ".join(prose(rng, 27) + p) for p in inner) + " " + " ".join(prose(rng, 27))


def test_a_copy_of_each_sentence_stays(spark):
    rng = random.Random(8)
    p1, p2 = prose(rng, 36), prose(rng, 45)
    rows, out = found_in(spark, {1: hosted(rng, p1), 2: hosted(rng, p1 + p2), 3: hosted(rng, p2), 4: hosted(rng, p2, p1)})
    for p, keeper in ((p1, 1), (p2, 2)):
        assert [i for i in sorted(out) if " ".join(p) in out[i]] == [keeper]
    assert sorted(rows) == sorted([
        (1, "passage", 27, 36, 1, False), (2, "passage", 27, 36, 1, True), (2, "passage", 63, 45, 1, False),
        (3, "passage", 27, 45, 1, True), (4, "passage", 27, 45, 1, True), (4, "passage", 99, 36, 1, True),
    ])


def test_passages_match_repeated_paragraphs(spark):
    rng = random.Random(9)
    p, q = prose(rng, 36), prose(rng, 27)
    line = " ".join(p)
    rows, out = found_in(spark, {2: hosted(rng, p), 4: hosted(rng, []) + "\n" + line, 5: line, 6: hosted(rng, p, q), 7: hosted(rng, q)})
    assert [i for i in sorted(out) if line in out[i]] == [4] and [i for i in sorted(out) if " ".join(q) in out[i]] == [6]
    assert sorted(rows) == sorted([
        (2, "passage", 27, 36, 2, True), (4, "paragraph", 54, 36, 2, False), (5, "paragraph", 0, 36, 2, True),
        (6, "passage", 27, 36, 2, True), (6, "passage", 90, 27, 6, False), (7, "passage", 27, 27, 6, True),
    ])
    alone, _ = found_in(spark, {4: line, 5: line, 6: hosted(rng, p)})
    assert (6, "passage", 27, 36, 4, True) in alone and len(alone) == 3


def test_passages_of_odd_tables(spark):
    df = odd_docs(spark)
    found = paragraph_dedup.repeated_passages(df)
    assert found.count() == 0 and paragraph_dedup.repeated_passages(df.limit(0)).count() == 0
    again = df.unionByName(df.where("doc_id = 8").withColumn("doc_id", F.lit(80).cast("long")))
    assert {(r[0], r[4], r[5]) for r in rows_of(paragraph_dedup.repeated_passages(again))} == {(8, 8, False), (80, 8, True)}
    out = paragraph_dedup.without_repeats(again)
    assert out.columns == df.columns and out.count() == 12 and out.where("doc_id = 80").first()["text"] == ""
    assert paragraph_dedup.tune_bands(0.8) == (8, 2)


# all together


@pytest.mark.parametrize("one_task", [0, 250_000])
def test_components_of_chains_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK", one_task)
    rng = random.Random(8)
    ids = list(range(500))
    rng.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(0, 200)] + [(ids[250], ids[i]) for i in range(251, 400)] + [(7, 7)]
    got = dict(rows_of(common.components(spark.createDataFrame(edges, "src long, dst long"))))
    want = brute.components(range(500), edges)
    assert got == {i: want[i] for i in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_pipeline(spark):
    import corpus_pipeline

    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, SMALL))
        if name != "byte_bpe":
            assert docs.columns == source.columns
        if name == "ngram_jaccard_join":
            want = brute.jaccard_components(rows_of(before.select("doc_id", "text")), 5, 80)
            assert sorted(i for (i,) in rows_of(docs.select("doc_id"))) == sorted(i for i, (_, c) in want.items() if c == i)
        if name == "pii":
            assert docs.count() == before.count() and not any(brute.personal(t) for (t,) in rows_of(docs.select("text")))
    assert docs.where("not round_trip").count() == 0
    again = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))
    empty = source.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert os.path.exists(public_tokenizers.path(queries.VOCABULARY))


def test_the_trees_of_personal_data_see_the_candidates_of_all_documents(spark, monkeypatch):
    """More candidates than the trees once were fitted on at most (4,000), a fifth of them credentials by their names."""
    seen, write = [], pii.written
    monkeypatch.setattr(pii, "written", lambda df: seen.append(write(df)) or seen[-1])
    docs = spark.range(4_500).selectExpr(
        "id as doc_id", "concat(if(id % 5 = 0, 'password: ', 'item '), substr(md5(cast(id as string)), 1, 20), 'a1') as text"
    )
    model = pii.fit(docs)
    assert model.trees and seen[0].where("kind = 'secret'").count() == 4_500
