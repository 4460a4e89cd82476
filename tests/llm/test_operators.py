"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkhop.llm import fingerprints as fp
from linkhop.llm import mixing, ngram_join, pii, suffix_dedup
from linkhop.llm.bpe import bpe_decode, bpe_digests, bpe_encode
from linkhop.llm.components import components
from linkhop.llm.quality import held_out, quality_filter, quality_scores
from linkhop.llm.sharding import shard_report
from linkhop.llm.token_counts import token_counts
from linkhop.llm.topk import top_k
from tests.llm import brute

WORD, BYTE = (public_tokenizers.path(p) for p in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, source string, bucket int, n_tokens string, spans int, hash string, part int"


def table(spark, texts, ids=None, sources=None):
    """documents with columns whose names operators use themselves."""
    n = len(texts)
    rows = zip(ids or range(n), texts, sources or ["a"] * n, [1] * n, ["x"] * n, [2] * n, ["h"] * n, [0] * n, strict=True)
    return spark.createDataFrame(list(rows), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    letters = "abcdefghij'stmdrevl  ..!?129\n\tÉéßñ Σσς漢字éİ🙂½²\xa0"
    out = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(150)]
    return [*out, None, "", out[3], "a" * 5000, "ab" * 3000 + "'" * 200, "<|endoftext|>hi<|startoftext|>", "the " * 3000, "it's 'twas we'll ''s"]


def test_token_counts(spark, texts):
    tok = Tokenizer.from_file(WORD)
    tok.no_truncation(), tok.no_padding()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(table(spark, texts), WORD).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)


def test_bpe(spark, texts):
    tok = Tokenizer.from_file(BYTE)
    got = {r.doc_id: tuple(r)[1:] for r in bpe_digests(table(spark, texts), BYTE).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_round_trip(spark, texts):
    df = bpe_decode(bpe_encode(table(spark, texts), BYTE).drop("text"), BYTE)
    assert {r.doc_id: r.text for r in df.select("doc_id", "text").collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_pii(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab@.-+%_019245 ()@.", k=rng.randint(0, 80))) for _ in range(800)]
    texts += [None, "", "1" * 50000 + "a" * 50000 + "@", "4111 1111 1111 1111 a@b.c@d.e 1.2.3.4.5.6.7.8 +49 (0) 30 1234567", "iban DE89 3704 0044 0532 0130 00", "my SSN 123-45-6789", "123-45-6789"]
    got = {r.doc_id: r for r in pii.pii_report(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute.pii_base(t)
        counts = Counter(k for k, *_ in want)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS[:4])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not joined
    assert "iban:5:32" in got[len(texts) - 3].spans and "ssn:7:18" in got[len(texts) - 2].spans and got[len(texts) - 1].spans == ""
    assert pii.masked("x a@b.cc y", pii.spans("x a@b.cc y")) == "x [EMAIL] y" and pii.masked(None, []) is None


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, rng.uniform(-1, 1)]) for _ in range(rng.choice([3, 3, 2]))]) for i in range(300)]
    rows += [(300, None), (301, [0.1, None, 0.2]), (302, [float("nan"), 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (304, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(4)
    import numpy as np

    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    asked = df.where("vec_id % 50 = 0")
    got = {tuple(r) for r in top_k(df, asked, 5).collect()}
    assert got == brute.top_k(plain, [r for r in plain if r[0] is not None and r[0] % 50 == 0], 5)
    few = df.where("vec_id < 3")
    assert top_k(few, few, 5).count() == 6
    assert top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_top_k_stops_early(spark):
    import numpy as np

    from linkhop.llm.topk import entries_read

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(scale=0.05, size=(4000, 16))).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 400 = 0")
    read, entries = entries_read(df, asked, 5, partitions=1).agg(F.sum("read"), F.sum("entries")).head()
    assert 0 < read < 0.8 * entries
    q = np.floor(256 * x).astype(int)
    for r in top_k(df, asked, 5, partitions=1).where("rank = 1").collect():
        s = q @ q[r.query_id]
        s[r.query_id] = s.min() - 1
        assert (r.vec_id, r.score) == (int(s.argmax()), int(s.max()))


def test_top_k_ties_and_large_components(spark):
    rows = [(i, [1.0, 1.0]) for i in range(30)] + [(50, [3e7, 1.0]), (51, [2.0**51, 1.0]), (51, [2.0**51, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [tuple(r) for r in top_k(df, df.where("vec_id in (7, 51)"), 5).where("query_id = 7").orderBy("rank").collect()]
    assert [r[2] for r in got] == [51, 51, 50, 0, 1] and got[3][3] == 2 * 256 * 256 == got[4][3]
    big = [tuple(r) for r in top_k(df, df.where("vec_id = 50"), 5).orderBy("rank").collect()]
    assert big[0] == (50, 1, 51, (1 << 63) - 1) and big[2][2:] == (0, int(3e7) * 256 * 256 + 65536)


def test_ngram_join(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(10):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 20)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [None, "", " \n", "A b", "a B", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(table(spark, texts)).collect()}
    assert got == brute.ngram_components(list(enumerate(texts)))
    kept = ngram_join.one_of_each(table(spark, [*texts, texts[5]], [*range(len(texts)), 5]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})


@pytest.mark.parametrize("tile", [3, 1024])
def test_ngram_links(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", "a b", "A b", "a b"]
    for size in (30, 60, 200, 7, 25):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(rng.randint(2, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts += [" ".join(w)] * rng.choice([1, 1, 3])
    rng.shuffle(texts)
    sets = [brute.shingles(t) for t in texts]
    linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and 100 * len(a & b) >= 75 * len(a | b)}
    rows = {r.doc_id: r for r in ngram_join.ngram_components(table(spark, texts)).collect()}
    assert {i: r.n_links for i, r in rows.items()} == {i: sum(x == i for x, _ in linked) for i in range(len(texts))}
    got = [tuple(r) for r in ngram_join.ngram_links(table(spark, texts)).collect()]
    classes = {tuple(sorted((rows[i].class_id, rows[j].class_id))) for i, j in linked if sets[i] != sets[j]}
    assert sorted(got) == sorted(classes)
    # links inside a component beyond those that span it
    assert len(classes) > len({r.class_id for r in rows.values()} - {None}) - len({r.component_id for r in rows.values() if r.class_id})


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


@pytest.mark.parametrize("group", [128, 2])
def test_repeats(spark, group):
    rng = random.Random(11)
    rnd = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = [rnd(rng.randint(20, 60)) for _ in range(5)]
    texts = []
    for _ in range(50):
        t = rnd(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p, a = rng.choice(shared), rng.randint(0, 10)
            t += p[a : a + rng.randint(20, 60)] + rnd(rng.randint(0, 30))
        texts.append(t)
    texts += [None, "", texts[3], "é" * 50, "a" * 70, "ab" * 40]
    keyed = table(spark, texts).select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "doc_id").alias("k2"))
    spans = {}
    for r in suffix_dedup.repeated_spans(keyed.select("k1", "k2", "text"), 30, 8, group).collect():
        spans.setdefault((r.k1, r.k2), []).append((r["from"], r["to"]))
    for r in keyed.select("doc_id", "k1", "k2").collect():
        merged = suffix_dedup._merged(spans.get((r.k1, r.k2), []))
        assert (sum(b - a for a, b in merged), len(merged)) == brute.repeats(texts, 30)[r.doc_id][1:3]


def test_repeats_report(spark):
    rng = random.Random(2)
    passage = "".join(rng.choices("abc ", k=700))
    texts = ["x" + passage + "y", passage[100:] + "zz", "q" * 399, None, "é" * 500, passage[:300], passage[:300]]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeats_report(table(spark, texts)).collect()}
    assert got == dict(enumerate(brute.repeats(texts, 400)))


def test_shards(spark, texts):
    many = texts * 3
    rows = shard_report(table(spark, many)).collect()
    again = {(r.doc_id, r.shard, r.slot) for r in shard_report(table(spark, many)).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == again
    for r in rows:
        data = (many[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.doc_id for r in rows}) == len(many)


def test_mixing(spark):
    rng = random.Random(8)
    texts = [" ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "one"]
    sources = [rng.choice(["b", "a", "é", None, "big", "big", "big"]) for _ in texts]
    rows = mixing.mix_table(table(spark, texts, sources=sources)).collect()
    names = sorted({s for s in sources if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for t, s in zip(texts, sources, strict=True) if s == n) for n in names]
    want = dict(zip(names, brute.water_levels(sizes), strict=True))
    taken = Counter()
    for r in rows:
        n = len((texts[r.doc_id] or "").split())
        assert r.size == n and r.taken <= 3 * n and r.taken % max(n, 1) == 0
        assert abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in names)
    mixed = mixing.mix(table(spark, texts, sources=sources)).where(mixing.word_count(F.col("text")) > 0)
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size)


def lz_phrases(t):
    out, i = set(), 0
    for j in range(1, len(t) + 1):
        if t[i:j] not in out:
            out.add(t[i:j])
            i = j
    return out


def bottom(t):
    """The least 32-bit hashes of the phrases of t, one by one: a polynomial of the code points, mixed."""
    import numpy as np

    from linkhop.llm.common import mixed

    out = set()
    for p in lz_phrases(t):
        h = 0
        for c in p:
            h = (ord(c) + 1 + 0x9E3779B97F4A7C15 * h) % (1 << 64)
        out.add(int(mixed(np.array([h], np.uint64))[0]) >> 32)
    return sorted(out)[:64]


def likeness_of(a, b):
    union = sorted(set(a) | set(b))[:64]
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


@pytest.mark.parametrize("kind", ["plain", "hot", "large"])
def test_fingerprints(spark, texts, kind):
    rng = random.Random(13)
    if kind == "plain":
        ids = [*range(len(texts) - 2), None, None]
    elif kind == "hot":  # one id holds most of the rows, and has neighbours on both sides
        texts = [*texts[:40], *(f"{i} {rng.random()}" for i in range(200))]
        ids = [*range(20), *range(100, 120), *[50] * 200]
    else:
        texts = [f"{i} {rng.random()}" for i in range(300)]
        ids = [(1 << 60) + i for i in range(300)]
    rows = fp.fingerprint_report(table(spark, texts, ids)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i in ids)
    # rows of one id, or without, may come in any order: what follows an id is one of the next id's rows
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault((i is None, i or 0), []).append(t or "")
    order = sorted(groups)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id is None, r.doc_id or 0), []).append(r)
    edit = lambda t, n: t[: len(t) - len(t) // 4] + n[: len(t) // 4]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for at, key in enumerate(order):
        own, after = groups[key], groups[order[(at + 1) % len(order)]]
        known = {sha(edit(t, n)): (t, n) for t in own for n in [*own, *after]}
        known |= {sha(edit(t, n)): (t, n) for t in own for n in after}
        for r in got[key]:
            t, n = known[r.edited_sha256]
            assert r.n_chars == len(t)
            if len(own) == 1 == len(after):
                assert r.edited_sha256 == sha(edit(t, after[0]))
                mine, edited, following = bottom(t), bottom(edit(t, n)), bottom(n)
                assert r.fingerprint == "".join(f"{h:08x}" for h in mine) and r.edited_fingerprint == "".join(f"{h:08x}" for h in edited)
                assert r.near_edited == likeness_of(mine, edited) and r.near_next == likeness_of(mine, following)
    assert fp.fingerprint_report(table(spark, ["one row"])).head().near_next == 1.0


def test_fingerprints_estimate_phrase_likeness():
    rng = random.Random(6)
    base = "".join(rng.choices("abcdef ", k=3000))
    for cut in (3000, 2500, 1500):
        other = base[:cut] + "".join(rng.choices("uvwxyz ", k=3000 - cut))
        a, b = lz_phrases(base), lz_phrases(other)
        assert abs(fp.likeness(fp.signature(base), fp.signature(other)) - len(a & b) / len(a | b)) < 0.2


def test_quality(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(80)) + "." for _ in range(300)]
    bad = [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(60)]
    texts = [*good, *bad, None, ""]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(360) if i % 2], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, labels).collect()
    assert all((r.held_out, r.predicted) == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2, int(r.score >= 0.7)) for r in rows)
    tried = [r for r in rows if r.held_out and r.doc_id < 360]
    assert all(r.predicted == int(r.doc_id < 300) for r in tried) and all(0 <= r.score <= 1 for r in rows)
    assert quality_filter(docs, labels).where("doc_id < 300").count() == 300
    assert spark.createDataFrame([(None,)], "d long").select(held_out(F.col("d")).alias("h")).head()["h"] is False


def test_prior_from_positives_and_unlabelled():
    import numpy as np

    from linkhop.llm.quality import WIDTH, estimated_prior

    rng = np.random.default_rng(3)
    good = lambda n: rng.normal(1.0, 1.0, (n, WIDTH)).astype(np.float32)
    bad = lambda n: rng.normal(0.0, 1.0, (n, WIDTH)).astype(np.float32)
    for prior in (0.3, 0.6, 0.9):
        n = int(2000 * prior)
        assert abs(estimated_prior(good(2000), np.concatenate([good(n), bad(2000 - n)])[rng.permutation(2000)]) - prior) < 0.08


def test_quality_without_positives(spark):
    docs = table(spark, ["a b", None, ""])
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_filter(docs, labels).count() == 3
    assert {r.score for r in quality_scores(docs, labels).collect()} == {0.5}


def test_context_decides_added_spans():
    near = {k: pii.spans(t) for k, t in {
        "birth": "born on 1987-03-02 in", "date": "built on 1987-03-02 in", "account": "account number 12345678", "number": "about 12345678 of", "secret": 'token = "' + "0f" * 20 + '"', "hash": "0f" * 20,
        "iban": "iban DE89370400440532013000", "serial": "serial DE89370400440532013000", "version": "version 1.2.3.4", "server": "server 1.2.3.4",
    }.items()}
    assert [s[0] for s in near["birth"]] == ["birth"] and [s[0] for s in near["account"]] == ["account"] and [s[0] for s in near["secret"]] == ["secret"]
    assert near["date"] == near["number"] == near["hash"] == near["serial"] == [] and [s[0] for s in near["iban"]] == ["iban"]
    assert near["version"][0][3] == 0.3 and near["server"][0][3] == 0.95


def test_names_that_differ_in_case_only(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, "x", "s", "t"), (2, "d e f", 8, "y", "s", "u")], "doc_id long, text string, Doc_ID int, Text string, source string, SOURCE string")
    labels = spark.createDataFrame([(1, 1, 0, 5)], "doc_id long, quality int, toxic int, Quality int")
    assert pii.pii_report(docs).count() == ngram_join.ngram_components(docs).count() == token_counts(docs, WORD).count() == bpe_digests(docs, BYTE).count() == 2
    assert suffix_dedup.repeats_report(docs).count() == shard_report(docs).count() == mixing.mix_table(docs).count() == fp.fingerprint_report(docs).count() == quality_scores(docs, labels).count() == 2
    for kept in (ngram_join.one_of_each(docs), mixing.mix(docs), pii.pii_masked(docs), quality_filter(docs, labels, threshold=0.0)):
        assert kept.columns == docs.columns
    assert pii.pii_masked(docs).collect()[0][3] in ("x", "y") and bpe_encode(docs, BYTE).count() == fp.fingerprints(docs).count() == 2


def test_repeated_ids_and_rows(spark):
    texts = ["same text here"] * 4 + ["other words a@b.cc", None, None, "x " * 30000]
    ids = [1, 1, 1, 2, 2, None, None, 3]
    docs = table(spark, texts, ids)
    assert sorted(r.doc_id or 0 for r in token_counts(docs, WORD).collect()) == sorted(r.doc_id or 0 for r in bpe_digests(docs, BYTE).collect()) == sorted(i or 0 for i in ids)
    assert sum(r.n_email for r in pii.pii_report(docs).collect()) == 1
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    first, again = ({(r.doc_id, r.score) for r in quality_scores(docs, labels).collect()} for _ in range(2))
    assert first == again and len({s for i, s in first if i == 1}) == 1
    rows = shard_report(docs).collect()
    assert len(rows) == 8 and len({(r.shard, r.slot) for r in rows}) == 8
    taken = mixing.mix_table(docs).collect()
    assert len(taken) == 8 and all(r.taken <= 3 * r.size for r in taken)
    assert {r.n_links for r in ngram_join.ngram_components(docs).collect() if r.doc_id == 1} == {3}


def test_empty_tables(spark):
    none = table(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for rows in (
        token_counts(none, WORD), bpe_digests(none, BYTE), pii.pii_report(none), ngram_join.ngram_components(none), suffix_dedup.repeats_report(none),
        shard_report(none), mixing.mix_table(none), fp.fingerprint_report(none), quality_scores(none, labels),
    ):
        assert rows.count() == 0


def test_equal_rows(spark):
    """Rows equal in id and text next to near copies: spans, links and their number as if each had an id of its own."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 300)}" for _ in range(n))
    base = say(200)
    near = [" ".join(f"z{i}" if j == 7 * i else w for j, w in enumerate(base.split())) for i in range(4)]
    rows = [(1, base)] * 300 + [(10 + i, t) for i, t in enumerate(near)] + [(100 + i, say(40)) for i in range(10)] + [(200 + i, base[:500] + say(9)) for i in range(140)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count, sets = Counter(rows), {t: brute.shingles(t) for _, t in set(rows)}
    links = {t: sum(n for (_, u), n in count.items() if 100 * len(sets[t] & sets[u]) >= 75 * len(sets[t] | sets[u])) - 1 for t in sets}
    got = ngram_join.ngram_components(df).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted((i, links[t]) for i, t in rows)
    assert {r.component_id for r in got if r.doc_id < 100} == {1}
    want = sorted((i, *x) for (i, _), x in zip(rows, brute.repeats([t for _, t in rows], 400), strict=True))
    assert sorted(tuple(r) for r in suffix_dedup.repeats_report(df).collect()) == want
    kept = ngram_join.one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id < 200) == [1, *range(100, 110)]


def test_sharding_of_equal_rows(spark, tmp_path):
    from linkhop.llm.sharding import shard_rows

    rows = [(1, "x" * 90, "a", [1])] * 700 + [(1, "x" * 90, "b", None)] * 300 + [(None, None, None, None)] * 400 + [(i, f"text {i}", "c", [i]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more array<int>").repartition(3)
    got = shard_rows(df, str(tmp_path / "one"), 7, bucket_bytes=4000).collect()
    again = shard_rows(df.repartition(5), str(tmp_path / "two"), 7, bucket_bytes=4000).collect()
    key = lambda r: (r.shard, r.slot)
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(again, key=key)]
    assert Counter((r.doc_id, r.text, r.source, str(r.more)) for r in got) == Counter((a, b, c, str(d)) for a, b, c, d in rows)
    shards = Counter(r.shard for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == 7
    assert all({r.slot for r in got if r.shard == s} == set(range(n)) for s, n in shards.items())
    buckets = Counter(r.bucket for r in got)  # about 28 buckets
    assert max(buckets.values()) < 4 * len(got) / len(buckets)


def test_risk_and_its_steps():
    """The non-negative risk: the fitted network scores positives high and the rest low by the given prior, and a risk below zero is stepped out of."""
    import numpy as np

    from linkhop.llm import quality

    rng = np.random.default_rng(1)
    good = lambda n: np.hstack([rng.normal(1.0, 1, (n, 3)), np.zeros((n, quality.WIDTH - 3))]).astype(np.float32)
    bad = lambda n: np.hstack([rng.normal(-1.0, 1, (n, 3)), np.zeros((n, quality.WIDTH - 3))]).astype(np.float32)
    for share in (0.3, 0.7):
        p, u = good(600), np.concatenate([good(int(1500 * share)), bad(1500 - int(1500 * share))])
        model = quality.fit(p, u, share)
        fresh = np.concatenate([good(500), bad(500)])
        right = (model.score(fresh) >= 0.5) == (np.arange(1000) < 500)
        assert right.mean() > 0.85
        # the loss of unlabelled texts less that of positives, as negatives, is not driven below zero
        of = lambda x: np.logaddexp(0, np.log(model.score(x) / (1 - model.score(x)))).mean()
        assert of(u) - share * of(p) > -0.1
        assert abs(quality.estimated_prior(p, u) - share) < 0.2
