"""Importance resampling, main texts of pages and Merkle manifests against plain versions."""

import hashlib
import html
import math
import random
import zlib
from collections import Counter

import pytest

from linkhop.llm import importance, merkle, text_density
from linkhop.llm.common import numbered, written
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, Bucket int, row string, position int, levels string"


def table(spark, rows):
    """documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(3)


def runs(text, order):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c.isascii() and not c.isalnum():
            words += [word] if word else []
            word = ""
        else:
            word += c
    return words, [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, order=1, buckets=10_000, least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) of each row, sorted."""
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, [d for _, d in docs]), (t, target)):
        for text in texts:
            counts.update(map(place, runs(text, order)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for doc_id, text in docs:
        words, found = runs(text, order)
        weight = sum(gain(place(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(str, (r[:5] for r in out)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_importance(spark, order):
    rng = random.Random(order)
    words = ["the", "The", "a1", "Été", "x-y", "漢字", "of", "IT", "é", "\x7f", "z" * 50]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 19, 20, 21, 60]))) for _ in range(120)] + [None, "", "  ", "the " * 4000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3 + [(None, texts[9]), (None, texts[9]), (3, texts[11])]
    docs += [(500, "the same row of more than twenty words " * 4)] * 60
    target = ["The of it it", None, "été 漢字 of", "the of it"]
    df = table(spark, [(i, t, "a", "en", 1) for i, t in docs])
    got = importance.resample(df, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string"), order=order, buckets=50, percent=30)
    assert sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in got.collect()) == resampled(docs, target, order, 50, 20, 30)


def test_importance_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    rows = importance.resample(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), none).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in rows) == [(1, 2, None), (2, 0, None)]


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), rng.randint(0, 5), i) for i in range(500)]
    df = written(spark.createDataFrame(rows, "g string, v int, row int").repartition(3), "rows")
    got = sorted((r.g, r.position, r.v, r.row) for r in numbered(df, ["g"], [F.col("v").desc(), F.col("row").asc()], "n").collect())
    want = []
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want += [(g, i, r[1], r[2]) for i, r in enumerate(own)]
    assert got == want


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbed(nodes, arity):
    """The root of nodes, and for each the (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, own = [], []
        for i in range(0, len(nodes), arity):
            run = nodes[i : i + arity]
            for j in range(len(run)):
                for k in at[i + j]:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(digest(*run))
            own.append([k for j in range(len(run)) for k in at[i + j]])
        nodes, at = above, own
    return nodes[0], paths


def manifest(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is None, r[0] or 0, leaf(r[0], r[2], r[3], r[4], r[1])))
        inner.append((own, *climbed([leaf(r[0], r[2], r[3], r[4], r[1]) for r in own], arity)))
    root, tops = climbed([i[1] for i in inner], arity)
    out = []
    for (own, subroot, paths), top in zip(inner, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf(r[0], r[2], r[3], r[4] + 1 if changed else r[4], r[1])
            for a, b in path + top:
                fold = digest(a, fold, b)
            out.append((r[0], leaf(r[0], r[2], r[3], r[4], r[1]), subroot, root, digest(*(a + b for a, b in path + top)), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("arity", "height"), [(2, 3), (2, 12), (3, 2)])
def test_merkle(spark, arity, height):
    rng = random.Random(arity * height)
    rows = [(rng.randint(0, 400), rng.choice(["a b", "", None, "é|-", "x" * 9000]), rng.choice(["s", None]), rng.choice(["en"] * 6 + [None, "", "ü", "z", "Z", "fr"]), rng.choice([None, 5, 2**63 - 1])) for _ in range(300)]
    rows += [(None, None, None, None, None)] * 3 + [(9, "same", "s", "en", 4)] * 20 + [(1, "alone", "s", "one", 1)]
    got = merkle.merkle_manifest(table(spark, rows), merkle.every_seventh(F.col("doc_id")), arity, height)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == manifest(rows, arity)


def test_merkle_small(spark):
    one = [(7, "x", "s", None, 1)]
    for rows in ([], one, one + [(8, "y", "s", None, 1)], one + [(8, "y", "s", "en", 1)]):
        got = merkle.merkle_manifest(table(spark, rows), merkle.every_seventh(F.col("doc_id")))
        assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == (manifest(rows) if rows else [])


def page(rng, article, tag):
    """A page with everything around an article that is not part of it."""
    say = lambda n: " ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet,", "elit."], k=n))
    links = "".join(f'<li><a href="/{i}">{say(1)}</a></li>' for i in range(8))
    parts = {
        "menu": f"<nav><ul>{links}</ul></nav>", "header": f'<header><a href="/">{say(2)}</a><p>{say(6)}</p></header>', "ad": f'<div class="ad-slot"><p>{say(12)}</p></div>',
        "notice": f'<div id="cookieNotice" role="alert">{say(9)} <button>OK</button></div>', "form": f"<form><label>{say(2)}</label><input><p>{say(3)}</p></form>",
        "side": f'<aside><h2>{say(2)}</h2><p>{say(20)}</p></aside>', "hidden": f'<p style="display: none">{say(30)}</p>',
    }
    before = "".join(parts[k] for k in rng.sample(sorted(parts), k=rng.randint(0, len(parts))))
    after = f'<section class="comments"><h3>{say(1)}</h3><div class="comment"><p>{say(25)}</p></div></section>' * rng.randint(0, 2) + f"<footer>&copy; {say(5)}</footer>"
    head = f"<!doctype html><html><head><title>{say(5)}</title><style>p > a {{}}</style><script>if (a < b) document.write('<p>x</p>')</script></head>"
    return f"{head}<body><!-- <p>{say(3)}</p> -->{before}<{tag}>{article}</{tag.split()[0]}>{after}</body></html>"


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post-body"', "div"])
def test_main_text(spark, tag):
    rng = random.Random(len(tag))
    words = ["word", "a & b", "x < y", "é", "“q”", "it's", "1.5"]
    pages, want = [], {}
    for i in range(60):
        blocks = [" ".join(rng.choices(words, k=rng.randint(30, 60))) for _ in range(rng.randint(2, 7))]
        blocks.insert(rng.randint(1, len(blocks)), "short.")
        title = " ".join(rng.choices(words, k=5))
        mark = lambda b: html.escape(b, quote=False).replace(" ", rng.choice([" ", "\n  ", " <b> "]), 1)
        closed = rng.choice(["</p>", "</p>\n", ""])
        article = f"<h1>{html.escape(title)}</h1>" + "".join(f"<p>{mark(b)}{closed}" for b in blocks)
        pages.append((i, f"http://x/{i}", page(rng, article, tag), "t"))
        want[i] = "\n".join([title, *blocks])
    pages += [(100, None, None, "t"), (None, "u", "", "t"), (101, "u", "<p>a &lt;b&gt; &am &#233;<p>b\xa0 c<br>d<br/>\n<i>e</i>f", "t"), (102, "u", "<div><ul><li><a>x</a><li><a>y</a></ul></div>", "t")]
    want |= {100: "", None: "", 101: "a <b> &am é\nb c d ef"}
    df = spark.createDataFrame(pages, "page_id long, url string, html string, Text string").repartition(3)
    rows = text_density.page_texts(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert {k: got[k] for k in want} == want
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(pages)


def test_pages_that_grow(spark):
    """Hostile pages take time in line with their length."""
    for source in ("<div>" * 50_000 + "x", "<p>" * 50_000, "<p>" + "<b>" * 20_000 + "<div>" * 20_000 + "x", "<" * 100_000, '<a b="' * 50_000, "<ul><li>" * 20_000 + "x"):
        assert len(text_density.main_text(source)) <= len(source)
    assert text_density.main_text("<article>" + "<p>ab</p>" * 50_000 + "</article>") == "\n".join(["ab"] * 50_000)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert text_density.page_texts(none).collect() == []
