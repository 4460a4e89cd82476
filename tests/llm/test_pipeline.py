import hashlib
import os
import random
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from linkhop.llm.ngram_join import ngram_components
from linkhop.llm import mixing, pii
from linkhop.llm.quality import quality_scores
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    good = {r.doc_id for r in quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    single = corpus_pipeline.near_duplicate_stage(spark, kept, SF)
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in ngram_components(kept).collect()}
    masked = corpus_pipeline.pii_stage(spark, single, SF)
    assert masked.count() == single.count() and masked.columns == corpus_pipeline.COLUMNS
    mixed = corpus_pipeline.mixing_stage(spark, masked, SF)
    assert mixed.count() > 0 and mixed.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.encoding_stage(spark, mixed, SF).count() == mixed.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "encoding"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, a third of the rows equal, near copies and clashing columns: each stage against a plain version of it."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 400)}" for _ in range(n))
    base = say(120)
    near = [" ".join(f"n{i}" if j == 9 * i else w for j, w in enumerate(base.split())) for i in range(5)]
    rows = [(7, base, "en", "hot", 5)] * 60 + [(20 + i, t, None, rng.choice(["hot", "b", None]), None) for i, t in enumerate(near)]
    rows += [(100 + i, say(rng.randint(1, 60)) + rng.choice(["", " a@b.example", " 4111 1111 1111 1111"]), "de", rng.choice(["a", "b", "c", None]), 3) for i in range(60)]
    rows += [(None, None, None, None, None)] * 3 + [(3, "", "en", "a", 0), (None, "", "en", "a", 0), (4, None, "en", "b", 2), (5, "long " * 30_000, "en", "b", 150_000), (6, "e", "en", "c", 1), (6, "e", "en", "c", 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    step = dict(corpus_pipeline.STAGES)
    as_rows = lambda df: Counter(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()))
    order = ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.COLUMNS == order
    # without a positive label all rows stay
    kept = step["quality"](spark, docs.repartition(3), sf)
    assert as_rows(kept) == Counter(rows)
    single = step["near_duplicates"](spark, kept, sf)
    left, groups = Counter(as_rows(single)), []
    for r in rows:
        s = brute.shingles(r[1])
        if not s:
            continue
        mine = [g for g in groups if any(100 * len(s & t) >= 75 * len(s | t) for t, _ in g)]
        groups = [g for g in groups if g not in mine] + [[(s, r), *(m for g in mine for m in g)]]
    firsts = Counter(min((r for _, r in g), key=lambda r: (r[0] is None, r[0] or 0)) for g in groups)
    assert left == firsts + Counter(r for r in rows if not brute.shingles(r[1]))
    masked = step["pii"](spark, single, sf)
    mask = lambda r: (r[0], pii.masked(r[1], pii.spans(r[1] or "")), r[2], r[3])
    want = Counter()
    for r, n in left.items():
        m = mask(r)
        want[(*m, len(m[1]) if r[4] is not None and m[1] is not None else None)] += n
    assert as_rows(masked) == want
    mixed = step["mixing"](spark, masked, sf)
    con = duckdb.connect()
    con.register("d", pd.DataFrame([r for r, n in want.items() for _ in range(n)], columns=order))
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source, n_chars FROM d")
    taken = con.execute(mixing.ORACLE).df()
    got = Counter()
    for r, n in as_rows(mixed).items():
        got[r[3]] += n * len((r[1] or "").split())
    by_source = Counter()
    for s, t in zip(taken["source"], taken["taken"], strict=True):
        by_source[None if pd.isna(s) else s] += int(t)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in by_source.items() if v}
    coded = step["encoding"](spark, mixed, sf).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids for _, t, *_ in as_rows(mixed)}
    plain = Counter()
    for r, n in as_rows(mixed).items():
        packed = b"".join(x.to_bytes(4, "little") for x in ids[r[1]])
        plain[r[0], len(ids[r[1]]), hashlib.sha256(packed).hexdigest()] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in coded) == plain


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert name == "encoding" or out.columns == corpus_pipeline.COLUMNS
