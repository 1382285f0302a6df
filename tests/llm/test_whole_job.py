"""Cases in which less than the whole job would show."""

from __future__ import annotations

import random
from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_text_operators import DOCS, shingle_set
from tests.llm.test_vectors_and_pages import VECTORS, brute_links
from wellpanel.llm import minhash_hamming as MH
from wellpanel.llm import nn_descent as ND
from wellpanel.llm import url_templates as UT


def brute_kept(rows, percent):
    """Smallest ids of the components of all pairs at ``percent`` or more."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(i) for i in sets})


def edited_pairs(n=40):
    """Texts of 100 words, each followed by a copy whose 96 shingles agree at 0.86, 0.81, 0.76 and 0.73."""
    rng = random.Random(12)
    rows = []
    for k in range(n):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(100)]
        edited = list(words)
        for at in [(30, 60), (30, 33, 60), (30, 50, 70), (1, 50)][k % 4]:
            edited[at] = f"e{k}x{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    return rows


def test_stage_takes_near_duplicates_from_080(spark):
    rows = edited_pairs()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    want = brute_kept(rows, 80)
    assert len(want) < len(brute_kept(rows, 85)) < len(rows)
    assert sorted(r.doc_id for r in C.one_of_each_group(spark, docs, "").collect()) == want
    assert sorted(r.doc_id for r in MH.keep_one(docs, percent=85).collect()) == brute_kept(rows, 85)


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_few_true_pairs_are_left_unconfirmed(percent):
    p = 1 - percent / 100
    lost = [sum(comb(MH.LENGTH, k) * p**k * (1 - p) ** (MH.LENGTH - k) for k in range(d + 1, MH.LENGTH + 1)) for d in range(MH.LENGTH)]
    assert lost[MH.farthest(percent)] < MH.LOST <= lost[MH.farthest(percent) - 1]


def test_pairs_within_the_promised_distance_are_confirmed():
    """15 of the indexed values and all others differ: 39 of 64, still within the promise."""
    a = np.arange(MH.LENGTH, dtype=np.uint16)
    b = a + 1000
    agree = [c * MH.CHUNK + k for c in range(MH.CHUNKS) for k in range(MH.CHUNK)][MH.GUARANTEED :]
    b[agree] = a[agree]
    slot = next(s for s in range(MH.INDEXED) if (MH.slots(a[None]) == MH.slots(b[None]))[0, s])
    cell = pd.DataFrame({"bucket": 1, "slot": slot, "i": 0, "j": 0, "block": 0, "rep": [1, 2], "n_shingles": 10, "signature": [a.tobytes(), b.tobytes()]})
    found = [x for part in MH._near_pairs(cell, 85) for x in zip(*part)]
    assert len(found) == 1 and found[0][2] == MH.LENGTH - MH.INDEXED + MH.GUARANTEED


def test_missing_links_are_completed_exactly(spark, monkeypatch):
    """Where descents find no neighbour at all, every link is still returned."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist(), 1) for i in range(150)]
    rows += [(500 + i, (np.array(rows[i][1]) + rng.normal(size=16) * 0.02).tolist(), 1) for i in range(3)]
    monkeypatch.setattr(ND, "_windows", lambda keep: lambda batches: iter(()))
    found = ND.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    want = brute_links(rows)
    assert sum(n for n, _ in want.values()) >= 6
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want


def test_bad_sections_below_the_third_segment(spark):
    rows = [(i, f"http://h.net/a/b/c/{'spam' if i % 2 else 'blog'}/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://h.net/a/b/c/d{i % 40}/e/f/g/x") for i in range(40)] + [(2000, "http://h.net/a/b/c")]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(300)], "doc_id long, quality int")
    found = UT.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert len(found) == len(rows)
    assert {(r.template, r.verdict) for r in found if r.page_id < 400} == {("/*/*/*/spam/*", "block"), ("/*/*/*/blog/*", "allow")}
    assert {r.template for r in found if 1000 <= r.page_id < 2000} == {"/*/*/*/*/*/*/*/*"}
    assert {r.template for r in found if r.page_id == 2000} == {"/*/*/*"}


ODD_NAMES = [
    "a.b", "q`r", "row", "key", "name", "times", "whole", "cut", "n_shingles", "component_id", "kept", "own_id", "place", "of", "fresh", "unkept",
    "__text__", "__score__", "__lang__", "__sure__", "__times__", "__source__", "__whole__", "__cut__", "__copy__", "label", "turn", "s1", "of_source",
]


def odd_docs(spark):
    rng = random.Random(4)
    texts = [" ".join(f"der{rng.randint(0, 400)}en" for _ in range(60)) for _ in range(12)]
    rows = [(i, texts[i % 10], "de", f"s{i % 3}", 0) for i in range(30)] + [(3, texts[11], "de", None, 0), (None, texts[10], None, "s1", 0), (40, None, "de", "s1", 0)]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(k).alias(c) for k, c in enumerate(ODD_NAMES)]).repartition(3)


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_of_any_name(spark, tmp_path, stage):
    docs = odd_docs(spark)
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found, want = (C.STAGES[stage][1](spark, d, str(tmp_path)) for d in (docs, plain))
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    if stage < 4:
        assert found.columns == docs.columns
        assert {tuple(r)[5:] for r in found.collect()} == {tuple(range(len(ODD_NAMES)))}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near = a.replace("a7 ", "changed ")
    rows = [(1, a), (1, b), (2, c), (3, b), (4, near), (4, c), (None, a), (5, None), (5, ""), (6, a), (6, a)]
    for width in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(width)
        kept = MH.keep_one(docs, percent=70)
        assert sorted(r.text or "" for r in kept.filter("doc_id is not null").collect() if r.text) in ([a, b, c], sorted([near, b, c]))
        assert kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 5").count() == 1
        found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in MH.near_duplicates(docs, 70).collect()}
        assert found == {(1, 36, 1, True), (2, 36, 2, True), (3, 36, 1, False), (4, 36, 1, False), (4, 36, 2, False), (None, 36, None, True), (5, 0, 5, True), (6, 36, 1, False)}
    plain = spark.createDataFrame([(1, a), (1, b), (2, c)], "doc_id long, text string")
    assert sorted(r.text for r in MH.keep_one(plain).collect()) == [a, b, c]


def test_negative_zero_is_zero(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, -0.0], 0), (3, [1.0, 0.001], 0), (4, [-0.0, -0.0], 0)]
    for width in (1, 2, 4):
        found = ND.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(width)).collect()
        assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found} == {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)}
