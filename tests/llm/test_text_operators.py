from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellpanel.llm import bpe_tree as B
from wellpanel.llm import language_hypervectors as LH
from wellpanel.llm import minhash_hamming as MH
from wellpanel.llm import quality_ftrl as QF
from wellpanel.llm import source_mixing as SM
from wellpanel.llm import toxic_crf as TC
from wellpanel.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the and ing ion her tha", "de": "der sch ung ein ich ver", "fr": "les que eau ont ais eux"}


def prose(rng: random.Random, lang: str, n: int) -> str:
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(3)
    rows = [(i, prose(rng, lang, rng.randint(20, 120) if i else 100), lang, f"s{i % 4}", 0) for i in range(60) for lang in [("en", "de", "fr")[i % 3]]]
    words = rows[0][1].split()
    rows += [(100 + k, " ".join(words[:k] + ["changed"] + words[k + 1 :]), "en", "s0", 0) for k in (3, 4, len(words) - 1)]
    rows += [(200, rows[5][1], "fr", None, 0), (201, rows[5][1].upper(), "fr", "s1", 0), (201, rows[5][1].upper(), "fr", "s1", 0)]
    rows += [(300, None, "en", "s2", 0), (301, "", "en", "s2", 0), (302, " \t\n", None, None, 0), (303, "one two", "en", "s3", 0), (304, "ONE two", "en", "s3", 0)]
    rows += [(None, "one two", "en", "s3", 0), (305, prose(rng, "en", 9000), "en", "s1", 0), (306, "12 34 %%% !!", "en", "s1", 0), (307, "x" * 5000, None, "s2", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    clashing = ["size", "key", "score", "component", "label", "rep", "slots", "row", "part", "kept", "signature", "turn", "target", "place"]
    return spark.createDataFrame(corpus(), DOCS).select("*", *[F.lit("x").alias(c) for c in clashing]).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 != 1), int(i % 7 == 0)) for i in range(60)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(docs):
    found = MH.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    want = brute_components([(r[0], r[1]) for r in corpus()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert want[201] == (want[5][0], 5) and want[304][1] == 303 and want[103][1] == want[104][1] == want[199][1] == 0


def test_large_group_of_edited_copies(spark):
    """Copies of one text with edits of their own, far more than a block, found as brute force finds them."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(700):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(0, 4)):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    found = {r.doc_id: r.component_id for r in MH.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert found == {i: c for i, (_, c) in brute_components(rows).items()}


def test_signature_join_guarantee():
    """Signatures within the guaranteed distance share a slot, wherever the errors are."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, MH.LENGTH), dtype=np.uint16)
        b = a.copy()
        b[0, rng.choice(MH.INDEXED, MH.GUARANTEED, replace=False)] ^= 1
        assert (MH.slots(a) == MH.slots(b)).any()


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (1, 0)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_keeps_one_row(docs):
    kept = MH.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = brute_components([(r[0], r[1]) for r in corpus()])
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()}) and ids.count(None) == 1


def test_mixing_meets_targets(docs, spark, nothing):
    rows = SM.mix(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in corpus()}
    assert len(rows) == docs.count() and all(r.size == size[r.doc_id] for r in rows if r.doc_id is not None)
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    for (source_size, target), own in by.items():
        assert sum(r.size for r in own) == source_size and target <= 2 * source_size + 1e-9
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    again = SM.mix(docs.repartition(2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert SM.mix(nothing).count() == 0
    copies = SM.repeat_documents(docs.filter("doc_id is not null and doc_id <> 201"))
    counted = {r.doc_id: r.n for r in copies.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    planned = {r.doc_id: r.taken // r.size for r in SM.mix(docs.filter("doc_id is not null and doc_id <> 201")).collect() if r.size}
    assert copies.columns == docs.columns and all(counted.get(i, 0) == n for i, n in planned.items())


def brute_targets(sizes, weights, budget):
    capped = set()
    while True:
        left = budget - sum(2 * sizes[k] for k in capped)
        open_ = [k for k in sizes if k not in capped]
        level = left / sum(weights[k] for k in open_) if open_ else 0
        above = {k for k in open_ if weights[k] * level > 2 * sizes[k]}
        if not above:
            return {k: 2 * sizes[k] if k in capped else weights[k] * level for k in sizes}
        capped |= above


def test_water_fill_redistributes_until_feasible(spark):
    sizes = {f"a{k}": s for k, s in enumerate([1000, 10, 10, 40, 5000, 3, 0])}
    rows = [(k, " ".join("w" * 1 for _ in range(n)), None, name, 0) for k, (name, n) in enumerate(sizes.items())]
    weights = {name: (5, 2, 1)[k % 3] for k, name in enumerate(sorted(sizes))}
    want = brute_targets(sizes, weights, 1.5 * sum(sizes.values()))
    found = SM.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert {rows[r.doc_id][3]: r.target for r in found} == pytest.approx(want)


@pytest.fixture(scope="module")
def tree():
    pytest.importorskip("tiktoken")
    path, pattern = B.public_encoding()
    return B.Tree(B.read_ranks(path), pattern)


@pytest.fixture(scope="module")
def reference_encoding(tree):
    import tiktoken

    path, pattern = B.public_encoding()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.read_ranks(path), special_tokens={})


ODD = ["a", " ", "  ", "\n", "'", "'re", "'ll", "s", "é", "日", "🙂", "1", "22", "!!", "the", " and", "\u2003", "\x1c", "\u200b", "\xa0", "aaaa", "\r\n", "\x00", "İ"]


@pytest.mark.parametrize("leaf", [1, 2, 7, 40])
def test_tree_encoding_equals_whole_encoding(tree, reference_encoding, monkeypatch, leaf):
    monkeypatch.setattr(B, "LEAF", leaf)
    monkeypatch.setattr(B, "MATCH_LEAF", 16)
    rng = random.Random(leaf)
    for _ in range(300):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 120)))
        tree.known.clear()
        ids = tree.many([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == reference_encoding.encode_ordinary(text), text
        assert tree.decode(ids) == text.encode()


def test_long_matches_join_by_tokens(tree, reference_encoding, monkeypatch):
    monkeypatch.setattr(B, "MATCH_LEAF", 3)
    rng = random.Random(4)
    for alphabet in ("ab", "etaoin", "the"):
        text = "".join(rng.choice(alphabet) for _ in range(1500))
        assert tree.known.merger.encode(text.encode()) == reference_encoding.encode_ordinary(text)


def test_documents_are_encoded_whole(docs, nothing, reference_encoding):
    for spread in (B.SPREAD, 500):
        found = B.encode_documents(docs, *B.public_encoding(), spread=spread).collect()
        assert len(found) == docs.count()
        texts = {i: t or "" for i, t, *_ in corpus()}
        for r in found:
            text = texts[r.doc_id] if r.doc_id is not None else "one two"
            ids = np.array(reference_encoding.encode_ordinary(text), "<u4").tobytes()
            assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert B.encode_documents(nothing, *B.public_encoding()).count() == 0


def test_languages(docs, nothing):
    found = {r.doc_id: r for r in LH.languages(docs).collect()}
    truth = {i: lang for i, _, lang, *_ in corpus() if i is not None and i < 60}
    held = [i for i in truth if found[i].held_out]
    assert held and all(found[i].lang_pred == truth[i] for i in held)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (300, 301, 302, 306))
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = LH.keep_known(docs)
    assert kept.columns == docs.columns and {300, 301, 302, 306}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == docs.count() - 4
    assert LH.languages(nothing).count() == 0
    unknown = LH.languages(docs.withColumn("lang", F.lit(None).cast("string")).filter("doc_id < 3")).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_trigram_table_equals_bundles():
    """Table look-ups give the dot products that whole bundles give."""
    base = LH.vectors(256)
    rng = np.random.default_rng(2)
    codes = rng.integers(0, LH.CODES, 50)
    prototype = LH.bind(rng.integers(0, LH.CODES, 500), base).sum(axis=0, keepdims=True).astype(np.float64)
    scores = LH.trigram_scores(prototype, base)[0]
    bundle = LH.bind(codes, base).sum(axis=0).astype(np.float64)
    assert scores[codes].sum() == pytest.approx(bundle @ prototype[0] / np.linalg.norm(prototype), rel=1e-4)


def quality_rows():
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = prose(rng, "en", 60)
        rows.append((i, text.replace(" ", "%%% ") if bad else text, "en", "s", 0))
        marks.append((i, int(not bad), int(i % 6 == 0)))
        if marks[-1][2]:
            words = rows[-1][1].split()
            rows[-1] = (i, " ".join(words[:30] + ["nastyword"] + words[30:]), "en", "s", 0)
    return rows, marks


def test_quality_learns_and_holds_out(spark, docs, nothing, labels):
    rows, marks = quality_rows()
    lab = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(rows, DOCS)
    found = QF.quality(table, lab).collect()
    truth = {i: q for i, q, _ in marks}
    held = [r for r in found if r.held_out]
    assert 20 < len(held) < 100 and all(r.predicted == truth[r.doc_id] for r in held)
    # labels of held-out rows change nothing
    flipped = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in QF.quality(table, flipped).collect()} == {r.doc_id: r.score for r in found}
    kept = QF.keep_good(docs, labels)
    assert kept.columns == docs.columns
    scores = QF.quality(docs, labels).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    by_id = {r.doc_id: r.score for r in scores}
    assert by_id[300] == by_id[301] == by_id[302]
    assert QF.quality(nothing, labels).count() == 0
    assert {r.score for r in QF.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_learns_words_and_offsets(spark, docs, nothing, labels):
    rows, marks = quality_rows()
    lab = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = TC.toxicity(spark.createDataFrame(rows, DOCS), lab).collect()
    truth, texts = {i: t for i, _, t in marks}, {i: t for i, t, *_ in rows}
    assert all(r.predicted == truth[r.doc_id] for r in found if r.held_out)
    assert all(texts[r.doc_id][s.start : s.end] == "nastyword" for r in found if r.held_out for s in r.spans)
    odd = TC.toxicity(docs, labels).collect()
    assert len(odd) == docs.count() and {r.score for r in odd if r.doc_id in (300, 301, 302)} == {0.0}
    assert TC.toxicity(nothing, labels).count() == 0
    assert all(r.predicted == 0 for r in TC.toxicity(docs, labels.limit(0)).collect())


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(6)
    emission, transitions = rng.normal(size=9) * 2, rng.normal(size=(3, 2))
    first = np.array([1, 0, 0, 0, 1, 0, 0, 0, 0], bool)
    p, expected = TC.marginals(emission, first, transitions)
    want, moves = np.zeros(9), np.zeros((3, 2))
    for a, b in ((0, 4), (4, 9)):
        total, on, pair = 0.0, np.zeros(b - a), np.zeros((3, 2))
        for bits in range(1 << (b - a)):
            y = [bits >> k & 1 for k in range(b - a)]
            w = np.exp(sum(emission[a + k] * y[k] + transitions[y[k - 1] if k else 2, y[k]] for k in range(b - a)))
            total += w
            on += w * np.array(y)
            for k in range(b - a):
                pair[y[k - 1] if k else 2, y[k]] += w
        want[a:b], moves = on / total, moves + pair / total
    assert p == pytest.approx(want) and expected == pytest.approx(moves)
    long = np.tile(emission, 500)
    q, _ = TC.marginals(long, np.tile(first, 500), transitions)
    assert q.reshape(500, 9) == pytest.approx(np.tile(want, (500, 1)))
