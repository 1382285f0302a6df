from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wellpanel.llm import pca_filtering as PF
from wellpanel.llm import pivotal_grams as PG
from wellpanel.llm import private_spans as PS

DOCS = "doc_id long, text string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
CLASHING = ["word", "n", "near", "run", "h", "id", "spans", "start", "lead", "rest", "cluster", "a.b", "q`r"]


def extra(df):
    """The table with columns whose names the operators use themselves, or that need quoting."""
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


# spelling variants


def variant_docs() -> list[tuple]:
    rng = random.Random(7)
    stems = ["".join(rng.choice("aeinrstéüß") for _ in range(rng.randint(6, 10))) for _ in range(40)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.15)), 39)]
            if rng.random() < 0.2:
                k, c = rng.randrange(len(w) + 1), rng.choice("aeinrst")
                w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.05 else w)
        rows.append((i, rng.choice([" ", ", ", " 7 "]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, "12 34 %%"), (None, "abcdefg abcdefg abcdefh"), (1003, "abcdefg" * 900), (5, rows[5][1]), (5, rows[5][1])]
    # a chain of forms: 2 < 20 < 200
    rows += [(2000 + k, "Àbcdefghi " * 200 + "Àbcdefghj " * 20 + "Àbcdefgkj " * 2) for k in (0,)]
    return rows


def brute_variants(rows):
    counts: dict[str, int] = {}
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    beside: dict[str, list[str]] = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if abs(len(a) - len(b)) <= 1 and near(a, b):
            beside[a].append(b)
            beside[b].append(a)
    best = {w: min(found, key=lambda v: (-counts[v], v.encode())) for w, found in beside.items() if found}
    form = {w: best[w] if w in best and counts[best[w]] >= 10 * counts[w] else None for w in counts}
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(beside[w]), counts[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(spark):
    rows = variant_docs()
    found = PG.spelling_variants(extra(spark.createDataFrame(rows, DOCS).repartition(3))).collect()
    want = brute_variants(rows)
    assert len(found) == len(want) and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == want
    assert any(form and root != form for _, form, root, *_ in want)  # chains are there


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, "short words only")], [(1, "lonelyword")]):
        assert PG.spelling_variants(spark.createDataFrame(rows, DOCS)).count() == 0


def test_pivots_are_disjoint_least_and_meet_every_near_word():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(7, 9))) for _ in range(1500)})
    grams: dict[str, int] = {}
    for w in words:
        for i in range(len(w) - 1):
            grams[w[i : i + 2]] = grams.get(w[i : i + 2], 0) + 1
    letters, vocabulary = PG.letter_counts(grams), set(words)
    rows = list(next(PG._indexer(grams, letters)(iter([pd.DataFrame({"word": words, "n": 2})]))).itertuples(index=False))
    listed: dict[tuple, set] = {}
    for r in rows:
        if not r.pivot:
            listed.setdefault((r.left, r.part, r.length), set()).add(r.word)
    met = {(r.word, other) for r in rows if r.pivot for other in listed.get((r.left, r.part, r.length), ())}
    for w in words:
        first, second = PG.pivots(w, PG.gram_prefix(w, grams), grams, letters)
        assert first + 2 <= second
        for k in range(len(w) + 1):
            for v in [w[:k] + c + w[k:] for c in "abcd"] + [w[:k] + c + w[k + 1 :] for c in "abcd"] + [w[:k] + w[k + 1 :]]:
                if v != w and v in vocabulary:
                    assert (w, v) in met or (v, w) in met


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def test_plain_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    for _ in range(6000):
        text = "".join(rng.choice(["a", "b.", "@", "@", ".", "-", "+", "1", "23", "4111", "1111", "255", "300", " ", "  ", "(", ")", "é", "_", "\n", "0"]) for _ in range(rng.randint(1, 40)))
        assert [s[:3] for s in PS.find(text) if s[3]] == brute_base(text), text


WORDS_OF = {lang: words.split() for lang, words in PS.SPELLED.items()}


def test_disguised_spans_map_back_to_the_source():
    """Identifiers disguised in many ways inside prose come back with the offsets of what was written."""
    rng = random.Random(11)
    prose = "the heat at onthia und der kopf, la une voix. Por que no están él über nd. ".split(" ")
    look = {b: a for a, b in zip(PS.LOOK, PS.READ) if b.islower()}
    wide = {c: chr(ord(c) + 0xFEE0) for c in "0123456789@."}
    for turn in range(1500):
        host = ["mail%d" % rng.randrange(99), "example", rng.choice(["com", "org", "net"])]
        name = "".join(rng.choice("abcdxyz") for _ in range(5)) + f".{rng.randrange(10, 99)}"
        lang = rng.choice(list(WORDS_OF))
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        digits += next(c for c in "0123456789" if PS.luhn(digits + c))
        phone = "1" + "".join(rng.choice("0123456789") for _ in range(10))
        ip = [str(rng.randrange(256)) for _ in range(4)]
        say = lambda s: rng.choice([" ", "-"]).join(WORDS_OF[lang][int(c)] for c in s)
        dot = rng.choice([" dot ", "[.]", " [dot] ", "(dot)", " punto ", " DOT "])
        kind, shown = rng.choice([
            ("email", name + rng.choice([" at ", " [at] ", "(at)", " AT ", " arroba ", " {at} "]) + dot.join(host)),
            ("email", name + rng.choice(["[at]", " (at) ", " at ", " [@] "]) + ".".join(host)),
            ("email", name + "@" + host[0] + dot + host[1] + dot + host[2]),
            ("email", "".join(look.get(c, c) for c in name) + "@" + ".".join(host)),
            ("email", "".join(wide.get(c, c) for c in name + "@" + ".".join(host))),
            ("email", name + "​@" + ".​".join(host)),
            ("ip", dot.join(ip)), ("ip", dot.join(say(p) for p in ip)), ("ip", "．".join(ip)),
            ("card", say(digits)), ("card", "".join(wide[c] for c in digits)), ("card", "–".join(digits[k : k + 4] for k in (0, 4, 8, 12))),
            ("card", digits[:8] + " " + say(digits[8:])), ("phone", "+" + say(phone)), ("phone", "plus " + say(phone)), ("phone", "+１ " + phone[1:4] + " " + phone[4:]),
        ])
        before, after = " ".join(rng.choices(prose, k=12)) + " — ", " — " + " ".join(rng.choices(prose, k=12))
        text = before + shown + after
        hit = (kind, len(before), len(before) + len(shown))
        assert hit in [s[:3] for s in PS.find(text)], (text, PS.find(text))
        assert any(PS.pc.match_substring_regex(PS.pa.array([text]), p)[0].as_py() for p in (PS.DISGUISED, PS.homoglyphs()[1]))
        assert [s for s in PS.find(before + after)] == []


@pytest.mark.parametrize("text", [
    "find us at example.com", "look at the dot com bubble", "me@example.com point final", "polka dot me@example.com", "one two. At the end one, two",
    "plus 10 000 000", "un point important, deux points", "4381893557741609 one two", "version 2 dot 0", "вопрос о цене", "3 l of milk", "john @ example.com",
])
def test_clean_text_gains_nothing(text):
    assert [s for s in PS.find(text) if not s[3]] == []


def test_private_spans_of_a_table(spark):
    rows = [(1, "a.b@c.de and \U0001f642 x9 [at] mail [dot] com, +1 (988) 555-2485"), (2, None), (3, ""), (None, "1.2.3.4"), (3, "1.2.3.4"), (3, "1.2.3.4"), (4, "x" * 200_000 + " " + "9" * 100_000 + " @" * 20_000)]
    found = PS.private_spans(extra(spark.createDataFrame(rows, DOCS).repartition(3))).collect()
    assert sorted(map(str, ((r.doc_id, [tuple(s) for s in r.spans]) for r in found))) == sorted(map(str, ((i, PS.find(t or "")) for i, t in rows)))
    assert PS.private_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_private_digest_columns(spark, tmp_path):
    text = "a.b@c.de and x9 [at] mail [dot] com from 1.2.3.4 or +1 (988) 555-2485"
    rows = [(1, text), (2, None), (3, "nothing")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in PS.op12_private_spans(spark, str(tmp_path)).collect()}
    shown = {k: f"{k.split('_')[0]}:{text.index(v)}:{text.index(v) + len(v)}" for k, v in {"email": "a.b@c.de", "email_2": "x9 [at] mail [dot] com", "ip": "1.2.3.4", "phone": "+1 (988) 555-2485"}.items()}
    assert found[1].spans == ",".join(shown.values()) and (found[1].n_email, found[1].n_ip, found[1].n_card, found[1].n_phone) == (2, 1, 0, 1)
    assert found[1].base_sha256 == hashlib.sha256(",".join([shown["email"], shown["ip"], shown["phone"]]).encode()).hexdigest()
    assert found[2].spans == found[3].spans == "" and found[2].base_sha256 == hashlib.sha256(b"").hexdigest()


# centroids

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_clusters(rows, rounds=10, scale=1024):
    kept = [(i, [int(np.floor(np.float64(scale) * np.float64(np.float32(x)))) if abs(x) < 2**30 else int(np.float32(x)) * scale for x in e]) for i, e, _ in rows
            if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", e) for i, e in kept)
    centroids = [list(e) for _, _, e in order[:8]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(e, c)), n) for n, c in enumerate(centroids)) for _, e in kept]

    for _ in range(rounds):
        own = assign()
        for n in range(len(centroids)):
            members = [e for (_, e), (_, k) in zip(kept, own) if k == n]
            if members:
                centroids[n] = [sum(col) // len(members) for col in zip(*members)]
    own, hold = assign(), lambda d: min(d, 2**63 - 1)
    whole = hold(sum(d for d, _ in own))
    inertia = {n: hold(sum(d for d, k in own if k == n)) for _, n in own}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(str((i, n, hold(d), inertia[n], whole, digest[n])) for (i, _), (d, n) in zip(kept, own))


def vector_rows(count=260, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(11, 64))
    rows = [(i, (centres[i % 11] + rng.normal(size=64) * 0.3).astype(np.float32).tolist(), 0) for i in range(count)]
    rows += [(900, rows[3][1], 1), (901, rows[3][1], 1), (5, rows[5][1], None), (5, rows[9][1], None), (None, rows[7][1], 2)]
    rows += [(910, None, 0), (911, [None] + [0.5] * 63, 0), (912, [float("nan")] * 64, 0), (913, [float("inf")] * 64, 0), (914, [0.5] * 63, 0), (915, [], 0), (916, [0.0] * 64, 0), (917, [-0.0] * 64, 0)]
    return rows


@pytest.mark.parametrize("rows, rounds", [
    (vector_rows(), 10), (vector_rows()[:5], 2), ([(7, [0.25] * 64, 0)], 1), ([(k, [0.5] * 64, 0) for k in range(30)], 2),
    (vector_rows(40) + [(2000, [1e30] * 64, 0), (2001, [-3e12] + [0.25] * 63, 0)], 3),
], ids=["many", "few", "one", "equal", "huge"])
def test_clusters_equal_brute_force(spark, rows, rounds):
    found = PF.cluster(extra(spark.createDataFrame(rows, VECTORS).repartition(3)), rounds=rounds).collect()
    assert sorted(str((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in found) == brute_clusters(rows, rounds)


def test_clusters_of_nothing(spark):
    assert PF.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    assert PF.cluster(spark.createDataFrame([(1, [0.5], 0)], VECTORS)).count() == 0


def test_bounds_keep_the_nearest_and_drop_the_rest():
    rng = np.random.default_rng(2)
    x = rng.integers(-900, 900, (2000, 64)) + 4000 * np.eye(8, 64, dtype=np.int64)[np.arange(2000) % 8]
    rotation = np.linalg.qr(rng.normal(size=(64, 16)))[0]
    centroids = x[:8].copy()
    cluster, distance, verified = PF.nearest(x, *PF.rotated(x, rotation), centroids, rotation)
    exact = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and verified <= 8 * len(x)
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:16].T
    assert PF.nearest(x, *PF.rotated(x, axes), centroids, axes)[2] < 0.5 * verified
