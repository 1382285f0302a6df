from __future__ import annotations

import base64
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from wellpanel.llm import nn_descent as ND
from wellpanel.llm import topk_nra as TK
from wellpanel.llm import url_templates as UT
from wellpanel.llm import warc_zstd as WZ

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), i % 3) for i in range(180)]
    rows += [(200 + k, (np.array(rows[k][1]) + rng.normal(size=16) * 0.01).astype(np.float32).tolist(), k % 3) for k in range(30)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 1), (302, rows[0][1], None), (350, rows[0][1], 0), (350, rows[0][1], 0)]
    rows += [(400, None, 0), (401, [None] + [1.0] * 15, 0), (402, [float("nan")] * 16, 0), (403, [float("inf")] + [1.0] * 15, 0), (404, [0.0] * 16, 0)]
    rows += [(405, [], 0), (450, [1.0, 2.0], 0), (451, [2.0, 4.0], 0), (None, rows[1][1], 1)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), VECTORS).select("*", *[F.lit("x").alias(c) for c in ("score", "rank", "id", "vec", "a", "b", "copies", "shard")]).repartition(4).cache()


def fits(e):
    return e is not None and all(x is not None and np.isfinite(x) for x in e)


def test_top_k_equals_brute_force(table, spark):
    rows = {i: np.floor(256 * np.array(e, np.float64)) for i, e, _ in vectors() if i is not None and fits(e)}
    want = set()
    for q in rows:
        if q % 50 == 0:
            scores = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in TK.search(table).collect()} == want
    assert TK.search(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("scale", [1, 10**6, 10**12, 10**17])
def test_bounds_never_lose_a_candidate(scale):
    rng = np.random.default_rng(scale % 97)
    x, q = rng.integers(-9, 9, (300, 12)).astype(float) * scale, rng.integers(-9, 9, (7, 12)).astype(float) * scale
    ids, asked = np.arange(300), np.array([0, 5, 900, 901, 902, 903, 904])
    found = TK.top_k(ids, x, asked, q, 4)
    for j, query in enumerate(asked):
        exact = [(-max(TK.LONG.min, min(TK.LONG.max, sum(int(a) * int(b) for a, b in zip(x[i], q[j])))), i) for i in ids if i != query]
        assert [(i, s) for f, i, s in found if f == query] == [(i, -s) for s, i in sorted(exact)[:4]]


def brute_links(rows):
    ok = {i: (np.array(e, np.float64), label) for i, e, label in rows if i is not None and label is not None and fits(e) and np.linalg.norm(e) > 0}
    links = {i: set() for i in ok}
    for a, (x, la) in ok.items():
        for b, (y, lb) in ok.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].add(b)
    out = {}
    for i, *_ in rows:
        if i is not None:
            seen, todo = {i}, [i]
            while todo:
                for y in links.get(todo.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            out[i] = (len(links.get(i, ())), min(seen))
    return out


def test_near_vectors_equal_brute_force(table, spark):
    found = ND.near_duplicates(table).collect()
    assert len(found) == table.count()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id is not None} == brute_links(vectors())
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert ND.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_saturated_lists_are_compared_exactly(spark, monkeypatch):
    """A crowd far larger than the longest list, with members at and beyond its rim."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=24)
    rows = [(i, (centre + rng.normal(size=24) * rng.uniform(0.02, 0.2)).astype(np.float32).tolist(), 1) for i in range(320)]
    rows += [(1000 + i, rng.normal(size=24).astype(np.float32).tolist(), 1) for i in range(150)]
    found = ND.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_links(rows)


PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(2)
    rows = [(i, f"HTTP://Sub.Example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}{rng.choice(['', '.html', '/', '?q=/de/'])}", f"<p>{'text ' * (i % 9)}{i % 40}</p>") for i in range(120)]
    rows += [(200, None, None), (201, "no scheme", ""), (202, "http://org", "x" * 300_000), (203, "http://ORG/", None), (204, "x://notorg/a\nb", "<p>é\U0001f642</p>")]
    rows += [(205, "http://example.org?x=/es/", "x" * 300_000), (206, "http://example.org/es/#a", "dup"), (206, "http://example.org/es/#a", "dup"), (None, "http://com/fr/1", "dup"), (207, "://", "dup")]
    return rows


@pytest.fixture(scope="module")
def web(spark):
    return spark.createDataFrame(pages(), PAGES).select("*", *[F.lit("x").alias(c) for c in ("host", "path", "key", "bad", "digest", "size", "newest", "template")]).repartition(3).cache()


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, quality int")


def plain_rule(host, path):
    best = None
    for verdict, h, p in UT.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def test_url_rules_and_parts(web, marks, spark):
    found = UT.judge(web, marks).collect()
    assert len(found) == len(pages())
    urls = {}
    for i, url, _ in pages():
        urls.setdefault(i, plain_parse(url))
    for r in found:
        assert (r.host, r.path) == urls[r.page_id]
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")
    assert UT.judge(spark.createDataFrame([], PAGES), marks).count() == 0


def test_impure_templates_are_rejected(spark):
    rows = [(i, f"http://h.net/{'spam' if i % 2 else 'blog'}/{i}") for i in range(400)] + [(1000 + i, f"http://h.net/misc{i}/x") for i in range(30)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(0, 300)], "doc_id long, quality int")
    found = UT.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {(r.template, r.verdict) for r in found if r.page_id < 400} == {("/spam/*", "block"), ("/blog/*", "allow")}
    assert {r.template for r in found if r.page_id >= 1000} == {"/*/*"}


def plain_templates(pages):
    """Template of every (segments, bad) of one host, by a recursive tree."""
    out = [None] * len(pages)

    def alike(x, y):
        (m, b), (n, c) = x, y
        return (b * n - c * m) ** 2 * (m + n) <= UT.DIFFERS * m * n * (b + c) * (m + n - b - c)

    def grow(rows, level, template):
        here = [i for i in rows if len(pages[i][0]) > level]
        for i in set(rows) - set(here):
            out[i] = template
        children, pooled = {}, [0, 0]
        for i in here:
            marked, bad = children.setdefault(pages[i][0][level], [[], [0, 0]])[1], pages[i][1]
            children[pages[i][0][level]][0].append(i)
            for t in (marked, pooled):
                t[0] += bad is not None
                t[1] += bad or 0
        (pm, pb), steps = pooled, {}
        for literal, (found, (m, b)) in children.items():
            if len(found) >= UT.SUPPORT and (b * pm - m * pb) ** 2 > UT.DIFFERS * m * pb * (pm - pb):
                steps.setdefault(b * UT.STEPS // m, []).append(literal)
        branches = []
        for _, literals in sorted(steps.items()):
            m, b = (sum(children[x][1][k] for x in literals) for k in (0, 1))
            if branches and alike(branches[-1][1], (m, b)):
                branches[-1][0].extend(literals)
                branches[-1][1] = (branches[-1][1][0] + m, branches[-1][1][1] + b)
            else:
                branches.append([list(literals), (m, b)])
        left = set(children) - {x for literals, _ in branches for x in literals}
        for literals in [*[x for x, _ in branches], left]:
            name = "*" if literals is left else literals[0] if len(literals) == 1 else "{" + min(literals) + "|*}"
            if literals:
                grow([i for x in literals for i in children[x][0]], level + 1, f"{template}/{name}")

    grow(range(len(pages)), 0, "")
    return out


def test_alike_siblings_are_one_branch(spark):
    """A random tree of hosts against a plain one; sections of like purity share a branch and what lies below it."""
    rng = random.Random(11)
    rows, marks = [], {}
    for host in ("a.net", "b.net", "c.net"):
        bad_share = {s: rng.choice([0.02, 0.05, 0.5, 0.9, 0.97]) for s in "spam junk casino blog news wiki".split()}
        below = {s: rng.choice([-0.5, 0.0, 0.5]) for s in ("old", "new", "top", "low")}
        for _ in range(1500):
            i, s, t = len(rows), rng.choice(list(bad_share)), rng.choice(list(below))
            s = s if rng.random() < 0.97 else f"rare{'xyz'[rng.randint(0, 2)] * rng.randint(1, 60)}"
            if rng.random() < 0.8:
                marks[i] = int(rng.random() >= min(1, max(0, bad_share.get(s, 0.3) + below[t])))
            rows.append((i, host, [s, t, "{n}"][: rng.choice([1, 3, 3, 3, 3])]))
    urls = [(i, f"http://{h}/" + "/".join(str(i) if s == "{n}" else s for s in segs) + ("" if len(segs) > 2 else f"?{i}")) for i, h, segs in rows]
    # only paths that end with the number carry a label
    marked = {i: 1 - q for i, q in marks.items() if len(rows[i][2]) > 2}
    want = {}
    for host in ("a.net", "b.net", "c.net"):
        own = [(i, segs) for i, h, segs in rows if h == host]
        want |= dict(zip([i for i, _ in own], plain_templates([(segs, marked.get(i)) for i, segs in own])))
    labels = spark.createDataFrame(sorted(marks.items()), "doc_id long, quality int")
    judged = UT.judge(spark.createDataFrame(urls, "page_id long, url string").repartition(5), labels).collect()
    assert {r.page_id: r.template for r in judged} == want
    db = duckdb.connect()
    db.register("pages", pd.DataFrame(urls, columns=["page_id", "url"]))
    db.register("labels", pd.DataFrame(sorted(marks.items()), columns=["doc_id", "quality"]))
    by_sql = db.sql(f"SELECT page_id, template, verdict FROM ({UT.SQL})").fetchall()
    assert sorted(by_sql) == sorted((r.page_id, r.template, r.verdict) for r in judged)
    assert {v for _, _, v in by_sql} == {"allow", "block"}
    first, second = ({t.split("/")[k] for t in want.values() if t.count("/") >= k} for k in (1, 2))
    assert any("|*}" in x for x in first) and any("|*}" in x for x in second)
    assert any(x.isalpha() for x in first | second)


def test_archives_round_trip(web, spark, tmp_path):
    by_payload = {}
    for i, _, html in pages():
        by_payload.setdefault(html or "", []).append(i)
    want = []
    for i, _, html in pages():
        data = (html or "").encode()
        newest = max((x for x in by_payload[html or ""] if x is not None), default=None)
        refers = newest if i != newest else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert sorted(map(str, (tuple(r) for r in WZ.round_trip(web).collect()))) == sorted(map(str, want))
    assert WZ.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    path = str(tmp_path / "warc")
    WZ.write_archives(web, path, least_bytes=4)
    back = {(r.page_id, r.record_type): r for r in WZ.read_archives(spark, path, payload=True).collect()}
    assert back[206, "response"].payload == b"dup" and back[207, "response"].refers_to is None
    assert back[202, "revisit"].refers_to == 205 and back[202, "revisit"].payload is None and back[204, "response"].payload == "<p>é\U0001f642</p>".encode()
    # any Zstandard reader passes over the frames between records
    archive = next((tmp_path / "warc").glob("part-*")).read_bytes()
    kinds = [magic for magic, _ in WZ.frames(memoryview(archive))]
    assert kinds[0] == WZ.DICTIONARY_MAGIC and set(kinds[1:]) == {WZ.FRAME_MAGIC, WZ.SKIPPABLE_MAGIC}


def test_damaged_archives_are_refused():
    good = WZ.record(1, "u", b"payload", None)
    assert WZ.parse(good)[1].endswith(b"payload")
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good + b"x", b""):
        with pytest.raises(ValueError):
            WZ.parse(bad)
    lead = WZ.struct.pack("<II", WZ.DICTIONARY_MAGIC, 0)
    frame = zstandard.ZstdCompressor(write_content_size=True).compress
    assert len(list(WZ.read_archive(lead + frame(good)))) == 1
    for archive in (lead + frame(good)[:-3], lead + frame(good.replace(b"payload", b"pay_oad")), b"junk" + lead):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(WZ.read_archive(archive))


def other_writer(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.0", *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def other_records() -> list[tuple[bytes, tuple, bytes | None]]:
    """Records as other programs write them, with the row and payload they stand for."""
    def sha(payload):
        return base64.b32encode(hashlib.sha1(payload).digest()).decode()

    body = b"<p>caf\xc3\xa9</p>" * 40
    common = {"WARC-Date": "2024-01-01T00:00:00Z"}
    http = b"HTTP/1.1 200 OK\r\nserver:x\r\ncontent-length:%d\r\n\r\n" % len(body) + body
    return [
        (other_writer({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:1>", "Content-Type": "application/warc-fields", **common}, b"software: x\r\n"),
         (None, None, 13, sha(b"software: x\r\n"), "warcinfo", None, "<urn:uuid:1>"), b"software: x\r\n"),
        (other_writer({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:2>", "WARC-Target-URI": "http://a/", "Content-Type": "application/http;msgtype=response", **common}, http),
         (None, "http://a/", len(body), sha(body), "response", None, "<urn:uuid:2>"), body),
        (other_writer({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:3>", "WARC-Payload-Digest": "sha256:abc", "Content-Type": "application/http", **common}, b"HTTP/1.1 200 OK\r\n\r\n" + body),
         (None, None, len(body), sha(body), "response", None, "<urn:uuid:3>"), body),
        (other_writer({"WARC-Type": "request", "WARC-Record-ID": "<urn:uuid:4>", "Content-Type": "application/http; msgtype=request", **common}, b"GET / HTTP/1.1\r\nhost: a\r\n\r\n"),
         (None, None, 0, sha(b""), "request", None, "<urn:uuid:4>"), b""),
        (other_writer({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:uuid:5>", "WARC-Refers-To": "<urn:uuid:2>", "WARC-Payload-Digest": f"sha1:{sha(body)}", "Content-Type": "application/http", **common}, http[: -len(body)]),
         (None, None, len(body), sha(body), "revisit", None, "<urn:uuid:5>"), None),
        (other_writer({"WARC-Type": "resource", "WARC-Record-ID": "<urn:page:77>", "Content-Type": "text/plain", **common}, b""), (77, None, 0, sha(b""), "resource", None, "<urn:page:77>"), b""),
    ]


def streamed(compressor, data: bytes) -> bytes:
    """A frame written piece by piece, whose header does not tell its size."""
    writer = compressor.compressobj()
    return b"".join(writer.compress(data[k : k + 100]) for k in range(0, len(data), 100)) + writer.flush()


@pytest.mark.parametrize("kind", ["no dictionary", "no size", "streamed", "raw dictionary", "compressed dictionary", "empty dictionary", "padded"])
def test_archives_of_other_writers(spark, tmp_path, kind):
    records = other_records()
    sample = [r[0] + bytes([k]) * (k % 7) for k in range(200) for r in records]
    stored = zstandard.train_dictionary(2048, sample).as_bytes() if "dictionary" in kind and kind not in ("no dictionary", "empty dictionary") else b""
    trained = zstandard.ZstdCompressionDict(stored) if stored else None
    one = zstandard.ZstdCompressor(dict_data=trained, write_content_size=kind != "no size", write_checksum=kind == "padded")
    lead = {"compressed dictionary": zstandard.ZstdCompressor().compress(stored), "raw dictionary": stored, "empty dictionary": b""}.get(kind)
    out = WZ.struct.pack("<II", WZ.DICTIONARY_MAGIC, len(lead)) + lead if lead is not None else b""
    pad = WZ.struct.pack("<II", WZ.SKIPPABLE_MAGIC + 3, 5) + b"later" if kind == "padded" else b""
    out += b"".join((streamed(one, r) if kind == "streamed" else one.compress(r)) + pad for r, _, _ in records)
    assert list(WZ.read_archive(out)) == [(row, payload) for _, row, payload in records]
    (tmp_path / "a.warc.zst").write_bytes(out)
    found = WZ.read_archives(spark, str(tmp_path / "a.warc.zst"), payload=True).collect()
    assert sorted(str((*r[:-1], None if r[-1] is None else bytes(r[-1]))) for r in found) == sorted(str((*row, payload)) for _, row, payload in records)


def test_frames_that_need_an_absent_dictionary_are_refused():
    record = other_records()[1][0]
    trained = zstandard.train_dictionary(1024, [record + bytes([k]) * k for k in range(100)])
    with pytest.raises(ValueError):
        list(WZ.read_archive(zstandard.ZstdCompressor(dict_data=trained).compress(record)))
