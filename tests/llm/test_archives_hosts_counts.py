"""Archives, link walks and text counts against plain versions of them."""

import base64
import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pytest

from pagewarden.llm import linkgraph, quality, warc


def archived(rows):
    """The contract row by row: bytes, digest, type and reference."""
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    groups = collections.defaultdict(list)
    for i, payload in payloads:
        groups[payload].append(i)
    out = []
    for i, payload in payloads:
        largest = max(groups[payload])
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest) + (("response", None) if i == largest else ("revisit", largest)))
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_round_trip_is_the_contract(spark, kind):
    rng = random.Random(8)
    bodies = [None, "", "a", "é\r\n\r\nb", "x" * 300_000, "WARC/1.1\r\n\r\n"]
    ids = list(range(120)) if kind == "long" else [f"{i}" for i in range(110)] + [
        "", " ", "a\r\nContent-Length: 3", "<urn:page:1>", "100% é", "%41", ">", "a b ", "\t", "urn:no-page"]
    rows = [(i, "http://a/", rng.choice(bodies) if n % 3 else f"own {n}") for n, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, f"page_id {kind}, url string, html string").repartition(5)
    got = warc.round_trip(pages).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == archived(rows)


def test_archives_of_other_writers(spark, tmp_path):
    def member(kind, number, block, *more):
        head = ["WARC/1.0", f"warc-type: {kind}", f"WARC-Record-ID: <urn:uuid:{number}>", *more, f"content-length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = "grüße".encode() * 30_000
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    for name in ("one", "two"):
        (tmp_path / f"{name}.warc.gz").write_bytes(
            member("warcinfo", f"{name}-0", b"software: x\r\n")
            + member("request", f"{name}-1", b"GET / HTTP/1.1\r\n\r\n")
            + member("response", f"{name}-2", http + body, "WARC-Target-URI: http://a/?q", f"WARC-Payload-Digest: sha1:{warc.digest(body)}")
            + member("response", f"{name}-3", http + b"short", "WARC-Target-URI: http://b/", f"WARC-Payload-Digest: sha1:{warc.digest(body)}")
        )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"file://{tmp_path}")
    got = {r.page_id: r for r in warc.read_archives(files).collect()}
    assert set(got) == {f"urn:uuid:{n}-{k}" for n in ("one", "two") for k in (2, 3)}
    whole, broken = got["urn:uuid:one-2"], got["urn:uuid:two-3"]
    assert whole.payload == body and whole.digest_ok and whole.url == "http://a/?q"
    assert broken.payload == b"short" and not broken.digest_ok


def test_walks_are_those_of_a_matrix(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.net" for i in range(12)]
    edges = {(rng.choice(hosts), rng.choice(hosts)): float(rng.randint(1, 5)) for _ in range(40)}
    seeds = [("trust", "h0.net", 3.0), ("trust", "h1.net", 1.0), ("distrust", "h2.net", 2.0)]
    want = {}
    for kind in ("trust", "distrust"):
        step = np.zeros((12, 12))
        for (a, b), weight in edges.items():
            a, b = hosts.index(a), hosts.index(b)
            step[(a, b) if kind == "trust" else (b, a)] += weight
        step /= np.maximum(step.sum(axis=1, keepdims=True), 1e-300)
        start = np.array([sum(w for k, s, w in seeds if (k, s) == (kind, h)) for h in hosts])
        score = start = start / start.sum()
        for _ in range(linkgraph.ROUNDS):
            score = linkgraph.DAMPING * score @ step + (1 - linkgraph.DAMPING) * start
        want.update({(kind, h): s for h, s in zip(hosts, score) if s > 0})
    table = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    given = spark.createDataFrame(seeds, "kind string, host string, weight double")
    got = linkgraph.propagate(table, given, linkgraph.scratch(spark)).collect()
    assert {(r.kind, r.host): r.score for r in got if r.score > 0} == pytest.approx(want)


def test_rules_are_those_of_a_loop(spark):
    rng = random.Random(6)
    hosts = ["example.org", "A.Example.ORG", "notexample.org", "org", "x.com", "com", "xcom", "b.net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/a#b", "/de/", "/ES/"]
    urls = [rng.choice(["http://", "https://", "HTTP://", "", "x:/"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(300)] + [None, "a://b://c/d"]

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r, _ in linkgraph.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        return host, path, max(fits, key=len) if fits else None

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = pages.select("page_id", linkgraph.host_of(pages.url).alias("host"), linkgraph.path_of(pages.url).alias("path"))
    got = rows.withColumn("rule", linkgraph.rule_of(rows.host, rows.path)).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in got} == dict(enumerate(map(plain, urls)))


def counted(text):
    blank = " \t\n\x0b\x0c\r"
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if line.strip(blank)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again)


def test_counts_are_those_of_a_loop():
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choices(["a", "b", "é ", " ", "\n", "\t", "#", "<", "a b c ", "x\x0b", "\u00a0", "\r\n", "😀"], k=rng.randint(0, 60)))
        assert quality.measure(text)[:5] == counted(text)
    assert quality.measure(None)[:5] == counted(None)
    long = "a b c d " * 100_000
    assert quality.measure(long)[:5] == counted(long)
