"""Operators 2, 3, 5, 7 and 10, the kernels, and the pipeline."""

import json
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sparkloom.llm import decontaminate, jaccard_join, kernels, packing, quality, quotes, sorted_runs, substring_dedup, url_filter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], DOCS).repartition(3)


# kernels


@pytest.mark.parametrize("member, pattern", [(kernels.ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), (kernels.SPACED, r"[^\x20\x09-\x0D]+")])
def test_words(member, pattern, monkeypatch):
    monkeypatch.setattr(kernels, "SEGMENT_BYTES", 64)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB9z_- \n\té中.!") for _ in range(rng.randint(0, 300))) for _ in range(60)] + [None, "", "x" * 500, "ab", "cd"]
    raw, offsets = kernels.string_buffers(pa.array(texts).slice(3))
    hashes, seen = {}, {}
    for lo, hi in kernels.slices(offsets, 700):
        w = kernels.Words(raw, offsets, lo, hi, member)
        for i in range(hi - lo):
            own = [m[0] for m in re.finditer(pattern, texts[3 + lo + i] or "")]
            assert w.count[i] == len(own)
            for text, h, s, e in zip(own, w.hash[w.begin[i] :], w.start[w.begin[i] :], w.end[w.begin[i] :], strict=False):
                assert bytes(raw[s:e]).decode() == text
                low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
                assert hashes.setdefault(low, h) == h and seen.setdefault(h, low) == low


# packing


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    docs = [(i, " ".join("".join(rng.choice("abcdeé'S.,!9ΣİÅ") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([0, 3, 50, 400, 3000])))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "a <|endoftext|> b"), (5, docs[5][1]), (None, "no id"), (203, "word " * 30_000), (204, "中文 ﬁ ﬂ Ⅷ")]
    got = packing.packed(frame(spark, docs)).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 2])
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for (d, total), own in pieces.items():
        same = [ids for ids in want[d] if len(ids) == total]
        for ids in same[:1]:
            covered = np.zeros(total, int)
            for r in own:
                part = ids[r["start"] : r["start"] + r["length"]]
                assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"] > 0
                covered[r["start"] : r["start"] + r["length"]] += 1
            assert (covered == len(same)).all()
    assert sum(len(x) for v in want.values() for x in v) == sum(r["length"] for r in got)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0  # full or a power of two: no padding


def test_packing_rule_is_sum_of_squares():
    rng, rows = random.Random(3), []
    packer = packing.Packer(0, rows.append, width=16, most_open=10**6)
    counts = np.zeros(17, int)
    for i in range(400):
        size = rng.randint(1, 15)
        best = []
        for h in [0, *np.flatnonzero(counts)]:
            if h + size <= 16:
                after = counts.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 16
                best.append(((after[1:16] ** 2).sum(), -h, after))
        counts = min(best, key=lambda b: b[:2])[2]
        packer.put(i, np.arange(size, dtype="<u4").tobytes())
        assert (packer.count[1:16] == counts[1:16]).all()


def test_packing_pours_only_the_fullest_windows():
    rng, rows = random.Random(3), []
    packer = packing.Packer(0, rows.append, width=64, most_open=40)
    total = poured = 0
    for i in range(3000):
        size, before = rng.randint(1, 63), packer.count.copy()
        packer.put(i, np.arange(size, dtype="<u4").tobytes())
        total += size
        gone = np.maximum(before - packer.count, 0)
        if gone.sum() > 1:  # placing a piece takes one window at most
            poured += 1
            assert packer.open >= 35 and gone.sum() <= 7
        assert packer.open <= 40 and packer.open == packer.count.sum() == sum(len(w) for w in packer.level.values())
    packer.close()
    assert poured and sum(r[2] for r in rows) == total
    sequences = {}
    for r in rows:
        sequences[r[5]] = sequences.get(r[5], 0) + r[2]
    assert all(n <= 64 and n & (n - 1) == 0 for n in sequences.values())


# quality


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = quality.train(docs, labels)
    out = {r["doc_id"]: r for r in quality.scored(docs, weights).collect()}
    assert len(out) == docs.count()
    truth = [(out[r["doc_id"]], r["quality"]) for r in labels.collect()]
    for d, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(r["predicted"], q) for r, q in truth if r["held_out"]]
    assert held and sum(p == q for p, q in held) >= 0.9 * len(held)
    # what is held out is never learned, and neither are other columns
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    other = docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "0 AS n_chars", "1 AS score", "2 AS label").repartition(7)
    assert (quality.train(other, flipped) == weights).all()


def plain_features(text):
    """The classifier's features in plain Python: weight index by value."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    seeds = lambda n, salt: [mix((i + 1) * 0x9E3779B97F4A7C15 + salt & mask) | 1 for i in range(n)]
    raw, s = text.encode(), seeds(6, 900)
    codes, base = seeds(256, 7), seeds(1, 11)[0] & ~7 | 3
    low = lambda b: b + 32 if 65 <= b <= 90 else b
    words = [m[0] for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^\x09-\x0d\x20-\x20\x30-\x39\x41-\x5a\x61-\x7a\x80-\xff]+", raw)]
    hashes = [mix((sum(codes[low(b)] * pow(base, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & mask) for w in words]
    shapes = []
    for i, w in enumerate(words):
        alnum = bool(re.match(rb"[0-9A-Za-z\x80-\xff]", w))
        upper = lambda b: 65 <= b <= 90
        shapes.append((0 if alnum else 1) + 2 * upper(w[0]) + 4 * upper(w[min(1, len(w) - 1)]) + 8 * (i > 0 and hashes[i] == hashes[i - 1]))
    out = []
    for i, h in enumerate(hashes):
        out += [mix(h * s[0] & mask), mix((shapes[i] + 1) * s[3] & mask)]
        if i:
            out += [mix(hashes[i - 1] * s[1] + h * s[2] & mask), mix((shapes[i - 1] + 1) * s[4] + (shapes[i] + 1) * s[5] & mask)]
    held = {}
    for x in out:
        held[x >> 64 - quality.BITS] = held.get(x >> 64 - quality.BITS, 0) + quality.SCALE / len(words)
    return held


def plain_scores(docs, labels, epochs=quality.EPOCHS):
    """Follow-the-regularised-leader and its scores in plain Python."""
    from math import exp, sqrt

    alpha, beta, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    z, n, top = {}, {}, 1 << quality.BITS

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + sqrt(n[i])) / alpha + l2)

    dot = lambda x: sum(weight(i) * v for i, v in x.items())
    learned = [(d, {**plain_features(t or ""), top: 1.0}) for d, t in docs if d in labels]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(learned)):
            d, x = learned[k]
            p, now = 1 / (1 + exp(-dot(x))), {i: weight(i) for i in x}
            for i, v in x.items():
                g, before = (p - labels[d]) * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (sqrt(before + g * g) - sqrt(before)) / alpha * now[i]
                n[i] = before + g * g
    return {d: 1 / (1 + exp(-dot({**plain_features(t or ""), top: 1.0}))) for d, t in docs}


def test_quality_against_plain_python(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    good, bad = "the quick Brown fox, é 12 jumps. over".split(), "BUY BUY now!!! $$$ click -> free".split()
    docs = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(100, None), (101, "Σ é ß"), (102, "a")]
    quality_of = {i: i % 2 for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    place = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = plain_scores(sorted(docs, key=lambda r: (place.get(r[0], 0), r[0])), quality_of)
    got = {r["doc_id"]: r for r in quality.scored(frame(spark, docs), quality.train(frame(spark, docs), labels)).collect()}
    assert len(got) == len(docs)
    for d, score in want.items():
        assert abs(got[d]["score"] - score) < 1e-5 and (abs(score - 0.3) < 1e-4 or got[d]["predicted"] == (score >= 0.3))


def test_quality_sample_is_bounded(spark):
    """Rows that share a doc_id count once; rows and bytes stay within their bounds; empty tables train nothing."""
    rows = [(i % 20, f"text {i} " + "word " * (i % 50)) for i in range(3000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 3, "doc_id bigint, quality int")
    docs = frame(spark, rows)
    every = quality.training_rows(docs, labels, 1000, 1 << 30)
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))
    assert len(quality.training_rows(docs, labels, 10, 1 << 30)) == 10
    size = lambda held: sum(len(r["idx"]) + len(r["val"]) for r in held)
    some = quality.training_rows(docs, labels, 1000, size(every) // 2)
    assert 0 < len(some) < len(every) and size(some) <= size(every) // 2 and some == every[: len(some)]
    assert quality.training_rows(docs, labels, 1000, 10) == [] and not quality.train(docs.limit(0), labels).any() and not quality.train(docs, labels.limit(0)).any()


def test_quality_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "x"), (3, "word " * 20_000), (3, "again")])
    labels = spark.createDataFrame([(2, None), (None, 1)], "doc_id bigint, quality int")
    out = quality.scored(docs, quality.train(docs, labels)).collect()
    assert len(out) == 5 and all(r["score"] == 0.5 for r in out)
    assert quality.keep_good(docs.limit(0), np.zeros((1 << quality.BITS) + 1, np.float32)).count() == 0


# urls


def judge(url, rules=url_filter.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for rule, verdict in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), verdict == "block", rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    rng = random.Random(4)
    hosts = ["example.org", "A.Example.ORG", "org", "xexample.org", "com", "m.x.com", "example.com", "", "a..org", ".org", "net"]
    paths = ["", "/", "/en/1", "/en/12?x", "/es/", "/es", "/fr/x#/de/", "/de/", "?/fr/", "#", "//", "/EN/1"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "://", "no scheme/x", "a://b://c/fr/", "ftp://é.com/fr/ü"]
    pages = spark.createDataFrame([(i, u, "r", "d") for i, u in enumerate(urls)] + [(0, urls[0], "r", "d")], "page_id bigint, url string, rule string, digest string")
    for rules in (url_filter.RULES, (("org/", "allow"), ("org/", "block"), ("m.x.com/", "block"))):
        got = url_filter.judged(pages, rules).collect()
        assert sorted(tuple(r) for r in got if r["rule"]) == sorted((i, *judge(u, rules)) for i, u in [*enumerate(urls), (0, urls[0])] if judge(u, rules)[2])
        assert len(got) == len(urls) + 1
        for r in got:
            assert tuple(r)[1:] == judge(urls[r["page_id"]], rules)
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_urls_of_very_many_labels(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "org/x"), (2, "http://org/" + "y" * 1_000_000), (3, "http://" + "." * 100_000 + "/")], "page_id bigint, url string")
    assert {r["page_id"]: r["rule"] for r in url_filter.judged(pages).collect()} == {1: "org/", 2: "org/", 3: None}


def test_more_rules_than_literals(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_LITERAL", 1)
    pages = spark.createDataFrame([(1, "http://x.org/y"), (2, "http://example.org/es/"), (3, None), (4, "http://a.com/de/")], "page_id bigint, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judged(pages).collect()} == {1: ("org/", "allow"), 2: ("example.org/es/", "block"), 3: (None, "allow"), 4: ("com/de/", "block")}
    assert [r["rule"] for r in url_filter.judged(pages, ()).collect()] == [None] * 4


# warc


def test_warc(spark):
    html = '<!DOCTYPE html><html lang="en"><head><title>T &amp; x</title><style>p{}</style></head><body><!-- no --><p>One &lt;b&gt;</p><script>var a="</p>";</script><div>Two <a class="q" href="/x?a=1&amp;b">link</a></div></body></html>'
    pages = spark.createDataFrame([(1, "http://a/b", html, 5), (2, None, None, 5), (3, "u", "", 5), (1, "http://a/b", html, 5), (None, "u", "plain", 5)], "page_id bigint, url string, html string, kind int")
    source = warc.responses(pages)
    out = warc.derivatives(source).collect()
    assert len(out) == 10
    ids = {r["record_id"] for r in source.collect()}
    import hashlib

    for r in out:
        raw = r["block"].encode()
        assert r["refers_to"] in ids and r["record_id"] not in ids
        assert r["block_digest"] == "sha256:" + hashlib.sha256(raw).hexdigest() and r["content_length"] == len(raw)
        head = dict(line.split(": ", 1) for line in r["headers"].split("\r\n")[1:])
        assert head["WARC-Refers-To"] == r["refers_to"] and head["WARC-Type"] == r["kind"] and int(head["Content-Length"]) == len(raw)
    first = {r["kind"]: r for r in out if r["page_id"] == 1}
    assert first["conversion"]["block"] == "One <b>\nTwo link"
    meta = json.loads(first["metadata"]["block"])
    assert meta["links"] == ["/x?a=1&amp;b"] and meta["lang"] == "en" and meta["title"] == "T &amp; x"
    assert meta["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest() and "text/html" in meta["source_headers"]
    assert len({r["record_id"] for r in out}) == 8
    text = warc.record_text(warc.derivatives(source)).first()["value"]
    assert text.startswith("WARC/1.1\r\n") and text.endswith("\r\n\r\n")
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_records_are_whole(spark, tmp_path):
    import hashlib
    import html

    from sparkloom.llm import queries

    texts = ["&copy; 2024 &middot; x", "it&#8217;s &#x27;q&#X27; &#128; &#0; &#xD800; &#99999999999999999999; &#x1F600;", "&amp;lt; &amp;copy; &lt;b&gt;", "a&copy2024 &eacute&Eacute; &unknown; & &; &#; &notin; &ngE;", "&#65279;&#xFFFE;|&hellip;&mdash;", "plain", "&#160;a&nbsp;b"]
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{t}</p>", "x", "y") for i, t in enumerate(texts)] + [(99, None, None, None, None), (98, "http://a/\r\nX: y", "", None, None)], "page_id bigint, url string, html string, record_id string, headers string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    out = queries.op5_warc_derivatives(spark, str(tmp_path)).collect()
    assert len(out) == 2 * len(texts) + 4
    for r in out:
        digest, uri = hashlib.sha256(r["block"].encode()).hexdigest(), r["target_uri"].replace("\r\n", "%0D%0A")
        assert r["headers"].split("\r\n") == [
            "WARC/1.1", f"WARC-Type: {r['kind']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Refers-To: {r['refers_to']}", f"WARC-Refers-To-Target-URI: {uri}", "WARC-Refers-To-Date: 1970-01-01T00:00:00Z",
            f"X-Refers-To-Payload-Digest: {r['source_digest']}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Block-Digest: sha256:{digest}", f"Content-Type: {r['mime']}",
            f"Content-Length: {len(r['block'].encode())}",
        ]
        if r["kind"] == "conversion" and r["page_id"] < 98:
            assert r["block"] == re.sub(r"[ \t\r\f]+", " ", html.unescape(texts[r["page_id"]]).replace("\xa0", " ")).strip(" \n")


def test_warc_texts_against_plain_patterns():
    """Texts, titles, languages and links as backtracking patterns would find them."""
    import html

    drop = re.compile(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>")
    breaks = re.compile(r"(?i)</(?:p|div|li|tr|h[1-6]|section|article|table|ul|ol|title)\s*>|<br\s*/?>")
    bits = ["<script", "</script >", "<style>", "</style>", "<!--", "-->", "<head ", "</head>", "<a ", 'href="x"', 'HREF="', '"', ">", "<p>", "</p>", "<br/>", "<html ", 'lang="', 'lang="en"', "title", "<title x>", "</title", " x ", "\n", "&amp;", "&copy", "&#65;", "<", 'xlang="q"']
    rng = random.Random(1)
    for _ in range(5000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        want = re.sub(r"[ \t\r\f]+", " ", html.unescape(re.sub(r"<[^>]*>", " ", breaks.sub("\n", drop.sub(" ", page)))))
        assert warc.page_text(page) == re.sub(r" ?\n[ \n]*", "\n", want).strip(" \n")
        for found, pattern in ((warc.title, r"(?is)<title[^>]*>(.*?)</title"), (warc.language, r'(?i)<html[^>]*\blang="([^"]*)"')):
            m = re.search(pattern, page)
            assert found(page) == (m[1] if m else "")
        assert warc.links(page) == re.findall(r'(?i)<a\b[^>]*?\bhref="([^"]*)"', page)


@pytest.mark.parametrize("bit", ["<script ", "<!--", "</p ", "<", "<a ", '<a href="', '<html lang="', "<html ", "<title", "<title>", "<head><head ", "&#", "&#x", "&#0", "&amp", "&#99999999999", "<br "])
def test_warc_is_linear_in_a_page(bit):
    page = bit * (1_000_000 // len(bit))
    source = {"page_id": 1, "record_id": "r", "target_uri": "u", "date": "d", "http_headers": "h", "payload_digest": "p", "payload": page}
    began = time.perf_counter()
    assert len(list(warc._records(source))) == 2 and time.perf_counter() - began < 5


# quotations


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nThanks in advance."),
        (1, 1, "assistant", "> How do I sort  a LIST?\n> Thanks in advance.\nUse the sorted function."),
        (1, 2, "user", ">> How do I sort a list?\n>> Thanks in advance.\n> Use the sorted function.\nAnd in reverse?"),
        (1, 3, "assistant", "> How do I sort a list?\n> Thanks in advance.\nAs to the first question: it is stable."),
        (2, 0, "user", "> Use the sorted function.\nWhere is this from?"),
        (2, 1, "user", "> nobody ever said this text\nhm"),
        (3, None, "user", None),
        (None, 0, "user", ""),
        (1, 0, "user", "How do I sort a list?\nThanks in advance."),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, level int")
    out = {(r["conv_id"], r["turn"]): r for r in quotes.linked(df).collect()}
    assert len(quotes.linked(df).collect()) == len(rows)
    assert out[1, 1]["parent_turn"] == 0 and out[1, 1]["text"] == "Use the sorted function." and out[1, 1]["linked"]
    assert out[1, 2]["parent_turn"] == 1 and out[1, 2]["max_level"] == 2 and out[1, 2]["n_quoted"] == 2 and out[1, 2]["text"] == "And in reverse?"
    assert out[1, 3]["parent_turn"] == 0 and out[1, 3]["linked"]
    assert out[2, 0]["foreign_conv"] == 1 and not out[2, 0]["linked"]
    assert out[2, 1]["parent_turn"] == 0 and out[2, 1]["foreign_conv"] is None
    assert out[3, None]["text"] == ""
    assert quotes.linked(df.limit(0)).count() == 0


def test_quotes_of_parts(spark):
    """Trimmed quotes, inline answers, blank lines without a mark and short messages link."""
    one, two, three = "The first paragraph has\ntwo lines of its own.", "A second paragraph is here.", "And the third ends it."
    rows = [
        (1, 0, f"{one}\n\n{two}\n\n{three}"),
        (1, 1, "Something else altogether.\nThank you very much."),
        (1, 2, f"> {two}\nTrimmed to a paragraph."),
        (1, 3, "> two lines of its own.\nTrimmed to a line."),
        (1, 4, "> The first paragraph has\n> two lines of its own.\nfirst answer\n> A second paragraph is here.\nsecond answer"),
        (1, 5, "> The first paragraph has\n> two lines of its own.\n\n> A second paragraph is here.\n\n> And the third ends it.\nNo marks on blank lines."),
        (1, 6, "Yes."),
        (1, 7, "Another message stands between."),
        (1, 8, "> yes.\nShort, but a whole message."),
        (1, 9, "> And the third ends it.\n> [...] cut\n> A second paragraph is here.\n> Thank you very much.\nMost of it is from turn 0."),
        (2, 0, f"> {three}\nQuoted from elsewhere."),
        (2, 1, "> Yes.\nToo short to be foreign."),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    out = {(r["conv_id"], r["turn"]): r for r in quotes.linked(df).collect()}
    assert len(out) == len(rows)
    assert {t: out[1, t]["parent_turn"] for t in (2, 3, 4, 5, 8, 9)} == {2: 0, 3: 0, 4: 0, 5: 0, 8: 6, 9: 0}
    assert all(out[1, t]["linked"] for t in (2, 3, 4, 5, 8, 9)) and not out[1, 7]["linked"]
    assert out[2, 0]["foreign_conv"] == 1 and not out[2, 0]["linked"] and out[2, 1]["foreign_conv"] is None


def test_quotes_of_very_long_lines(spark):
    rows = [(1, 0, "a message that is answered"), (1, 1, ">" * 1_000_000 + " a message that is answered"), (1, 2, " " * 1_000_000 + "> a message that is answered\nyes"), (1, 3, "> line\n" * 50_000 + "end"), (1, 4, "x" * 2_000_000)]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    out = {r["turn"]: r for r in quotes.linked(df).collect()}
    assert out[1]["max_level"] == 1_000_000 and out[1]["parent_turn"] == 0 and out[1]["linked"]
    assert out[2]["linked"] and out[2]["text"] == "yes" and out[3]["n_quoted"] == 1 and out[4]["text"] == "x" * 2_000_000
    assert [out[t]["position"] for t in range(5)] == [1, 2, 3, 4, 5]


def test_quotes_in_one_large_conversation(spark):
    """Places, turns before and quotations where one conversation holds most rows, and one has no id."""
    rows = [(None if i % 7 == 0 else 5, i, "user", f"message number {i}" if i % 3 else f"> message number {i - 8}\nanswer") for i in range(600)] + [(5, None, "user", "no turn"), (5, 1, "user", "message number 1")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    got = {}
    for r in quotes.linked(df).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append(r)
    for conv in (None, 5):
        own = sorted((t for c, t, _, _ in rows if c == conv), key=lambda t: (t is not None, t or 0))
        places = sorted((p["position"], t is not None, t or 0) for (c, t), held in got.items() if c == conv for p in held)
        assert [p for p, _, _ in places] == list(range(1, len(own) + 1)) and sorted((a, t) for _, a, t in places) == [(t is not None, t or 0) for t in own]
        at = {t: p["position"] for (c, t), held in got.items() if c == conv and len(held) == 1 for p in held}
        assert all(at[t] > at[p["parent_turn"]] for (c, t), held in got.items() if c == conv and t in at for p in held if p["parent_turn"] is not None and p["parent_turn"] in at)
    said = {(c, x): t for c, t, _, x in rows if x.startswith("message")}
    for c, t, _, x in rows:
        if x.startswith(">"):
            want = said.get((c, x[2:].split("\n")[0]))
            assert all(r["linked"] == (want is not None) and (want is None or r["parent_turn"] == want) for r in got[c, t])


def test_reply_order(spark):
    """Conversations read depth first, against a plain walk of the tree."""
    rng = random.Random(12)
    rows, parent = [], {}
    for conv in [None, *range(25)]:
        for turn in range(rng.choice([1, 2, 6, 15, 40])):
            quotes_ = turn > 1 and rng.random() < 0.4
            back = rng.randint(0, turn - 1) if quotes_ else turn - 1
            parent[conv, turn] = back
            head = f"> message {conv} number {back} of all\n" if quotes_ else ""
            rows.append((conv, turn, "user", f"{head}message {conv} number {turn} of all"))
    want = {}
    for conv in {c for c, _ in parent}:
        kids, order = {}, []
        for (c, t), p in sorted(parent.items(), key=lambda x: (str(x[0][0]), x[0][1])):
            if c == conv and t:
                kids.setdefault(p, []).append(t)
        walk = [0]
        while walk:
            t = walk.pop()
            order.append(t)
            walk += sorted(kids.get(t, []), reverse=True)
        want |= {(conv, t): i for i, t in enumerate(order, 1)}
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = quotes.linked(df).collect()
    assert {(r["conv_id"], r["turn"]): r["position"] for r in got} == want and len(got) == len(rows)
    assert {(r["conv_id"], r["turn"]): r["parent_turn"] for r in got if r["turn"]} == {k: p for k, p in parent.items() if k[1]}
    assert any(want[k] != k[1] + 1 for k in want)


def test_quotes_against_sql(spark, tmp_path):
    """The operator and its SQL on conversations full of quotations: whole, parts, nested, foreign, repeated, without ids."""
    import duckdb

    from sparkloom.llm.oracles import ORACLES

    rng = random.Random(21)
    said = [f"{rng.choice(['A', 'Some', 'one'])} remark {i % 23} about {rng.choice('xyz')}" for i in range(60)] + ["Yes.", "no", ""]
    rows = []
    for conv in [None, 1, 2, 3, 4, 5]:
        earlier = []
        for turn in range(14):
            own = "\n\n".join("\n".join(rng.sample(said, rng.randint(1, 3))) for _ in range(rng.randint(1, 2)))
            text = own
            if rng.random() < 0.6:
                lines = (rng.choice(earlier) if earlier and rng.random() < 0.7 else own).split("\n")
                cut = lines[rng.randrange(len(lines)) :] if rng.random() < 0.4 else lines
                mark = rng.choice(["> ", ">", ">> ", " > "])
                text = "\n".join(mark + x if x or rng.random() < 0.5 else x for x in cut) + "\n" + rng.choice(said)
            earlier.append(own)
            rows.append((conv, None if turn == 0 and conv == 4 else turn, rng.choice(["user", "assistant"]), text))
    rows += [rows[5], rows[5], (9, 0, None, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    cursor = con.execute(ORACLES["op2_quotation_linking"])
    names = [c[0] for c in cursor.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(r[n] for n in names) for r in quotes.linked(spark.read.parquet(str(tmp_path / "c"))).collect()), key=key)
    assert got == want and sum(r[names.index("linked")] for r in got) > 10 and any(r[names.index("foreign_conv")] is not None for r in got)


def test_places_and_last_values(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3]), rng.randint(0, 50), rng.choice([None, rng.randint(0, 9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, at bigint, v bigint")
    want, held = {}, {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0])):
        n, last = held.get(k, (0, None))
        want[i] = (n + 1, last)
        held[k] = (n + 1, last if v is None else v)
    for parts in ("1", "4", "60"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {r["id"]: (r["place"], r["last"]) for r in sorted_runs.numbered(df, ["k"], ["at", "id"], "v").collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted_runs.numbered(df.limit(0), ["k"], ["at", "id"], "v").count() == 0


# pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "contamination", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        if name == "packing":
            tokens = {r["doc_id"]: r["doc_tokens"] for r in out.collect()}
            assert set(tokens) == {r["doc_id"] for r in now.select("doc_id").collect()}
            break
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (now, out))
        if name == "quality":
            score = {r["doc_id"]: r["predicted"] for r in quality.scored(now, quality.train(now, labels)).collect()}
            assert after == {d: t for d, t in before.items() if score[d]}
        elif name == "near_duplicates":
            assert set(after) == {r["component_id"] for r in jaccard_join.report(now).collect()}
        elif name == "repeated_passages":
            changed = {r["doc_id"] for r in substring_dedup.repeated_spans(now).collect()}
            assert {d for d in before if after.get(d) != before[d]} == changed
        else:
            bad = {r["doc_id"] for r in decontaminate.hits(now, items).where("contaminated").collect()}
            assert set(before) - set(after) == bad
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
    ran = {r["doc_id"]: r["doc_tokens"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert ran == tokens


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, repeated and null ids; and an empty table."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 900)) + rng.choice(["", "", ".", ","]) for _ in range(n))
    rows = [(i, text(rng.randint(20, 90)), "en", "s", 1) for i in range(30)]
    rows += [(40, None, None, None, None), (41, "", None, None, None), (None, text(40), None, None, None), (None, None, None, None, None), (42, text(60_000), "en", "s", 1)]
    rows += [rows[3], rows[3], (43, rows[5][1], "de", None, 7), (6, "another text " + text(30), "en", "s", 1), (44, " \n\t", "en", "s", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(30)] + [(None, 1, None), (5, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, text(15)), (2, None), (None, "x y z")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            path = str(tmp_path / f"{name}-{empty}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() == 0) == empty
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
