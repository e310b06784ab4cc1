"""Operators 1, 4 and 9 against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import decontaminate, spans, substring_dedup, suffix_dedup

DOCS = "doc_id bigint, text string, start string, text_hash string, __key string, n_chars bigint"


def words(rng, n, size=400):
    return [f"{rng.choice('abcdefghij')}{rng.randint(0, size)}" for _ in range(n)]


def corpus():
    rng = random.Random(3)
    shared = [words(rng, n) for n in (50, 51, 60, 120, 49, 30)]
    docs = []
    for i in range(60):
        body = words(rng, rng.randint(0, 150))
        for p in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = p
        docs.append((i, " ".join(body)))
    docs += [(100, docs[5][1]), (101, docs[7][1].upper()), (102, None), (103, ""), (5, docs[5][1]), (None, docs[9][1]), (104, " ".join(words(rng, 30_000))), (6, "other text under a used id")]
    twice = " ".join(shared[3])
    docs.append((105, f"{twice} between {twice}"))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", "y", "k", len(t or "")) for d, t in docs], DOCS).repartition(3)


def repeated_words(docs, n=50):
    """Covered words by (doc_id, text): windows of n words that occur earlier too."""
    rows = sorted({(-(1 << 63) if d is None else d, t or "") for d, t in docs})
    where = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((d, t, i))
    return where


def test_suffix_array(spark):
    docs = corpus()
    got = suffix_dedup.repeated_passages(frame(spark, docs)).collect()
    hashes = {r["h"]: r["text"] for r in frame(spark, docs).selectExpr("xxhash64(text) AS h", "text").collect()}
    have = {}
    for r in got:
        have.setdefault((r["doc_id"], hashes[r["text_hash"]]), set()).update(range(r["start"], r["end"]))
    by_hash = {t: h for h, t in hashes.items()}
    want = {}
    for places in repeated_words(docs).values():
        ordered = sorted(set(places), key=lambda p: (p[0], by_hash.get(p[1], 0) % (1 << 64), p[2]))
        for d, t, i in ordered[1:]:
            want.setdefault((d, t), set()).update(range(i, i + 50))
    assert have == want
    assert want


def sentences(text):
    """Words and byte bounds of each sentence."""
    raw, out, first = text.encode(), [], 0
    cuts = [m.end() for m in re.finditer(rb"[.!?](?=[ \t\r\n\x0b\x0c])|\n", raw)] + [len(raw)]
    for cut in cuts:
        found = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw[first:cut]))
        if found:
            out.append((tuple(m[0].lower() if m[0].isascii() else m[0] for m in found), first + found[0].start(), cut))
        first = cut
    return out


def test_sentence_spans(spark):
    rng = random.Random(8)
    sents = [" ".join(words(rng, rng.randint(3, 9))) + rng.choice(".!?") for _ in range(80)]
    docs = []
    for i in range(50):
        own = [" ".join(words(rng, rng.randint(2, 9), 10**6)) + "." for _ in range(rng.randint(0, 12))]
        at, k = rng.randint(0, 70), rng.randint(0, 6)
        own[3:3] = sents[at : at + k]
        docs.append((i, rng.choice([" ", "\n"]).join(own)))
    long = " ".join(words(rng, 57))
    docs += [(70 + i, f"{' '.join(words(rng, 20))}.\n{long}.\n{' '.join(words(rng, 9))}.") for i in range(3)]
    docs += [(60, docs[3][1]), (None, docs[4][1]), (61, None), (62, ""), (3, docs[3][1]), (63, "All. Of. It. " * 30)]
    df = frame(spark, docs)
    got = substring_dedup.repeated_spans(df, lengthen=False).collect()
    hashes = {r["h"]: r["text"] for r in df.selectExpr("xxhash64(text) AS h", "text").collect()}
    have = {(r["doc_id"], hashes[r["text_hash"]], r["start"], r["end"]) for r in got}
    where, by_hash = {}, {t: h for h, t in hashes.items()}
    for d, t in {(-(1 << 63) if d is None else d, t or "") for d, t in docs}:
        s = sentences(t)
        for k in (1, 2, 3):
            for i in range(len(s) - k + 1):
                run = s[i : i + k]
                if sum(len(x[0]) for x in run) >= (10 if k == 3 else 40):
                    where.setdefault(tuple(x[0] for x in run), []).append((d, by_hash.get(t, 0) % (1 << 64), run[0][1], run[-1][2], t))
    spans = {}
    for places in where.values():
        for d, _, a, b, t in sorted(places)[1:]:
            spans.setdefault((d, t), []).append((a, b))
    want = set()
    for (d, t), own in spans.items():
        own.sort()
        a, b = own[0]
        for x, y in own[1:]:
            if x > b:
                want.add((d, t, a, b))
                a, b = x, y
            b = max(b, y)
        want.add((d, t, a, b))
    assert have == want and want
    # cutting them out leaves the bytes between, all columns and rows without repeats untouched
    out = substring_dedup.without_repeats(df, lengthen=False)
    assert out.columns == df.columns
    left = {(r["doc_id"], r["text"]) for r in out.collect()}
    for d, t in docs:
        key = -(1 << 63) if d is None else d
        cuts = sorted((a, b) for x, y, a, b in want if (x, y) == (key, t or ""))
        if not cuts:
            assert (d, t) in left
            continue
        raw, at, kept = t.encode(), 0, b""
        for a, b in cuts:
            kept, at = kept + raw[at:a], b
        rest = (kept + raw[at:]).decode()
        assert ((d, rest) in left) == bool(rest.strip())


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "Short, item!"), (10, "é ß ü"), (3, None), (4, " ... "), (10, "same id again")]


def contaminated(docs, items, n=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            x = split(text)
            k = min(n, len(x))
            for j in range(len(x) - k + 1) if k else ():
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == x[j : j + k]:
                        hit.update(range(i, i + k))
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_decontamination(spark, block_bytes):
    rng = random.Random(2)
    long_item = ITEMS[0][1].split()
    docs = [(i, " ".join(rng.choice(["filler", "short", "item", "é", "one", "two"]) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(50, "x " + " ".join(long_item[:13]).upper() + " y"), (51, " ".join(long_item[:12])), (52, "-".join(long_item * 3)), (53, None), (54, ""), (55, "É ß ü"), (None, "short item"), (50, "short item")]
    docs += [(56, "pad " * 5000 + " ".join(long_item)), (57, "same,id;again"), (50, "short item")]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.hits(frame(spark, docs), items, block_bytes=block_bytes).drop("spans").collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(contaminated(docs, ITEMS), key=key)
    kept = decontaminate.clean(frame(spark, docs), items, block_bytes=block_bytes)
    assert kept.columns == frame(spark, docs).columns
    bad = sorted(str((d, t)) for (d, t), r in zip(docs, contaminated(docs, ITEMS), strict=True) if not r[5])
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == bad


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "x")]).limit(0), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.hits(docs, items).count() == 0
    assert decontaminate.hits(frame(spark, [(1, "short item")]), items.limit(0)).first()["n_hit"] == 0
    assert suffix_dedup.repeated_passages(docs).count() == 0
    assert substring_dedup.repeated_spans(docs).count() == 0
    assert substring_dedup.without_repeats(docs).count() == 0


def lengthened_runs(s):
    """First and last sentence of each run of the lengthened rule."""
    for i in range(len(s)):
        held = 0
        for k in range(1, len(s) - i + 1):
            held += len(s[i + k - 1][0])
            if k < 3:
                if held >= (40, 20)[k - 1]:
                    yield i, i + k - 1
            elif held >= 10:
                yield i, i + k - 1
                break


def test_firsts_know_what_comes_later():
    """Whatever the slices, only places after one that went on are held back."""
    rng = random.Random(6)
    known, sent, least = spans.Firsts(), {}, {}
    known.MOST = 40
    for _ in range(200):
        keys = sorted(rng.sample(range(100), rng.randint(0, 30)))
        place = [(rng.randint(-3, 3), rng.randint(0, 2), rng.randint(0, 5)) for _ in keys]
        columns = [np.array([p[i] for p in place], t) for i, t in enumerate((np.int64, np.uint64, np.uint32))]
        later = known.later(np.array(keys, np.uint64), *columns, np.array([rng.random() < 0.5 for _ in keys], bool))
        for k, p, l in zip(keys, place, later, strict=True):
            if l:
                assert least[k] < p and least[k] in sent[k]
            else:
                sent.setdefault(k, set()).add(p)
            least[k] = min(least.get(k, p), p)
    assert len(known.held) == 40 and all(least[k] in sent[k] for k in least)


def test_short_sentences_are_not_left_alone(spark):
    rng = random.Random(5)
    menu = "\n".join(words(rng, 150, 10**6))
    script = "\n".join("".join(chr(0x4E00 + rng.randint(0, 5000)) for _ in range(20)) for _ in range(30))
    pair = f"{' '.join(words(rng, 12, 10**6))}. {' '.join(words(rng, 12, 10**6))}."
    docs = [(10 * j + i, f"Own {' '.join(words(rng, 12, 10**6))}.\n{p}\nend {' '.join(words(rng, 12, 10**6))}.") for j, p in enumerate((menu, script, pair)) for i in range(3)]
    sents = [" ".join(words(rng, rng.randint(1, 4))) + "." for _ in range(60)]
    docs += [(100 + i, " ".join(sents[(a := rng.randint(0, 50)) : a + rng.randint(1, 20)])) for i in range(60)]
    docs += [(200, "All. Of. It. " * 30), (201, None), (202, "a. b. c.")]
    df = frame(spark, docs)
    got = {(r["doc_id"], r["start"], r["end"]) for r in substring_dedup.repeated_spans(df, lengthen=True).collect()}
    where = {}
    for d, t in docs:
        s = sentences(t or "")
        for i, j in lengthened_runs(s):
            where.setdefault(tuple(x[0] for x in s[i : j + 1]), []).append((d, s[i][1], s[j][2]))
    want, open_ = set(), None
    for d, a, b in sorted({p for places in where.values() for p in sorted(places)[1:]}):
        if open_ and open_[0] == d and a <= open_[2]:
            open_[2] = max(open_[2], b)
            continue
        if open_:
            want.add(tuple(open_))
        open_ = [d, a, b]
    want.add(tuple(open_))
    assert got == want
    # the pipeline cuts every copy but the first, whole
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    for j, p in enumerate((menu, script, pair)):
        assert p in left[10 * j]
        for i in (1, 2):
            assert not any(line in left[10 * j + i] for line in p.split("\n")) and "end" in left[10 * j + i]
