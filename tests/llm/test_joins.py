"""Operators 6 and 8 and the components they share, against plain Python."""

import random
import re

import numpy as np
import pytest

from sparkloom.llm import embedding_dedup, jaccard_join
from sparkloom.llm.components import components

DOCS = "doc_id bigint, text string, n bigint, set_id string, root string, __doc string, __hash string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "a", "b", "c", "d") for d, t in docs], DOCS).repartition(3)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def grouped(n, links, ids):
    """Least id of each row's component."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        up[find(a)] = find(b)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(n)]


def near_copies():
    """Families of edited texts of many sizes, chains, copies, texts that share a passage only."""
    rng = random.Random(4)
    w = lambda n: [f"{rng.choice('abcdefg')}{rng.randint(0, 5000)}" for _ in range(n)]
    docs, passage = [], w(60)
    for size in (1, 3, 5, 6, 7, 8, 9, 11, 14, 20, 33, 60, 100, 200, 300, 800, 2500):
        base = w(size)
        for k in range(9):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 80))):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], w(1), w(2)])
                own = own or w(1)
            docs.append(" ".join(own))
            if k % 4 == 3:
                base = own  # a chain: later copies drift from the first
    docs += [" ".join(w(40) + passage + w(rng.randint(20, 60))) for _ in range(40)]
    for size in (30, 120):  # families that crowd a slice and fall into several components
        base = w(size)
        for _ in range(100):
            own = list(base)
            for _ in range(rng.randint(0, size // 7)):
                own[rng.randrange(size)] = w(1)[0]
            docs.append(" ".join(own))
    docs += [docs[3], docs[70].upper(), docs[100], None, "", "   ", "one", "one", "two"]
    out = [(i, t) for i, t in enumerate(docs)]
    rng.shuffle(out)
    return out + [(7, out[7][1]), (7, out[7][1]), (3, "a used id with another text"), (None, docs[60])]


@pytest.mark.parametrize("small, part", [(24, 2048), (3, 4), (1, 2)])
def test_jaccard(spark, small, part):
    docs = near_copies()
    sets = [shingles(t) for _, t in docs]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                links.append((i, j))
    low = -(1 << 63)
    ids = [low if d is None else d for d, _ in docs]
    want = sorted((i, len(s), c) for i, s, c in zip(ids, sets, grouped(len(docs), links, ids), strict=True))
    got = jaccard_join.report(frame(spark, docs), small, part).collect()
    fix = lambda v: low if v is None else v
    assert sorted((fix(r["doc_id"]), r["n_shingles"], fix(r["component_id"])) for r in got) == want
    assert len(links) > 300 and len({c for _, _, c in want}) < len(docs) - 100


def test_bands_hold_every_linked_pair():
    for x in range(1, 3000, 7):
        for y in range(x, x * 100 // 75 + 1, max(1, x // 20)):
            if 100 * x < 75 * y:
                continue
            first, last = jaccard_join.bands(np.array([x, y]))
            band = int(np.searchsorted(jaccard_join.BOUNDS, x + y))
            assert all(first <= band) and all(band <= last)
            k, n, agree, subsets = jaccard_join.shape(band)
            assert k >= (x + y) // 7 and n > k and subsets.max() < n and 1 <= agree <= len(subsets)


def test_subsets_agree_as_often_as_is_said():
    """However k differing partitions are placed, at least ``agree`` subsets are free of them, and no fewer can be said."""
    rng = random.Random(7)
    for band in range(1, 26):
        k, n, agree, subsets = jaccard_join.shape(band)
        if k < 1:
            continue
        free = lambda bad: sum(not bad & set(s) for s in subsets.tolist())  # noqa: E731, B023
        assert min(free(set(rng.sample(range(n), k))) for _ in range(30)) >= agree
        if subsets.shape[1] == 1 or k <= jaccard_join.PAIRS_UP_TO:
            worst = set(range(k))
        else:
            worst = {3 * i for i in range(min(k, n // 3))} | {3 * i + 1 for i in range(max(0, k - n // 3))}
        assert free(worst) == agree


def test_one_of_each_keeps_columns(spark):
    docs = near_copies()
    df = frame(spark, docs)
    out = jaccard_join.one_of_each(df)
    assert out.columns == df.columns
    rows = out.collect()
    groups = {r["component_id"] for r in jaccard_join.report(df).where("n_shingles > 0").collect()}
    kept = {r["doc_id"] for r in rows if (r["text"] or "").strip()}
    assert kept == groups
    assert {r["text"] for r in rows} >= {None, "", "   "}


def test_jaccard_empty(spark):
    assert jaccard_join.report(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(900, i) for i in range(901, 960)]
    nodes = sorted({x for l in links for x in l if l[0] != l[1]})
    at = {x: i for i, x in enumerate(nodes)}
    want = dict(zip(nodes, grouped(len(nodes), [(at[a], at[b]) for a, b in links if a != b], nodes), strict=True))
    got = components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3)).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(nodes)


def vectors():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 32))
    rows = []
    for i in range(900):
        v = base[i % 40] + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.3, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(900 + i, rows[4][1], 1) for i in range(30)]  # copies
    rows += [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] + [1.0] * 31, 1), (1004, rows[0][1], None)]
    rows += [(1005, [None] + rows[0][1][1:], 0), (1006, [], 0), (1007, rows[0][1][:16], 0), (5, rows[5][1], 2), (None, rows[8][1], 2)]
    return rows


def test_embeddings(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id bigint, embedding array<float>, label int, k1 string, mult int").repartition(4)
    got = embedding_dedup.linked(df).collect()
    units = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v) / np.linalg.norm(v) if ok else None)
    links, degree = [], [0] * len(rows)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= 0.93:
                links.append((i, j))
                degree[i] += 1
                degree[j] += 1
    have = sum(r["n_links"] for r in got)
    assert sum(degree) >= have >= 0.97 * sum(degree)  # none below the threshold, nearly all above
    low = -(1 << 63)
    fix = lambda v: low if v is None else v
    exact = {}
    for (d, _, _), n in zip(rows, degree, strict=True):
        exact.setdefault(fix(d), []).append(n)
    assert sum(sorted(exact[fix(r["vec_id"])]) == sorted([x["n_links"] for x in got if x["vec_id"] == r["vec_id"]]) for r in got) >= 0.9 * len(got)
    for r in got:
        assert r["kept"] == (r["vec_id"] == r["component_id"])
        if r["vec_id"] in (1000, 1001, 1002, 1003, 1004, 1005, 1006):
            assert (r["n_links"], r["component_id"]) == (0, r["vec_id"])


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.linked(df).count() == 0


def test_hot_group_is_split(spark, monkeypatch):
    """Groups beyond GROUP are compared in parts, with the same counts."""
    monkeypatch.setattr(embedding_dedup, "GROUP", 10)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + rng.standard_normal(16) * 0.01], 1) for i in range(70)]
    got = embedding_dedup.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(69, 0)}


def test_no_filter_of_a_vector_is_cut_off(spark):
    """Pairs that share a filter, but none of the 20 best of either, are linked."""
    rng = np.random.default_rng(3)
    a, r = rng.standard_normal((2, 3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = 0.932 * a + np.sqrt(1 - 0.932**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    code = embedding_dedup.ProductCode(32, *embedding_dedup.code_shape(100))

    def best(x, filters):
        left, right = (h[0] for h in code._halves(x[None]))
        return filters[np.argsort(-(left[filters // code.per_half] + right[filters % code.per_half]))[:20]]

    pairs = []
    for x, y, f, g in zip(a, b, code.decode(a), code.decode(b), strict=True):
        if len(np.intersect1d(f, g)) and not len(np.intersect1d(best(x, f), best(y, g))):
            pairs.append((x, y))
    assert len(pairs) >= 10
    pairs = pairs[:50]
    rows = [(2 * i + k, [float(z) for z in v], i) for i, p in enumerate(pairs) for k, v in enumerate(p)]
    got = embedding_dedup.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(v, 1, v - v % 2) for v, _, _ in rows}
