"""Embedding near-dedup, centroid clustering and lexical search beside plain loops, and their edges."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_tables import TEXTS, edge_documents, no_documents

from streamlens.llm import centroids, lattice, lexical


def counted(rows):
    return Counter(tuple(r) for r in rows)


# 11 embeddings


def linked(x, y, cosine=lattice.COSINE):
    top = lambda v: [c / max(map(abs, v)) for c in v]
    x, y = top(x), top(y)
    return sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)) >= cosine


def usable(vector, label):
    return label is not None and vector and all(c is not None and math.isfinite(c) for c in vector) and any(vector)


def plain_links(rows):
    """(vec_id, n_links, component, kept) of (vec_id, vector, label) rows, by all pairs."""
    n = len(rows)
    good = [usable(v, label) for _, v, label in rows]
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, x, a), (_, y, b) = rows[i], rows[j]
            if good[i] and good[j] and a == b and len(x) == len(y) and linked(x, y):
                near[i].append(j)
                near[j].append(i)
    out = []
    for i in range(n):
        seen, front = {i}, [i]
        while front:
            for j in near[front.pop()]:
                if j not in seen:
                    seen.add(j)
                    front.append(j)
        least = min((rows[j][0] is not None, rows[j][0] or 0) for j in seen)
        root = least[1] if least[0] else None
        out.append((rows[i][0], len(near[i]), root, rows[i][0] == root))
    return Counter(out)


def near_copy(draw, vector, cosine):
    x = np.array(vector) / np.linalg.norm(vector)
    z = draw.normal(size=len(x))
    z -= z @ x * x
    return (cosine * x + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)).tolist()


EMBEDDING = "vec_id long, embedding array<double>, label string"


def test_lattice_decodes_to_the_nearest_point():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 8)) * 2
    point = lattice.nearest_e8(x)
    assert np.array_equal(2 * point, np.rint(2 * point))
    assert (((2 * point) % 2).sum(1) % 8 == 0).all() and (point.sum(1) % 2 == 0).all()
    short = lattice.shortest()
    assert short.shape == (240, 8) and np.allclose((short**2).sum(1), 2)
    away = ((x - point) ** 2).sum(1)
    for step in short:
        assert (away <= ((x - point - step) ** 2).sum(1) + 1e-9).all()


def test_probed_cells_are_the_neighbours():
    made = lattice.Lattice(64, tables=2, probes=3)
    draw = np.random.default_rng(2)
    x = lattice.unit(draw.normal(size=(50, 64)))
    group = np.full(50, 7)
    keys = made.cells(x, group)
    assert keys.shape == (50, 2, 4) and len(np.unique(keys[0])) == 8
    assert np.array_equal(keys[:, :, 0], made.cells(x, group, probes=False)[:, :, 0])
    # a neighbour's own key is what is probed: move a vector's projection by a shortest vector
    u = (x @ made.directions).reshape(50, 2, 2, 8)
    point = lattice.nearest_e8(u.reshape(-1, 8)).reshape(u.shape)
    own = {int(k) for k in keys[0, 0, 1:]}
    found = set()
    for half in range(2):
        for step in lattice.shortest():
            moved = point[0, 0].copy()
            moved[half] += step
            with np.errstate(over="ignore"):
                whole = (2 * moved).astype(np.int64).astype(np.uint64).reshape(16)
                salt = lattice._mixed(np.array([8], np.uint64))
                found.add(int(lattice._mixed((whole * made.factors).sum(keepdims=True) ^ salt)[0]))
    assert own <= found


def test_recall_against_all_pairs(spark):
    """Pairs from the threshold upwards, where lattice hashing is weakest."""
    draw = np.random.default_rng(3)
    rows = []
    for k in range(1200):
        x = draw.normal(size=64).tolist()
        rows += [(2 * k, x, "a"), (2 * k + 1, near_copy(draw, x, draw.uniform(0.9301, 0.95)), "a")]
    found = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, EMBEDDING)).collect()}
    assert len(found) == 2400
    assert np.mean([found[2 * k].n_links == 1 and found[2 * k + 1].component_id == 2 * k for k in range(1200)]) >= 0.98


@pytest.mark.parametrize("spread", [0.9995, 0.985, 0.968])
def test_crowded_groups_count_every_link(spark, monkeypatch, spread):
    """One label holds a large group; balls, cells and blocks are small, so that all of them are cut."""
    monkeypatch.setattr(lattice, "BALL", 16)
    monkeypatch.setattr(lattice, "CAP", 40)
    monkeypatch.setattr(lattice, "ROWS", 64)
    draw = np.random.default_rng(4)
    middle = draw.normal(size=32)
    rows = [(k, near_copy(draw, middle, spread), "hot") for k in range(220)]
    rows += [(500 + k, near_copy(draw, middle, 0.93), "hot") for k in range(20)]
    rows += [(600 + k, draw.normal(size=32).tolist(), "hot") for k in range(60)]
    rows += [(700 + k, near_copy(draw, middle, spread), "other") for k in range(3)]
    got = {r.vec_id: tuple(r) for r in lattice.near_duplicates(spark.createDataFrame(rows, EMBEDDING)).collect()}
    expected = {r[0]: r for r in plain_links(rows)}
    assert set(got) == set(expected)
    assert all(got[i][1] <= expected[i][1] for i in got)
    assert sum(r[1] for r in got.values()) >= 0.995 * sum(r[1] for r in expected.values())
    assert np.mean([got[i] == expected[i] for i in got]) >= (0.99 if spread > 0.99 else 0.8)


def test_embedding_edges(spark):
    inf, nan = float("inf"), float("nan")
    x = [0.5, -1.0, 2.0, 0.25, 1.0, 1.0, 1.0, 1.0, 3.0]
    rows = [
        (1, x, "a"), (2, [2 * c for c in x], "a"), (3, [-c for c in x], "a"), (3, x, "a"), (4, x, "b"), (5, x, None),
        (6, None, "a"), (7, [], "a"), (8, [0.0] * 9, "a"), (9, [nan, *x[1:]], "a"), (10, [inf, *x[1:]], "a"),
        (11, [None, *x[1:]], "a"), (12, [1e-300 * c for c in x], "a"), (13, [1e300 * c for c in x], "a"),
        (14, x[:3], "a"), (15, x[:3], "a"), (16, [4.0], "c"), (17, [2.0], "c"), (18, [-2.0], "c"), (None, x, "b"), (None, [0.0], "b"),
    ]
    extra = "node long, ball string, grp int, `_id` string, usable int, kept string"
    df = spark.createDataFrame([(*r, 1, "b", 2, "i", 3, "k") for r in rows], f"{EMBEDDING}, {extra}")
    got = lattice.near_duplicates(df)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    expected = Counter()
    for (i, n, root, kept), many in plain_links(rows).items():
        expected[i, n, root, True if i is None else kept] += many
    assert counted(got.collect()) == expected
    assert lattice.near_duplicates(df.limit(0)).count() == 0


# 12 clusters


def plain_clusters(rows, k=16, rounds=3):
    kept = [
        (i, [math.floor(64 * max(-(2.0**18), min(2.0**18, c))) for c in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)
    ]
    raw = lambda v: np.array(v, "<i4").tobytes()
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    own = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), raw(r[1])))[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in own]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        members = {}
        for (_, v), (c, _) in zip(kept, assign()):
            members.setdefault(c, []).append(v)
        own = [[sum(p) // len(members[c]) for p in zip(*members[c])] if c in members else old for c, old in enumerate(own)]
    last = assign()
    inertia = Counter()
    for c, d in last:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in own]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (c, d) in zip(kept, last))


def test_transform_and_search_are_exact():
    draw = np.random.default_rng(5)
    signs = np.array([[(-1) ** bin(i & j).count("1") for j in range(64)] for i in range(64)])
    x = draw.integers(-(2**24), 2**24 + 1, (40, 64))
    assert np.array_equal(centroids.transform(x), x @ signs)
    changes = (np.diff(signs[:, centroids.sequency()], axis=0) != 0).sum(0)
    assert changes.tolist() == list(range(64))
    for spread in (1, 3, 200, 2**24):
        own = draw.integers(-spread, spread + 1, (16, 64))
        own[9] = own[4]
        x = np.concatenate((draw.integers(-spread, spread + 1, (300, 64)), own, (own[:8] + own[8:]) // 2))
        far = ((x[:, None] - own[None]) ** 2).sum(2)
        number, distance = centroids.Search(own).nearest(x)
        assert np.array_equal(number, far.argmin(1)) and np.array_equal(distance, far.min(1))


def test_cluster_edges(spark):
    pick = random.Random(6)
    some = lambda wide=1.0: [pick.uniform(-wide, wide) for _ in range(64)]
    twin = some()
    rows = [(k, some()) for k in range(90)] + [(200, twin), (200, twin), (201, twin), (None, some()), (None, twin)]
    rows += [(202, some()[:63]), (203, None), (204, []), (205, [None, *some()[1:]]), (206, [float("nan"), *some()[1:]])]
    rows += [(207, [float("-inf"), *some()[1:]]), (208, some(1e9)), (209, [1e308, *some()[1:]]), (210, [0.0] * 64), (211, [-1e-9] * 64)]
    extra = "cluster string, n int, ints string, c string"
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], f"vec_id long, embedding array<double>, {extra}")
    assert counted(centroids.cluster(df).collect()) == plain_clusters(rows)
    few = df.filter("vec_id < 5")
    assert counted(centroids.cluster(few).collect()) == plain_clusters(rows[:5])
    assert centroids.cluster(df.limit(0)).count() == 0
    same = spark.createDataFrame([(k, twin) for k in range(40)], "vec_id long, embedding array<float>")
    found = centroids.cluster(same).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in found} == {(0, 0, 0)} and len(found) == 40


# 13 lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_search(docs, items, k=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    total, length = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = Counter()
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for doc, c in own:
            m = 100 - 25 + (25 * sum(c.values()) * total) // length
            score = 0
            for t, often in asked.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    score += often * w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        for rank, (score, known, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, doc if known else None, -score] += 1
    return out


ITEMS = [(1, TEXTS[9]), (2, "word"), (2, "word word W1 w2"), (3, None), (4, ""), (5, "!!"), (None, "a B a b"), (6, "nowhere"),
         (7, "again and AGAIN a"), (8, TEXTS[11]), (9, "w5 " * 3000 + "line")]


@pytest.mark.parametrize("block", [60, lexical.BLOCK])
def test_search_edges(spark, block):
    df, rows = edge_documents(spark)
    df = df.unionByName(df.filter("doc_id = 8").selectExpr("cast(null as long) doc_id", *df.columns[1:]))
    rows = [*rows, (None, TEXTS[4])]
    items = spark.createDataFrame([(*r, "x", 1, 2) for r in ITEMS], "item_id long, text string, `row` string, block int, rank long")
    got = lexical.search(df, items, block_words=block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert counted(got.collect()) == plain_search(rows, ITEMS)
    if block == lexical.BLOCK:
        assert lexical.search(no_documents(spark), items).count() == 0
        assert lexical.search(df, items.limit(0)).count() == 0


def test_ties_at_the_last_place(spark):
    """Hundreds of equal documents: the smallest doc_ids fill the places, whichever task holds them."""
    rows = [(k, "alpha beta" if k % 3 else "alpha gamma") for k in range(600)]
    docs = spark.createDataFrame(random.Random(7).sample(rows, 600), "doc_id long, text string").repartition(7)
    items = [(1, "alpha"), (2, "gamma alpha"), (3, "delta")]
    got = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert counted(got.collect()) == plain_search(rows, items)


def test_partial_sums_stay_exact():
    """Weights near the bound are dealt to several tiles, and no tile's sums reach it."""
    draw = np.random.default_rng(8)
    weights = draw.integers(1, 20_000, 50)
    items = [Counter({int(t): int(n) for t, n in zip(draw.integers(0, 50, 9), draw.integers(1, 5000, 9))}) for _ in range(6)]
    items.append(Counter({3: 10**6}))
    exact = np.array([[item.get(t, 0) * int(weights[t]) for t in range(50)] for item in items])
    for limit in (2**53, 10**12, 10**13):
        tiles = lexical.ItemTiles(items, weights, width=16, limit=limit)
        assert all(tile.sum(1).max() * lexical.IMPACT < limit for _, tile in tiles.tiles)
        impact = draw.integers(0, lexical.IMPACT, (50, 30))
        term, doc = np.nonzero(impact >= 0)
        assert np.array_equal(tiles.scores(doc, term, impact.ravel(), 30), exact @ impact)
    assert len(lexical.ItemTiles(items, weights, width=16, limit=10**12).tiles) > 4


def test_impacts_of_very_long_documents():
    assert lexical.impacts(np.array([5]), np.array([10**9]), 10**11, 10**13).tolist() == [
        (10**9 * 5) // (5000 + 12 * (75 + 25 * 10**9 * 10**11 // 10**13))
    ]
