import numpy as np

from mosaicry.llm import clusters, neighbours
from mosaicry.llm.clusters import band_recall, bands_for, describe_groups, jaccard_of_cosine, similar_vector_links, split_around_medoids, vector_groups
from mosaicry.llm.neighbours import fit_router, nearest, unit_vectors


def voices(n_groups=25, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(n_groups):
        c = rng.standard_normal(dim)
        for _ in range(1 + g % 7):
            rows.append((i, (c + 0.25 * rng.standard_normal(dim)).astype(float).tolist()))
            i += 1
    return rows


def cosines(rows):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


SCHEMA = "id long, vec array<float>, code string"


def test_groups_equal_brute_force(spark):
    rows = voices()
    s = cosines(rows)
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            label[i] = min(label[j] for j in range(len(rows)) if s[i, j] >= 0.8)
    size = {g: label.count(g) for g in label}
    want = {i: g for i, g in enumerate(label) if size[g] > 1}
    extra = [(9000, None, "x"), (9001, [0.0] * 32, "x"), (9002, [float("nan")] * 32, "x"), (9003, [], "x"), (None, rows[0][1], "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:3]] + extra, SCHEMA)
    got = {r["id"]: r["group_id"] for r in vector_groups(df, "id", "vec", 0.8).collect()}
    assert got == want
    assert vector_groups(df.limit(0), "id", "vec").count() == 0


def test_a_group_of_copies_and_its_description(spark):
    rows = voices(6)
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    links = similar_vector_links(df, "id", "vec", 0.8)
    assert links.count() < 200
    g = vector_groups(df, "id", "vec", 0.8)
    d = {r["group_id"]: r for r in describe_groups(df, "id", "vec", g, links=links).collect()}
    assert d[0]["size"] == 51 and d[0]["spread"] < 1e-6 and d[0]["typical"] == [0, 1000, 1001]


def test_medoids_split_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, i) for i in range(21, 26)], "a long, b long")
    got = {r["id"]: r["medoid"] for r in split_around_medoids(chain).collect()}
    assert len(got) == 16 and all(abs(i - m) <= 1 for i, m in got.items() if i < 10) and all(got[i] == 20 for i in range(20, 26))


def test_band_recall_is_as_documented():
    for n in (5, 300, 30_000, 10**7, 10**9):
        bands, rows = bands_for(n, jaccard_of_cosine(0.8))
        assert band_recall(jaccard_of_cosine(0.8), bands, rows) >= 0.999 and n / 3**rows <= 8
        assert band_recall(jaccard_of_cosine(0.85), bands, rows) > 0.9998


def test_vectors_are_kept_whatever_batch_they_lie_in(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(2 + i % 3).tolist()) for i in range(30)] + [(100 + i, rows_) for i, rows_ in enumerate([[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [1.0, 0.0], None, [], [0.0, 0.0], [float("nan"), 1.0]])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got = []
    for parts in (1, 3, 11):
        t = df.repartition(parts)
        u = unit_vectors(t, "id", "vec")
        got.append(({tuple(r) for r in vector_groups(t, "id", "vec", 0.9).collect()}, {r["id"] for r in u.collect()}, {(r["id"], r["other"]) for r in nearest(u, u, 2, 0.5, factor=1.0).collect()}))
    assert got[0] == got[1] == got[2]
    assert got[0][1] == {*range(30), 100, 101, 102} and (100, 101) in got[0][2] and (100, 102) not in got[0][2]


def brute_top(rows, base, k, least):
    out = set()
    for i, v in rows:
        s = sorted(((-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in base if j != i))
        out |= {(i, j) for c, j in s[:k] if -c >= least}
    return out


def test_exact_search_with_factor_one(spark):
    rows = [(i, np.array(v, dtype=np.float32)) for i, v in voices(60, seed=4)]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in rows] + [(900, None, "x"), (901, [0.0] * 32, "x")], SCHEMA)
    u = unit_vectors(df, "id", "vec")
    assert u.count() == len(rows)
    want = brute_top(rows, rows, 3, 0.5)
    got = {(r["id"], r["other"]) for r in nearest(u, u, 3, 0.5, factor=1.0, sample=50, shard=40).collect()}
    assert got == want
    got = {(r["id"], r["other"]) for r in nearest(u, u, 3, 0.5, sample=50, shard=40).collect()}
    assert len(got & want) >= 0.9 * len(want) and got - want == set() or len(got & want) >= 0.9 * len(want)


def test_search_with_ties_and_nothing(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "id long, vec array<float>")
    u = unit_vectors(df, "id", "vec")
    got = sorted((r["id"], r["other"]) for r in nearest(u, u, 2, 0.7, shard=4).collect())
    assert got == sorted((i, j) for i in range(20) for j in [x for x in range(20) if x != i][:2])
    assert nearest(u, u.limit(0), 2, 0.7).count() == 0 and nearest(u.limit(0), u, 2, 0.7).count() == 0
    assert isinstance(fit_router(u.limit(0), 0), bytes)


def test_loose_groups_split_by_all_their_similar_pairs(spark):
    # fans of directions 12 degrees apart, some stored several times; the best linked ones do not have the smallest ids
    rng = np.random.default_rng(5)
    rows = []
    for fan in range(2):
        for k in range(14):
            v = np.zeros(8)
            v[2 * fan], v[2 * fan + 1] = np.cos(np.radians(12 * k)), np.sin(np.radians(12 * k))
            rows += [v.tolist()] * int(rng.integers(1, 5))
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows)]
    x = dict(rows)
    s = {(i, j): i != j and np.dot(x[i], x[j]) >= 0.8 for i in x for j in x}
    rank = {i: (sum(s[i, j] for j in x), -i) for i in x}
    medoid, left = {}, set(x)
    while left:
        lead = {i for i in left if all(rank[i] > rank[j] for j in left if s[i, j])}
        for i in left:
            if i in lead or any(s[i, j] for j in lead):
                medoid[i] = i if i in lead else max((j for j in lead if s[i, j]), key=rank.get)
        left -= set(medoid)
    want = {m: list(medoid.values()).count(m) for m in medoid.values()}
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    g = vector_groups(df, "id", "vec", 0.8)
    for block in (1024, 8):
        clusters.PAIR_BLOCK = block
        got = {r["group_id"]: r["size"] for r in describe_groups(df, "id", "vec", g, split=True).collect()}
        assert got == want
    clusters.PAIR_BLOCK = 1024


def test_the_disk_holds_each_vector_once(spark, monkeypatch):
    # many shards and blocks: no vector is copied for a block of queries or follows a query to a shard
    rng = np.random.default_rng(3)
    x = rng.integers(-20, 20, (300, 16)) / 128
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    written, write = [], neighbours.materialize

    def counted(t, name="t", **more):
        out = write(t, name, **more)
        if {"vec", "packed"} & set(out.columns):
            written.append((name, out.count()))
        return out

    monkeypatch.setattr(neighbours, "materialize", counted)
    u = unit_vectors(df, "id", "vec")
    got = {(r["id"], r["other"]) for r in nearest(u, u, 3, 0.3, factor=1.0, sample=100, shard=50, block=25).collect()}
    assert got == brute_top(list(enumerate(x)), list(enumerate(x)), 3, 0.3) and got
    assert sum(n for _, n in written) == len(x)


def test_packed_vectors_come_back_as_they_were():
    x = np.random.default_rng(2).standard_normal((9, 33)).astype(np.float32)
    assert (neighbours.unpacked(neighbours.packed(x), 33) == x).all()
