"""Near-duplicates of texts and vectors, and components: against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from namesieve.llm import projection_passes, simhash_bk
from namesieve.llm.components import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(-40, 90, (60, 2))]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    links.remove((5, 5))
    assert got == roots({n for pair in links for n in pair}, links)
    assert components(df.limit(0), "a", "b").count() == 0


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash_bk, "_CHUNK", 7)
    for text in (None, "", " \n", "one", "One two", "a b c", "É x y z " * 30, "A b c d e f g h i j a b c"):
        assert simhash_bk.fingerprint(text and text.encode()) % (1 << 64) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_forest_finds_what_brute_force_finds(radius, monkeypatch):
    monkeypatch.setattr(simhash_bk, "FRONTIER", 300)
    rng = np.random.default_rng(radius)
    fps = {int(rng.integers(0, 4)) * (1 << 40) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for _ in range(500)}
    fps = np.array(sorted(fps), np.uint64)
    shard, member = np.sort(rng.integers(0, 4, len(fps))), rng.random(len(fps)) < 0.7
    a, b = simhash_bk.Forest(shard, fps, member).search(np.arange(len(fps)), radius)
    want = {
        (i, j) for i in range(len(fps)) for j in np.flatnonzero(member & (shard == shard[i]))
        if i != j and bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius
    }
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def near_texts():
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(400)]
    rows, texts = [], []
    for k in range(25):
        text = list(rng.choice(words, 150))
        for _ in range(int(rng.integers(1, 6))):
            changed = list(text)
            for at in rng.integers(0, 150, int(rng.integers(0, 3))):
                changed[at] = "other"
            texts.append(" ".join(changed))
    texts += [None, "", " ", "tiny", "Tiny", "two words"] + [texts[0]] * 30
    for i, t in enumerate(texts):
        rows.append((int(i * 7 % 1009), t, i))
    return rows


@pytest.mark.parametrize("size", [20_000, 4])
def test_simhash_components_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(simhash_bk, "SHARD", size)  # 4: most shards are split
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long").repartition(7)
    got = {r.doc_id: r for r in simhash_bk.near_duplicates(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t, _ in rows}
    ids = list(fps)
    links = [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    want = roots(ids, links)
    assert any(fps[a] != fps[b] for a, b in links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    kept = sorted(map(tuple, simhash_bk.keep_one(df).collect()))
    assert kept == sorted(r for r in rows if want[r[0]] == r[0])


def test_simhash_odd_rows(spark):
    text = "a b c d e f g"
    rows = [(None, text), (None, text), (3, text), (3, text), (None, "x y z other"), (None, "x y z other"), (9, "q r s t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_bk.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3)] * 2 + [(3, 3)] * 2 + [(None, None)] * 2 + [(9, 9)], key=str)
    kept = sorted((tuple(r) for r in simhash_bk.keep_one(df).collect()), key=str)
    assert kept == sorted([(3, text), (None, "x y z other"), (9, "q r s t")], key=str)
    assert simhash_bk.near_duplicates(df.limit(0)).count() == 0 and simhash_bk.keep_one(df.limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for k in range(30):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9)) if k else 300):  # one dense cluster, far larger than a window
            v = centre + rng.standard_normal(16) * rng.choice([0.01, 0.05, 0.12])
            rows.append((n, v.astype(np.float32).tolist(), int(k % 3)))
            n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(40)]
    n += 40
    odd = [(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([float("inf")] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0), (rows[0][1], None), ([1.0, 2.0], 0), ([2.0, 4.0], 0)]
    return rows + [(n + i, v, label) for i, (v, label) in enumerate(odd)]


def test_projection_passes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(projection_passes, "BLOCK", 32)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("x"))
    got = {r.vec_id: r for r in projection_passes.near_duplicates(df.repartition(5), window=4).collect()}
    unit = {}
    for i, v, label in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v) and label is not None:
            unit[i] = (np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)), label)
    near = {i: set() for i, _, _ in rows}
    for i, (a, la) in unit.items():
        for j, (b, lb) in unit.items():
            if i < j and la == lb and len(a) == len(b) and a @ b >= 0.98:
                near[i].add(j)
                near[j].add(i)
    total = sum(map(len, near.values()))
    found = sum(r.n_links for r in got.values())
    assert total > 20_000 and 0.97 * total <= found <= total
    assert all(r.n_links <= len(near[i]) for i, r in got.items())
    want = roots(list(near), [(i, j) for i, js in near.items() for j in js if i < j])
    assert sum(r.component_id == want[i] for i, r in got.items()) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 and got[i].kept for i in near if not near[i])


def test_projection_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    empty = projection_passes.near_duplicates(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = sorted((tuple(r) for r in projection_passes.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True)], key=str)
