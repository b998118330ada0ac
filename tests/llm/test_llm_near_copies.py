"""Near copies: against brute-force Jaccard similarity of five-word shingles."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from namesieve.llm import near_copies, nnls_packing, tokens


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(a, b):
    return a == b or (a | b and len(a & b) >= 0.8 * len(a | b))


def texts():
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(3000)]
    common = list(rng.choice(words, 25))
    out = []
    for k in range(60):
        text = list(rng.choice(words, int(rng.integers(20, 300)))) + common * (k % 3 > 0)
        for _ in range(4):
            changed, at = list(text), int(rng.integers(len(text)))
            changed[at:at] = list(rng.choice(words, int(rng.integers(0, max(2, len(text) // 6)))))
            if rng.random() < 0.3:
                changed[int(rng.integers(len(changed)))] = "other"
            out.append(" ".join(changed))
    base = list(rng.choice(words, 120))  # one large group, all of it near
    out += [" ".join([*base, *rng.choice(words, 3)]) for _ in range(80)]
    return out + [None, "", " \n", "tiny", "Tiny", "two words", "a b c d e", "A b  c d e"] + out[:5]


@pytest.mark.parametrize("common", [16, 1])
def test_stage_equals_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(near_copies, "COMMON", common)
    rows = [(int(i * 7 % 1009), t, "x") for i, t in enumerate(texts())]
    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unequal = 0
    for i in sets:
        for j in sets:
            if i < j and linked(sets[i], sets[j]):
                unequal += sets[i] != sets[j]
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert unequal > 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, df, "").collect()))
    assert got == sorted(r for r in rows if find(r[0]) == r[0])


def test_a_key_of_many_texts_is_cut_and_keeps_one_hub():
    rng = np.random.default_rng(3)
    m = 3 * near_copies.PIECE + 100
    key = np.r_[np.full(5, 1), np.full(m, 2), [3], np.full(2, 4)]
    n = np.r_[np.full(5, 30), np.sort(rng.integers(100, 105, m)), [7], [8, 9]]
    node = np.r_[np.arange(5), 1000 + np.arange(m), [1], [2, 3]]
    rows = [key, node, n, n]
    out, groups = [], near_copies._Grouping()
    for start in range(0, len(key), 3001):
        out += groups.add([r[start : start + 3001] for r in rows])
    found = [r for batch in [*out, *groups.end()] for r in batch.to_pylist()]
    sizes = sorted(len(r["nodes"]) for r in found)
    assert sizes[:2] == [2, 5] and sum(sizes[2:]) == m and len(sizes) >= 5 and sizes[-1] <= near_copies.PIECE + 3001
    cut = [r for r in found if 1000 in r["nodes"] or r["nodes"][0] >= 1000]
    assert len({r["digest"] for r in cut}) == 1 and sorted(r["seq"] for r in cut) == list(range(len(cut)))
    assert {h for r in cut for h in r["low"]} | {h for r in cut for h in r["mid"]} == {1000}


def test_a_tile_gives_no_pairs_of_long_texts_that_only_share_a_key():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64)) for _ in range(300)]
    sets += [np.unique(np.r_[s[:1900], rng.integers(0, 1 << 63, 90).astype(np.uint64)]) for s in sets[:40]]
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int32)
    small, sketch = [near_copies._small(s) for s in sets], [near_copies._sketch(s) for s in sets]
    sketch[77] = b""  # none: it may be like any
    columns = [np.ones(m, np.int64), np.zeros(m, np.int32), np.arange(m), n, n, np.arange(m)]
    names = ["digest", "tile", "node", "n", "rem", "root", "asks", "small", "sketch"]
    both = [
        pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(m, asks)), pa.array(small), pa.array(sketch)], names)
        for asks in (0, 1)
    ]
    made = list(near_copies._tiles(None)(iter([b.slice(k, 50) for b in both for k in range(0, m, 50)])))
    found = {(r["a"], r["b"]) for batch in made for r in batch.to_pylist()}
    assert {(i, 300 + i) for i in range(40)} <= found and all(a < b for a, b in found)
    assert len(found) < 2 * m


def test_odd_rows(spark):
    text = "a b c d e f g"
    rows = [(None, text), (None, text), (3, text), (3, text), (None, "x y z other"), (None, "x y z other"), (9, "q r s t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in near_copies.keep_one(df).collect()), key=str)
    assert kept == sorted([(3, text), (None, "x y z other"), (9, "q r s t")], key=str)
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_a_worker_forgets_the_words_it_packed():
    tokens.encoder(nnls_packing.TOKENIZER).ids("some words that a worker keeps")
    rows = pa.RecordBatch.from_pydict({"node": pa.array([1], pa.int64()), "text": pa.array([b"a b c d e f"])})
    assert [b.num_rows for b in near_copies._describe(iter([rows]))] == [1]
    assert tokens.encoder.cache_info().currsize == 0
