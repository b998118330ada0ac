"""Periodic runs against a plain search of every period."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from namesieve.llm import catalog, periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=24, exponent=3):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return found


def wide_runs(words, least=24, exponent=3):
    """The same with numpy, for whole texts."""
    found, w = {}, np.array(words)
    for q in range(1, len(words) // exponent + 1):
        equal = np.r_[False, w[q:] == w[:-q], False].astype(np.int8)
        steps = np.flatnonzero(np.diff(equal))
        for i, j in zip(steps[::2].tolist(), steps[1::2].tolist()):
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
    return found


texts = st.lists(
    st.one_of(
        st.lists(st.integers(0, 2), max_size=40),
        st.builds(lambda u, k, v: u * k + v, st.lists(st.integers(0, 3), max_size=6), st.integers(0, 9), st.lists(st.integers(0, 3), max_size=9)),
    ),
    max_size=4,
)


@settings(max_examples=300, deadline=None)
@given(texts, st.sampled_from([(24, 3), (8, 3), (1, 3), (4, 2), (12, 4)]))
def test_runs_of_some_texts_at_once(docs, least):
    expected, begin = {}, 0
    for words in docs:
        expected.update({(begin + s, n): q for (s, n), q in plain_runs(words, *least).items()})
        begin += len(words)
    stops = np.cumsum([len(d) for d in docs], dtype=np.int64)
    flat = np.array([w for d in docs for w in d], np.int64)
    assert periodic_runs.runs_of(flat, stops, *least) == expected


def test_long_texts_take_no_square_time():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for words in ([0] * 20_000, list(range(50)) * 400, [x for i in range(700) for x in (100 + i, *range(30))], fibonacci[-1]):
        found = periodic_runs.runs_of(np.array(words), np.array([len(words)]))
        if words is fibonacci[-1]:
            assert all(words[s : s + n - q] == words[s + q : s + n] for (s, n), q in found.items()) and found
        else:
            assert found == wide_runs(words)


def test_nulls_blanks_repeats_and_other_columns(spark):
    phrase = " ".join(["a b"] * 15)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, phrase), (4, phrase), (4, phrase), (5, "x\x0b" + phrase + "\ufeff \u00e9")]
    docs = spark.createDataFrame([(i, t, t, 7) for i, t in rows], "key long, body string, runs string, id int")
    found = periodic_runs.find(docs, "key", "body").collect()
    run = [(0, 30, 2)]
    expected = [
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 30, run, "a b"), (4, 30, run, "a b"), (4, 30, run, "a b"),
        (5, 32, [(1, 29, 2)], "x a b b\ufeff \u00e9"),
    ]
    got = [(r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert periodic_runs.find(docs.limit(0), "key", "body").count() == 0


def test_query_equals_plain_search(spark):
    rows = {}
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        words = (r["text"] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
        runs = sorted((s, m, q) for (s, m), q in wide_runs([ids[w] for w in words]).items())
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda x: (x[0], x[2])))
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        rows[r["doc_id"]] = (
            len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
        )
    got = {r.doc_id: tuple(r)[1:] for r in catalog.op11_periodic_runs(spark, SF).collect()}
    assert got == rows and sum(r[0] for r in rows.values()) > 10
