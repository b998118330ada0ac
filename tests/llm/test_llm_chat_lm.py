"""Chat logs and the language model."""

import collections
import hashlib
import math
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namesieve.llm import bloom_lm, chat_log


@given(st.text(alphabet="<|\\ai\n_>"), st.sampled_from(["user", "assistant", "<|\\\n|", ""]))
def test_rendering_is_reversible(text, role):
    out, start, stop = chat_log.render(role, text)
    assert chat_log.parse(out) == (role, text)
    assert out.count("<|im_start|>") == out.count("<|im_end|>") == 1
    assert chat_log.unescape(out[start:stop]) == (text if role == "assistant" else "")


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, tie string, seq int, kind string, role string, text string")


def test_fold(spark):
    rows = [
        (1, 0, "", 0, "start", "user", None), (1, 0, "", 1, "delta", None, "hel"), (1, 0, "", 2, "delta", None, "lo"),
        (1, 1, "", 0, "start", "assistant", None), (1, 1, "", 1, "delta", None, "bad"), (1, 1, "", 2, "regenerate", None, None),
        (1, 1, "", 3, "delta", None, "good"), (1, 1, "", 4, "delta", None, None), (1, 1, "", 5, "delta", None, " one"),
        (1, 2, "", 0, "start", "assistant", None), (1, 2, "", 1, "delta", None, "x"), (1, 2, "", 2, "edit", None, "edited"),
        (1, 2, "", 3, "typing", None, "?"), (1, 2, "", 4, None, None, "?"), (1, 3, "", 0, "start", None, None),
        (None, None, "b", 0, "start", "user", None), (None, None, "a", 0, "start", "user", None), (None, None, "a", 1, "edit", None, "n"),
    ]
    done = chat_log.messages(events(spark, rows).repartition(4))
    got = [(r.conv_id, r.turn, r.tie, *chat_log.parse(r.formatted)) for r in done.collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 0, "", "user", "hello"), (1, 1, "", "assistant", "good one"), (1, 2, "", "assistant", "edited"),
            (1, 3, "", "", ""), (None, None, "a", "user", "n"), (None, None, "b", "user", ""),
        ], key=str,
    )
    total = {r.conv_id: r for r in chat_log.summaries(done).collect()}
    assert total[1].loss_chars == len("good oneedited") and total[1].n_turns == 4 and total[None].n_turns == 2
    assert total[None].turns_sha256 == hashlib.sha256(b"user\nn\nuser\n\n").hexdigest()
    assert chat_log.summaries(chat_log.messages(events(spark, []))).count() == 0


def test_table_and_one_long_conversation(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"text <|im_end|> {i}" * (i % 4)) for i in range(3000)]
    rows += [(8, 0, "user", None), (8, 0, "user", None), (8, 1, "assistant", "é" * 5), (9, 0, None, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tie", F.lit(1))
    got = {r.conv_id: r for r in chat_log.summaries(chat_log.messages(chat_log.log_of(table.repartition(6)))).collect()}
    for conv in (7, 8, 9):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(learned)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert got[conv].formatted_chars == sum(len(chat_log.render(a, b)[0]) for a, b in turns)


def test_filter_keeps_counts(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**62), 2**62, 5000)
    counts = np.maximum(3, (rng.pareto(1.0, 5000) * 3).astype(np.int64))
    table = spark.createDataFrame(list(zip(keys.tolist(), counts.tolist())), "h long, n long")
    built = bloom_lm.build_filter(table, 3)
    levels = built.levels(keys.view(np.uint64))
    want = np.floor(np.log2(counts / 3) * 4 + 1e-9).astype(int) + 1
    assert (levels >= want).all() and (levels == want).mean() > 0.97
    others = rng.integers(-(2**62), 2**62, 5000).view(np.uint64)
    assert (built.levels(others) > 0).mean() < 0.04
    middle = bloom_lm.counts_of_levels(built.most, 3)[want]
    assert (np.abs(middle / counts - 1) < 0.2).mean() > 0.95
    empty = bloom_lm.build_filter(table.limit(0), 1)
    assert (empty.levels(others) == 0).all()


def test_binary_search_of_levels():
    filter_ = bloom_lm.Filter(np.zeros(bloom_lm.SHARDS * 80_000, np.uint8), 640_000, 70, 1)
    keys = (np.arange(1, 71, dtype=np.uint64) * np.uint64(bloom_lm.SHARDS)) ** np.uint64(3)
    filter_.add(keys, np.arange(1, 71))  # all of shard 0
    assert filter_.levels(keys).tolist() == list(range(1, 71))


def corpus():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        at, text = int(rng.integers(300)), []
        for _ in range(int(rng.integers(0, 60))):
            at = int((at * 7 + rng.integers(3)) % 300) if rng.random() < 0.8 else int(rng.integers(300))
            text.append(words[at].upper() if rng.random() < 0.1 else words[at])
        rows.append((i, " ".join(text)))
    return rows + [(900, None), (901, ""), (902, "Ünseen Ünseen w1\x0bw2"), (None, "w1 w2 w3"), (950, "w1 w1"), (950, "w1 w1")]


@pytest.mark.parametrize("resolution", [2.0**-24, 2.0**-10])
def test_scores(spark, monkeypatch, resolution):
    monkeypatch.setattr(bloom_lm, "RESOLUTION", resolution)
    monkeypatch.setattr(bloom_lm, "PRIOR", 5.0)
    monkeypatch.setattr(bloom_lm, "_SLICE", 900)
    monkeypatch.setattr(bloom_lm, "_GATHERED", 500)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: (t or "").encode().lower().split() + ["end"]
    seen = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    total, types = sum(seen.values()), len(seen)
    got = collections.defaultdict(list)
    result = bloom_lm.score(df).collect()
    for r in result:
        got[r.doc_id].append(r)
    assert len(result) == len(rows)
    for i, t in rows:
        w, r = words(t), got[i][0]
        base = sum(math.log10((seen[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(w), total)
        assert r.n_known == sum(seen[x] > 0 for x in w) and r.base_score == pytest.approx(base, abs=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    if resolution < 2.0**-20:  # pairs tell a lot here
        out = [r for r in result if r.held_out]
        assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)


def test_scores_do_not_depend_on_the_floor(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "PRIOR", 5.0)
    df = spark.createDataFrame(corpus(), "doc_id long, text string").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    all_in = {r.doc_id: r for r in bloom_lm.score(df).collect()}
    monkeypatch.setattr(bloom_lm, "RESOLUTION", 0.5)  # only words of half the corpus, so none, are in the filter
    result = bloom_lm.score(df).collect()
    for r in result:
        one = all_in[r.doc_id]
        assert (r.n_known, r.n_tokens) == (one.n_known, one.n_tokens) and r.base_score == pytest.approx(one.base_score)
    # Levels and false positives of the filter are what differs.
    assert sum(r.score for r in result) == pytest.approx(sum(r.score for r in all_in.values()), rel=0.05)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = {r.doc_id: (r.text or "").lower().split() + ["\n"] for r in df.collect()}
    one = collections.Counter(w for i, t in texts.items() if not held(i) for w in t)
    two = collections.Counter(x for i, t in texts.items() if not held(i) for x in zip(t, t[1:]))
    mass = sum(one.values()) + 0.1 * (len(one) + 1)
    for r in result:  # without the filter all counts are exact
        t, word = texts[r.doc_id], lambda w: (one[w] + 0.1) / mass
        p = [word(t[0]), *((two[a, b] + 5 * word(b)) / (one[a] + 5) for a, b in zip(t, t[1:]))]
        if r.doc_id != 902:  # other white space
            assert r.score == pytest.approx(sum(map(math.log10, p)))


def test_scores_without_rows_or_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bloom_lm.score(empty).count() == 0
    alone = bloom_lm.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (alone.held_out, alone.n_tokens, alone.n_known, alone.train_tokens) == (True, 3, 0, 0) and alone.base_score == 0


def test_pairs_under_the_floor_are_not_stored_by_token(spark, monkeypatch):
    """Most pairs of a large corpus are under the floor: what is written for them must not be a multiple of the texts."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 400, 200))) for i in range(300)]
    monkeypatch.setattr(bloom_lm, "RESOLUTION", 2.0**-13)
    monkeypatch.setattr(bloom_lm, "PRIOR", 5.0)
    folder = Path(bloom_lm.written(spark.range(1), "lm-folder").inputFiles()[0].removeprefix("file:")).parents[1]
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    result = {r.doc_id: r for r in bloom_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert size() - before < sum(len(t) for _, t in rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = {i: t.split() + ["\n"] for i, t in rows}
    one = collections.Counter(w for i, t in texts.items() if not held(i) for w in t)
    two = collections.Counter(x for i, t in texts.items() if not held(i) for x in zip(t, t[1:]))
    floor = math.ceil(sum(one.values()) * 2.0**-13)
    assert floor == 7 and min(one.values()) >= floor and max(v for (_, b), v in two.items() if b != "\n") < floor
    mass = sum(one.values()) + 0.1 * (len(one) + 1)
    for i, t in texts.items():  # the filter's levels of words are what differs
        p = [(one[t[0]] + 0.1) / mass, *((two[a, b] + 5 * (one[b] + 0.1) / mass) / (one[a] + 5) for a, b in zip(t, t[1:]))]
        assert result[i].score == pytest.approx(sum(map(math.log10, p)), rel=0.02)
