"""Token ids, the bit-packed store and packing: against the plain tokenizer, exact round trips."""

import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namesieve.llm import nnls_packing, shared, token_store, tokens

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TEXTS = [
    None, "", "   ", "a  b \n\n c\t\td ", "it's I'm  they'll\n've", "x<|endoftext|>y <|endoftext|> z", "a b c　",
    "1234 56.78 €%$ αβΣ ΟΔΟΣ. ΟΔΟΣ", "a\x1cb \x1f c", "é ́x é", "\n\n\n", " \n x", "日本語 テスト です", "a​b",
    "\r\nfoo\r\n", "<|endoftext|", "tab\tsep", " lead", "trail ", "ﬁ ﬀ ǅ İstanbul", "a\n\nb", "word%%% W&&& x's. don't x..",
    "ÿ À ß. ẞ é", "= ≠ a≠b", "x\n.y z;", "<|ENDOFTEXT|> ok", "Same same SAME same.", "long " * 9000,
]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain(file, texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokens.tokenizer_path(file)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [x.ids for x in found]


@pytest.mark.parametrize("file", FILES)
def test_ids_equal_the_plain_call(file, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 6)  # words are forgotten and met again
    encode = tokens.Encoder(file)
    for _ in range(2):
        assert [encode.ids(t).tolist() for t in TEXTS] == plain(file, TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBé. \n!’'\t<|9Σ́", max_size=12), max_size=4))
def test_ids_of_any_text(parts):
    text = " ".join(parts)
    for file in FILES:
        assert tokens.encoder(file).ids(text).tolist() == plain(file, [text])[0]


@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=200), st.data())
@settings(max_examples=100, deadline=None)
def test_packed_ids_come_back(width, ids, data):
    ids = np.array(ids, "<u4") % (1 << width)
    packed = token_store.pack(ids, width)
    assert len(packed) == (len(ids) * width + 7) // 8
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert token_store.unpack(packed, width, start, stop).tolist() == ids[start:stop].tolist()


def docs(spark):
    rows = [(i * 3 % 29, t, "x") for i, t in enumerate(TEXTS)] + [(7, "twice", "x"), (7, "twice", "x"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, payload string").repartition(5), rows


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 40)
    df, rows = docs(spark)
    folder = shared.new_folder(spark, "test-store")
    token_store.write(df, folder)
    got = token_store.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = collections.Counter((i, tuple(x + [2])) for (i, _, _), x in zip(rows, plain(FILES[0], [r[1] for r in rows])))
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.ids_crc32 == crc(r.ids) and r.n_tokens == len(r.ids) for r in got)
    every = [x for r in got for x in r.ids]
    for a, b in ((0, 1), (5, 90), (len(every) - 3, len(every) + 9), (3, 3)):
        assert token_store.span(spark, folder, a, b).tolist() == every[a:b]


def test_empty_store(spark):
    df, _ = docs(spark)
    folder = shared.new_folder(spark, "test-store")
    token_store.write(df.limit(0), folder)
    assert token_store.digests(spark, folder).count() == 0 and len(token_store.span(spark, folder, 0, 5)) == 0


def test_combinations_fill_a_sequence_and_nnls_fits():
    matrix = nnls_packing.combinations()
    assert (np.arange(1, 65) @ matrix == 64).all() and matrix.shape[1] > 500
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 30)), np.zeros(30)
    x[[3, 8, 20]] = 2.0, 0.5, 7.0
    found = nnls_packing.nnls(a, a @ x)
    assert (found >= 0).all() and np.abs(a @ (found - x)).max() < 1e-6
    worse = nnls_packing.nnls(a, -np.ones(12))
    assert (worse == 0).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=300))
def test_plan_holds_every_id_once(lengths):
    sequences = nnls_packing.plan(np.array(lengths, np.int64))
    pieces = collections.defaultdict(list)
    for q in sequences:
        assert 0 < sum(n for _, _, n in q) <= 4096
        for d, s, n in q:
            pieces[d].append((s, n))
    for d, size in enumerate(lengths):
        at = 0
        for s, n in sorted(pieces[d]):
            assert s == at and n > 0
            at += n
        assert at == size


def test_little_padding_on_many_documents():
    lengths = np.maximum(1, np.random.default_rng(0).lognormal(6.5, 1, 20_000)).astype(np.int64)
    sizes = [sum(n for _, _, n in q) for q in nnls_packing.plan(lengths)]
    assert sum(4096 - s for s in sizes if s & (s - 1)) < 0.002 * lengths.sum()


def test_pack_table(spark):
    df, rows = docs(spark)
    out = nnls_packing.pack(df, with_ids=True).collect()
    per, texts = collections.defaultdict(list), plain(FILES[1], [r[1] for r in rows])
    for r in out:
        per[r.doc_id].append(r)
    total = collections.Counter()
    for (i, _, _), ids in zip(rows, texts):
        total[i] += len(ids) + 1
    assert {i: sum(p.length for p in ps) for i, ps in per.items()} == dict(total)
    by = {i: ids + [2] for (i, _, _), ids in zip(rows, texts)}
    for r in out:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert crc(got) == r.ids_crc32
        if r.doc_id is not None and len(per[r.doc_id]) and sum(1 for x in rows if x[0] == r.doc_id) == 1:
            assert got == by[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(by[r.doc_id])
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert nnls_packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        nnls_packing.pack(df, length=100)
    assert df.select(F.count("*")).first()[0] == len(rows)
