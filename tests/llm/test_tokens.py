import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe, packing

from .cases import by_id, frame, odd_rows

MODEL, LIBRARY = bpe.BytePairs(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
WORDS, WORD_LIBRARY = packing.WordIds(packing.default_vocabulary()), Tokenizer.from_file(packing.default_vocabulary())
TEXTS = st.text(st.characters(exclude_categories=["Cs"]))
PARTS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "é", "1", "'s", ".", "\x1d", "　", " ", "Σ", "́", "\x01", "<|endoftext|>", "<|startoftext|>", "<|", "\U0001f642"]), max_size=20).map("".join)


def ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXTS, PARTS))
def test_bpe_is_the_library(text):
    (mine,) = MODEL.encode_batch([text])
    assert mine == ids(LIBRARY, text)
    assert MODEL.decode(mine) == LIBRARY.decode(np.frombuffer(mine, "<u4").tolist(), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXTS, PARTS))
def test_words_are_the_library(text):
    assert WORDS.encode_batch([text]) == [ids(WORD_LIBRARY, text)]


@pytest.mark.parametrize("piece", [b"a", b"ab", b" the", b"aaaa", b"x" * 4097, bytes(range(256)) * 3])
def test_segment_tree_picks_leftmost_lowest_rank(piece):
    """Against a scan for the best pair after every merge."""
    symbols = [int(MODEL.byte_id[b]) for b in piece]
    while len(symbols) > 1:
        rank = MODEL.ranks(np.array(symbols[:-1]), np.array(symbols[1:]))
        if (rank < 0).all():
            break
        best = int(np.argmin(np.where(rank < 0, 1 << 40, rank)))
        symbols[best : best + 2] = [int(MODEL.merged[rank[best]])]
    assert MODEL.encode_pieces([piece]) == [np.array(symbols, "<u4").tobytes()]


@pytest.mark.parametrize("few", [0, 1, 1000])
def test_pieces_alone_and_together_merge_alike(monkeypatch, few):
    monkeypatch.setattr(bpe, "FEW", few)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("etaoinshr"), n)) for n in (1, 2, 3, 5, 64, 65, 700, 701)]
    assert bpe.BytePairs(bpe.default_vocabulary()).encode_batch(texts) == [ids(LIBRARY, t) for t in texts]


def test_one_very_long_piece():
    """Letters without any space: one piece, with as many merges as it has letters."""
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("etaoinshrdlué"), 40_000))
    began = time.process_time()
    (mine,) = MODEL.encode_batch([text])
    assert time.process_time() - began < 5
    assert mine == ids(LIBRARY, text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    texts = ["one two three four, five", "six seven\neight one two", "nine  ten one"] * 3
    small, words = bpe.BytePairs(bpe.default_vocabulary()), packing.WordIds(packing.default_vocabulary())
    for _ in range(2):
        for t in texts:
            assert small.encode_batch([t]) == [ids(LIBRARY, t)]
            assert words.encode_batch([t]) == [ids(WORD_LIBRARY, t)]


def test_words_cost_a_sixth_of_the_library():
    """CPU time over many words and their forms, the lesser of two runs."""
    rng = np.random.default_rng(7)
    parts = ["the", "of", "de", "tion", "er", "ing", "sch", "lich", "aux", "ción", "é", "en", "re", "at", "ou", "ver"]
    words = ["".join(rng.choice(parts, rng.integers(1, 6))) for _ in range(40_000)]
    texts = [" ".join(w.capitalize() + "." if i % 9 == 0 else w for i, w in enumerate(rng.choice(words, 600))) for _ in range(1000)]

    def least(encode):
        took = []
        for _ in range(2):
            began = time.process_time()
            out = encode()
            took.append(time.process_time() - began)
        return min(took), out

    library, want = least(lambda: [np.array(e.ids, "<u4").tobytes() for e in WORD_LIBRARY.encode_batch_fast(texts, add_special_tokens=False)])
    models = [packing.WordIds(packing.default_vocabulary()) for _ in range(2)]
    mine, got = least(lambda: models.pop().encode_batch(texts))
    assert got == want and 6 * mine < library


def test_words_of_many_texts_are_the_library():
    """Texts of one call, null and empty ones among them, of an array that begins elsewhere."""
    texts = ["left out", None, "", " \t", "One,two! ÉTÉ?! ß ñandú|", "a\x1cb a\xa0b \x0b\x0cc\r\n", "ONE one One; !? x&y", None, "don't DON'T '\u017f 3rd \x01 ;", "e\u0301 é ÿŸ ×÷"]
    got = packing.WordIds(packing.default_vocabulary()).encode(pa.array(texts).slice(1))
    assert got.to_pylist() == [ids(WORD_LIBRARY, t or "") for t in texts[1:]]
    assert packing.WordIds(packing.default_vocabulary()).encode(pa.array([], pa.string())).to_pylist() == []


def test_bpe_odd_rows(spark):
    rows = odd_rows()
    want = []
    for i, t in rows:
        raw = ids(LIBRARY, t or "")
        text = LIBRARY.decode(np.frombuffer(raw, "<u4").tolist(), skip_special_tokens=False)
        want.append((i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    df = frame(spark, rows)
    assert by_id(bpe.digest_columns(df)) == sorted(want, key=repr)
    assert by_id(bpe.decode(bpe.encode(df))) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert bpe.digest_columns(frame(spark, [])).count() == 0


def test_packing_odd_rows(spark):
    rows = odd_rows()
    out = packing.best_fit_packing(frame(spark, rows)).toPandas()
    want = []
    for i, t in rows:
        raw = ids(WORD_LIBRARY, t or "") + b"\0\0\0\0"
        want += [(i, k, at // 4, len(raw[at : at + 8192]) // 4, zlib.crc32(raw[at : at + 8192])) for k, at in enumerate(range(0, len(raw), 8192))]
    got = [(None if d != d or d is None else int(d), int(p), int(s), int(n), int(c)) for d, p, s, n, c in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    large = {float(2**62): 2**62}
    assert sorted(((large.get(x[0], x[0]), *x[1:]) for x in got), key=repr) == sorted(want, key=repr)
    _gapless(out, 2048)
    assert packing.best_fit_packing(frame(spark, [])).count() == 0


def _gapless(out, capacity):
    for _, part in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        ends = part["length"].cumsum()
        assert (part["offset"] == ends - part["length"]).all() and ends.max() <= capacity


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("documents", "attention"), [(10**6, 10**12), (3, 10**12), (10**6, 5_000)])
def test_every_capacity_holds(rule, documents, attention):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 70, 500)
    bins, offsets = packing.vector_best_fit(lengths, (100, documents, attention), rule)
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 100 and len(mine) <= documents and (mine.astype(int) ** 2).sum() <= attention
        assert sorted(offsets[bins == b]) == sorted(np.cumsum(np.sort(mine)[::-1]) - np.sort(mine)[::-1]) or len(set(offsets[bins == b])) == len(mine)
    # no two bins could be one
    loads = [(lengths[bins == b].sum(), (bins == b).sum(), (lengths[bins == b].astype(int) ** 2).sum()) for b in np.unique(bins)]
    if documents > 3 and attention > 5_000:
        assert sum(x[0] <= 50 for x in loads) <= 1
        assert len(loads) <= np.ceil(lengths.sum() / 100) * 1.03 + 1


def test_few_sequences(spark):
    rows = [(i, "word " * (1 + i * 37 % 1500)) for i in range(400)]
    out = packing.best_fit_packing(frame(spark, rows)).toPandas()
    _gapless(out, 2048)
    assert out["sequence_id"].nunique() <= np.ceil(out["length"].sum() / 2048) + 2


def test_an_item_above_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([101]), (100, 1, 10**6))
