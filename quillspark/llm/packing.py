"""Packing documents into fixed-size training sequences: vector best-fit."""

from __future__ import annotations

import math
import string
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held, keyed, materialize, slices, table

#: Parts of words that one worker remembers.
REMEMBERED = 800_000
#: Words that are encoded in one call; more of them take longer for each.
TOGETHER = 256
#: Bytes of text whose words are looked up together.
LOOKED_UP = 32 << 20
#: Letters, and marks that may follow them: the tokenizer takes the two apart and lower-cases the letters, so forms of a word share what is encoded.
_LETTERS = string.ascii_letters + "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
_MARKS = "#$%&*|!?;:.,"
_WHOLE, _LOWER = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", "^[a-zß-öø-ÿ]+$"
#: A word of its own between the words that are encoded in one call.
MARK = "\x01"
#: Pieces that one task packs together.
GROUP_PIECES = 16_384
#: Weights of the residual tokens, document count and attention cost in a bin's score.
WEIGHTS = (1.0, 0.01, 0.01)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of words by the tokenizers library, each part of a word encoded once.

    The tokenizer turns white space into spaces and drops them, so no token
    crosses white space and a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        # lower-case letters between spaces need no more than this
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.plain.get_vocab(), self.plain.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.parts = pa.array([], pa.string())  # what the tokenizer encodes at once
        self.ids = pa.array([], pa.large_binary())  # of each part
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words: one call for all that cannot hold the mark's token, which takes the ids apart again."""
        if self.mark is None or any(MARK in w for w in words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut, raw = np.flatnonzero(ids == self.mark) * 4, ids.tobytes()
        starts, ends = np.append(0, cut + 4).tolist(), np.append(cut, len(raw)).tolist()
        return [raw[a:b] for a, b in zip(starts, ends, strict=True)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """_encode_words() of words of lower-case letters, whose last tokens take the ids apart."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut, raw = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist(), ids.tobytes()
        if len(cut) != len(words) or cut[-1] != len(raw):
            return self._encode_words(words)
        return [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def _part_ids(self, parts: pa.Array) -> pa.Array:
        """Ids of distinct parts; those of this call stay when too many are remembered."""
        at = pc.index_in(parts, value_set=self.parts)
        new = parts.filter(pc.is_null(at))
        if len(new):
            letters = pc.match_substring_regex(new, pattern=_LOWER)
            names, found = [self.parts], [self.ids]
            for flag, encode in ((letters, self._encode_letters), (pc.invert(letters), self._encode_words)):
                some = new.filter(flag)
                names.append(some)
                for k in range(0, len(some), TOGETHER):
                    found.append(pa.array(encode(some.slice(k, TOGETHER).to_pylist()), pa.large_binary()))
            self.parts, self.ids = pa.concat_arrays(names), pa.concat_arrays(found)
            at = pc.index_in(parts, value_set=self.parts)
        ids = self.ids.take(at)
        if len(self.parts) > REMEMBERED:
            self.parts, self.ids = parts, ids
        return ids

    def encode(self, texts: pa.Array) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        stems = pc.utf8_rtrim(words, characters=_MARKS)
        whole = pc.match_substring_regex(stems, pattern=_WHOLE)
        heads = pc.if_else(whole, pc.utf8_lower(stems), words)
        tails = pc.if_else(whole, pc.utf8_ltrim(words, characters=_LETTERS), "")
        parts = pa.concat_arrays([heads, tails]).dictionary_encode()
        ids = self._part_ids(parts.dictionary).take(parts.indices)
        ids = pc.binary_join_element_wise(ids.slice(0, len(words)), ids.slice(len(words)), pa.scalar(b"", pa.large_binary()))
        said = ids.take(coded.indices)
        ends = np.frombuffer(said.buffers()[1], np.int64)[: len(said) + 1] if len(said) else np.zeros(1, np.int64)
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends[borders]), said.buffers()[2] or pa.py_buffer(b"")])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """encode() of texts in a list."""
        return self.encode(pa.array(texts, pa.string())).to_pylist()


def _words(path: str) -> WordIds:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core
    return held(("words", path), lambda: WordIds(path))


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut only where longer than capacity."""
    path = path or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        model = _words(path)
        for whole in batches:
            for b in slices(whole, most=LOOKED_UP):
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(b.column(0).to_pylist(), model.encode(b.column(1)), strict=True):
                    ids = ids.as_py() + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def vector_best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in decreasing length.

    An item asks for (tokens, 1 document, tokens**2 attention cost). Among the
    bins that can take it under every capacity, rule "norm" picks the one whose
    weighted residual after it has the least norm, "dot" the one whose residual
    has the largest weighted dot-product with the item; ties go to the oldest bin.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule must be norm or dot, not {rule!r}")
    caps, w = np.array(capacities, float), np.array(weights, float)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((3, max(1, len(lengths))))  # residuals of open bins, by capacity
    number = np.empty(max(1, len(lengths)), np.int64)
    used: list[int] = []
    n_open = 0
    least = float(lengths.min()) if len(lengths) else 0.0
    for i in order:
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        at = -1
        if n_open:
            r = left[:, :n_open]
            fits = np.flatnonzero((r[0] >= need[0]) & (r[1] >= need[1]) & (r[2] >= need[2]))
            if fits.size:
                r = r[:, fits]
                if rule == "norm":
                    score = sum(w[k] * ((r[k] - need[k]) / caps[k]) ** 2 for k in range(3))
                else:
                    score = -sum(w[k] * (r[k] / caps[k]) * (need[k] / caps[k]) for k in range(3))
                at = int(fits[np.argmin(score)])
        if at < 0:
            if (need > caps).any():
                raise ValueError("an item is larger than a bin")
            at = n_open
            left[:, at], number[at] = caps, len(used)
            used.append(0)
            n_open += 1
        b = int(number[at])
        bins[i], offsets[i] = b, used[b]
        used[b] += int(size)
        left[:, at] -= need
        if (left[:, at] < (least, 1.0, least * least)).any():  # nothing fits any more: closed; the others keep their order
            left[:, at : n_open - 1] = left[:, at + 1 : n_open].copy()
            number[at : n_open - 1] = number[at + 1 : n_open].copy()
            n_open -= 1
    return bins, offsets


def pack(cut: DataFrame, capacity: int = 2048, max_documents: int | None = None, max_attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces(); every row is placed.

    The pieces are dealt by a hash of their id and of where they were read into groups
    of about group_pieces, so many pieces of one id or of none are spread too, and each
    group wastes at most its last bins.
    Without limits of their own, document count and attention cost bind no
    earlier than tokens. No piece may be longer than capacity, and none may
    exceed max_attention alone. An empty table gives an empty table.
    """
    rows = materialize(cut, "pieces")
    groups = max(1, math.ceil(rows.count() / group_pieces))
    capacities = (capacity, max_documents or capacity, max_attention or capacity * capacity)

    def place(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = vector_best_fit(part["length"].to_numpy(), capacities, rule, weights)
        part["sequence_id"] = (np.int64(key[0]) << np.int64(32)) + bins
        part["offset"] = offsets
        return part.drop(columns="pack_group")

    dealt = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInPandas(place, schema)


def best_fit_packing(docs: DataFrame, capacity: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null and empty texts are one piece that holds the end id alone; a null id
    stays null; repeated rows are packed as often as they are there.
    """
    return pack(pieces(docs, capacity, path, 0, id_col, text_col), capacity, **limits)


def op9_best_fit_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"))
