"""Substring deduplication with repeated-phrase automata.

1. Winnowing picks phrases of PHRASE words so that every window of WINDOW words
   holds at least one, chosen by the window's own words alone. A phrase that two
   documents picked is confirmed as recurring. Only the phrases themselves are
   kept, as one code for each word, not where they stand.
2. The confirmed phrases are dealt in shards. A shard serves about 1 MB of
   documents: it compiles all phrases that any of these may have into one
   Aho-Corasick automaton over word codes and streams every one of the documents
   through it. The hits say where the phrases occur; nothing else does.
3. A window belongs to the located phrase of least hash in it. The windows of
   one occurrence are a cell. Equal cells are settled by the smallest document
   that has them. Where a phrase stands in unequal cells, the windows of each
   cell's first document are compared one by one.

Two documents that share a window picked the same phrase in it, so both shards
hold it, both documents locate it and put the window under it: every shared
window is found. Words that share a code can only add hits, never hide one.
Windows count as equal when two independent 64-bit hashes, of the window and of
its phrase, are.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keyed, let_go, materialize, slices, table
from ._words import U, batch_words, mix, sequence_hash, split_words

WINDOW = 50
PHRASE = 8

_PLACE_BITS = 24  # the hash bits above them order phrases
_PLACE = U((1 << _PLACE_BITS) - 1)
_MOST = U((1 << 64) - 1)
#: Codes of words: characters below the surrogates, 0 left out.
_CODES = U(0xD7FF)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(values[i : i + width]); shorter by width - 1."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


class _Slice:
    """Phrase and window hashes of a slice of documents."""

    def __init__(self, texts: pa.Array, window: int, phrase: int):
        self.words = batch_words(texts)
        self.window, self.phrase = window, phrase
        self.prefix = self.words.prefix()
        n = len(self.words.hashes)
        at = np.arange(max(0, n - phrase + 1))
        self.phrases = sequence_hash(self.prefix, at, at + phrase)
        starts = np.arange(max(0, n - window + 1))
        # windows that stay inside one document
        self.whole = self.words.doc[starts] == self.words.doc[starts + window - 1] if len(starts) else np.zeros(0, bool)

    def order(self) -> np.ndarray:
        """Phrases by hash, leftmost first where equal; place() undoes it."""
        key = mix(self.phrases) & ~_PLACE
        self._by = None
        if len(key) < 1 << _PLACE_BITS:
            return key | np.arange(len(key)).astype(U)
        self._by = np.argsort(key, kind="stable")  # the same order where a place does not fit in beside the hash
        out = np.empty(len(key), U)
        out[self._by] = np.arange(len(key)).astype(U)
        return out

    def place(self, order: np.ndarray) -> np.ndarray:
        return (order & _PLACE).astype(np.int64) if self._by is None else self._by[order.astype(np.int64)]

    def codes(self) -> np.ndarray:
        """A character for each word, equal words alike."""
        return (mix(self.words.hashes) % _CODES + U(1)).astype(np.uint16)

    def owner(self, order: np.ndarray) -> np.ndarray:
        """The least entry among the phrases of each window."""
        return _sliding_min(order, self.window - self.phrase + 1) if len(self.whole) else np.zeros(0, U)


def with_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "part") -> DataFrame:
    """docs with part_col, which tells the texts of one id apart: the text's hash where rows share the id, else 0."""
    row_id, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    shared = docs.where(row_id.isNotNull()).groupBy(row_id.alias("_shared_id")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_shared_id")
    shared = materialize(shared, "shared-ids")
    if not shared.limit(1).count():
        return docs.withColumn(part_col, F.lit(0).cast("long"))
    part = F.when(F.col("_shared_id").isNotNull(), F.xxhash64(text)).otherwise(F.lit(0)).alias(part_col)
    return docs.join(shared, row_id == F.col("_shared_id"), "left").select(*docs.columns, part)


def picked_phrases(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(codes, doc_id, part) of each winnowed phrase of documents (doc_id, part, text): its words' codes, 16 bits each."""

    def run(batches):
        let_go()
        for whole in batches:
            for b in slices(whole):
                s = _Slice(b.column(2), window, phrase)
                at = s.place(np.unique(s.owner(s.order())[s.whole]))
                doc = s.words.doc[at]
                ids, parts = (b.column(k).to_numpy(zero_copy_only=False)[doc] for k in (0, 1))
                codes = s.codes()[at[:, None] + np.arange(phrase)] if len(at) else np.zeros(0, np.uint16)
                ends = np.arange(len(at) + 1, dtype=np.int32) * 2 * phrase
                packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([packed, pa.array(ids).cast(pa.int64()), pa.array(parts).cast(pa.int64())], ["codes", "doc_id", "part"])

    return docs.mapInArrow(run, "codes binary, doc_id long, part long")


def recurring_phrases(picked: DataFrame) -> DataFrame:
    """Phrases that at least two documents picked."""
    ends = picked.groupBy("codes").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return ends.where("a < b").select("codes")


def compiled(phrases) -> ahocorasick.Automaton:
    """The shard's automaton: phrases of word codes."""
    machine = ahocorasick.Automaton()
    for codes in phrases:
        machine.add_word(codes.decode("utf-16-le"), len(codes) // 2)
    machine.make_automaton()
    return machine


def occurrences(machine: ahocorasick.Automaton, codes: np.ndarray) -> np.ndarray:
    """Where the automaton's phrases start in one document's words."""
    hits = [end - n + 1 for end, n in machine.iter(codes.tobytes().decode("utf-16-le"))] if len(machine) else []
    return np.array(hits, np.int64)


def locate(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Cells of every document: (phrase, cell, doc_id, part, start, n, windows).

    docs has doc_id, part, text and phrases, the recurring phrases that the document
    may have (null: none of its own). A cell is n windows from word start on; windows
    holds their hashes.
    """

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                s = _Slice(b.column(2), window, phrase)
                machine = compiled({p for row in b.column(3).to_pylist() if row for p in row})
                codes, first = s.codes(), s.words.first.tolist()
                found = [i + occurrences(machine, codes[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
                at = np.concatenate(found) if found else np.zeros(0, np.int64)
                order = np.full(len(s.phrases), _MOST)
                order[at] = s.order()[at]
                owner = s.owner(order)
                start = np.flatnonzero(s.whole & (owner != _MOST)) if len(owner) else np.zeros(0, np.int64)
                own = s.place(owner[start])
                hashes = sequence_hash(s.prefix, start, start + window)
                new = np.ones(len(start), bool)
                new[1:] = (np.diff(start) != 1) | (np.diff(own) != 0) | (np.diff(s.words.doc[start]) != 0)
                lo = np.flatnonzero(new)
                n = np.diff(np.append(lo, len(start)))
                begin, place = start[lo], own[lo]
                cell = sequence_hash(s.prefix, begin, begin + n + window - 1) ^ mix((place - begin).astype(U) * U(1 << 32) + n.astype(U))
                doc = s.words.doc[begin]
                ids, parts = (b.column(k).to_numpy(zero_copy_only=False)[doc] for k in (0, 1))
                packed = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(np.append(lo * 8, len(start) * 8).astype(np.int32)), pa.py_buffer(hashes.tobytes())])
                columns = [pa.array(s.phrases[place].view(np.int64)), pa.array(cell.view(np.int64)), pa.array(ids).cast(pa.int64()), pa.array(parts).cast(pa.int64()), pa.array((begin - s.words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), packed]
                yield pa.RecordBatch.from_arrays(columns, ["phrase", "cell", "doc_id", "part", "start", "n", "windows"])

    return docs.mapInArrow(run, "phrase long, cell long, doc_id long, part long, start int, n int, windows binary")


def _windows(cells: DataFrame) -> DataFrame:
    """(phrase, window, doc_id, part, start) of each window of cells."""

    def run(batches):
        for b in batches:
            n = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = np.frombuffer(b"".join(b.column(5).to_pylist()), np.int64)
            first = np.repeat(np.cumsum(n) - n, n)
            phrase, doc, part, start = (np.repeat(b.column(k).to_numpy(zero_copy_only=False), n) for k in range(4))
            columns = [phrase, hashes, doc, part, (start + np.arange(len(hashes)) - first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["phrase", "window", "doc_id", "part", "start"])

    return cells.select("phrase", "doc_id", "part", "start", "n", "windows").mapInArrow(run, "phrase long, window long, doc_id long, part long, start int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, part, start, length) in words: spans covered by windows that a smaller doc_id has too.

    docs has doc_id, text and part (see with_parts), which only says whose words a
    span counts.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "part", F.coalesce("text", F.lit("")).alias("text"))
    picked = materialize(picked_phrases(docs, window, phrase), "picked")
    recurring = materialize(recurring_phrases(picked), "recurring")
    mine = picked.join(recurring, "codes").groupBy("doc_id", "part").agg(F.collect_set("codes").alias("phrases"))
    cells = materialize(locate(docs.join(mine, ["doc_id", "part"], "left").select("doc_id", "part", "text", "phrases"), window, phrase), "cells")

    firsts = cells.groupBy("phrase", "cell").agg(F.min("doc_id").alias("first_doc"))
    firsts = materialize(firsts, "firsts")
    several = firsts.groupBy("phrase").agg((F.min("cell") != F.max("cell")).alias("several")).where("several").select("phrase")
    several = materialize(several, "several")
    with_first = cells.join(firsts, ["phrase", "cell"])
    settled = with_first.where("first_doc < doc_id").select("doc_id", "part", "start", (F.col("n") + F.lit(window - 1)).alias("length"))

    opened = with_first.where("first_doc = doc_id").select(*cells.columns).join(several, "phrase")
    windows = materialize(_windows(opened), "windows")
    shared = windows.groupBy("phrase", "window").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    shared = materialize(shared.where("first_doc < last_doc").select("phrase", "window", "first_doc"), "shared")
    single = windows.join(shared, ["phrase", "window"]).where("first_doc < doc_id").select("doc_id", "part", "start", F.lit(window).alias("length"))
    return settled.unionByName(single)


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    docs = with_parts(docs)
    spans = repeated_spans(docs, window, phrase).groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    return docs.join(spans, ["doc_id", "part"], "left").select("doc_id", "text", "spans")


def _kept(text: str | None, spans) -> tuple[list[str], int]:
    """Words that stay, and how many went."""
    words = split_words(text or "")
    if not spans:
        return words, 0
    kept, last = [], 0
    for a, b in _merged((s["start"], s["length"]) for s in spans):
        kept += words[last:a]
        last = b
    kept += words[last:]
    return kept, len(words) - len(kept)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per row of docs.

    Removes each word covered by a window of `window` words that also starts in
    a document with a smaller id. Words are split at space and 0x09-0x0D; the
    kept ones are joined by one space. Null and empty texts have no words. Rows
    without id take part in nothing and stay whole. Rows that share an id count
    as one document: they never remove each other's words, but each loses only
    what its own text repeats. An empty table gives an empty table.
    """

    def run(batches):
        for b in batches:
            done = [_kept(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [b.column(0), pa.array([len(k) + n for k, n in done], pa.int64()), pa.array([n for _, n in done], pa.int64()), pa.array([" ".join(k) for k, _ in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text"])

    return _with_spans(keyed(docs, id_col, text_col), window, phrase).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """docs without the repeated passages: text_col and chars_col are the new text's, other columns stay.

    A text from which nothing goes stays as it is, white space included; of any
    other the kept words are joined by one space. A row goes if all its words went.
    """
    parted = with_parts(docs, id_col, text_col, "_part")
    named = parted.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("_part").alias("part"), F.col(f"`{text_col}`").alias("text"))
    spans = repeated_spans(named, window, phrase).groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": id_col, "part": "_part", "spans": "_repeated_spans"})
    rows = parted.join(spans, [id_col, "_part"], "left").select(*docs.columns, "_repeated_spans")
    names = docs.columns
    at, chars = names.index(text_col), names.index(chars_col)

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                texts, keep = b.column(at).to_pylist(), []
                for i, spans in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    keep.append(True)
                    if spans:
                        words, _ = _kept(texts[i], spans)
                        texts[i], keep[i] = " ".join(words), bool(words)
                columns = list(b.columns[:-1])
                columns[at] = pa.array(texts, pa.string())
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)


def digest_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """substring_dedup() with the digest of the kept text in its place."""

    def run(batches):
        for b in batches:
            done = [_kept(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            sha = [hashlib.sha256(" ".join(k).encode()).hexdigest() for k, _ in done]
            columns = [b.column(0), pa.array([len(k) + n for k, n in done], pa.int64()), pa.array([n for _, n in done], pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(keyed(docs, id_col, text_col), window, phrase).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op3_substring_dedup(spark, sf_dir):
    return digest_columns(table(spark, sf_dir, "documents"))
