"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

Pieces of text (pre-tokens) are independent of each other, so each worker
encodes a piece once and remembers its ids. Unseen pieces are merged together:
every piece is a row of a matrix of symbols, and its row of a second matrix is a
segment tree whose leaves are the ranks of adjacent pairs. The root is the
leftmost lowest-rank pair; a merge changes three leaves and the nodes above them.
Where few pieces are as long, each has a tree of its own in plain integers.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import held, keyed, slices, table

#: Fixed values of byte-level BPE: how text is cut into pieces before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces remembered by one worker.
REMEMBERED = 700_000
#: Symbols that are merged together at once.
TOGETHER = 1 << 20
#: Fewer pieces of one width are merged one by one: a step over a matrix costs as much as so many single merges.
FEW = 32

NONE = int(np.iinfo(np.int64).max)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A vocabulary with its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: np.uint32(t["id"]).tobytes() for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.rank_of = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank, self.becomes = dict(zip(key.tolist(), range(len(key)), strict=True)), self.merged.tolist()
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it does not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def plant(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The segment tree of each row of symbols; leaf i is the rank of the pair that starts at symbol i, above the place i."""
        n, width = symbols.shape
        flat, tree = symbols.reshape(-1), np.full(n * 2 * width, NONE)
        pairs = np.flatnonzero((np.arange(width)[None, :] < lengths[:, None] - 1).reshape(-1))
        rank = self.ranks(flat[pairs], flat[pairs + 1])
        found = rank >= 0
        row, place = np.divmod(pairs[found], width)
        tree[row * 2 * width + width + place] = rank[found] << 32 | place
        level, nodes = width // 2, tree.reshape(n, 2 * width)
        while level:
            np.minimum(nodes[:, 2 * level : 4 * level : 2], nodes[:, 2 * level + 1 : 4 * level : 2], out=nodes[:, level : 2 * level])
            level //= 2
        return tree

    def merge_one(self, symbols: np.ndarray) -> np.ndarray:
        """Merge one row of symbols; what is left of them."""
        n = len(symbols)
        width = 1 << max(1, (n - 1).bit_length())
        padded = np.full((1, width), -1, np.int64)
        padded[0, :n] = symbols
        tree = array("q", self.plant(padded, np.array([n])).tobytes())
        flat, right, left = (array("q", x.astype(np.int64).tobytes()) for x in (symbols, np.arange(1, n + 1), np.arange(-1, n - 1)))
        rank, becomes, size = self.rank.get, self.becomes, self.size

        def update(place: int, value: int) -> None:
            node = width + place
            while tree[node] != value:
                tree[node] = value
                if node == 1:
                    return
                beside = tree[node ^ 1]
                node >>= 1
                if beside < value:
                    value = beside

        def renew(place: int, after: int) -> None:
            r = rank(flat[place] * size + flat[after])
            update(place, NONE if r is None else r << 32 | place)

        while (root := tree[1]) != NONE:
            at = root & 0xFFFFFFFF
            gone = right[at]
            after = right[at] = right[gone]
            flat[at], flat[gone] = becomes[root >> 32], -1
            update(gone, NONE)
            if after < n:
                left[after] = at
                renew(at, after)
            else:
                update(at, NONE)
            if left[at] >= 0:
                renew(left[at], at)
        out = np.frombuffer(flat, np.int64)
        return out[out >= 0]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merge each row of symbols (as wide as a power of two, filled up with -1) in place.

        A symbol that a merge has taken up becomes -1.
        """
        n, width = symbols.shape
        flat, tree = symbols.reshape(-1), self.plant(symbols, lengths)
        column = np.arange(width)
        right = np.tile(np.minimum(column + 1, width), n)
        left = np.tile(column - 1, n)

        def update(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            base, node = row * 2 * width, width + place
            tree[base + node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])

        def leaf(first: np.ndarray, second: np.ndarray, place: np.ndarray) -> np.ndarray:
            rank = self.ranks(first, second)
            return np.where(rank >= 0, rank << 32 | place, NONE)

        rows = np.arange(n)
        while True:
            root = tree[rows * 2 * width + 1]
            live = root != NONE
            rows, root = rows[live], root[live]
            if not rows.size:
                return symbols
            at, base = root & 0xFFFFFFFF, rows * width
            gone = right[base + at]
            after = right[base + gone]
            flat[base + at] = self.merged[root >> 32]
            flat[base + gone] = -1
            right[base + at] = after
            has = (after < width) & (flat[base + np.minimum(after, width - 1)] >= 0)
            left[(base + after)[has]] = at[has]
            update(rows, gone, np.full(len(rows), NONE))
            update(rows, at, np.where(has, leaf(flat[base + at], flat[base + np.minimum(after, width - 1)], at), NONE))
            before = left[base + at]
            has = before >= 0
            r, p = rows[has], before[has]
            update(r, p, leaf(flat[r * width + p], flat[r * width + at[has]], p))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each non-empty piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        widths = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for width in np.unique(widths):
            mine = np.flatnonzero(widths == width)
            if len(mine) < FEW:
                for i in mine.tolist():
                    out[i] = self.merge_one(self.byte_id[np.frombuffer(pieces[i], np.uint8)]).astype("<u4").tobytes()
                continue
            step = max(1, TOGETHER // int(width))
            for k in range(0, len(mine), step):
                some = mine[k : k + step]
                raw = np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)
                n = lengths[some]
                filled = np.arange(width)[None, :] < n[:, None]
                symbols = np.full((len(some), int(width)), -1, np.int64)
                symbols[filled] = self.byte_id[raw]
                self.merge(symbols, n)
                kept = symbols >= 0
                ids = symbols[kept].astype("<u4").tobytes()
                ends = np.cumsum(kept.sum(1)) * 4
                start = 0
                for i, end in zip(some.tolist(), ends.tolist(), strict=True):
                    out[i] = ids[start:end]
                    start = end
        return out

    def _learn(self, units: set[str], pieces: set[str]) -> None:
        """Remember these. A unit is the text between two single spaces, with the space before it."""
        new = units - self.units.keys()
        if len(self.units) + len(new) > REMEMBERED:
            self.units.clear()
            new = set(units)
        cut = {u: PIECES.findall(" " + u) for u in new if not (u.isascii() and u.isalpha())}
        parts = {p for ps in cut.values() for p in ps}
        # a piece with one space before it is a unit of its own
        new.difference_update(cut)
        new.update(p[1:] for p in parts if p[0] == " " and not p[1:2].isspace() and len(p) > 1)
        new.difference_update(self.units)
        pieces = pieces | {p for p in parts if p[0] != " " or p[1:2].isspace() or len(p) == 1}
        if len(self.pieces) > REMEMBERED // 4:
            self.pieces.clear()
        alone, bare = list(new), [p for p in pieces if p not in self.pieces]
        ids = self.encode_pieces([b" " + u.encode() for u in alone] + [p.encode() for p in bare])
        self.units.update(zip(alone, ids))
        self.pieces.update(zip(bare, ids[len(alone) :], strict=True))
        for u, ps in cut.items():
            self.units[u] = b"".join([self.pieces[p] if p in self.pieces else self.units[p[1:]] for p in ps])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit.

        Where each run of white space that has a space in front of a word is
        just that space, the text can be cut at its spaces; any other text, and
        one with a special token, is cut by the pattern.
        """
        quick: dict[int, list[str]] = {}
        slow: dict[int, list] = {}
        wanted: set[str] = set()
        pieces: set[str] = set()
        for i, text in enumerate(texts):
            parts = text.split(" ")
            if "" in parts or self.cut.search(text):
                segments, last = [], 0
                for m in self.cut.finditer(text):
                    segments += [PIECES.findall(text[last : m.start()]), self.special[m.group()]]
                    last = m.end()
                segments.append(PIECES.findall(text[last:]))
                slow[i] = segments
                for s in segments:
                    if isinstance(s, list):
                        pieces.update(s)
            else:
                quick[i] = parts
                wanted.update(parts[1:])
                pieces.update(PIECES.findall(parts[0]))
        self._learn(wanted, pieces)
        out = [b""] * len(texts)
        unit, piece = self.units.__getitem__, self.pieces.__getitem__
        for i, parts in quick.items():
            out[i] = b"".join(map(piece, PIECES.findall(parts[0]))) + b"".join(map(unit, parts[1:]))
        for i, segments in slow.items():
            out[i] = b"".join(s if isinstance(s, bytes) else b"".join(map(piece, s)) for s in segments)
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids; special tokens as their strings."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def vocabulary(path: str) -> BytePairs:
    """The vocabulary of this worker, read once."""
    return held(("bpe", path), lambda: BytePairs(path))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; a null id stays null; repeated rows give
    repeated rows, an empty table none. Other columns are not looked at.
    """
    path = path or default_vocabulary()

    def run(batches):
        model = vocabulary(path)
        for whole in batches:
            for b in slices(whole):
                ids = model.encode_batch([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of what encode() gives; null ids give a null text."""
    path = path or default_vocabulary()

    def run(batches):
        model = vocabulary(path)
        for b in batches:
            texts = [None if x is None else model.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_columns(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes without writing either down."""
    path = path or default_vocabulary()

    def run(batches):
        model = vocabulary(path)
        for whole in batches:
            for b in slices(whole):
                ids = model.encode_batch([t or "" for t in b.column(1).to_pylist()])
                columns = [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir):
    return digest_columns(table(spark, sf_dir, "documents"))
