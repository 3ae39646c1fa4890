"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

Each block has ancestor-tag and text features. Weights are learned on labelled
pages by the gradient of the log-likelihood; Viterbi gives each page's most
likely sequence of content and other blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, table
from .html_blocks import leaf_blocks
from .html_pages import labelled_pages

#: Labelled pages that training makes, and passes over them.
TRAIN_PAGES, PASSES = 800, 200
#: A feature of blocks on fewer training pages is left out, so that beginnings of names count for rare names.
LEAST_PAGES = 12
OTHER, CONTENT = 0, 1
#: Characters of scripts that are written without spaces: Thai to Khmer, kana, Han and their full-width signs.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef]")
#: Characters that end a sentence, or a text that is a sentence in quotes or brackets.
_STOPS = ".!?:;…\"”»)。．！？：」』）।؟"


def path_features(path: tuple) -> list[str]:
    """Tags of all ancestors, the innermost one, those below an article, names with their beginnings and tags, and the nearest names."""
    out = {f"tag={path[-1][0]}" if path else "tag="}
    inside = False
    for tag, names in path:
        out.add(f"in={tag}")
        if tag in ("article", "main"):
            inside = True
        elif inside:
            out.add(f"below={tag}")
        out.update(f"name={n}" for n in names)
        out.update(f"name~{n[:5]}" for n in names)
        out.update(f"{tag}.{n}" for n in names)
    out.update(f"near={n[:5]}" for n in next((names for _, names in reversed(path) if names), ()))
    return sorted(out)


def text_features(text: str, linked: int) -> list[str]:
    """How long a block is in words (two characters are one where no spaces are written), how much of it is links, how it begins and ends."""
    unspaced = 0 if text.isascii() else len(text) - len(_UNSPACED.sub("", text))
    words = text.count(" ") + 1 + unspaced // 2
    out = [f"words={min(7, words.bit_length())}", f"links={min(4, 4 * linked // max(1, len(text)))}"]
    if text[-1] in _STOPS:
        out.append("stop")
    if text[0].isalpha() and text[0] == text[0].upper():  # letters without case too
        out.append("upper")
    if "©" in text or "·" in text or "|" in text:
        out.append("sign")
    return out


@dataclass
class Chain:
    """Weights: of each feature (for content against other), of the label before, and of the first label."""

    weight: dict[str, float]
    step: np.ndarray
    begin: np.ndarray

    def __post_init__(self):
        self._paths: dict[tuple, float] = {}

    def emission(self, path: tuple, text: str, linked: int) -> float:
        """Score of content less that of other."""
        get = self.weight.get
        if path not in self._paths:
            if len(self._paths) > 50_000:
                self._paths.clear()
            self._paths[path] = sum(get(f, 0.0) for f in path_features(path)) + get("bias", 0.0)
        return self._paths[path] + sum(get(f, 0.0) for f in text_features(text, linked))

    def decode(self, scores: list[float]) -> list[int]:
        """The most likely labels (Viterbi); other where equal."""
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.begin[0], self.begin[1] + scores[0]
        back: list[tuple[int, int]] = []
        for e in scores[1:]:
            from_a, from_b = (OTHER if a + s00 >= b + s10 else CONTENT), (OTHER if a + s01 >= b + s11 else CONTENT)
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + e
            back.append((from_a, from_b))
        label = OTHER if a >= b else CONTENT
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _padded(pages: list[list[list[int]]], labels: list[list[int]], size: int):
    """Features of each block, one after another; labels and places by (page, block)."""
    longest, n = max(map(len, pages)), len(pages)
    x = np.zeros((sum(map(len, pages)), size), np.float32)
    y, there = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    row = 0
    for i, (blocks, marks) in enumerate(zip(pages, labels, strict=True)):
        for features in blocks:
            x[row, features] = 1
            row += 1
        y[i, : len(marks)], there[i, : len(marks)] = marks, True
    return x, y, there


def _gradient(e, y, there, step, begin):
    """Expected less observed counts: for content scores, steps and first labels, by forward and backward sums."""
    n, longest = e.shape
    emit = np.stack([np.zeros_like(e), e], 2)
    forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    forward[:, 0] = begin + emit[:, 0]
    for t in range(1, longest):
        new = np.logaddexp.reduce(forward[:, t - 1, :, None] + step[None], axis=1) + emit[:, t]
        forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    for t in range(longest - 2, -1, -1):
        new = np.logaddexp.reduce(step[None] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(there[:, t + 1, None], new, 0.0)
    p = np.exp(forward + backward - total[:, None, None]) * there[..., None]
    both = there[:, 1:]
    pair = forward[:, :-1, :, None] + step + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
    pair = np.exp(np.minimum(pair, 0)) * both[..., None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    first = np.bincount(y[:, 0], minlength=2)
    return (p[..., 1] - y) * there, pair.sum((0, 1)) - seen, p[:, 0].sum(0) - first


def train(pages: list[tuple[str, list[int]]], passes: int = PASSES, l2: float = 1e-4, rate: float = 0.1, least_pages: int = LEAST_PAGES) -> Chain:
    """A chain from (html, labels of its leaf blocks), by Adam steps on the regularised log-likelihood."""
    said, labels, seen = [], [], Counter()
    for page, marks in pages:
        blocks = leaf_blocks(page)
        if len(blocks) != len(marks):
            raise ValueError(f"{len(marks)} labels for {len(blocks)} blocks")
        if blocks:
            said.append([["bias", *path_features(path), *text_features(text, linked)] for text, path, linked, _ in blocks])
            labels.append(marks)
            seen.update({f for block in said[-1] for f in block})
    if not said:
        return Chain({}, np.zeros((2, 2)), np.zeros(2))
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= min(least_pages, len(said))))}
    rows = [[[names[f] for f in block if f in names] for block in page] for page in said]
    flat, y, there = _padded(rows, labels, len(names))
    values = [np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)]
    means, squares = ([np.zeros_like(v) for v in values] for _ in range(2))
    for k in range(1, passes + 1):
        w, step, begin = values
        e = np.zeros(y.shape)
        e[there] = flat @ w.astype(np.float32)
        de, ds, db = _gradient(e, y, there, step, begin)
        for value, grad, mean, square in zip(values, (flat.T @ de[there].astype(np.float32), ds, db), means, squares, strict=True):
            grad = grad / len(rows) + l2 * value
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad**2 - square)
            value -= rate * (1 - k / (passes + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    w, step, begin = values
    return Chain({n: float(w[i]) for n, i in names.items()}, step, begin)


@lru_cache(maxsize=4)
def default_chain(pages: int = TRAIN_PAGES, seed: int = 7) -> Chain:
    """Trained on pages of html_pages, whose labels are known as they are made."""
    return train(labelled_pages(pages, seed))


def main_text(page: str | None, chain: Chain) -> str:
    """Content blocks in page order, joined by one newline; empty for null, empty or text-free pages."""
    blocks = leaf_blocks(page)
    labels = chain.decode([chain.emission(path, text, linked) for text, path, linked, _ in blocks])
    return "\n".join(b[0] for b, label in zip(blocks, labels, strict=True) if label == CONTENT)


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages; whole pages, nothing dropped or capped.

    Null html is empty; null ids and urls stay null; repeated rows give repeated
    rows; other columns are not looked at; an empty table gives none.
    """
    chain = chain or default_chain()
    parts = (chain.weight, chain.step, chain.begin)

    def run(batches):
        mine = Chain(*parts)
        for whole in batches:
            for b in slices(whole, "html"):
                texts = [main_text(p, mine) for p in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
