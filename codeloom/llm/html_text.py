"""HTML extraction from flat text blocks.

A page is cut into blocks at block-level tags.  Word count and link density of a
block and of its two neighbours are the features (Kohlschütter et al., 2010); a
decision tree, grown here on the blocks of the small labelled table, says which
blocks are content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.html_labels import PAGES, fill

_BLOCK = frozenset(
    "address article aside blockquote body br center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split()
)
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?>(?:[^<>"']+|"[^"]*"|'[^']*')*))>|<[/!?a-zA-Z][^>]*>""")


def blocks(page: str | None) -> list[tuple[str, int, float]]:
    """(text, words, link density) of each text block of a page."""
    parts = _TAG.split(_SKIP.sub(" ", page or ""))
    out: list[tuple[str, int, float]] = []
    text, words, linked, link = [], 0, 0, False
    for k in range(0, len(parts), 4):
        if k:
            tag = (parts[k - 2] or "").lower()
            if tag == "a":
                link = not parts[k - 3]
            elif tag in _BLOCK and words:
                out.append((" ".join(text), words, linked / words))
                text, words, linked = [], 0, 0
        own = html.unescape(parts[k]).split()
        if own:
            text += own
            words += len(own)
            linked += len(own) * link
    if words:
        out.append((" ".join(text), words, linked / words))
    return out


def features(found: list[tuple[str, int, float]]) -> np.ndarray:
    own = np.array([(0, 0.0), *((w, d) for _, w, d in found), (0, 0.0)])
    return np.hstack([own[:-2], own[1:-1], own[2:]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 3, least: int = 3) -> list[tuple]:
    """A decision tree by Gini impurity: nodes (feature, threshold, left, right), leaves (-1, share, 0, 0)."""
    nodes: list[tuple] = []

    def node(at: np.ndarray, left: int) -> int:
        k = len(nodes)
        share = float(y[at].mean()) if len(at) else 0.0
        nodes.append((-1, share, 0, 0))
        best = None
        if left and 0 < share < 1:
            for f in range(x.shape[1]):
                v = np.unique(x[at, f])
                for t in (v[1:] + v[:-1]) / 2:
                    low = x[at, f] <= t
                    a, b = at[low], at[~low]
                    if min(len(a), len(b)) >= least:
                        cost = sum(len(z) * y[z].mean() * (1 - y[z].mean()) for z in (a, b))
                        if best is None or cost < best[0] - 1e-12:
                            best = cost, f, float(t), a, b
        if best:
            _, f, t, a, b = best
            nodes[k] = (f, t, node(a, left - 1), node(b, left - 1))
        return k

    node(np.arange(len(x)), depth)
    return nodes


def labelled(pages: list[list[tuple[int, str]]] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """(features, label) of each block of labelled pages."""
    x, y = [np.zeros((0, 6))], [np.zeros(0)]
    for page in pages:
        x.append(features(blocks(fill("".join(html for _, html in page)))))
        y.append(np.concatenate([np.full(len(blocks(fill(html))), label) for label, html in page]))
        if len(x[-1]) != len(y[-1]):
            raise ValueError("a labelled piece of HTML that isn't a block of its own")
    return np.concatenate(x), np.concatenate(y)


def train(pages: list[list[tuple[int, str]]] = PAGES) -> list[tuple]:
    return grow(*labelled(pages))


def classify(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    feature, value, left, right = (np.array(c) for c in zip(*tree))
    while (feature[at] >= 0).any():
        inner = feature[at] >= 0
        low = x[np.arange(len(x)), feature[at]] <= value[at]
        at = np.where(inner, np.where(low, left[at], right[at]), at)
    return value[at] >= 0.5


def extract(pages: DataFrame, tree: list[tuple] | None = None) -> DataFrame:
    """(page_id, text, n_blocks, n_kept) of each row; text holds the content blocks, a line each.

    Null and empty pages, and pages without text, give an empty text and no
    blocks; scripts, styles and comments are never text, and tags that don't
    close are read as far as they go.  Rows are read one by one: repeated rows
    repeat, a null id stays null, an empty table gives none, other columns are
    not looked at.
    """
    tree = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(p) for p in b.column(1).to_pylist()]
            some = [f for f in found if f]
            keep = iter(classify(tree, np.concatenate([features(f) for f in some])).tolist() if some else [])
            kept = [[t for t, _, _ in f if next(keep)] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(["\n".join(k) for k in kept], pa.string()), pa.array([len(f) for f in found], pa.int32()), pa.array([len(k) for k in kept], pa.int32())], names=["page_id", "text", "n_blocks", "n_kept"]
            )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, text string, n_blocks int, n_kept int")
