"""Main text of web pages: boosted trees over block elements, decoded over the tree.

Each block element gets the probability that it holds main text, from trees trained on generated
pages (:mod:`corpusloom.llm.sample_pages`).  Decoding chooses the most probable labelling in which
whatever is inside a dropped element is dropped too, by one pass up and one down the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import boosting, scratch
from corpusloom.llm.dom import Node, features, parse, run_text

#: Generated pages the trees are trained on.
TRAINING_PAGES = 3000


@lru_cache(1)
def model(pages: int = TRAINING_PAGES) -> boosting.Trees:
    """Trees trained on generated pages; the same at every call."""
    from corpusloom.llm.sample_pages import labelled_pages

    rows, labels = [], []
    for page, main in labelled_pages(pages):
        nodes = parse(page)
        rows.append(features(nodes))
        labels.append(node_labels(nodes, main))
    return boosting.fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def node_labels(nodes: list[Node], main: frozenset[str]) -> np.ndarray:
    """Whether each node's subtree holds a run whose text is one of ``main``."""
    out = np.zeros(len(nodes), dtype=bool)
    for k in range(len(nodes) - 1, -1, -1):
        out[k] |= any(run_text(p) in main for _, p in nodes[k].runs)
        if k and out[k]:
            out[nodes[k].parent] = True
    return out


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """The most probable labels such that nothing inside a dropped node is kept."""
    keep = -np.logaddexp(0, -log_odds)
    drop = -np.logaddexp(0, log_odds)
    parent = [v.parent for v in nodes]
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        keep[parent[k]] += max(keep[k], drop[k])
        drop[parent[k]] += drop[k]
    out = keep > drop
    for k in range(1, len(nodes)):
        out[k] &= out[parent[k]]
    return out


def kept_text(nodes: list[Node], kept: np.ndarray) -> str:
    runs = sorted(r for v, k in zip(nodes, kept) if k for r in v.runs)
    return "\n".join(t for _, pieces in runs if (t := run_text(pieces)))


def extract(pages: list[str | None], trees: boosting.Trees) -> list[str]:
    """Main text of each page; empty for a page without any."""
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    scores = trees.log_odds(np.concatenate([features(n) for n in parsed]))
    cuts = np.cumsum([len(n) for n in parsed])[:-1]
    return [kept_text(nodes, decode(nodes, s)) for nodes, s in zip(parsed, np.split(scores, cuts))]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    Null, empty and text-less pages give the empty text.  Pages are read whole, in time proportional to
    their length.  Rows are independent, so repeated rows and null ids pass through.  Other columns are
    ignored, whatever their names.  An empty table gives an empty result.
    """
    scratch.prepare(pages.sparkSession)
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            texts = extract(batch.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
