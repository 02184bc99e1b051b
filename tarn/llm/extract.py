"""Main text of web pages: a bidirectional LSTM labels every block with the whole page in view."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm import BiLSTM, padded
from .blocks import N_INPUT, Block, parse, vectors
from .common import module_bytes, table

#: Blocks that are labelled together; a longer page goes alone.
BATCH_BLOCKS = 8192


@lru_cache(1)
def labeller() -> BiLSTM:
    """The weights that train_html.py wrote."""
    found = np.load(io.BytesIO(module_bytes("html_labeller.npz")))
    net = BiLSTM({k: found[k] for k in found.files})
    if net.p["w0"].shape[0] != N_INPUT + net.hidden:
        raise ValueError("html_labeller.npz was trained for other inputs; run tarn.llm.train_html")
    return net


def main_texts(pages: list[list[Block]]) -> list[str]:
    """The blocks labelled main text of each page, one a line."""
    net = labeller()
    out = [""] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= BATCH_BLOCKS:
            end += 1
        own = [pages[i] for i in order[at:end]]
        flat = vectors([b for p in own for b in p])
        cuts = np.cumsum([len(p) for p in own])[:-1]
        scores = net.scores(*padded(np.split(flat, cuts)))
        for k, (i, p) in enumerate(zip(order[at:end], own, strict=True)):
            out[i] = "\n".join(b.text for b, s in zip(p, scores[:, k].tolist(), strict=False) if s > 0)
        at = end
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages(page_id, url, html)``.

    Null or empty html, and pages without main text, give an empty text. Nothing is shuffled. Repeated rows
    repeat; other columns don't matter; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts([parse(h.as_py() or "") for h in part.column(2)])
                texts = [t.encode("utf-8", "replace").decode() for t in texts]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
