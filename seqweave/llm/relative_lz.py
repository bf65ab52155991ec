"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is its own reference, cut into blocks by the picked k-gram that a passage holds (see anchors.py): a
passage of ``least`` words can only repeat inside the blocks of its own picks, so parsing it against those is parsing it
against every block. A block is read in document order. Each passage is factored greedily: from the present
word on, the longest stretch that the indexed reference holds is one factor, and a word that starts none is a literal.
Factors of ``least`` words or more are duplicate spans. Because a greedy factor may hide a repeat that
straddles its end, parsing goes on ``least`` - 1 words before the end, at the first window that crosses it.
What was not found enters the index for later documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import HOT, SPANS, contexts, hot_spans, merge_spans, spread
from .common import chunks, free_name, row_key

_WORD = re.compile(rb"[^ \t\n\x0b\f\r]+")


class Block:
    """Reference passages of one gram, indexed by their windows of ``least`` words."""

    def __init__(self, least: int):
        self.width = 4 * least
        self.index: dict[bytes, tuple[bytes, int, int, int | None]] = {}

    def factors(self, words: bytes, last: int, key: int):
        """(first word, number of words, reference document) of each long factor found in other documents."""
        i, width = 0, self.width
        while i <= last:
            hit = self.index.get(words[4 * i : 4 * i + width])
            if hit is None or hit[2] == key:
                i += 1
                continue
            ref, at, _, doc_id = hit
            n, m = 4 * i + width, at + width
            while words[n : n + 4] == ref[m : m + 4] and n < len(words) and m < len(ref):
                n += 4
                m += 4
            yield i, n // 4 - i, doc_id
            i = n // 4 - width // 4 + 1

    def add(self, words: bytes, last: int, key: int, doc_id: int | None) -> None:
        for i in range(last + 1):
            self.index.setdefault(words[4 * i : 4 * i + self.width], (words, 4 * i, key, doc_id))


def parse(batches, least: int):
    """Factor passages that come sorted by gram, then document; yields span rows."""
    gram, block, seen = None, None, {}
    for batch in batches:
        rows = [], [], [], [], []
        cols = [batch.column(c).to_pylist() for c in ("gram", "doc_id", "key", "starts", "last", "words")]
        for g, doc_id, key, starts, last, words in zip(*cols):
            if g != gram:
                gram, block, seen = g, Block(least), {}
            known = seen.get(words)
            if known is None:
                found = block.factors(words, last, key)
            elif known != key:  # the same passage again: one factor from end to end
                found = [(0, last + least, block.index[words[: block.width]][3])]
            else:
                found = block.factors(words, last, key)
            for i, n, ref in found:
                for begin, end in spread(starts, i, n):
                    for r, v in zip(rows, (doc_id, key, begin, end, ref)):
                        r.append(v)
            if known is None:
                block.add(words, last, key, doc_id)
                seen[words] = key
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "key", "start", "stop", "ref_doc_id"])


def document_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50, hot: int = HOT) -> DataFrame:
    """(doc_id, key, spans) of the documents that repeat ``least`` words or more of an earlier document."""
    passages, windows, _ = contexts(df, least, doc_id, text, hot)
    passages = passages.repartition("gram").sortWithinPartitions("gram", F.col("doc_id").asc_nulls_last(), "key", "starts")
    spans = passages.mapInArrow(lambda batches: parse(batches, least), SPANS)
    return merge_spans(spans if windows is None else spans.unionByName(hot_spans(windows, least)))


def duplicate_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50, hot: int = HOT) -> DataFrame:
    """Word spans [start, stop) that stand in an earlier document too: doc_id, start, stop, ref_doc_id.

    A span is a maximal union of windows of ``least`` words, each of which an earlier document holds, documents
    being ordered by doc_id (nulls last), then by a hash of the row; the first document keeps its words.
    ref_doc_id is the earliest document with the span's first window. Words are runs without ASCII white space and are
    compared by 32-bit hashes, ``least`` of them at a time. Repeats inside one document don't count.

    Null and empty texts and those under ``least`` words give nothing. Rows equal in doc_id and text are one
    document; the same doc_id with another text is another one. Very long texts are read whole. An empty table gives no rows.
    Other columns are not read. Picks that stand in more than ``hot`` places are compared window by window, with the same result.
    """
    return document_spans(df, doc_id, text, least, hot).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.stop", "s.ref_doc_id")


def cut_spans(text: bytes, spans: list[dict]) -> bytes:
    """``text`` without the words of the spans and the white space after them."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, end = [], 0
    for s in spans:
        kept.append(text[end : at[s["start"]]])
        end = at[s["stop"]]
    return b"".join(kept) + text[end:]


def remove_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", least: int = 50) -> DataFrame:
    """``df`` with duplicate spans cut out of its texts and n_chars set anew; a document of which no word is left goes.

    Rows without duplicates pass unchanged, null and empty texts too. Of documents with the same passage the one first in
    order of doc_id (nulls last), then of a hash of the row, keeps it. Repeated rows are one document and are cut alike. Very long
    texts are cut whole. An empty table gives no rows. Other columns pass unchanged, whatever their names.
    """
    names = df.columns
    key = free_name(names, "__key")
    found = free_name(names, "__spans")
    spans = document_spans(df, doc_id, text, least).select(F.col("key").alias(key), F.col("spans").alias(found))
    joined = df.withColumn(key, row_key(doc_id, text)).join(spans, key, "left")

    def cut(batches):
        for part in chunks(batches, text):
            i = part.schema.get_field_index(text)
            spans_of = part.column(found).to_pylist()
            texts = part.column(i).cast(pa.binary()).to_pylist()
            new = [cut_spans(t, s) if s else t for t, s in zip(texts, spans_of)]
            cols = [pa.array(new, pa.binary()).cast(pa.string()) if k == i else c for k, c in enumerate(part.columns)]
            keep = pa.array(np.array([not s or bool(t.strip()) for t, s in zip(new, spans_of)], bool))
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names).filter(keep)

    out = joined.mapInArrow(cut, joined.schema)
    if n_chars in names:
        out = out.withColumn(n_chars, F.when(F.col(found).isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(df.schema[n_chars].dataType))
    return out.select(*names)
