"""Token counts with offset-mapped attribution.

Each whole document is encoded once by a byte-level BPE vocabulary. The byte lengths of its
tokens give their spans, which are interval-joined (merge of two sorted lists) to the sections
of the document, its lines. A token belongs to the section that holds most of its bytes, the
earlier one if equal; line ends count to the line they end. So the sections' counts add up to
the document's count.

field_tokens does the same for the fields of a record: they are joined and encoded once, and each
token goes to the field with most of its bytes.

Null and empty texts: one section, no token. Null fields: empty. Repeated rows: each gives its own
sections. Empty table: no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logspark.llm.common import pick, pieces

VOCABULARY = "byte_bpe_50k.tiktoken"


@functools.cache
def encoder(path: str):
    """The encoder and the byte length of each token id; loaded once in a worker."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) per section: each token to the section with most of its bytes, the earlier if equal."""
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    owner = first.copy()
    for i in np.flatnonzero(last > first):
        edges = np.clip(np.concatenate([[starts[i]], section_ends[first[i] : last[i]], [token_ends[i]]]), starts[i], token_ends[i])
        owner[i] = first[i] + int(np.diff(edges).argmax())
    n = len(section_ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[last > first], minlength=n)


def section_tokens(docs: DataFrame, vocabulary: str = "") -> DataFrame:
    """(doc_id, section, start_byte, end_byte, n_tokens, n_crossing, doc_tokens), a row for each line of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(vocabulary)
        for batch in pieces(batches):
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                ends = np.append(np.flatnonzero(raw == 10) + 1, len(raw)) if len(raw) == 0 or raw[-1] != 10 else np.flatnonzero(raw == 10) + 1
                ids = np.array(enc.encode_ordinary(text), dtype=np.int64)
                tokens, crossing = attribute(np.cumsum(lengths[ids]), ends)
                n = len(ends)
                for col, values in zip(cols, ([doc_id] * n, range(n), np.append(0, ends[:-1]).tolist(), ends.tolist(), tokens.tolist(), crossing.tolist(), [len(ids)] * n), strict=True):
                    col.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "section", "start_byte", "end_byte", "n_tokens", "n_crossing", "doc_tokens"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, section long, start_byte long, end_byte long, n_tokens long, n_crossing long, doc_tokens long")


def field_tokens(docs: DataFrame, fields: list[str], separator: str = "\n", vocabulary: str = "") -> DataFrame:
    """(doc_id, field, n_bytes, n_tokens, n_crossing, doc_tokens), a row for each field of each row; a separator counts to the field before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(vocabulary)
        for batch in pieces(batches, fields[-1]):
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, *parts in zip(batch.column("doc_id").to_pylist(), *(batch.column(f).to_pylist() for f in fields), strict=True):
                texts = [(p or "") + (separator if i + 1 < len(fields) else "") for i, p in enumerate(parts)]
                sizes = [len(t.encode()) for t in texts]
                ids = np.array(enc.encode_ordinary("".join(texts)), dtype=np.int64)
                tokens, crossing = attribute(np.cumsum(lengths[ids]), np.cumsum(sizes))
                for col, values in zip(cols, ([doc_id] * len(fields), fields, sizes, tokens.tolist(), crossing.tolist(), [len(ids)] * len(fields)), strict=True):
                    col.extend(values)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "field", "n_bytes", "n_tokens", "n_crossing", "doc_tokens"])

    rows = docs.select(docs["doc_id"], *[docs[f].cast("string").alias(f) for f in fields])
    return rows.mapInArrow(run, "doc_id long, field string, n_bytes long, n_tokens long, n_crossing long, doc_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
