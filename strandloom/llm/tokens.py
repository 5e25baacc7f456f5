"""Token counts by offset-mapped attribution.

Every text is encoded once, whole. The tokens of a byte-level vocabulary cut the text's bytes without
gaps, so their spans are running sums of token lengths. An interval join maps the spans to the
sections of the text; a token that crosses a border is allocated by an explicit rule:

* ``start``: to the section that holds its first byte,
* ``majority``: to the section that holds most of its bytes (ties: the first),
* ``split``: to each section by its share of the bytes.

Scale: one pass without a shuffle; the join of sorted spans is a binary search within the row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

RULES = ("start", "majority", "split")
_ENCODINGS: dict = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file and its table of token lengths, made once per process."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _ENCODINGS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _ENCODINGS[path, pattern]


def attribute(token_ends: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. ``borders`` are the section ends (the last is the text's end)."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    n = len(borders)
    first = np.searchsorted(borders, starts, side="right")
    if rule == "start":
        return np.bincount(first, minlength=n).astype(np.float64)[:n]
    last = np.searchsorted(borders, token_ends - 1, side="right")
    inside = first == last
    counts = np.bincount(first[inside], minlength=n).astype(np.float64)[:n]
    for t in np.flatnonzero(~inside):
        a, b = starts[t], token_ends[t]
        edges = np.concatenate(([a], borders[first[t] : last[t]], [b]))
        shares = np.diff(edges)
        if rule == "split":
            counts[first[t] : last[t] + 1] += shares / (b - a)
        else:
            counts[first[t] + int(np.argmax(shares))] += 1
    return counts


def count_tokens(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, rule: str = "start", separator: str = "\n") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_tokens, n_sections, section_tokens array<double>.

    A section is a stretch up to and with a ``separator`` (the last one is what follows the last
    separator, if anything). Sections' counts add up to n_tokens under every rule. Null and empty texts
    have no token and no section; a tie goes to the first section; texts are encoded whole, however long;
    null ids stay; columns of other names are not read; repeated rows give repeated results, an empty
    table none.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[id_col].dataType.simpleString()
    mark = np.frombuffer(separator.encode(), np.uint8)
    if len(mark) != 1:
        raise ValueError("the separator must be one ASCII character")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = encoding(ranks, pattern)
        for batch in sliced(batches):
            totals, sections, counts = [], [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                ids = coder.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
                ends = np.cumsum(lengths[ids])
                borders = np.flatnonzero(np.frombuffer(data, np.uint8) == mark[0]) + 1
                if len(data) and (not len(borders) or borders[-1] != len(data)):
                    borders = np.append(borders, len(data))
                totals.append(len(ids))
                sections.append(len(borders))
                counts.append(attribute(ends, borders, rule) if len(borders) else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(sections, pa.int64()), pa.array(counts, pa.list_(pa.float64()))], ["id", "n_tokens", "n_sections", "section_tokens"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens bigint, n_sections bigint, section_tokens array<double>")
    return out.withColumnRenamed("id", id_col)
