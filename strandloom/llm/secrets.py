"""Secret scans with multipart credential linking.

Three base patterns find plain secrets. The linking adds weak parts, a bare secret-like token, a named
identifier or an endpoint, only where complementary parts stand in one scope: an interval join of
identifiers with secrets and of secrets with endpoints, whose scope is ``scope`` code points to either
side. An identifier and an endpoint alone are no credential.

Scale: one pass over the texts without a shuffle; parts are joined within a document by both ends, with
binary search over sorted starts and the greatest end so far, so the work is linear in the text but for a
logarithm, however many parts stand in one scope.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

KINDS = ("assign", "access", "hex", "secret", "endpoint", "identifier")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of hexadecimal digits are maximal, so asking for 16 is the same as dropping shorter runs.
HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak parts: reported only when linked.
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,128}={0,2}(?![A-Za-z0-9+/=_-])")
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name)?|login|account(?:_?(?:id|name))?|(?:[a-z0-9]+[_-]){0,4}(?:client|app|tenant|access_?key|key)[_-]?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, kinds by their place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _reach(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts of the sorted spans, and the greatest end of each and all before it."""
    spans, most, ends = sorted(spans), 0, []
    for s in spans:
        most = max(most, s[2])
        ends.append(most)
    return [s[0] for s in spans], ends


def _near(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]], scope: int) -> list[tuple[int, int, int]]:
    """The spans that any of the others meets or comes within ``scope`` of: it starts at most so far
    behind the span's end, and of those that do one ends at most so far before its start."""
    starts, ends = _reach(others)
    at = [bisect.bisect_right(starts, s[2] + scope) for s in spans]
    return [s for s, i in zip(spans, at, strict=True) if i and ends[i - 1] >= s[0] - scope]


def _apart(spans: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of ``taken``."""
    starts, ends = _reach(taken)
    at = [bisect.bisect_left(starts, s[2]) for s in spans]
    return [s for s, i in zip(spans, at, strict=True) if not i or ends[i - 1] <= s[0]]


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int) -> list[tuple[int, int, int]]:
    """Weak parts whose complements stand in their scope."""
    access = [s for s in base if s[1] == 1]
    strong = [s for s in base if s[1] in (0, 2)]
    ends = [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)]
    named = _apart([(m.start(), 5, m.end()) for m in IDENTIFIER.finditer(text)], base + ends)
    names = access + named
    if not names and not strong:
        return []
    mixed = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])")
    # A secret belongs to an identifier, an identifier and an endpoint to a secret.
    weak = [(m.start(), 3, m.end()) for m in WEAK_SECRET.finditer(text) if mixed.match(m[0])] if names else []
    weak = _near(_apart(weak, base + ends + named), names, scope)
    return weak + _near(named + ends, strong + weak, scope)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scope: int = 300) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_assign, n_access, n_hex, base_spans, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, comma-joined.
    Null and empty texts have none; ties in start are ordered assign, access, hex, secret, endpoint, identifier;
    texts are read whole, however long; columns of other names are not read; repeated rows give repeated
    results, an empty table none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts: list[list[int]] = [[], [], []]
            base, every = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text or "")
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in found))
                base.append(written(found))
                every.append(written(found + linked_spans(text or "", found, scope)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(every, pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string")
    return out.withColumnRenamed("id", id_col)
