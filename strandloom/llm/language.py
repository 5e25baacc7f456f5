"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. A word is known if it occurs at least
``min_count`` times in the sample that the model is fitted on; any other falls back to its character
n-grams, longest first: the first order of which any n-gram occurs in the sample scores the word with the
mean of those that do; then the next shorter order, down to single characters.

Scale: the model is fitted on a sample of at most about ``max_docs`` labelled rows, shared evenly by the
languages, and holds every word and n-gram of the sample, so what reaches the driver and is broadcast
grows with the sample and not with the corpus. No language crowds out the words of another. Prediction
is one pass over the whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, sliced, stored, unused, worker_memory

WORDS = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies of words and n-grams in each language (rows of ``scores``)."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    scores: np.ndarray
    evidence: int = 30
    memory: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def rows(self, word: str) -> tuple[int, ...]:
        """Rows of ``scores`` whose mean is the score of the word; none if nothing of it is known."""
        known = self.words.get(word)
        if known is not None:
            return (known,)
        found = self.memory.get(word)
        if found is None:
            for n in ORDERS:
                table = self.grams[n]
                found = tuple(table[g] for g in grams(word, n) if g in table)
                if found:
                    break
            if len(self.memory) > 100_000:
                self.memory.clear()
            self.memory[word] = found
        return found

    def predict(self, text: bytes | None) -> tuple[str, float]:
        counts = Counter(WORDS.findall((text or b"").decode("utf-8", "replace").lower()))
        # Numerals such as superscripts are words to the pattern but no letters.
        if not self.languages or not any(c.isalpha() for word in counts for c in word):
            return "und", 0.0
        at, weight = [], []
        for word, n in counts.items():
            found = self.rows(word)
            at += found
            weight += [n / len(found)] * len(found) if found else []
        total = np.asarray(weight) @ self.scores[at] if at else np.zeros(len(self.languages))
        # All words count alike; their mean weighs as much as ``evidence`` of them at most.
        total = total * (min(self.evidence, sum(counts.values())) / sum(counts.values()))
        chance = np.exp(total - total.max())
        best = int(np.argmax(chance))
        return self.languages[best], float(chance[best] / chance.sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, item, lang, n): kind 0 is a word, others are the order of an n-gram."""
    worker_memory()
    for batch in sliced(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            words[lang].update(WORDS.findall((text or b"").decode("utf-8", "replace").lower()))
        rows: Counter = Counter()
        for lang, found in words.items():
            for word, n in found.items():
                rows[0, word, lang] += n
                for order in ORDERS:
                    for g in grams(word, order):
                        rows[order, g, lang] += n
        cols = list(zip(*((*k, n) for k, n in rows.items()), strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "item", "lang", "n"])


def threshold(n: int, quota: int) -> int:
    """The 64-bit signed number that about ``quota`` of ``n`` hashes do not exceed."""
    return (1 << 63) - 1 if n <= quota else (quota << 64) // n - (1 << 63)


def sample(labelled: DataFrame, id_col: str, lang_col: str, max_docs: int) -> DataFrame:
    """At most about ``max_docs`` rows, chosen by a hash of the id: each language has an even share, and
    gives all its rows if it has fewer. With more languages than ``max_docs`` all rows are chosen alike."""
    lang = F.col(lang_col).cast("string")
    sizes = stored(labelled.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    found, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    mark = F.xxhash64(id_col)
    if total <= max_docs:
        return labelled
    if found > max_docs:
        return labelled.where(mark <= threshold(total, max_docs))
    # At most max_docs rows. Shares that small languages leave over go to the larger ones.
    counts, share, left = {}, max_docs, dict(sizes.collect())
    while left:
        quota = share // len(left)
        small = [x for x, n in left.items() if n <= quota]
        for x in small or list(left):
            n = left.pop(x)
            counts[x] = threshold(n, quota)
            share -= n
    of, most = unused(labelled, "__of", "__most")
    bounds = labelled.sparkSession.createDataFrame(sorted(counts.items()), f"{of} string, {most} bigint")
    return labelled.join(F.broadcast(bounds), lang == F.col(of)).where(mark <= F.col(most)).select(*[labelled[c] for c in labelled.columns])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, max_docs: int = 10_000, min_count: int = 2, evidence: int = 30) -> LanguageModel:
    """Fit on at most about ``max_docs`` rows of ``labelled``, shared evenly by the languages.

    Rows with a null language or text teach nothing; repeated rows count as often as they occur; long
    texts count whole; null ids are sampled like others; columns of other names are not read. A word is
    known from ``min_count`` occurrences in the sample, an n-gram from one. ``evidence`` bounds how sure a
    prediction gets: the mean score of a text's words counts as that of at most so many. Without any
    labelled row the model knows no language and predicts ``und``.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = sample(rows, id_col, lang_col, max_docs)
    counts = rows.select(F.col(lang_col).cast("string"), F.col(text_col).cast("binary")).mapInArrow(_counts, "kind int, item string, lang string, n bigint")
    counts = counts.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))
    known = F.sum("n").over(Window.partitionBy("kind", "item")) >= F.when(F.col("kind") == 0, min_count).otherwise(1)
    counts = stored(counts.withColumn("known", known).where("known").drop("known"), "language-counts")
    languages = sorted(r[0] for r in rows.select(F.col(lang_col).cast("string")).distinct().collect())
    # Rows of the sample's vocabulary, in an order that does not depend on tasks.
    found = counts.orderBy("kind", "item", "lang").toArrow()
    kinds, n = found.column("kind").to_numpy(), found.column("n").to_numpy()
    place = {x: i for i, x in enumerate(languages)}
    lang = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    items = found.column("item").to_pylist()
    tables: dict[int, dict[str, int]] = {}
    blocks, base = [], 0
    for k in (0, *sorted(ORDERS)):
        at = np.flatnonzero(kinds == k)
        own: dict[str, int] = {}
        where = np.array([own.setdefault(items[i], len(own)) for i in at], np.int64)
        block = np.zeros((len(own), len(languages)))
        block[where, lang[at]] = n[at]
        tables[k] = {x: base + i for x, i in own.items()}
        base += len(own)
        # Half a count for what a language has not shown.
        blocks.append(np.log((block + 0.5) / (block.sum(axis=0) + 0.5 * (len(own) + 1))))
    scores = np.concatenate(blocks) if blocks else np.zeros((0, len(languages)))
    # Only differences between languages matter.
    scores = scores - scores.mean(axis=1, keepdims=True) if len(languages) else scores
    return LanguageModel(languages, tables[0], {k: tables[k] for k in ORDERS}, scores, evidence)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns so named are replaced).

    ``und`` with score 0 where the text is null or has no letter; otherwise a learned language and its
    share of the likelihood (0 to 1). Texts of which nothing is known score evenly; ties go to the first
    language in sorted order. Texts count whole, however long. Repeated rows get equal predictions; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        worker_memory()
        model = shared.value
        found = [model.predict(t) for t in as_bytes(texts)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    names = ("lang_pred", "score")
    # Nondeterministic to the optimizer, which else evaluates it again in every filter on its result.
    (found,) = unused(docs, "__lang")
    out = docs.withColumn(found, predict.asNondeterministic()(F.col(text_col).cast("binary")))
    return out.select(*[docs[c] for c in docs.columns if c.lower() not in names], *[F.col(f"{found}.{c}").alias(c) for c in names])


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is the held-out fold."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


