"""The stages one by one against brute force, and the whole pipeline."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from strandloom.llm import queries
from strandloom.llm.common import stored

from .fixtures import documents, empty
from .test_operators import WORD, brute_wide, brute_wide_groups, cut_lines

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert len({n.split("_")[0] for n in names if n.startswith("op")}) == 10


@pytest.mark.parametrize("source", ["sf0.001", "fixture"])
def test_stages(spark, source):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "sf0.001" else documents(spark)[0]
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]

    kept = stored(stages["language_id"](spark, docs, SF), "t")
    assert kept.columns == columns
    if source == "sf0.001":
        letters = docs.where(F.col("text").rlike(r"\p{L}"))
        assert kept.count() == letters.count()
    assert kept.where("text is null").count() == 0

    cut = stored(stages["line_dedup"](spark, kept, SF), "t")
    want = cut_lines([(r["doc_id"], r["text"]) for r in kept.collect()], 40, 5)
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == Counter({(d, t): n for (d, _, _, t), n in want.items()})
    assert cut.columns == columns and cut.where("n_chars <> char_length(text)").count() == 0

    single = stored(stages["near_dedup"](spark, cut, SF), "t")
    prints = defaultdict(list)
    for r in cut.collect():
        prints[brute_wide(r["text"])].append(r["doc_id"])
    groups = defaultdict(list)
    for p, root in brute_wide_groups(set(prints)).items():
        groups[root] += prints[p]
    least = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert Counter(r["doc_id"] for r in single.collect()) == least
    assert single.columns == columns

    mixed = stored(stages["mixing"](spark, single, SF), "t")
    assert mixed.columns == columns
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    size = lambda df: sum(len(WORD.findall(r["text"] or "")) for r in df.collect())
    assert size(mixed) == pytest.approx(1.5 * size(single), rel=0.05)

    packed = stages["packing"](spark, mixed, SF)
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(r["doc_id"] for r in mixed.collect())


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "t")
    assert docs.count() == 0
