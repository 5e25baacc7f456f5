"""Results and plans that larger tables have shown to be wrong or too costly."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions.alphabet import six_digits


def test_six_digits_rounds_the_double_and_not_its_decimal_form(spark):
    rng = random.Random(1)
    values = [0.0671875, -0.0671875, 0.0, -0.0, -1e-9, 1e-300, 5e-7, 0.9999995, 1.5, 15.9999999]
    values += [rng.randrange(10**7) / 10**7 * rng.choice([1, -1, 15]) for _ in range(2000)] + [k / 2**7 for k in range(256)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", six_digits(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in rows] == [f"{r['x']:.6f}" for r in rows]


def test_sites_of_a_corpus_are_neither_shuffled_nor_counted_one_by_one(spark):
    from strandloom.operators import predict

    rng = random.Random(2)
    seqs = spark.createDataFrame([(i, str(i), "".join(rng.choice("ACGTN" if i % 2 else "ACGT") for _ in range(60)), 1) for i in range(20)], "sid bigint, name string, s string, strand tinyint")
    for model in (predict.Model(), predict.Model(markov=True), predict.Model(markov=True, both=True)):
        sites = predict.site_probabilities(seqs, seqs, model)
        plan = sites._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        table = predict.window_sites(seqs, seqs, model)
        assert predict.accuracy(table, "sites").collect() == predict.accuracy(sites).collect()
        assert table.count() < sites.count() == table.agg(F.sum("sites")).first()[0]
        assert sorted(predict.vcf_sites(seqs, seqs, model).collect()) == sorted(predict.vcf_rows(sites).collect())
    assert predict.accuracy(predict.window_sites(seqs.where("sid < 0"), seqs.where("sid < 0"), predict.Model()), "sites").first().asDict() == {"total": 0, "correct": 0, "fraction": 0.0}


def test_packed_suffix_table_equals_the_one_by_joins(spark, monkeypatch):
    from strandloom.functions.alphabet import DNA
    from strandloom.operators import suffix, suffix_chunks

    monkeypatch.setattr(suffix_chunks, "CHUNK", 600)
    monkeypatch.setattr(suffix_chunks, "BATCH", 300)
    rng = random.Random(3)
    texts = ["", "A", "A", "N" * 90, "N" * 70, "ACGT" * 30, "ACGT" * 30, ""] + ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(150))) for _ in range(15)]
    texts += [texts[-1], texts[-2] + texts[-1], texts[-1] + texts[-2], texts[-3][:24], texts[-3][-24:]]
    seqs = spark.createDataFrame([(7 * i % 101, str(i), s, 1) for i, s in enumerate(texts)], "sid bigint, name string, s string, strand tinyint")
    for revsort in (False, True):
        got = suffix.suffix_table(seqs, DNA, revsort)
        want = suffix.joined_table(seqs, DNA, revsort)
        assert got.columns == want.columns
        assert sorted(got.collect()) == sorted(want.collect())
    monkeypatch.setattr(suffix_chunks, "LONGEST", 100)
    assert suffix_chunks.suffix_rows(seqs.withColumn("term_order", F.col("sid")), DNA) is None


def test_intervals_and_texts_of_packed_tables(spark):
    from strandloom.functions.alphabet import DNA
    from strandloom.operators import suffix

    rng = random.Random(4)
    texts = ["", "ACG", "NNNNNNNNNNNN"] + ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(90))) for _ in range(12)]
    seqs = spark.createDataFrame([(i, str(i), s, 1) for i, s in enumerate(texts)], "sid bigint, name string, s string, strand tinyint")
    sa = suffix.suffix_table(seqs, DNA)
    plain = spark.createDataFrame(sa.collect(), sa.schema)
    assert hasattr(sa, "packed") and not hasattr(plain, "packed")
    assert sorted(suffix.word_intervals(sa, seqs, [1, 4]).collect()) == sorted(suffix.word_intervals(plain, seqs, [1, 4]).collect())
    words = spark.createDataFrame([(w,) for w in ("A", "ACG", "NNNN", "", "X", "GGGGGGGG", texts[-1][:7], texts[-1][:9])], "word string")
    assert sorted(suffix.lookup(sa, seqs, words).collect()) == sorted(suffix.lookup(plain, seqs, words).collect())
    by_place = {(r["srank"], r["s"]) for r in suffix.reconstruct(sa).collect()}
    assert by_place == {(r["srank"], r["s"]) for r in suffix.reconstruct(plain.drop("pos")).collect()}
    assert sorted(s for _, s in by_place) == sorted(texts)


def test_frequent_hashes_are_sent_as_gaps(spark, monkeypatch):
    import numpy as np

    from strandloom.operators import repeats

    monkeypatch.setattr(repeats, "LIST", 1000)
    rng = random.Random(5)
    for most in (300, 1 << 40, 1 << 62):
        values = np.sort(np.array([rng.randrange(most) for _ in range(500)] + [0, most - 1], np.int64))
        assert (repeats._values(repeats._gaps(values)) == values).all()
    marks = [rng.randrange(1 << 40) for _ in range(4000)] + [x for x in (0, 7, (1 << 40) - 1) for _ in range(5)] + [9] * 4
    found = repeats.frequent_hashes(spark.createDataFrame([(x,) for x in marks], "mark bigint").repartition(3), 40, 7, 5)
    assert sorted(r["mark"] for r in found.collect()) == [0, 7, (1 << 40) - 1]
    empty = spark.createDataFrame([], "mark bigint")
    assert repeats.frequent_hashes(empty, 40, 7, 5).count() == 0


@pytest.fixture(scope="module")
def mapped(spark):
    """A table of mapped files over several chunks, with long repeats, and the same rows without them."""
    from strandloom.functions.alphabet import DNA
    from strandloom.operators import suffix, suffix_chunks, suffix_files

    rng = random.Random(6)
    texts = ["", "A", "N" * 90, "N" * 70, "ACGT" * 30, "ACGT" * 30, ""] + ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(400))) for _ in range(9)]
    texts += [texts[-1], texts[-2] + texts[-1], texts[-1] + texts[-2], texts[-1][60:], "GG" + texts[-1]]
    seqs = spark.createDataFrame([(7 * i % 101, str(i), s, 1) for i, s in enumerate(texts)], "sid bigint, name string, s string, strand tinyint")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffix_chunks, "CHUNK", 700)
        sa = suffix.suffix_table(seqs, DNA)
        plain = spark.createDataFrame(suffix.joined_table(seqs, DNA).collect(), sa.schema)
        assert isinstance(sa.packed, suffix_files.Packed)
        yield sa, plain, seqs


def test_a_table_keeps_ranks_of_anchors_only(spark):
    from pathlib import Path

    from strandloom.functions.alphabet import DNA
    from strandloom.operators import ranking, suffix

    rng = random.Random(7)
    texts = ["".join(rng.choice("ACGTN") for _ in range(20_000)) for _ in range(15)]
    seqs = spark.createDataFrame([(i, str(i), s, 1) for i, s in enumerate(texts)], "sid bigint, name string, s string, strand tinyint")
    before = set(ranking._KEPT)
    suffix.suffix_table(seqs, DNA)
    held = sum(f.stat().st_size for p in set(ranking._KEPT) - before for f in Path(p.removeprefix("file:")).rglob("*") if f.is_file())
    assert held < 3 * sum(map(len, texts))


def test_samples_are_made_without_the_other_rows(mapped):
    from strandloom.operators import suffix

    sa, plain, seqs = mapped
    n = seqs.count()
    for exponent in (0, 2, 5):
        assert sorted(suffix.samples(sa, exponent, n).collect()) == sorted(suffix.samples(plain, exponent, n).collect())


def test_backward_extensions_read_packed_letters(mapped, monkeypatch):
    from strandloom.functions.alphabet import DNA
    from strandloom.operators import suffix

    sa, plain, seqs = mapped
    rows = suffix.bwt_rows(sa)
    assert rows.pieces.count() < rows.count() == plain.count()
    assert sorted(rows.collect()) == sorted(plain.select("row", "bwt").collect())
    one = suffix.initial_intervals(sa, seqs)
    two = suffix.extend_backward(rows, one, DNA)
    want = sorted(suffix.word_intervals(plain, seqs, [2]).collect())
    assert sorted(two.collect()) == want
    assert sorted(suffix.extend_backward(rows, two, DNA).collect()) == sorted(suffix.word_intervals(plain, seqs, [3]).collect())
    monkeypatch.setattr(suffix, "FEW_INTERVALS", 0)
    assert sorted(suffix.extend_backward(rows, one, DNA).collect()) == want


def test_intervals_of_words_come_from_sorted_keys(mapped):
    from strandloom.functions.alphabet import DNA
    from strandloom.operators import suffix, suffix_files

    sa, plain, seqs = mapped
    for lengths in ([4], [1, 5, 24], [25]):
        assert (sa.packed.intervals(lengths) is None) == (max(lengths) > suffix_files.KEY)
        assert sorted(suffix.word_intervals(sa, seqs, lengths).collect()) == sorted(suffix.word_intervals(plain, seqs, lengths).collect())
    twins = [suffix.reverse_intervals(suffix.word_intervals(x, seqs, [4]), DNA).fillna(-1, ["rlo"]) for x in (sa, plain)]
    assert sorted(twins[0].collect()) == sorted(twins[1].collect())


def test_inverse_lf_makes_two_columns(mapped):
    from strandloom.operators import suffix

    sa, plain, _ = mapped
    out = suffix.inverse_lf(sa)
    assert sorted(out.collect()) == sorted(suffix.inverse_lf(plain).collect())
    assert "srank" not in out._jdf.queryExecution().analyzed().toString()


def test_letters_are_sent_to_their_sequences_packed(mapped):
    from strandloom.operators import suffix

    sa, plain, seqs = mapped
    out = suffix.reconstruct(sa)
    assert "collect_list" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted(out.collect()) == sorted(suffix.reconstruct(plain).collect())
    assert sorted(r["s"] for r in out.collect()) == sorted(r["s"] for r in seqs.collect())


def test_rows_are_made_in_row_order(mapped):
    sa, plain, _ = mapped
    got = sa.collect()
    assert sorted(got) == sorted(plain.collect())
    assert sum(b["row"] != a["row"] + 1 for a, b in zip(got, got[1:], strict=False)) <= len(sa.packed.bounds) + 2


def test_a_key_that_fills_a_range_is_left_to_the_other_table(spark, monkeypatch):
    from strandloom.functions.alphabet import DNA
    from strandloom.operators import suffix, suffix_chunks

    monkeypatch.setattr(suffix_chunks, "CHUNK", 300)
    texts = ["N" * 1100, "ACGT", "N" * 40]
    seqs = spark.createDataFrame([(i, str(i), s, 1) for i, s in enumerate(texts)], "sid bigint, name string, s string, strand tinyint")
    sa = suffix.suffix_table(seqs, DNA)
    assert isinstance(sa.packed, suffix_chunks.Packed)
    row = {(r["sid"], r["pos"]): r["row"] for r in sa.collect()}
    want = sorted((s[p:].replace("N", "Z"), i, p) for i, s in enumerate(texts) for p in range(len(s)))
    assert [row[i, p] for _, i, p in want] == list(range(3, 3 + len(want)))
