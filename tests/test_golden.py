"""The golden corpus: s1 = ACGTACGTTN, s2 = AACCACGT."""

import random
from collections import Counter

import pytest

from strandloom.functions.alphabet import DNA, Alphabet
from strandloom.operators import edit, frontier, kmers, predict, repeats, search, sequences, suffix
from strandloom.plans.index import SequenceIndex
from strandloom.sources import fasta

ROWS = """0 s1 1 10 N 19|1 s2 0 8 T 15|2 s2 0 0 * 0|3 s2 0 1 A 2|4 s2 0 4 C 7|5 s1 1 0 * 1|6 s1 1 4 T 16|7 s2 0 3 C 8|8 s2 0 2 A 3|9 s2 0 5 A 4|10 s1 1 1 A 5
11 s1 1 5 A 6|12 s2 0 6 C 9|13 s1 1 2 C 10|14 s1 1 6 C 11|15 s2 0 7 G 12|16 s1 1 3 G 13|17 s1 1 7 G 14|18 s1 1 8 T 17|19 s1 1 9 T 18"""


def table(spark, rows):
    return spark.createDataFrame([(i, n, s, 1) for i, (n, s) in enumerate(rows)], "sid bigint, name string, s string, strand tinyint")


@pytest.fixture(scope="module")
def corpus(spark):
    return table(spark, [("s1", "ACGTACGTTN"), ("s2", "AACCACGT")]).cache()


@pytest.fixture(scope="module")
def sa(spark, corpus):
    return suffix.suffix_table(corpus, DNA).cache()


def test_suffix_rows(sa, corpus):
    got = sa.join(corpus.select("sid", "name"), "sid").orderBy("row").collect()
    want = [x.split() for x in ROWS.replace("\n", "|").split("|")]
    assert [[str(r["row"]), r["name"], str(r["srank"]), str(r["pos"]), r["bwt"], str(r["lf"])] for r in got] == want


def test_lookup(spark, sa, corpus):
    words = spark.createDataFrame([(w,) for w in ("ACGT", "AC", "CCA", "T", "GGG")], "word string")
    got = {r["word"]: (r["lo"], r["width"]) for r in suffix.lookup(sa, corpus, words).collect()}
    assert got == {"ACGT": (4, 3), "AC": (3, 4), "CCA": (8, 1), "T": (15, 4), "GGG": (0, 0)}


def test_reconstruct_and_samples(sa, corpus):
    assert {r["srank"]: r["s"] for r in suffix.reconstruct(sa).collect()} == {0: "AACCACGT", 1: "ACGTACGTTN"}
    assert {r["row"] for r in suffix.samples(sa, 2).collect()} == {4, 8, 12, 16}
    lf = [r["lf"] for r in sa.where("bwt <> '*'").select("lf").collect()]
    assert len(set(lf)) == len(lf)


def test_matches(spark, corpus):
    qs = table(spark, [("a", "ACGTACCACG"), ("b", "TAACCGTACG"), ("c", "TACGTAACC"), ("none", "NNNN"), ("short", "A"), ("empty", "")])
    index = SequenceIndex.build(corpus, DNA)
    want = {0: {(4, 6, 3, 1), (0, 6, 5, 1)}, 1: {(4, 6, 10, 1), (1, 4, 2, 1)}, 2: {(5, 4, 2, 1), (1, 5, 5, 1), (0, 5, 16, 1)}}
    for compat in (False, True):
        got = {}
        for r in index.max_matches(qs, 3, compat=compat).collect():
            got.setdefault(r["qid"], set()).add((r["qi"], r["ql"], r["lo"], r["width"]))
        if compat:
            want[2] = want[2] - {(0, 5, 16, 1)}
        assert got == want


def test_matches_brute_force(spark):
    rng = random.Random(5)
    corpus = ["".join(rng.choice("ACG") for _ in range(rng.randint(0, 40))) for _ in range(12)]
    queries = ["".join(rng.choice("ACG") for _ in range(rng.randint(0, 25))) for _ in range(15)]
    seed, most = 4, 3
    got = sorted(map(tuple, search.max_matches(table(spark, [("q", q) for q in queries]), table(spark, [("t", t) for t in corpus]), seed, most).collect()))
    want = []
    for qid, q in enumerate(queries):
        occurs = {(i, j) for i in range(len(q)) for j in range(i + seed, len(q) + 1) if any(q[i:j] in t for t in corpus)}
        maximal = [(i, j) for i, j in occurs if not any((a, b) != (i, j) and a <= i and b >= j for a, b in occurs)]
        rows = [(i, j - i, sum(sum(t.startswith(q[i:j], p) for p in range(len(t))) for t in corpus)) for i, j in maximal]
        for i, n, w in rows:
            if sum(x[2] for x in rows if x[1] > n) < most:
                want.append((qid, i, n, w))
    assert got == sorted(want)


def test_greedy(spark):
    corpus = table(spark, [("t", "ACGTACGTTGCA"), ("u", "TTGCAAC")])
    qs = table(spark, [("q", "GTACGTTTGCAACC")])
    got = {tuple(r) for r in search.greedy_matches(qs, corpus, 3, -1).collect()}
    assert got == {(0, 0, 7), (0, 6, 7)}
    with pytest.raises(ValueError):
        search.greedy_matches(qs, corpus, 3, 3)


@pytest.mark.parametrize(("least", "jump"), [(3, -1), (3, 0), (3, 2), (5, 1), (4, 3)])
def test_greedy_brute_force(spark, least, jump):
    """Longest matches found walking the ends of a query from its last letter."""
    rng = random.Random(9)
    corpus = ["".join(rng.choice("ACG") for _ in range(rng.randint(0, 60))) for _ in range(8)]
    queries = ["".join(rng.choice("ACG") for _ in range(rng.randint(0, 40))) for _ in range(12)] + [corpus[0] + corpus[1], ""]
    want = set()
    for qid, q in enumerate(queries):
        length, found, end = least, [], len(q)
        while end >= length:
            start = next(i for i in range(end + 1) if any(q[i:end] in t for t in corpus))
            if end - start > length:
                length, found = end - start, []
            if end - start == length:
                found.append(start)
            end -= length - jump if jump >= 0 else 1
        want |= {(qid, i, length) for i in found}
    got = [tuple(r) for r in search.greedy_matches(table(spark, [("q", q) for q in queries]), table(spark, [("t", t) for t in corpus]), least, jump).collect()]
    assert len(want) > 3 and set(got) == want and len(got) == len(want)


def test_reversed_order(corpus):
    got = [r["word"] for r in kmers.in_reversed_order(kmers.kmer_counts(corpus, 2), DNA).collect()]
    assert got == sorted(got, key=lambda w: [DNA.letters.index(c) for c in reversed(w)])
    assert [r["x"] for r in corpus.select(DNA.decode(DNA.encode(corpus["s"])).alias("x")).collect()] == ["ACGTACGTTN", "AACCACGT"]


PROBS = [
    ("s1", 3, "G", (0, 0, 0.916667, 0), 1.718263, (0.008929, 0.080357, 0.818452, 0.055556), 1.105294),
    ("s1", 4, "T", (0, 0, 0, 0.75), 1.188722, (0.24, 0.12, 0.010417, 0.599167), 0.566605),
    ("s1", 7, "G", (0, 0, 0.833333, 0), 1.447471, (0.008929, 0.080357, 0.818452, 0.055556), 1.105294),
    ("s2", 3, "C", (0.666667, 0, 0, 0), 0.943358, (0.493056, 0.416667, 0, 0), 0.790176),
    ("s2", 4, "C", (0, 0, 0, 0), 0, (0.248929, 0, 0.482143, 0.24), 0.441169),
    ("s2", 6, "C", (0, 0.833333, 0, 0), 1.447471, (0.111111, 0.735119, 0.080357, 0.008929), 0.839388),
]


def test_prediction(corpus):
    central = predict.Model(kmin=1, kmax=2, alpha=1.0)
    both = predict.Model(kmin=1, kmax=2, alpha=1.0, markov=True, both=True)
    for k, model in ((3, central), (5, both)):
        got = {(r["name"], r["pos"]): r for r in predict.site_probabilities(corpus, corpus, model).collect()}
        assert len(got) == 9
        for row in PROBS:
            r = got[row[0], row[1]]
            assert r["ref"] == row[2]
            assert [r[f"p_{c}"] for c in "ACGT"] == pytest.approx(row[k], abs=2e-6)
            assert r["entropy"] == pytest.approx(row[k + 1], abs=2e-6)
    with pytest.raises(ValueError):
        predict.Model(both=True)


def test_edits(spark, corpus):
    features = spark.createDataFrame([("s2", 2, 4), ("s2", 6, 7)], "name string, start bigint, end bigint")

    def run(**options):
        return {r["name"]: r["s"] for r in edit.edit_intervals(corpus.where("name = 's2'"), features, edit.Edit(**options)).collect()}

    assert run(new_char="N") == {"s2": "AANNACNT"}
    assert run(new_char="N", invert=True) == {"s2": "NNCCNNGN"}
    assert run(lower=True) == {"s2": "AAccACgT"}
    assert run(replace="delete") == {"s2": "AAACT"}
    assert run(split=True) == {"s2_3-4": "CC", "s2_7-7": "G"}
    assert run(split=True, invert=True) == {"s2_1-2": "AA", "s2_5-6": "AC", "s2_8-8": "T"}
    whole = {r["name"]: r["s"] for r in edit.whole_sequences(corpus, revcomp=True).collect()}
    assert whole["s2_revcomp"] == "ACGTGGTT"
    assert {r["name"]: r["s"] for r in edit.whole_sequences(corpus, translate=True).collect()}["s2_transl"] == "XXNTPHTR"
    assert edit.edit_intervals(corpus, features, edit.Edit(skip=True)).count() == 1


def test_counts(corpus):
    texts = ["ACGTACGTTN", "AACCACGT"]
    want = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2))
    assert {r["word"]: r["n"] for r in kmers.kmer_counts(corpus, 3).collect()} == want
    both = {r["word"]: r["n"] for r in kmers.both_strand_counts(corpus, 3, DNA).collect()}
    twin = str.maketrans("ACGTN", "TGCAN")
    assert all(both[w] == both[w.translate(twin)[::-1]] for w in both)
    assert tuple(sequences.corpus_stats(corpus).first()) == (20, 2, 10)


def test_repeats(spark):
    rng = random.Random(3)
    unit = "".join(rng.choice("ACGT") for _ in range(12))
    texts = [rng.choice("ACGT") * 1 + "".join(rng.choice("ACGT") for _ in range(5)) + unit + "".join(rng.choice("ACGT") for _ in range(5)) for _ in range(40)]
    seqs = sequences.with_revcomp(table(spark, [(f"t{i}", t) for i, t in enumerate(texts)]), DNA)
    got = repeats.exact_repeats(seqs, DNA, 10, 14, 10, 0.8, printall=True).collect()
    assert unit in {r["word"] for r in got}
    assert repeats.exact_repeats(table(spark, [("a", "ACGT")]), DNA, 10, 12).count() == 0


def test_fasta_files(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text("junk\n>s1 described > not a record\nACGTAC\nGTTZ\n>s2\nAAC CACGT\n>empty\n>last\nacgt")
    rows = fasta.read_fasta(spark, str(path), DNA).orderBy("sid").collect()
    assert [(r["name"], r["s"]) for r in rows] == [("s1", "ACGTACGTTN"), ("s2", "AACCACGT"), ("empty", ""), ("last", "ACGT")]
    spark.dataSource.register(fasta.FastaSource)
    for pushed in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        found = spark.read.format("fasta").option("path", str(path)).option("pushdown", pushed).load().where("name = 's2'").collect()
        assert [tuple(r) for r in found] == [("s2", "AACCACGT")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    out = tmp_path / "out"
    fasta.write_fasta(fasta.read_fasta(spark, str(path), DNA), str(out), 4)
    assert fasta.read_fasta(spark, str(out), DNA).count() == 4
    bed = tmp_path / "x.bed"
    bed.write_text("# comment\ns2\t3\t4\tmore\n skipped\ns2\t7\t7\n")
    assert [tuple(r) for r in fasta.read_intervals(spark, str(bed), True).collect()] == [("s2", 2, 4), ("s2", 6, 7)]
    vcf = tmp_path / "vcf"
    seqs = table(spark, [("s1", "ACGTACGTTN"), ("s2", "AACCACGT")])
    sites = predict.vcf_rows(predict.site_probabilities(seqs, seqs, predict.Model(kmin=1, kmax=2, alpha=1.0)))
    fasta.write_vcf(sites, str(vcf))
    lines = [x for f in sorted(vcf.glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[:2] == fasta.VCF_HEADER.split("\n")
    body = [x.split("\t") for x in lines[2:]]
    assert [(x[0], int(x[1])) for x in body] == sorted((x[0], int(x[1])) for x in body) and len(body) == 9
    assert body[0] == ["s1", "3", "ACGTA", "G", "G", "0.916667", "PASS", "E=1.718263;P=0.000000,0.000000,0.916667,0.000000"]
    queries = tmp_path / "queries"
    queries.mkdir()
    (queries / "a").write_text("acgtz\n\nAAC")
    (queries / "b").write_text("TT\n")
    assert [(r["sid"], r["s"]) for r in fasta.read_queries(spark, str(queries), DNA).orderBy("sid").collect()] == [(0, "ACGTN"), (1, ""), (2, "AAC"), (3, "TT")]


def test_fasta_source(spark, tmp_path):
    """Parts of every size give every record once; writing appends or replaces, and a failure leaves nothing."""
    rng = random.Random(2)
    rows = [(f"n{i}", "".join(rng.choice("ACGT") for _ in range(rng.choice((0, 1, 30, 31, 200))))) for i in range(40)]
    spark.dataSource.register(fasta.FastaSource)
    df = spark.createDataFrame(rows, "name string, s string").repartition(3)
    path = str(tmp_path / "out")
    read = lambda split=1 << 26: sorted(map(tuple, spark.read.format("fasta").option("path", path).option("split", str(split)).load().collect()))
    for width in ("30", "0"):
        df.write.format("fasta").option("path", path).option("width", width).mode("overwrite").save()
        assert all(read(split) == sorted(rows) for split in (64, 100, 333, 1 << 26))
    df.write.format("fasta").option("path", path).mode("append").save()
    assert read() == sorted(rows * 2)
    with pytest.raises(Exception, match=".*"):
        df.selectExpr("name", "IF(name = 'n7', raise_error('stop'), s) AS s").write.format("fasta").option("path", path).mode("overwrite").save()
    assert read() == sorted(rows * 2) and not [x for x in (tmp_path / "out").iterdir() if x.name.startswith(".")]


def test_index_saved(spark, corpus, tmp_path):
    index = SequenceIndex.build(corpus, DNA, revcomp=True, revsort=True)
    index.save(str(tmp_path / "i"))
    again = SequenceIndex.load(spark, str(tmp_path / "i"))
    assert again.sa.count() == index.sa.count() == 40
    assert again.revcomp
    words = spark.createDataFrame([("ACG",), ("CGT",)], "word string")
    got = {r["word"]: r["width"] for r in again.lookup(words).collect()}
    assert got["ACG"] == got["CGT"] == 6


def test_alphabets():
    assert Alphabet.of("DNA/w").letters == "ACGTN"
    assert Alphabet.of("DNA/wild/var").letters == "ACGT|N"
    assert len(Alphabet.of("iupac").letters) == 15
    assert Alphabet.of("protein").default_prefix() == 2
    assert Alphabet.of("abc/casesens").case_sensitive
    with pytest.raises(ValueError):
        Alphabet.of("DNA/x")


def test_frontier(spark, sa, corpus, monkeypatch):
    level = frontier.visit_words(sa, corpus, DNA, lambda f, d: f.where("width >= 2"), 3)
    texts = ["ACGTACGTTN", "AACCACGT"]
    want = {w for k in (1, 2, 3) for w, n in Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1)).items() if n >= 2}
    assert {r["word"] for r in level.collect()} == want
    parents = suffix.word_intervals(sa, corpus, [2]).where("word = 'AC'").selectExpr("word AS parent", "lo", "width", "cast(null as array<int>) AS index")
    tracked = {(r["letter"], r["kid_index"]): r["index"] for r in frontier.track(sa, parents).collect()}
    assert tracked == {("A", 0): 0, ("C", 0): 1, ("*", 0): 2, ("T", 0): 3}
    given = spark.createDataFrame([("ACG", 4, 3, [-1, 5, -3]), ("A", 2, 5, [0, -2, 2, 3, -1])], "parent string, lo bigint, width bigint, index array<int>")
    for piece in (2, 1 << 16):
        monkeypatch.setattr(frontier, "PIECE", piece)
        tracked = {(r["parent"], r["letter"], r["kid_index"], r["index"]) for r in frontier.track(sa, given).collect()}
        assert tracked == {("ACG", "C", 0, -2), ("ACG", "*", 0, 5), ("ACG", "T", 0, -4), ("A", "*", 0, 0), ("A", "A", 0, -3), ("A", "C", 0, 2), ("A", "*", 1, 3), ("A", "T", 0, -2)}
    kids = spark.createDataFrame([("AC", "A", 2, 1, [0]), ("AC", "C", 7, 1, [1]), ("AC", "T", 16, 2, [3, 0])], "parent string, letter string, lo bigint, width bigint, index array<int>")
    grown = frontier.expand(sa, parents.select("parent", "lo", "width"), kids, min_len=2, north=2, south=2, frac=0.5).collect()
    top = next(r for r in grown if r["letter"] == "T")
    assert (top["lo"], top["width"], top["grown"]) == (16, 2, 0)
    assert frontier.expand(sa, parents.select("parent", "lo", "width"), kids, min_len=2, north=2, south=2, frac=0.9, greedy=True).count() == 0


def test_row_dump(sa, corpus):
    line = {r["row"]: r["line"] for r in suffix.row_dump(sa, corpus, 4, 3).collect()}[4]
    assert line == "         4         4         8 *AAC C ACGT" + "*" * 26


def test_programs(spark, corpus):
    from strandloom.plans import programs

    index = programs.build(corpus, "DNA/w")
    assert programs.inspect_word(index, "acgt") == (4, 3)
    assert programs.inspect_word(index, "GGG") == (0, 0)
    assert programs.inspect_word_rows(index, "T").count() == 4 and programs.inspect_word_rows(index, "GGG").count() == 0
    assert programs.inspect_forward(index, 12) == "GT*" and programs.inspect_forward(index, 99) is None
    assert {r["value"] for r in programs.inspect_sequences(index, -1).collect()} == {"s1 ACGTACGTTN", "s2 AACCACGT"}
    assert {tuple(r) for r in programs.inspect_names(index).collect()} == {(0, 8, 1, "s2"), (1, 10, 0, "s1")}
    qs = table(spark, [("a", "acgtaccacg")])
    assert {r["line"] for r in programs.find(index, qs, 3, lines=True).collect()} == {"s2 pos:1 start:3 qi:4 ql:6", "s1 pos:0 start:5 qi:0 ql:6"}
    with pytest.raises(ValueError):
        programs.mine_repeats(index)
    sites = programs.predict(corpus, kmin=1, kmax=2, alpha=1.0, name="s2")
    assert sites.count() == 4
    assert programs.predict_words(sites, 2).count() == 16
    with pytest.raises(ValueError):
        programs.edit(corpus, new_char="N")
    assert programs.edit(corpus, revcomp=True).count() == 2


def test_windows_of_long_sequences(spark, monkeypatch):
    monkeypatch.setattr(kmers, "STEP", 7)
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 3, 7, 8, 9, 14, 50)]
    seqs = table(spark, [("t", t) for t in texts])
    for k, before, short in ((1, 0, False), (3, 0, False), (3, 5, False), (4, 0, True), (9, 2, True)):
        got = sorted(tuple(r) for r in kmers.windows(seqs, k, before=before, short=short).collect())
        want = []
        for i, t in enumerate(texts):
            for p in range(len(t) if short else len(t) - k + 1):
                row = (i, p, t[p : p + k])
                want.append((*row, t[max(0, p - before) : p]) if before else row)
        assert got == sorted(want)


def test_kept_tables(spark, monkeypatch):
    """Stored tables go when they are forgotten; a cluster without a shared folder is refused."""
    import os

    from strandloom.operators import ranking

    df = ranking.kept(spark.range(5).toDF("x"), "t")
    folder = df.kept_at.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(folder)
    ranking.forget(df, None, spark.range(1))
    assert not os.path.exists(folder)

    class Elsewhere:
        """A session on a cluster whose checkpoint folder is not set."""

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("sc", (), {"getCheckpointDir": staticmethod(lambda: type("none", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError, match="checkpoint"):
        ranking.shared_folder(Elsewhere)
