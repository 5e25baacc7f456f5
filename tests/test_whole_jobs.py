"""Registered queries on small tables against brute force, where a part of the job could go missing."""

import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from strandloom.functions.alphabet import DNA
from strandloom.operators import repeats
from strandloom.operators.sequences import sequence_ranks
from strandloom.operators.suffix import suffix_ranks
from strandloom.plans import queries

MAP = str.maketrans(queries.LOWER, queries.MAPPED)
TWIN = str.maketrans("ACGTN", "TGCAN")
ORDER = str.maketrans("ACGTN", "abcde")


def letters(text):
    return "".join(c for c in text if c.isascii() and c.isalpha()).lower().translate(MAP)


def tables(spark, path, texts, passages=("a short passage",)):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


# --- repeats --------------------------------------------------------------------------------------
def mined(texts, minlen, maxlen, least, most):
    """{word: (length, nseq)} of the words recorded on both strands."""
    both = [t for s in texts for t in (s, s.translate(TWIN)[::-1])]
    going, found = None, {}
    for d in range(minlen, maxlen + 2):
        at, left = Counter(), defaultdict(Counter)
        for t in both:
            for i in range(len(t) - d + 1):
                word = t[i : i + d]
                if going is None or word[1:] in going:
                    at[word] += 1
                    if i:
                        left[word][t[i - 1]] += 1
        going = set()
        for word, cs in left.items():
            n = sum(cs.values())
            if at[word] < least or n < least:
                continue
            if max(cs.values()) / n < most:
                found[word] = (d, n)
            else:
                going.add(word)
    return found


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_repeats_reach_the_default_lengths(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", broadcast)
    rng = random.Random(11)

    def some(n):
        return "".join(rng.choice("abcd") for _ in range(n))

    long, longer = some(30), some(60)
    texts = ["abcd"[i % 4].join((some(7), long + some(9))) + "abcd"[i % 4] + longer + some(5) for i in range(24)]
    sf = tables(spark, tmp_path, texts)
    want = mined([letters(t) for t in texts], 25, 45, 10, 0.8)
    assert letters(long) in want
    both = sorted((w, strand, d, n) for x, (d, n) in want.items() for w, strand in ((x, "+"), (x.translate(TWIN)[::-1], "-")))
    after = [*(r[0] for r in both[1:]), ""]
    shown = [r for r, word in zip(both, after, strict=True) if not word.startswith(r[0]) and r[2] <= 45]
    assert any(r[2] > 16 for r in shown)
    got = entry.queries()["exact_repeats"](spark, sf).orderBy("n").collect()
    assert [(r["word"], r["strand"], r["length"], r["nseq"]) for r in got] == shown


@pytest.mark.parametrize("minlen, maxlen, letters", [(25, 45, "ACGT"), (25, 45, "ACN"), (10, 12, "ACGTN"), (26, 70, "AC")])
def test_words_grow_in_one_task_as_they_do_in_all_texts(spark, monkeypatch, minlen, maxlen, letters):
    """Pieces end within words, spans are sent in many lists and equal rows meet in several sorted parts."""
    for name, value in (("STEP", 50), ("SPANS", 300), ("ROWS", 500), ("SHARE", 300), ("BROADCAST_ROWS", 4)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(len(letters) * minlen)

    def some(n):
        return "".join(rng.choice(letters) for _ in range(n))

    one, two, half = some(70), some(40), some(30)
    turned = half + half.translate(TWIN)[::-1]  # its own reverse complement
    texts = [x for i in range(14) for x in (some(i % 3) + one + some(5), two[i % 2 :], some(i) + one[20:] + two, "" if i else "A" * 90)]
    texts += [some(i) + turned + some(3) for i in range(6)]
    rows = [(i, str(i), s, 1) for i, s in enumerate([*texts, None])] + [(-1, "twin", one * 20, -1)]
    seqs = spark.createDataFrame(rows, "sid bigint, name string, s string, strand tinyint")
    want = mined(texts, minlen, maxlen, 10, 0.8)
    assert len(want) > 3
    assert {r["word"]: (r["length"], r["nseq"]) for r in repeats.repeat_words(seqs, DNA, minlen, maxlen).collect()} == want


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_repeats_shuffle_a_few_bytes_for_a_window(spark, monkeypatch, broadcast):
    """Every window is frequent, with as many hashes as the broadcast takes and with more."""
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", broadcast)
    rng = random.Random(7)
    base = ["".join(rng.choice("ACGT") for _ in range(20_000)) for _ in range(5)]
    texts = [base[i % 5] for i in range(60)]
    seqs = spark.createDataFrame([(i, str(i), s, 1) for i, s in enumerate(texts)], "sid bigint, name string, s string, strand tinyint").repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()

    def sent():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        jobs = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(jobs.apply(i).shuffleWriteBytes() for i in range(jobs.size()))

    before = sent()
    assert repeats.repeat_words(seqs, DNA).count() == 0
    assert sent() - before < 5 * sum(map(len, texts))


# --- index ----------------------------------------------------------------------------------------
def suffixes(texts):
    """[(sid, pos, bwt)] of all rows of the suffix table, by sorting the suffixes themselves."""
    ends = [(i, len(t), t[-1:] or "*") for i, t in enumerate(texts)]
    body = sorted((t[p:].translate(ORDER), i, p, t[p - 1] if p else "*") for i, t in enumerate(texts) for p in range(len(t)))
    return ends + [(i, p, c) for _, i, p, c in body]


def starts(rows):
    n = Counter(c for *_, c in rows)
    return {c: sum(n[d] for d in "*ACGTN"[: "*ACGTN".index(c)]) for c in n}


def test_every_row_has_ranks(spark, tmp_path):
    passages = ["dab badd", "", "abba dab", "cxyz", "abba dab"]
    rows = suffixes([letters(t) for t in passages])
    first = starts(rows)
    want = {(k, c, n + sum(x[2] == c for x in rows[:k])) for k in range(len(rows)) for c, n in first.items()}
    got = entry.queries()["rank_all_letters"](spark, tables(spark, tmp_path, ["none"], passages))
    assert got.count() == len(want) and {tuple(r) for r in got.select("k", "bwt", "lf").collect()} == want


# --- index over documents -------------------------------------------------------------------------
def test_documents_are_indexed(spark, tmp_path):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdx") for _ in range(n)) for n in (30, 0, 55, 1)]
    texts += [texts[2], texts[0][5:]]
    q, sf = entry.queries(), tables(spark, tmp_path, texts)
    seqs = [letters(t) for t in texts]
    rows = suffixes(seqs)
    row = {(i, p): k for k, (i, p, _) in enumerate(rows)}
    got = {r["row"]: r for r in q["documents_suffix_rows"](spark, sf).collect()}
    assert [(got[k]["sid"], got[k]["pos"], got[k]["bwt"]) for k in range(len(rows))] == rows
    assert all(got[k]["lf"] == row[i, p - 1] for k, (i, p, c) in enumerate(rows) if c != "*")
    found = {r["word"]: (r["lo"], r["width"]) for r in q["documents_word_lookup"](spark, sf).collect()}
    for word in queries.WORDS:
        at = [k for k, (i, p, _) in enumerate(rows) if seqs[i].startswith(word, p)]
        assert found[word] == (min(at, default=0), len(at))


@pytest.mark.parametrize("first", [2, 16])
def test_suffixes_that_end_where_others_go_on(spark, first):
    rng = random.Random(5)
    seqs = ["ACGT" * 4, "ACGT" * 4 + "A", "GG", "G", "", "A" * 70]
    seqs += ["".join(rng.choice("AC") for _ in range(rng.randint(1, 40))) for _ in range(12)]
    seqs += [seqs[6], seqs[7][:20], seqs[8][3:19]]
    df = spark.createDataFrame([(i, f"n{i}", s) for i, s in enumerate(seqs)], "sid bigint, name string, s string")
    ranks = sequence_ranks(df, DNA)
    term = {r["sid"]: r["term_order"] for r in ranks.collect()}
    want = sorted((s[p:], term[i], i, p) for i, s in enumerate(seqs) for p in range(len(s)))
    got = suffix_ranks(ranks, DNA, first).collect()
    assert [(r["sid"], r["pos"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, p) for _, _, i, p in want]
    assert sorted(r["rank"] for r in got) == list(range(len(want)))
