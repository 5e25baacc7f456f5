"""The registered queries over the driver's tables, each with its SQL for comparison."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, PROTEIN, number_word, word_number
from ..operators import edit, frontier, kmers, predict, repeats, search, sequences, suffix
from ..operators.ranking import kept
from .index import SequenceIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER = "abcdefghijklmnopqrstuvwxyz"
MAPPED = "ACGTACGTACGTACGTACGTACGTNN"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return register


def dna(spark: SparkSession, sf_dir: str, name: str, sid: str) -> DataFrame:
    """The texts of a table as sequences over A, C, G, T, N, one letter per letter."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(sid, "text")
    return sequences.sequences(df, sid, F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), LOWER, MAPPED))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir, "documents", "doc_id")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir, "benchmark", "item_id")


def index(spark: SparkSession, sf_dir: str, revsort: bool = False, corpus=benchmark, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """The suffix table and its sequences. A table that is read once need not be kept: its rows are made
    from packed ranks as they are read."""
    seqs = corpus(spark, sf_dir)
    sa = suffix.suffix_table(seqs, DNA, revsort)
    return kept(sa, "index") if keep else sa, seqs


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# Views that the SQL of the queries starts from.
def _dna(view: str, table: str, sid: str) -> str:
    return f"{view} AS (SELECT {sid} AS sid, CAST({sid} AS VARCHAR) AS name, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LOWER}', '{MAPPED}') AS s FROM {table})"


DOCS = _dna("docs", "documents", "doc_id")
BENCH = _dna("bench", "benchmark", "item_id")
RC = "reverse(translate({0}, 'ACGTN', 'TGCAN'))"
ENC = "translate({0}, 'ACGTN', 'abcde')"


def _grams(view: str, source: str, k: int, extra: str = "sid, ") -> str:
    return f"{view} AS (SELECT {extra}CAST(i - 1 AS BIGINT) AS pos, substr(s, i, {k}) AS word FROM (SELECT {extra}s, unnest(range(1, length(s) - {k} + 2)) AS i FROM {source} WHERE length(s) >= {k}))"


# Suffixes of the benchmark table in sorted order.
def _sa(order: str = "sid") -> str:
    return f"""{BENCH}, r0 AS (SELECT sid, name, s, row_number() OVER (ORDER BY {order}) - 1 AS term_order FROM bench),
    r AS (SELECT *, row_number() OVER (ORDER BY {ENC.format('s')}, term_order) - 1 AS srank FROM r0),
    suf AS (SELECT sid, srank, term_order, i - 1 AS pos, CASE WHEN i = 1 THEN '*' ELSE substr(s, i - 1, 1) END AS bwt, {ENC.format('substr(s, i)')} AS t
      FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM r)),
    body AS (SELECT (SELECT count(*) FROM r) + row_number() OVER (ORDER BY t, term_order) - 1 AS row, sid, srank, pos, bwt FROM suf),
    rows AS (SELECT * FROM body UNION ALL SELECT term_order, sid, srank, length(s), CASE WHEN s = '' THEN '*' ELSE right(s, 1) END FROM r),
    starts AS (SELECT bwt, sum(count(*)) OVER (ORDER BY CASE WHEN bwt = '*' THEN '' ELSE {ENC.format('bwt')} END) - count(*) AS c FROM rows GROUP BY bwt),
    sa AS (SELECT CAST(row AS BIGINT) AS row, sid, CAST(srank AS BIGINT) AS srank, CAST(pos AS BIGINT) AS pos, bwt,
      CAST(CASE WHEN bwt = '*' THEN srank ELSE c + row_number() OVER (PARTITION BY bwt ORDER BY row) - 1 END AS BIGINT) AS lf FROM rows JOIN starts USING (bwt))"""


SA = _sa()


# --- counting -------------------------------------------------------------------------------------
def _kmer_sql(k: int) -> str:
    return f"WITH {DOCS}, {_grams('g', 'docs', k)} SELECT word, count(*) AS n FROM g GROUP BY word"


@query(_kmer_sql(4))
def kmer_counts_k4(spark, sf_dir):
    return kmers.kmer_counts(documents(spark, sf_dir), 4)


@query(_kmer_sql(7))
def kmer_counts_k7(spark, sf_dir):
    return kmers.kmer_counts(documents(spark, sf_dir), 7)


@query(f"WITH {DOCS}, {_grams('g', 'docs', 5)}, c AS (SELECT word, count(*) AS n FROM g GROUP BY word), b AS (SELECT * FROM c UNION ALL SELECT {RC.format('word')}, n FROM c) SELECT word, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY word")
def kmer_counts_both_strands(spark, sf_dir):
    return kmers.both_strand_counts(documents(spark, sf_dir), 5, DNA)


@query("""WITH p AS (SELECT doc_id AS sid, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOUZ', 'XXXXX') AS s FROM documents),
  """ + _grams("g", "p", 3) + " SELECT word, count(*) AS n FROM g GROUP BY word")
def protein_kmer_counts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return kmers.kmer_counts(sequences.sequences(df, "doc_id", PROTEIN.clean(F.col("text"))), 3)


@query("""WITH e AS (SELECT user_id AS sid, string_agg(chr(65 + CAST(k AS INTEGER)), '' ORDER BY ts, event_id) AS s
  FROM (SELECT *, dense_rank() OVER (ORDER BY event_type) - 1 AS k FROM events) GROUP BY user_id), """ + _grams("g", "e", 3) + " SELECT word, count(*) AS n FROM g GROUP BY word")
def event_kmer_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    kinds = events.select("event_type").distinct()
    kinds = kinds.select("event_type", F.expr("char(64 + row_number() OVER (ORDER BY event_type))").alias("letter"))
    rows = events.join(kinds, "event_type").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "letter"))), lambda x: x["letter"]), "").alias("text"))
    return kmers.kmer_counts(sequences.sequences(rows, "user_id", "text"), 3)


@query(f"""WITH {DOCS}, {_grams('g', 'docs', 5)}, c AS (SELECT substr(word, 2, 4) AS word, substr(word, 1, 1) AS left_letter, count(*) AS n FROM g GROUP BY 1, 2)
  SELECT word, left_letter, n, CAST(sum(n) OVER (PARTITION BY word) AS BIGINT) AS tot, max(n) OVER (PARTITION BY word) AS top FROM c""")
def left_neighbour_histogram(spark, sf_dir):
    return kmers.neighbour_histogram(documents(spark, sf_dir), 4)


@query(f"""WITH {DOCS}, {_grams('g', 'docs', 5)}, c AS (SELECT substr(word, 2, 4) AS word, translate(substr(word, 1, 1), 'ACGT', 'TGCA') AS c FROM g)
  SELECT word, count(*) FILTER (c = 'A') AS n_a, count(*) FILTER (c = 'C') AS n_c, count(*) FILTER (c = 'G') AS n_g, count(*) FILTER (c = 'T') AS n_t FROM c GROUP BY word""")
def nucleotide_kids(spark, sf_dir):
    return kmers.nucleotide_kids(documents(spark, sf_dir), 4, complement=True)


@query(f"""WITH {DOCS}, g AS (SELECT substr(s, i, 4) AS bucket FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM docs)), c AS (SELECT bucket, count(*) AS n FROM g GROUP BY bucket)
  SELECT bucket, n, CAST(sum(n) OVER (ORDER BY {ENC.format('bucket')}) - n + (SELECT count(*) FROM docs) AS BIGINT) AS start FROM c""")
def bucket_histogram(spark, sf_dir):
    return kmers.bucket_histogram(documents(spark, sf_dir), DNA)


@query(f"WITH {DOCS} SELECT CAST(sum(length(s) + 1) AS BIGINT) AS bwt_len, count(*) AS nseq, max(length(s)) AS max_len FROM docs")
def corpus_stats(spark, sf_dir):
    return sequences.corpus_stats(documents(spark, sf_dir))


@query(f"WITH {DOCS} SELECT row_number() OVER (ORDER BY {ENC.format('s')}, sid) - 1 AS srank, length(s) AS signed_length, row_number() OVER (ORDER BY sid) - 1 AS terminator_row, name FROM docs")
def sequence_catalogue(spark, sf_dir):
    return sequences.sequence_catalogue(documents(spark, sf_dir), DNA)


@query(f"""WITH {DOCS}, n AS (SELECT max(sid) + 1 AS k FROM docs), b AS (SELECT sid, name, s, 1 AS strand FROM docs UNION ALL SELECT sid + k, name, {RC.format('s')}, -1 FROM docs, n)
  SELECT sid, name, md5(s) AS digest, length(s) AS len, CAST(strand AS TINYINT) AS strand FROM b""")
def both_strand_set(spark, sf_dir):
    return sequences.with_revcomp(documents(spark, sf_dir), DNA).select("sid", "name", F.md5("s").alias("digest"), F.length("s").cast("bigint").alias("len"), "strand")


# --- index ----------------------------------------------------------------------------------------
@query(f"WITH {SA} SELECT * FROM sa")
def suffix_rows(spark, sf_dir, corpus=benchmark):
    return index(spark, sf_dir, corpus=corpus, keep=False)[0]


@query(f"WITH {SA} SELECT row, bwt FROM sa WHERE row BETWEEN 100 AND 1099")
def bwt_slice(spark, sf_dir):
    return suffix.bwt_slice(index(spark, sf_dir)[0], 100, 1000)


@query(f"WITH {SA} SELECT bwt, count(*) AS n, min(lf) AS first_lf, max(lf) AS last_lf, CAST(sum(lf) AS BIGINT) AS sum_lf FROM sa GROUP BY bwt")
def lf_mapping(spark, sf_dir, corpus=benchmark):
    sa = index(spark, sf_dir, corpus=corpus, keep=False)[0]
    return sa.groupBy("bwt").agg(F.count(F.lit(1)).alias("n"), F.min("lf").alias("first_lf"), F.max("lf").alias("last_lf"), F.sum("lf").alias("sum_lf"))


@query(f"WITH {_sa('reverse(' + ENC.format('s') + '), sid')} SELECT row, sid, srank, bwt FROM sa WHERE row < (SELECT count(*) FROM bench)")
def terminator_rows_revsort(spark, sf_dir):
    sa, seqs = index(spark, sf_dir, revsort=True)
    return sa.where(F.col("row") < seqs.count()).select("row", "sid", "srank", "bwt")


@query(f"WITH {SA} SELECT lf AS row, row AS forward_row FROM sa WHERE bwt <> '*'")
def inverse_lf(spark, sf_dir, corpus=benchmark):
    return suffix.inverse_lf(index(spark, sf_dir, corpus=corpus, keep=False)[0])


@query(f"WITH {SA} SELECT row, substr(s || '*', CAST(pos AS INTEGER) + 1, 500) AS text FROM sa JOIN bench USING (sid)")
def forward_walk(spark, sf_dir):
    return suffix.forward_walk(*index(spark, sf_dir))


@query(f"WITH {SA} SELECT CAST(srank AS BIGINT) AS srank, s FROM r")
def reconstruct(spark, sf_dir, corpus=benchmark):
    return suffix.reconstruct(index(spark, sf_dir, corpus=corpus, keep=False)[0])


@query(f"WITH {SA} SELECT row, srank, pos FROM sa WHERE row >= (SELECT count(*) FROM bench) AND row % 32 = 0")
def sa_samples(spark, sf_dir, corpus=benchmark):
    sa, seqs = index(spark, sf_dir, corpus=corpus, keep=False)
    return suffix.samples(sa, nseq=seqs.count())


@query(f"""WITH {SA}, c AS (SELECT row // 256 AS block, bwt, count(*) AS n FROM sa GROUP BY 1, 2), g AS (SELECT block, bwt FROM (SELECT DISTINCT block FROM c), (SELECT DISTINCT bwt FROM c))
  SELECT block, bwt, CAST(coalesce(sum(n) OVER (PARTITION BY bwt ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS occ FROM g LEFT JOIN c USING (block, bwt)""")
def occ_checkpoints(spark, sf_dir):
    return suffix.occ_checkpoints(index(spark, sf_dir)[0], 256)


@query(f"""WITH {SA}, x AS (SELECT row AS k, l.bwt, l.c, CASE WHEN sa.bwt = l.bwt THEN 1 ELSE 0 END AS hit FROM sa, starts l)
  SELECT k, bwt, CAST(c + coalesce(sum(hit) OVER (PARTITION BY bwt ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lf FROM x""")
def rank_all_letters(spark, sf_dir):
    """The rank of every letter at every row."""
    sa = index(spark, sf_dir)[0]
    return suffix.rank_all(sa, sa.select(F.col("row").alias("k")), DNA, 256)


@query(f"WITH {SA} SELECT row, substr(s || '*', CAST(pos AS INTEGER) + 1, 1) AS letter FROM sa JOIN bench USING (sid)")
def first_letters(spark, sf_dir):
    return suffix.first_letters(*index(spark, sf_dir))


@query(f"WITH {SA} SELECT row AS term_order, srank FROM sa WHERE row < (SELECT count(*) FROM bench)")
def terminator_inverse(spark, sf_dir):
    sa, seqs = index(spark, sf_dir)
    return suffix.terminator_inverse(sa, seqs.count())


def _intervals(k: int) -> str:
    return f"SELECT word, min(row) AS lo, count(*) AS width FROM g{k} JOIN sa USING (sid, pos) GROUP BY word"


@query(f"WITH {SA}, {_grams('g1', 'bench', 1)} {_intervals(1)}")
def initial_intervals(spark, sf_dir):
    return suffix.initial_intervals(*index(spark, sf_dir))


@query(f"WITH {SA}, {_grams('g3', 'bench', 3)} {_intervals(3)}")
def extend_backward(spark, sf_dir, corpus=benchmark):
    """Two backward extensions from the letters: all words of three."""
    sa, seqs = index(spark, sf_dir, corpus=corpus, keep=False)
    one = kept(suffix.initial_intervals(sa, seqs), "intervals")
    rows = suffix.bwt_rows(sa)
    two = kept(suffix.extend_backward(rows, one, DNA), "intervals")
    return suffix.extend_backward(rows, two, DNA)


@query(f"WITH {SA}, {_grams('g4', 'bench', 4)}, w AS ({_intervals(4)}) SELECT w.word, w.lo, w.width, coalesce(v.lo, -1) AS rlo FROM w LEFT JOIN w v ON v.word = {RC.format('w.word')}")
def reverse_intervals(spark, sf_dir, corpus=benchmark):
    out = suffix.reverse_intervals(kept(suffix.word_intervals(*index(spark, sf_dir, corpus=corpus, keep=False), [4]), "intervals"), DNA)
    return out.withColumn("rlo", F.coalesce("rlo", F.lit(-1)))


WORDS = ("ACGT", "AC", "T", "N", "GATTACA", "NNNN", "TACG", "CCA", "GGGGGGGG")


@query(f"""WITH {SA}, w AS (SELECT unnest({list(WORDS)!r}) AS word)
  SELECT w.word, coalesce(min(x.row), 0) AS lo, count(x.row) AS width FROM w LEFT JOIN (SELECT row, substr(s, CAST(pos AS INTEGER) + 1) AS t FROM sa JOIN bench USING (sid) WHERE pos < length(s)) x ON starts_with(x.t, w.word) GROUP BY w.word""")
def word_lookup(spark, sf_dir, corpus=benchmark):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return suffix.lookup(*index(spark, sf_dir, corpus=corpus, keep=False), words)


@query(f"""WITH {SA} SELECT row, lpad(CAST(row AS VARCHAR), 10, ' ') || lpad(CAST(pos AS VARCHAR), 10, ' ') || lpad(CAST(length(s) AS VARCHAR), 10, ' ') || ' ' ||
  lpad(right(CASE WHEN pos = 0 THEN '' WHEN row < (SELECT count(*) FROM bench) THEN left(s, length(s) - 1) ELSE left(s, CAST(pos AS INTEGER) - 1) END, 4), 4, '*') || ' ' || bwt || ' ' || rpad(substr(s, CAST(pos AS INTEGER) + 1, 30), 30, '*') AS line
  FROM sa JOIN bench USING (sid) WHERE row BETWEEN 190 AND 309""")
def row_dump(spark, sf_dir):
    return suffix.row_dump(*index(spark, sf_dir), start=200, length=100, up=10, down=10)


@query(f"""WITH {SA}, {', '.join(_grams(f'g{k}', 'bench', k) for k in (1, 2, 3))}, w1 AS ({_intervals(1)}), w2 AS ({_intervals(2)}), w3 AS ({_intervals(3)}),
  a AS (SELECT *, 1 AS depth FROM w1 WHERE width >= 50), b AS (SELECT *, 2 AS depth FROM w2 WHERE width >= 50 AND substr(word, 2) IN (SELECT word FROM a)),
  c AS (SELECT *, 3 AS depth FROM w3 WHERE width >= 50 AND substr(word, 2) IN (SELECT word FROM b)) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def visit_words(spark, sf_dir):
    """Words of up to three letters with at least 50 occurrences, by pruned levels."""
    sa, seqs = index(spark, sf_dir)
    return frontier.visit_words(sa, seqs, DNA, lambda level, depth: level.where("width >= 50"), 3)


@query(f"""WITH {SA}, {_grams('g2', 'bench', 2)}, p AS ({_intervals(2)})
  SELECT word AS parent, bwt AS letter, CAST(row_number() OVER (PARTITION BY word, bwt ORDER BY row) - 1 AS BIGINT) AS kid_index, CAST(row - lo AS BIGINT) AS index FROM p JOIN sa ON row >= lo AND row < lo + width""")
def track_positions(spark, sf_dir):
    sa, seqs = index(spark, sf_dir)
    parents = suffix.word_intervals(sa, seqs, [2]).select(F.col("word").alias("parent"), "lo", "width", F.lit(None).cast("array<int>").alias("index"))
    return frontier.track(sa, parents).select("parent", "letter", F.col("kid_index").cast("bigint").alias("kid_index"), F.col("index").cast("bigint").alias("index"))


@query(f"WITH {SA}, {_grams('g3', 'bench', 3)}, {_grams('g4', 'bench', 4)}, w3 AS ({_intervals(3)}), w4 AS ({_intervals(4)}) SELECT w4.word AS kid, w3.word AS parent FROM w4 JOIN w3 USING (lo, width)")
def identical_kids(spark, sf_dir):
    """Words of four letters whose rows are those of a word of three."""
    sa, seqs = index(spark, sf_dir)
    parents = kept(suffix.word_intervals(sa, seqs, [3]), "parents")
    return frontier.identical_kids(parents, suffix.extend_backward(sa, parents, DNA))


@query(f"""WITH {SA}, {_grams('g3', 'bench', 3)}, {_grams('g4', 'bench', 4)}, w AS ({_intervals(3)} UNION ALL {_intervals(4)})
  SELECT word, lo, width FROM w QUALIFY row_number() OVER (PARTITION BY lo, width ORDER BY {ENC.format('word')}) = 1""")
def promoted_kids(spark, sf_dir):
    """Words of three and four letters, each interval once."""
    sa, seqs = index(spark, sf_dir)
    parents = kept(suffix.word_intervals(sa, seqs, [3]), "parents")
    return frontier.promote(parents.unionByName(suffix.extend_backward(sa, parents, DNA)), DNA)


def _beyond(name: str, one: str, two: str) -> str:
    return f"CASE WHEN wins AND {one} = letter THEN CASE WHEN {two} = letter THEN 2 ELSE 1 END ELSE 0 END AS {name}"


@query(f"""WITH {SA}, {_grams('g2', 'bench', 2)}, p AS ({_intervals(2)}),
  k AS (SELECT word AS parent, bwt AS letter, min(lf) AS klo, count(*) AS t, string_agg(CAST(row - lo AS VARCHAR), ',' ORDER BY row) AS index FROM p JOIN sa ON row >= lo AND row < lo + width WHERE bwt <> '*' GROUP BY 1, 2),
  m AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY t DESC, {ENC.format('letter')}) = 1 AND t >= 0.4 * sum(t) OVER (PARTITION BY parent) AS wins FROM k),
  grow AS (SELECT m.*, {_beyond('n', 'a.bwt', 'b.bwt')}, {_beyond('s', 'c.bwt', 'd.bwt')} FROM m JOIN p ON p.word = m.parent
    LEFT JOIN sa a ON a.row = lo - 1 LEFT JOIN sa b ON b.row = lo - 2 LEFT JOIN sa c ON c.row = lo + width LEFT JOIN sa d ON d.row = lo + width + 1)
  SELECT parent, letter, klo - n AS lo, t + n + s AS width, repeat('-1,', CAST(n AS INTEGER)) || index || repeat(',-1', CAST(s AS INTEGER)) AS index,
    max(CASE WHEN wins THEN n + s ELSE -1 END) OVER (PARTITION BY parent) AS grown FROM grow""")
def expand_intervals(spark, sf_dir):
    """Kids of all words of two letters; the majority kid takes up to two rows on either side."""
    sa, seqs = index(spark, sf_dir)
    parents = kept(suffix.word_intervals(sa, seqs, [2]).select(F.col("word").alias("parent"), "lo", "width"), "parents")
    found = frontier.track(sa, parents.withColumn("index", F.lit(None).cast("array<int>"))).where("letter <> '*'")
    first = sa.join(F.broadcast(parents.select("parent", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("width") - 1)).alias("row"))), "row")
    first = first.groupBy("parent", F.col("bwt").alias("letter")).agg(F.min("lf").alias("lo"), F.count(F.lit(1)).alias("width"))
    index_ = F.transform(F.array_sort(F.collect_list(F.struct("kid_index", "index"))), lambda x: x["index"])
    kids = first.join(found.groupBy("parent", "letter").agg(index_.alias("index")), ["parent", "letter"])
    out = frontier.expand(sa, parents, kids, min_len=2, north=2, south=2, frac=0.4)
    return out.select("parent", "letter", "lo", "width", F.array_join(F.transform("index", lambda i: i.cast("string")), ",").alias("index"), "grown")


@query(f"WITH {SA}, {_grams('g3', 'bench', 3)} SELECT x.word, x.lo, x.width, (SELECT count(*) FROM sa) AS rows, (SELECT CAST(sum(lf) AS BIGINT) FROM sa) AS sum_lf, (SELECT count(*) FROM bench) AS sequences FROM ({_intervals(3)}) x")
def saved_index(spark, sf_dir):
    """An index written to files and read back: all its words of three letters, and totals."""
    import uuid

    from ..operators.ranking import shared_folder

    path = f"{shared_folder(spark).rstrip('/')}/saved-{uuid.uuid4().hex}"
    SequenceIndex.build(benchmark(spark, sf_dir), DNA).save(path)
    again = SequenceIndex.load(spark, path)
    words = kmers.windows(again.seqs, 3).select("word").distinct()
    totals = again.sa.agg(F.count(F.lit(1)).alias("rows"), F.sum("lf").alias("sum_lf")).crossJoin(again.seqs.agg(F.count(F.lit(1)).alias("sequences")))
    return again.lookup(words).crossJoin(F.broadcast(totals))


# --- search ---------------------------------------------------------------------------------------
SEED = 24


def _matches(source: str = "bench", corpus: str = "docs", seed: int = SEED) -> str:
    return f"""{DOCS}, {BENCH}, {_grams('q', source, seed)}, {_grams('t', corpus, seed)},
    h AS (SELECT q.sid AS qid, t.sid, q.pos AS qpos, t.pos - q.pos AS d FROM q JOIN t USING (word)),
    i AS (SELECT *, qpos - row_number() OVER (PARTITION BY qid, sid, d ORDER BY qpos) AS grp FROM h),
    runs AS (SELECT qid, sid, min(qpos) AS qi, max(qpos) + {seed} AS qe, min(qpos) + d AS tpos FROM i GROUP BY qid, sid, d, grp),
    sp AS (SELECT qid, qi, qe, count(*) AS width FROM runs GROUP BY ALL),
    mx AS (SELECT qid, qi, qe, qe - qi AS ql, width FROM sp a WHERE NOT EXISTS (SELECT 1 FROM sp b WHERE b.qid = a.qid AND b.qi <= a.qi AND b.qe >= a.qe AND (b.qi < a.qi OR b.qe > a.qe)))"""


@query(f"WITH {_matches()} SELECT qid, qi, ql, width FROM mx")
def max_matches(spark, sf_dir):
    return search.max_matches(benchmark(spark, sf_dir), documents(spark, sf_dir), SEED)


@query(f"WITH {_matches()} SELECT qid, qi, ql, width FROM mx a WHERE coalesce((SELECT sum(width) FROM mx b WHERE b.qid = a.qid AND b.ql > a.ql), 0) < 2")
def max_matches_topk(spark, sf_dir):
    return search.max_matches(benchmark(spark, sf_dir), documents(spark, sf_dir), SEED, max_match=2)


@query(f"WITH {_matches()} SELECT qid, qi, ql, width FROM mx a WHERE NOT (qi = 0 AND EXISTS (SELECT 1 FROM mx b WHERE b.qid = a.qid AND b.qi = 1))")
def max_matches_compat(spark, sf_dir):
    return search.max_matches(benchmark(spark, sf_dir), documents(spark, sf_dir), SEED, compat=True)


@query(f"WITH {_matches()} SELECT qid, qi, ql, width FROM mx a WHERE ql = (SELECT max(ql) FROM mx b WHERE b.qid = a.qid)")
def longest_match(spark, sf_dir):
    return search.longest_matches(benchmark(spark, sf_dir), documents(spark, sf_dir), SEED)


@query(f"WITH {_matches()} SELECT qid, qi, ql, sid, tpos FROM mx JOIN runs USING (qid, qi, qe)")
def match_hits(spark, sf_dir):
    return search.match_hits(benchmark(spark, sf_dir), documents(spark, sf_dir), SEED)


@query(f"""WITH {_matches()} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ql DESC, qi, sid, tpos) AS ord, sid || ' pos:' || tpos || ' qi:' || qi || ' ql:' || ql AS line FROM mx JOIN runs USING (qid, qi, qe)""")
def hit_lines(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return search.hit_lines(search.match_hits(benchmark(spark, sf_dir), docs, SEED), docs).select("qid", F.col("ord").cast("bigint").alias("ord"), "line")


@query()
def greedy_matches(spark, sf_dir):
    return search.greedy_matches(benchmark(spark, sf_dir), documents(spark, sf_dir), SEED, 4)


def _reversed_matches(seed: int) -> str:
    return _matches("rev", "bench", seed).replace(f"{BENCH}, ", f"{BENCH}, rev AS (SELECT sid, reverse(s) AS s FROM bench), ", 1)


@query(f"""WITH {_reversed_matches(8)}, {SA.split(', r0 AS', 1)[1].join(['r0 AS', ''])}
  SELECT qid, qi, ql, min(row) AS lo, count(*) AS width FROM mx JOIN runs USING (qid, qi, qe) JOIN sa ON sa.sid = runs.sid AND sa.pos = runs.tpos GROUP BY qid, qi, ql""")
def indexed_matches(spark, sf_dir):
    """Reversed passages searched in an index of the passages, with the rows where the matches start."""
    seqs = benchmark(spark, sf_dir)
    return SequenceIndex.build(seqs, DNA).max_matches(sequences.reversed_set(seqs), 8)


@query(f"""WITH {_reversed_matches(8)}, {SA.split(', r0 AS', 1)[1].join(['r0 AS', ''])},
  st AS (SELECT qid, qi, ql, min(row) AS lo FROM mx JOIN runs USING (qid, qi, qe) JOIN sa ON sa.sid = runs.sid AND sa.pos = runs.tpos GROUP BY qid, qi, ql)
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ql DESC, qi, sid, tpos) AS ord, sid || ' pos:' || tpos || ' start:' || lo || ' qi:' || qi || ' ql:' || ql AS line FROM mx JOIN runs USING (qid, qi, qe) JOIN st USING (qid, qi, ql)""")
def indexed_hit_lines(spark, sf_dir):
    """Reversed passages searched in an index of the passages, printed with the first row of each match."""
    seqs = benchmark(spark, sf_dir)
    lines = SequenceIndex.build(seqs, DNA).hit_lines(sequences.reversed_set(seqs), 8)
    return lines.select("qid", F.col("ord").cast("bigint").alias("ord"), "line")


# --- prediction -----------------------------------------------------------------------------------
def _counts(corpus: str, k: int, markov: bool) -> str:
    size = k + 1 if markov else 2 * k + 1
    name = f"{'m' if markov else 'c'}{k}"
    return f"""{_grams('w' + name, corpus, size)}, f{name} AS (SELECT word, count(*) AS n FROM w{name} GROUP BY word),
    b{name} AS (SELECT word, n FROM f{name} UNION ALL SELECT {RC.format('word')}, n FROM f{name}),
    {name} AS (SELECT substr(word, 1, {k}) || substr(word, {k + 2}, {k}) AS ctx, {', '.join(f"CAST(sum(CASE WHEN substr(word, {k + 1}, 1) = '{c}' THEN n ELSE 0 END) AS DOUBLE) AS n_{c}" for c in 'ACGT')} FROM b{name} WHERE regexp_full_match(word, '[ACGT]+') GROUP BY 1)"""


def _fold(source: str, name: str, kmin: int, kmax: int, alpha: float, markov: bool, subtract: bool, left: str, right: str, ref: str) -> str:
    """CTEs that end in ``name``: source with p_A .. p_T."""
    out, last = [], f"(SELECT *, {', '.join(f'0.0::DOUBLE AS p_{c}' for c in 'ACGT')} FROM {source})"
    for k in range(kmin, kmax + 1):
        here = f"{name}_{k}"
        ctx = f"right({left}, {k})" if markov else f"right({left}, {k}) || left({right}, {k})"
        n = {c: f"coalesce(t.n_{c}, 0)" for c in "ACGT"}
        total = " + ".join(n.values())
        less = "1" if subtract else "0"
        new = ", ".join(f"CASE WHEN {total} > 0 AND {alpha} + ({total}) - {less} > 0 THEN ({alpha} * x.p_{c} + ({n[c]} - CASE WHEN {ref} = '{c}' THEN {less} ELSE 0 END)) / ({alpha} + ({total}) - {less}) ELSE x.p_{c} END AS p_{c}" for c in "ACGT")
        out.append(f"{here} AS (SELECT x.* EXCLUDE (p_A, p_C, p_G, p_T), {new} FROM {last} x LEFT JOIN {'m' if markov else 'c'}{k} t ON t.ctx = {ctx})")
        last = here
    out.append(f"{name} AS (SELECT * FROM {last})")
    return ", ".join(out)


def _sites(kmax: int, window: int) -> str:
    return f"{_grams('win', 'bench', window, 'sid, name, ')}, st AS (SELECT sid, name, pos + {kmax} + 1 AS pos, word AS w, substr(word, {kmax + 1}, 1) AS ref FROM win WHERE regexp_full_match(word, '[ACGT]+'))"


ENTROPY = " + ".join(f"CASE WHEN p_{c} > 0 THEN p_{c} * (2 + log2(p_{c})) ELSE 0 END" for c in "ACGT")
BEST = "CASE " + " ".join(f"WHEN p_{c} >= greatest(p_A, p_C, p_G, p_T) THEN '{c}'" for c in "ACGT") + " END"
OWN = "CASE ref " + " ".join(f"WHEN '{c}' THEN p_{c}" for c in "ACGT") + " END"
SHOWN = f"sid, pos, w AS \"window\", ref, {BEST} AS alt, {', '.join(f'round(p_{c}, 6) AS p_{c}' for c in 'ACGT')}, round({OWN}, 6) AS p_ref, round({ENTROPY}, 6) AS entropy"

CENTRAL = f"{BENCH}, {_counts('bench', 2, False)}, {_counts('bench', 3, False)}, {_sites(3, 7)}, {_fold('st', 'pr', 2, 3, 100.0, False, True, 'x.w[1:3]', 'x.w[5:7]', 'x.ref')}"
MARKOV = f"{BENCH}, {DOCS}, {_counts('docs', 2, True)}, {_counts('docs', 3, True)}, {_sites(3, 4)}, {_fold('st', 'pr', 2, 3, 100.0, True, False, 'x.w[1:3]', 'NULL', 'x.ref')}"
BOTH = f"""{BENCH}, {_counts('bench', 2, True)}, {_counts('bench', 3, True)}, {_sites(3, 7)}, {_fold('st', 'fw', 2, 3, 100.0, True, True, 'x.w[1:3]', 'NULL', 'x.ref')},
  {_fold('st', 'rv', 2, 3, 100.0, True, True, RC.format('x.w[5:7]'), 'NULL', "translate(x.ref, 'ACGT', 'TGCA')")},
  pr AS (SELECT fw.sid, fw.name, fw.pos, fw.w, fw.ref, {', '.join(f'(fw.p_{c} + rv.p_{d}) / 2 AS p_{c}' for c, d in zip('ACGT', 'TGCA', strict=True))} FROM fw JOIN rv USING (sid, pos))"""


def _sites_shown(corpus: DataFrame, seqs: DataFrame, model: predict.Model) -> DataFrame:
    """Rounded once for each window."""
    cols = [f"p_{c}" for c in "ACGT"]
    table = rounded(predict.window_sites(corpus, seqs, model).drop("sites"), *cols, "p_ref", "entropy")
    return predict.at_sites(seqs, model, table).select("sid", "pos", "window", "ref", "alt", *cols, "p_ref", "entropy")


def _central(spark, sf_dir, corpus=benchmark) -> DataFrame:
    seqs = corpus(spark, sf_dir)
    return predict.site_probabilities(seqs, seqs, predict.Model())


@query(f"WITH {CENTRAL} SELECT {SHOWN} FROM pr")
def central_probs(spark, sf_dir, corpus=benchmark):
    seqs = corpus(spark, sf_dir)
    return _sites_shown(seqs, seqs, predict.Model())


@query(f"WITH {MARKOV} SELECT {SHOWN} FROM pr")
def markov_probs(spark, sf_dir):
    return _sites_shown(documents(spark, sf_dir), benchmark(spark, sf_dir), predict.Model(markov=True, subtract=False))


@query(f"WITH {BOTH} SELECT {SHOWN} FROM pr")
def bidirectional_probs(spark, sf_dir, corpus=benchmark):
    seqs = corpus(spark, sf_dir)
    return _sites_shown(seqs, seqs, predict.Model(markov=True, both=True))


@query(f"""WITH {CENTRAL}, v AS (SELECT *, {BEST} AS alt, {ENTROPY} AS e FROM pr) SELECT name AS "CHROM", pos AS "POS", w AS "ID", ref AS "REF", alt AS "ALT", round({OWN}, 6) AS "QUAL", CASE WHEN alt = ref THEN 'PASS' ELSE 'no' END AS "FILTER",
  printf('E=%.6f;P=%.6f,%.6f,%.6f,%.6f', e, p_A, p_C, p_G, p_T) AS "INFO" FROM v""")
def vcf_sites(spark, sf_dir, corpus=benchmark):
    seqs = corpus(spark, sf_dir)
    return predict.vcf_sites(seqs, seqs, predict.Model(), 6)


@query(f"WITH {CENTRAL} SELECT count(*) AS total, count(*) FILTER ({BEST} = ref) AS correct, round(count(*) FILTER ({BEST} = ref) / count(*), 6) AS fraction FROM pr")
def prediction_accuracy(spark, sf_dir, corpus=benchmark):
    seqs = corpus(spark, sf_dir)
    return rounded(predict.accuracy(predict.window_sites(seqs, seqs, predict.Model()), "sites"), "fraction")


STATS = f"""{CENTRAL}, v AS (SELECT sid, pos, ref, {OWN} AS p, pos - row_number() OVER (PARTITION BY sid ORDER BY pos) AS island FROM pr),
  l AS (SELECT ref, p, lag(ref) OVER o AS ref1, lag(p) OVER o AS p1, lag(ref, 2) OVER o AS ref2, lag(p, 2) OVER o AS p2 FROM v WINDOW o AS (PARTITION BY sid, island ORDER BY pos)),
  m AS (SELECT ref2 || ref1 || ref AS word, p2 * p1 * p AS p FROM l WHERE ref2 IS NOT NULL),
  s AS (SELECT word, count(*) AS count, avg(p) AS prob, CASE WHEN min(p) > 0 THEN avg(log2(CASE WHEN p > 0 THEN p END)) END AS logp FROM m GROUP BY word)"""


@query(f"WITH {STATS} SELECT word, count, round(prob, 6) AS prob, round(logp, 6) AS logp FROM s")
def word_stats(spark, sf_dir, corpus=benchmark):
    return rounded(predict.word_statistics(_central(spark, sf_dir, corpus), 3), "prob", "logp")


@query(f"""WITH {STATS}, a AS (SELECT unnest(range(64)) AS num), w AS (SELECT num, substr('ACGT', num // 16 + 1, 1) || substr('ACGT', num // 4 % 4 + 1, 1) || substr('ACGT', num % 4 + 1, 1) AS word FROM a)
  SELECT num, word, coalesce(count, 0) AS count, round(coalesce(prob, 0), 6) AS prob, round(coalesce(logp, 0), 6) AS logp FROM w LEFT JOIN s USING (word)""")
def word_table(spark, sf_dir, corpus=benchmark):
    return rounded(predict.word_table(predict.word_statistics(_central(spark, sf_dir, corpus), 3), 3), "prob", "logp")


# --- the same over the corpus ---------------------------------------------------------------------
def _over_documents(f, sql: bool) -> None:
    """Registers f over documents. SQL is that of f over docs; sorting all suffixes of documents as
    texts is quadratic in their length, so the index has none and is compared with brute force."""
    name = f"documents_{f.__name__}"
    QUERIES[name] = partial(f, corpus=documents)
    if sql:
        ORACLES[name] = re.sub(r"\bbench\b", "docs", ORACLES[f.__name__].replace(BENCH, DOCS))


for _f in (suffix_rows, lf_mapping, inverse_lf, reconstruct, sa_samples, extend_backward, word_lookup, reverse_intervals):
    _over_documents(_f, sql=False)
for _f in (central_probs, bidirectional_probs, vcf_sites, prediction_accuracy, word_stats, word_table):
    _over_documents(_f, sql=True)


# --- repeats --------------------------------------------------------------------------------------
MINLEN, MAXLEN, OFTEN, FRAC = 25, 45, 10, 0.8


def _repeat_levels(view: str = DOCS, corpus: str = "docs", MINLEN: int = MINLEN, MAXLEN: int = MAXLEN, OFTEN: int = OFTEN) -> str:  # noqa: N803
    out = [f"{view}, both_ AS (SELECT sid, s FROM {corpus} UNION ALL SELECT -1 - sid, {RC.format('s')} FROM {corpus})", _grams(f"o{MINLEN}", "both_", MINLEN)]
    for d in range(MINLEN, MAXLEN + 2):
        out.append(f"l{d} AS (SELECT o.sid, o.pos, o.word, CASE WHEN o.pos > 0 THEN substr(b.s, CAST(o.pos AS INTEGER), 1) END AS c FROM o{d} o JOIN both_ b USING (sid) WHERE o.word IN (SELECT word FROM o{d} GROUP BY word HAVING count(*) >= {OFTEN}))")
        out.append(f"w{d} AS (SELECT word, CAST(sum(n) AS BIGINT) AS nseq, max(n) / sum(n) AS frac FROM (SELECT word, c, count(*) AS n FROM l{d} WHERE c IS NOT NULL GROUP BY 1, 2) GROUP BY word HAVING sum(n) >= {OFTEN})")
        if d <= MAXLEN:
            out.append(f"o{d + 1} AS (SELECT sid, pos - 1 AS pos, c || word AS word FROM l{d} WHERE c IS NOT NULL AND word IN (SELECT word FROM w{d} WHERE frac >= {FRAC}))")
    out.append("rec AS (" + " UNION ALL ".join(f"SELECT word, {d} AS length, nseq, frac FROM w{d} WHERE frac < {FRAC}" for d in range(MINLEN, MAXLEN + 2)) + ")")
    out.append(f"tw AS (SELECT *, '+' AS strand FROM rec UNION ALL SELECT {RC.format('word')}, length, nseq, frac, '-' FROM rec)")
    out.append(f"fl AS (SELECT *, coalesce(starts_with(lead(word) OVER o, word), false) OR length > {MAXLEN} AS is_substring FROM tw WINDOW o AS (ORDER BY {ENC.format('word')}, strand))")
    return ", ".join(out)


@query(f"WITH {_repeat_levels()} SELECT row_number() OVER (ORDER BY {ENC.format('word')}, strand) AS n, word, strand, CAST(length AS BIGINT) AS length, nseq, round(frac, 6) AS frac, is_substring FROM fl WHERE NOT is_substring")
def exact_repeats(spark, sf_dir):
    return rounded(repeats.exact_repeats(documents(spark, sf_dir), DNA, MINLEN, MAXLEN, OFTEN, FRAC), "frac")


@query(f"WITH {_repeat_levels()} SELECT word, strand, CAST(length AS BIGINT) AS length, is_substring FROM fl")
def exact_repeats_all(spark, sf_dir):
    return repeats.exact_repeats(documents(spark, sf_dir), DNA, MINLEN, MAXLEN, OFTEN, FRAC, printall=True).select("word", "strand", "length", "is_substring")


@query(f"""WITH {_repeat_levels()}, p AS (SELECT *, row_number() OVER (ORDER BY {ENC.format('word')}, strand) AS n FROM fl WHERE NOT is_substring)
  SELECT n, '>Repeat' || n || ' strand=' || strand || ' length=' || length || ' nseq=' || nseq || printf(' frac=%.6f', frac) || chr(10) || word AS line FROM p""")
def repeat_fasta(spark, sf_dir):
    return repeats.repeat_fasta(repeats.exact_repeats(documents(spark, sf_dir), DNA, MINLEN, MAXLEN, OFTEN, FRAC))


BENCH2 = BENCH.replace("bench AS", "bench0 AS", 1) + f", bench AS (SELECT sid, name, s FROM bench0 UNION ALL SELECT sid + (SELECT max(sid) + 1 FROM bench0), name, {RC.format('s')} FROM bench0)"
SA2 = SA.replace(BENCH, BENCH2, 1)


@query(f"""WITH {_repeat_levels(SA2, 'bench0', 10, 14, 4)}, p AS (SELECT *, row_number() OVER (ORDER BY {ENC.format('word')}, strand) AS n FROM fl WHERE NOT is_substring),
  {', '.join(_grams(f'g{k}', 'bench', k) for k in range(10, 15))}, iv AS ({' UNION ALL '.join(_intervals(k) for k in range(10, 15))})
  SELECT n, '>Repeat' || n || ' strand=' || strand || ' SI=' || lo || '-' || (lo + width) || ' length=' || length || ' nseq=' || nseq || printf(' frac=%.6f', frac) || chr(10) || word AS line FROM p JOIN iv USING (word)""")
def indexed_repeat_fasta(spark, sf_dir):
    """Short repeats of the passages with their rows in an index of both strands."""
    return SequenceIndex.build(benchmark(spark, sf_dir), DNA, revcomp=True).repeat_fasta(10, 14, 4, FRAC)


@query(f"WITH {BENCH} SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS place, name, s, CAST(1 AS TINYINT) AS strand FROM bench")
def fasta_files(spark, sf_dir):
    """Sequences written as FASTA files and read back in order."""
    import uuid

    from ..operators.ranking import shared_folder
    from ..sources.fasta import read_fasta, write_fasta

    path = f"{shared_folder(spark).rstrip('/')}/fasta-{uuid.uuid4().hex}"
    seqs = benchmark(spark, sf_dir)
    write_fasta(seqs, path)
    return read_fasta(spark, path, DNA).select(F.col("name").cast("bigint").alias("sid"), F.col("sid").alias("place"), "name", "s", "strand")


@query(f"WITH {BENCH} SELECT row_number() OVER (ORDER BY sid) - 1 AS sid, CAST(row_number() OVER (ORDER BY sid) - 1 AS VARCHAR) AS name, s FROM bench")
def query_files(spark, sf_dir):
    """Passages written as query lines and read back in order."""
    import uuid

    from ..operators.ranking import shared_folder
    from ..sources.fasta import read_queries

    path = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    benchmark(spark, sf_dir).repartitionByRange(3, "sid").sortWithinPartitions("sid").select(F.lower("s").alias("value")).write.text(path)
    return read_queries(spark, path, DNA).select("sid", "name", "s")


@query(f"WITH {BENCH} SELECT '>' || name || chr(10) || array_to_string([substr(s, 1 + 70 * i, 70) FOR i IN range(greatest(1, (length(s) + 69) // 70))], chr(10)) AS value FROM bench")
def fasta_lines(spark, sf_dir):
    from ..sources.fasta import fasta_lines as lines

    return lines(benchmark(spark, sf_dir), 70)


# --- editing --------------------------------------------------------------------------------------
BED = """bed AS (SELECT CAST(item_id AS VARCHAR) AS name, CAST(item_id % 7 + k * 40 AS BIGINT) AS "start", CAST(item_id % 7 + k * 40 + 5 + item_id % 11 AS BIGINT) AS "end" FROM benchmark, (SELECT unnest(range(3)) AS k) WHERE item_id % 5 <> 4)"""


def _bed(spark, sf_dir, table: str = "benchmark", sid: str = "item_id") -> DataFrame:
    """Three intervals on four of five items."""
    items = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(sid).alias("item")).where("item % 5 <> 4")
    rows = items.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    start = F.col("item") % 7 + F.col("k") * 40
    return rows.select(F.col("item").cast("string").alias("name"), start.cast("bigint").alias("start"), (start + 5 + F.col("item") % 11).cast("bigint").alias("end"))


def _edit_sql(feature: str, between: str, skip: bool = False) -> str:
    """Pieces put together again; feature and between are SQL over x."""
    join = "JOIN" if skip else "LEFT JOIN"
    return f"""WITH {BENCH}, {BED}, f AS (SELECT sid, name, s, least("start", length(s)) AS a, least("end", length(s)) AS b, row_number() OVER (PARTITION BY sid ORDER BY "start") AS k, count("start") OVER (PARTITION BY sid) AS m FROM bench {join} bed USING (name)),
    p AS (SELECT sid, name, k, s, a, b, m, coalesce(lag(b) OVER (PARTITION BY sid ORDER BY k), 0) AS e FROM f),
    x AS (SELECT sid, name, 2 * k AS o, false AS is_f, e AS lo, a AS hi, s FROM p WHERE a IS NOT NULL UNION ALL SELECT sid, name, 2 * k + 1, true, a, b, s FROM p WHERE a IS NOT NULL
      UNION ALL SELECT sid, name, 2 * k + 2, false, coalesce(b, 0), length(s), s FROM p WHERE k = greatest(m, 1)),
    y AS (SELECT sid, name, o, is_f, lo, hi, CASE WHEN hi > lo THEN substr(s, CAST(lo + 1 AS INTEGER), CAST(hi - lo AS INTEGER)) ELSE '' END AS x FROM x)
    SELECT sid, name, string_agg(CASE WHEN is_f THEN {feature} ELSE {between} END, '' ORDER BY o) AS s FROM y GROUP BY sid, name"""


def _edited(spark, sf_dir, **options) -> DataFrame:
    return edit.edit_intervals(benchmark(spark, sf_dir), _bed(spark, sf_dir), edit.Edit(**options))


@query(f"WITH {DOCS} SELECT sid, name || '_revcomp' AS name, md5({RC.format('s')}) AS digest FROM docs")
def revcomp(spark, sf_dir):
    return edit.whole_sequences(documents(spark, sf_dir), revcomp=True).select("sid", "name", F.md5("s").alias("digest"))


@query(f"WITH {DOCS} SELECT sid, md5(reverse(s)) AS digest FROM docs")
def reverse(spark, sf_dir):
    return sequences.reversed_set(documents(spark, sf_dir)).select("sid", F.md5("s").alias("digest"))


CODON_ROWS = "SELECT a || b || c AS codon, substr('FFLLSSSSYY$$CC$WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * i + 4 * j + k + 1 AS INTEGER), 1) AS aa FROM (SELECT substr('TCAG', CAST(i + 1 AS INTEGER), 1) AS a, i FROM range(4) t(i)), (SELECT substr('TCAG', CAST(j + 1 AS INTEGER), 1) AS b, j FROM range(4) t(j)), (SELECT substr('TCAG', CAST(k + 1 AS INTEGER), 1) AS c, k FROM range(4) t(k))"


@query(f"""WITH {BENCH}, cod AS ({CODON_ROWS}), st AS (SELECT sid, name || '_transl' AS name, s FROM bench UNION ALL SELECT sid, name || '_revcomp_transl', {RC.format('s')} FROM bench), w AS (SELECT name, sid, i, substr(s, i, 3) AS codon FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM st WHERE length(s) >= 3))
  SELECT sid, name, 'XX' || string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS s FROM w LEFT JOIN cod USING (codon) GROUP BY sid, name""")
def translate_dna(spark, sf_dir):
    return edit.whole_sequences(benchmark(spark, sf_dir), both=True, translate=True)


@query(_edit_sql("lower(x)", "x"))
def case_mask(spark, sf_dir):
    return _edited(spark, sf_dir, lower=True)


@query(_edit_sql("x", "lower(x)"))
def case_mask_inverted(spark, sf_dir):
    return _edited(spark, sf_dir, lower=True, invert=True)


@query(_edit_sql("x", "lower(x)"))
def case_upper(spark, sf_dir):
    """Features of lower-case sequences in upper case."""
    return edit.edit_intervals(benchmark(spark, sf_dir).withColumn("s", F.lower("s")), _bed(spark, sf_dir), edit.Edit(upper=True))


@query(_edit_sql("x", "x"))
def plain_regions(spark, sf_dir):
    """Features without an option: the sequences as they are."""
    return _edited(spark, sf_dir)


@query(re.sub(r"\bbench\b", "docs", _edit_sql("lower(x)", "x").replace(BENCH, DOCS).replace(BED, BED.replace("benchmark", "documents").replace("item_id", "doc_id"))).replace("SELECT sid, name, string_agg", "SELECT sid, name, md5(string_agg").replace("'' ORDER BY o) AS s", "'' ORDER BY o)) AS digest"))
def documents_case_mask(spark, sf_dir):
    """Three intervals on four of five documents in lower case."""
    out = edit.edit_intervals(documents(spark, sf_dir), _bed(spark, sf_dir, "documents", "doc_id"), edit.Edit(lower=True))
    return out.select("sid", "name", F.md5("s").alias("digest"))


@query(_edit_sql("repeat('N', length(x))", "x"))
def mask_char(spark, sf_dir):
    return _edited(spark, sf_dir, new_char="N")


@query(_edit_sql("'ACGT'", "x"))
def replace_regions(spark, sf_dir):
    return _edited(spark, sf_dir, replace="ACGT")


@query(_edit_sql("''", "x"))
def delete_regions(spark, sf_dir):
    return _edited(spark, sf_dir, replace="delete")


@query(_edit_sql("lower(x)", "x", skip=True))
def skip_unmentioned(spark, sf_dir):
    return _edited(spark, sf_dir, lower=True, skip=True)


_PIECES = _edit_sql("x", "x").rsplit("SELECT sid, name, string_agg", 1)[0]


@query(_PIECES + "SELECT sid, name || '_' || (lo + 1) || '-' || hi AS name, x AS s FROM y WHERE is_f")
def split_regions(spark, sf_dir):
    return _edited(spark, sf_dir, split=True)


@query(_PIECES + "SELECT sid, name || '_' || (lo + 1) || '-' || hi AS name, x AS s FROM y WHERE NOT is_f AND hi > lo")
def split_inverted(spark, sf_dir):
    return _edited(spark, sf_dir, split=True, invert=True)


@query(f"""WITH {BED} SELECT name, "start", "end" FROM bed""")
def bed_normalise(spark, sf_dir):
    """Intervals written as 1-based lines and read back."""
    from ..sources.fasta import parse_intervals

    lines = _bed(spark, sf_dir).select(F.concat_ws("\t", "name", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("ignored")).alias("value"))
    comment = spark.createDataFrame([("# name start end",), (" skipped",)], "value string")
    return parse_intervals(lines.unionByName(comment), one_based=True)


@query(f"WITH {BENCH} SELECT name, s FROM bench")
def fasta_round_trip(spark, sf_dir):
    """Records formatted with line breaks and parsed again."""
    from ..sources.fasta import fasta_lines, parse_fasta

    records = fasta_lines(benchmark(spark, sf_dir).withColumn("name", F.concat("name", F.lit(" a description"))), 70)
    return parse_fasta(records.select(F.expr("substring(value, 2)").alias("value")), DNA)


NUMBER = " + ".join(f"(instr('ACGT', substr(word, {i}, 1)) - 1) * {4 ** (6 - i)}" for i in range(1, 7))


@query(f"WITH {DOCS}, {_grams('g', 'docs', 6)} SELECT word, CAST({NUMBER} AS BIGINT) AS number, word AS again FROM (SELECT DISTINCT word FROM g WHERE regexp_full_match(word, '[ACGT]+'))")
def kmer_numbers(spark, sf_dir):
    words = kmers.windows(documents(spark, sf_dir), 6, ()).select("word").where(kmers.acgt(F.col("word"))).distinct()
    return words.withColumn("number", word_number(F.col("word"), "ACGT")).withColumn("again", number_word(F.col("number"), "ACGT", 6))


@query(f"WITH {_matches()} SELECT qid, qi, ql, width FROM mx")
def streaming_search(spark, sf_dir):
    """Benchmark passages as a stream of queries against the documents; rows of all micro-batches. A batch
    that is tried again replaces its rows."""
    import uuid

    from ..operators.ranking import shared_folder
    from ..streaming.search import search_stream

    corpus = documents(spark, sf_dir)
    path = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    source = source.withColumn("text", F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), LOWER, MAPPED))
    source.write.parquet(f"{path}/in")
    lines = spark.readStream.schema(source.schema).parquet(f"{path}/in")
    done = search_stream(lines, corpus, DNA, lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}"), id_col="item_id", text_col="text", min_len=SEED, checkpoint=f"{path}/state")
    done.awaitTermination()
    return spark.read.schema("qid bigint, qi bigint, ql bigint, width bigint, batch bigint").parquet(f"{path}/out").drop("batch")
