"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, mark string, rank int, k1 bigint, spans string, kept_text string, key string"


def texts(seed: int, n: int) -> list[str | None]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(120)]
    made: list[str | None] = []
    passage = " ".join(rng.choice(vocab) for _ in range(55))
    line = "A line that is Long enough to be counted, é and all the rest."
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 130))]
        if i % 5 == 0:
            words[3:3] = passage.split()
        text = "".join(w + rng.choice([" ", " ", "\n", "\t", "  "]) for w in words)
        if i % 3 == 0:
            text += "\n  " + (line.upper() if i % 2 == 0 else line) + "\r\n"
        if i % 7 == 0 and made:
            text = made[-1]
        made.append(text)
    made[1:1] = [None, "", " \n\t ", "word", "and " * 90, "é", None]
    return made


def documents(spark, n: int = 60, seed: int = 1, repeated: bool = True):
    rows = [(i, t, ["en", "xx", None][i % 3], [None, "b", "a", "é"][i % 4], 7, 5, "m", 1, 2, "s", "k", "y") for i, t in enumerate(texts(seed, n))]
    rows.append((None, "null id " + "and " * 40, None, None, None, None, None, None, None, None, None, None))
    if repeated:
        rows += [rows[12], rows[12], rows[1]]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)
