"""Rows that every operator must take: nulls, empties, long texts, ties, repeats."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=60, seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(80)]
    out = []
    for i in range(n):
        text = " ".join(rnd.choices(vocab, k=rnd.randint(1, 60)))
        if i % 7 == 0:
            text = text.replace(" ", "\n", 3).title()
        out.append((i, text, rnd.choice(["en", "de", None]), f"src{i % 3}", len(text)))
    out += [(n, None, None, None, None), (n + 1, "", "en", "", 0), (n + 2, " \n\t ", "de", "s", 4),
            (n + 3, out[3][1], "en", "s", 9), (n + 4, "".join(c.upper() if c.isascii() else c for c in out[3][1]), "en", "s", 9),
            (n + 5, "word " * 20_000, "en", "s", 100_000), (n + 6, "x" * 30_000, None, "s", 1),
            (None, "no identifier here at all", "en", "s", 3)]
    return out + [out[5], out[5]]                       # repeated rows


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(df):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F
    for name in ("id", "score", "shard", "fp", "digest", "keep_id", "row", "__x", "sha", "run",
                 "a.b"):
        df = df.withColumn(name, F.lit("extra"))
    return df
