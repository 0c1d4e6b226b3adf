"""Small tables of awkward rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema)


def words(n, seed=0, kinds=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(kinds)}é" if r.random() < 0.1 else f"w{r.randrange(kinds)}" for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "an id is missing here, all of it"), (5, "x " * 30000), (6, "Ünïcödé ß 漢字 \U0001f600 it's <|endoftext|> 12%"), (7, "a\nb\na\nb\n\n")]


def clashing(df):
    """The table with more columns, some of the names operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("node", "size", "score", "x", "position", "h", "root", "rank", "start", "end", "members", "key", "length", "html")})
