"""Small tables with every odd case, and plain versions of what the operators compute."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of the operators' own making, given as input columns.
CLASHING = ("fp", "key", "block", "shard", "slot", "unit", "span", "tail", "root", "node", "text_key", "copies", "copy", "pass", "score", "labels", "label", "size", "n", "u", "v", "token", "component_id", "lm_row")


def words(rng, n, size=200):
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "to", "ré", "lin", "ka") for b in ("mo", "shi", "tu", "ern") for c in ("", "s", "ing", "ö", "en")]
    return [rng.choice(vocabulary[:size]) for _ in range(n)]


def odd_rows(seed=1, n=40):
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.choice((0, 1, 2, 3, 5, 30, 80)))), "en", rng.choice(("a", "b", None, "é")), 0) for i in range(n)]
    base = words(rng, 120)
    near = list(base)
    near[60] = "changed"
    rows += [(100, " ".join(base), "en", "a", 0), (101, " ".join(base), "en", "b", 0), (102, " ".join(near), "en", "a", 0)]
    rows += [(103, None, None, None, None), (104, "", "en", "a", 0), (105, None, "en", "a", 0), (None, "no id here at all", "en", "a", 0), (None, None, None, None, None)]
    rows += [(106, "same row twice", "en", "a", 0)] * 2 + [(106, "same id, other text", "en", "a", 0)]
    rows += [(107, " ".join(words(rng, 30_000)), "en", "a", 0), (108, "x" * 200_000, "en", "a", 0), (109, "\t \n\r\x0b\x0c", "en", "a", 0), (110, "İ ß Ⅳ \u2028 \u00a0 😀", "en", "b", 0)]
    return [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]


def docs(spark, rows=None, clash=True):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOC_SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("x").alias(c) for c in CLASHING))
    return df
