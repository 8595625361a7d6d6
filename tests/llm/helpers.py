"""Small tables with the awkward rows every operator must take."""

import random

from pyspark.sql import functions as F

SYLLABLES = "an be con der el fa gi hor im ju ka lo men no or pa qui re sa ta un ver wa xe yo zu".split()
DOC_TYPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, at string, row string"


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_docs(spark, extra=()):
    """Nulls in every column, empty and very long texts, copies, repeated rows,
    and extra columns whose names operators might want to use."""
    rng = random.Random(5)
    long_text = prose(rng, 30_000)
    texts = [(1, prose(rng, 60), "s1"), (2, None, "s1"), (3, "", None), (4, " \t\n ", "s2"), (5, long_text, "s2"),
             (5, long_text, "s2"), (None, prose(rng, 40), "s3"), (None, None, None), (6, "one", "s1"), (7, "é日本 🙂 \x00 x", "s1")]
    copied = prose(rng, 80)
    texts += [(100 + i, copied, "s4") for i in range(6)]
    texts += [(200 + i, prose(rng, rng.randint(5, 120)), f"s{i % 3}") for i in range(20)]
    texts += list(extra)
    return spark.createDataFrame([(d, t, None, s, None if t is None else len(t), "k", "s", "a", "r") for d, t, s in texts], DOC_TYPE)


def no_docs(spark):
    return spark.createDataFrame([], DOC_TYPE)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def count_ids(df):
    return {r[0]: r[1] for r in df.groupBy("doc_id").agg(F.count(F.lit(1))).collect()}
