"""Small tables with nulls, ties, empty and long texts, repeats and clashing extra columns."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["Éa", "ñ x", "日本", "a b", "#%&"]
    passages = [[r.choice(vocab) for _ in range(r.choice([19, 20, 21, 35, 60]))] for _ in range(6)]
    out = []
    for i in range(n):
        t = []
        for _ in range(r.randint(1, 5)):
            t += [r.choice(vocab) for _ in range(r.randint(0, 30))]
            if r.random() < 0.6:
                p = r.choice(passages)
                a = r.randint(0, 3)
                t += p[a : len(p) - r.randint(0, 3)]
        seps = [r.choice([" ", " ", "\n", "\t", "  "]) for _ in t]
        out.append("".join(w + s for w, s in zip(t, seps)))
    out[5] = out[4]
    out[7] = out[4]
    return out + ["", None, " \n\t", "one", "x " * 50, "x " * 19, " ".join("long%d" % (i % 977) for i in range(20000))]


def documents(spark, seed=1, n=60, extra=False):
    ts = texts(seed, n)
    rows = [(i * 3 % 1009, t, "en", "s%d" % (i % 4) if i % 9 else None, None) for i, t in enumerate(ts)]
    rows += [(None, ts[4], None, None, None), rows[4], rows[10], (rows[11][0], ts[12], None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    if extra:
        from pyspark.sql import functions as F

        for c in ("pos", "h", "fp", "n_words", "runs", "dk", "rk", "v", "size", "score"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def write(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
