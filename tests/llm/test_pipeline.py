"""The pipeline's stages against brute force, each on its own input."""

from collections import defaultdict

import corpus_pipeline
from fieldweave.llm import toxicity

from .helpers import DOCS, words
from .test_more_operators import toxic_corpus
from .test_text_operators import brute_components, brute_fp, brute_hits, brute_repeats, brute_shingles


def test_pipeline(spark, tmp_path):
    docs, labels = toxic_corpus(300)
    passage = " ".join(f"shared{i}" for i in range(60))
    bench = [(1, " ".join(f"bench{i}" for i in range(14))), (2, None)]
    n = 1000
    clean = [t for (_, t, *_), (_, _, toxic) in zip(docs, labels) if not toxic and len(t.split()) > 40]
    for i in range(12):
        own = clean[i]  # too much for a near copy
        docs.append((n + i, f"intro {own} " + passage + f" outro {i}\nend", "en", "t", 5))
    docs += [(n + 20, docs[0][1], "en", "s", 1), (n + 21, docs[1][1] + " more", "fr", None, 2), (n + 22, "start " + bench[0][1] + " stop", "en", "u", 3), (n + 23, None, None, None, None), (n + 24, "", "en", "u", 0)]
    docs += [(None, docs[2][1], "en", "s", 1), docs[3]]
    df = spark.createDataFrame(docs, DOCS)
    d = str(tmp_path)
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    def step(k, given):
        out = corpus_pipeline.STAGES[k][1](spark, given, d)
        out.write.parquet(f"{d}/stage{k}")
        return spark.read.parquet(f"{d}/stage{k}")

    a = step(0, df)
    scores = {r["text"]: r["score"] for r in toxicity.scores(df, toxicity.train(df, spark.read.parquet(f"{d}/labels.parquet"))).collect()}
    assert sorted(map(str, a.collect())) == sorted(str(r) for r in df.collect() if scores[r["text"]] < 0.3)
    b = step(1, a)
    rows = a.collect()
    comp = brute_components([brute_fp(r["text"]) for r in rows], [brute_shingles(r["text"]) for r in rows])
    groups = defaultdict(list)
    for c, r in zip(comp, rows):
        groups[c].append(r)
    assert sorted(map(str, b.collect())) == sorted(str(min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))) for g in groups.values())
    c = step(2, b)
    rows = b.collect()
    want = sorted((str(r["doc_id"]), [x for x, y in zip(w, g) if not y], r["lang"], r["source"]) for r, (w, g) in zip(rows, brute_repeats(rows)))
    assert sorted((str(r["doc_id"]), words(r["text"]), r["lang"], r["source"]) for r in c.collect()) == want
    assert len(want) < len(docs) and any(g and any(g) for _, g in brute_repeats(rows))
    e = step(3, c)
    assert sorted(map(str, e.collect())) == sorted(str(r) for r in c.collect() if not brute_hits(r["text"], bench)[4])
    f = step(4, e)
    assert sorted(r["doc_id"] for r in f.collect()) == sorted(r["doc_id"] for r in e.collect())
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(str, whole.collect())) == sorted(map(str, f.collect()))
    for x in (a, b, c, e):
        assert x.columns == df.columns


def test_pipeline_on_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
