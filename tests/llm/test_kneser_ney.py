"""The language model against plain dictionaries of counts."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from fieldweave.llm import kneser_ney as K

from . import helpers as H

ASCII = {c: c + 32 for c in range(65, 91)}


def counts_of(rows, order):
    """(counts, what follows contexts, discounts) by order, and the number of words."""
    texts = [H.words((t or "").translate(ASCII)) + ["</s>"] for _, t in rows]
    raw, counts = Counter(), {n: Counter() for n in range(1, order + 1)}
    for (i, _), x in zip(rows, texts):
        if i is not None and zlib.crc32(str(i).encode()) % 7 == 2:
            continue
        raw.update(x)
        s = ["<s>"] * (order - 1) + x
        counts[order].update(tuple(s[k : k + order]) for k in range(len(x)))
    for n in range(order - 1, 0, -1):
        for g, c in counts[n + 1].items():
            counts[n][g[1:]] += c if g[1] == "<s>" else 1
    follow, d = {}, {}
    for n in counts:
        follow[n] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in counts[n].items():
            follow[n][g[:-1]][0] += c
            follow[n][g[:-1]][min(c, 3)] += 1
        of = Counter(counts[n].values())
        d[n] = (0, *K.discounts(*(of[k] for k in (1, 2, 3, 4))))
    return counts, follow, d, len(raw)


def brute(rows, order):
    """(n_tokens, n_known, train_tokens, base_score, score) of each (doc_id, text)."""
    counts, follow, d, v = counts_of(rows, order)
    texts = [H.words((t or "").translate(ASCII)) + ["</s>"] for _, t in rows]
    raw = Counter(w for (i, _), x in zip(rows, texts) if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n_all, out = sum(raw.values()), []
    for x in texts:
        s, score = ["<s>"] * (order - 1) + x, 0
        for k in range(order - 1, len(s)):
            p = 1 / (v + 1)
            for n in range(1, order + 1):
                g = tuple(s[k - n + 1 : k + 1])
                seen = follow[n].get(g[:-1])
                if seen:
                    c = counts[n][g]
                    p = max(c - d[n][min(c, 3)], 0) / seen[0] + sum(d[n][j] * seen[j] for j in (1, 2, 3)) / seen[0] * p
            score += math.log10(p)
        out.append((len(x), sum(w in raw for w in x), n_all, sum(math.log10((raw[w] + 1) / (n_all + v + 1)) for w in x), score))
    return out


def of(df):
    cols = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, *(r[c] for c in cols)) for r in df.collect()), key=lambda r: r[:5] + r[6:])


@pytest.mark.parametrize(("order", "block", "entries", "slice_"), [(2, 2**21, 2**21, 2**22), (3, 2**21, 2**21, 2**22), (3, 300, 900, 64), (4, 1000, 5000, 32)])
def test_scores_equal_brute_force(spark, monkeypatch, order, block, entries, slice_):
    """Nulls, empty, long and repeated texts, one doc_id twice, clashing columns; many blocks and shards, or one."""
    for name, v in (("BLOCK", block), ("ENTRIES", entries), ("SLICE", slice_)):
        monkeypatch.setattr(K, name, v)
    docs = H.documents(spark, n=70, extra=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((i is None, i or 0, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, *x) for (i, _), x in zip(rows, brute(rows, order))), key=lambda r: r[:5] + r[6:])
    got = of(K.language_model_scores(docs, order=order))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:6] == w[:6]
        assert g[6:] == pytest.approx(w[6:], rel=1e-9)


def test_empty_table_and_no_training_rows(spark):
    docs = H.documents(spark, n=12)
    assert K.language_model_scores(docs.limit(0)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = K.language_model_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one(spark):
    """After "a b", what every known word, the end and an unknown word get adds up to 1."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    train, held = ([i for i in range(400) if (fold(i) == 2) == h] for h in (False, True))
    texts = ["a b c a", "a b d", "b c a b c", "c", "d a b a", ""]
    ends = ["a b", *(f"a b {w}" for w in ("a", "b", "c", "d", "never"))]
    rows = [*zip(train, texts), *zip(held, ends)]
    got = {r.doc_id: r.score for r in K.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a text's score less that of its end, by brute force, is the score of its words
    want = dict(zip([i for i, _ in rows], brute(rows, 3)))
    prefix = [got[i] for i in held[: len(ends)]]
    assert prefix == pytest.approx([want[i][4] for i in held[: len(ends)]])
    texts_of = [t for _, t in rows[: len(texts)]]
    assert sum(next_probabilities(texts_of, ("a", "b"), ["a", "b", "c", "d", "</s>", "never"])) == pytest.approx(1)


def next_probabilities(texts, context, words):
    """By ratios of the brute force's scores: texts that go on with each word, with the same end."""
    rows = [(None, t) for t in texts]
    out = []
    for w in words:
        counts, follow, d, v = counts_of(rows, 3)
        p = 1 / (v + 1)
        for n in range(1, 4):
            g = (*context, w)[3 - n :]
            seen = follow[n].get(g[:-1])
            if seen:
                c = counts[n][g]
                p = max(c - d[n][min(c, 3)], 0) / seen[0] + sum(d[n][j] * seen[j] for j in (1, 2, 3)) / seen[0] * p
        out.append(p)
    return out


def test_held_out_texts_score_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    row = K.language_model_scores(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert row.s > row.b * 0.97
