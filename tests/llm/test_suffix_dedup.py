"""Byte-level dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
import zstandard

from fieldweave.llm import suffix_dedup

from .helpers import DOCS, documents, write
from .test_text_operators import alike_in_24_bits


def brute(rows):
    key = [(-(2**63) if r["doc_id"] is None else r["doc_id"]) for r in rows]
    bs = [(r["text"] or "").encode() for r in rows]
    least = {}
    for k, b in zip(key, bs):
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            least[s] = min(k, least.get(s, k))
    out = []
    for k, b, r in zip(key, bs, rows):
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < k:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(r["doc_id"]), len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk,parts", [(700, 5), (4_000_000, 96)])
def test_suffix_dedup(spark, tmp_path, monkeypatch, chunk, parts):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "MIN_PARTS", parts)
    r = random.Random(5)
    base = ["".join(r.choice("abcdé ") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(80):  # repeats of every length about the limit, at ends and in the middle, and near copies
        t = "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 90)))
        for _ in range(r.randint(0, 3)):
            b = r.choice(base)
            a = r.randint(0, 300)
            t += b[a : a + r.choice([30, 40, 46, 47, 48, 49, 50, 51, 52, 70, 100])] + "".join(r.choice("xyz") for _ in range(r.choice([0, 1, 30])))
        rows.append((1000 + i * 7 % 80, t, None, None, None))
    for i in range(10):
        c = list(base[0])
        for _ in range(i):
            c[r.randrange(400)] = "#"
        rows.append((2000 + i, "".join(c), None, None, None))
    rows += [(3000, "ab" * 300, None, None, None), (3001, "ab" * 100, None, None, None), (3002, "a" * 60, None, None, None), (None, base[1], None, None, None), (2003, base[2], None, None, None)]
    rows += [rows[0], rows[81]]
    df = spark.createDataFrame(rows, DOCS).unionByName(documents(spark, n=20)).repartition(4)
    out = suffix_dedup.op9_suffix_dedup(spark, write(df, tmp_path))
    got = sorted((str(x[0]), *x[1:]) for x in out.collect())
    assert got == brute(df.collect())
    assert sum(x[2] for x in got) > 5000


def test_rows_of_one_id_are_told_apart(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    repeated, clean = alike_in_24_bits(passage)
    rows = [(k, t, None, None, None) for k, t in [(1, passage), (5, repeated), (5, clean), (None, clean[:40]), (None, clean[60:100])]]
    df = spark.createDataFrame(rows, DOCS)
    got = suffix_dedup.op9_suffix_dedup(spark, write(df, tmp_path)).collect()
    assert sorted((str(x[0]), *x[1:]) for x in got) == brute(df.collect())


def test_suffixes_do_not_depend_on_slabs(monkeypatch):
    r = random.Random(8)
    texts = [bytes(r.choice(b"ab c") for _ in range(n)) for n in (0, 49, 50, 51, 400, 3, 2000, 77)] + [b"z" * 300, b""]
    row = {"chunk": 0, "ids": list(range(len(texts))), "sizes": [len(t) for t in texts], "frame": zstandard.compress(b"".join(texts))}
    x = suffix_dedup.Texts(row)
    whole = [a.tolist() for a in x.samples()]
    chosen = {lo + j: p for p, lo, n in zip(*whole) for j in range(n)}
    windows = [a + j for a, n in zip(x.start.tolist(), x.size.tolist()) for j in range(n - 49)]
    assert sorted(chosen) == windows and all(s <= p <= s + 34 for s, p in chosen.items())
    for slab in (61, 100, 977):
        monkeypatch.setattr(suffix_dedup, "SLAB", slab)
        assert [a.tolist() for a in x.samples()] == whole


def test_empty_table(spark, tmp_path):
    assert suffix_dedup.op9_suffix_dedup(spark, write(spark.createDataFrame([], DOCS), tmp_path)).count() == 0
