"""Quality, substring dedup, SimHash and decontamination against brute force."""

import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldweave.llm import common as C
from fieldweave.llm import decontaminate, quality, simhash, substring_dedup

from .helpers import DOCS, documents, words, write


def brute_repeats(rows, width=20):
    """Per row its words and the mask of words to remove."""
    first = {}
    ws = [words(r["text"]) for r in rows]
    key = [(-(2**63) if r["doc_id"] is None else r["doc_id"]) for r in rows]
    seen = defaultdict(set)
    for k, w, r in zip(key, ws, rows):
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])].add((k, r["text"], i))
    out = []
    for k, w, r in zip(key, ws, rows):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if any(d < k or (d == k and t == r["text"] and p < i) for d, t, p in seen[tuple(w[i : i + width])]):
                gone[i : i + width] = [True] * width
        out.append((w, gone))
    return out


@pytest.mark.parametrize("block", [150, 1_000_000])
def test_substring_dedup(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    df = documents(spark, extra=True)
    got = substring_dedup.op3_substring_dedup(spark, write(df, tmp_path)).collect()
    rows = df.collect()
    want = sorted(
        (str(r["doc_id"]), len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest()) for r, (w, g) in zip(rows, brute_repeats(rows))
    )
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert sum(w[2] for w in want) > 500


def test_substring_dedup_keeps_columns_and_clean_text(spark):
    df = documents(spark, extra=True)
    out = substring_dedup.dedup_substrings(df)
    assert out.columns == df.columns and out.count() == df.count()
    kept = {(r["doc_id"], tuple(words(r["text"]))) for r in out.collect()}
    rows = df.collect()
    assert kept == {(r["doc_id"], tuple(x for x, y in zip(w, g) if not y)) for r, (w, g) in zip(rows, brute_repeats(rows))}
    same = {r["text"] for r in out.collect()}
    assert all(r["text"] in same for r, (w, g) in zip(rows, brute_repeats(rows)) if not any(g))


def test_substring_dedup_of_short_and_long_texts_under_one_id(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(90))
    short = ["", None, "one", " ".join(f"s{i}" for i in range(18)), " ".join(f"s{i}" for i in range(19)), " ".join(f"t{i}" for i in range(20))]
    rows = [(k, t, None, None, None) for k in (None, 4) for t in [passage, "before " * 40 + passage, *short]] + [(9, passage, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = substring_dedup.op3_substring_dedup(spark, write(df, tmp_path)).collect()
    rows = df.collect()
    assert sorted((str(r[0]), *r[1:3]) for r in got) == sorted((str(r["doc_id"]), len(w), sum(g)) for r, (w, g) in zip(rows, brute_repeats(rows)))
    assert substring_dedup.dedup_substrings(df).count() == len(rows)


def alike_in_24_bits(passage):
    """A text with the passage and one without, of equal size, whose hashes end in the same 24 bits."""
    tail = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) % 2**24
    other = " ".join(f"q{i}" for i in range(len(passage.split())))
    seen = {tail(t): t for t in (f"a{i} {passage}" for i in range(20000))}
    return next((seen[tail(t)], t) for t in (f"b{i} {other}" for i in range(20000)) if tail(t) in seen)


@pytest.mark.parametrize("shared", [None, 5])
def test_substring_dedup_tells_rows_of_one_id_apart(spark, tmp_path, shared):
    passage = " ".join(f"p{i}" for i in range(60))
    if shared is None:  # rows without an id come first, so only what a text repeats itself goes
        passage += " " + passage
    repeated, clean = alike_in_24_bits(passage)
    rows = [(k, t, None, None, None) for k, t in [(1, passage), (shared, repeated), (shared, clean), (7, clean[:9])]]
    df = spark.createDataFrame(rows, DOCS)
    got = substring_dedup.op3_substring_dedup(spark, write(df, tmp_path)).collect()
    want = brute_repeats(df.collect())
    assert sorted((str(r[0]), *r[1:3]) for r in got) == sorted((str(r[0]), len(w), sum(g)) for r, (w, g) in zip(rows, want))
    assert clean in {r["text"] for r in substring_dedup.dedup_substrings(df).collect()}


def brute_fp(text):
    t = (text or "").translate(str.maketrans(C.UPPER, C.LOWER))
    w = words(t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_shingles(text):
    w = words((text or "").translate(str.maketrans(C.UPPER, C.LOWER)))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(fps, sets=None):
    """Linked by 3 bits or less, with sets also by a Jaccard similarity of 0.8 or more."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            near = sets and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if near or bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_query(spark, tmp_path):
    df = documents(spark, extra=True)
    rows = df.collect()
    fps = [brute_fp(r["text"]) for r in rows]
    comp = brute_components(fps)
    least = defaultdict(list)
    for c, r in zip(comp, rows):
        if r["doc_id"] is not None:
            least[c].append(r["doc_id"])
    want = sorted((str(r["doc_id"]), "%016x" % f, min(least[c])) for r, f, c in zip(rows, fps, comp))
    got = sorted((str(r[0]), r[1], r[2]) for r in simhash.op8_simhash(spark, write(df, tmp_path)).collect())
    assert got == want


def test_simhash_links_at_every_distance(spark):
    import random

    r = random.Random(4)
    fps = {0}
    for _ in range(60):
        f = r.getrandbits(64)
        fps.add(f)
        for _ in range(r.randint(0, 5)):  # chains of hops of 1 to 4 bits
            for b in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    comp = brute_components(fps)
    s = lambda x: x - 2**64 if x >= 2**63 else x
    got = simhash.components(simhash.links(spark.createDataFrame([(s(f),) for f in fps], "fp long"))).collect()
    root = {r["node"]: r["root"] for r in got}
    groups = defaultdict(set)
    for f, c in zip(fps, comp):
        groups[c].add(s(f))
    assert any(len(g) > 3 for g in groups.values())
    for g in groups.values():
        assert {root.get(f, f) for f in g} == {min(g)}


def test_quality(spark, tmp_path):
    import re

    df = documents(spark, extra=True)
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.op1_compression_bands(spark, write(df, tmp_path)).collect()}
    want = set()
    for r in df.collect():
        t = r["text"] or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        win = defaultdict(list)
        for i in range(len(w) - 7):
            win[tuple(w[i : i + 8])].append(i)
        rep = {k for at in win.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
        want.add((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    assert got == want


def test_quality_bands(spark):
    import base64
    import random

    r = random.Random(2)
    prose = " ".join("".join(r.choice(["an", "the", "er", "ti", "on", "re", "sh", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(3000))
    junk = " ".join(base64.b64encode(r.randbytes(30)).decode() for _ in range(300))
    same = " ".join(f"item {i % 7} again and again in this list" for i in range(40)) + " tail"
    rows = [(1, prose), (2, junk), (3, "word " * 3000), (4, prose[:300]), (5, prose[:9000] + junk + prose[9000:10000]), (6, same)]
    got = {x["doc_id"]: x["kept"] for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}


BENCH = [(1, "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu"), (2, "two words"), (3, None), (4, "!!"), (10, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "two words"), (None, "null item words")]


def brute_hits(text, items):
    import re

    ws = lambda t: re.findall(decontaminate.WORD, (t or "").translate(str.maketrans(C.UPPER, C.LOWER)))
    w, hit, its = ws(text), set(), set()
    for i, t in items:
        p = ws(t)
        m = min(10, len(p))
        for a in range(len(p) - m + 1 if m else 0):
            for k in range(len(w) - m + 1):
                if w[k : k + m] == p[a : a + m]:
                    hit |= set(range(k, k + m))
                    its |= {str(i)} if i is not None else set()
    return len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [6, 300_000])
def test_decontamination(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_PATTERNS", limit)
    body = "x w1 ALPHA beta-gamma delta epsilon zeta eta theta iota kappa! lambda mu nu two  words"
    rows = [(1, body, "en", "a", 0), (2, "beta gamma delta epsilon zeta eta theta iota kappa", None, None, None), (3, None, None, None, None), (4, "", None, None, None), (None, "two words, two words null item words", None, None, None)]
    rows += [rows[0], (5, " ".join(f"W{i}" for i in range(30)), None, None, None), (6, "two two words" * 2000, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontaminate.op6_decontamination(spark, write(df, tmp_path)).collect()
    want = sorted((str(r[0]), *brute_hits(r[1], BENCH)) for r in rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    df = df.withColumns({"dk": F.lit("mine"), "rk": F.lit(1.5)})
    clean = decontaminate.clean_documents(df, spark.createDataFrame(BENCH, "item_id long, text string"))
    assert sorted((r["doc_id"], r["dk"], r["rk"]) for r in clean.collect()) == [(2, "mine", 1.5), (3, "mine", 1.5), (4, "mine", 1.5)]


def test_long_items_are_cut_into_pieces_with_the_same_windows():
    words_ = [f"w{i}" for i in range(57)]
    item = pa.RecordBatch.from_pydict({"item": ["a", None, "c"], "text": [" ".join(words_), "short one", ""]})
    for piece in (1, 7, 48, 100):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(decontaminate, "PIECE", piece)
            (got,) = decontaminate._pieces([item])
        windows = [tuple(t.split()[i : i + 10]) for a, t in zip(got["item"].to_pylist(), got["text"].to_pylist()) if a == "a" for i in range(len(t.split()) - 9)]
        assert windows == [tuple(words_[i : i + 10]) for i in range(48)]
        assert [t for a, t in zip(got["item"].to_pylist(), got["text"].to_pylist()) if a != "a"] == ["short one", ""]


def test_empty_tables(spark, tmp_path):
    d = write(spark.createDataFrame([], DOCS), tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for f in (quality.op1_compression_bands, substring_dedup.op3_substring_dedup, simhash.op8_simhash, decontaminate.op6_decontamination):
        assert f(spark, d).count() == 0


def test_one_of_each_drops_near_copies_by_shingle_similarity(spark):
    import random

    r = random.Random(3)
    rows, width = [], 5
    for i in range(40):  # each with copies of which one to nine words in 250 differ
        w = [f"w{r.randrange(3000)}" for _ in range(250)]
        for j in range(4):
            c = list(w)
            for k in range([0, 2, 4, 9][j]):
                c[10 + k * 25] = f"x{i}.{j}.{k}"
            rows.append((i * 10 + j, " ".join(c), None, None, None))
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (words(x[1]) for x in rows)]
    fps = [simhash.fingerprint(x[1].encode()) for x in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            near = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if near or (fps[i] ^ fps[j]).bit_count() <= 3:
                root = [root[j] if x == root[i] else x for x in root]
    least = defaultdict(list)
    for k, x in zip(root, rows):
        least[k].append(x[0])
    got = simhash.one_of_each(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(x["doc_id"] for x in got) == sorted(min(g) for g in least.values())
    assert 40 < len(got) < 100


def test_one_of_each_is_the_same_row_whatever_the_order_and_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, lang, f"s{i}", i) for i, lang in enumerate(["b", "a", "c", None, "a"])] + [(2, "other", "x", None, 0)] * 2
    df = spark.createDataFrame(rows, DOCS).withColumns({"dk": F.lit("mine"), "rk": F.lit(None).cast("int"), "wh": F.array(F.lit(1))})
    got = {str(sorted(map(str, simhash.one_of_each(df.orderBy(F.rand(k)).repartition(1 + k)).collect()))) for k in range(3)}
    assert len(got) == 1 and got.pop().count("dk='mine'") == 2


def test_compression_verdict_by_brute_force(spark):
    import random

    import zstandard

    r = random.Random(2)
    sizes = [0, 1, 100, 127, 128, 255, 256, 511, 512, 1023, 1024, 4095, 4096, 9000, 16383, 16384, 40000]
    made = []
    for n in sizes:
        made += ["ab " * (n // 3), "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ     ") for _ in range(n))]
        w = []
        while sum(map(len, w)) < n:
            w.append(r.choice(["the ", "of ", "and ", "a ", "%s " % r.randrange(900), "word%s " % r.randrange(3000)]))
        made.append("".join(w)[:n])
    rows = [(i, t, None, None, None) for i, t in enumerate(made)]
    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    kept = 0
    for x in quality.quality(spark.createDataFrame(rows, DOCS)).collect():
        b = made[x["doc_id"]].encode()
        low, high = [(lo, hi) for least, lo, hi in quality.BANDS if len(b) >= least][-1]
        ratio = len(press.compress(b)) / len(b) if b else 0.0
        parts = [b[i : i + quality.CHUNK] for i in range(0, len(b) - quality.CHUNK + 1, quality.CHUNK)]
        bad = sum(not quality.CHUNK_BAND[0] <= len(press.compress(p)) / len(p) <= quality.CHUNK_BAND[1] for p in parts)
        assert x["ratio"] == ratio and x["n_chunks"] == len(parts) and x["n_bad_chunks"] == bad
        assert x["kept"] == (not x["base_failed"] and low <= ratio <= high and 4 * bad <= len(parts))
        kept += x["kept"]
    assert 5 < kept < len(made) - 5
