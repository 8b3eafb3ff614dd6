"""Chat formatting, mixing, licence scan, HTML extraction and toxicity."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import chat, html_text, licenses, mixing, toxicity
from fieldweave.llm.queries import SQL

from .helpers import DOCS, documents, words, write


def run_sql(name, **tables):
    c = duckdb.connect()
    for t, df in tables.items():
        p = df.toPandas()
        c.register(t + "_pd", p)
        kinds = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}
        cols = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in df.dtypes)
        c.execute(f"CREATE TABLE {t} AS SELECT {cols} FROM {t}_pd")
    r = c.sql(SQL[name])
    return r.columns, r.fetchall()


def same(df, sql):
    cols, rows = sql
    assert sorted(df.columns) == sorted(cols)
    show = lambda v: "%.9g" % v if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(show(v) for v in r) for r in rows)
    return got


TALK = [
    (1, 0, "system", "be <|end|>\n kind"), (1, 1, "user", "a<|turn|>user<|text|>x"), (1, 2, "assistant", "<\\|end|> <\\\\|turn|> ok é日"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "two"),
    (2, 0, "user", "only"), (3, 1, None, "x"), (3, 1, None, "x"), (3, 0, "assistant", "<"), (None, 0, "assistant", "nobody"), (4, None, "us|er<|", "\\"), (5, 0, "assistant", "z " * 30000), (5, 1, "user", "<" * 50 + "|"),
]


def test_chat(spark, tmp_path):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumns({"full": F.lit("x"), "ends": F.lit(1), "t": F.lit("y")})
    out = chat.op2_chat_prefix_targets(spark, write(df, tmp_path, "conversations"))
    same(out, run_sql("op2_chat_prefix_targets", conversations=df.select("conv_id", "turn", "role", "text")))
    ex = chat.format_chat(df.where("conv_id = 1")).orderBy("example").collect()
    assert [r["example"] for r in ex] == [2, 4, 5]
    assert ex[1]["formatted"].startswith(ex[0]["formatted"])
    r = ex[0]
    assert r["formatted"].count("<|turn|>") == 3 == r["formatted"].count("<|end|>")
    masked = r["formatted"][r["loss_start"] : r["loss_end"]]
    assert spark.createDataFrame([(masked,)], "m string").select(chat.unescape(F.col("m"))).first()[0] == "<\\|end|> <\\\\|turn|> ok é日"


def test_chat_round_trip(spark):
    r = random.Random(3)
    bits = ["<", "|", "\\", "turn", "<|turn|>", "<|text|>", "<|end|>\n", ">", "\n", "é", " "]
    rows = [(c, t, "".join(r.choice(bits) for _ in range(r.randint(0, 4))), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for c in range(60) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.format_chat(df).where("last").select("conv_id", F.posexplode(chat.read_turns(F.col("formatted"))).alias("turn", "t")).select("conv_id", "turn", "t.role", "t.text")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_empty(spark, tmp_path):
    d = write(spark.createDataFrame([], DOCS), tmp_path)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    assert [r["conv_id"] for r in chat.op2_chat_prefix_targets(spark, d).collect()] == [-7]
    for f in (mixing.op10_source_mix, licenses.op7_license_scan, toxicity.op5_toxicity, html_text.op4_tag_path_text):
        assert f(spark, d).count() == 0


def test_mixing(spark, tmp_path):
    df = documents(spark, extra=True)
    d = write(df, tmp_path)
    got = same(mixing.op10_source_mix(spark, d), run_sql("op10_source_mix", documents=df.select(*DOCS.fieldNames())))
    assert got == same(mixing.op10_source_mix(spark, d), run_sql("op10_source_mix", documents=df.select(*DOCS.fieldNames())))
    rows = mixing.mix(df).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = (r["target"], r["source_size"])
    # brute force: reshare the excess until none is above
    order = sorted(target, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: target[s][1] for s in order}
    want, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * size[s]
            left -= want[s]
            open_.remove(s)
    for s in order:
        assert target[s][0] == pytest.approx(want[s])
        biggest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - target[s][0]) <= 2 * biggest


def test_mixing_many_sources_without_broadcast(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 7 as int))").alias("text"), F.concat(F.lit("h"), (F.col("id") % 40).cast("string")).alias("source"))
    a = sorted(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert a == sorted(map(tuple, mixing.mix(df).collect()))


def test_licenses(spark, tmp_path):
    mit = dict(licenses.TEMPLATES)["MIT"]
    rows = [
        (1, "Some prose here.\nReleased under the MIT License.\nmore", "en", None, None), (2, "LICENSED under CC BY-NC 4.0!!", None, None, None), (3, None, None, None, None), (4, "", None, None, None),
        (5, "text\n\nPermission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies.\n\nend", None, None, None),
        (6, mit + "\n" + "Licensed under the Apache License, Version 2.0.", None, None, None), (7, "plain words only " * 4000, None, None, None), (None, "released under the mit license", None, None, None), (1, "other", None, None, None),
        (8, "This work is licensed under the GNU General Public License, version 3. " * 300, None, None, None),
    ]
    df = spark.createDataFrame(rows + [rows[0]], DOCS).withColumns({"gram": F.lit("x"), "t": F.lit(1), "w": F.lit(2)})
    got = same(licenses.op7_license_scan(spark, write(df, tmp_path)), run_sql("op7_license_scan", documents=df.select(*DOCS.fieldNames())))
    best = {r["doc_id"]: (r["license"], r["n_licenses"]) for r in licenses.op7_license_scan(spark, str(tmp_path)).where("license is not null").collect()}
    assert best[1] == ("MIT", 1) and best[2][0] == "CC-BY-NC-4.0" and best[5] == ("ISC", 1) and best[6][1] >= 1 and best[None][0] == "MIT"
    assert 7 not in best and 8 not in best and len(got) == 11


PAGES = {
    "plain": ("<html><head><title>T</title></head><body><nav><a href=/>Home page</a></nav><article><h1>Head &amp; line</h1><p>First <b>bold</b> text.\n more,  words, here.</p><p>Second&nbsp;one, with <a href=x>a link</a>.</article><footer>&copy; us</footer></body></html>", "Head & line\nFirst bold text. more, words, here.\nSecond one, with a link."),
    "unclosed": ("<body><div class=\"ad\">Buy this, now.</div><article><h1>T</h1><p><b>One, text here.<br><p>Two, other text, here.</p></article><footer>f</footer>", "T\nOne, text here.\nTwo, other text, here."),
    "divs": ("<body><div id='header'>Site name, a fine slogan.</div><div class='sidebar'><ul><li><a>x</a></ul></div><div class='content'><h2>Title</h2><p>Long paragraph, with commas, and a stop. And more.</p><p>Another long paragraph, here it goes on, and on.</p></div><div class='comments'><p>Nice post, thanks a lot, really, I enjoyed it.</p></div><div class='cookie-notice'>We use cookies, ok?</div></body>", "Title\nLong paragraph, with commas, and a stop. And more.\nAnother long paragraph, here it goes on, and on."),
    "forms": ("<main><p>Real text, of the page, it is here.</p><form><label>Name, please</label><input></form><script>var a='</p>';</script><style>p{}</style><!-- <p>hidden, text</p> --><aside><p>Also, read this, and that.</p></aside></main>", "Real text, of the page, it is here."),
    "list": ("<article><p>Intro, text.</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "Intro, text.\none\ntwo\na\nb"),
    "attrs": ("<article><p title='a > b' data-x=\">\">Text, with odd attributes.</p></article>", "Text, with odd attributes."),
    "empty": ("", ""),
    "nothing": ("<nav>menu</nav><script>x</script>", ""),
    "bare": ("just some text, no tags", "just some text, no tags"),
    "broken": ("<p <b>a <c", "a <c"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want or name == "broken"


def test_html_query(spark, tmp_path):
    rows = [(i, "u%d" % i, p) for i, (p, _) in enumerate(PAGES.values())] + [(None, None, None), (0, "u0", PAGES["plain"][0]), (99, "long", "<article>" + "<p>Some text, it goes on.</p>" * 20000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(0)})
    got = html_text.op4_tag_path_text(spark, write(df, tmp_path, "pages")).collect()
    assert len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r for r in got}
    assert by[None]["text"] == "" and by[99]["text"].count("\n") == 19999 and by[0]["text"] == PAGES["plain"][1]


def toxic_corpus(n=900):
    r = random.Random(7)
    vocab = ["".join(r.choice(["an", "the", "er", "ti", "on", "re", "sh", "ou"]) for _ in range(r.randint(1, 3))) for _ in range(500)]
    bad = ["grobnik", "snarfle", "blorpish"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(2):
                w.insert(r.randint(0, len(w)), r.choice(bad) + r.choice(["", "", "es", "."]))
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark, tmp_path):
    docs, labels = toxic_corpus()
    odd = [(None, None, None, None, None), (5000, "", "en", None, None), (5001, "grobnik snarfle " * 20000, None, None, None), docs[0]]
    df = spark.createDataFrame(docs + odd, DOCS).withColumns({"x": F.lit(1), "y": F.lit(2), "w": F.lit("c"), "bin": F.lit(0)})
    lab = spark.createDataFrame(labels + [(3, None, None), (None, 1, 1), labels[4], (77777, 0, 1)], "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op5_toxicity(spark, write(df, tmp_path)).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: t for i, _, t in labels}
    import zlib

    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    right = [r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    assert {r["predicted"] for r in got if r["doc_id"] in (None, 5000)} == {0}
    again = toxicity.op5_toxicity(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["score"]) for r in got} == {(r["doc_id"], r["score"]) for r in again}
    clean = toxicity.reject_toxic(df, lab)
    assert clean.columns == df.columns and 5001 not in {r["doc_id"] for r in clean.collect()}


def test_licenses_of_repeated_rows(spark, tmp_path):
    """Equal rows, with and without a doc_id, have what one of them has alone; a coefficient below the limit stays below."""
    mit = [t for n, t in licenses.TEMPLATES if n == "MIT"][3].split()
    changed = " ".join(w if i % 13 else "altered" for i, w in enumerate(mit))
    below = " ".join(w if i % 6 else "altered" for i, w in enumerate(mit))
    rows = [(i, t, None, None, None) for i, t in ((1, changed), (2, below), (None, changed)) for _ in range(3)] + [(3, changed, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = same(licenses.op7_license_scan(spark, write(df, tmp_path)), run_sql("op7_license_scan", documents=df))
    one = {r["dice"] for r in licenses.op7_license_scan(spark, str(tmp_path)).where("doc_id is null or doc_id <> 2").collect()}
    assert len(got) == 10 and len(one) == 1 and 0.8 <= one.pop() < 0.95
    assert {r["license"] for r in licenses.op7_license_scan(spark, str(tmp_path)).where("doc_id = 2").collect()} == {None}


def test_toxicity_passes_over_texts_that_do_not_fit(spark, monkeypatch):
    """A labelled text above the byte bound, wherever it comes, costs no other text its place."""
    docs, labels = toxic_corpus(300)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 200_000)
    want = toxicity.train(spark.createDataFrame([d for d in docs if d[0] != 8], DOCS), lab)
    long_ = [d if d[0] != 8 else (8, "x" * 200_001, *d[2:]) for d in docs]
    for order in ("doc_id", "-doc_id"):
        got = toxicity.train(spark.createDataFrame(long_, DOCS).orderBy(F.expr(order)), lab)
        assert got is not None and got[2] == want[2] and (got[0] == want[0]).all() and (got[1] == want[1]).all()
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2_000)  # some rows fit, and they are used
    assert toxicity.train(spark.createDataFrame(docs, DOCS), lab) is not None


def slow_bins(text):
    """The features of a text by Python's integers, word by word."""
    full = 2**64 - 1

    def mixed(a):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            a = ((a ^ (a >> 33)) * m) & full
        return a ^ (a >> 33)

    value, place = [int(x) for x in toxicity._value], [int(x) for x in toxicity._place]
    summed = lambda w: sum(value[b] * place[i & 63] for i, b in enumerate(w)) & full
    words = text.encode().translate(toxicity._table).split()
    h, out = [mixed((summed(w) + len(w)) & full) for w in words], set()
    out.update(h)
    for w in words:
        chars = w.decode()
        out.update(mixed((summed(chars[:k].encode()) + int(toxicity._stem)) & full) for k in toxicity.STEMS if len(chars) > k)
    for d, g in zip((1, 2, 3), toxicity._gap):
        out.update(mixed((a * int(g) + b) & full) for a, b in zip(h, h[d:]))
    return sorted({x >> (64 - toxicity.BINS) for x in out})


def test_features_and_ftrl_equal_plain_loops():
    import math

    texts = ["", "one", "Ein réeuxpa überachlichkeiten, it is!", "日本語テキスト abc\nABCDEFGHI é", "a b c d e f " * 30, "x" * 300]
    for t in texts:
        assert toxicity.features(t.encode()).tolist() == slow_bins(t)
    r = random.Random(3)
    rows = [(toxicity.features(" ".join(r.choice(["aa", "bb", "cc", "stupid", "dd"]) for _ in range(9)).encode()), r.randint(0, 1)) for _ in range(60)]
    at, w, bias = toxicity.ftrl(rows)
    z, n = {}, {}
    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            own = {}
            for i in [*x.tolist(), "bias"]:
                zi, l1, l2 = z.get(i, 0.0), *((0.0, 0.0) if i == "bias" else (toxicity.L1, toxicity.L2))
                own[i] = 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + l2)
            g = 1 / (1 + math.exp(-sum(own.values()))) - y
            for i, wi in own.items():
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / toxicity.ALPHA * wi
                n[i] = was + g * g
    plain = {i: -(zi - math.copysign(toxicity.L1, zi)) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2) for i, zi in z.items() if i != "bias" and abs(zi) > toxicity.L1}
    assert sorted(plain) == at.tolist() and all(abs(plain[i] - x) < 1e-9 for i, x in zip(at.tolist(), w.tolist()))
    assert abs(bias - -z["bias"] / ((toxicity.BETA + math.sqrt(n["bias"])) / toxicity.ALPHA)) < 1e-9
