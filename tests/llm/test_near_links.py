"""Near copies that share a key with a set that is like neither of them."""

import pandas as pd
from pyspark.sql import functions as F

from fieldweave.llm import simhash


def test_pairs_that_the_hub_does_not_link_are_compared(spark):
    rows = []
    for k in range(5):
        words = [f"w{k}x{i}" for i in range(60)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-3], "one", "more", "word"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = simhash._near_rows(docs, "doc_id", "text").withColumn("bands", F.array(F.lit(1).cast("long"))).localCheckpoint()
    fp = {r["dk"]: r["fp"] for r in near.collect()}
    want = {tuple(sorted((fp[a], fp[b]))) for a in range(10) for b in range(a) if a // 2 == b // 2 and fp[a] != fp[b]}
    got = {(r["a"], r["b"]) for r in simhash.near_links(near, docs, "doc_id", "text").collect()}
    assert len(want) > 1 and got == want


def _copies(n, changed):
    """Texts of one template, each with its own words at a few places."""
    words = [f"w{i}" for i in range(60)]
    return [" ".join(words[:at] + [f"c{k}x{i}" for i in range(changed)] + words[at + changed :]) for k in range(n) for at in [(7 * k) % 50]]


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """The links of blocks connect what the links of all pairs connect."""
    texts = [t for changed in (1, 5, 9) for t in _copies(12, changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = simhash._near_rows(docs, "doc_id", "text").withColumn("bands", F.array(F.lit(1).cast("long"))).localCheckpoint()
    fp = {r["dk"]: r["fp"] for r in near.collect()}
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]

    def parts(links):
        over = {f: f for f in fp.values()}
        top = lambda x: x if over[x] == x else top(over[x])
        for a, b in links:
            over[max(top(a), top(b))] = min(top(a), top(b))
        return {f: top(f) for f in over}

    want = parts((fp[i], fp[j]) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(set(want.values())) > 2
    for few, block in ((2, 10), (2, 1000), (32, 10)):
        monkeypatch.setattr(simhash, "PAIRWISE", few)
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = [(r["a"], r["b"]) for r in simhash.near_links(near, docs, "doc_id", "text").collect()]
        assert parts(got) == want


def test_rows_of_a_group_do_not_grow_with_its_square():
    """A block's unconnected sets give one row each and a forest of links."""
    texts = _copies(300, 1)
    mine = pd.DataFrame({"found": [simhash.shingle_set(t.encode()) for t in texts], "part": range(300), "own": 0, "i": 0, "j": 0})
    got = simhash.block_links(mine)
    assert 0 < len(got) < 300
    assert simhash.block_links(mine.assign(part=1)) == []
