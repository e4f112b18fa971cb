import math
import random
import re

from tessera.llm import lexical_search
from tessera.llm.lexical_search import search

DOCS = "doc_id long, text string, item_id string, rank string, score string"
ITEMS = "item_id long, text string, doc_id string"


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k, multiplicity=False):
    split = [(d, terms(t)) for d, t, *_ in docs]
    n_docs, total = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    out = []
    for item, text, *_ in items:
        found, mine = [], terms(text)
        for d, w in split:
            score = 0
            for t in set(mine):
                tf, df = w.count(t), sum(t in x for _, x in split)
                if tf:
                    m = 50 + 50 * len(w) * n_docs // total
                    s = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 20 * m))
                    score += s * (mine.count(t) if multiplicity else 1)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def data():
    r = random.Random(7)
    words = ["Alpha", "beta", "été", "ÉTÉ", "x1", "the", "漢字", "don't", "a-b", "_u_", "Zeta"]
    text = lambda n: r.choice([" ", "\n", ", "]).join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.randrange(25)), "c", None, None) for i in range(120)] + [(5, "same", "", "", "")] * 3 + [(900, None, None, None, None), (901, "", None, None, None), (902, " .,!\x00", None, None, None), (None, "alpha x1", None, None, None), (None, "alpha x1", None, None, None)]
    docs += [(903, "the " * 40_000 + "alpha", None, None, None), (904, "copy of beta", None, None, None), (3, "copy of beta", None, None, None)]
    items = [(i, text(6), "z") for i in range(9)] + [(20, None, None), (21, "", None), (22, "nowhere", None), (23, "SAME same beta the the", None), (23, "SAME same beta the the", None), (None, "alpha", None)]
    return docs, items


def check(spark, k, **more):
    docs, items = data()
    got = search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS).repartition(3), k, **more).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, k, more.get("multiplicity", False))
    return got


def test_against_all_pairs(spark):
    check(spark, 10)


def test_all_documents(spark):
    got = check(spark, 1000)
    assert [x for x in got if x.item_id is None and x.doc_id is None]


def test_small_blocks(spark, monkeypatch):
    """Several blocks of items and of documents; ties at the k-th place across blocks."""
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 7)
    check(spark, 4, item_bytes=60)
    check(spark, 3, multiplicity=True)


def test_empty(spark):
    docs, items = data()
    some, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], DOCS)
    asked = spark.createDataFrame(items, ITEMS)
    assert search(none, asked).collect() == [] and search(some, spark.createDataFrame([], ITEMS)).collect() == []
    assert search(some.where("doc_id = 902"), asked).collect() == []
