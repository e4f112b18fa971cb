import itertools
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from tessera.llm.filter_audit import RemovalPolynomial, audit, text_failures

DOCS = "doc_id long, text string, lang string, source string, part string, mask string, good string, n string"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(doc, docs):
    d, text = doc[0], doc[1] or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    same = any(o[0] is not None and d is not None and o[0] < d and (o[1] or "") == text for o in docs)
    return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": same}


def brute(docs, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    out = []
    for part in {x[2] or "" for x in docs}:
        mine = [(x[0], fails(x, docs)) for x in docs if (x[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                out_now = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                removed_by[f] += len(out_now)
                rows.append((part, "".join(order), step, len(left), len(out_now), sum(x[1][f] for x in mine) - len(out_now), sum(x[1][f] and sum(x[1].values()) == 1 for x in mine), sum(x[0] in good for x in out_now), sum(x[0] in toxic for x in out_now)))
        out += [(*x, removed_by[x[1][x[2] - 1]]) for x in rows]
    return sorted(out)


def data():
    r = random.Random(9)
    docs = []
    for i in range(150):
        n = r.choice([0, 1, 30, 99, 100, 101, 130])
        words = [r.choice(["alpha", "Beta", "ÉTÉ", "C#", "d\x0be"]) + str(r.randrange(r.choice([3, 400]))) for _ in range(n)]
        docs.append((r.choice([i, i, i % 7, None]), r.choice([" ", "\t", " "]).join(words), r.choice(["en", "fr", "", None]), "s", None, None, None, None))
    docs += [docs[3]] * 4 + [(3, "copy", "en", *[None] * 5), (2, "copy", "fr", *[None] * 5), (2, "copy", "en", *[None] * 5), (None, "copy", "de", *[None] * 5), (4, None, "en", *[None] * 5), (5, "", "en", *[None] * 5), (600, "x " * 60_000, "en", *[None] * 5)]
    labels = [(i, i % 2, int(i % 5 == 0), "z") for i in range(0, 150, 2)] + [(2, 1, None, None), (3, None, 1, None), (3, 0, 0, None), (None, 1, 1, None)]
    return docs, labels


def test_against_all_orders(spark):
    docs, labels = data()
    got = audit(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS), text_failures()).collect()
    assert sorted(map(tuple, got)) == brute(docs, labels)


def test_two_filters(spark):
    docs, labels = data()
    got = audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), {"S": F.length("text") < 50, "N": F.col("text").isNull() | (F.col("source") == "none")}, repeated=None).collect()
    assert {x.filter_order for x in got} == {"SN", "NS"} and all(x.kept + x.removed > 0 for x in got if x.step == 1)


def test_polynomial():
    r = random.Random(2)
    counts = {m: r.randrange(1000) for m in range(32)}
    p = RemovalPolynomial(counts, 5)
    for s in range(32):
        assert p.corner(s) == sum(c for m, c in counts.items() if m & s)
    for i in range(5):
        assert p.shapley(i) == sum((Fraction(c, m.bit_count()) for m, c in counts.items() if m >> i & 1), Fraction(0))


def test_empty(spark):
    docs, labels = data()
    none = spark.createDataFrame([], DOCS)
    assert audit(none, spark.createDataFrame(labels, LABELS), text_failures()).collect() == []
    assert audit(spark.createDataFrame(docs[:5], DOCS), spark.createDataFrame([], LABELS), text_failures()).where("good_lost + toxic_lost > 0").count() == 0
