import hashlib
import random
from collections import Counter

import pytest

from tessera.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string, spans string"


def covered(rows, m):
    count = Counter()
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, raw in raws:
        for i in range(len(raw) - m + 1):
            count[raw[i : i + m]] += 1
    out = []
    for doc, raw in raws:
        hit = bytearray(len(raw))
        for i in range(len(raw) - m + 1):
            if count[raw[i : i + m]] > 1:
                hit[i : i + m] = b"\1" * m
        out.append((doc, raw, hit, sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1]))))
    return out


def expected(rows, m, passage=None):
    out = []
    short = covered(rows, passage) if passage else [None] * len(rows)
    for (doc, raw, hit, spans), other in zip(covered(rows, m), short):
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        out.append((doc, len(raw), sum(hit), spans, hashlib.sha256(kept).hexdigest(), *((sum(other[2]), other[3]) if other else ())))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(40)
    rows = [(i, text(r.randrange(1, 60)), "x") for i in range(20)]
    rows += [(100 + i, text(r.randrange(20)) + passage[r.randrange(30) :] + text(r.randrange(20)), None) for i in range(15)]
    rows += [(200, None, None), (201, "", None), (202, "ab" * 200, None), (203, passage, None), (203, passage, None), (None, text(30), None), (203, text(30), None)]
    return rows


@pytest.mark.parametrize("hot", [4096, 3, 1])
def test_against_brute_force(spark, hot):
    rows = corpus(hot)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), min_len=50, levels=(16, 40, 50), hot=hot).collect()
    assert sorted((tuple(x) for x in got), key=str) == expected(rows, 50)


@pytest.mark.parametrize("hot", [4096, 3, 1])
def test_both_lengths_against_brute_force(spark, hot):
    rows = corpus(hot + 10)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), min_len=50, levels=(16, 40, 50), hot=hot, passage=30, passage_levels=(8, 24, 30)).collect()
    assert sorted((tuple(x) for x in got), key=str) == expected(rows, 50, 30)


def test_very_long_text(spark):
    r = random.Random(1)
    passage = " ".join("%x" % r.getrandbits(40) for _ in range(60))
    long = " ".join("%x" % r.getrandbits(40) for _ in range(200_000))
    rows = [(1, long[:1_000_000] + passage + long[1_000_000:], None), (2, "short " + passage, None)]
    got = {x.doc_id: x for x in remove_repeats(spark.createDataFrame(rows, SCHEMA), passage=240).collect()}
    assert [(got[i].n_removed, got[i].passage_bytes, got[i].n_spans) for i in (1, 2)] == [(len(passage), len(passage), 1)] * 2


def test_empty_table_and_text(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "é" * 300, None), (2, "x" + "é" * 300, None)]
    got = {x.doc_id: x for x in remove_repeats(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()}
    assert got[1].kept_text == "" and got[2].kept_text == "x"
