import random
import re
from collections import Counter

import pytest

from tessera.llm.passage_dedup import CODE, remove_passages, word_spans

SCHEMA = "doc_id long, text string, spans string, kept_text string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def expected(rows, least):
    """doc, text without all words that some repeated string of `least` words covers, number of those words."""
    found = [[m.span() for m in WORD.finditer(t or "")] for _, t, *_ in rows]
    words = [[t[a:b] for a, b in at] for (_, t, *_), at in zip(rows, found)]
    count = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for (doc, text, *_), at, w in zip(rows, found, words):
        hit = [False] * len(w)
        for i in range(len(w) - least + 1):
            if count[tuple(w[i : i + least])] > 1:
                hit[i : i + least] = [True] * least
        kept, end = "", 0
        for i, h in enumerate(hit):
            if h:
                kept += text[end : at[i][0]] if not (i and hit[i - 1]) else ""
                end = at[i][1]
        out.append((doc, text if text is None else kept + text[end:], sum(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_strings(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé—1") for _ in range(r.randrange(1, 3)))
    text = lambda n: r.choice([" ", "\n", "  ", "\x0b"]).join(word() for _ in range(n))
    passage = [word() for _ in range(30)]
    rows = [(i, text(r.randrange(1, 40)), "x", None) for i in range(20)]
    rows += [(100 + i, f"{text(r.randrange(9))} {' '.join(passage[r.randrange(24) :])}\t{text(r.randrange(9))}", None, None) for i in range(15)]
    rows += [(200, None, None, None), (201, "", None, None), (202, "ab " * 200, None, None), (203, " ".join(passage), None, None), (203, " ".join(passage), None, None), (None, text(30), None, None), (203, "\x85x  y", None, None)]
    got = remove_passages(spark.createDataFrame(rows, SCHEMA).repartition(3), least=8, keep=("spans",)).collect()
    assert sorted(((x.doc_id, x.kept_text, x.words_removed) for x in got), key=str) == expected(rows, 8)
    assert Counter(x.spans for x in got) == Counter(x[2] for x in rows)


def test_edges_make_no_passage_longer():
    assert word_spans([(2, 2 + CODE * 8)], 8) == [] and word_spans([(0, CODE * 8 + 3)], 8) == [(0, 8)] and word_spans([(3, CODE * 9 + 1), (CODE * 6, CODE * 11)], 8) == [(1, 11)]


def test_empty(spark):
    assert remove_passages(spark.createDataFrame([], SCHEMA)).collect() == []
