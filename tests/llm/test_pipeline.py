import random
from collections import Counter
from itertools import groupby

import corpus_pipeline
import pytest
import test_minhash_dedup
import test_passage_dedup
from tessera.llm.common import materialise
from tessera.llm.passage_dedup import LEAST_WORDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(120)
    docs, labels = [], []
    for i in range(400):
        kind = r.choice(["clean"] * 6 + ["toxic", "junk"])
        t = text(r.randrange(30, 300)).split()
        if kind == "toxic":
            for _ in range(5):
                t[r.randrange(len(t))] = r.choice(["vile", "viler"])
        if kind == "junk":
            t = [w.upper() + "!!" for w in t]
        t = " ".join(t)
        if kind == "clean" and i % 9 == 0:
            t += "\n" + passage
        docs.append((i, t, "en", r.choice(["a", "b", "c", None]), len(t)))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    docs += [(1000 + i, docs[i][1], "en", "a", None) for i in range(0, 400, 10)]
    docs += [(1100 + i, docs[i][1] + " more", "en", "b", 1) for i in range(5, 400, 20)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "a", 0), docs[0], docs[0]]
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bad = lambda d: d.where("text rlike 'vile|!!'").count()
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, folder), "stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        sizes.append(docs.count())
        if name == "quality classifier":
            assert bad(docs) == 0 and docs.count() >= 0.9 * (before.count() - bad(before))
        if name == "MinHash near-dedup":
            # the draw before may have taken a copy and not its original; of both, the original stays
            there = {r.doc_id for r in before.select("doc_id").collect()}
            copies = [r.doc_id for r in docs.where("doc_id >= 1000 and doc_id < 2000").select("doc_id").collect()]
            assert sum((c - 1000 if c % 10 == 0 else c - 1100) in there for c in copies) <= 2
            assert docs.where("doc_id = 0").count() <= 1
        if name == "suffix-array dedup":
            assert docs.count() == before.count() and docs.agg({"n_chars": "sum"}).first()[0] < before.agg({"n_chars": "sum"}).first()[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.where("start = 0").count() == docs.count() and packed.agg({"length": "max"}).first()[0] <= 2048
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


@pytest.mark.parametrize("letters", [(2, 4), (3, 3), (3, 7), (6, 12)])
def test_passages_of_just_over_fifty_words(spark, letters):
    """Of short words and long ones, set apart or joined to what stands beside them; one of 40 words stays."""
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(*letters))) for _ in range(n))
    passages = [text(51), text(55), text(51), text(40)]
    docs = [(i, f"{text(40)}{passages[i % 4].join(['(', ').'] if i % 3 == 0 else chr(10) * 2)}{text(40)}", "en", "a", None) for i in range(12)] + [(100 + i, text(130), "en", "a", None) for i in range(12)]
    got = {x.doc_id: x.text for x in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(docs, SCHEMA), "").collect()}
    for i, t, *_ in docs:
        if i < 100 and i % 4 < 3:
            assert " ".join(passages[i % 4].split()[1:-1]) not in got[i] and len(got[i]) <= len(t) - 0.9 * len(passages[i % 4])
        else:
            assert got[i] == t


def test_stages_against_brute_force(spark, tmp_path):
    """Near-duplicates, passages, mix and packing once more in plain Python, each on the rows that its stage was given."""
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held[name] = sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=str)
        docs = materialise(stage(spark, docs, folder), "stage")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    given = held["MinHash near-dedup"]
    # one row of each group: that of the smallest id
    want = Counter()
    for row, group in zip(sorted(given, key=lambda r: str(r[0])), sorted(test_minhash_dedup.expected([(d, t) for d, t, _ in given]), key=lambda g: str(g[0]))):
        assert row[0] == group[0]
        if group[3]:
            want[row[0]] = 1
    assert Counter(d for d, *_ in held["suffix-array dedup"]) == want
    cut = {doc: t or "" for doc, t, _ in test_passage_dedup.expected([(d, t) for d, t, _ in held["suffix-array dedup"]], LEAST_WORDS)}
    assert {d: t or "" for d, t, _ in held["mixing sources to target weights"]} == cut
    words = {d: len((t or "").split()) for d, t, _ in held["mixing sources to target weights"]}
    total, by = sum(words.values()), Counter()
    for d, _, s in held["mixing sources to target weights"]:
        by[s] += words[d]
    mixed = rows(docs)
    taken = Counter(d for d, _ in mixed)
    assert max(taken.values()) <= 2 and all(words[d] for d in taken)
    assert abs(sum(words[d] * k for d, k in taken.items()) - 1.5 * total) <= len(by)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    for _, own in groupby(sorted(pieces, key=lambda p: p.sequence_id), key=lambda p: p.sequence_id):
        own = sorted(own, key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))] and sum(p.length for p in own) <= 2048
    assert Counter(p.doc_id for p in pieces if p.start == 0) == taken
