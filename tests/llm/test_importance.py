import math
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import importance
from tessera.llm.importance import kth_largest, resample

SCHEMA = "doc_id long, text string, kept string, quality string"


def rows():
    r = random.Random(1)
    words = ["w%02d" % i for i in range(300)]
    out, labels = [], []
    for i in range(1500):
        kind = r.choice(["clean"] * 7 + ["toxic", "junk"])
        text = [r.choice(words) for _ in range(r.randrange(20, 120))]
        if kind == "toxic":
            for _ in range(4):
                text[r.randrange(len(text))] = r.choice(["vile", "viler", "awfulness"])
        if kind == "junk":
            text = [w.upper() + "!!" for w in text]
        out.append((i, " ".join(text), None, "x"))
        if i % 3 == 0:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    labels += [(None, 1, 0), (7, None, 0), (9, 1, None)]
    return out, labels


def test_held_out_accuracy(spark):
    data, labels = rows()
    kinds = {i: "toxic" if "vile" in t or "awful" in t else "junk" if "!!" in t else "clean" for i, t, *_ in data}
    odd = [(5000, None, None, None), (5001, "", None, None), (5001, "", None, None), (None, data[0][1], None, None)]
    df = spark.createDataFrame(data + odd, SCHEMA).repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = resample(df, lab).collect()
    assert len(got) == len(data) + len(odd)
    assert sorted(map(str, got)) == sorted(map(str, resample(df.repartition(2), lab).collect()))
    wrong = {"clean": 0, "toxic": 0, "junk": 0}
    for x in got:
        if x.doc_id is not None and x.doc_id < 5000 and x.doc_id % 3 and x.kept != (kinds[x.doc_id] == "clean"):
            wrong[kinds[x.doc_id]] += 1
    assert wrong["toxic"] == wrong["junk"] == 0 and wrong["clean"] <= 30
    drawn = [x for x in resample(df, lab, k=100).collect() if x.kept]
    assert len(drawn) == 100 and all(x.toxicity <= 0 for x in drawn)


def test_length_alone_rejects_nothing(spark):
    data, labels = rows()
    r = random.Random(4)
    common = [f"w{i:02}" for i in range(300)]
    long = lambda n, bad=0.0: " ".join(r.choice(["vile", "viler", "awfulness"]) if r.random() < bad else f"{r.getrandbits(40):x}" if r.random() < 0.05 else r.choice(common) for _ in range(n))
    texts = {6000 + i: long(n) for i, n in enumerate([2_000, 20_000, 20_000, 100_000, 100_000, 500_000])}
    texts |= {7000: long(20_000, 0.02), 7001: long(500_000, 0.02)}
    df = spark.createDataFrame(data + [(i, t, None, None) for i, t in texts.items()], SCHEMA).repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in resample(df, lab).where("doc_id >= 6000").collect()}
    assert got == {i: i < 7000 for i in texts}


def test_without_labels_and_rows(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resample(spark.createDataFrame([], SCHEMA), lab).collect() == []
    assert len(resample(spark.createDataFrame([(1, "a b", None, None), (2, None, None, None)], SCHEMA), lab).collect()) == 2


def test_kth_largest(spark):
    r = random.Random(2)
    keys = [r.choice([r.random(), 0.5, r.randrange(3)]) for _ in range(5000)]
    df = spark.createDataFrame([(i, float(k)) for i, k in enumerate(keys)], "id long, key double")
    for k in (1, 777, 2500, 4999):
        assert kth_largest(df, "key", k, bins=16, few=10) == sorted(map(float, keys), reverse=True)[k - 1]
    assert kth_largest(df, "key", 5000) == -math.inf and kth_largest(df, "key", 0) == math.inf
    assert kth_largest(df.selectExpr("id", "1.0D key"), "key", 10) == 1.0


def test_log_weights_against_plain_sums(spark):
    data, labels = rows()
    data = data[:400]
    got = {x.doc_id: x.log_weight for x in resample(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    mask = (1 << 64) - 1

    def grams(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in text.encode().split()]
        own = [x * 0x9E3779B97F4A7C15 & mask for x in h]
        pairs = [(a + b * 0xC2B2AE3D27D4EB4F) * 0x9E3779B97F4A7C15 & mask for a, b in zip(own, h[1:])]
        return [g >> 46 for g in own + pairs]

    usable = [(i, q, t) for i, q, t in labels if None not in (i, q, t)]
    held = {x.doc_id for x in importance.labelled_sample(spark.createDataFrame(usable, "doc_id long, quality int, toxic int")).where("kind >= 3").collect()}
    fitting = {i for i, q, t in usable if q == 1 and t == 0 and i not in held}
    raw, clean = Counter(), Counter()
    for i, text, *_ in data:
        raw.update(grams(text))
        if i in fitting:
            clean.update(grams(text))
    share = sum(clean.values()) / sum(raw.values())
    for i, text, *_ in data:
        g = grams(text)
        mean = sum(math.log((clean[x] + 5) / (raw[x] * share + 5)) for x in g) / len(g)
        n = min(len(g), 1024)
        assert abs(got[i] - mean * min(n, 8 * math.sqrt(n))) < 1e-6


def test_draws_follow_the_weights(spark):
    """Gumbel top-1 of a table draws each row in proportion to its weight."""
    weights = [0.0, math.log(2), math.log(5)]
    df = spark.range(30_000).selectExpr("id % 10000 game", "cast(id / 10000 as int) option")
    from pyspark.sql import functions as F

    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("option") + 1)
    keyed = df.withColumn("key", weight + importance.gumbel("game", "option", F.lit(23)))
    won = keyed.groupBy("game").agg(F.max_by("option", "key").alias("option")).groupBy("option").count().collect()
    for r in won:
        assert abs(r["count"] / 10_000 - [1, 2, 5][r.option] / 8) < 0.02


def test_windows_against_loops():
    """The strongest four occurrences of each 128 words, windows overlapping by half, in plain loops."""
    r = random.Random(11)
    markers = np.unique(np.array([r.randrange(1 << 64) for _ in range(40)], np.uint64))
    model = importance.Model(np.zeros(1), markers, np.array([r.random() * 3 for _ in markers]))
    strength = dict(zip(markers.tolist(), model.toxicity.tolist()))
    for n in [0, 1, 5, 64, 127, 128, 129, 500, 2000]:
        draw = lambda: np.array([r.choice(markers.tolist()) if r.random() < 0.05 else r.randrange(1 << 64) for _ in range(n)], np.uint64)  # noqa: B023, E731
        words, beginnings = draw(), draw()
        at = sorted((i, strength[h]) for hashes in (words, beginnings) for i, h in enumerate(hashes.tolist()) if h in strength)

        def windows(ahead):
            held = {}
            for i, x in at:  # noqa: B023
                held.setdefault((i + ahead) // 128, []).append(x)
            return [sum(sorted(xs, reverse=True)[:4]) for xs in held.values()]

        worst, usual = model.against(words, beginnings)
        assert math.isclose(worst, max([*windows(0), *windows(64)], default=0.0), abs_tol=1e-9)
        assert math.isclose(usual, sum(windows(0)) / max(1, -(-n // 128)), abs_tol=1e-9)


def test_kept_are_the_k_largest_of_weight_and_noise(spark):
    docs, labels = rows()
    docs = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    drawn = {}
    for seed in (1, 2):
        scored = resample(docs, labels, temperature=20.0, k=300, seed=seed).withColumn("noise", importance.gumbel("doc_id", "rid", F.lit(seed))).collect()
        key = {x.doc_id: x.log_weight + 20.0 * x.noise for x in scored if x.toxicity <= 0}
        drawn[seed] = {x.doc_id for x in scored if x.kept}
        assert drawn[seed] == set(sorted(key, key=key.get, reverse=True)[:300]) and len(key) > 600
        plain = sorted((x for x in scored if x.toxicity <= 0), key=lambda x: -x.log_weight)[:300]
        assert 30 < len(drawn[seed] - {x.doc_id for x in plain}) < 270  # the draw decides, and so do the weights
    assert drawn[1] != drawn[2]
