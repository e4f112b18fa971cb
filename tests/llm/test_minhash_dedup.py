import random

import pytest

from tessera.llm.minhash_dedup import near_duplicates

SCHEMA = "doc_id long, text string, node string, key int"


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words)} if 0 < len(words) < 5 else {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    sets = [grams(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        low = min(ids) if ids else None
        for i in g:
            out.append((rows[i][0], len(sets[i]), low if sets[i] else rows[i][0], True if not sets[i] else rows[i][0] == low))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randrange(3, 200))]
        for _ in range(r.randrange(1, 12)):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((n, r.choice([" ", "\t", "\n "]).join(x.upper() if r.random() < 0.1 else x for x in copy), None, 1))
            n += 1
    rows += [(n, None, None, 1), (n + 1, "", "x", None), (n + 2, " \n\t", None, 1), (n + 3, "a b", None, 1), (n + 4, "A  b", None, 1)]
    rows += [(n + 5, "É a b c d e", None, 1), (n + 6, "é a b c d e", None, 1), (None, "lonely words that stand here alone", None, None)]
    return rows


@pytest.mark.parametrize("hot", [4096, 2])
def test_against_brute_force(spark, hot):
    rows = corpus(hot)
    rows += [rows[0], (rows[1][0], "another text under an id that is taken already", None, 1)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), hot=hot).collect()
    assert sorted((tuple(x) for x in got), key=str) == expected(rows)


def test_word_sequences_that_share_64_bits_stay_apart(spark, monkeypatch):
    import tessera.llm.minhash_dedup as m

    real = m.xxhash.xxh3_128_intdigest
    rows = corpus(5)
    classes = m.near_duplicates(spark.createDataFrame(rows, SCHEMA)).count()
    assert classes == len(rows)

    def signatures(batches):  # runs in the tests' own worker: the first 64 bits are the same for all
        m.xxhash.xxh3_128_intdigest = lambda raw: real(raw) & ((1 << 64) - 1)
        try:
            yield from real_signatures(batches)
        finally:
            m.xxhash.xxh3_128_intdigest = real

    real_signatures = m._signatures
    monkeypatch.setattr(m, "_signatures", signatures)
    got = m.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(x) for x in got), key=str) == expected(rows)


def test_long_texts_and_a_hot_shingle(spark):
    r = random.Random(9)
    words = lambda n: " ".join("%x" % r.getrandbits(30) for _ in range(n))
    shared, long = "one line that all of these texts share word by word", words(60_000)
    rows = [(i, f"{words(2)} {shared} {words(2)}", None, 1) for i in range(120)] + [(500, long, None, 1), (501, long + " more", None, 1), (502, words(60_000), None, 1)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), hot=8).collect()
    assert sorted((tuple(x) for x in got), key=str) == expected(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
