import random
import zlib

from tessera.llm.mixing import fit_budget, mix, water_fill
from tessera.llm.ring_shards import place, shard_rows

SCHEMA = "doc_id long, text string, source string, size string, shard int"


def test_fit_budget_is_exact_where_it_can_be():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randrange(1, 40): r.randrange(1, 6) for _ in range(r.randrange(1, 8))}
        whole = sum(n * c for n, c in counts.items())
        reach = {0}
        for n, c in counts.items():
            reach = {x + n * k for x in reach for k in range(c + 1)}
        budget = r.randrange(whole + 1)
        took = fit_budget(counts, budget)
        assert all(0 <= took[n] <= counts[n] for n in counts)
        got = sum(n * k for n, k in took.items())
        assert got <= budget
        base = {n: c * budget // whole for n, c in counts.items()} if whole > budget else counts
        floor = sum(n * k for n, k in base.items())
        rest = {0}
        for n, c in counts.items():
            rest = {x + n * k for x in rest for k in range(c - base[n] + 1)}
        assert got == floor + max(x for x in rest if floor + x <= budget) or whole <= budget


def test_what_is_left_favours_no_length():
    counts = {n: 7 for n in range(1, 2001)}
    whole = 7 * sum(counts)
    for budget in (whole // 3, whole // 2 + 12345):
        took = fit_budget(counts, budget)
        assert sum(n * k for n, k in took.items()) == budget
        share = 7 * budget / whole
        assert all(abs(k - share) <= 2 for k in took.values())
        long = sum(k for n, k in took.items() if n > 1000) / sum(took.values())
        assert abs(long - 0.5) < 0.02


def test_a_very_long_text_in_a_mix(spark):
    data = [(1, "w " * 300_000, "a", None, None), *((i, "w " * (i % 50), "b", None, None) for i in range(2, 400)), (None, "a b", None, None, None)]
    got = {x.doc_id: x for x in mix(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[1].size == 300_000 and got[1].taken in (0, 300_000, 600_000) and got[None].size == 2


def test_water_fill():
    assert water_fill([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, 2 / 3 * 250, 1 / 3 * 250]
    assert water_fill([0, 10], [5, 2], 15, 2) == [0.0, 15.0]


def rows(n=3000):
    r = random.Random(5)
    out = [(i, " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(0, 40))), r.choice(["a", "b", "c", "d", None, "É"]), "x", 1) for i in range(n)]
    return out + [(7, None, "a", None, None), (7, None, "a", None, None), (None, "a b c", None, None, None)] + [(5, "same words here", "a", None, None)] * 500


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = sorted((tuple(x) for x in mix(df, part_rows=50).collect()), key=str)
    assert got == sorted((tuple(x) for x in mix(df.repartition(2), part_rows=50).collect()), key=str)
    assert len(got) == len(data)
    total = sum(x[1] for x in got)
    by = {}
    for _, size, source_size, target, taken in got:
        assert taken in (0, size, 2 * size)
        by.setdefault((source_size, target), []).append((size, taken))
    assert len(by) == 6 and abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (source_size, target), own in by.items():
        assert sum(s for s, _ in own) == source_size and target <= 2 * source_size
        assert abs(sum(t for _, t in own) - target) <= 1


def checked_shards(spark, data, slack=1.02):
    """Shards of each text; contract columns, slots and balance are as they must be."""
    got = shard_rows(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    want = sorted((x[0] is None, x[0] or 0, len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in data)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.size, x.text_crc32) for x in got) == want
    loads, slots, texts = [0] * 16, {}, {}
    for x in got:
        assert x.law == "bytes" and x.grown_shard is None
        loads[x.shard] += x.size
        slots.setdefault(x.shard, []).append(x.slot)
        texts.setdefault((x.size, x.text_crc32), set()).add(x.shard)
    assert max(loads) <= slack * sum(loads) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return texts, loads


def test_shards_keep_equal_texts(spark):
    r = random.Random(7)
    data = rows() + [(None, f"text {i % 40} " + "x" * r.randrange(3), None, None, None) for i in range(200)]
    data += [(9000 + i, f"a group of copies, number {i % 30}", "a", None, 1) for i in range(900)]
    texts, loads = checked_shards(spark, data)
    assert all(len(s) == 1 for s in texts.values()) and min(loads) > 0.97 * sum(loads) / 16


def test_shards_cut_a_text_that_outweighs_one(spark):
    data = rows(2000) + [(20_000 + i, "copies that weigh a third of all " * 3, "a", None, None) for i in range(1000)]
    texts, loads = checked_shards(spark, data)
    cut = {k: s for k, s in texts.items() if len(s) > 1}
    assert len(cut) == 1 and next(iter(cut))[0] == len("copies that weigh a third of all " * 3) + 1


def test_one_row_larger_than_a_shard(spark):
    data = rows(500) + [(90_000, "very long " * 200_000, "a", None, None)]
    texts, loads = checked_shards(spark, data, slack=16)
    assert max(loads) >= 2_000_000 and all(loads)


def test_ring_moves_little():
    r = random.Random(1)
    loads = [(r.getrandbits(64), r.randrange(50, 150)) for _ in range(8000)]
    a, b = place(loads, 16), place(loads, 17)
    assert None not in a and sum(x != y for x, y in zip(a, b)) < 0.15 * len(loads)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).collect() == [] and shard_rows(empty).collect() == []
