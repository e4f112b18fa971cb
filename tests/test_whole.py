"""Operators against brute force, and chains and dumps over whole tables."""

import difflib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import address
from tessera.operators import graph as G
from tessera.operators import matching
from tessera.plans import catalogue


def test_names_against_all_pairs(spark):
    r = random.Random(1)
    a = {"abxcdyef", "abcdef", "abcdefghij"} | {"".join(r.choice("abcd") for _ in range(r.randrange(1, 14))) for _ in range(60)}
    b = {"abzcdwef", "abXcdYef", "abxcdxefxghxij"} | {"".join(r.choice("abcde") for _ in range(r.randrange(1, 14))) for _ in range(60)}
    got = {x.l: (x.r, round(x.score, 9)) for x in matching.by_name(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), "a", "b").collect()}
    want = {}
    for x in a:
        score = lambda y: 1.0 if sorted(x) == sorted(y.lower()) else difflib.SequenceMatcher(None, x, y.lower()).ratio()  # noqa: B023, E731
        best = min(b, key=lambda y: (-score(y), y))  # noqa: B023
        if score(best) >= 0.7:
            want[x] = (best, round(score(best), 9))
    assert got == want and "abxcdyef" in got and "abcdef" in got


def test_names_of_one_form(spark):
    """Few pairs are met, each once, and none that reaches the level is lost."""
    a, b = [f"customer{i:09d}" for i in range(0, 1500, 5)], [f"customer{i:09d}" for i in range(1, 1500, 5)]
    items = [matching._letters(spark.createDataFrame([(x,) for x in names], f"{k} string"), k) for names, k in ((a, "kl"), (b, "kr"))]
    counts = items[0].select("item").unionByName(items[1].select("item")).groupBy("item").count().collect()
    rarity = spark.createDataFrame([(x.item, i) for i, x in enumerate(sorted(counts, key=lambda x: (x["count"], x.item)))], "item string, rank int")
    ranked = [matching._ranked(i, rarity, k, p) for i, k, p in zip(items, ("kl", "kr"), "lr")]
    pairs = [tuple(x) for x in matching.name_candidates(*ranked, 0.93).collect()]
    close = {(x, y) for x in a for y in b if difflib.SequenceMatcher(None, x, y).ratio() >= 0.93}
    assert len(pairs) == len(set(pairs)) < 0.1 * len(a) * len(b) and close <= set(pairs) and close


def test_names_one_letter_off_are_met_by_it(spark, monkeypatch):
    """Names of one form whose partner lacks one letter are settled without the pairs that have the same letters."""
    monkeypatch.setattr(matching, "name_candidates", lambda *_: pytest.fail("all pairs of the same letters"))
    names = [f"Customer#{i:09d}" for i in range(2000)]
    a, b = spark.createDataFrame([(f"{x}x",) for x in names], "a string"), spark.createDataFrame([(x,) for x in names], "b string")
    got = {x.l: (x.r, x.score) for x in matching.by_name(a, b, "a", "b").collect()}
    assert got == {f"{x}x": (x, 36 / 37) for x in names}
    got = matching.by_name(b, a, "b", "a").collect()
    assert {x.l: (x.r, x.score) for x in got} == {x: (f"{x}x", 36 / 37) for x in names}


def test_streets_against_all_pairs(spark):
    r = random.Random(2)
    names = ["садовая", "новосадовая", "сад", "са", "садовый", "вая", "мира", "мираж", "адмирал"]
    more = lambda: " ".join(r.sample(["ростов", "южный", "северный", "донской", "центр", "поле"], r.randrange(5)))
    rows = lambda n: [(i, f"{more()} ул {r.choice(names)} д {r.choice(['1', '2', '1/2'])}" if r.random() < 0.6 else r.choice([f"{more()} ул {r.choice(names)}", "д ул д"])) for i in range(n)]
    a, b = spark.createDataFrame(rows(120), "i long, a string"), spark.createDataFrame(rows(80), "j long, b string").withColumn("rank", F.col("j") % 3)
    got = {x.i: (x.j, round(x.score, 9)) for x in matching.by_address(a, b, "i", "j", "a", "b", "rank").collect()}
    all_pairs = a.crossJoin(b).withColumn("s", address.likeness(F.col("a"), F.col("b"))).where("s >= 0.6").collect()
    want = {}
    for x in sorted(all_pairs, key=lambda x: (x["rank"], -x.s, x.j)):
        want.setdefault(x.i, (x.j, round(x.s, 9)))
    assert got == want
    one = lambda x, c: spark.createDataFrame([(1, x, 1)], f"{c} long, t{c} string, rank int")
    assert matching.by_address(one("ул садовая д 1", "i").drop("rank"), one("ул новосадовая д 1", "j"), "i", "j", "ti", "tj", "rank").count() == 1


def met(df):
    """The most rows that a join of df made; df is run for it."""
    df.collect()

    def most(node):
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("numOutputRows").get().value() if "Join" in node.nodeName() else 0
        return max([own, *map(most, inner)])

    return most(df._jdf.queryExecution().executedPlan())


def test_streets_that_share_a_beginning(spark, monkeypatch):
    """What meets grows with the names, not with their product, also where all begin alike; longer names than a piece are met by theirs."""
    letters = lambda c: F.translate(F.col(c).cast("string"), "0123456789", "абвгдежзик")
    names = lambda before, after: spark.range(1500).select(F.struct(F.concat(F.lit(before), letters("id"), F.lit(after)).alias("street")).alias("s"))
    for after in ("ю", "ю" + "щ" * 100):
        df = matching._streets(names("садовая", after), names("новосадовая", after))
        with monkeypatch.context() as m:  # all that meet, before they are told apart
            m.setattr(matching.F, "startswith", lambda *_: F.lit(True))
            assert met(matching._streets(names("садовая", after), names("новосадовая", after))) < 10 * 1500
        got = {tuple(x) for x in df.collect()}
        assert len(got) == 1500 and all(r == f"ново{x}" for x, r in got)


def test_best_candidates_of_classes(spark):
    """What meets grows with the kinds and amounts of a block; the five best are those of all pairs, also where something isn't known."""
    r = random.Random(3)
    rows = [(i, r.choice("ab") if r.random() < 0.97 else None, r.choice(["x", "y", None]), r.choice([100.0, 100.9, 101.0, 104.0, 106.0, 300.0, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, b string, t string, x double")
    out = matching.certificate_best(df, ["b"], "i", "t", "x")
    assert met(out) < 10_000
    a, b = df, df.select("b", F.col("i").alias("c"), F.col("t").alias("u"), F.col("x").alias("y"))
    pairs = a.join(b, "b").where("i <> c").withColumn("score", matching.certificate_points(F.col("t") == F.col("u"), F.lit(0.0), F.col("x"), F.col("y")))
    want = {tuple(x) for x in matching.best_candidates(pairs, "i", "c", "score").select("i", "c", "score", "place").collect()}
    assert {tuple(x) for x in out.collect()} == want and want


def test_a_street_without_numbers_is_not_paired(spark):
    """3,000 rows on either side of one street: what meets grows with the rows, not with their product."""
    side = lambda c: spark.range(3000).select(F.col("id").alias(c), F.concat(F.lit("город ростов ул садовая офис "), (F.col("id") % 500 + 10).cast("string")).alias(f"t{c}"))
    got = matching.by_address(side("i"), side("j").withColumn("rank", F.col("j") % 2), "i", "j", "ti", "tj", "rank")
    assert {x.i: x.j for x in got.collect()} == {i: i % 500 if i % 2 == 0 else 0 for i in range(3000)}


def test_founder_levels_has_no_depth(spark, tmp_path):
    spark.createDataFrame([(1, -5.0), (100, 1.0), (10_000, 1.0), (1_000_000, 1.0)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted((x.start, x.found, x.path, x.depth) for x in catalogue.QUERIES["founder_levels"](spark, str(tmp_path)).collect())
    assert got[-1] == (1_000_000, 1, "1000000>10000>100>1", 3) and len(got) == 4


def test_recursive_chain_has_no_depth(spark):
    spark.createDataFrame([(i, i - 1 if i else 2, i == 0) for i in range(68)], "n long, up long, hit boolean").coalesce(1).createOrReplaceTempView("long_chain")
    deepest = G.chains_recursive(spark, "long_chain", "n", "up", "hit").agg(F.max("depth"), F.count("*")).first()
    assert tuple(deepest) == (67, 68)


def test_every_customer_is_dumped(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert catalogue.QUERIES["dump_all_rows"](spark, str(tmp_path)).distinct().count() == 100


def test_founders_of_one_number_stand_by_order(spark, tmp_path):
    """Padding gives 408, 1408 and 11408 one number. Their order is open in the SQL; DuckDB keeps that of so few rows."""
    spark.createDataFrame([(7, "Customer#7", "MACHINERY"), (8, "Customer#8", "BUILDING")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [1, 408, 410, 1408, 2584, 11408]
    spark.createDataFrame([(o, 7) for o in orders], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {x.c_custkey: x for x in catalogue.QUERIES["legal_documents"](spark, str(tmp_path)).collect()}
    assert [p.split(":")[1] for p in got[7].pledges.split(";")] == ["408", "1408", "11408", "2584"] and got[8].pledges == ""
    duck = duckdb.connect()
    for t in ("customer", "orders"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    result = duck.execute(catalogue.ORACLE_SQL["legal_documents"])
    names = [d[0] for d in result.description]
    assert {r[0]: r for r in result.fetchall()} == {k: tuple(x[n] for n in names) for k, x in got.items()}
