from pyspark.sql import functions as F

from tessera.operators import views


def store(spark):
    land = spark.createDataFrame([("1:1", "Поле", "ул. А", 10.0, "active", None), ("1:2", None, None, None, "deregistered", "[]")], "cad_number string, name string, address string, area double, lifecycle_status string, object_restrictions string")
    building = spark.createDataFrame([("2:1", "building", "Дом", "ул. Б", 5.0, "active", '[{"a":1},{"b":2}]'), ("2:2", "hut", "Хата", None, None, "active", "bad")], "cad_number string, object_type string, name string, address string, area double, lifecycle_status string, object_restrictions string")
    rights = spark.createDataFrame(
        [(1, "2:1", "right", "ownership", "n1", 1, 2, None, "2020-01-01", 1), (2, "2:1", "encumbrance", "lease", "n2", None, None, "2024-01-01", "2021-01-01", 1), (3, "1:1", "restriction", None, "n3", None, None, None, None, 1), (4, "1:1", "encumbrance", "mortgage", "n4", None, None, None, None, 0)],
        "right_id int, object_key_value string, right_category string, right_type_code string, right_number string, share_numerator int, share_denominator int, valid_until string, right_date string, is_active int",
    ).withColumn("valid_from", F.lit(None).cast("string"))
    holders = spark.createDataFrame([(1, "legal", "Б", "77", None), (1, "legal", "А", None, None), (2, "legal", "В", None, None)], "right_id int, holder_type string, name string, inn string, ogrn string")
    extracts = spark.createDataFrame([("2:1", "e1", "2020-01-01"), ("2:1", "e2", "2022-01-01")], "cad_number string, extract_number string, extract_date string")
    money = spark.createDataFrame([("2:1", "initial", 5.0, "2020-01-01"), ("2:1", "initial", 7.0, "2021-01-01"), ("2:1", "residual", 1.0, None)], "cad_number string, valuation_type string, amount double, doc_date string")
    return {"land_objects": land, "building_objects": building, "rights": rights, "right_holders": holders, "extracts": extracts, "valuations": money}


def test_views(spark):
    s = store(spark)
    views.register_views(spark, s, F.lit("2024-01-01"))
    d = {r.cad_number: r for r in spark.table("v_object_dossier").collect()}
    h = d["2:1"]
    assert (h.owners, h.active_leases, h.encumbrances_count, h.object_restrictions_count, h.last_extract, h.book_value_initial, h.book_value_residual) == ("А; Б ИНН 77", "n2", 1, 2, "e2 от 2022-01-01", 7.0, 1.0)
    assert (d["1:1"].restrictions_count, d["1:1"].encumbrances_count, d["2:2"].object_type_ru, d["2:2"].object_restrictions_count) == (1, 0, "hut", 0)
    assert [(r.contract_number, r.status, r.lessee_name) for r in spark.table("v_lease_contracts").collect()] == [("n2", "Действует", "В")]
    assert [r.right_number for r in spark.table("v_pledges_prohibitions").collect()] == ["n4"]
    assert sorted(r.share_str for r in spark.table("v_rights_full").collect()) == ["1/1", "1/1", "1/1", "1/2", "1/2"]
    grants = spark.createDataFrame([("u", "2:1", "2030-01-01"), ("u", "2:2", "2020-01-01")], "subject string, resource_id string, expires_at string")
    assert [r.cad_number for r in views.catalogue(s, "ул.", None, grants, "u", F.lit("2024-01-01")).collect()] == ["2:1"]
    assert {r.cad_number for r in views.catalogue(s).collect()} == {"1:1", "2:1", "2:2"}
    assert spark.range(1).select(views.is_deregistered(F.lit("Снят с учета")).alias("x")).first().x
