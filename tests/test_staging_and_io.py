import os

import pytest
from helpers import rows

from storepulse.operators import staging
from storepulse.sources import raw, sinks

TEXT = {
    "orders": ["o1,c1,DELIVERED,2018-01-01 10:00:00,2018-01-01 11:00:00,,\"\",2018-01-20 00:00:00,extra"],
    "order_items": ["o1,1,p1,s1,2018-01-05 00:00:00,10.50,2.25"],
    "order_payments": ["o1,1,Credit_Card,3,12.75"],
    "customers": ["c1,person1,01234,São Paulo,sp"],
    "sellers": ["s1,04321,RIO,rj"],
    "products": ["p1,livros", "p2,sem_nome", "p3,"],
    "category_translation": ["livros,books"],
    "marketing_qualified_leads": ["m1,2018-01-01,lp,Email", "m2,2018-01-01,lp,", "m3,2018-01-01,lp,\"\""],
    "closed_deals": ["m1,s1,a,b,2018-01-03 00:00:00,,online,,abc", "m2,s2,a,b,2018-01-03 00:00:00,pet,,shop,1200.5"],
}


def write_raw(folder, tables=TEXT):
    for name, lines in tables.items():
        header = list(raw.CATALOG[name].columns)
        if name == "orders":
            header.append("ignored_extra")
        path = os.path.join(folder, raw.CATALOG[name].file)
        with open(path, "w", encoding="utf-8") as out:
            out.write("\n".join([",".join(header), *lines]) + "\n")


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    write_raw(folder)
    tables = raw.read_raw(spark, folder)
    assert {t.simpleString() for df in tables.values() for t in (f.dataType for f in df.schema)} == {"string"}
    counts = dict(rows(raw.row_counts(tables), "table", "rows"))
    assert counts["products"] == 3 and counts["closed_deals"] == 2 and len(counts) == 9
    return staging.stage_all(tables)


def test_missing_files_are_all_named(spark, tmp_path):
    write_raw(str(tmp_path), {"orders": TEXT["orders"]})
    with pytest.raises(raw.MissingInput) as err:
        raw.read_raw(spark, str(tmp_path))
    assert "order_items.csv" in str(err.value) and "closed_deals.csv" in str(err.value)
    assert " orders.csv" not in str(err.value)


def test_missing_column_is_named(spark, tmp_path):
    write_raw(str(tmp_path))
    (tmp_path / "sellers.csv").write_text("seller_id\ns1\n")
    with pytest.raises(ValueError, match="seller_city"):
        raw.read_raw(spark, str(tmp_path))


BAD = ["4,5", "6,7,8,9,10", "s7,\"open,RIO,rj", "s8"]
GOOD = ["s1,04321,RIO,rj", "s2,\"a, \"\"b\"\"\",SP,sp", "s3,,,", ",,,"]


def test_malformed_rows_are_set_aside(spark, tmp_path):
    """Good and malformed rows together are all rows; each malformed one is named by file and line."""
    write_raw(str(tmp_path))
    (tmp_path / "sellers.csv").unlink()
    (tmp_path / "sellers.csv").mkdir()
    header = ",".join(raw.CATALOG["sellers"].columns)
    where = {}
    for part, lines in {"a": [GOOD[0], BAD[0], "", GOOD[1], BAD[1]], "b": [BAD[2], *GOOD, BAD[3]]}.items():
        (tmp_path / "sellers.csv" / f"{part}.csv").write_text("\n".join([header, *lines]) + "\n")
        where |= {(f"{part}.csv", i): x for i, x in enumerate(lines, start=2) if x in BAD}
    tables = raw.read_raw(spark, str(tmp_path))
    assert tables["sellers"].columns == list(raw.CATALOG["sellers"].columns)
    good = rows(tables["sellers"], "seller_id", "seller_zip_code_prefix")
    assert good == sorted([("s1", "04321"), ("s2", 'a, "b"'), ("s1", "04321"), ("s2", 'a, "b"'), ("s3", None), (None, None)], key=repr)
    assert tables["sellers"].select("seller_id").count() == 6 == raw.row_counts(tables).filter("table = 'sellers'").first().rows
    out = raw.malformed(spark, str(tmp_path))
    assert {(os.path.basename(r.file), r.line): r.text for r in out.collect()} == where
    assert {r.table for r in out.collect()} == {"sellers"}


def test_line_numbers_over_many_blocks(spark, tmp_path):
    write_raw(str(tmp_path), {**TEXT, "products": [f"p{i},c{i}" if i % 50 else f"p{i}" for i in range(2, 3000)]})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = raw.malformed(spark, str(tmp_path))
        assert rows(out, "line", "text") == sorted(((i, f"p{i}") for i in range(50, 3000, 50)), key=repr)
        assert raw.read_raw(spark, str(tmp_path))["products"].count() == 2998 - 59
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_of_a_table_agree_in_their_headers(spark, tmp_path):
    write_raw(str(tmp_path))
    (tmp_path / "products.csv").unlink()
    (tmp_path / "products.csv").mkdir()
    (tmp_path / "products.csv" / "a.csv").write_text("product_id,product_category_name\np1,x\n")
    (tmp_path / "products.csv" / "b.csv").write_text("product_category_name,product_id\nx,p2\n")
    with pytest.raises(Exception, match="(?i)header"):
        raw.read_raw(spark, str(tmp_path))["products"].collect()


def test_other_file_names():
    assert raw.catalog_with_files({"orders": "my_orders.csv"})["orders"].file == "my_orders.csv"


def test_types(staged):
    assert dict(staged["stg_orders"].dtypes)["purchased_at"] == "timestamp_ntz"
    assert dict(staged["stg_order_items"].dtypes)["item_price"] == "decimal(12,2)"
    assert dict(staged["stg_leads"].dtypes)["first_contact_date"] == "date"


def test_blanks_and_case(staged):
    order = staged["stg_orders"].first()
    assert order.order_status == "delivered" and order.shipped_at is None and order.delivered_at is None
    assert rows(staged["stg_leads"], "mql_id", "origin") == [("m1", "email"), ("m2", "unknown"), ("m3", "unknown")]
    deals = rows(staged["stg_closed_deals"], "mql_id", "business_segment", "lead_type", "declared_monthly_revenue")
    assert deals == [("m1", "unknown", "online", None), ("m2", "pet", "unknown", 1200.5)]
    assert staged["stg_customers"].first().city == "são paulo" and staged["stg_customers"].first().state == "SP"


def test_category_fallback(staged):
    got = rows(staged["stg_products"], "product_id", "category_pt", "category")
    assert got == [("p1", "livros", "books"), ("p2", "sem_nome", "sem_nome"), ("p3", None, "unknown")]


def test_save_replace_and_read_back(spark, tmp_path):
    tables = sinks.Tables(spark, str(tmp_path))
    tables.save("marts", "numbers", spark.range(5))
    assert tables.get("marts", "numbers").count() == 5
    again = tables.save("marts", "numbers", spark.range(3).selectExpr("id", "id % 2 as part"), ["part"])
    assert again.count() == 3 and tables.sql("select count(*) as n from marts_numbers").first().n == 3
    with pytest.raises(ValueError):
        tables.path("nowhere", "numbers")


def test_tables_of_two_folders_and_a_new_session(spark, tmp_path):
    one, two = (sinks.Tables(spark, str(tmp_path / x)) for x in ("one", "two"))
    one.save("marts", "numbers", spark.range(5))
    two.save("marts", "numbers", spark.range(7))
    assert (one.get("marts", "numbers").count(), two.get("marts", "numbers").count()) == (5, 7)
    assert one.sql("select count(*) as n from marts_numbers").first().n == 5
    assert two.sql("select count(*) as n from marts_numbers").first().n == 7
    later = sinks.Tables(spark.newSession(), str(tmp_path / "one"))
    assert later.get("marts", "numbers").count() == 5
    assert later.sql("select max(id) as m from marts_numbers").first().m == 4


def test_report_has_header_and_one_file(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report(spark.range(4), path, single_file=True)
    parts = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert len(parts) == 1
    with open(os.path.join(path, parts[0])) as f:
        assert f.read().splitlines() == ["id", "0", "1", "2", "3"]
