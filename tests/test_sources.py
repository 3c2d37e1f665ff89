import datetime as dt

import pytest

from parcelwise.operators import cleaning, features
from parcelwise.plans.report import run_report
from parcelwise.sources import sinks, wide
from parcelwise.sources.star import order_line_columns, order_lines

SMALL = "/root/testdata/sf0.001"


def wide_rows(n):
    """Rows of the wide table with every category level varied by position."""
    out = []
    for i in range(n):
        row = {}
        for name, kind in wide.WIDE_COLUMNS.items():
            if kind in ("int", "long"):
                row[name] = str(i % 3)
            elif kind == "double":
                row[name] = str(round((i * 7 % 23) / 4, 2))
            elif kind == "timestamp":
                row[name] = f"{i % 12 + 1}/{i % 28 + 1}/201{i % 2 + 6} {i % 24}:05"
            else:
                row[name] = f"{name[:3]} {i % 4}"
        row["Order Item Id"] = str(i)
        row["Late_delivery_risk"] = str(int(i % 5 < 2))
        row["Days for shipment (scheduled)"] = str((0, 1, 2, 4)[i % 4])
        row["Shipping Mode"] = ("Same Day", "First Class", "Second Class", "Standard Class")[i % 4]
        row["Order Status"] = ("COMPLETE", "SUSPECTED_FRAUD", "PENDING")[i % 3]
        out.append(row)
    return out


def write_csv(path, rows, encoding="latin1", pad=()):
    names = list(wide.WIDE_COLUMNS)
    header = [n + "   " if n in pad else n for n in names]
    with open(path, "w", encoding=encoding) as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r[n] for n in names) + "\n")


def test_wide_csv_is_read_with_declared_types(spark, tmp_path):
    rows = wide_rows(20)
    rows[0]["Customer City"] = "Málaga "
    write_csv(tmp_path / "w.csv", rows, pad=("Order Item Discount Rate",))
    df = wide.read_wide_csv(spark, str(tmp_path / "w.csv"))
    first = df.where("line_id = '0'").first()
    assert first["customer_city"] == "Málaga " and first["order_ts"] == dt.datetime(2016, 1, 1, 0, 5)
    assert dict(df.dtypes)["discount_rate"] == "double" and dict(df.dtypes)["late_risk"] == "int"
    bad = spark.createDataFrame([("1/31/2018 22:56",), ("soon",), (None,)], "t string")
    assert tuple(wide.unparsed_times(bad, "t", "M/d/yyyy H:mm").first()) == (2, 1)


def test_column_accounting_of_the_wide_table(spark, tmp_path):
    write_csv(tmp_path / "w.csv", wide_rows(30))
    df = wide.read_wide_csv(spark, str(tmp_path / "w.csv")).drop("source_market")
    assert len(df.columns) == 53 == len(wide.wide_schema())
    cleaned = cleaning.clean(df)
    assert len(cleaned.columns) == 37
    modelled = cleaning.model_columns(cleaned)
    assert len(modelled.columns) == 27
    assert sum(t == "string" for _, t in modelled.dtypes) == 9
    assert len(features.interaction_columns(("a", "b", "c", "d"))) == 6


def test_tables_survive_a_round_trip(spark, tmp_path):
    df = order_lines(spark, SMALL, ("line_id", "late_risk", "sales"))
    sinks.save_table(df, str(tmp_path / "clean"))
    back = spark.read.parquet(str(tmp_path / "clean"))
    assert back.dtypes == df.dtypes and back.exceptAll(df).count() == 0
    sinks.save_result(back.groupBy("late_risk").count(), str(tmp_path / "result"))
    assert spark.read.option("header", True).csv(str(tmp_path / "result")).columns == ["late_risk", "count"]


def test_only_needed_tables_are_joined(spark):
    plan = order_lines(spark, SMALL, ("sales",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    region = order_lines(spark, SMALL, ("order_region", "late_risk"))._jdf.queryExecution().optimizedPlan().toString()
    assert "p_brand" not in region and "s_name" not in region
    assert order_lines(spark, SMALL).columns == order_line_columns()


def test_report_over_the_wide_table(spark, tmp_path):
    write_csv(tmp_path / "w.csv", wide_rows(240))
    lines = wide.read_wide_csv(spark, str(tmp_path / "w.csv"))
    names = ["risk_by_region", "correlation_matrix", "roc_auc", "kaplan_meier", "hourly_volume_risk", "kmeans_summary", "lr_coefficients"]
    done = run_report(lines, str(tmp_path / "out"), names)
    assert list(done) == names
    for name in names:
        assert spark.read.option("header", True).csv(str(tmp_path / "out" / name)).count() > 0


def test_ids_beyond_32_bits_are_kept(spark, tmp_path):
    rows = wide_rows(6)
    for i, r in enumerate(rows):
        r["Order Item Id"] = r["Order Id"] = str(2**31 + i)
    write_csv(tmp_path / "w.csv", rows)
    df = wide.read_wide_csv(spark, str(tmp_path / "w.csv"))
    assert {r["line_id"] for r in df.collect()} == {str(2**31 + i) for i in range(6)}
    assert df.where("order_id is null").count() == 0
    bad = spark.createDataFrame([("1", "7"), ("x", None), (None, "1e99x")], "line_id string, sales string")
    assert {tuple(r) for r in wide.unparsed_numbers(bad, ["line_id", "sales"]).collect()} == {("line_id", 2, 1), ("sales", 2, 1)}


def test_files_with_another_header_are_refused(spark, tmp_path):
    rows = wide_rows(3)
    write_csv(tmp_path / "a.csv", rows)
    text = (tmp_path / "a.csv").read_text(encoding="latin1").split("\n", 1)
    swapped = text[0].replace("Sales,Order Item Total", "Order Item Total,Sales")
    assert swapped != text[0]
    (tmp_path / "b.csv").write_text(swapped + "\n" + text[1], encoding="latin1")
    for columns in (["*"], ["sales"]):
        with pytest.raises(Exception, match="header"):
            wide.read_wide_csv(spark, str(tmp_path)).select(*columns).collect()


def test_scratch_tables_go(spark, tmp_path):
    import os

    from parcelwise.functions.small import checkpointed, clear_scratch, scratch_folder

    df = checkpointed(spark.range(3).withColumn("a b", spark.range(1).select("id").scalar()))
    assert df.columns == ["id", "a b"] and df.count() == 3
    folder = scratch_folder(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    clear_scratch(spark)
    assert not os.path.isdir(folder)


def test_lines_are_joined_with_parts_then_orders_alone(spark):
    """Lines, the largest table, meet two others; an order's customer is found before (F15 to F28: disk of the shuffles)."""
    from parcelwise.plans.catalogue import MODEL_USES

    plan = order_lines(spark, SMALL, MODEL_USES)._jdf.queryExecution().optimizedPlan().toString()
    depth = {}
    for line in plan.splitlines():
        for key in ("l_partkey", "l_orderkey", "o_custkey", "c_nationkey"):
            if "Join LeftOuter, (" in line and f"({key}#" in line:
                depth[key] = line.index("Join")
    assert depth["l_orderkey"] < min(depth["l_partkey"], depth["o_custkey"], depth["c_nationkey"])


def test_emptiness_needs_no_join(spark, monkeypatch):
    from parcelwise.plans import catalogue

    plans, take = [], type(spark.range(1)).take
    monkeypatch.setattr(type(spark.range(1)), "take", lambda df, n: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or take(df, n))
    lines = order_lines(spark, SMALL, catalogue.MODEL_USES)
    run = catalogue.of_rows("n long")(lambda df: spark.range(3).toDF("n"))
    assert run(lines).count() == 3 and run(lines.limit(0)).count() == 0
    assert len(plans) == 2 and "Join" not in plans[0]
