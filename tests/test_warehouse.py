"""Raw CSV files through to reports and answers, on files in a scratch folder."""

import csv
import datetime as dt
import os
import re
from concurrent.futures import ThreadPoolExecutor

import pytest

from seasonstar.plans.warehouse import LoadError, RawPaths, Warehouse
from seasonstar.sources.layouts import MappingLayout, NightsLayout, SpendLayout, VisitorLayout
from seasonstar.sources.tables import read_text_csv, rebuild_table
from seasonstar.sources.versions import ConflictError, VersionedTables

AREAS = ((7, "Harbour", "Visit Harbour"), (12, "Taupō", "Lake Taupo"), (30, "Hills", None))


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as handle:
        writer = csv.writer(handle)
        writer.writerow(header)
        writer.writerows(rows)
    return str(path)


def months():
    return [dt.date(2024 + i // 12, i % 12 + 1, 1) for i in range(24)]


@pytest.fixture
def raw(tmp_path):
    mapping = [
        (code, name, name, label or "null", label or "null", 1.5) for code, name, label in AREAS
    ]
    visitors, nights, spend = [], [], []
    for m in months():
        slash = f"{m.day}/{m.month:02d}/{m.year}"
        for code, name, label in AREAS:
            for k, (segment, measure, kind) in enumerate(
                (
                    ("Domestic visitor", "Domestic guest nights", "New Zealand"),
                    (
                        "Total international visitor",
                        "International guest nights",
                        "International",
                    ),
                )
            ):
                count = code + 10 * m.month * (k + 1)
                visitors.append((f"RTO{code:02d}", f"{name} RTO", segment, slash, count, "RTO"))
                nights.append((m.isoformat(), "RTO", f"{name} RTO", "Motel", measure, count, ""))
                nights.append((m.isoformat(), "RTO", f"{name} RTO", "Hotel", measure, 999, "c"))
                if label:
                    for product in ("Food", "Fuel, other"):
                        spend.append(
                            (slash, label, product, kind, "Anywhere", 0, m.month + k + code / 10)
                        )
    return RawPaths(
        mapping=write_csv(
            tmp_path / "mapping.csv", (*MappingLayout().columns, "Shape_Length"), mapping
        ),
        visitors=write_csv(tmp_path / "visitors.csv", VisitorLayout().columns, visitors),
        nights=write_csv(tmp_path / "nights.csv", NightsLayout().columns, nights),
        spend=write_csv(tmp_path / "spend.csv", SpendLayout().columns, spend),
    )


def test_build(spark, raw, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(raw)
    warehouse.build_star()
    reports = {name: frame.collect() for name, frame in warehouse.reports().items()}
    assert tuple(reports["missing_measures"][0]) == (144, 48, 0, 0)
    assert len(reports["months"]) == 24 and len(reports["fact_sample"]) == 50
    assert {r.RTOName for r in reports["coverage_gaps"]} == {"Hills"}
    assert all(r.SpendData == "Available" for r in reports["month_completeness"])
    answers = {name: frame.collect() for name, frame in warehouse.answers().items()}
    assert {r.RTOName for r in answers["exposure_score"]} == {"Harbour", "Taupō"}
    assert answers["exposure_score"][0].PeakMonths == "December, November, October"
    assert len(answers["seasonality_index"]) == 3 * 12  # two areas and one zone
    assert len(answers["counter_demand"]) == 3

    warehouse.register_views()
    row = spark.sql(
        """SELECT sum(f.SpendMillion) AS s FROM FactTourismMonthly f
           JOIN DimDate d ON f.DateKey = d.DateKey JOIN DimLocation l USING (LocationKey)
           JOIN DimVisitorType v USING (VisitorTypeKey)
           WHERE d.Year = 2024 AND v.VisitorType = 'Domestic' AND l.RTOName = 'Taupō'"""
    ).first()
    assert row.s == pytest.approx(2 * (78 + 12 * 1.2))
    assert spark.table("FactSpendDetail").count() == 2 * 2 * 2 * 24


def test_year_predicate_prunes_partitions(spark, raw, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(raw)
    warehouse.build_star()
    warehouse.years = (2025,)
    frame = warehouse.answers()["exposure_score"]
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("Year" in f and "2025" in f for f in filters), filters


def test_refresh_replaces_one_year(spark, raw, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(raw)
    warehouse.build_star()
    before = warehouse.table("fact").where("Year = 2024").collect()
    with open(raw.visitors, encoding="utf-8") as handle:
        text = handle.read()
    line = next(row for row in text.splitlines() if "1/03/2025" in row)
    with open(raw.visitors, "w", encoding="utf-8") as handle:
        handle.write(text.replace(line, line.replace(line.split(",")[4], "5000")))
    warehouse.load(raw)
    warehouse.build_star(refresh_years=[2025])
    fact = warehouse.table("fact")
    assert sorted(fact.where("Year = 2024").collect()) == sorted(before)
    assert fact.where("VisitorCount = 5000").count() == 1
    assert fact.count() == 144


def withdraw(path, *signs):
    with open(path, encoding="utf-8") as handle:
        lines = handle.readlines()
    with open(path, "w", encoding="utf-8") as handle:
        handle.writelines(line for line in lines if not any(s in line for s in signs))


def test_a_withdrawn_year_leaves_no_row(spark, raw, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(raw)
    warehouse.build_star()
    assert warehouse.table("spend_detail").where("Year = 2025").count() == 96
    before = sorted(warehouse.table("spend_detail").where("Year = 2024").collect())
    withdraw(raw.spend, "/2025")
    warehouse.load(raw)
    warehouse.build_star(refresh_years=[2025])
    assert warehouse.table("spend_detail").where("Year = 2025").isEmpty()
    assert sorted(warehouse.table("spend_detail").collect()) == before
    assert warehouse.table("fact").where("Year = 2025 AND SpendMillion IS NOT NULL").isEmpty()
    withdraw(raw.visitors, "/2025")
    withdraw(raw.nights, "2025-")
    warehouse.load(raw)
    warehouse.build_star(refresh_years=[2025])
    assert warehouse.table("months").count() == 12 and warehouse.table("fact").count() == 72
    assert warehouse.table("fact").where("Year = 2025").isEmpty()


def test_a_failed_star_leaves_the_last_one(spark, raw, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(raw)
    warehouse.build_star()
    version, fact = warehouse.version(), sorted(warehouse.table("fact").collect())
    withdraw(raw.visitors, "/2025")
    withdraw(raw.nights, "2025-")
    withdraw(raw.spend, "/2025")
    warehouse.load(raw)
    # the other year is taken over from the last version, but its months are gone
    with pytest.raises(LoadError, match="DateKey without a parent"):
        warehouse.build_star(refresh_years=[2024])
    assert warehouse.version() == version
    assert sorted(warehouse.table("fact").collect()) == fact
    assert warehouse.table("months").count() == 24
    assert warehouse.table("spend_detail").where("Year = 2025").count() == 96


def everything(warehouse):
    return {name: sorted(map(str, warehouse.table(name).collect())) for name in ("mapping", "visitors", "nights", "spend")}


def test_a_refused_source_leaves_all_four_tables(spark, raw, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(raw)
    before, version = everything(warehouse), warehouse.clean.current()
    with open(raw.mapping, "a", encoding="utf-8") as handle:
        handle.write("31,Far,Far,Far,Far,1\n")
    withdraw(raw.visitors, "/2025")
    with open(raw.spend, "a", encoding="utf-8") as handle:
        handle.write("2/01/2024,Lake Taupo,Food,New Zealand,Anywhere,0,1\n")
    for how in ("fail", "quarantine"):
        with pytest.raises(LoadError, match="duplicate values"):
            warehouse.load(raw, on_violation=how)
        assert warehouse.clean.current() == version and everything(warehouse) == before


@pytest.mark.parametrize("killed_at", ["mapping", "visitors", "spend", "fact", "publish"])
def test_a_killed_job_leaves_everything(spark, raw, tmp_path, monkeypatch, killed_at):
    from seasonstar.plans import warehouse as module

    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(raw)
    warehouse.build_star()
    versions = warehouse.clean.current(), warehouse.star.current()
    before, fact = everything(warehouse), sorted(warehouse.table("fact").collect())
    withdraw(raw.visitors, "/2025")

    class Killed(BaseException):
        pass

    build, publish = module.rebuild_table, VersionedTables.publish

    def dying(frame, path, **options):
        if path.endswith(f"/{killed_at}"):
            frame.limit(1).write.parquet(path)  # some files, and no word of success
            raise Killed
        return build(frame, path, **options)

    def dying_publish(tables, version):
        if killed_at == "publish":
            raise Killed
        return publish(tables, version)

    monkeypatch.setattr(module, "rebuild_table", dying)
    monkeypatch.setattr(VersionedTables, "publish", dying_publish)
    with pytest.raises(Killed):
        if killed_at != "fact":
            warehouse.load(raw)
        warehouse.build_star()
    assert (warehouse.clean.current(), warehouse.star.current()) == versions
    assert everything(warehouse) == before and sorted(warehouse.table("fact").collect()) == fact
    assert warehouse.expire(unfinished_hours=1) == []
    assert len(warehouse.expire(unfinished_hours=-1)) == 1
    assert everything(warehouse) == before


def test_two_builders_never_share_a_number(spark, raw, tmp_path, monkeypatch):
    one, two = (Warehouse(spark, str(tmp_path / "wh")) for _ in range(2))
    one.load(raw)
    one.build_star()
    begin = VersionedTables.begin

    def overtaken(tables, **made_from):
        draft = begin(tables, **made_from)
        monkeypatch.setattr(VersionedTables, "begin", begin)
        two.load(raw) if tables.root.endswith("clean") else two.build_star()
        return draft

    for job in (lambda: one.load(raw), one.build_star):
        monkeypatch.setattr(VersionedTables, "begin", overtaken)
        with pytest.raises(LoadError, match="published by another job"):
            job()
    for tables in (one.clean, one.star):
        history = tables.history()
        assert [v.number for v in history] == [1, 2] and len({v.name for v in history}) == 2
    assert one.star.current().made_from == {"clean": one.clean.current().name}
    one.load(raw)
    assert [v.number for v in two.clean.history()] == [1, 2, 3]


def test_publishing_checks_for_the_number_itself(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "set"))
    assert tables.current() is None
    with pytest.raises(LookupError):
        tables.table("t")
    drafts = [tables.begin() for _ in range(8)]
    for draft in drafts:
        spark.range(1).write.parquet(draft.path("t"))

    def publish(draft):
        try:
            return tables.publish(draft).number
        except ConflictError:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(publish, drafts))
    assert [n for n in done if n is not None] == [1]
    assert tables.current().name == drafts[done.index(1)].name


def test_old_versions_expire(spark, raw, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    for _ in range(4):
        warehouse.load(raw)
    kept = [v.name for v in warehouse.clean.history()[-2:]]
    assert len(warehouse.expire(keep=2)) == 2
    assert [v.name for v in warehouse.clean.history()] == kept
    folders = {n for n in os.listdir(tmp_path / "wh" / "clean") if n.startswith("v-")}
    assert folders == set(kept) and warehouse.table("visitors").count() == 144
    with pytest.raises(ValueError):
        warehouse.expire(keep=0)


def test_checks_take_one_job_beside_the_writes(spark, raw, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        """Number of the last one; the store forgets old ones, so they are not counted there."""
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return store.executionsList().last().executionId()

    spark.range(1).collect()
    started = executions()
    warehouse.load(raw)
    loaded = executions()
    warehouse.build_star()
    built = executions()
    # two looks at every header, four writes, two checks, and the mapping measured for two joins
    assert loaded - started == 2 * 4 + 4 + 2 + 2
    # five writes and one check
    assert built - loaded == 5 + 1


def test_malformed_records(spark, raw, tmp_path):
    with open(raw.nights, "a", encoding="utf-8") as handle:
        handle.write("2024-01-01,RTO,Taupō RTO,Cabin, extra,Domestic guest nights,7,\n")
        handle.write("2024-01-01,RTO\n")
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    with pytest.raises(Exception, match="(?i)malformed"):
        warehouse.load(raw)
    warehouse.load(raw, on_violation="quarantine")
    records = [r._malformed for r in warehouse.table("quarantine/nights_records").collect()]
    assert sorted(records) == [
        "2024-01-01,RTO",
        "2024-01-01,RTO,Taupō RTO,Cabin, extra,Domestic guest nights,7,",
    ]
    assert warehouse.table("quarantine/spend_records").isEmpty()


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", ("a", "b"), [("x\ny", "1"), ("z", "2")])
    with pytest.raises(Exception, match="(?i)malformed"):
        read_text_csv(spark, path).collect()
    rows = read_text_csv(spark, path, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("x\ny", "1"), ("z", "2")]
    captured = read_text_csv(spark, path, on_malformed="capture").collect()
    assert [r._malformed for r in captured] == ['"x', None, None]


def test_long_codes_are_reported(spark, raw, tmp_path):
    with open(raw.mapping, "a", encoding="utf-8") as handle:
        handle.write("99999999999,Far,Far,Far,Far,1\n")
    with pytest.raises(LoadError, match="RTO_Code present"):
        Warehouse(spark, str(tmp_path / "wh")).load(raw)


def test_files_follow_the_size_not_the_splits(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 40).selectExpr("id AS RTO_Code", "2020 + id % 2 AS Year")
    rebuild_table(rows, str(tmp_path / "t"), partition_by=["Year"], sort_by=["RTO_Code"])
    for year in (2020, 2021):
        files = [f for f in os.listdir(tmp_path / "t" / f"Year={year}") if f.endswith(".parquet")]
        assert len(files) == 1


def test_bad_load_leaves_tables_alone(spark, raw, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(raw)
    with open(raw.visitors, "a", encoding="utf-8") as handle:
        handle.write("RTO55,Nowhere RTO,Domestic visitor,1/01/2024,5,RTO\n")
    with pytest.raises(LoadError, match="without a parent"):
        warehouse.load(raw)
    assert warehouse.table("visitors").where("RTO_Code = 55").isEmpty()
    with open(raw.visitors, "a", encoding="utf-8") as handle:
        handle.write("RTO07,Harbour RTO,Domestic visitor,unknown,-5,RTO\n")
    with pytest.raises(LoadError, match="Month present"):
        warehouse.load(raw)


def test_duplicate_grain_fails(spark, raw, tmp_path):
    with open(raw.spend, "a", encoding="utf-8") as handle:
        handle.write("2/01/2024,Lake Taupo,Food,New Zealand,Anywhere,0,1\n")
    with pytest.raises(LoadError, match="duplicate"):
        Warehouse(spark, str(tmp_path / "wh")).load(raw)


def test_quarantine(spark, raw, tmp_path):
    with open(raw.nights, "a", encoding="utf-8") as handle:
        handle.write("2024-01-01,RTO,Taupō RTO,Cabin,Domestic guest nights,,x\n")
        handle.write("2024-01-01,RTO,Taupō RTO,Camp,Domestic guest nights,-3,\n")
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(raw, on_violation="quarantine")
    bad = warehouse.table("quarantine/nights").collect()
    assert {(r.Property, tuple(r.FailedRules)) for r in bad} == {
        ("Cabin", ("Total_stay_nights present",)),
        ("Camp", ("Total_stay_nights in range",)),
    }
    assert warehouse.table("nights").where("Property IN ('Cabin', 'Camp')").isEmpty()


def test_csv_is_read_as_text(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", ("a", "Area type"), [("007", 'say "hi", ō'), ("", "x")])
    rows = read_text_csv(spark, path).collect()
    assert [tuple(r) for r in rows] == [("007", 'say "hi", ō'), (None, "x")]
    assert read_text_csv(spark, path, empty_as_null=False).collect()[1].a == ""
    assert read_text_csv(spark, path, ["Area type"]).columns == ["Area type"]
    with pytest.raises(ValueError, match="missing|columns"):
        read_text_csv(spark, path, ["b"])


def test_csv_with_another_column_order_is_refused(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    write_csv(folder / "1.csv", ("a", "b"), [(1, 2)])
    write_csv(folder / "2.csv", ("b", "a"), [(2, 1)])
    with pytest.raises(Exception, match="(?i)header"):
        read_text_csv(spark, str(folder)).collect()


def test_refresh_needs_partitions(spark, tmp_path):
    with pytest.raises(ValueError):
        rebuild_table(spark.range(1).toDF("x"), str(tmp_path / "t"), refresh=True)
