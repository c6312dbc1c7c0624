"""Refreshing the star by the cells that have changed, against full builds."""

import csv
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seasonstar.operators.changes import cell_digests, changed_cells
from seasonstar.plans.warehouse import LoadError, Warehouse
from seasonstar.sources.versions import VersionedTables
from test_warehouse import raw, withdraw  # noqa: F401

FACTS = ("fact", "spend_detail")


def contents(warehouse):
    names = (*FACTS, "months", "locations")
    return {
        name: Counter(
            tuple(sorted(row.asDict().items(), key=lambda kv: kv[0]))
            for row in warehouse.table(name).collect()
        )
        for name in names
    }


def revise(path, column, year, rng, times=3):
    """Change some counts of one year, repeat none, drop one row."""
    with open(path, encoding="utf-8", newline="") as handle:
        header, *rows = list(csv.reader(handle))
    at = [i for i, row in enumerate(rows) if any(str(year) in field for field in row)]
    for i in rng.sample(at, times):
        rows[i][column] = str(rng.randrange(1, 9000))
    del rows[rng.choice(at)]
    with open(path, "w", encoding="utf-8", newline="") as handle:
        csv.writer(handle).writerows([header, *rows])


def folders(warehouse, name):
    return warehouse.star.partitions(warehouse.star.current(), name)


def test_a_refresh_equals_a_full_build(spark, raw, tmp_path):  # noqa: F811
    rng = random.Random(11)
    warehouse, full = (Warehouse(spark, str(tmp_path / name)) for name in ("wh", "full"))

    def step():
        warehouse.load(raw)
        years = warehouse.refresh_star()
        full.load(raw)
        full.build_star()
        assert contents(warehouse) == contents(full)
        return years

    assert step() == [2024, 2025]
    first = warehouse.version()
    assert folders(warehouse, "fact") == {first: [2024, 2025]}

    for path, column in ((raw.visitors, 4), (raw.nights, 5), (raw.spend, 6)):
        revise(path, column, 2025, rng)
    assert step() == [2025]
    second = warehouse.version()
    for name in FACTS:
        assert folders(warehouse, name) == {first: [2024], second: [2025]}
        written = os.listdir(tmp_path / "wh" / "star" / second / name)
        assert [n for n in written if n.startswith("Year=")] == ["Year=2025"]

    # a folder that the kept version shares partitions with outlives its publication
    assert warehouse.expire(keep=1, unfinished_hours=0) and warehouse.table("fact").count() > 100
    assert [v.name for v in warehouse.star.history()] == [second]

    # a year goes: its partitions are in no folder any more, and the old first year stays shared
    withdraw(raw.spend, "/2025")
    withdraw(raw.visitors, "/2025")
    withdraw(raw.nights, "2025-")
    assert step() == [2025]
    assert folders(warehouse, "fact") == {first: [2024]}
    warehouse.expire(keep=1, unfinished_hours=0)
    assert second not in os.listdir(tmp_path / "wh" / "star")
    assert warehouse.table("fact").count() == 72


def test_nothing_changed_and_a_refresh_that_fails(spark, raw, tmp_path, monkeypatch):  # noqa: F811
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.load(raw)
    warehouse.build_star()  # keeps no digests
    assert warehouse.refresh_star() == [2024, 2025]
    before, shared = contents(warehouse), folders(warehouse, "fact")
    assert warehouse.refresh_star() == []
    assert contents(warehouse) == before and folders(warehouse, "fact") == shared
    # a year refreshed by name reads shared partitions as well
    warehouse.build_star(refresh_years=[2025])
    assert contents(warehouse) == before

    warehouse.refresh_star()
    version = warehouse.version()
    revise(raw.visitors, 4, 2024, random.Random(5))
    warehouse.load(raw)

    def killed(tables, draft):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(VersionedTables, "publish", killed)
        with pytest.raises(RuntimeError, match="killed"):
            warehouse.refresh_star()
    assert warehouse.version() == version and contents(warehouse) == before
    assert warehouse.refresh_star() == [2024]
    with pytest.raises(LoadError, match="nothing has been loaded"):
        Warehouse(spark, str(tmp_path / "none")).refresh_star()


def test_digests_follow_contents_and_not_order(spark):
    columns = "RTO_Code INT, Month STRING, a STRING, b STRING"
    rows = [(1, "m", "x", None), (1, "m", None, "x"), (1, "m", "x", None), (2, "m", "y", "z"), (3, "n", "", "")]

    def digests(rows, label="s"):
        return cell_digests({label: spark.createDataFrame(rows, columns)})

    def changed(one, two):
        return sorted(tuple(r) for r in changed_cells(one, two).collect())

    base = digests(rows)
    assert changed(base, digests(rows[::-1]).repartition(5)) == []
    assert changed(base, cell_digests({"s": spark.createDataFrame(rows, columns).select("b", "a", "Month", "RTO_Code")})) == []
    # a NULL that moves to another column, a row more of the same kind, a cell that goes or comes
    assert changed(base, digests([(1, "m", None, "x"), *rows[1:]])) == [(1, "m")]
    assert changed(base, digests([*rows, rows[0]])) == [(1, "m")]
    assert changed(base, digests(rows[:4])) == [(3, "n")]
    assert changed(base, digests([*rows, (4, "n", "", "")])) == [(4, "n")]
    # the empty text is not NULL, and a row of one source is not that of another
    assert changed(base, digests([*rows[:4], (3, "n", "", None)])) == [(3, "n")]
    assert changed(base, digests(rows, "t")) == [(1, "m"), (2, "m"), (3, "n")]
    assert digests([(None, "m", "x", "y"), (1, None, "x", "y")]).isEmpty()
    assert changed(base, base.where(F.lit(False))) == [(1, "m"), (2, "m"), (3, "n")]
