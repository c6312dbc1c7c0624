"""Cleaning rules on hand-made text."""

import datetime as dt

import pytest

from seasonstar.operators import clean
from seasonstar.sources.layouts import MappingLayout, NightsLayout, SpendLayout, VisitorLayout

M = dt.date


def text_frame(spark, layout, rows):
    schema = ", ".join(f"`{name}` string" for name in layout.columns)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def mapping(spark):
    raw = text_frame(
        spark,
        MappingLayout(),
        [
            ("7", " Harbour ", "Harbour", "Visit Harbour", "Visit Harbour"),
            ("12", "Taupō", "Taupo", "Lake Taupō", "Lake Taupo"),
            ("30", "Hills", "Hills", "null", " null "),
            ("31", "Dales", "Dales", "null", "null"),
        ],
    )
    return clean.clean_mapping(raw)


def test_mapping(mapping):
    rows = {row.RTO_Code: tuple(row)[1:] for row in mapping.collect()}
    assert rows[7] == ("Harbour", "Harbour", "Visit Harbour", "Visit Harbour")
    assert rows[30] == ("Hills", "Hills", None, None)
    assert mapping.schema["RTO_Code"].dataType.simpleString() == "int"


def test_nights(spark, mapping):
    domestic = "Domestic guest nights"
    rows = [
        ("1/01/2024", "RTO", "Taupō RTO", "Motel", domestic, "10", None),
        ("2024-01-01", " RTO ", " Harbour rto ", " Motel ", f" {domestic} ", "12.0", ""),
        ("31/02/2024", "RTO", "Hills", "Motel", "International guest nights", "3", "p"),
        ("1/01/2024", "RTO", "Hills", "Motel", domestic, "99", " c "),  # suppressed
        ("1/01/2024", "RTO", "Hills", "Motel", domestic, "98", "C"),  # another flag
        ("1/01/2024", "RTO", "Hills", "Total", domestic, "97", None),
        ("1/01/2024", "RTO", "Total New Zealand", "Motel", domestic, "96", None),
        ("1/01/2024", "Region", "Hills", "Motel", domestic, "95", None),
        ("1/01/2024", "RTO", "Hills", "Motel", "Occupancy", "94", None),
        ("1/01/2024", "RTO", "Taupo RTO", "Motel", domestic, "93", None),  # no macron
        ("1/12/2023", "RTO", "Hills", "Motel", domestic, "92", None),  # before the window
        ("1/07/2026", "RTO", "Hills", "Motel", domestic, "91", None),  # after the window
        ("unknown", "RTO", "Hills", "Motel", domestic, "90", None),
        ("1/06/2026", "RTO", "Hills", "Motel", domestic, " ", "x"),  # blank value
    ]
    raw = text_frame(spark, NightsLayout(), rows)
    got = sorted(map(tuple, clean.clean_nights(raw, mapping).collect()), key=repr)
    assert got == sorted(
        [
            (12, M(2024, 1, 1), "Motel", "Domestic", 10),
            (7, M(2024, 1, 1), "Motel", "Domestic", 12),
            (30, M(2024, 2, 1), "Motel", "International", 3),
            (30, M(2024, 1, 1), "Motel", "Domestic", 98),
            (30, M(2026, 6, 1), "Motel", "Domestic", None),
        ],
        key=repr,
    )
    zero = clean.clean_nights(raw, mapping, blank="zero").where("Month = '2026-06-01'")
    assert [row.Total_stay_nights for row in zero.collect()] == [0]
    with pytest.raises(ValueError):
        clean.clean_nights(raw, mapping, blank="keep")


def test_spend(spark, mapping):
    rows = [
        ("1/01/2024", " Lake Taupo ", "Food", "New Zealand", "Auckland", "12.5", "1.25"),
        ("2024-02-10", "Visit Harbour", "Food", " International ", " Asia ", "", None),
        ("1/01/2024", "non-RTO - Kawerau", "Food", "New Zealand", "x", "1", "1"),  # excluded
        ("1/01/2024", "null", "Food", "New Zealand", "x", "1", "1"),  # unlabelled areas
        ("1/01/2024", None, "Food", "New Zealand", "x", "1", "1"),  # unknown to NOT IN
        ("1/01/2024", "Lake Taupō", "Food", "New Zealand", "x", "1", "1"),  # needs ASCII
        ("1/01/2024", "Lake Taupo", "Food", "Total", "x", "1", "1"),
        ("1/12/2023", "Lake Taupo", "Food", "New Zealand", "x", "1", "1"),
    ]
    raw = text_frame(spark, SpendLayout(), rows)
    got = sorted(map(tuple, clean.clean_spend(raw, mapping).collect()), key=repr)
    assert got == [
        (12, M(2024, 1, 1), "Food", "Domestic", "Auckland", 12.5, 1.25),
        (7, M(2024, 2, 1), "Food", "International", "Asia", 0.0, None),
    ]
    keys = clean.area_keys(mapping, clean.MAPPING.label_ascii)
    std = clean.standardise_spend(raw)
    lost = {row.AreaKey: row.Rows for row in clean.unmatched_keys(std, keys).collect()}
    assert lost == {"null": 1, "Lake Taupō": 1}
    window = (M(2024, 1, 1), M(2026, 6, 1))
    assert tuple(clean.reconcile_rows(std, keys, window).first()) == (8, 5, 3, 2)


def test_reconcile_empty_source(spark, mapping):
    raw = text_frame(spark, SpendLayout(), [])
    keys = clean.area_keys(mapping, clean.MAPPING.label_ascii)
    counts = clean.reconcile_rows(clean.standardise_spend(raw), keys)
    assert tuple(counts.first()) == (0, 0, 0, 0)


def test_visitors(spark):
    rows = [
        (" RTO07 ", "Harbour RTO", "Domestic visitor", "1/03/2024", "5", "RTO"),
        ("RTO12", "Taupō RTO RTO", " Total international visitor", "2020-03-09", "6", " RTO "),
        ("REG01", "North", "Domestic visitor", "1/03/2024", "7", "Region"),
        ("RTO12", "Taupō RTO", "Other", "1/03/2024", "8", "RTO"),
        ("RTO12", "Taupō RTO", "Domestic visitor", None, "9", "RTO"),
    ]
    raw = text_frame(spark, VisitorLayout(), rows)
    got = sorted(map(tuple, clean.clean_visitors(raw).collect()), key=repr)
    assert got == sorted(
        [
            (7, "Harbour", "Domestic", M(2024, 3, 1), 5),
            (12, "Taupō", "International", M(2020, 3, 1), 6),  # no window by default
            (12, "Taupō", "Domestic", None, 9),
        ],
        key=repr,
    )
    window = (M(2024, 1, 1), M(2026, 6, 1))
    assert clean.clean_visitors(raw, window=window).count() == 1


def test_nfd_names_are_reported(spark, mapping):
    """A decomposed macron is another byte string: the row drops out and is reported."""
    raw = text_frame(
        spark,
        NightsLayout(),
        [("1/01/2024", "RTO", "Taupō RTO", "Motel", "Domestic guest nights", "1", None)],
    )
    assert clean.clean_nights(raw, mapping).count() == 0
    keys = clean.area_keys(mapping, clean.MAPPING.name)
    assert clean.unmatched_keys(clean.standardise_nights(raw), keys).first().Rows == 1


def test_dropped_rows_name_the_first_reason(spark, mapping):
    rows = [
        ("1/01/2024", "Lake Taupo", "Food", "New Zealand", "x", "1", "1"),  # loaded
        ("1/01/2024", "non-RTO - Kawerau", "Food", "Total", "x", "1", "1"),  # fails both filters
        ("1/01/2024", None, "Food", "New Zealand", "x", "1", "1"),
        ("1/01/2024", "Lake Taupo", "Food", "Total", "x", "1", "1"),
        ("1/01/2024", "Lake Taupo", "Food", None, "x", "1", "1"),
        ("1/12/2023", "Atlantis", "Food", "New Zealand", "x", "1", "1"),  # unknown before early
        ("1/12/2023", "Lake Taupo", "Food", "New Zealand", "x", "1", "1"),
        ("soon", "Lake Taupo", "Food", "New Zealand", "x", "1", "1"),
        ("soon", "Lake Taupo", "Food", "New Zealand", "x", "1", "1"),  # a repeated row counts
    ]
    raw = text_frame(spark, SpendLayout(), rows)
    keys = clean.area_keys(mapping, clean.MAPPING.label_ascii)
    window = (M(2024, 1, 1), M(2026, 6, 1))
    std = clean.standardise_spend(raw, trace=True)
    dropped = clean.dropped_rows(std, keys, window)
    got = sorted(((r.Reason, tuple(r.Raw)) for r in dropped.collect()), key=repr)
    reasons = (
        *["area excluded"] * 2, *["visitor type"] * 2, "area unknown", *["outside the window"] * 3
    )
    assert got == sorted(zip(reasons, rows[1:], strict=True), key=repr)
    counts = {r.Reason: r.Rows for r in clean.drop_reasons(dropped).collect()}
    raw_rows, kept, matched, loaded = clean.reconcile_rows(std, keys, window).first()
    assert counts["area excluded"] + counts["visitor type"] == raw_rows - kept
    assert counts["area unknown"] == kept - matched
    assert counts["outside the window"] == matched - loaded
    assert clean.dropped_rows(std.limit(0), keys, window).isEmpty()
    # without a window a row without a month is loaded, as the cleaners do
    assert clean.dropped_rows(std, keys).where("Reason = 'outside the window'").isEmpty()


def test_near_keys(spark, mapping):
    def names(*texts):
        rows = [("2024-01-01", "RTO", f"{t} RTO", "Motel", "Domestic guest nights", "1", "") for t in texts]
        return clean.standardise_nights(text_frame(spark, NightsLayout(), rows))

    keys = clean.area_keys(mapping, clean.MAPPING.name)
    two = "Taupo\u0304"
    rows = names("Taup\u014d", two, two, "Taupo", "taup\u014d", "Taupo\u0301", "Atlantis", "")
    assert [tuple(r) for r in clean.near_keys(rows, keys).collect()] == [(two, "Taup\u014d", 12, 2)]
    # the other way round: the mapping in two characters
    keys = keys.replace({"Taup\u014d": two}, subset=["AreaKey"])
    assert [tuple(r) for r in clean.near_keys(rows, keys).collect()] == [("Taup\u014d", two, 12, 1)]
