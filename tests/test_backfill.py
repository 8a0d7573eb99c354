import pytest

from jurispark.operators.backfill import YearCursor, walk, walk_years


def index_of(spark, versions):
    return spark.createDataFrame([(f"k{i}", i * 10, v, "x") for i, v in enumerate(versions)], "key string, position int, version string, title string")


def keys(done):
    return sorted(r["key"] for r in done.due.collect())


def test_runs_cover_every_changed_entry_once(spark):
    index = index_of(spark, ["1", "1", "2", None, "1", "2", "1"])
    known = spark.createDataFrame([("k0", "1"), ("k2", "1"), ("k3", "9"), ("k4", "1"), ("k4", "1"), ("gone", "1")], "key string, version string")
    first = walk(index, known, ["key"], 2)
    assert (keys(first), first.skipped, first.cursor) == (["k1", "k2"], 1, 30) and first.due.columns == index.columns
    second = walk(index, known, ["key"], 2, first.cursor)
    assert (keys(second), second.skipped, second.cursor) == (["k3", "k5"], 1, 60)
    third = walk(index, known, ["key"], 2, second.cursor)
    assert (keys(third), third.skipped, third.cursor) == (["k6"], 0, None)
    assert keys(walk(index, known, ["key"], 2, 999)) == keys(first)  # past the end: from the start
    assert keys(walk(index, known, ["key"], 2, first.cursor)) == keys(second)  # again, as after a restart
    every = walk(index, known, ["key"], 100)
    assert keys(every) == ["k1", "k2", "k3", "k5", "k6"] and every.cursor is None
    none = walk(index_of(spark, []), known, ["key"], 3, 5)
    assert (keys(none), none.skipped, none.cursor) == ([], 0, None)
    with pytest.raises(ValueError):
        walk(index, known, ["key"], 0)


def test_years_go_down_and_pages_up(spark):
    rows = [(2020, 1, 1), (2020, 1, 2), (2020, 2, 3), (2020, 4, 99), (2019, 2, 98), (2018, 1, 4), (2018, 2, 5), (1899, 1, 97)]
    items = spark.createDataFrame(rows, "year int, page int, id int")
    ids = lambda found: sorted(r["id"] for r in found.collect())
    found, cursor = walk_years(items, 2, YearCursor(2026))
    assert ids(found) == [1, 2, 3] and cursor == YearCursor(2020, 3)
    found, cursor = walk_years(items, 1, cursor)
    assert ids(found) == [4] and cursor == YearCursor(2018, 2)
    found, cursor = walk_years(items, 5, cursor)
    assert ids(found) == [5] and cursor == YearCursor(1899)
    found, cursor = walk_years(items, 5, cursor)
    assert ids(found) == [] and cursor == YearCursor(1899)
    with pytest.raises(ValueError):
        walk_years(items, 0, cursor)
