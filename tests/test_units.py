"""Units are committed once, wherever a job dies."""

import pytest

from lectern.sources import sinks

SCHEMA = "book_id int, unit int, text string"
ROWS = [(b, u, f"{b}.{u}.{k}") for b in (1, 2) for u in (1, 2, 3) for k in range(4)]
BY = ("book_id", "unit")


def read(spark, path):
    return sorted(map(tuple, sinks.read_units(spark, path, BY).select("book_id", "unit", "text").collect()))


@pytest.mark.parametrize("dies_at", ["before the data", "between data and record", "after the record"])
def test_a_job_that_dies_can_run_again(spark, tmp_path, monkeypatch, dies_at):
    path, df = str(tmp_path / "units"), spark.createDataFrame(ROWS, SCHEMA)
    sinks.commit_units(df.where("book_id = 1 and unit < 3"), path, BY)
    rename, calls = sinks._rename, []

    def dying(session, source, target):
        calls.append(target)
        if dies_at == "before the data" or dies_at == "between data and record" and len(calls) == 2:
            raise KeyboardInterrupt
        rename(session, source, target)
        if dies_at == "after the record" and len(calls) == 2:
            raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "_rename", dying)
    with pytest.raises(KeyboardInterrupt):
        sinks.commit_units(df, path, BY)
    monkeypatch.setattr(sinks, "_rename", rename)
    assert len(read(spark, path)) == (24 if dies_at == "after the record" else 8)
    sinks.commit_units(df, path, BY)
    assert read(spark, path) == sorted(ROWS)
    sinks.commit_units(df, path, BY)  # nothing is left to do
    assert read(spark, path) == sorted(ROWS)
    sinks.commit_units(spark.createDataFrame([(2, 3, "new")], SCHEMA), path, BY, force=True)
    assert read(spark, path) == sorted([r for r in ROWS if r[:2] != (2, 3)] + [(2, 3, "new")])


def test_damage_is_found(spark, tmp_path):
    path, df = str(tmp_path / "units"), spark.createDataFrame(ROWS, SCHEMA)
    sinks.commit_units(df, path, BY)
    assert sinks.damaged_units(spark, path, BY, df.columns).count() == 0
    run = sinks.committed_units(spark, path, BY).first().run
    df.where("unit <> 2").union(df.where("unit = 2 and text not like '%.3'")).write.mode("overwrite").parquet(f"{path}/data/run={run}")
    assert sorted((r.book_id, r.unit, r.rows, r.found_rows) for r in sinks.damaged_units(spark, path, BY, df.columns).collect()) == [(1, 2, 4, 3), (2, 2, 4, 3)]
    with pytest.raises(FileNotFoundError):
        sinks.read_units(spark, str(tmp_path / "none"), BY)
