"""Tables in the shared folder."""

from pathlib import Path

import pytest

from turnsift.operators import durable


def test_scratch_tables_go_and_kept_ones_stay(spark):
    folder = Path(durable.ensure_checkpoint_dir(spark).removeprefix("file:"))
    with durable.scratch(spark):
        first = durable.written(spark.range(5), "gone")
        kept = durable.written(first.filter("id > 2"), "kept", keep=True)
    assert not list(folder.glob("gone-*"))
    assert sorted(r.id for r in kept.collect()) == [3, 4]
    outside = durable.written(spark.range(2), "outside")
    assert outside.count() == 2 and outside.dtypes == spark.range(2).dtypes


def test_scratch_tables_go_after_an_error(spark):
    folder = Path(durable.ensure_checkpoint_dir(spark).removeprefix("file:"))
    with pytest.raises(ZeroDivisionError):
        with durable.scratch(spark):
            durable.written(spark.range(5), "broken")
            raise ZeroDivisionError
    assert not list(folder.glob("broken-*")) and not durable._scopes


def test_unset_folder_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(durable, "_named_folder", lambda spark: None)
    with pytest.raises(ValueError):
        durable.ensure_checkpoint_dir(spark)
