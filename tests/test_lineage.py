"""Folders that go when Python ends."""

from __future__ import annotations

from loomspark.functions import lineage


def test_folders_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "_MADE", {})
    for name in ("a", "b"):
        spark.range(3).write.parquet(lineage.remove_at_end(spark, str(tmp_path / name)))
    spark.range(1).write.parquet(str(tmp_path / "kept"))
    lineage.remove_made()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["kept"] and not lineage._MADE
