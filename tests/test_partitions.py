"""Work that costs more than its bytes say is spread by rows."""

from __future__ import annotations

from loomspark.plans import media_queries


def test_stages_of_media_are_spread_by_turns(spark, data, monkeypatch):
    monkeypatch.setattr(media_queries, "TURNS_A_TASK", 20, raising=False)
    turns = spark.read.parquet(f"{data}/conversations.parquet").count()
    rows = media_queries.prc_mm_sizes(spark, data)
    assert rows.rdd.getNumPartitions() == len(media_queries.PLUGINS) * (turns // 20 + 1) > 8
    counts = {r["plugin"]: r["count"] for r in rows.groupBy("plugin").count().collect()}
    assert set(counts) == set(media_queries.PLUGINS) and len(set(counts.values())) == 1
