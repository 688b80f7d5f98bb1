"""How stored rows come in as a stream."""

from catalog import streams
from sparrowline.streaming.events import append_table


def test_triggers_do_not_grow_in_number_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    stream = streams.as_stream(spark, spark.range(1000), "rows")
    query = append_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1000
    assert query.lastProgress["batchId"] < 2 * streams.TRIGGERS
