import uuid

from weftgraph.operators.intervals import IncrementalRun
from weftgraph.streaming.follow import follow


def test_stream_is_processed_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), IncrementalRun(spark, str(tmp_path / "store"))
    rows = lambda *ids: spark.createDataFrame([("r", i) for i in ids], "repo_id string, scan_id bigint")
    name = f"follow-{uuid.uuid4().hex}"
    go = lambda n: follow(spark, source, rows(1).schema, store, lambda d: d, n).awaitTermination(120)
    rows(1, 2).write.parquet(source)
    assert go(name)
    rows(2, 7).write.mode("append").parquet(source)
    assert go(name)
    assert sorted(r.scan_id for r in store.output().collect()) == [1, 2, 7]
    # a lost checkpoint lists every file again
    assert go(name + "-again")
    assert sorted(r.scan_id for r in store.output().collect()) == [1, 2, 7]
