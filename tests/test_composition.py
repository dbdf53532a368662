"""Orders of channels: as many partitions as the input is large, and the same rows."""

from tidemark.operators import composition


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    schema = "channel_id bigint, stream_id bigint, ord bigint"
    for name, shift in (("ranked", 0), ("assigned", 1)):
        spark.createDataFrame([(k % 40, k // 40 + shift, k // 40) for k in range(400)], schema).write.parquet(str(tmp_path / name))
    ranked, assigned = (spark.read.parquet(str(tmp_path / n)) for n in ("ranked", "assigned"))
    eligible = ranked.select("stream_id")
    few = composition.composed(ranked, assigned, eligible=eligible, most=6)
    monkeypatch.setattr(composition, "PART_BYTES", 400)
    many = composition.composed(ranked, assigned, eligible=eligible, most=6)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 10 < many.rdd.getNumPartitions()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() > 0
    bare = composition.composed(spark.createDataFrame(ranked.collect(), schema), spark.createDataFrame(assigned.collect(), schema), eligible=eligible, most=6)
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, few.collect()))
