from reclink.plans import registry
from reclink.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    records = registry.view(spark, SF)
    records.where("src > 1").write.parquet(str(tmp_path / "in"))
    incremental.build_index(records, str(tmp_path / "index"))
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "in"))
    incremental.link_stream(stream, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    columns = ["q_id", "s1_id", "brank", "bscore"]
    found = spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, registry.kept(spark, SF).select(*columns).collect()))
