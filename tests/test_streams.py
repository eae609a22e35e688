import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ss11_matured_labels", "ss01_online_store"])
def test_streams_end_in_files(spark, name):
    """Results of streams are files, not rows in the driver's memory; the session's settings are as they were."""
    import __spark_entry__

    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    made = __spark_entry__.queries()[name](spark, DATA)
    assert made.inputFiles()
    assert spark.conf.get(key) == old and spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
    events = spark.read.parquet(f"{DATA}/events.parquet")
    want = events.filter("event_id % 11 <= 7") if name.startswith("ss11") else events
    assert sorted(r.id for r in made.select("id").collect()) == sorted(r.event_id for r in want.select("event_id").collect())
