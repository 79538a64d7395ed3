import pytest

from quillon.plans.relation import PlanError
from quillon.session import Session
from quillon.streaming import bind_stream, start_memory, writer


def test_a_plan_over_a_stream_is_the_plan_over_the_table(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    batch = Session(spark).register_table("events", source)
    live = bind_stream(Session(spark), "events", stream)
    for i, (plan, mode) in enumerate([("(Project (Filter events (Greater value 50.0)) event_id value)", "append"), ("(GroupBy events (Max value) (CountAll) event_type)", "complete")]):
        q = start_memory(live, plan, f"streamed_{i}", mode)
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(f"streamed_{i}").collect())) == sorted(map(tuple, batch.dataframe(plan).collect()))


def test_no_stream(spark):
    with pytest.raises(PlanError, match="no stream"):
        bind_stream(Session(spark), "t", spark.range(1))
    with pytest.raises(PlanError, match="reads no stream"):
        writer(Session(spark), "(Table (a 1))")
