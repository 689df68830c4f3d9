"""Queries of the registry whose memory or time grew faster than it had to."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tarn import queries
from tarn.queries import ORACLES, QUERIES, source

SMALL = "/root/testdata/sf0.001"


def test_approximate_count_keeps_no_sketch_for_a_pair(spark):
    df = QUERIES["agg_approx"](spark, SMALL)
    keyed = [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate(keys=" in x and "l_partkey" in x.partition("functions=")[0]]
    assert keyed and not any("approx_count_distinct" in x for x in keyed)
    n, m = F.approx_count_distinct("l_partkey"), F.count_distinct("l_partkey")
    plain = source(spark, SMALL, "lineitem").groupBy("l_returnflag").agg((F.abs(n - m) <= 0.5 * m).alias("near"))
    assert sorted(df.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("name", ["stream_session", "stream_tumbling", "stream_sliding"])
def test_stream_comes_in_bounded_batches_in_time_order(spark, monkeypatch, name):
    """Batches of a bounded size, after which no closed window stays in the state, give what SQL gives over all events at once."""
    monkeypatch.setattr(queries, "BATCH_EVENTS", 300)
    sizes, lasts, states, order, start = [], [], [], queries.in_time_order, queries.append_stream_of

    def watched(events, folder):
        for _ in order(events, folder):
            files = spark.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(folder)
            sizes.append(files.count() - sum(sizes))
            lasts.append(files.agg(F.max("ts").cast("long")).first()[0])
            yield

    def run(*args):
        q = start(*args)
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        return q

    monkeypatch.setattr(queries, "in_time_order", watched)
    monkeypatch.setattr(queries, "append_stream_of", run)
    found = QUERIES[name](spark, SMALL).select("event_type", "begin", "finish", "n").collect()
    assert len(sizes) == 4 and sum(sizes) == 1000 and max(sizes) < 450 and lasts == sorted(set(lasts))
    assert len(states) == 5 and max(states) < 30
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS FROM '{SMALL}/events.parquet'")
    assert sorted(map(tuple, found)) == sorted(c.sql(f"SELECT event_type, begin, finish, n FROM ({ORACLES[name]})").fetchall())
