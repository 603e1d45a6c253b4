"""Components of a graph with an edge for every event, against brute force."""

from compare import SMALL

import __spark_entry__ as entry


def test_components_of_all_events(spark):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id").collect()
    for r in events:
        other = r.event_id - r.user_id % (r.event_id % 97 + 1)
        if other != r.event_id:
            low, high = sorted((root(r.event_id), root(other)))
            parent[high] = low
    got = {r.node: r.component for r in entry.queries()["connected_components_all"](spark, SMALL).collect()}
    assert got == {x: root(x) for x in parent} and 1 < len(set(got.values())) < len(got)
