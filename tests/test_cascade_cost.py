"""What training and scoring read and write, and that percentiles stay exact."""

import math
import random

from netloom.operators import learn, prepare as prep
from netloom.plans import live_queries


def test_later_percentile_passes_leave_other_values_in_spark(spark, monkeypatch):
    rng, seen = random.Random(3), spark.sparkContext.accumulator(0)
    values = [rng.uniform(-1e6, 1e6) for _ in range(4000)] + [0.0, -0.0, math.inf, -math.inf, math.nan, None]
    table = spark.createDataFrame([(v, abs(v) if v is not None else 1.0) for v in values], "x double, y double").repartition(3)
    plain = prep._radix_counts

    def counted(batches, level, prefixes):
        def watch():
            for batch in batches:
                seen.add(batch.num_rows if level else 0)
                yield batch
        return plain(watch(), level, prefixes)
    monkeypatch.setattr(prep, "_radix_counts", counted)
    got = {(r["column"], r["percent"]): r["bound"] for r in prep.exact_percentiles(table, ["x", "y"], (0.0, 37.3, 100.0)).collect()}
    order = sorted([v for v in values if v is not None and v == v]) + [math.nan]
    at = (len(order) - 1) * 37.3 / 100
    assert got["x", 37.3] == order[int(at)] + (order[int(at) + 1] - order[int(at)]) * (at - int(at))
    assert got["x", 0.0] == -math.inf and math.isnan(got["x", 100.0]) and got["y", 0.0] == 0.0
    assert seen.value < len(values)          # three passes over all rows before


def test_cascade_writes_only_what_it_returns(spark, tiny, monkeypatch):
    from netloom.plans.fixtures import table

    given = []
    plain = learn.cascade
    monkeypatch.setattr(learn, "cascade", lambda df, *a: given.append(df.columns) or plain(df, *a))
    out = live_queries.cascade_scoring(table(spark, tiny, "flows"))
    assert out.columns == ["flow_id", "h", "verdict", "attack_type", "confidence", "stage_reached"] and out.count() > 0
    assert given == [["flow_id", "h", *live_queries.MODEL_FEATURES]]
