"""A session whose best all have a score of zero."""

import datetime as dt

from panelworks.operators import daybook


def test_sizes_where_all_scores_are_zero(spark):
    rows = [(dt.date(2024, 1, 1), f"s{k}", k, 0.0) for k in range(1, 6)]
    got = daybook.decisions(spark.createDataFrame(rows, "ts date, symbol string, rk long, meta_p double"), 0.5).orderBy("rk").collect()
    assert [(r.action, r.size_x, r.meta_rank) for r in got] == [("SKIP", None, k) if k <= 3 else ("-", None, k) for k in range(1, 6)]
