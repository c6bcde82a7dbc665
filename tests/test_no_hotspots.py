"""Feature enrichment where no window is a hotspot, against SQL."""

import duckdb
import pytest
from test_oracle import SF, rows_of

from orbispan.plans import catalog


@pytest.mark.parametrize("name", ["feature_enrichment", "feature_enrichment_p"])
def test_no_hotspots(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/orders.parquet").limit(40).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.SQL[name]).fetchdf()
    assert (want["n1"] == 0).all() and len(want) > 1
    assert rows_of(got) == rows_of(want)
