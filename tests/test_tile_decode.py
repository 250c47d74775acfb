"""Tiles of odd values: hundredths, no number, infinities, nulls and values beyond a whole float."""

import math

import oracle
import pyarrow as pa
import pyarrow.parquet as pq

from slopeworks import registry


def test_odd_values_equal_sql(spark, tmp_path):
    rows = [[k / 100 for k in range(300)], [1.5, math.nan, math.inf, -math.inf, None, -0.295, 0.0, 3e18, 1e30], [167772.15, 167772.16, 200000.7, 1e6, 3.3e7, 1e9], None, []]
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    # No number is unequal to itself, so rows are told as texts.
    told = lambda rows: sorted((k, None if v is None else [None if x is None else f"{x:.12g}" for x in v]) for k, v in rows)
    got = told((x.tile_id, x.elev) for x in registry.tile_decode(spark, str(tmp_path)).collect())
    want = told(oracle.connect(str(tmp_path)).execute(registry.oracle_sql()["tile_decode"]).fetchall())
    assert got == want
