"""The derived views keep the whole of their base tables."""

from slopeworks.sources.fixtures import view


def test_every_customer_is_a_request(spark, sf10):
    assert view(spark, sf10, "fx_requests").count() == spark.read.parquet(f"{sf10}/customer.parquet").count() > 20
