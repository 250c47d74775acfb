import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from slopeworks.llm import mixing
from slopeworks.llm.queries import op2_mix


def plain_targets(sizes):
    """Weights 5, 2, 1 over the sources in order; what is above three times a source's size is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 3 * sizes[s] for s in over})
        open_ -= over
    return target


def held(rows, texts):
    sizes = defaultdict(int)
    for (_, text, source), _r in zip(texts, texts, strict=True):
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(dict(sizes))
    source_of = {d: s for d, _, s in texts}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1


def test_targets_and_near_takes(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = op2_mix(spark, sf).collect()
    held(rows, texts)
    assert sorted(rows) == sorted(op2_mix(spark, sf).collect())


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.op2_sql()})").fetchall()
    assert sorted(want) == sorted(map(tuple, op2_mix(spark, sf).collect()))


def test_odd_rows(spark, weird, no_docs):
    docs = weird.select("doc_id", "source", "text", mixing.size_of(F.col("text")).alias("size"))
    rows = mixing.mix_sources(docs).withColumn("taken", F.col("copies") * F.col("size"))
    assert rows.count() == 12
    held(rows.collect(), [tuple(r) for r in weird.select("doc_id", "text", "source").collect()])
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_rows_alike_are_no_key(spark):
    """A third of all rows alike, and null ids with one text: no key of the joins and windows holds more than one of them."""
    rows = [(7, "one two three", "a", {"k": 1})] * 300 + [(None, "four five", "b", {"k": k}) for k in range(300)] + [(k, "six " * (k % 5), "c", None) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `m.x` map<string,int>")
    got = mixing.take_copies(docs)
    assert got.columns == docs.columns
    thin = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    want = {r["source"]: r["n"] for r in mixing.mix_sources(thin).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    found = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert found == {s: n for s, n in want.items() if n}
    copies = {tuple(sorted((r["m.x"] or {}).items())): r["n"] for r in got.where("source = 'b'").groupBy(F.to_json("`m.x`").alias("m")).agg(F.count("*").alias("n"), F.first("`m.x`").alias("m.x")).collect()}
    assert max(copies.values()) - min(copies.values()) <= 1
