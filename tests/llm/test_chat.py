from collections import defaultdict

import duckdb

from slopeworks.llm import chat


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(f"select conv_id, perspective, turn, speaker, segment, loss_mask, start, length from ({chat.op3_sql()})").fetchall()
    assert sorted(want) == sorted(map(tuple, chat.rotate(spark.read.parquet(f"{sf}/conversations.parquet")).collect()))


def test_native(spark, sf):
    plan = chat.rotate(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", None), (1, 3, None, "who?"), (1, 3, "ann", "tie"), (1, None, "bob", "first"),
        (None, 5, "ann", "no conversation"), (2, 0, "system", "alone"), (3, 7, "ann", "twice"), (3, 7, "ann", "twice"),
        *[(4, k, "ann" if k % 2 else "bob", "x" * (k % 7)) for k in range(3000)],
    ]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, start int, perspective string")
    found = defaultdict(list)
    for r in chat.rotate(df).collect():
        found[r["conv_id"], r["perspective"]].append(r)
    assert set(found) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "ann"), (4, "ann"), (4, "bob")}
    for (_, who), own in found.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] == len(r["segment"]) and r["loss_mask"] == (r["speaker"] == who)
            at += r["length"]
    whole = "".join(r["segment"] for r in sorted(found[1, "ann"], key=lambda r: r["start"]))
    assert whole == (
        "<|user name=bob|>\nfirst<|end|>\n<|system|>\nbe kind<|end|>\n<|assistant|>\nhello<|end|>\n<|user name=bob|>\n<|end|>\n"
        "<|assistant|>\ntie<|end|>\n<|user name=unknown|>\nwho?<|end|>\n"
    )
    assert len(found[4, "bob"]) == 3000
    assert chat.rotate(df.where("false")).count() == 0
