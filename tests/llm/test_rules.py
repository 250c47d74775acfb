import math
import re

import pytest
from pyspark.sql import functions as F

from slopeworks.llm import rules
from slopeworks.llm.queries import op5_rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for own in at.values() if len(own) > 1 for i in own for k in range(8)}
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


def test_base(spark, sf10):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf10}/documents.parquet").collect()}
    rows = op5_rules(spark, sf10).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.asDict() | plain(texts[r["doc_id"]]) == r.asDict()
        assert not (r["kept"] and r["base_failed"])


def test_native(spark, weird):
    plan = rules.with_statistics(weird)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("n", "alpha", "delta"), [(100, 0.05, 0.05), (1000, 0.01, 0.001), (5000, 0.0067, 0.004), (20, 0.01, 0.05), (0, 0.01, 0.05)])
def test_bound_is_exact(spark, n, alpha, delta):
    total, most = 0.0, -1
    for k in range(n + 1):
        total += math.comb(n, k) * alpha**k * (1 - alpha) ** (n - k)
        if total > delta:
            break
        most = k
    if n == 0:
        most = -1
    assert spark.range(1).select(rules._allowed(F.lit(n).cast("long"), alpha, F.lit(delta)).alias("k")).first()["k"] == most


def test_false_rejections_stay_below_the_risk(spark):
    """Good texts of 40 words, a few with symbols; bad ones are full of them."""
    def text(k):
        bad = k % 4 == 0
        mark = "###" if bad else "#" if k % 331 == 1 else ""
        return " ".join(f"w{k}x{i}{mark}" for i in range(40))

    rows = [(k, text(k), "en" if k % 3 else None, int(k % 4 != 0)) for k in range(9000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_rules(docs, labels).collect()}
    assert not any(kept[k] for k in range(0, 9000, 4))
    good = [k for k in range(9000) if k % 4]
    assert sum(not kept[k] for k in good) <= rules.ALPHA * len(good)
    # Too few labels certify nothing: all that pass the base stay.
    assert all(r["kept"] for r in rules.apply_rules(docs, labels.limit(20)).collect())


def test_odd_rows(weird, weird_labels, no_docs):
    rows = rules.apply_rules(weird, weird_labels).collect()
    assert len(rows) == 12
    for r in rows:
        assert r.asDict() | plain(r["text"]) == r.asDict()
    assert rules.apply_rules(no_docs, weird_labels).count() == 0
    assert rules.apply_rules(weird, weird_labels.where("false")).count() == 12
