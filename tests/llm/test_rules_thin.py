"""Strata too thin for a bound of their own share one."""

from slopeworks.llm import rules


def test_thin_strata_get_a_verdict(spark):
    def text(k):
        mark = "###" if k % 4 == 0 else "#" if k % 331 == 1 else ""
        return " ".join(f"w{k}x{i}{mark}" for i in range(40))

    lang = lambda k: "en" if k % 2 else ("fr", "de", None)[k // 4 % 3]
    rows = [(k, text(k), lang(k), int(k % 4 != 0)) for k in range(8000)]
    docs = spark.createDataFrame([*[r[:3] for r in rows], (-1, text(0), "it")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_rules(docs, labels).collect()}
    assert not any(kept[k] for k in range(0, 8000, 4))
    thin_good = [k for k in range(8000) if k % 4 == 2]
    assert sum(not kept[k] for k in thin_good) <= rules.ALPHA * len(thin_good)
    assert kept[-1]  # no labels of its own
    # The thin ones are too few even together.
    few = labels.where("doc_id % 2 = 1 or doc_id < 400")
    assert all(r["kept"] for r in rules.apply_rules(docs, few).where("lang is null or lang <> 'en'").collect())
