from collections import Counter

from slopeworks.llm import licenses
from slopeworks.llm.queries import op8_licenses


def brute(text):
    """Every line against every short notice by words alone; a line with too few of a notice's words cannot be near it."""
    found, at = [], 0
    notices = [(n, licenses.words_of(t), Counter(licenses.words_of(t))) for n, t in licenses.TEMPLATES.items()]
    for line in (text or "").split("\n"):
        mine = [w.lower() for w in licenses._WORDS.findall(line)]
        counts = Counter(mine)
        near = {n: licenses.wording_differences(t, mine)[0] for n, t, c in notices if (c - counts).total() <= licenses.DIFFERENT * len(t)}
        near = {n: d for n, d in near.items() if d <= licenses.DIFFERENT * len(licenses.words_of(licenses.TEMPLATES[n]))}
        if near:
            found.append((at, at + len(line), min(near.values()), {n for n, d in near.items() if d == min(near.values())}))
        at += len(line) + 1
    return found


def test_equals_brute_force(spark, sf10):
    want = {(r["doc_id"], a, b, d): names for r in spark.read.parquet(f"{sf10}/documents.parquet").collect() for a, b, d, names in brute(r["text"])}
    got = {(r["doc_id"], r["block_start"], r["block_end"], r["differences"]): r["license"] for r in op8_licenses(spark, sf10).collect()}
    assert set(got) == set(want) and len(got) > 20
    assert all(got[k] in want[k] for k in got)


def test_wording(spark):
    words = licenses.words_of
    assert licenses.wording_differences(words("released under the MIT License."), words("this is Released under the MIT  license!")) == (0, 2, 7)
    assert licenses.wording_differences(["a", "b"], []) == (2, 0, 0)
    scan = licenses.Scanner(licenses.TEMPLATES)
    assert scan.judge("Licensed under CC BY-NC 4.0.")[0][0] == "CC-BY-NC-4.0"
    assert scan.judge("Licensed under CC BY 4.0.")[0][0] == "CC-BY-4.0"
    assert scan.judge("This work is licensed under the GNU General Public License, version 2.")[0][0] == "GPL-2.0-only"
    assert scan.judge("a driving licence is needed to enter") == []


def test_odd_rows(spark, weird, no_docs):
    more = spark.createDataFrame([(20, "x\nReleased under the MIT License.\n" * 2), (None, "All rights reserved."), (21, "license " * 20000)], "doc_id long, text string")
    rows = licenses.scan_licenses(more).collect()
    assert sorted((r["doc_id"] or -1, r["block_start"], r["license"]) for r in rows) == [(-1, 0, "all-rights-reserved"), (20, 2, "MIT"), (20, 36, "MIT")]
    assert licenses.scan_licenses(weird).count() == 0 and licenses.scan_licenses(no_docs).count() == 0
