"""Planted notices: wrapped, altered, several at once, body texts."""

import pytest

from slopeworks.llm import licenses

FILL = "some other words that say nothing of it "


@pytest.mark.parametrize(("text", "names"), [
    ("Licensed under the Apache License,\nVersion 2.0.", ["Apache-2.0"]),
    ("# Licensed under the Apache\n#   License, Version 2.0.", ["Apache-2.0"]),
    ("Licensed under Apache License, Version 2.0", ["Apache-2.0"]),
    ("Released under MIT License", ["MIT"]),
    ("ALL RIGHTS RESERVED.", ["all-rights-reserved"]),
    ("All rights\nreserved.", ["all-rights-reserved"]),
    ("Available under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("This code is licensed under GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0-only"]),
    ("Licensed under the Apache License, Version 1.1.", []),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0. Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.", ["Apache-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "MIT"]),
    ("Released under the MIT License.\nReleased under the MIT License.", ["MIT", "MIT"]),
    ("The above copyright notice and this\npermission notice shall be included in\nall copies or substantial portions of the Software.", ["MIT"]),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", ["GPL-2.0-only"]),
    ("the license was granted by a public body in the general version 2", []),
])
@pytest.mark.parametrize("times", [0, 1, 40])
def test_planted(text, names, times):
    scan = licenses.Scanner(licenses.TEMPLATES)
    given = FILL * times + "\n" + text + "\n" + FILL * times
    found = scan.scan(given)
    assert sorted(x[2] for x in found) == names
    assert all(len(FILL * times) <= x[0] < x[1] <= len(FILL * times) + len(text) + 1 for x in found)


def test_each_template_is_itself():
    scan = licenses.Scanner(licenses.TEMPLATES)
    for name, text in [*licenses.TEMPLATES.items(), *[x[:2] for x in licenses.BODIES], ("MIT", "SPDX-License-Identifier: MIT"), ("BUSL-1.1", "// SPDX-License-Identifier: BUSL-1.1")]:
        assert [(x[2], x[4]) for x in scan.scan(text)] == [(name, 0)], text


def test_blocks_are_the_lines_of_a_span(spark):
    text = "one\nLicensed under the Apache License,\nVersion 2.0. Released under MIT License.\ntwo"
    rows = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(text[r.block_start : r.block_end], r.license, r.differences) for r in rows] == [
        (text[4:-4], "Apache-2.0", 0), ("Version 2.0. Released under MIT License.", "MIT", 1),
    ]


def test_a_short_notice_in_noise():
    text = "All rights reserved.\nThe eratened th, handha, reat re ates thtintsh eneaer ea."
    assert [x[2] for x in licenses.Scanner(licenses.TEMPLATES).scan(text)] == ["all-rights-reserved"]


def test_ranking_decides():
    """Two templates are confirmed on one stretch: the one that saves more has it, by whatever order they are given in."""
    whole = next(x[1] for x in licenses.BODIES if x[0] == "MIT" and x[1].startswith("Permission") and len(x[1]) > 900)
    scan = licenses.Scanner(licenses.TEMPLATES)
    words = tuple(licenses.words_of(whole))
    confirmed = scan.spans(words, tuple(range(len(scan.templates))))
    assert len({t for *_, t in confirmed}) == 3  # the grant, the notice, and the whole
    assert [(x[2], x[0], x[4]) for x in scan.scan(whole)] == [("MIT", 0, 0)] and scan.scan(whole)[0][1] > len(whole) - 3
    near = {"x": "one two three four five six seven eight nine ten", "y": "one two three four five six seven eight nine eleven"}
    for given in (near, dict(reversed(near.items()))):
        assert [x[2] for x in licenses.Scanner(given).scan("so one two three four five six seven eight nine eleven it is")] == ["y"]


def test_templates_of_ones_own_need_no_word_of_licensing():
    own = {"house": "Only members of the household may read these recipes aloud at dinner."}
    scan = licenses.Scanner(own)
    found = scan.scan(FILL * 30 + "\nonly members of this household may read these\nrecipes aloud at dinner\n" + FILL)
    assert [(x[2], x[4]) for x in found] == [("house", 1)]
    assert scan.scan("members of the household read recipes") == []


def test_a_long_run_of_one_word_and_texts_between():
    text = "license " * 3000 + licenses._MIT_GRANT + " license" * 3000 + " SPDX-License-Identifier: ISC"
    assert [x[2] for x in licenses.Scanner(licenses.TEMPLATES).scan(text)] == ["MIT", "ISC"]
