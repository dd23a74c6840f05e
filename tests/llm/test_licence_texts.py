"""Licence scan on real licence files and multi-line notices."""

from __future__ import annotations

from pathlib import Path

import pytest

from contraluz.llm import licence

COMMON = Path("/usr/share/common-licenses")
NAMES = {
    "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}
PROSE = "The river ran past the mill and the people of the town met there to talk of the price of the grain.\n"
GPL = """/* tool.c
 *
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU {0}General Public License as published by
 * the Free Software Foundation; either version {1} of the License, or
 * (at your option) any later version.
 */
int main(void) {{ return 0; }}
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
"""


def scanned(spark, rows):
    return {r["path"]: r for r in licence.scan(spark.createDataFrame(rows, "path string, text string")).collect()}


@pytest.mark.skipif(not COMMON.exists(), reason="no licence files here")
def test_real_licence_files(spark):
    rows = [(f"{file}/COPYING", "Copyright 2020 A. Uthor\n\n" + (COMMON / file).read_text()) for file in NAMES]
    rows += [(f"{file}/src/a.c", "int a;") for file in NAMES] + [("prose/LICENSE", PROSE * 40)]
    got = scanned(spark, rows + [(f"p/{i}", PROSE) for i in range(50)])
    assert {file: got[f"{file}/COPYING"]["licence"] for file in NAMES} == NAMES
    assert {file: got[f"{file}/src/a.c"]["licence"] for file in NAMES} == NAMES
    assert all(got[f"{file}/COPYING"]["origin"] == "licence file" for file in NAMES)
    assert got["prose/LICENSE"]["licence"] is None


def test_notices_over_several_lines(spark):
    rows = [("a", GPL.format("", 2)), ("b", GPL.format("", 3)), ("c", GPL.format("Lesser ", "2.1")), ("d", APACHE), ("e", PROSE)]
    got = scanned(spark, rows + [(f"p/{i}", PROSE) for i in range(50)])
    assert [got[p]["licence"] for p in "abcde"] == ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "Apache-2.0", None]
    assert got["a"]["origin"] == "statement" and got["a"]["own_score"] > 0.8
