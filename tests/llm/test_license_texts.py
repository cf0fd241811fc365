"""How long licenses begin, tags, and versions."""

from viewframe.llm import license_scan

LGPL21 = """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999

 Copyright (C) 1991, 1999 Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

[This is the first released version of the Lesser GPL.  It also counts
 as the successor of the GNU Library Public License, version 2, hence
 the version number 2.1.]

  The licenses for most software are designed to take away your
freedom to share and change it.  By contrast, the GNU General Public
Licenses are intended to guarantee your freedom.
"""
GPL3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble
"""
APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""


def test_titles_tags_and_versions(spark):
    rows = {
        "a/COPYING": LGPL21, "a/x.c": "int main;", "b/LICENSE": GPL3, "c/LICENSE": APACHE, "d/s.py": "# SPDX-License-Identifier: MIT\nprint()", "e/s.c": "/* SPDX-License-Identifier: GPL-2.0-or-later */",
        "f/s.c": "// SPDX-License-Identifier: Nobody-1.0", "g/LICENSE": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "h/LICENSE": "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM",
        "i/README": "Licensed under the GNU Lesser General Public License, version 2.1.", "j/README": "Licensed under the GNU Lesser General Public License, version 3.", "k/LICENSE": "Attribution-ShareAlike 4.0 International\n\nCreative Commons Public License",
        "l/n.txt": None, "m/n.txt": "",
    }
    found = {r.path: (r.license, r.inherited_from) for r in license_scan.scanned(spark.createDataFrame(list(rows.items()), "path string, text string")).collect()}
    expected = {
        "a/COPYING": "LGPL-2.1", "b/LICENSE": "GPL-3.0", "c/LICENSE": "Apache-2.0", "d/s.py": "MIT", "e/s.c": "GPL-2.0", "g/LICENSE": "MPL-2.0", "h/LICENSE": "EPL-2.0",
        "i/README": "LGPL-2.1", "j/README": "LGPL-3.0", "k/LICENSE": "CC-BY-SA-4.0", "f/s.c": None, "l/n.txt": None, "m/n.txt": None,
    }
    assert {p: found[p][0] for p in expected} == expected
    assert found["a/x.c"] == ("LGPL-2.1", "a")
