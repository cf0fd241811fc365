"""License files as they are written, with wrapped lines, and deep directories."""

from viewframe.llm import license_scan

MIT = """MIT License

Copyright (c) 2020 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
WRAPPED = "# This program is free\n# software: you can redistribute it under the\n# terms of the GNU General Public\n# License version 3.\n\n" + "code " * 40


def test_wrapped_licenses_and_deep_paths(spark):
    deep = "m/" + "/".join(f"d{k}" for k in range(50))
    rows = [("m/LICENSE", MIT), (deep + "/x.py", "code"), ("g/x.py", WRAPPED), ("g/y.py", "code"), (deep[2:] + "/LICENSE.txt", MIT), (deep[2:] + "/e/f.py", "code")]
    found = {r.path: (r.license, r.inherited_from) for r in license_scan.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {
        "m/LICENSE": ("MIT", None), deep + "/x.py": ("MIT", "m"), "g/x.py": ("GPL-3.0", None), "g/y.py": (None, None),
        deep[2:] + "/LICENSE.txt": ("MIT", None), deep[2:] + "/e/f.py": ("MIT", deep[2:]),
    }
