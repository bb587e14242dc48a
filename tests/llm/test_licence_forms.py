"""Licences told by SPDX lines, standard headers and licence files."""

import pytest

from lumenlake.llm import licences

GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""
MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """# Redistributions of source code must retain the above copyright
# notice, this list of conditions and the following disclaimer."""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//     http://www.apache.org/licenses/LICENSE-2.0"""
CASES = [
    ("# SPDX-License-Identifier: MIT\ncode", "MIT"), ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("// spdx-license-identifier: (MPL-2.0 OR MIT)", "MPL-2.0"), ("# SPDX-License-Identifier: ISC.", "ISC"), ("# SPDX-License-Identifier: NONE", None),
    (GPL, "GPL-3.0"), (GPL.replace("General", "Lesser General"), "LGPL-3.0"), (GPL.replace("version 3", "version 2"), "GPL-2.0"), (MIT, "MIT"), (APACHE, "Apache-2.0"),
    (BSD, "BSD-2-Clause"), (BSD + "\n# Neither the name of X nor the names of its contributors may be used to\n# endorse or promote products derived from this software", "BSD-3-Clause"),
    ("// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", "BSD-3-Clause"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "GPL-2.0"), ("Creative Commons Attribution 4.0 International", "CC-BY-4.0"), ("Creative Commons Attribution-ShareAlike 4.0 International", "CC-BY-SA-4.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("a story about a licence", None), (None, None),
]


@pytest.fixture(scope="module")
def own(spark):
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, (t, _) in enumerate(CASES)], "doc_id long, path string, text string")
    return {r.doc_id: r.licence for r in licences.licences(files, named=False).collect()}


def test_exact_forms(own):
    assert [own[i] for i in range(len(CASES))] == [name for _, name in CASES]


def test_inherits_from_any_depth(spark):
    deep = "/".join(f"d{i}" for i in range(60))
    rows = [(1, "LICENSE", "Released under the MIT License"), (2, f"{deep}/x.py", "code"), (3, f"d0/{'e/' * 50}y.py", None)]
    out = licences.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert {r.doc_id: (r.licence, r.origin) for r in out} == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("MIT", "inherited")}
