"""Heads of common licences, as people put them into files."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tamis.llm import licences

# Heads of public licences.
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED “AS IS”, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.
"""
BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without permission.\n"
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES."""
PROVIDED = ", provided that the above copyright notice and this permission notice appear in all copies"
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {} which is available at the foundation's site."


def gnu(name, stop, version, later):
    terms = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"""This program is free software{stop[0]} you can redistribute it and/or modify
it under the terms of the {name} as published by
the Free Software Foundation{stop[1]} {terms}.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{name} for more details.

You should have received a copy of the {name}
along with this program.  If not, see <https://www.gnu.org/licenses/>."""


GPL, LGPL, LIBRARY, AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Library General Public License", "GNU Affero General Public License"
HEADS = [
    ("Apache-2.0", APACHE), ("Apache-2.0", "\n".join(f" * {line}" for line in APACHE.split("\n"))), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", MIT), ("MIT", MIT.partition("\n\n")[2]), ("MIT", MIT.replace("permission notice", "permission notice (including the next paragraph)")),
    ("MIT", "This project is licensed under the terms of the MIT license."), ("MIT", "The MIT License"),
    ("BSD-2-Clause", BSD2 + BSD_END), ("BSD-3-Clause", BSD2 + BSD3 + BSD_END), ("BSD-3-Clause", BSD2 + BSD3),
    ("ISC", ISC.format(PROVIDED)), ("ISC", ISC.format(PROVIDED).replace("and/or", "and")), ("0BSD", ISC.format("")),
    ("GPL-2.0-or-later", gnu(GPL, ";;", "2", True)), ("GPL-3.0-or-later", gnu(GPL, ":,", "3", True)), ("GPL-2.0-only", gnu(GPL, ";;", "2", False)),
    ("GPL-3.0-only", gnu(GPL, ";;", "3", False)), ("LGPL-2.1-or-later", gnu(LGPL, ";;", "2.1", True)), ("LGPL-2.1-or-later", gnu(LGPL, ":,", "2.1", True)),
    ("LGPL-3.0-or-later", gnu(LGPL, ":,", "3", True)), ("LGPL-2.1-only", gnu(LGPL, ";;", "2.1", False)), ("LGPL-2.0-or-later", gnu(LIBRARY, ";;", "2", True)),
    ("LGPL-2.0-or-later", gnu(LIBRARY, ":,", "2", True)), ("GPL-2.0-or-later", gnu(GPL, ":,", "2", True)),
    ("AGPL-3.0-or-later", gnu(AGPL, ":,", "3", True)), ("AGPL-3.0-or-later", gnu(AGPL, ";;", "3", True)),
    ("GPL-2.0", "Released under the GNU General Public License, version 2."), ("GPL-3.0", "This work is licensed under the GNU General Public License v3.0."),
    ("LGPL-2.0", "Licensed under the GNU Library General Public License, version 2."), ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3."),
    ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
                " * file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")."),
    ("CDDL", "The contents of this file are subject to the terms of the Common Development and Distribution License."),
    ("EPL-2.0", EPL.format("2.0")), ("EPL-1.0", EPL.format("v1.0")), ("EPL-1.0", EPL.format("v. 1.0")),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain."),
    ("CC0-1.0", "This work is released under CC0 1.0 Universal."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("Artistic or GPL", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."), ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or later."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This article is licensed under CC BY-NC 4.0."), ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND", "Licensed under CC BY-NC-ND 3.0 Unported."), ("proprietary", "All rights reserved."),
    *[(tag, f"// SPDX-License-Identifier: {tag}") for tag in licences.TAGS],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, text) for k, (_, text) in enumerate(HEADS)], "doc_id long, text string")


def test_heads_are_known(docs):
    found = {r.doc_id: r for r in licences.scan(docs).collect()}
    wrong = [(name, found[k].licences, found[k].sentence_ids) for k, (name, _) in enumerate(HEADS) if found[k].licences != name or found[k].n_unmatched]
    assert wrong == []


def test_every_sentence_and_rule_can_be_reached(docs):
    seen = {i for r in licences.scan(docs).collect() for i in r.sentence_ids.split(",")}
    named = [name for name, _ in licences.SENTENCES]
    assert len(set(named)) == len(named)
    assert [name for name in named if name not in seen] == []
    assert {i for _, ids in licences.RULES for i in ids} <= set(named) and {name for name in named} == {i for _, ids in licences.RULES for i in ids}
    # a rule whose run a rule before it holds inside would never find it
    runs = ["".join(f"<{i}>" for i in ids) for _, ids in licences.RULES]
    assert [(a, b) for k, b in enumerate(runs) for a in runs[:k] if a in b] == []


def test_heads_agree_with_sql(docs, spark, tmp_path):
    docs.union(docs.select(F.col("doc_id") + 1000, F.concat(F.lit("Some prose comes first.\n\n"), "text", F.lit("\n\nAnd some after it. "), "text"))).write.parquet(f"{tmp_path}/d")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    scanned = licences.scan(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(map(tuple, scanned.collect())) == sorted(duck.execute(licences.sql()).fetchall())
    assert "Python" not in scanned._jdf.queryExecution().toString()
