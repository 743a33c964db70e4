from partwatch.llm import licences
from partwatch.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    name = "op9_license_scans"
    text, good = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert good, text
    assert QUERIES[name](spark, SF).where("n_licences > 0").count() > 0


def test_every_known_sentence_has_a_trigger():
    assert all(any(t in s for t in licences.TRIGGERS) for s in licences.KNOWN)


def test_rules(spark):
    s = licences.SENTENCES
    mit = "Copyright (c) 2024 Some One\n\n" + "\n".join(s[k] for k in licences.RULES[0][2]).replace(" of ", "\nof ")
    bsd = f"{s['BSD-GRANT']} {s['BSD-SOURCE']}\n2. {s['BSD-BINARY']}"
    texts = [
        (1, mit), (2, bsd), (3, f"{s['BSD-GRANT-SOURCE']} {s['BSD-BINARY']} {s['BSD-NAMES']}"), (4, "a line without a mark\nReleased under the MIT License.\nMore"), (5, None), (6, ""),
        (7, "We wrote: Licensed under CC BY-NC 4.0. " * 2 + "Licensed under CC BY-NC 4.0. End"), (8, "Not released under the MIT license terms."), (9, "x" * 2_000_000),
    ]
    rows = licences.scan_licences(spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, licences string"))
    got = {r.doc_id: r.matches for r in rows.collect()}
    assert got == {
        1: ["MIT/text"], 2: ["BSD-2-Clause/text"], 3: ["BSD-3-Clause/text"], 4: ["MIT/notice"], 5: [], 6: [], 7: ["CC-BY-NC-4.0/notice"], 8: [], 9: [],
    }
    assert licences.scan_licences(rows.where("false")).count() == 0


def test_published_layouts(spark):
    """Texts as they are published: wrapped, an empty line after each colon, as they are and in comments."""
    mit = """MIT License

Copyright (c) 2024 Some One

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
    bsd2 = """Copyright (c) 2024, Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
    bsd3 = bsd2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS\""""
    apache = """Copyright 2024 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    grant = mit[: mit.index("THE SOFTWARE IS")].replace("MIT License\n\n", "")
    expected = [
        (mit, ["MIT/text", "MIT/title"]), (grant, ["MIT/grant"]), (bsd2, ["BSD-2-Clause/text"]), (bsd3, ["BSD-3-Clause/text"]),
        (bsd3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), ["BSD-3-Clause/text"]), (apache, ["Apache-2.0/header"]),
        (apache.replace("at\n\n", "at\n"), ["Apache-2.0/header"]), (apache.replace("2.0\n\n", "2.0\n"), ["Apache-2.0/header"]),
    ]
    rows = []
    for text, _ in expected:
        for first, prefix, last in (("", "", ""), ("", "# ", ""), ("", "// ", ""), ("/*\n", " * ", "\n */")):
            commented = first + "\n".join((prefix + line).rstrip() for line in text.split("\n")) + last
            rows += [(len(rows), commented), (len(rows) + 1, commented.replace("\n", "\r\n"))]
    got = {r.doc_id: sorted(r.matches) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: expected[i // 8][1] for i, _ in rows}
