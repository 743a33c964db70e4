"""Licence scans by sentence rules: known licence sentences become identifiers, and sequences of identifiers match rules.

Only DataFrame functions: one pass over the rows, nothing shuffled and no Python on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices. A sentence ends where a text's mark is, so what follows a colon belongs to it,
# and the number of a first list item ends it. An empty line after the colon ends it as well: the parts are sentences of their own.
SENTENCES = {
    "MIT-NOTICE": "Released under the MIT License.",
    "MIT-NOTICE-2": "Licensed under the MIT License.",
    "MIT-NOTICE-3": "This project is licensed under the terms of the MIT license.",
    "MIT-TITLE": "MIT License",
    "MIT-TITLE-2": "The MIT License (MIT)",
    "MIT-GRANT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT-GRANT-HEAD": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MIT-GRANT-KEEP": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT-WARRANTY": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "MIT-LIABILITY": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "APACHE-NOTICE": "Licensed under the Apache License, Version 2.0.",
    "APACHE-HEAD": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "APACHE-BASIS": (
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "APACHE-AT": "You may obtain a copy of the License at",
    "APACHE-URL": "http://www.apache.org/licenses/LICENSE-2.0",
    "APACHE-AT-URL": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "APACHE-UNLESS": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "APACHE-URL-UNLESS": (
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "APACHE-SEE": "See the License for the specific language governing permissions and limitations under the License.",
    "GPL3-NOTICE": "This work is licensed under the GNU General Public License, version 3.",
    "GPL2-NOTICE": "This work is licensed under the GNU General Public License, version 2.",
    "GPL3-LATER": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL2-LATER": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-HOPE": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "GPL-SEE": "See the GNU General Public License for more details.",
    "BSD-GRANT": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1."
    ),
    "BSD-GRANT-HEAD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "BSD-GRANT-SOURCE": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions "
        "and the following disclaimer."
    ),
    "BSD-SOURCE": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer."
    ),
    "BSD-BINARY": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-NAMES": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "ISC-GRANT": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-HEAD": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "UNLICENSE": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4": "Licensed under CC BY-ND 4.0.",
    "CC0-NOTICE": "Licensed under CC0 1.0.",
}

# Rules in order: the first that matches takes its sentences away from later ones.
RULES = (
    ("MIT", "text", ("MIT-GRANT", "MIT-WARRANTY", "MIT-LIABILITY")),
    ("MIT", "text", ("MIT-GRANT-HEAD", "MIT-GRANT-KEEP", "MIT-WARRANTY", "MIT-LIABILITY")),
    ("Apache-2.0", "header", ("APACHE-HEAD", "APACHE-BASIS", "APACHE-SEE")),
    ("Apache-2.0", "header", ("APACHE-HEAD", "APACHE-AT", "APACHE-URL", "APACHE-UNLESS", "APACHE-SEE")),
    ("Apache-2.0", "header", ("APACHE-HEAD", "APACHE-AT-URL", "APACHE-UNLESS", "APACHE-SEE")),
    ("Apache-2.0", "header", ("APACHE-HEAD", "APACHE-AT", "APACHE-URL-UNLESS", "APACHE-SEE")),
    ("GPL-3.0-or-later", "header", ("GPL3-LATER", "GPL-HOPE", "GPL-SEE")),
    ("GPL-2.0-or-later", "header", ("GPL2-LATER", "GPL-HOPE", "GPL-SEE")),
    ("BSD-3-Clause", "text", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES")),
    ("BSD-3-Clause", "text", ("BSD-GRANT-HEAD", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES")),
    ("BSD-3-Clause", "text", ("BSD-GRANT-SOURCE", "BSD-BINARY", "BSD-NAMES")),
    ("BSD-2-Clause", "text", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY")),
    ("BSD-2-Clause", "text", ("BSD-GRANT-HEAD", "BSD-SOURCE", "BSD-BINARY")),
    ("BSD-2-Clause", "text", ("BSD-GRANT-SOURCE", "BSD-BINARY")),
    ("MIT", "grant", ("MIT-GRANT",)),
    ("MIT", "grant", ("MIT-GRANT-HEAD", "MIT-GRANT-KEEP")),
    ("MIT", "notice", ("MIT-NOTICE",)),
    ("MIT", "notice", ("MIT-NOTICE-2",)),
    ("MIT", "notice", ("MIT-NOTICE-3",)),
    ("MIT", "title", ("MIT-TITLE",)),
    ("MIT", "title", ("MIT-TITLE-2",)),
    ("Apache-2.0", "notice", ("APACHE-NOTICE",)),
    ("Apache-2.0", "notice", ("APACHE-HEAD",)),
    ("GPL-3.0-only", "notice", ("GPL3-NOTICE",)),
    ("GPL-2.0-only", "notice", ("GPL2-NOTICE",)),
    ("GPL-3.0-or-later", "notice", ("GPL3-LATER",)),
    ("GPL-2.0-or-later", "notice", ("GPL2-LATER",)),
    ("ISC", "grant", ("ISC-GRANT",)),
    ("MPL-2.0", "notice", ("MPL-HEAD",)),
    ("Unlicense", "notice", ("UNLICENSE",)),
    ("CC-BY-4.0", "notice", ("CC-BY-4",)),
    ("CC-BY-SA-4.0", "notice", ("CC-BY-SA-4",)),
    ("CC-BY-NC-4.0", "notice", ("CC-BY-NC-4",)),
    ("CC-BY-ND-4.0", "notice", ("CC-BY-ND-4",)),
    ("CC0-1.0", "notice", ("CC0-NOTICE",)),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What is neither a letter, digit, sentence end nor line break becomes one space.
OTHER = r"[^a-z0-9.!?\n]+"
# A sentence ends at its marks before white space, and in line form also at every line break.
LINE_END = r"[.!?]* ?\n[ \n]*|[.!?]+ |[.!?]+$"
FLOW_END = r"[.!?]+ |[.!?]+$"
# In flow form an empty line ends a sentence and another line break is a space.
EMPTY_LINE, LINE_BREAK = r"\n *\n[\n ]*", r" *\n *"


def normal(sentence: str) -> str:
    """A catalogue sentence in the form in which texts are looked up."""
    return re.sub(r"[.!?]+$", "", re.sub(OTHER, " ", sentence.lower()).strip()).strip()


# Each known sentence holds one of these, so a text without any needs no further reading.
TRIGGERS = ("licen", "software", "redistribution", "warrant")


KNOWN = {normal(text): name for name, text in SENTENCES.items()}


def _identifiers(text: Column, end: str) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    sentences = F.filter(F.transform(F.split(text, end), lambda s: F.trim(s)), lambda s: s.isin(*KNOWN))
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.transform(sentences, lambda s: F.element_at(names, s))


def _matched(identifiers: Column) -> Column:
    """Each rule's ``licence/kind`` if it matches what earlier rules left, as an array in the order of the rules.

    A fold over the rules: as one nested expression per rule the plan would grow with their square.
    """
    rule = lambda licence, kind, names: F.struct(
        F.lit(" " + "  ".join(names) + " ").alias("pattern"), F.lit(f"{licence}/{kind}").alias("label")
    )
    start = F.struct(
        F.concat(F.lit(" "), F.array_join(identifiers, "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("found")
    )

    def apply(state: Column, r: Column) -> Column:
        hit = F.contains(state["left"], r["pattern"])
        return F.struct(
            F.replace(state["left"], r["pattern"], F.lit(" | ")).alias("left"),
            F.when(hit, F.concat(state["found"], F.array(r["label"]))).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(F.array(*[rule(*r) for r in RULES]), start, apply, lambda state: state["found"])


def scan_licences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the licence notices of each whole text.

    A text is normalised (A-Z lower-cased, everything but letters, digits, sentence marks and line breaks one space) and cut
    into sentences twice: at line breaks too, for notices on a line of their own, and across them, for wrapped licence texts.
    Added columns replace others of their names: ``sentence_ids`` and ``flow_ids``, the known sentences in order in either
    form; ``matches``, the ``licence/kind`` of each rule that matches in line form, then those only in flow form; ``licences``,
    the distinct licences, sorted. A null or empty text has none. Rows are independent of each other.
    """
    text = F.col(f"`{text_col}`").cast("string")
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), OTHER, " ")
    plain = F.when(text.rlike("(?i)" + "|".join(TRIGGERS)), plain).otherwise("")
    flow = F.regexp_replace(F.regexp_replace(plain, EMPTY_LINE, ". "), LINE_BREAK, " ")
    rows = docs.select("*", _identifiers(plain, LINE_END).alias("__lines"), _identifiers(flow, FLOW_END).alias("__flow"))
    rows = rows.withColumns({"__of_lines": _found("__lines"), "__of_flow": _found("__flow")})
    matches = F.array_union("__of_lines", "__of_flow")
    return rows.withColumns(
        {
            "sentence_ids": F.col("__lines"),
            "flow_ids": F.col("__flow"),
            "matches": matches,
            "licences": F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.substring_index(m, "/", 1)))),
        }
    ).drop("__lines", "__flow", "__of_lines", "__of_flow")


def _found(name: str) -> Column:
    nothing = F.array().cast("array<string>")
    return F.when(F.size(name) == 0, nothing).otherwise(_matched(F.col(name)))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The query's rows as one DuckDB statement."""
    known = ", ".join(map(_quoted, KNOWN))
    names = f"MAP {{{', '.join(f'{_quoted(k)}: {_quoted(v)}' for k, v in KNOWN.items())}}}"

    def identifiers(text: str, end: str) -> str:
        parts = f"list_transform(string_split_regex({text}, {_quoted(end)}), lambda s: trim(s))"
        return f"list_transform(list_filter({parts}, lambda s: s IN ({known})), lambda s: names[s])"

    def steps(source: str) -> str:
        """One CTE per rule would repeat the text; the state is a struct carried through a list fold instead."""
        return f"' ' || array_to_string({source}, '  ') || ' '"

    plain = f"regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9.!?\\n]+', ' ', 'g')"
    flow = f"regexp_replace(regexp_replace(t, '{EMPTY_LINE}', '. ', 'g'), '{LINE_BREAK}', ' ', 'g')"
    ctes = [f"plain AS (SELECT doc_id, {plain} AS t, {names} AS names FROM documents)"]
    ctes.append(
        "r0 AS (SELECT doc_id, lines, flow, CAST([] AS VARCHAR[]) AS fl, CAST([] AS VARCHAR[]) AS ff, "
        f"{steps('lines')} AS a, {steps('flow')} AS b FROM (SELECT doc_id, {identifiers('t', LINE_END)} AS lines, "
        f"{identifiers(flow, FLOW_END)} AS flow FROM plain))"
    )
    for k, (licence, kind, ids) in enumerate(RULES):
        pattern, label = _quoted(" " + "  ".join(ids) + " "), _quoted(f"{licence}/{kind}")
        ctes.append(
            f"r{k + 1} AS (SELECT doc_id, lines, flow, CASE WHEN contains(a, {pattern}) THEN list_append(fl, {label}) ELSE fl END AS fl, "
            f"CASE WHEN contains(b, {pattern}) THEN list_append(ff, {label}) ELSE ff END AS ff, "
            f"replace(a, {pattern}, ' | ') AS a, replace(b, {pattern}, ' | ') AS b FROM r{k})"
        )
    last = f"r{len(RULES)}"
    both = "list_concat(fl, list_filter(ff, lambda m: NOT list_contains(fl, m)))"
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, array_to_string(lines, ',') AS sentence_ids, "
        f"array_to_string({both}, ',') AS matches, "
        f"array_to_string(list_sort(list_distinct(list_transform({both}, lambda m: split_part(m, '/', 1)))), ',') AS licences, "
        f"CAST(len(list_distinct(list_transform({both}, lambda m: split_part(m, '/', 1)))) AS BIGINT) AS n_licences FROM {last}"
    )
