"""Licence scan by sentence rules, with built-in expressions only.

Sentences are normalised and mapped to the ids of known licence sentences; the ids of a text,
in order, are matched against ordered rules, and a rule takes the ids it matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L = "licen[cs]e"
THIS = "(this (work|file|code|software|program|project|library|text|article) is )?"
MOVE = "you can redistribute it and or modify it under the terms of "
SAID = " as published by the free software foundation"
URL = "https?: (www\\.)?"
# Families of licences by one publisher, with their names and versions.
GNU = {"gpl": ("GPL", f"gnu general public {L}", ["2", "3"]), "lgpl": ("LGPL", f"gnu (lesser|library) general public {L}", ["2", "2.1", "3"]),
       "agpl": ("AGPL", f"gnu affero general public {L}", ["3"])}
CREATIVE = {"cc-by": "attribution", "cc-by-sa": "attribution-sharealike", "cc-by-nc": "attribution-noncommercial", "cc-by-nd": "attribution-noderiv(ative)?s",
            "cc-by-nc-sa": "attribution-noncommercial-sharealike", "cc-by-nc-nd": "attribution-noncommercial-noderiv(ative)?s"}
TAGS = ("MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD Zlib BSL-1.0 MPL-2.0 EPL-2.0 CC0-1.0 Unlicense GPL-2.0-only GPL-2.0-or-later GPL-3.0-only "
        "GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC-BY-4.0 CC-BY-SA-4.0").split()
# Id and normalised form (lower case, single spaces, no stops) of known licence sentences.
SENTENCES = [
    ("mit-title", f"(the )?mit {L}"),
    ("mit-short", f"{THIS}(released|licen[cs]ed|distributed) under the (terms of the )?mit {L}"),
    ("mit-grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files .*"),
    ("mit-notice", "the above copyright notice and this permission notice (\\(including the next paragraph\\) )?shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided \"?as is\"?, without warranty of any kind.*"),
    ("mit-liable", "in no event shall the authors or copyright holders be liable for any claim, damages or other liability.*"),
    ("apache-short", f"{THIS}(released|licen[cs]ed) under the apache {L},? version 2(\\.0)?"),
    ("apache-grant", f"licen[cs]ed under the apache {L}, version 2\\.0 \\(the \"?{L}\"?\\).*"),
    ("apache-use", f"you may not use this file except in compliance with the {L}"),
    ("apache-copy", f"you may obtain a copy of the {L} at( {URL}apache\\.org licenses license-2\\.0.*)?"),
    ("apache-url", f"{URL}apache\\.org licenses license-2\\.0"),
    ("apache-basis", f"unless required by applicable law or agreed to in writing, software distributed under the {L} is distributed on an \"?as is\"? basis.*"),
    ("apache-see", f"see the {L} for the specific language governing permissions and limitations under the {L}"),
    ("gpl-warranty", "this (program|library|software) is distributed in the hope that it will be useful, but without any warranty.*"),
    ("gpl-implied", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-grant", "redistribution and use in source and binary forms, with or without modification, are permitted.*"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-name", "neither the name of .* may be used to endorse or promote products derived from this software.*"),
    ("bsd-as-is", "this software is provided by .* \"?as is\"? and any express or implied warranties.*"),
    ("bsd-liable", "in no event shall .* be liable for any direct, indirect, incidental, special, exemplary, or consequential damages.*"),
    ("isc-grant", "permission to use, copy, modify,? and( or)? distribute this software for any purpose with or without fee is hereby granted, "
                  "provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "permission to use, copy, modify,? and( or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-as-is", "the software is provided \"?as is\"? and .* disclaims all warranties with regard to this software.*"),
    ("mpl-short", f"this source code form is subject to the terms of the mozilla public {L}, v 2\\.0"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file, you can obtain one at .*"),
    ("mpl1-short", f"the contents of this file are subject to the mozilla public {L} version 1\\.1.*"),
    ("cddl-short", f"the contents of this file are subject to the terms of the common development and distribution {L}.*"),
    ("epl1-short", f"(all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public {L} (v |v|version )?1\\.0.*"),
    ("epl2-short", f"(all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public {L} (v |v|version )?2\\.0.*"),
    ("boost-short", f"(use, modification and distribution (is|are) subject to|distributed under) the boost software {L}, version 1\\.0.*"),
    ("boost-see", "\\(?see accompanying file license_1_0.*"),
    ("boost-grant", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation.*"),
    ("unlicense-grant", "this is free and unencumbered software released into the public domain"),
    ("cc0-waiver", "to the extent possible under law, .* (has|have) (waived|dedicated) all copyright and related (or|and) neighboring rights.*"),
    ("cc0-short", f"{THIS}(released|licen[cs]ed|dedicated to the public domain) under (the )?(cc0|creative commons zero)( [0-9.]+)?( universal)?( {L})?"),
    ("zlib-as-is", "this software is provided [\"']?as-is[\"']?, without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.*"),
    ("perl-terms", "(this .* is free software, )?you (can|may) redistribute it and or modify it under the same terms as (the )?perl( 5)?.*"),
    ("ofl-short", f"this font software is licen[cs]ed under the sil open font {L}, version 1\\.1"),
    ("eupl-short", "licen[cs]ed under the eupl,? version 1\\.2.*"),
    ("reserved", "all rights reserved"),
    *[(f"{f}{v}-short", f"{THIS}(released|licen[cs]ed) under the (terms of the )?{name},? (version |v){re.escape(v)}(\\.0)?") for f, (_, name, versions) in GNU.items() for v in versions],
    *[(f"{f}{v}-later", f"(.* is free software(:|,) )?{MOVE}the {name}{SAID}, either version {re.escape(v)}(\\.0)? of the {L},? or \\(at your option\\) any later version")
      for f, (_, name, versions) in GNU.items() for v in versions],
    *[(f"{f}-grant", f"(.* is free software(:|,) )?{MOVE}the {name}{SAID}") for f, (_, name, _) in GNU.items()],
    *[(f"{f}-details", f"see the {name} for more details") for f, (_, name, _) in GNU.items()],
    *[(f"{f}-copy", f"you should have received a copy of the {name}.*") for f, (_, name, _) in GNU.items()],
    ("lgpl-short", f"{THIS}(released|licen[cs]ed) under the (terms of the )?{GNU['lgpl'][1]}"),
    ("gnu-url", "if not, (see|write to) .*(gnu\\.org|free software foundation).*"),
    *[(f"either-{v}", f"either version {re.escape(v)}(\\.0)? of the {L},? or \\(at your option\\) any later version") for v in ("2", "2.1", "3")],
    *[(f"only-{v}", f"version {re.escape(v)}(\\.0)? of the {L}") for v in ("2", "2.1", "3")],
    *[(cc, f"{THIS}licen[cs]ed under (a |the )?({cc.replace('cc-', 'cc[ -]')}|creative commons {name})( [0-9.]+)?( international| unported)?( {L})?") for cc, name in CREATIVE.items()],
    *[(f"spdx-{tag.lower()}", f"spdx-license-identifier: {re.escape(tag.lower())}") for tag in TAGS],
]


def _gnu_rules(family: str) -> list[tuple[str, list[str]]]:
    """The heads of one family: with a version or none, each with and without what stands behind the grant."""
    name, _, versions = GNU[family]
    grants = [(f"{name}-{v if '.' in v else v + '.0'}{kind}", ids) for v in versions for kind, ids in (
        ("-or-later", [f"{family}{v}-later"]), ("-or-later", [f"{family}-grant", f"either-{v}"]), ("-only", [f"{family}-grant", f"only-{v}"]))]
    grants.append((name, [f"{family}-grant"]))
    tails = [["gpl-warranty", "gpl-implied", f"{family}-details", f"{family}-copy", "gnu-url"], ["gpl-warranty", "gpl-implied", f"{family}-details", f"{family}-copy"],
             ["gpl-warranty", "gpl-implied", f"{family}-details"], ["gpl-warranty"], []]
    return [(licence, ids + tail) for licence, ids in grants for tail in tails]


# Licence and the ordered sentence ids that show it, the most specific rule of a licence first.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "mit-liable"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is", "bsd-liable"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-grant", "apache-use", "apache-copy", "apache-url", "apache-basis", "apache-see"]),
    ("Apache-2.0", ["apache-grant", "apache-use", "apache-copy", "apache-see"]),
    ("Apache-2.0", ["apache-grant", "apache-use"]),
    *[rule for family in GNU for rule in _gnu_rules(family)],
    ("ISC", ["isc-grant", "isc-as-is"]), ("ISC", ["isc-grant"]), ("0BSD", ["0bsd-grant", "isc-as-is"]), ("0BSD", ["0bsd-grant"]),
    ("MPL-2.0", ["mpl-short", "mpl-copy"]), ("Zlib", ["zlib-as-is", "zlib-grant"]), ("Zlib", ["zlib-grant"]),
    ("MIT", ["mit-grant"]), ("MIT", ["mit-short"]), ("MIT", ["mit-title"]),
    ("Apache-2.0", ["apache-grant"]), ("Apache-2.0", ["apache-short"]),
    *[(f"{GNU[f][0]}-{v if '.' in v else v + '.0'}", [f"{f}{v}-short"]) for f in GNU for v in GNU[f][2]], ("LGPL", ["lgpl-short"]),
    ("MPL-2.0", ["mpl-short"]), ("MPL-1.1", ["mpl1-short"]), ("CDDL", ["cddl-short"]), ("EPL-1.0", ["epl1-short"]), ("EPL-2.0", ["epl2-short"]),
    ("BSL-1.0", ["boost-short", "boost-see"]), ("BSL-1.0", ["boost-short"]), ("BSL-1.0", ["boost-grant"]), ("Unlicense", ["unlicense-grant"]), ("CC0-1.0", ["cc0-waiver"]), ("CC0-1.0", ["cc0-short"]),
    ("Artistic or GPL", ["perl-terms"]), ("OFL-1.1", ["ofl-short"]), ("EUPL-1.2", ["eupl-short"]),
    *[(cc.upper(), [cc]) for cc in CREATIVE], *[(tag, [f"spdx-{tag.lower()}"]) for tag in TAGS],
    ("proprietary", ["reserved"]),
]
HINT = ("licen[cs]e|permission|redistribut|warrant(y|ies)|rights reserved|copyright|creative commons|neither the name|public domain|copy of the mpl|same terms as|"
        "if not, (see|write to)|under (the )?(cc[ 0-]|eupl)|in no event shall")
QUOTES = ("\u201c\u201d\u2018\u2019", "\"\"")  # the last two signs are dropped
SHORT_V = "([ \\t-\\r(,])v\\.[ \\t-\\r]*([0-9])"  # "v. 2.0" is no end of a sentence
NEAR_MISS = "unknown"  # the id of a sentence that names a licence but is none of the known ones


def _sentences(text: Column) -> Column:
    """Normalised sentences that may speak of a licence; only texts with such a word are split."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + QUOTES[0], "abcdefghijklmnopqrstuvwxyz" + QUOTES[1])
    parts = F.split(F.regexp_replace(low, SHORT_V, "$1v $2"), "[.!?;][ \\t-\\r]+|\\n[ \\t-\\r]*\\n")
    clean = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(
        s, "[ \\t-\\r/*#]+", " "), "^[ .]+", ""), "[ .!?;]+$", ""))
    return F.when(low.rlike(HINT), F.filter(clean, lambda s: s.rlike(HINT))).otherwise(F.array().cast("array<string>"))


def _identify(sentence: Column) -> Column:
    """The id of a whole sentence, of the first form that it has."""
    (name, pattern), *others = SENTENCES
    found = F.when(sentence.rlike(f"^({pattern})$"), F.lit(name))
    for name, pattern in others:
        found = found.when(sentence.rlike(f"^({pattern})$"), F.lit(name))
    return found.otherwise(F.lit(NEAR_MISS))


def _take(state: Column, rule: Column) -> Column:
    return F.struct(
        F.when(state["left"].contains(rule["run"]) & ~F.array_contains(state["licences"], rule["licence"]), F.concat(state["licences"], F.array(rule["licence"])))
        .otherwise(state["licences"]).alias("licences"),
        F.replace(state["left"], rule["run"], F.lit("|")).alias("left"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licences, n_unmatched`` for every row.

    ``sentence_ids`` are the ids in text order and ``licences`` the sorted names, both
    comma-joined and empty where there is none; ``n_sentences`` counts sentences that speak of a
    licence, ``n_unmatched`` those that no rule took. NULL is an empty text, repeated rows are
    scanned alike, other columns are not read.
    """
    ids = F.transform(_sentences(F.coalesce(F.col("text").cast("string"), F.lit(""))), _identify)
    rows = docs.select("doc_id", ids.alias("ids"))
    start = F.struct(F.array().cast("array<string>").alias("licences"), F.array_join(F.transform("ids", lambda i: F.concat(
        F.lit("<"), i, F.lit(">"))), "").alias("left"))
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("".join(f"<{i}>" for i in run)).alias("run")) for licence, run in RULES])
    end = F.when(F.size("ids") > 0, F.aggregate(rules, start, _take)).otherwise(start)
    return rows.select("doc_id", "ids", end.alias("end")).select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_sort("end.licences"), ",").alias("licences"),
        (F.size(F.split("end.left", "<")) - 1).cast("long").alias("n_unmatched"))


def sql() -> str:
    """The scan in DuckDB."""
    alpha = f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ{QUOTES[0]}', 'abcdefghijklmnopqrstuvwxyz{QUOTES[1]}'"
    cases = " ".join("WHEN regexp_matches(s, '^({})$') THEN '{}'".format(p.replace("'", "''"), n) for n, p in SENTENCES)
    left, steps = "left0", []
    for k, (_, ids) in enumerate(RULES):
        run = "".join(f"<{i}>" for i in ids)
        steps.append(f"s{k + 1} AS (SELECT *, contains(left{k}, '{run}') AS hit{k}, replace(left{k}, '{run}', '|') AS left{k + 1} FROM s{k})")
        left = f"left{k + 1}"
    names = ", ".join(f"CASE WHEN hit{k} THEN '{licence}' END" for k, (licence, _) in enumerate(RULES))
    return f"""
    WITH low AS (SELECT doc_id, translate(coalesce(text, ''), {alpha}) AS t FROM documents),
    parts AS (SELECT doc_id, CASE WHEN regexp_matches(t, '{HINT}') THEN list_filter(list_transform(
        regexp_split_to_array(regexp_replace(t, '{SHORT_V}', '\\1v \\2', 'g'), '[.!?;][ \\t-\\r]+|\\n[ \\t-\\r]*\\n'), lambda s: regexp_replace(regexp_replace(regexp_replace(
        s, '[ \\t-\\r/*#]+', ' ', 'g'), '^[ .]+', ''), '[ .!?;]+$', '')), lambda s: regexp_matches(s, '{HINT}')) ELSE [] END AS parts FROM low),
    s0 AS (SELECT doc_id, ids, coalesce(list_aggregate(list_transform(ids, lambda i: '<' || i || '>'), 'string_agg', ''), '') AS left0 FROM (
        SELECT doc_id, list_transform(parts, lambda s: CASE {cases} ELSE '{NEAR_MISS}' END) AS ids FROM parts)),
    {", ".join(steps)}
    SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(list_aggregate(ids, 'string_agg', ','), '') AS sentence_ids,
        coalesce(list_aggregate(list_sort(list_distinct(list_filter([{names}], lambda n: n IS NOT NULL))), 'string_agg', ','), '') AS licences,
        (len({left}) - len(replace({left}, '<', '')))::BIGINT AS n_unmatched FROM s{len(RULES)}"""
