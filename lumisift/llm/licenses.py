r"""License scans by sentence rules: normalised sentences -> identifiers of known licence sentences -> ordered rules.

Native: DataFrame functions only; narrow (no shuffle). A text is cut into sentences twice: at line ends and after
`. ! ? ; :` before blanks, and at empty lines and after those signs with other lines folded, for sentences that wrap. A sentence is lower-cased,
and every run of other than a-z and 0-9 becomes one blank. Known sentences become identifiers, others vanish. Rules
are tried in order; each takes its identifiers out of the sequence, so a long licence is not also reported as its parts.

Defined cases: a null or empty text has no sentence and no licence; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier -> sentences that say it, as published in the licence texts.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache2-under": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "This work is licensed under the Apache License, Version 2.0.",
    ),
    "apache2-comply": ("you may not use this file except in compliance with the License.",),
    "apache2-copy": ("You may obtain a copy of the License at",),
    "apache2-asis": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "apache2-see": ("See the License for the specific language governing permissions and limitations under the License.",),
    "mit-under": ("Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License."),
    "mit-title": ("The MIT License", "MIT License"),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-asis": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "gpl3-under": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ),
    "gpl-nowarranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "ccbync4-under": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "ccby4-under": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc0-under": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0."),
    "bsd-redist": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "bsd-under": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."),
    "mpl2-subject": ("This Source Code Form is subject to the terms of the Mozilla Public License, v.",),
    "mpl2-copy": tuple(f"If a copy of the MPL was not distributed with this file, You can obtain one at {at}mozilla.org/MPL/2.0/." for at in ("http://", "https://", "https://www.")),
    "isc-grant": tuple(
        f"Permission to use, copy, modify, {and_} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        for and_ in ("and", "and/or")
    ),
    "isc-asis": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "reserved": ("All rights reserved.",),
}

#: Families of the GNU licences, their names in notices, and versions.
GNU = (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
#: Other licences that a sentence says by name.
NAMED = {
    "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"),
    "ISC": ("the ISC License",),
    "Unlicense": ("the Unlicense",),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
#: The tag of a short identifier, and identifiers that it may give besides the licences named here.
TAG = "SPDX-License-Identifier"
TAGGED = ("0BSD", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only")

# A notice is known in the pieces that a text is cut into; a piece that ends before the version says no licence by itself.
_RULES: list[tuple[str, tuple[str, ...]]] = []
for _family, _name, _versions in GNU:
    _terms, _low = f"you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation", _family.lower()
    SENTENCES[f"{_low}-terms"] = (f"{_terms};",)
    for _version in reversed(_versions):
        _licence = f"{_family}-{_version if '.' in _version else _version + '.0'}"
        for _suffix, _kind, _clause in (("-or-later", "later", "either version {} of the License, or (at your option) any later version."), ("", "only", "version {} of the License.")):
            SENTENCES[f"{_low}{_version}-{_kind}"] = (f"{_terms}, {_clause.format(_version)}",)
            SENTENCES[f"version{_version}-{_kind}"] = (_clause.format(_version),)
            _RULES += [(_licence + _suffix, (f"{_low}{_version}-{_kind}",)), (_licence + _suffix, (f"{_low}-terms", f"version{_version}-{_kind}"))]
for _licence, _names in NAMED.items():
    SENTENCES[f"{_licence.lower()}-named"] = tuple(f"{_how} under {_x}." for _x in _names for _how in ("Licensed", "This work is licensed"))
    _RULES.append((_licence, (f"{_licence.lower()}-named",)))

#: Ordered rules: licence, the identifiers that say it in this order.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-under", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-under", "apache2-comply")),
    ("Apache-2.0", ("apache2-under",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-under",)),
    *_RULES,
    ("GPL-3.0", ("gpl3-under",)),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-under",)),
    ("CC-BY-NC-4.0", ("ccbync4-under",)),
    ("CC-BY-4.0", ("ccby4-under",)),
    ("CC0-1.0", ("cc0-under",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("MPL-2.0", ("mpl2-copy",)),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense",)),
    ("All-Rights-Reserved", ("reserved",)),
)
for _licence in sorted({x for x, _ in RULES} - {"All-Rights-Reserved"} | set(TAGGED)):
    SENTENCES[f"spdx-{_licence.lower()}"] = (f"{TAG} {_licence}",)
    RULES += ((_licence, (f"spdx-{_licence.lower()}",)),)

#: Each known sentence has one of these within a word once lower-cased, so a text that has none has no known sentence, whatever its lines and
#: blanks: only words are looked at, and no word is joined or cut by normalising. The tests go through all sentences.
HINTS = ("licen", "permission", "copyright", "warrant", "distribut", "reserved", "unencumber")


def normalised_text(text: str) -> str:
    """The plain form of a known sentence; `_identifiers` does the same over columns."""
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split())


def known(sentences: dict[str, tuple[str, ...]] = SENTENCES) -> dict[str, str]:
    return {normalised_text(s): name for name, all_of in sentences.items() for s in all_of}


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _identifiers(text: Column, by_line: bool) -> Column:
    """Known sentences of a text in order, by identifier. A tag and what it gives are one sentence."""
    text = F.regexp_replace(text, f"(?i)({TAG}):[ \\t]*", "$1 ")
    if not by_line:
        text = F.translate(F.regexp_replace(text, "\n[ \t\r\n]*\n", "\u0001"), "\n\u0001", " \n")
    sentences = F.split(F.regexp_replace(text, "([.!?;:])[ \\t\\r\\n\\f]+", "$1\n"), "\n")
    names = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    found = F.filter(F.transform(sentences, normalised), lambda s: s.isin(*known()))
    return F.transform(found, lambda s: names[s])


def said(rule: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in rule)


def _matched(sequence: Column) -> Column:
    """The licences of a sequence, rule by rule; each takes what it matches out of the rest."""
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(said(rule)).alias("said")) for licence, rule in RULES])
    none = F.array().cast("array<string>")

    def step(a: Column, r: Column) -> Column:
        return F.struct(F.replace(a["rest"], r["said"], F.lit("|")).alias("rest"), F.when(F.contains(a["rest"], r["said"]), F.array_append(a["found"], r["licence"])).otherwise(a["found"]).alias("found"))

    start = F.struct(F.array_join(F.transform(sequence, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("rest"), none.alias("found"))
    return F.when(F.size(sequence) > 0, F.aggregate(rules, start, step)["found"]).otherwise(none)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, sentence_ids array<string> (in order; by line, else folded), licences array<string> (sorted)."""
    text = F.coalesce("text", F.lit(""))
    low, hinted, none = F.lower(text), F.lit(False), F.array().cast("array<string>")
    for hint in HINTS:
        hinted = hinted | F.contains(low, F.lit(hint))
    ids = docs.select("doc_id", *[F.when(hinted, _identifiers(text, by_line)).otherwise(none).alias(name) for name, by_line in (("lines", True), ("folded", False))])
    more = F.when(F.size("folded") > F.size("lines"), F.col("folded")).otherwise(F.col("lines"))
    both = ids.select("doc_id", more.alias("sentence_ids"), _matched(F.col("lines")).alias("a"), _matched(F.col("folded")).alias("b"))
    return both.select("doc_id", "sentence_ids", F.array_sort(F.array_union("a", "b")).alias("licences"))
