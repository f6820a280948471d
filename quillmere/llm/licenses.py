"""License scans by sentence rules.

Known licence sentences, normalised, have identifiers. A text becomes the sequence of identifiers of the sentences
it holds; ordered rules over identifiers then name the licence, longest rule first. Sentences may be wrapped over
lines. Short notices come from templates over a list of licence names, so the table is built from a rule.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.session import prepare

#: Licence identifiers and the names they go by.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 license"],
    "MIT": ["MIT License", "MIT licence"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    **{f"CC-{k}-{v}": [f"Creative Commons {n} {v} International License", f"CC {k} {v}", f"CC-{k}-{v}"] for k, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("4.0", "3.0")},
}
#: How a notice names a licence.
TEMPLATES = [
    "licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "distributed under the {}", "distributed under the terms of the {}",
    "this work is licensed under {}", "this work is licensed under the {}", "this work is licensed under a {}", "this software is licensed under the {}",
    "this project is licensed under the {}", "this file is licensed under the {}", "available under the {}", "published under the {}", "provided under the {}",
    "license: {}", "licence: {}", "spdx-license-identifier: {}", "{}",
]
#: Sentences of licence texts and of their standard notices.
SENTENCES = {
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache.grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache.copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2.free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense.public": "This is free and unencumbered software released into the public domain.",
}
#: A licence, and the sentences that state it, in order.
RULES = [
    ("MIT", ("mit.grant", "mit.notice", "mit.as-is")),
    ("MIT", ("mit.grant", "mit.notice")),
    ("MIT", ("mit.grant",)),
    ("ISC", ("isc.grant",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("Apache-2.0", ("apache.grant", "apache.copy")),
    ("Apache-2.0", ("apache.grant",)),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.hope")),
    ("GPL-3.0-or-later", ("gpl.free",)),
    ("GPL-2.0-or-later", ("gpl2.free", "gpl.hope")),
    ("GPL-2.0-or-later", ("gpl2.free",)),
    ("MPL-2.0", ("mpl.terms",)),
    ("Unlicense", ("unlicense.public",)),
]

WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
SPLIT = re.compile(r"[^\n]+")
HARD = re.compile(r"[.;:!?][\"')\]]*(?=\s|$)")


def normalised(sentence: str) -> str:
    """Lower case, words only, numbers with their dots, list numbers such as 1. or (a) in front left out."""
    return " ".join(WORD.findall(re.sub(r"^\s*(?:[*#/;-]+\s*|\(?[0-9a-zA-Z][.)]\s+)*", "", sentence).lower()))


def tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Normalised sentence to identifier, and the rules, longest first."""
    known, rules = {}, list(RULES)
    for licence, names in NAMES.items():
        rules.append((licence, (f"notice.{licence}",)))
        for name in [*names, licence]:
            for t in TEMPLATES:
                if t != "{}" or "license" in name.lower() and name != licence:
                    known[normalised(t.format(name))] = f"notice.{licence}"
    for key, s in SENTENCES.items():
        known[normalised(s)] = key
    return known, sorted(dict.fromkeys(rules), key=lambda r: -len(r[1]))


KNOWN, ORDERED = tables()
KEYS = sorted(KNOWN)
#: Parts of words that most known sentences hold.
COMMON = ["license", "licence", "permission", "redistribution", "copyright", "warranty", "unencumbered"]


def trigger() -> re.Pattern:
    """A cheap test of a text in lower case that every known sentence passes, wherever its lines break: it looks at single words only."""
    left = [k for k in KEYS if not any(c in k for c in COMMON)]
    named = {normalised(name).split()[0] for licence, names in NAMES.items() for name in [*names, licence]}
    words = sorted({w for k in left for w in k.split() if w in named} - {"new"})
    found = re.compile("|".join(COMMON) + "|(?<![a-z0-9])(?:" + "|".join(map(re.escape, words)) + ")(?![a-z0-9])")
    if missed := [k for k in KEYS if not any(found.search(w) for w in k.split())]:
        raise ValueError(f"the screen loses known sentences: {missed}")
    return found


TRIGGER = trigger()


def pieces(text: str) -> list[tuple[int, int]]:
    """Stretches between line ends and sentence ends, in order."""
    out = []
    for line in SPLIT.finditer(text):
        at = line.start()
        for m in HARD.finditer(line.group()):
            end = line.start() + m.end()
            out.append((at, end))
            at = end
        if at < line.end():
            out.append((at, line.end()))
    return [(s, e) for s, e in out if text[s:e].strip()]


def sentences(text: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences; a sentence may join any number of pieces, the longest wins."""
    if not TRIGGER.search(text.lower()):
        return []
    parts, out, k, free = pieces(text), [], 0, 0
    while k < len(parts):
        best, words = None, ""
        for j in range(k, len(parts)):
            s, e = parts[j]
            more = " ".join(WORD.findall(text[s:e].lower())) if words else normalised(text[s:e])
            if not words and not more:  # a piece without words opens no sentence; the next that does takes it along
                break
            words = f"{words} {more}".strip()
            place = bisect_left(KEYS, words)
            if place == len(KEYS) or not KEYS[place].startswith(words):
                break
            if key := KNOWN.get(words):
                best = (key, e, j)
        if best:
            first = k
            while first > free and not normalised(text[slice(*parts[first - 1])]):
                first -= 1
            s, e = parts[first]
            out.append((best[0], s + len(text[s:e]) - len(text[s:e].lstrip()), best[1]))
            k = free = best[2] + 1
        else:
            k += 1
    return out


def match_rules(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(licence, start, end): at each place the longest rule whose identifiers come in order, others between them allowed only where unknown."""
    out, k = [], 0
    keys = tuple(x[0] for x in found)
    while k < len(keys):
        rule = next((r for r in ORDERED if keys[k : k + len(r[1])] == r[1]), None)
        if rule:
            out.append((rule[0], found[k][1], found[k + len(rule[1]) - 1][2]))
            k += len(rule[1])
        else:
            k += 1
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences (known ones), n_matches, licenses (distinct, sorted, comma-joined), spans.

    ``spans`` lists licence:start:end in code points, comma-joined. Null and empty texts have none. Repeated rows
    all come back. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, ms, names, spans = [], [], [], []
            for t in b.column(1).to_pylist():
                found = sentences(t or "")
                matched = match_rules(found)
                ns.append(len(found))
                ms.append(len(matched))
                names.append(",".join(sorted({x[0] for x in matched})))
                spans.append(",".join(f"{x}:{s}:{e}" for x, s, e in matched))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(ms, pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_sentences", "n_matches", "licenses", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_sentences long, n_matches long, licenses string, spans string")
