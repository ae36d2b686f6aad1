"""License scans by rules over known sentences.

A text is cut into parts, which are normalised (lower case, words of letters and
digits, single blanks). A known licence sentence is found where all its words
follow each other from the beginning of a part to the end of that or a later
one, so neither line width nor comment marks matter, and no word of it may be
missing. What is found, in order, is a sequence of sentence identifiers. A rule names the
identifiers that must occur in its order, others may lie between; the rules that
hold are the licences of the text. Sentences of a longer rule do not count for its
prefix (BSD-3-Clause is no BSD-2-Clause). Everything is array expressions over the row:
no row is moved.

Defined cases: a null or empty text has no sentences and no licence. A sentence
that occurs twice is in the sequence twice. Repeated rows and null ids are kept.
Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of licences and notices, as they are usually written.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-you": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-software": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-notice": "Released under the MIT License.",
    "mit-license": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-work-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-work-2": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Creative Commons notices follow from their elements and versions.
_ELEMENTS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
SENTENCES |= {f"cc-{e}-{v}".lower(): f"Licensed under CC {e} {v}." for e in _ELEMENTS for v in _VERSIONS}

# Identifiers that must occur in this order.
RULES = {
    "Apache-2.0": [["apache-notice"], ["apache-you", "apache-use"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "GPL-2.0": [["gpl-work-2"]],
    "GPL-2.0-or-later": [["gpl-2"]],
    "GPL-3.0": [["gpl-work-3"]],
    "GPL-3.0-or-later": [["gpl-3"]],
    "ISC": [["isc-grant"]],
    "MIT": [["mit-notice"], ["mit-license"], ["mit-grant", "mit-notice-kept"]],
    "MPL-2.0": [["mpl-form"]],
    **{f"CC-{e}-{v}": [[f"cc-{e}-{v}".lower()]] for e in _ELEMENTS for v in _VERSIONS},
}


def _gnu(work: str, mark: str, license: str, end: str) -> str:
    """A GNU notice; versions 2 and 3 differ in the marks around their parts."""
    return f"This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the {license} as published by the Free Software Foundation{end}"


_GPL, _LESSER, _LIBRARY, _AFFERO = (f"GNU {name}General Public License" for name in ("", "Lesser ", "Library ", "Affero "))
_LATER = "version {} of the License, or (at your option) any later version."
_ONLY = "version {} of the License."
_WORKS = ("program", "library", "file", "software")
# Fixed values: (identifier, sentence), of which an identifier may have several. ``<name>`` is one to twelve words.
# The SQL knows only ``SENTENCES`` and ``RULES``.
MORE_SENTENCES = [
    ("bsd-names", "Neither the name of <name> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-names", "The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    *[
        (f"{short}-{version}{kind}", _gnu(work, ":", name, f", {start}{text.format(version)}"))
        for work in _WORKS
        for short, name, versions in (("gpl", _GPL, ("2", "3")), ("lgpl", _LESSER, ("2.1", "3")), ("lgpl", _LIBRARY, ("2",)), ("agpl", _AFFERO, ("3",)))
        for version in versions
        for kind, start, text in (("", "either ", _LATER), ("-only", "", _ONLY))
    ],
    ("cc0-notice", "Licensed under CC0 1.0."),
    ("cc0-waived", "To the extent possible under law, <name> waived all copyright and related or neighboring rights to <name>."),
    ("cc0-dedicated", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    *[
        (name, f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {version} {text}")
        for name, version, text in (
            ("epl-2", "2.0", "which is available at https://www.eclipse.org/legal/epl-2.0/"), ("epl-2", "v. 2.0", "which is available at https://www.eclipse.org/legal/epl-2.0/"),
            ("epl-2", "2.0", "which is available at http://www.eclipse.org/legal/epl-2.0/"), ("epl-2", "v. 2.0", "which is available at http://www.eclipse.org/legal/epl-2.0/"),
            ("epl-2", "v2.0", "which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"),
            ("epl-1", "v1.0", "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
            ("epl-1", "v1.0", "which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v10.html"),
        )
    ],
    ("unlicense-released", "This is free and unencumbered software released into the public domain."),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
# Titles of licences, and statements that name them.
TITLES = {
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "Unlicense": ["Unlicense"],
}
STATEMENTS = (
    "Released under the {}.", "Licensed under the {}.", "Distributed under the {}.", "This file is released under the {}.", "This software is released under the {}.",
    "This project is released under the {}.", "This file is licensed under the {}.", "This software is licensed under the {}.", "This project is licensed under the {}.",
)
_SAID = [(name, statement.format(title)) for name, titles in TITLES.items() for title in titles for statement in STATEMENTS]
_SAID = [pair for pair in _SAID if pair[1] not in SENTENCES.values()]
SENTENCES |= {f"says-{name}-{k}": sentence for k, (name, sentence) in enumerate(_SAID)}
RULES = RULES | {name: [*RULES.get(name, []), *([f"says-{of}-{k}"] for k, (of, _) in enumerate(_SAID) if of == name)] for name in TITLES if name in RULES}
_UNRULED = {name: [[f"says-{of}-{k}"] for k, (of, _) in enumerate(_SAID) if of == name] for name in TITLES if name not in RULES}
MORE_RULES = {
    "AGPL-3.0": [["agpl-3-only"]],
    "AGPL-3.0-or-later": [["agpl-3"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]],
    "BSD-4-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"]],
    "CC0-1.0": [["cc0-notice"], ["cc0-waived"], ["cc0-dedicated"]],
    "EPL-1.0": [["epl-1"]],
    "EPL-2.0": [["epl-2"]],
    "GPL-2.0": [*RULES["GPL-2.0"], ["gpl-2-only"]],
    "GPL-3.0": [*RULES["GPL-3.0"], ["gpl-3-only"]],
    "LGPL-2.0": [["lgpl-2-only"]],
    "LGPL-2.0-or-later": [["lgpl-2"]],
    "LGPL-2.1": [["lgpl-2.1-only"]],
    "LGPL-2.1-or-later": [["lgpl-2.1"]],
    "LGPL-3.0": [["lgpl-3-only"]],
    "LGPL-3.0-or-later": [["lgpl-3"]],
    "Unlicense": [["unlicense-released", "unlicense-anyone"]],
}
ALL_RULES = RULES | {name: [*rule, *_UNRULED.get(name, [])] for name, rule in MORE_RULES.items()}
# A machine-readable mark names any of the licences, those without "or later" also as "only".
_MARK = "SPDX-License-Identifier: "
_ONLY_NAMES = [name for name in ALL_RULES if "GPL" in name and not name.endswith("later")]
MORE_SENTENCES += [(f"spdx-{name}", _MARK + name) for name in ALL_RULES] + [(f"spdx-{name}", f"{_MARK}{name}-only") for name in _ONLY_NAMES]
ALL_RULES = {name: [*rule, [f"spdx-{name}"]] for name, rule in ALL_RULES.items()}
# Every name of a mark's expression is made a mark of its own; a plus is "or later"; what a statement refers to in brackets is left out.
_MARKS = [
    (r"(?i)(?:SPDX-License-Identifier:[ \t]*|(?!\A)\G[ \t]+(?:OR|AND)[ \t]+)\(?([A-Za-z0-9][A-Za-z0-9.+-]*)\)?", f"|{_MARK}$1|"),
    (r"(?<=SPDX-License-Identifier: [A-Za-z0-9.-]{1,40})\+\|", "-or-later|"),
    (r"(?i)[ \t]*\(see [^()\n|]{1,80}\)", ""),
]
# A rule does not hold by sentences that belong to one of these longer ones.
LONGER = {"BSD-2-Clause": ["BSD-4-Clause", "BSD-3-Clause"], "BSD-3-Clause": ["BSD-4-Clause"]}
# Every known sentence has one of these in it; other texts are not cut up.
HINTS = ("licens", "permission", "permitted", "redistribut", "copyright notice", "public domain", "neighboring", "advertising")

# Cut after a mark that ends a sentence, at an empty line, and at a line that begins with a capital, comment marks aside.
_CUTS = [(r"([.;:!?])\s+", r"\1|"), (r"\n\s*\n", "|"), (r"\n[\s#*/;-]*([A-Z])", r"|\1")]
# A line that holds comment marks only is empty, too.
_EMPTY = (r"\n[\s#*/;%!-]*\n", "|")


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier, each sentence cut the way texts are; what the SQL looks up."""
    known = {}
    for name, sentence in SENTENCES.items():
        parts = cut(sentence)
        for k, part in enumerate(parts):
            # A sentence that is cut in several is known by its longest part.
            if part == max(parts, key=len):
                known[part] = name
    return known


def cut(text: str) -> list[str]:
    text = text.replace("|", " ")
    for pattern, mark in _CUTS:
        text = re.sub(pattern, mark, text)
    return [part for part in map(normalised, text.split("|")) if part]


def _pattern(sentence: str) -> str:
    """A known sentence in a marked text, whose words have one blank or cut between them."""
    words = normalised(sentence.replace("<name>", "0name0")).split()
    return "[ |]".join("[a-z0-9]+(?:[ |][a-z0-9]+){0,11}?" if w == "0name0" else w for w in words)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    marked = F.translate(text, "|", " ")
    for pattern, mark in [*_MARKS, _EMPTY, *_CUTS]:
        marked = F.regexp_replace(marked, pattern, mark.replace("\\1", "$1"))
    marked = F.regexp_replace(F.lower(marked), "[^a-z0-9|]+", " ")
    marked = F.regexp_replace(F.concat(F.lit("|"), marked, F.lit("|")), r" ?\|[ |]*", "|")
    sentences = [*SENTENCES.items(), *MORE_SENTENCES]
    patterns = sorted((_pattern(sentence) for _, sentence in sentences), key=len, reverse=True)
    whole = F.regexp_extract_all(marked, F.lit(rf"(?<=\|)(?:{'|'.join(patterns)})(?=\|)"), F.lit(0))
    plain = {normalised(sentence): name for name, sentence in sentences if "<name>" not in sentence}
    known = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])

    def name_of(found):
        out = F.try_element_at(known, F.translate(found, "|", " "))
        for name, sentence in sentences:
            if "<name>" in sentence:
                out = F.coalesce(out, F.when(found.rlike(f"^{_pattern(sentence)}$"), F.lit(name)))
        return out

    found = F.transform(whole, name_of)
    none = F.array().cast("array<string>")
    return F.when(F.lower(text).rlike("|".join(HINTS)), found).otherwise(none)


def _holds(sequence: Column, alternatives: list[list[str]]) -> Column:
    out = F.lit(False)
    for names in alternatives:
        out = out | sequence.like("%" + "%".join(f"<{n}>" for n in names) + "%")
    return out


def _without_longer(sequence: Column, rule: str) -> Column:
    """The sequence without what belongs to rules that go on where ``rule`` ends."""
    for longer in LONGER.get(rule, ()):
        for first, *names in ALL_RULES[longer]:
            # Not over a second beginning.
            others = rf"(?:<(?!{re.escape(first)}>)[^>]*>)*?"
            sequence = F.regexp_replace(sequence, f"<{re.escape(first)}>" + "".join(f"{others}<{re.escape(n)}>" for n in names), "")
    return sequence


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licenses)`` for each row of ``docs(doc_id, text)``.

    ``sentence_ids`` and ``licenses`` are comma-joined, the first in order of occurrence, the second by name.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(text).alias("ids"))
    sequence = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    rules = F.array(*[F.when(_holds(_without_longer(sequence, name), ALL_RULES[name]), F.lit(name)) for name in sorted(ALL_RULES)])
    licenses = F.when(F.size("ids") > 0, F.array_join(rules, ",")).otherwise(F.lit(""))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        licenses.alias("licenses"),
    )


def scan_sql() -> str:
    """The scan of ``documents`` as DuckDB SQL, by parts: it does not rejoin sentences that are cut at a line."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    marked = "replace(coalesce(text, ''), '|', ' ')"
    for pattern, mark in _CUTS:
        marked = f"regexp_replace({marked}, {quote(pattern)}, {quote(mark)}, 'g')"
    known = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known_sentences().items())
    parts = f"list_transform(string_split(lower({marked}), '|'), lambda p: trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')))"
    held = []
    for name in sorted(RULES):
        tests = [f"sequence LIKE {quote('%' + '%'.join(f'<{n}>' for n in names) + '%')}" for names in RULES[name]]
        held.append(f"CASE WHEN {' OR '.join(tests)} THEN {quote(name)} END")
    return f"""
        WITH found AS (SELECT doc_id, list_filter(list_transform({parts}, lambda p: MAP {{{known}}}[p]), lambda n: n IS NOT NULL) AS ids FROM documents),
        joined AS (SELECT *, '<' || coalesce(array_to_string(ids, '><'), '') || '>' AS sequence FROM found)
        SELECT doc_id, len(ids) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
            coalesce(array_to_string(list_filter([{', '.join(held)}], lambda n: n IS NOT NULL), ','), '') AS licenses
        FROM joined
    """
