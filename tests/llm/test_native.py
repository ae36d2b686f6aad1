"""Sharding, personal data, licences and chat against plain Python."""

import collections
import hashlib
import random
import re
import textwrap
import time
import zlib

import pytest

from rows import EDGE
from scoreloom.llm import chat, licenses, pii, sharding

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ODD = [
    "a@b.c_d@e.f x@y.z@w.q", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "😀 é +1 (736) 555-2678 300.1.1.1 001.2.3.4",
    "a@b", "+1234567890 1-", "joe [at] mail [dot] com, call 555-123-4567 or (212) 555-0199",
    "4111-1111-1111-1111 0000000000000000 41111111111111111111111", "a@b.c.d.", "@x.y a@-.-", "9" * 3000, "a." * 3000 + "@b" + ".c" * 3000,
    "+1" + " " * 2000, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "99999999999999999999.1.1.1 1.1.1.1",
]


def native_only(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_personal_data(make_docs, small):
    source = random.Random(2)
    mixed = ["".join(source.choice("a1.@+- 4(5)😀") for _ in range(60)) for _ in range(400)]
    rows = [*[(r[0], r[1]) for r in EDGE], *[(1000 + i, t) for i, t in enumerate(ODD + mixed)]]
    df = pii.find_personal_data(make_docs(rows))
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in df.collect()), key=repr)
    want = []
    for i, text in rows:
        spans = base_spans(text)
        n = collections.Counter(s[3] for s in spans)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert native_only(df)


def test_reliability_by_hand(spark):
    """The fitted posteriors are those of the same rounds in plain Python."""
    counts = [(1, 1, 1, 40), (1, 1, 0, 30), (1, -1, 0, 5), (-1, -1, 0, 50), (-1, 1, 0, 10)]
    rows = [("email", *c) for c in counts]
    votes = spark.createDataFrame(rows, "kind string, v_regex int, v_gazetteer int, v_context int, n long")
    got = pii.labeler_reliability(votes).first()
    prior, reliable = 0.5, [0.8] * 3

    def q(v):
        yes, no = prior, 1 - prior
        for r, x in zip(reliable, v):
            yes, no = (yes * r, no * (1 - r)) if x == 1 else (yes * (1 - r), no * r) if x == -1 else (yes, no)
        return yes / (yes + no)

    for _ in range(pii.ROUNDS):
        n = sum(c[3] for c in counts)
        post = {c: q(c[:3]) for c in counts}
        new = []
        for k in range(3):
            right = sum(c[3] * (post[c] if c[k] == 1 else 1 - post[c]) for c in counts if c[k])
            new.append((right + 8) / (sum(c[3] for c in counts if c[k]) + 10))
        prior, reliable = (sum(c[3] * post[c] for c in counts) + 1) / (n + 2), new
    assert got.prior == pytest.approx(prior) and list(got.reliability) == pytest.approx(reliable)


def test_looser_spans_are_added(make_docs):
    rows = [(i, f"write an email to joe{i}@mail{i}.example.com or call +1 (212) 555-01{i:02d} today") for i in range(80)]
    rows += [(100, "call my phone 212-555-0199 now"), (101, "no data")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(make_docs(rows)).collect()}
    assert got[0].startswith("email:18:") and got[101] == ""
    assert got[100] in ("", "phone:14:26")


def test_clear_looser_spans_are_added(make_docs):
    """Clear spans of all kinds in other spellings are accepted, and unlikely ones are not."""
    rows = [(i, f"write an email to joe{i}@mail{i}.example.com or call +1 (212) 555-01{i:02d} today, server 10.0.0.{i}, card 4111 1111 1111 1111") for i in range(80)]
    loose = {
        100: ("call my phone 212-555-0199 now", "phone:14:26"), 101: ("mail joe [at] mail [dot] com now", "email:5:28"),
        102: ("the server 192[.]168[.]0[.]7 is up", "ip:11:28"), 103: ("my card 4111.1111.1111.1111 is new", "card:8:27"),
        104: ("no data", ""), 105: ("the value 900.800.700.999 of it", ""), 106: ("write to joe at mail dot com now", "email:9:28"),
        107: ("about 7777 7777 7777 7772 units", ""), 108: ("the host 10 0 0 7 is up", "ip:9:17"),
    }
    df = pii.find_personal_data(make_docs(rows + [(i, text) for i, (text, _) in loose.items()]))
    got = {r.doc_id: r.spans for r in df.collect()}
    assert {i: got[i] for i in loose} == {i: spans for i, (_, spans) in loose.items()}
    assert native_only(df)


def test_shards(make_docs, small):
    rows = [(r[0], r[1]) for r in EDGE] + [(r.doc_id + 100, r.text) for r in small.collect()]
    placed, slot_map = sharding.shard_documents(make_docs(rows))
    got = placed.collect()
    assert native_only(placed)
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(places) == list(range(len(places))) for places in by_shard.values())
    versions = collections.Counter(r.version for r in slot_map.collect())
    assert versions == {0: sharding.SLOTS, 1: sharding.SLOTS}


@pytest.mark.parametrize("hot", [None, 7])
def test_one_id_for_most_rows_fills_no_shard(make_docs, hot):
    """Sizes of the rows themselves are near equal, also where an id, or none, is shared by two thirds of them."""
    source = random.Random(3)
    rows = [(hot if i % 3 else i, f"text {i} " + "x" * source.randrange(200)) for i in range(30_000)]
    total = collections.Counter()
    for r in sharding.shard_documents(make_docs(rows))[0].collect():
        total[r.shard] += r["size"]
    mean = sum(total.values()) / sharding.SHARDS
    assert len(total) == sharding.SHARDS and max(total.values()) < 1.02 * mean and min(total.values()) > 0.98 * mean


def test_even_and_few_moves(spark):
    loads = sharding.slot_loads(spark.range(50_000).select(sharding.slot_of(sharding.F.col("id")).alias("virtual_slot"), (sharding.F.col("id") % 97 + 1).alias("size")))
    first = sharding.first_map(loads, 24)
    second = sharding.rebalance(first, 24)
    third = sharding.rebalance(second, 25)
    before, after, more = ({r.virtual_slot: (r.shard, r.bytes) for r in m.collect()} for m in (first, second, third))
    for placed, shards in ((after, 24), (more, 25)):
        total = collections.Counter()
        for shard, size in placed.values():
            total[shard] += size
        assert set(total) == set(range(shards)) and max(total.values()) - min(total.values()) <= 600  # a mean slot
    assert sum(before[s][0] != after[s][0] for s in before) < 0.15 * len(before)
    assert sum(after[s][0] != more[s][0] for s in after) < 0.2 * len(after)


def test_empty_tables(spark, empty):
    assert sharding.shard_documents(empty)[0].count() == 0
    assert pii.find_personal_data(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_licenses(make_docs):
    s = licenses.SENTENCES
    apache = f"#!/bin/sh\n# {s['apache-you']}\n# {s['apache-use']}\n# {s['apache-copy']}\n#\n#     http://example.org\n\nText."
    mit = f"Copyright 2020 X\n\n{s['mit-grant']}\n\n{s['mit-notice-kept']}\n"
    rows = [
        (1, f"Some prose.\n{s['cc-by-nc-4.0']}\nMore prose."), (2, apache), (3, mit), (4, s["mit-notice-kept"] + "\n\n" + s["mit-grant"]),
        (5, f"a. {s['gpl-work-3']} b. {s['mit-notice']}"), (6, "Permission is hereby granted to nobody."), (7, None), (8, "licensed under the mit license"),
    ]
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert got[1] == (1, "CC-BY-NC-4.0") and got[2][1] == "Apache-2.0" and got[3][1] == "MIT"
    assert got[4] == (2, "") and got[5] == (2, "GPL-3.0,MIT") and got[6] == (0, "") and got[7] == (0, "") and got[8] == (1, "MIT")
    assert len(licenses.scan_licenses(make_docs(EDGE)).collect()) == len(EDGE)


def test_wrapped_licenses(make_docs):
    """Licence texts are recognised at every line width and behind comment marks."""
    s = licenses.SENTENCES
    mit = ["Copyright (c) 2020 Some One", s["mit-grant"], s["mit-notice-kept"], 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.']
    apache = [f"{s['apache-you']} {s['apache-use']} {s['apache-copy']}", "http://www.apache.org/licenses/LICENSE-2.0", s["apache-software"]]
    texts = {("MIT", 2): mit, ("Apache-2.0", 4): apache}
    rows, want = [], {}
    for (name, n), paragraphs in texts.items():
        for width in (30, 45, 60, 66, 72, 79, 100):
            for mark in ("", "# ", " * ", "// "):
                lines = f"\n{mark.rstrip()}\n".join(textwrap.fill(p, width, initial_indent=mark, subsequent_indent=mark) for p in paragraphs)
                want[len(rows)] = (name, n)
                rows.append((len(rows), f"Some code.\n\n{lines}\n\nMore of it."))
    # As the MIT licence is usually wrapped.
    usual = s["mit-grant"].replace("whom the Software", "whom the\nSoftware")
    rows.append((1000, f"{usual}\n\n{s['mit-notice-kept']}"))
    want[1000] = ("MIT", 2)
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert got == want


def test_more_licenses(make_docs):
    """Versions of GNU notices, the longer of two rules, and licences the SQL does not know."""
    s = licenses.SENTENCES
    bsd = f"{s['bsd-grant']}\n\n1. {s['bsd-source']}\n\n2. {s['bsd-binary']}\n\n"
    names = "3. Neither the name of the copyright\n   holder nor the names of its contributors may be used to endorse or promote\n   products derived from this software without specific prior written permission.\n\n"
    advertising = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software.\n\n"
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; {} of the License{}"
    lgpl = gpl.replace("program", "library").replace("General", "Lesser General")
    later = ", or\n(at your option) any later version."
    cases = [
        (bsd, "BSD-2-Clause"), (bsd + names, "BSD-3-Clause"), (bsd + advertising + names.replace("3.", "4."), "BSD-4-Clause"),
        (bsd + names + bsd, "BSD-2-Clause,BSD-3-Clause"), (bsd + bsd + names, "BSD-2-Clause,BSD-3-Clause"),
        (gpl.format("either version 2", later), "GPL-2.0-or-later"), (gpl.format("either version 3", later), "GPL-3.0-or-later"),
        (gpl.format("version 2", "."), "GPL-2.0"), (gpl.format("version 3", "."), "GPL-3.0"), (gpl.format("", "."), ""), (s["gpl-2"], "GPL-2.0-or-later"), (s["gpl-3"], "GPL-3.0-or-later"),
        (lgpl.format("either\nversion 2.1", later), "LGPL-2.1-or-later"), (lgpl.format("version 2.1", "."), "LGPL-2.1"), (lgpl.format("either version 3", later), "LGPL-3.0-or-later"),
        (gpl.replace("General", "Affero General").format("either version 3", later), "AGPL-3.0-or-later"),
        ("To the extent possible under law, Some One has waived all copyright and\nrelated or neighboring rights to This Work.", "CC0-1.0"),
        ("# This program and the accompanying materials are made\n# available under the terms of the Eclipse Public License 2.0\n# which is available at https://www.eclipse.org/legal/epl-2.0/\n#\n# SPDX", "EPL-2.0"),
        ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n", "Unlicense"),
        ("This is free and unencumbered software released into the public domain.", ""),
        ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0\n#include <a.h>", "Apache-2.0"), ("/* spdx-license-identifier: GPL-2.0-only */", "GPL-2.0"),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\nimport x", "Apache-2.0,MIT"), ("SPDX-License-Identifier: LGPL-2.1+", "LGPL-2.1-or-later"),
        ("SPDX-License-Identifier: GPL-3.0-or-later AND BSD-3-Clause AND ISC", "BSD-3-Clause,GPL-3.0-or-later,ISC"), ("SPDX-License-Identifier: LicenseRef-own", ""), (" OR MIT license", ""),
        ("This file is released under the MIT license.", "MIT"), ("Released under the MIT License (see LICENSE).", "MIT"), ("This project is licensed under the BSD 3-Clause License", "BSD-3-Clause"),
        ("We once released under the MIT License.", ""), ("This software is licensed under the Unlicense.", "Unlicense"),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(make_docs([(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert got == {i: name for i, (_, name) in enumerate(cases)}
    assert {n for rule in licenses.ALL_RULES.values() for names in rule for n in names} <= {*licenses.SENTENCES, *(n for n, _ in licenses.MORE_SENTENCES)}
    assert all(any(h in sentence.lower() for h in licenses.HINTS) for name, sentence in licenses.MORE_SENTENCES if name != "unlicense-anyone")


def test_sentences_are_hinted_and_distinct():
    known = licenses.known_sentences()
    assert len(set(known.values())) == len(licenses.SENTENCES)
    for name, sentence in licenses.SENTENCES.items():
        assert any(h in sentence.lower() for h in licenses.HINTS), name
    assert {n for alternatives in licenses.RULES.values() for names in alternatives for n in names} <= set(licenses.SENTENCES)


CHAT = [
    (1, 0, "user", "Hello there.\nHow are you?"),
    (1, 1, "assistant", "> How are  you?\nFine."),
    (1, 2, "user", ">> how are you?\n> Fine.\nGood to hear"),
    (1, 3, "user", "Something else"),
    (1, 4, "assistant", "> Hello there.\n> How are you?\nA late answer"),
    (1, 5, "assistant", ">> Fine.\nOnly deeper"),
    (1, 5, "assistant", "repeated turn"),
    (2, 0, "user", "How are you?"),
    (2, 1, "user", "> Fine.\nnot from this conversation"),
    (2, 2, "user", "> \n> ...\nnothing to link"),
    (2, 3, "user", None),
    (None, 0, "user", "no conversation"),
    (None, 1, "user", "> no conversation\nlinked"),
    (3, None, "user", "> no turn"),
]


def test_quotes(spark):
    messages = spark.createDataFrame([(*r, "x") for r in CHAT], "conv_id long, turn long, role string, text string, own string")
    df = chat.format_conversations(messages)
    got = df.collect()
    assert len(got) == len(CHAT) and native_only(df)
    by = {(r.conv_id, r.turn): r for r in got if r.text != "repeated turn"}
    assert [(by[1, t].parent_turn, by[1, t].root_turn, by[1, t].depth) for t in range(6)] == [
        (None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0), (0, 0, 1), (1, 0, 2)
    ]
    assert by[1, 2].text == "Good to hear" and by[1, 2].n_quotes == 2 and by[1, 2].n_linked == 2
    assert by[2, 1].parent_turn is None and by[2, 1].n_quotes == 1 and by[2, 2].n_linked == 0
    assert by[2, 3].text == "" and by[None, 1].parent_turn == 0 and by[3, None].root_turn is None
    order = [(r.root_turn, r.turn) for r in got if r.conv_id == 1]
    assert order == sorted(order)


def test_long_reply_chain(spark):
    rows = [(7, 0, "user", "line 0")] + [(7, t, "user", f"> line {t - 1}\nline {t}") for t in range(1, 70)]
    got = {r.turn: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[t].root_turn == 0 and got[t].depth == t for t in got)


def test_quotes_of_parts(spark):
    """Passages that are no whole run or line of their source: several lines of it, an excerpt, or wrapped otherwise."""
    first = "One line to begin with\nthe second line of four\nand here the third one\nthen the end"
    rows = [
        (1, 0, first), (1, 1, "> the second line of four\n> and here the third one\nlines 2 and 3"),
        (1, 2, "> the second line of\n> four and here\n> the third one\nwrapped"), (1, 3, "> second line of four and\nan excerpt"),
        (1, 4, "> the second line of four\n> then the end\nnot consecutive"), (1, 5, "> econd line of four\nno whole word"),
        (1, 6, "Alpha\nyes.\nno.\nbeta\n\nA paragraph\nof two lines\n\nLast words"), (1, 7, "> Yes.\n> No.\nshort lines"), (1, 8, "> A paragraph\n> of two lines\na paragraph"),
        (1, 9, "> Last words\n> here\nends otherwise"), (1, 10, "> with the second\nfew words, no lines"), (1, 11, "> words that come only later on\nfirst"),
        (1, 12, "There are words that come only later on in this"), (1, 13, "> words that come only later on\nsecond"),
        (2, 0, "> the second line of four\n> and here the third one\nanother conversation"),
        (None, 0, first), (None, 1, "> and here the third one then\n> the end\nno id"),
    ]
    df = chat.format_conversations(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_linked) for r in df.collect()}
    linked = {(1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 7): 6, (1, 8): 6, (1, 13): 12, (None, 1): 0}
    assert got == {(c, t): (linked.get((c, t)), int((c, t) in linked)) for c, t, _ in rows}
    assert native_only(df)


def test_a_hundred_thousand_spans_in_one_text(make_docs):
    """Work grows with a text about as its length does, whatever it holds."""
    many = 100_000
    text = "".join(f"{i % 250}.{i % 13}.{i % 7}.9 é" for i in range(many))
    mixed = "host 10.0.0.1, call 555-010-1234 card 4111 1111 1111 1112; " * 3000
    began = time.perf_counter()
    rows = {r.doc_id: r for r in pii.find_personal_data(make_docs([(1, text), (2, mixed), (3, "10.0.0.1")])).collect()}
    assert time.perf_counter() - began < 60
    assert rows[1].n_ip == many and rows[2].n_ip == 3000 and rows[3].spans == "ip:0:8"
    at, want = 0, []
    for i in range(many):
        size = len(f"{i % 250}.{i % 13}.{i % 7}.9")
        want.append(f"ip:{at}:{at + size}")
        at += size + 2
    assert rows[1].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_a_hundred_thousand_lines_in_one_message(spark):
    lines = [("> " if i % 2 else "") + f"line number {i}" for i in range(100_000)]
    schema = "conv_id long, turn long, role string, text string"
    began = time.perf_counter()
    rows = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "line number 1"), (1, 1, "user", "\n".join(lines))], schema)).collect()
    assert time.perf_counter() - began < 60
    last = next(r for r in rows if r.turn == 1)
    assert last.n_quotes == 50_000 and last.n_linked == 1 and last.parent_turn == 0
    assert last.text.split("\n")[:2] == ["line number 0", "line number 2"] and last.text.count("\n") == 49_999
