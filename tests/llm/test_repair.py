"""Conversation repair against dynamic programming over the whole conversation, row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from scoreloom.llm import conversation_repair as cr

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string, i string, fault string, audit string, conv string, copy string"
MOVES = {("start", "s"): "system", ("start", "u"): "user", ("system", "u"): "user", ("user", "a"): "assistant", ("assistant", "u"): "user"}


def spelled(value):
    return " " if value is None else str(value)


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spelled(conv)}:{spelled(turn)}".encode()) % 20
        role, text = spelled(role), spelled(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) by states, from the last row to the first."""
    far = (10**9, "")
    best = {q: (0, "") if q in ("start", "assistant") else far for q in ("start", "system", "user", "assistant")}

    def inserted(best):
        for _ in range(3):
            for (p, letter), q in MOVES.items():
                if letter != "s":
                    best[p] = min(best[p], (best[q][0] + 2, "I" + best[q][1]))
        return best

    best = inserted(best)
    for (_, role, _), fault in zip(reversed(rows), reversed(faults)):
        now = {p: (cost + 3, "D" + audit) for p, (cost, audit) in best.items()}
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            for (p, letter), q in MOVES.items():
                cost, audit = best[q]
                if letter != "s":
                    now[p] = min(now[p], (cost + 2 + more, "R" + audit))
                if role[:1] == letter:
                    now[p] = min(now[p], (cost + more, "K" + audit))
        best = inserted(now)
    return best["start"]


def by_hand(rows):
    rows = after_damage(rows)
    faults = faults_of(rows)
    cost, audit = cheapest(rows, faults)
    said, user, at = [], True, iter(rows)
    for letter in audit:
        row = ("", "", "") if letter == "I" else next(at)
        if letter == "K" and row[1][0] == "s":
            said.append(f"{row[1]}:{row[2]}")
        elif letter != "D":
            said.append(f"{row[1] if letter == 'K' else 'user' if user else 'assistant'}:{row[2]}")
            user = not user
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(name) for name in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def check(spark, rows, **options):
    df = spark.createDataFrame([(*row, *["extra"] * 5) for row in rows], SCHEMA).repartition(3)
    got = cr.repair_conversations(df, **options).collect()
    want = {conv: by_hand([r for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    return {r.conv_id: r for r in got}


def random_rows(seed, sizes):
    source = random.Random(seed)
    texts = ["Hi.", "ok?", "no end", None, "", " \n\x0b", "Ä!", "yes. ", "a:b.", "end\x85"]
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", "", "Übung"]
    rows = []
    for conv, size in enumerate(sizes):
        for i in range(size):
            text = source.choice(texts)
            rows.append((conv or None, source.choice([None, i, i, i, 2 * i]), source.choice(roles), text and text + source.choice(["", f"{i}."])))
    return rows


@pytest.mark.parametrize("block", [2, 3, cr.BLOCK])
def test_against_rows_in_order(spark, block):
    check(spark, random_rows(block, [1, 2, 3, 5, 8, 17, 40, 0, 1, 4, 90]), block=block)


def test_long_conversation(spark):
    """A conversation of thousands of rows is parsed in several rounds of blocks."""
    found = check(spark, random_rows(9, [0, 3000, 2]))
    assert len(found[1].audit) > 2000


def test_cases(spark):
    assert check(spark, []) == {}
    # The checksum drops the only row of some conversation.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = check(spark, [(gone, 0, "user", "Hi."), (None, None, None, None)])[gone]
    assert (row.gaps, row.cost, row.audit, row.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())


def test_hot_conversation_and_repeats(spark):
    rows = random_rows(4, [0, 200]) * 3 + random_rows(5, [0, 0, 4, 4])
    check(spark, rows)


def strings(initials, faults):
    """All edits by exhaustion, as (cost, audit), for very few rows."""
    good = re.compile("(s?(ua)+)?$")
    kinds = [[("D", "", 3)] + ([] if f in ("blank", "duplicate") else [("K", a, 0), ("R", "u", 2), ("R", "a", 2)]) for a, f in zip(initials, faults)]
    gaps = list(itertools.chain.from_iterable(itertools.product("ua", repeat=k) for k in range(3)))
    for edits in itertools.product(*kinds):
        for inserted in itertools.product(gaps, repeat=len(edits) + 1):
            roles, audit, cost = "", "", 0
            for k, between in enumerate(inserted):
                roles, audit, cost = roles + "".join(between), audit + "I" * len(between), cost + 2 * len(between)
                if k < len(edits):
                    letter, role, price = edits[k]
                    roles, audit, cost = roles + role, audit + letter, cost + price + (faults[k] == "truncated" and letter != "D")
            if good.match(roles):
                yield cost, audit


@pytest.mark.parametrize("initials", ["s", "a", "us", "uu", "sa", "xa", "uas", "aua"])
def test_parse_against_all_edits(initials):
    for faults in ([None] * len(initials), ["truncated"] * len(initials), ["blank", *[None] * (len(initials) - 1)]):
        cell = cr.parse([cr.row_cell(a if a in "sua" else "", f) for a, f in zip(initials, faults)])
        assert min(cell[cr.START, q] for q in cr.GOOD if (cr.START, q) in cell) == min(strings(initials, faults))
