"""Personal data by weak supervision.

Candidates are spans of four kinds: the base patterns, and looser ones: other
spellings, matches that fail their check, and spans of no certain form that the
gazetteer or context labeler proposes. Three labelers vote on each: the *regex*
labeler (does the strict pattern hold for the span in its usual spelling), the
*gazetteer* labeler (does the span contain a known mail host or number prefix)
and the *context* labeler (does a word before the span announce the kind). Votes
are counted per kind; expectation-maximisation over these counts, of which there
are at most ``27`` a kind, gives every labeler's reliability and a posterior per
pattern of votes. The posteriors are the labels of a naive Bayes classifier over
shape features of the span, which decides on the looser candidates. Base spans
are always reported.

All positions are code points. Only counts of votes and features, whose number
does not depend on the rows, leave the scan.

Defined cases: a null text counts as empty; an empty text has no spans. A match
of a base pattern that fails its check is no base span, and is not tried again at
another place. With no candidates there is no model and no further span.
Repeated rows and null ids are kept. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import stored, with_running

KINDS = ("email", "ip", "card", "phone")

# The base patterns. A match that could start inside a run of its first class starts at the run's
# beginning or where the match before has ended, and the classes that follow each other exclude each other, so
# possessive forms match the same without trying again.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser spans: an address spelled out; numbers with other separators, and no leading plus.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(]? ?(?:\.|dot) ?[\])]? ?[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,3}[0-9]{4}){2}[ ._/-]{1,3}[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
# Spans of no certain form, which are candidates where the gazetteer or the context labeler proposes them.
OPEN = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.,:-])[0-9]{1,3}(?:[ ,:_-][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{2,6}(?:[ ._/-]{1,3}[0-9]{2,6}){2,6}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:[0-9]{7,15}|\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,4}){1,4})(?![0-9])",
}
# Which labelers propose; a prefix alone says nothing about a number.
PROPOSERS = {"email": ("gazetteer", "context"), "ip": ("context",), "card": ("context",), "phone": ("context",)}
# Numbers of digits of a candidate, also of a match of the base pattern that fails its check.
DIGITS = {"ip": (4, 14), "card": (13, 19), "phone": (7, 18)}
# What a text must contain for a pattern to match at all.
_NEEDS = {"email": "@", "phone": "+"}
# Gazetteers and context words, as patterns over a span and over the 24 characters before it.
GAZETTEER = {
    "email": r"(?i)(mail|example|gmail|yahoo|outlook|proton|\.(com|org|net|edu))",
    "ip": r"^(10\.|127\.|172\.|192\.168\.|203\.0\.113\.|198\.51\.100\.)",
    "card": r"^(4|5[1-5]|3[47]|6)",
    "phone": r"(555|^\+(1|33|34|44|49))",
}
CONTEXT = {
    "email": r"(?i)(mail|contact|write|reach|correo|adresse|@)",
    "ip": r"(?i)(\bip\b|host|server|address|addr)",
    "card": r"(?i)(card|visa|credit|payment|tarjeta|carte|karte)",
    "phone": r"(?i)(phone|call|tel|fax|mobile|contact|llam|appel|ruf)",
}
CONTEXT_CHARS = 24
ROUNDS = 20
ACCEPT = 0.9
# Base patterns for matches that may fail; of runs of digits only those that are long enough, as others are many.
FAILED = BASE | {"card": r"[0-9](?:[\x20-]?[0-9]){12,}+"}


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with an ``array<struct<start, end, span, before>>`` for each named ``(pattern, needed)``: its leftmost non-overlapping matches, in code points, where ``needed``.

    Places are running totals of the lengths of matches and of the text between them; ``before``, the characters before
    a span, is put together from the pieces before it. Nothing counts characters from the beginning of the text again.
    """
    columns, chars, of = df.columns, F.lit(CONTEXT_CHARS), lambda name, what: F.col(f"{name} {what}")
    none = F.array().cast("array<string>")
    found = {f"{n} found": F.when(needed, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none) for n, (p, needed) in patterns.items()}
    df = df.withColumns(found)
    between = lambda n, p: F.when(F.size(of(n, "found")) > 0, F.slice(F.split(F.col(text), p, -1), 1, F.size(of(n, "found")))).otherwise(none)
    df = df.withColumns({f"{n} gaps": between(n, p) for n, (p, _) in patterns.items()})
    sizes = {f"{n} ends": F.zip_with(of(n, "gaps"), of(n, "found"), lambda g, m: F.length(g) + F.length(m)) for n in patterns}
    df = with_running(df, sizes, F.lit(0), lambda done, x: done + x)
    # A piece has a character at least, so as many of the pieces before as characters are asked for will do.
    tail = lambda g, m: F.right(F.concat(F.right(g, chars), m), chars)
    df = df.withColumns({f"{n} tails": F.zip_with(of(n, "gaps"), of(n, "found"), tail) for n in patterns})

    def span(n):
        def build(m, i):
            earlier = F.array_join(F.slice(of(n, "tails"), F.greatest(i - chars, F.lit(0)) + 1, F.least(i, chars)), "")
            before = F.right(F.concat(earlier, F.right(of(n, "gaps")[i], chars)), chars)
            return F.struct((of(n, "ends")[i] - F.length(m)).alias("start"), of(n, "ends")[i].alias("end"), m.alias("span"), before.alias("before"))

        return F.transform(of(n, "found"), build)

    return df.select(*columns, *[span(n).alias(n) for n in patterns])


def only_apart(df: DataFrame, pairs: dict[str, Column]) -> DataFrame:
    """``df`` whose named columns keep the spans, none of which overlap each other, that none of the paired others overlaps.

    All are put in one order, a span by its end and another by its start. A span is apart if, of the
    others that start before its end, none ends after its start: a running maximum tells.
    """
    columns = df.columns
    event = lambda key, last, end, s: F.struct(key.alias("key"), last.alias("last"), end.alias("end"), s.alias("span"))

    def events(name, others):
        nothing = F.when(F.lit(False), F.element_at(F.col(name), 1))
        asked = F.transform(F.col(name), lambda s: event(s["end"], F.lit(0), F.lit(-1), s))
        given = F.transform(others, lambda o: event(o["start"], F.lit(1), o["end"], nothing))
        some = (F.size(F.col(name)) > 0) & (F.size(others) > 0)
        return F.when(some, F.array_sort(F.concat(asked, given))).otherwise(asked)

    df = df.withColumns({f"{name} events": events(name, others) for name, others in pairs.items()})
    df = with_running(df, {f"{name} latest": F.transform(F.col(f"{name} events"), lambda e: e["end"]) for name in pairs}, F.lit(-1), F.greatest)

    def kept(name):
        marked = F.zip_with(F.col(f"{name} events"), F.col(f"{name} latest"), lambda e, end: F.struct(e["span"].alias("span"), end.alias("end")))
        return F.transform(F.filter(marked, lambda m: m["span"].isNotNull() & (m["end"] <= m["span"]["start"])), lambda m: m["span"])

    return df.select(*[kept(c).alias(c) if c in pairs else F.col(f"`{c}`") for c in columns])


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn test."""
    reverse = F.split(F.reverse(digits), "")

    def value(d, i):
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    values = F.transform(F.filter(reverse, lambda d: d != ""), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    """The check that a match of a base pattern must pass."""
    if kind == "ip":
        # At most 255, leading zeros allowed; long numbers are no integers.
        return F.forall(F.split(span, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(span)).between(14, 19) & luhn(_digits(span))
    if kind == "phone":
        return F.length(_digits(span)).between(10, 15)
    return F.lit(True)


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a column of base spans for each kind."""
    may = {kind: F.contains(F.col(text), F.lit(_NEEDS[kind])) if kind in _NEEDS else F.col(text).rlike("[0-9]") for kind in KINDS}
    df = with_spans(df, text, {kind: (BASE[kind], may[kind]) for kind in KINDS})
    passing = lambda kind: F.filter(F.col(kind), lambda s: valid(kind, s["span"]))
    return df.withColumns({kind: passing(kind) for kind in KINDS})


def _plausible(kind: str, span: Column) -> Column:
    return F.length(_digits(span)).between(*DIGITS[kind]) if kind in DIGITS else F.lit(True)


def canonical(kind: str, span: Column) -> Column:
    """A looser span as the base pattern would have it."""
    if kind == "email":
        at = F.regexp_replace(span, r" ?[\[(] ?at ?[\])] ?| at ", "@")
        return F.regexp_replace(at, r" ?[\[(] ?dot ?[\])] ?| dot ", ".")
    if kind == "ip":
        return F.regexp_replace(span, "[^0-9]+", ".")
    return _digits(span) if kind == "card" else span


def strict(kind: str, span: Column) -> Column:
    """Does the base pattern hold for all of the canonical span, and its check; a phone may have a national number."""
    if kind == "phone":
        return (span.startswith("+") & valid(kind, span)) | _digits(span).rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$")
    return canonical(kind, span).rlike(f"^(?:{BASE[kind]})$") & valid(kind, canonical(kind, span))


def with_loose_spans(df: DataFrame, text: str) -> DataFrame:
    """``df``, with its base spans, and for each kind a column of looser spans that no base span overlaps, with ``open`` for those that a labeler had to propose."""
    columns = df.columns
    may = {"email": r"[\[(] ?at ?[\])]| at [A-Za-z0-9-]+ dot ", "ip": r"[0-9][^0-9]{1,9}[0-9]", "card": "[0-9]{2}", "phone": "[0-9]{2}"}
    needed = {kind: F.col(text).rlike(pattern) for kind, pattern in may.items()}
    numbers = [kind for kind in KINDS if kind != "email"]
    patterns = {f"loose_{kind}": (LOOSE[kind], needed[kind]) for kind in KINDS} | {f"open_{kind}": (OPEN[kind], needed[kind]) for kind in KINDS}
    # Matches that fail their check.
    patterns |= {f"failed_{kind}": (FAILED[kind], needed[kind]) for kind in numbers}
    df = with_spans(df, text, patterns)

    def proposed(kind, s):
        by = {"gazetteer": lambda: canonical(kind, s["span"]).rlike(GAZETTEER[kind]), "context": lambda: s["before"].rlike(CONTEXT[kind])}
        out = F.lit(False)
        for name in PROPOSERS[kind]:
            out = out | by[name]()
        return out

    def candidates(name, kind):
        wanted = {"loose": lambda s: F.lit(True), "failed": lambda s: ~valid(kind, s["span"]), "open": lambda s: proposed(kind, s)}[name]
        kept = F.filter(F.col(f"{name}_{kind}"), lambda s: _plausible(kind, s["span"]) & wanted(s))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["span"].alias("span"), s["before"].alias("before"), F.lit(name == "open").alias("open")))

    df = df.withColumns({f"{name}_{kind}": candidates(name, kind) for name in ("loose", "open") for kind in KINDS})
    df = df.withColumns({f"failed_{kind}": candidates("failed", kind) for kind in numbers})
    # Matches of one pattern do not overlap each other, so each is held against those of the others only.
    df = only_apart(df, {f"failed_{kind}": F.col(f"loose_{kind}") for kind in numbers})
    df = df.withColumns({f"loose_{kind}": F.concat(f"loose_{kind}", f"failed_{kind}") for kind in numbers})
    df = only_apart(df, {f"open_{kind}": F.col(f"loose_{kind}") for kind in KINDS})
    df = df.withColumns({f"loose_{kind}": F.concat(f"loose_{kind}", f"open_{kind}") for kind in KINDS})
    df = only_apart(df, {f"loose_{kind}": F.concat(*KINDS) for kind in KINDS})
    return df.select(*columns, *[f"loose_{kind}" for kind in KINDS])


def _votes(kind: str, span: Column, before: Column, certain: Column) -> list[Column]:
    """1 for, 0 abstaining, -1 against; one column per labeler. The regex labeler is not sure of spans of no certain form."""
    return [
        F.when(~F.coalesce(strict(kind, span), F.lit(False)), -1).when(certain, 1).otherwise(0).alias("v_regex"),
        F.when(canonical(kind, span).rlike(GAZETTEER[kind]), 1).otherwise(-1).alias("v_gazetteer"),
        F.when(before.rlike(CONTEXT[kind]), 1).otherwise(0).alias("v_context"),
    ]


LABELERS = ("v_regex", "v_gazetteer", "v_context")


def labeler_reliability(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(kind, prior, reliability array<double>, patterns)`` from ``votes(kind, v_..., n)``, by expectation-maximisation.

    A labeler that votes is right with its reliability, the same for both
    classes. Counts start with one right and one wrong vote at the start value.
    """
    packed = votes.groupBy("kind").agg(
        F.array_sort(F.collect_list(F.struct(*LABELERS, "n"))).alias("patterns")
    )

    def posterior(state, p):
        yes, no = state["prior"], 1 - state["prior"]
        for i, name in enumerate(LABELERS):
            r = state["reliability"][i]
            yes = yes * F.when(p[name] == 1, r).when(p[name] == -1, 1 - r).otherwise(F.lit(1.0))
            no = no * F.when(p[name] == 1, 1 - r).when(p[name] == -1, r).otherwise(F.lit(1.0))
        return yes / (yes + no)

    def total(patterns, value):
        return F.aggregate(patterns, F.lit(0.0), lambda a, p: a + value(p) * p["n"])

    def improve(state, _):
        q = lambda p: posterior(state, p)
        n = total(F.col("patterns"), lambda p: F.lit(1.0))
        prior = (total(F.col("patterns"), q) + 1) / (n + 2)
        reliability = []
        for name in LABELERS:
            right = total(F.col("patterns"), lambda p: F.when(p[name] == 1, q(p)).when(p[name] == -1, 1 - q(p)).otherwise(F.lit(0.0)))
            voted = total(F.col("patterns"), lambda p: F.when(p[name] != 0, 1.0).otherwise(F.lit(0.0)))
            reliability.append((right + 8) / (voted + 10))
        return F.struct(prior.alias("prior"), F.array(*reliability).alias("reliability"))

    start = F.struct(F.lit(0.5).cast("double").alias("prior"), F.array(*[F.lit(0.8).cast("double")] * len(LABELERS)).alias("reliability"))
    fitted = packed.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, improve))
    scored = F.transform("patterns", lambda p: F.struct(*[p[n].alias(n) for n in LABELERS], posterior(F.col("state"), p).alias("q")))
    return fitted.select("kind", F.col("state.prior").alias("prior"), F.col("state.reliability").alias("reliability"), scored.alias("posteriors"))


def _features(span: Column, before: Column) -> list[Column]:
    """Shape features of a span, each with few values; its votes are added to them."""
    size = F.least(F.floor(F.length(span) / 4), F.lit(8)).cast("string")
    digits = F.least(F.length(_digits(span)), F.lit(20)).cast("string")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(span, "[0-9]+", "9"), "[A-Za-z]+", "a"), "[^9a]+", "-")
    return [
        F.concat(F.lit("size "), size),
        F.concat(F.lit("digits "), digits),
        F.concat(F.lit("shape "), F.substring(shape, 1, 5)),
        F.concat(F.lit("before "), F.regexp_extract(before, "(.)$", 1).rlike("[A-Za-z0-9]").cast("string")),
    ]


def train_span_classifier(candidates: DataFrame, posteriors: DataFrame) -> DataFrame:
    """``(kind, base, weights map<feature, log-odds>)``: naive Bayes over soft labels.

    A feature's share in a class is smoothed by one candidate of its share in both:
    without evidence against it a rare feature decides nothing.
    Both tables are bounded by the numbers of kinds and of feature values.
    """
    soft = candidates.groupBy("kind", *LABELERS, "features").agg(F.count("*").alias("n")).join(
        F.broadcast(posteriors.select("kind", F.inline("posteriors"))), ["kind", *LABELERS]
    )
    yes, no = F.sum(F.col("n") * F.col("q")), F.sum(F.col("n") * (1 - F.col("q")))
    totals = soft.groupBy("kind").agg((yes + 1).alias("all_yes"), (no + 1).alias("all_no"))
    counts = soft.select("kind", "n", "q", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(
        yes.alias("yes"), no.alias("no")
    )
    # ``all_yes`` and ``all_no`` hold the added candidate.
    share = (F.col("yes") + F.col("no")) / (F.col("all_yes") + F.col("all_no") - 2)
    odds = F.log((F.col("yes") + share) / F.col("all_yes")) - F.log((F.col("no") + share) / F.col("all_no"))
    return (
        counts.join(F.broadcast(totals), "kind")
        .groupBy("kind")
        .agg(
            F.max(F.log(F.col("all_yes") / F.col("all_no"))).alias("base"),
            F.map_from_entries(F.collect_list(F.struct("feature", odds.alias("odds")))).alias("weights"),
        )
    )


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for each row of ``docs(doc_id, text)``."""

    def judged(kind, base):
        """A span with its votes and features; the text of the span itself is not kept."""

        def build(s):
            before = s["before"]
            votes = [F.lit(1).alias("v_regex"), *_votes(kind, s["span"], before, F.lit(True))[1:]] if base else _votes(kind, s["span"], before, ~s["open"])
            return F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("strict"),
                *votes, F.array(*_features(s["span"], before), *[F.concat(F.lit(f"{n} "), v.cast("string")) for n, v in zip(LABELERS, votes)]).alias("features"),
            )

        return build

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = with_loose_spans(with_base_spans(rows, "_text"), "_text")
    found = stored(
        rows.select(
            "doc_id",
            F.concat(
                *[F.transform(kind, judged(kind, True)) for kind in KINDS],
                *[F.transform(f"loose_{kind}", judged(kind, False)) for kind in KINDS],
            ).alias("found"),
        ),
        "spans",
    )
    candidates = found.select(F.explode("found").alias("s")).select("s.kind", *[f"s.{name}" for name in LABELERS], "s.features")
    votes = candidates.groupBy("kind", *LABELERS).agg(F.count("*").alias("n"))
    model = train_span_classifier(candidates, stored(labeler_reliability(votes), "labelers"))
    # One row with an entry per kind.
    models = stored(model.agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("base", "weights")))).alias("models")), "span_model")

    def accepted(s):
        own = F.col("models")[s["kind"]]
        odds = F.aggregate(s["features"], own["base"], lambda a, f: a + F.coalesce(own["weights"][f], F.lit(0.0)))
        return F.coalesce(1 / (1 + F.exp(-odds)) >= accept, F.lit(False))

    of_kind = lambda kind: lambda s: s["kind"] == kind
    split = found.join(F.broadcast(models)).select(
        "doc_id",
        F.filter("found", lambda s: s["strict"]).alias("base"),
        F.filter("found", lambda s: s["strict"] | accepted(s)).alias("spans"),
    )
    return split.select(
        "doc_id",
        *[F.size(F.filter("base", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
