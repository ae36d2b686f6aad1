"""Chat formatting by quotation linking.

Every line of a message has a quote level, the number of ``>`` it begins with.
Runs of lines of one level are passages. The level-0 lines are what the author
wrote; they, and each of their runs and lines, are a message's originals. The
normalised quoted passages are hashed and joined to the originals of the same
conversation: a passage stems from the message with the lowest turn that holds
it, if that is before the quoting one. A passage that is no such original is
looked for within level-0 texts, however its lines are wrapped: from four words
on as consecutive words anywhere, below that as consecutive whole lines. Windows
of a text that begin with the passage's first words and have its length are
hashed, so that what is found is equal as a whole. A message replies to the latest message
that it quotes at its lowest linked level. Depth and root of a message come from
pointer doubling over these replies, so the number of joins is the logarithm of
the longest chain.

The conversation comes out without quotes, ordered by ``(conv_id, root_turn,
turn)``: replies follow what they reply to, under the message that began the
thread. Rows are sorted by ranges of this order, so one large conversation is
spread over tasks.

Defined cases: a null text counts as empty and quotes nothing. A null ``conv_id``
is a conversation like any other. A message without a turn is not linked and is
its own thread, without a root. Rows that repeat conversation and turn are kept
and share their links. Passages without a letter or digit are not linked.
Messages without links begin threads. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import let, stored

_MARK = r"^(\s*>)+ ?"
# Fixed value: passages of fewer words link as whole lines only.
EXCERPT_WORDS = 4


def passages(text: Column) -> Column:
    """``array<struct<level, body>>``: runs of lines of one quote level, in order."""
    lines = F.transform(
        F.split(text, "\r?\n", -1),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(line, _MARK, "").alias("body"),
        ),
    )

    def runs(lines):
        # Where the level changes; a run goes on to the next such place.
        first = lambda i: (i == 1) | (F.element_at(lines, i)["level"] != F.element_at(lines, F.greatest(i - 1, F.lit(1)))["level"])
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), first)

        def cut(starts):
            ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines) + 1))
            body = lambda start, end: F.array_join(F.transform(F.slice(lines, start, end - start), lambda line: line["body"]), "\n")
            return F.zip_with(starts, ends, lambda start, end: F.struct(F.element_at(lines, start)["level"].alias("level"), body(start, end).alias("body")))

        return let(starts, cut)

    return let(lines, runs)


def normalised(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def _key(said: Column) -> Column:
    """Hash, within the conversation, of a normalised passage."""
    return F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit("\n"), said), 256)


def _start_key(words: Column) -> Column:
    """Hash, within the conversation, of the first words of a passage; what it pairs is confirmed by ``_key``."""
    return F.xxhash64(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.array_join(words, " "))


def _said(bodies: Column) -> Column:
    """Normalised passages that have a letter or digit."""
    return F.filter(F.transform(bodies, normalised), lambda b: b.rlike(r"[\p{L}\p{N}]"))


def _hashes(bodies: Column) -> Column:
    return F.array_distinct(F.transform(_said(bodies), _key))


def _excerpts(parsed: DataFrame, pending: DataFrame) -> DataFrame:
    """``(hash, source)``: the lowest turn whose level-0 text has a passage of ``pending(conv_id, said)`` within it."""
    wanted = pending.select(F.col("conv_id").alias("_conv")).distinct()
    lines = F.filter(F.transform(F.split("own", "\n", -1), normalised), lambda b: b != "")
    # Stored, so that no expression over the words splits the text again.
    texts = stored(
        parsed.where("turn IS NOT NULL AND own <> ''").join(wanted, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").select(
            F.monotonically_increasing_id().alias("id"), "conv_id", "turn", lines.alias("lines"), F.split(normalised(F.col("own")), " ", -1).alias("words")
        ),
        "texts",
    )
    passages = pending.select("conv_id", F.split("said", " ", -1).alias("words")).where(F.size("words") >= EXCERPT_WORDS)
    starts = passages.select(_start_key(F.slice("words", 1, EXCERPT_WORDS)).alias("start"), F.size("words").alias("n")).distinct()
    places = texts.where(F.size("words") >= EXCERPT_WORDS).select(
        "id",
        F.size("words").alias("length"),
        F.posexplode(
            F.transform(F.sequence(F.lit(1), F.size("words") - (EXCERPT_WORDS - 1)), lambda i: _start_key(F.slice("words", i, EXCERPT_WORDS)))
        ).alias("at", "start"),
    )
    windows = places.join(starts, "start").where("at + n <= length").groupBy("id").agg(F.collect_set(F.struct("at", "n")).alias("windows"))
    longer = texts.join(windows, "id").select(
        "turn", F.explode(F.transform("windows", lambda w: _key(F.array_join(F.slice("words", w["at"] + 1, w["n"]), " ")))).alias("hash")
    )
    # Passages of few words have few lines.
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("lines")),
            lambda i: F.transform(F.array(*map(F.lit, range(2, EXCERPT_WORDS))), lambda n: F.array_join(F.slice("lines", i, n), " ")),
        )
    )
    few = F.filter(runs, lambda run: F.size(F.split(run, " ", -1)) < EXCERPT_WORDS)
    shorter = texts.where(F.size("lines") > 0).select("conv_id", "turn", few.alias("few")).select("turn", F.explode(_hashes(F.col("few"))).alias("hash"))
    return longer.unionByName(shorter).groupBy("hash").agg(F.min("turn").alias("source"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, level 0 text own, n_quotes, n_linked, parent_turn)`` for each row of ``messages``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Messages without a mark are one passage.
    cut = F.when(text.rlike(r"(^|\n)\s*>"), passages(text)).otherwise(F.array(F.struct(F.lit(0).alias("level"), text.alias("body"))))
    parsed = messages.select("conv_id", "turn", "role", cut.alias("parts"))
    own_runs = F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["body"])
    own = F.trim(F.array_join(own_runs, "\n"))
    quotes = F.filter("parts", lambda p: p["level"] > 0)
    parsed = stored(parsed.select("conv_id", "turn", "role", own.alias("own"), own_runs.alias("runs"), quotes.alias("quotes")), "messages")

    quoted = parsed.where((F.size("quotes") > 0) & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode("quotes").alias("q")).select(
        "conv_id", "turn", F.col("q.level").alias("level"), F.explode(_said(F.array("q.body"))).alias("said")
    ).distinct().withColumn("hash", _key(F.col("said")))
    everything = F.concat(F.array("own"), F.col("runs"), F.split("own", "\n", -1))
    originals = (
        parsed.where("turn IS NOT NULL")
        .select("turn", F.explode(_hashes(everything)).alias("hash"))
        .groupBy("hash")
        .agg(F.min("turn").alias("source"))
    )
    quoted = stored(quoted.join(originals, "hash", "left"), "quotes")
    pending = quoted.where("source IS NULL OR source >= turn").drop("source")
    found = pending.join(_excerpts(parsed, pending), "hash").where("source < turn")
    linked = quoted.where("source < turn").unionByName(found)
    # Of the lowest level the latest source.
    replies = linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_linked"), (-F.min(F.struct("level", (-F.col("source")).alias("later")))["later"]).alias("parent_turn")
    )
    replies = stored(replies, "replies").select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "n_linked", "parent_turn")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("turn") == F.col("_turn"))
    return parsed.join(replies, on, "left").select(
        "conv_id", "turn", "role", "own", F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn",
    )


def _roots(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, root_turn, depth)`` for every message with a parent; ``links(conv_id, turn, parent_turn)``."""
    now = stored(links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "roots")
    while True:
        up = now.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("root_turn").alias("_root"), F.col("depth").alias("_depth"))
        on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("root_turn") == F.col("_turn"))
        joined = stored(now.join(up, on, "left"), "roots")
        now = joined.select("conv_id", "turn", F.coalesce("_root", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        if joined.where("_root IS NOT NULL").isEmpty():
            return now


def format_conversations(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, parent_turn, root_turn, depth, n_quotes, n_linked)``, reply-ordered, quotes removed."""
    linked = stored(link_quotes(messages), "linked")
    roots = _roots(linked.where("parent_turn IS NOT NULL").select("conv_id", "turn", "parent_turn").distinct())
    roots = roots.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "root_turn", "depth")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("turn") == F.col("_turn"))
    out = linked.join(roots, on, "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quotes", "n_linked",
    )
    return out.repartitionByRange("conv_id", "root_turn", "turn").sortWithinPartitions("conv_id", "root_turn", "turn")
