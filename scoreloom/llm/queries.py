"""One query per operator over the given tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from scoreloom.llm import (
    bpe, chat, conversation_repair, decontaminate, embedding_dedup, exact_dedup, language, licenses, near_dedup, pii, sharding, spelling, token_counts,
)
from scoreloom.llm.common import table

# The contract of the query asks for four words.
NEAR_SHINGLE = 4


def op1_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"), shingle=NEAR_SHINGLE)


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op2_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    content = language.learn(docs.where(~F.coalesce(_held_out(), F.lit(False))), required=False)
    found = language.identify(docs.select("doc_id", "text"), content).select("row.doc_id", "lang_found.*")
    held_out = F.coalesce(_held_out(), F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


def op3_exact_dedup(spark, sf):
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


def op4_byte_bpe(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_and_decode(table(spark, sf, "documents"), path, public_tokenizers.PATTERN, extra=("n_split",))


def op5_license_scan(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents"))


def op6_quote_linking(spark, sf):
    return chat.format_conversations(table(spark, sf, "conversations"))


def op7_token_counts(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    counts = token_counts.count_tokens(table(spark, sf, "documents"), path, keep_prefixes=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_sharding(spark, sf):
    placed, _ = sharding.shard_documents(table(spark, sf, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op9_personal_data(spark, sf):
    return pii.find_personal_data(table(spark, sf, "documents"))


def op10_decontamination(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("hit", "items")


def op11_embedding_dedup(spark, sf):
    return embedding_dedup.near_duplicate_vectors(table(spark, sf, "embeddings"))


def op12_conversation_repair(spark, sf):
    return conversation_repair.repair_conversations(table(spark, sf, "conversations"))


def op13_spelling_variants(spark, sf):
    return spelling.spelling_variants(table(spark, sf, "documents"))


def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_language_id, op3_exact_dedup, op4_byte_bpe, op5_license_scan, op6_quote_linking,
        op7_token_counts, op8_sharding, op9_personal_data, op10_decontamination,
        op11_embedding_dedup, op12_conversation_repair, op13_spelling_variants, pipeline,
    )
}

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{gaps}'), lambda w: w <> '')"

_CRC = """
        polynomial AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, with ``polynomial`` among the tables."""
    digits = f"hex(encode({text}))"
    numbers = f"list_transform(range(1, len({digits}), 2), lambda k: ('0x' || substr({digits}, k, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295)"


_WHITE = "[ \\t\\n\\x0b\\f\\r]"

ORACLE = {
    "op1_near_dedup": f"""
        WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(gaps='[ \\t\\n\\x0b\\f\\r]+')} AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {NEAR_SHINGLE} THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - {NEAR_SHINGLE - 2}), lambda i: array_to_string(w[i:i + {NEAR_SHINGLE - 1}], ' '))) END AS s
            FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
        shared AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
            FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT u, v FROM shared WHERE 100 * k >= {near_dedup.SIMILARITY} * (na + nb - k)),
        both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
        component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN component ON id = doc_id
    """,
    "op3_exact_dedup": """
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', '', 'g') AS norm FROM documents),
        ranked AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
            count(*) OVER (PARTITION BY norm) AS group_size FROM texts)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked
    """,
    "op5_license_scan": licenses.scan_sql(),
    "op6_quote_linking": """
        WITH RECURSIVE lines AS (
            SELECT conv_id, turn, i, regexp_extract(l, '^(\\s*>)+ ?') AS mark, regexp_replace(l, '^(\\s*>)+ ?', '') AS body
            FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) AS l,
                generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), 1) AS i FROM conversations)),
        levels AS (SELECT *, length(regexp_replace(mark, '[^>]', '', 'g')) AS level FROM lines),
        runs AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM levels),
        passages AS (SELECT conv_id, turn, level, min(i) AS i, string_agg(body, chr(10) ORDER BY i) AS body FROM runs GROUP BY conv_id, turn, level, run),
        own AS (SELECT conv_id, turn, coalesce(trim(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ' '), '') AS own,
            count(*) FILTER (level > 0) AS n_quotes FROM passages GROUP BY 1, 2),
        said AS (SELECT conv_id, turn, own AS body FROM own UNION SELECT conv_id, turn, body FROM passages WHERE level = 0
            UNION SELECT conv_id, turn, unnest(string_split(own, chr(10))) FROM own),
        norm AS (SELECT conv_id, min(turn) AS source, trim(regexp_replace(lower(body), '\\s+', ' ', 'g'), ' ') AS p FROM said GROUP BY conv_id, p),
        quoted AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(body), '\\s+', ' ', 'g'), ' ') AS p FROM passages WHERE level > 0),
        linked AS (SELECT q.conv_id, q.turn, level, source FROM quoted q JOIN norm n ON q.conv_id = n.conv_id AND q.p = n.p
            WHERE source < turn AND regexp_matches(q.p, '[\\p{L}\\p{N}]')),
        replies AS (SELECT conv_id, turn, count(*) AS n_linked, arg_max(source, source - 1000000 * level) AS parent_turn FROM linked GROUP BY 1, 2),
        up(conv_id, turn, node, depth) AS (
            SELECT conv_id, turn, turn, 0 FROM conversations
            UNION SELECT u.conv_id, u.turn, r.parent_turn, u.depth + 1 FROM up u JOIN replies r ON u.conv_id = r.conv_id AND u.node = r.turn),
        roots AS (SELECT conv_id, turn, min(node) AS root_turn, max(depth)::BIGINT AS depth FROM up GROUP BY 1, 2)
        SELECT c.conv_id, c.turn, c.role, own AS text, parent_turn, root_turn, depth, n_quotes, coalesce(n_linked, 0) AS n_linked
        FROM conversations c JOIN own USING (conv_id, turn) JOIN roots USING (conv_id, turn) LEFT JOIN replies USING (conv_id, turn)
    """,
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(gaps='[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS.format(gaps='[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS p FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
        found AS (SELECT doc_id, item_id, size, i FROM places JOIN windows USING (size, p)),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + size)) AS t(k) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
            FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_embedding_dedup": f"""
        WITH RECURSIVE parts AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        units AS (SELECT vec_id, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS u FROM parts
            WHERE len(x) > 0 AND list_bool_and(list_transform(x, lambda v: v IS NOT NULL AND isfinite(v))) AND list_dot_product(x, x) > 0),
        links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM units a JOIN units b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.u, b.u) >= {embedding_dedup.COSINE}),
        reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.v FROM reach r JOIN links l ON r.other = l.u),
        component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1),
        counts AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
        SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN counts ON u = id
    """,
    "op12_conversation_repair": f"""
        WITH RECURSIVE {_CRC},
        kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
            FROM conversations, polynomial),
        said AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM kinds WHERE kind <> 0),
        places AS (SELECT *, left(role, 1) AS initial, right(regexp_replace(text, '{_WHITE}+$', ''), 1) AS last,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i FROM said),
        lines AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
            i > 0 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM places),
        faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
            FROM lines GROUP BY 1),
        moves(p, letter, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        inserted(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
            (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
        edits AS (SELECT conv_id, i, p, p AS q, 3 AS cost, 'D' AS letter FROM lines, range(4) AS t(p)
            UNION ALL SELECT conv_id, i, p, q, 2 + (fault IS NOT NULL)::INT, 'R' FROM lines, moves WHERE letter <> 's' AND coalesce(fault, '') NOT IN ('blank', 'duplicate')
            UNION ALL SELECT conv_id, i, p, q, (fault IS NOT NULL)::INT, 'K' FROM lines JOIN moves ON letter = initial WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate')),
        steps AS MATERIALIZED (SELECT e.conv_id, e.i, e.p, s.q, e.cost + s.cost AS cost, e.letter || s.audit AS audit FROM edits e JOIN inserted s ON e.q = s.p),
        parse(conv_id, i, p, best) AS (
            SELECT conv_id, 0::BIGINT, q, {{'cost': s.cost::BIGINT, 'audit': s.audit}} FROM faults, inserted s WHERE s.p = 0
            UNION ALL SELECT a.conv_id, a.i + 1, b.q, min({{'cost': a.best.cost + b.cost, 'audit': a.best.audit || b.audit}})
            FROM parse a JOIN steps b ON a.conv_id = b.conv_id AND a.i = b.i AND a.p = b.p GROUP BY ALL),
        cheapest AS (SELECT a.conv_id, min(best) AS best FROM parse a JOIN faults f ON a.conv_id = f.conv_id AND a.i = f.n WHERE p IN (0, 3) GROUP BY 1),
        letters AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS pos FROM cheapest WHERE best.audit <> ''),
        numbered AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS i FROM letters),
        joined AS (SELECT n.conv_id, pos, letter, role, text, letter = 'K' AND initial = 's' AS opening FROM numbered n LEFT JOIN lines l ON n.conv_id = l.conv_id AND n.i = l.i AND letter <> 'I' WHERE letter <> 'D'),
        turns AS (SELECT *, count(*) FILTER (NOT opening) OVER (PARTITION BY conv_id ORDER BY pos) % 2 AS odd FROM joined),
        repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS text
            FROM turns GROUP BY 1)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults USING (conv_id) LEFT JOIN cheapest USING (conv_id) LEFT JOIN repaired USING (conv_id)
    """,
    "op13_spelling_variants": f"""
        WITH RECURSIVE {_CRC},
        runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2),
        hashed AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, polynomial),
        written AS (SELECT CASE WHEN h % {spelling.DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
        words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= {spelling.LETTERS} GROUP BY 1 HAVING sum(n) >= {spelling.OCCURRENCES}),
        shorter AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS part FROM words, unnest(range(1, length(word) + 1)) AS t(k)),
        near AS (SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.part = b.part AND a.k = b.k AND a.word <> b.word
            UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.part = w.word UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.part = w.word),
        ranked AS (SELECT near.word, count(*) AS n_near, min({{'n': -w.n, 'word': other}}) AS best FROM near JOIN words w ON w.word = other GROUP BY 1),
        forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= {spelling.RATIO} * n THEN best.word END AS form, CASE WHEN -best.n >= {spelling.RATIO} * n THEN -best.n END AS form_n
            FROM words w LEFT JOIN ranked r ON w.word = r.word),
        chain(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms l ON l.word = c.root AND l.form IS NULL
    """,
}
