"""SQL over the same tables, giving the same columns as ``spark_queries``.

Written from the definitions, not from the Spark plans: windows where Spark
uses arithmetic on row numbers, grids by join where Spark adds rows of zeros.
"""

from __future__ import annotations

from scoreloom.registry import datasets as D
from scoreloom.registry.patterns import pattern_model
from scoreloom.functions import updates
from scoreloom.model import WEIGHT_NAMES
from scoreloom.operators.sharding import ROWS_PER_SHARD
from scoreloom.operators import training
from scoreloom.registry.spark_queries import BATCH, BATCH_SHARDS, CLASS_LISTS, EPOCH_STEPS, EPOCHS, MANY_SHARDS, RATE, SHARDS, SHUFFLED_EPOCHS


def _count(table: str, at_least: int, rows_per_shard: int = ROWS_PER_SHARD) -> str:
    return f"(SELECT greatest({at_least}, (count(*) + {rows_per_shard - 1}) // {rows_per_shard})::BIGINT FROM {table})"


def _spread(row_id: str, n) -> str:
    return f"(((({row_id} % 2147483648) * 1327217885 % 2147483648) * {n}) >> 31)::INTEGER"


def _dot(vector: str, row) -> str:
    return f"list_dot_product({vector}, [{', '.join(repr(float(w)) for w in row)}]::DOUBLE[])"


def _layer(vector: str, matrix) -> str:
    return "[" + ", ".join(_dot(vector, row) for row in matrix) + "]"


def _scored(source: str, model, name: str = "scored") -> str:
    """CTEs from ``source`` (with ``x`` DOUBLE[] and ``label``) to ``name`` with logits, pred, loss, p."""
    w_p, w_z, w_n, w_c = model.used_blocks()
    hidden = ", ".join(
        f"(1 - 1 / (1 + exp(-{_dot('proj', z)}))) * tanh({_dot('proj', n)})" for z, n in zip(w_z, w_n)
    )
    return f"""
{name}_p AS (SELECT *, {_layer('x', w_p)} AS proj FROM {source}),
{name}_h AS (SELECT *, [{hidden}] AS hid FROM {name}_p),
{name}_l AS (SELECT *, {_layer('hid', w_c)} AS logits FROM {name}_h),
{name}_e AS (SELECT *, list_max(logits) AS top,
    list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))) AS total FROM {name}_l),
{name} AS (SELECT *, (list_position(logits, top) - 1)::INTEGER AS pred,
    ln(total) + top - logits[label + 1] AS loss,
    list_transform(logits, lambda v: exp(v - top) / total) AS p FROM {name}_e)"""


PLACED = "(SELECT *, row_number() OVER () - 1 AS row_id FROM embeddings)"
EMB = f"emb AS (SELECT row_id, vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM {PLACED})"
EMB_W = f"""counted AS (SELECT label AS k, count(*) AS n FROM embeddings GROUP BY label),
emb AS (SELECT row_id, vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x,
    (SELECT count(*) FROM embeddings) / (10.0 * n) AS weight
  FROM {PLACED} JOIN counted ON label = k)"""
EMB_SCORED = EMB + "," + _scored("emb", D.EMBEDDING_MODEL)

_STATS = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(D.LINEITEM_COLUMNS))
_SCALED = ", ".join(f"(({c} - m{i}) / s{i})::FLOAT::DOUBLE" for i, c in enumerate(D.LINEITEM_COLUMNS))
LINE = f"""stats AS (SELECT {_STATS} FROM lineitem),
flags AS (SELECT l_returnflag AS class_name, count(*) AS n,
    (row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1)::INTEGER AS label
  FROM lineitem GROUP BY l_returnflag),
line AS (SELECT f.label, [{_SCALED}] AS x FROM lineitem, stats, flags f WHERE l_returnflag = class_name)"""
LINE_SCORED = LINE + "," + _scored("line", D.LINEITEM_MODEL)


def _report(truth: str, classes: str, name: str = "report", by: str | None = None, groups: str | None = None) -> str:
    """CTE ``name``: report of ``truth`` (label, pred[, by]) over ``classes`` (label, class_name)."""
    g, same = (f"{by}, ", f"AND t.{by} = c.{by}") if by else ("", "")
    source = f"(SELECT * FROM {classes}, {groups})" if by else classes
    return f"""
{name}_s AS (SELECT {('c.' + by + ',') if by else ''} c.label, c.class_name,
    count(*) FILTER (t.label = c.label) AS support,
    count(*) FILTER (t.pred = c.label) AS predicted,
    count(*) FILTER (t.pred = c.label AND t.label = c.label) AS tp
  FROM {source} c LEFT JOIN {truth} t ON (t.label = c.label OR t.pred = c.label) {same}
  GROUP BY ALL),
{name} AS (SELECT {g}label, class_name,
    CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
    CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0.0 END AS f1,
    support FROM {name}_s)"""


def _averages(report: str = "report", name: str = "averages", by: str | None = None) -> str:
    g, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    weighted = "sum({0} * support) / sum(support)"
    return f"""
{name} AS (
  SELECT {g}'accuracy' AS class_name, {weighted.format('recall')} AS precision,
    {weighted.format('recall')} AS recall, {weighted.format('recall')} AS f1, sum(support)::BIGINT AS support
  FROM {report} {group}
  UNION ALL SELECT {g}'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM {report} {group}
  UNION ALL SELECT {g}'weighted avg', {weighted.format('precision')}, {weighted.format('recall')},
    {weighted.format('f1')}, sum(support)::BIGINT FROM {report} {group})"""


R6_REPORT = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support"
EMB_CLASSES = "classes AS (SELECT i::INTEGER AS label, 'class_' || i AS class_name FROM range(10) t(i))"


def _spell(array: str, size: int, prefix: str) -> str:
    return ", ".join(f"round({array}[{i + 1}]::DOUBLE, 6) AS {prefix}{i}" for i in range(size))


def _split(key: str) -> str:
    return f"CASE WHEN {key} % 10 < 7 THEN 'train' WHEN {key} % 10 = 7 THEN 'val' ELSE 'test' END"


def _manifest(numbered: str, n) -> str:
    return f"""
slots AS (SELECT i::INTEGER AS shard FROM range({n}) t(i)),
held AS (SELECT {_spread('row_id', n)} AS shard, count(*) AS n_rows FROM ({numbered}) GROUP BY 1),
manifest AS (SELECT shard, coalesce(n_rows, 0) AS n_rows FROM slots LEFT JOIN held USING (shard))"""


LINE_ROWS = "SELECT row_number() OVER () - 1 AS row_id FROM lineitem"
EMB_ROWS = "SELECT row_number() OVER () - 1 AS row_id FROM embeddings"
EMB_SHARD = _spread("row_id", _count("embeddings", SHARDS))
BATCHED = f"""placed AS (SELECT *, {_spread('row_id', _count('embeddings', BATCH_SHARDS))} AS shard FROM emb),
batched AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY row_id) - 1) // {BATCH} AS batch_id FROM placed)"""
EVENT_LABELS = """kinds AS (SELECT event_type, count(*) AS n,
    (row_number() OVER (ORDER BY count(*) DESC, event_type) - 1)::INTEGER AS label
  FROM events GROUP BY event_type)"""
HISTORY = """history AS (SELECT l_returnflag AS run_id,
    ((year(l_shipdate) - 1992) * 12 + month(l_shipdate))::INTEGER AS epoch,
    avg(l_tax) AS train_loss, avg(l_discount) AS train_acc, avg(l_extendedprice / 1e5) AS val_loss,
    (sum(l_quantity::BIGINT)::BIGINT * 2 // count(*)) / 100.0::DOUBLE AS val_acc,
    count(*)::DOUBLE AS train_s, sum(l_quantity)::DOUBLE AS val_s
  FROM lineitem GROUP BY 1, 2)"""
DAMAGED = f"""damaged AS (SELECT
    CASE WHEN l_linenumber <> 6 THEN [{', '.join(D.LINEITEM_COLUMNS)}] END AS features,
    CASE WHEN l_quantity = 13 THEN 'nan'::DOUBLE WHEN l_quantity = 17 THEN 'inf'::DOUBLE
      WHEN l_quantity = 19 THEN NULL ELSE l_quantity / 10 END AS label,
    CASE WHEN l_tax <> 0.05 THEN l_tax END AS weight FROM lineitem),
judged AS (SELECT *, CASE WHEN features IS NULL THEN 'null_features' WHEN label IS NULL THEN 'null_label'
    WHEN isnan(label) OR isinf(label) THEN 'bad_label' WHEN weight IS NULL THEN 'null_weight' ELSE 'ok' END AS reason
  FROM damaged)"""


def _gradient() -> str:
    """Every weight's gradient by the chain rule, one row per training row and weight, then summed."""
    model = D.EMBEDDING_MODEL
    w_p, w_z, w_n, w_c = model.used_blocks()
    hidden, features = w_p.shape
    classes = len(w_c)
    keep = ", ".join(f"1 - 1 / (1 + exp(-{_dot('proj', z)}))" for z in w_z)
    cand = ", ".join(f"tanh({_dot('proj', n)})" for n in w_n)
    d_logits = ", ".join(f"weight * (p[{c + 1}] - (label = {c})::INTEGER)" for c in range(classes))
    d_h = _layer("d_logits", w_c.T)
    d_update = ", ".join(f"-d_h[{i}] * cand[{i}] * keep[{i}] * (1 - keep[{i}])" for i in range(1, hidden + 1))
    d_cand = ", ".join(f"d_h[{i}] * keep[{i}] * (1 - cand[{i}] * cand[{i}])" for i in range(1, hidden + 1))
    d_p = ", ".join(f"{_dot('d_update', w_z[:, i])} + {_dot('d_cand', w_n[:, i])}" for i in range(hidden))

    def outer(name: str, left: str, right: str, rows: int, cols: int, first: int = 0) -> str:
        return f"""SELECT '{name}' AS name, (i + {first})::INTEGER AS row, j::INTEGER AS col,
  sum({left}[i + 1] * {right}[j + 1]) / count(*) AS value
  FROM chain, range({rows}) a(i), range({cols}) b(j) GROUP BY ALL"""

    def zeros(name: str, rows: int, cols: int) -> str:
        return f"SELECT '{name}', i::INTEGER, j::INTEGER, 0.0::DOUBLE FROM range({rows}) a(i), range({cols}) b(j)"

    return f"""WITH {EMB_W},{_scored('emb', model)},
c1 AS (SELECT *, [{keep}] AS keep, [{cand}] AS cand, [{d_logits}] AS d_logits FROM scored),
c2 AS (SELECT *, {d_h} AS d_h FROM c1),
c3 AS (SELECT *, [{d_update}] AS d_update, [{d_cand}] AS d_cand FROM c2),
chain AS (SELECT *, [{d_p}] AS d_p FROM c3),
every AS (
  {outer('classifier', 'd_logits', 'hid', classes, hidden)}
  UNION ALL {outer('gru_input', 'd_update', 'proj', hidden, hidden, hidden)}
  UNION ALL {outer('gru_input', 'd_cand', 'proj', hidden, hidden, 2 * hidden)}
  UNION ALL {outer('input_projection', 'd_p', 'x', hidden, features)}
  UNION ALL {zeros('gru_input', hidden, hidden)}
  UNION ALL {zeros('gru_hidden', 3 * hidden, hidden)})
SELECT name, row, col, round(value, 7) AS value FROM every"""


def _model_columns(params: str) -> str:
    """The matrices that reach the output, as lists of rows, from a table ``(name, row, col, param)``."""

    def rows(name: str, low: str = "0", high: str = "1000000000") -> str:
        return f"""(SELECT list(r ORDER BY row) FROM (SELECT row, list(param ORDER BY col) AS r FROM {params}
      WHERE name = '{name}' AND row >= {low} AND row < {high} GROUP BY row))"""

    h = f"(SELECT count(DISTINCT row) FROM {params} WHERE name = 'input_projection')"
    return f"""{rows('input_projection')} AS w_p, {rows('gru_input', h, f'2 * {h}')} AS w_z,
  {rows('gru_input', f'2 * {h}')} AS w_n, {rows('classifier')} AS w_c"""


def _forward(name: str, source: str, params: str) -> str:
    """CTEs that score ``source(x, label, ...)`` with the weights in ``params``, ending in ``name``."""
    layer = lambda w, v: f"list_transform({w}, lambda r: list_dot_product(r, {v}))"
    return f"""
{name}_w AS MATERIALIZED (SELECT {_model_columns(params)}),
{name}_p AS (SELECT s.*, w.*, {layer('w_p', 'x')} AS proj FROM {source} s, {name}_w w),
{name}_g AS (SELECT *, list_transform({layer('w_z', 'proj')}, lambda a: 1 - 1 / (1 + exp(-a))) AS keep,
    list_transform({layer('w_n', 'proj')}, lambda a: tanh(a)) AS cand FROM {name}_p),
{name}_h AS (SELECT *, list_transform(list_zip(keep, cand), lambda z: z[1] * z[2]) AS hid FROM {name}_g),
{name}_l AS (SELECT *, {layer('w_c', 'hid')} AS logits FROM {name}_h),
{name}_e AS (SELECT *, list_max(logits) AS top, list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))) AS total FROM {name}_l),
{name} AS MATERIALIZED (SELECT *, list_position(logits, top) - 1 AS pred, ln(total) + top - logits[label + 1] AS loss,
    list_transform(logits, lambda v: exp(v - top) / total) AS p FROM {name}_e)"""


def _step(k: int, source: str, shape, rate: float) -> str:
    """CTEs from ``state{k - 1}`` to ``state{k}``: scores of ``source``, their gradient, clipping and update."""
    f, h, c = shape.num_features, shape.hidden_size, shape.num_classes
    name, before = f"step{k}", f"state{k - 1}"

    def outer(block: str, left: str, right: str, rows: int, cols: int, first: int = 0) -> str:
        return f"""SELECT '{block}' AS name, i + {first} AS row, j AS col, sum({left}[i + 1] * {right}[j + 1]) / count(*) AS g
    FROM {name}_c, range({rows}) a(i), range({cols}) b(j) GROUP BY ALL"""

    b1, b2, eps = updates.BETA1, updates.BETA2, updates.EPSILON
    back = lambda w, d: f"list_transform(range(1, {h} + 1), lambda i: list_dot_product(list_transform({w}, lambda r: r[i]), {d}))"
    return f"""{_forward(name, source, before)},
{name}_a AS (SELECT *, list_transform(range(1, {c} + 1), lambda i: weight * (p[i] - (label = i - 1)::INTEGER)) AS d_logits FROM {name}),
{name}_b AS (SELECT *, {back('w_c', 'd_logits')} AS d_h FROM {name}_a),
{name}_d AS (SELECT *, list_transform(range(1, {h} + 1), lambda i: -d_h[i] * cand[i] * keep[i] * (1 - keep[i])) AS d_update,
    list_transform(range(1, {h} + 1), lambda i: d_h[i] * keep[i] * (1 - cand[i] * cand[i])) AS d_cand FROM {name}_b),
{name}_c AS MATERIALIZED (SELECT x, proj, hid, d_logits, d_update, d_cand, list_transform(list_zip({back('w_z', 'd_update')}, {back('w_n', 'd_cand')}),
    lambda z: z[1] + z[2]) AS d_p FROM {name}_d),
{name}_g2 AS ({outer('classifier', 'd_logits', 'hid', c, h)}
  UNION ALL {outer('gru_input', 'd_update', 'proj', h, h, h)}
  UNION ALL {outer('gru_input', 'd_cand', 'proj', h, h, 2 * h)}
  UNION ALL {outer('input_projection', 'd_p', 'x', h, f)}),
{name}_n AS MATERIALIZED (SELECT *, least(1.0, {updates.CLIP_NORM} / (sqrt((SELECT sum(g * g) FROM {name}_g2)) + {updates.CLIP_EPSILON})) AS clip FROM {name}_g2),
{name}_m AS (SELECT s.name, s.row, s.col, s.param, {b1} * mean + {1 - b1} * coalesce(g * clip, 0) AS mean,
    {b2} * var + {1 - b2} * coalesce(g * clip, 0) * coalesce(g * clip, 0) AS var
  FROM {before} s LEFT JOIN {name}_n n ON s.name = n.name AND s.row = n.row AND s.col = n.col),
state{k} AS MATERIALIZED (SELECT name, row, col, param * {1 - rate * updates.WEIGHT_DECAY}
    - {rate} * (mean / {1 - b1**k}) / (sqrt(var / {1 - b2**k}) + {eps}) AS param, mean, var FROM {name}_m)"""


def _start(model) -> str:
    """CTE ``state0``: the weights of a model, without momentum."""
    values = ", ".join(
        f"('{name}', {i}, {j}, {float(v)!r})"
        for name in WEIGHT_NAMES
        for i, row in enumerate(model.weights[name].tolist())
        for j, v in enumerate(row)
    )
    return f"""state0 AS MATERIALIZED (SELECT name, row::BIGINT AS row, col::BIGINT AS col, param::DOUBLE AS param, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS var
  FROM (VALUES {values}) v(name, row, col, param))"""


def _run() -> str:
    """CTEs of ``EPOCHS`` steps over the training rows with validation after each, ending in ``history``."""
    steps, parts = [], []
    for k in range(1, EPOCHS + 1):
        steps += [_step(k, "train_rows", D.EMBEDDING_SHAPE, RATE), _forward(f"val{k}", "val_rows", f"state{k}")]
        parts.append(
            f"""SELECT {k}::INTEGER AS epoch, (SELECT avg(loss * weight) FROM step{k}) AS train_loss,
  (SELECT avg((pred = label)::INTEGER) FROM step{k}) AS train_acc, (SELECT avg(loss) FROM val{k}) AS val_loss,
  (SELECT avg((pred = label)::INTEGER) FROM val{k}) AS val_acc"""
        )
    return f"""{EMB_W},
train_rows AS MATERIALIZED (SELECT * FROM emb WHERE vec_id % 10 < 7), val_rows AS MATERIALIZED (SELECT * FROM emb WHERE vec_id % 10 = 7),
{_start(D.EMBEDDING_MODEL)},{','.join(steps)},
history AS MATERIALIZED ({' UNION ALL '.join(parts)}),
best AS (SELECT epoch, val_acc FROM history WHERE val_acc > 0 ORDER BY val_acc DESC, epoch LIMIT 1)"""


_WEIGHTS = "SELECT name, row::INTEGER AS row, col::INTEGER AS col, round(param, 6) AS value FROM"


def _blocks(epoch: int, num_blocks: int) -> str:
    """Place of every block in an epoch's order, seed 0: by the fifth power of the shifted number modulo a prime."""
    prime, shift = training.ORDER_PRIME, training.order_shift(epoch, 0)
    return f"""SELECT block, row_number() OVER (ORDER BY square * square % {prime} * x % {prime}, block) - 1 AS pos
  FROM (SELECT *, x * x % {prime} AS square FROM (SELECT b::INTEGER AS block, (b + {shift}) % {prime} AS x FROM range({num_blocks}) t(b)))"""


def _epoch() -> str:
    """Steps over ``lineitem``, each on the blocks that its epoch's order names."""
    shape, blocks, size = D.LINEITEM_SHAPE, EPOCH_STEPS * training.BLOCKS_PER_BATCH, training.BLOCKS_PER_BATCH
    orders = [f"order{e} AS ({_blocks(e, blocks)})" for e in range(1, SHUFFLED_EPOCHS + 1)]
    steps = []
    for k in range(SHUFFLED_EPOCHS * EPOCH_STEPS):
        epoch, step = k // EPOCH_STEPS + 1, k % EPOCH_STEPS
        rows = f"rows{k + 1} AS MATERIALIZED (SELECT p.* FROM placed p JOIN order{epoch} o ON p.block = o.block WHERE pos // {size} = {step})"
        steps.append(f"{rows},{_step(k + 1, f'rows{k + 1}', shape, RATE)}")
    return f"""WITH stats AS (SELECT {_STATS} FROM lineitem),
flags AS (SELECT l_returnflag AS class_name, count(*) AS n,
    (row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1)::INTEGER AS label FROM lineitem GROUP BY l_returnflag),
placed AS MATERIALIZED (SELECT f.label, [{_SCALED}] AS x, (SELECT count(*) FROM lineitem) / (3.0 * n) AS weight, {_spread('row_id', blocks)} AS block
  FROM (SELECT *, row_number() OVER () - 1 AS row_id FROM lineitem), stats, flags f WHERE l_returnflag = class_name),
{','.join(orders)},
{_start(D.LINEITEM_MODEL)},{','.join(steps)}
{_WEIGHTS} state{SHUFFLED_EPOCHS * EPOCH_STEPS}"""


def _performance() -> str:
    values = "UNION ALL ".join(
        f"SELECT 'report' AS section, class_name AS name, '{m}' AS metric, {m}::DOUBLE AS value FROM {t} "
        for t in ("report", "averages")
        for m in ("precision", "recall", "f1", "support")
    )
    return f"""WITH {LINE_SCORED},{_report('scored', 'flags')},{_averages()},
cells AS (SELECT a.label, b.label AS pred, (SELECT count(*) FROM scored s WHERE s.label = a.label AND s.pred = b.label) AS n
  FROM flags a, flags b),
every AS (
  SELECT 'overall' AS section, 'all' AS name, 'accuracy' AS metric, avg((label = pred)::INTEGER)::DOUBLE AS value FROM scored
  UNION ALL SELECT 'overall', 'all', 'loss', avg(loss) FROM scored
  UNION ALL SELECT 'overall', 'all', 'total_samples', count(*)::DOUBLE FROM scored
  UNION ALL {values}
  UNION ALL SELECT 'confusion', label::VARCHAR, pred::VARCHAR, n::DOUBLE FROM cells WHERE n > 0)
SELECT section, name, metric, round(value, 6) AS value FROM every"""


def _comparison() -> str:
    parts = ",".join(
        _scored("line", pattern_model(D.LINEITEM_SHAPE, shift), name) for name, shift in D.LINEITEM_SHIFTS.items()
    )
    stacked = " UNION ALL ".join(f"SELECT '{m}' AS model, label, pred, loss FROM {m}" for m in D.LINEITEM_SHIFTS)
    models = ", ".join(f"('{m}')" for m in D.LINEITEM_SHIFTS)
    columns = ", ".join(f"round(max(value) FILTER (model = '{m}'), 6) AS {m}" for m in D.LINEITEM_SHIFTS)
    averaged = " UNION ALL ".join(
        f"SELECT model, class_name || '_{shown}' AS metric, {c} AS value FROM averages WHERE class_name <> 'accuracy'"
        for shown, c in (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1"))
    )
    return f"""WITH {LINE},{parts},
stacked AS ({stacked}),
names AS (SELECT * FROM (VALUES {models}) v(model)),{_report('stacked', 'flags', by='model', groups='names')},
{_averages(by='model')},
every AS (
  SELECT model, 'accuracy' AS metric, avg((label = pred)::INTEGER)::DOUBLE AS value FROM stacked GROUP BY model
  UNION ALL SELECT model, 'loss', avg(loss) FROM stacked GROUP BY model
  UNION ALL {averaged})
SELECT metric, {columns} FROM every GROUP BY metric"""


def _listed() -> str:
    """CTEs to ``report`` of two results over ``lineitem``, each over the names of its own list."""
    known = ", ".join(f"('{model}', '{name}')" for model, names in CLASS_LISTS.items() for name in names)
    return f"""stacked AS (SELECT 'flags' AS model, l_returnflag AS truth, {CLASS_LISTS['flags']}[l_linenumber % 3 + 1] AS guess, l_tax AS loss FROM lineitem
  UNION ALL SELECT 'mixed', CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_linestatus END,
    CASE WHEN l_quantity < 25 THEN l_linestatus ELSE l_returnflag END, l_discount FROM lineitem WHERE l_linenumber < 6),
known AS (SELECT * FROM (VALUES {known}) v(model, class_name)),
sums AS (SELECT k.model, class_name, count(truth) FILTER (truth = class_name) AS support, count(truth) FILTER (guess = class_name) AS predicted,
    count(truth) FILTER (truth = class_name AND guess = class_name) AS tp
  FROM known k LEFT JOIN stacked s ON s.model = k.model AND (truth = class_name OR guess = class_name) GROUP BY 1, 2),
report AS (SELECT model, class_name, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
    CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0.0 END AS f1, support FROM sums)"""


def _class_lists() -> str:
    columns = ", ".join(f"round(max(value) FILTER (model = '{m}'), 6) AS {m}" for m in CLASS_LISTS)
    averaged = " UNION ALL ".join(
        f"SELECT model, class_name || '_{shown}' AS metric, {c} AS value FROM averages WHERE class_name <> 'accuracy'"
        for shown, c in (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1"))
    )
    return f"""WITH {_listed()},{_averages(by='model')},
every AS (SELECT model, 'accuracy' AS metric, avg((truth = guess)::INTEGER)::DOUBLE AS value FROM stacked GROUP BY model
  UNION ALL SELECT model, 'loss', avg(loss) FROM stacked GROUP BY model UNION ALL {averaged})
SELECT metric, {columns} FROM every GROUP BY metric"""


def _classes() -> str:
    union = list(dict.fromkeys(name for names in CLASS_LISTS.values() for name in names))
    columns = ", ".join(f"round(max(value) FILTER (model = '{m}'), 6) AS {m}" for m in CLASS_LISTS)
    parts = " UNION ALL ".join(
        f"SELECT model, class_name, '{shown}' AS metric, {c}::DOUBLE AS value FROM report"
        for shown, c in (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1"), ("support", "support"))
    )
    return f"""WITH {_listed()} SELECT (list_position({union}, class_name) - 1)::INTEGER AS label, class_name, metric, {columns}
FROM ({parts}) GROUP BY class_name, metric"""


_MOMENTS = "SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM (SELECT unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY i"


_DATA_SHAPE = """shape AS (SELECT max(len(embedding)) AS f, count(DISTINCT label) AS c, 16 AS h FROM embeddings)"""
_CLASS_REPORT = f"""WITH {EMB_SCORED}, {EMB_CLASSES},{_report('scored', 'classes')}
SELECT label, class_name, {R6_REPORT} FROM report"""
_KEPT = "batch_id, count(*) AS n_rows, min(vec_id) AS first_key, max(vec_id) AS last_key FROM batched GROUP BY shard, batch_id"

ORACLE = {
    "scan_features": f"SELECT vec_id, label, 1.0::DOUBLE AS weight, {_spell('embedding', 64, 'f')} FROM embeddings",
    "label_dictionary": f"WITH {EVENT_LABELS} SELECT label, event_type AS class_name FROM kinds",
    "feature_width": """SELECT min(len(embedding))::INTEGER AS min_width, max(len(embedding))::INTEGER AS max_width,
  first(len(embedding))::INTEGER AS first_width FROM embeddings""",
    "scan_split": f"""SELECT {_split('vec_id')} AS split, label, count(*) AS n_rows, sum(vec_id)::BIGINT AS key_sum,
  round(sum(embedding[1]::DOUBLE), 6) AS f0_sum FROM embeddings GROUP BY 1, 2""",
    "write_shards": f"""SELECT {EMB_SHARD} AS shard, count(*) AS n_rows, sum(vec_id)::BIGINT AS key_sum,
  sum(label)::BIGINT AS label_sum, round(sum(embedding[64]::DOUBLE), 6) AS f63_sum FROM {PLACED} GROUP BY 1""",
    "read_shard": f"SELECT {EMB_SHARD} AS shard, vec_id, label, {_spell('embedding', 4, 'f')} FROM {PLACED}",
    "report_sink": _CLASS_REPORT,
    "model_sink": f"""WITH {_run()}, kept AS ({' UNION ALL '.join(
        f"SELECT {k} AS epoch, * FROM state{k}" for k in range(1, EPOCHS + 1))})
{_WEIGHTS} kept JOIN best USING (epoch)""",
    "model_source": f"WITH {EMB_SCORED} SELECT vec_id, pred, round(loss, 6) AS loss FROM scored",
    "prediction_sink": f"""WITH {EMB_SCORED}
SELECT vec_id, label, pred, round(loss, 6) AS loss, {_spell('p', 10, 'p')} FROM scored""",
    "prepare_shards": f"WITH {_manifest(LINE_ROWS, _count('lineitem', SHARDS))} SELECT * FROM manifest",
    "vector_to_array": f"SELECT vec_id, {_spell('embedding', 64, 'f')} FROM embeddings",
    "to_sample": f"""SELECT l_orderkey, l_linenumber, trunc(l_quantity / 7)::INTEGER AS label,
  l_discount AS weight, {', '.join(f'{c}::FLOAT::DOUBLE AS f{i}' for i, c in enumerate(D.LINEITEM_COLUMNS))}
  FROM lineitem""",
    "drop_malformed": f"""WITH {DAMAGED} SELECT trunc(label)::INTEGER AS label, count(*) AS n_rows,
  round(sum(weight), 6) AS weight_sum FROM judged WHERE reason = 'ok' GROUP BY 1""",
    "reject_counts": f"WITH {DAMAGED} SELECT reason, count(*) AS n FROM judged GROUP BY reason",
    "drop_empty_shards": f"WITH {_manifest(EMB_ROWS, MANY_SHARDS)} SELECT * FROM manifest WHERE n_rows > 0",
    "shard_id_from_path": f"SELECT {EMB_SHARD} AS shard, count(*) AS n_rows FROM {PLACED} GROUP BY 1",
    "run_stamp": """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp,
  event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS output_dir FROM events""",
    "format_metric": """SELECT l_orderkey, l_linenumber, printf('%.4f', l_discount * l_tax) AS rate_4,
  printf('%.2f', l_extendedprice / l_quantity) AS price_2 FROM lineitem""",
    "repartition_shards": f"""SELECT vec_id, {EMB_SHARD} AS shard,
  {EMB_SHARD} AS partition FROM {PLACED}""",
    "shard_manifest": f"WITH {_manifest(LINE_ROWS, MANY_SHARDS)} SELECT * FROM manifest",
    "minibatches": f"WITH {EMB}, {BATCHED} SELECT shard, {_KEPT}",
    "minibatches_sliced": f"WITH {EMB}, {BATCHED} SELECT shard, {_KEPT}",
    "minibatches_shuffled": f"""WITH {EMB}, {BATCHED}
SELECT shard, batch_id, count(*) AS n_rows FROM batched GROUP BY shard, batch_id""",
    "shard_totals": f"""WITH held AS (SELECT {_split('vec_id')} AS split, {_spread('row_id', MANY_SHARDS)} AS shard, count(*) AS n
  FROM {PLACED} GROUP BY 1, 2)
SELECT split, sum(n)::BIGINT AS total_rows, count(*) AS valid_shards, {MANY_SHARDS}::BIGINT AS num_shards
FROM held GROUP BY split""",
    "data_statistics": f"""WITH {EVENT_LABELS} SELECT (SELECT count(*) FROM events) AS total_samples,
  (SELECT count(*) FROM kinds) AS num_classes, label, n FROM kinds""",
    "class_distribution": """SELECT 'class_' || i AS class_name, count(label) AS n
FROM range(12) t(i) LEFT JOIN embeddings ON label = i GROUP BY i""",
    "mean_loss": f"WITH {LINE_SCORED} SELECT round(avg(loss), 6) AS loss FROM scored",
    "weighted_loss": f"""WITH {EMB_W}, {BATCHED},{_scored('batched', D.EMBEDDING_MODEL)}
SELECT shard, batch_id, round(avg(loss * weight), 6) AS weighted_loss FROM scored GROUP BY shard, batch_id""",
    "accuracy": f"WITH {LINE_SCORED} SELECT round(avg((label = pred)::INTEGER), 6) AS accuracy FROM scored",
    "confusion_counts": f"""WITH {EMB_SCORED}, {EMB_CLASSES}
SELECT a.label, b.label AS pred, count(s.label) AS n FROM classes a CROSS JOIN classes b
LEFT JOIN scored s ON s.label = a.label AND s.pred = b.label GROUP BY 1, 2""",
    "confusion_wide": f"""WITH {LINE_SCORED} SELECT f.label, {', '.join(
        f'count(*) FILTER (pred = {k}) AS pred_{k}' for k in range(3))} FROM flags f LEFT JOIN scored s USING (label) GROUP BY 1""",
    "confusion_pairs": f"""WITH {EMB_SCORED}, seen AS (SELECT label, pred, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT label, 'class_' || label AS label_name, pred, 'class_' || pred AS pred_name, n, (sum(n) OVER (PARTITION BY label))::BIGINT AS label_total,
  (sum(n) OVER (PARTITION BY pred))::BIGINT AS pred_total, round(100.0 * n / sum(n) OVER (PARTITION BY label), 6)::DOUBLE AS pct FROM seen""",
    "compare_class_lists": _class_lists(),
    "compare_classes": _classes(),
    "scale_vectors": f"""WITH moments AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM ({_MOMENTS}))
SELECT vec_id, {', '.join(f"round((embedding[{i + 1}]::DOUBLE - m[{i + 1}]) / s[{i + 1}], 6) AS z{i}" for i in range(64))} FROM embeddings, moments""",
    "confusion_percent": """WITH cells AS (SELECT a.i::INTEGER AS label, b.i::INTEGER AS pred, count(quality) AS n
  FROM range(3) a(i) CROSS JOIN range(3) b(i) LEFT JOIN labels ON quality = a.i AND toxic = b.i GROUP BY 1, 2)
SELECT label, pred, n, round(100.0 * n / nullif(sum(n) OVER (PARTITION BY label), 0), 6)::DOUBLE AS pct FROM cells""",
    "class_report": _CLASS_REPORT,
    "report_averages": f"""WITH pairs AS (SELECT quality AS label, toxic AS pred FROM labels),
classes AS (SELECT * FROM (VALUES (0, 'low'), (1, 'high'), (2, 'never')) v(label, class_name)),
{_report('pairs', 'classes')},{_averages()} SELECT class_name, {R6_REPORT} FROM averages""",
    "report_full": f"""WITH {LINE_SCORED},{_report('scored', 'flags')},{_averages()},
both_ AS (SELECT class_name, precision, recall, f1, support FROM report
  UNION ALL SELECT class_name, precision, recall, f1, support FROM averages)
SELECT class_name, {R6_REPORT}, (SELECT count(*) FROM lineitem) AS total_samples,
  (SELECT count(*) FROM flags)::INTEGER AS num_classes FROM both_""",
    "evaluate_performance": _performance(),
    "compare_models": _comparison(),
    "compare_results": _comparison(),
    "experiment_summary": """WITH trained AS (SELECT o_orderstatus AS run_id, count(*)::DOUBLE AS seconds,
    max(o_totalprice) AS best FROM orders GROUP BY 1),
evaluated AS (SELECT l_linestatus AS run_id, max(l_discount) AS acc, max(l_extendedprice) AS loss FROM lineitem GROUP BY 1)
SELECT t.run_id AS run_timestamp, 'local' AS mode, 1::INTEGER AS num_shards, 4::INTEGER AS num_features,
  3::INTEGER AS num_classes, 64::INTEGER AS hidden_size, 512::INTEGER AS batch_size, 3::INTEGER AS epochs,
  0.2::DOUBLE AS dropout, 0.002::DOUBLE AS learning_rate,
  CASE WHEN e.run_id IS NULL THEN 'TRAINED' ELSE 'SUCCESS' END AS status,
  seconds AS total_training_time, best AS best_validation_accuracy, acc AS test_accuracy, loss AS test_loss
FROM trained t LEFT JOIN evaluated e ON t.run_id = e.run_id""",
    "epoch_history": f"""WITH {HISTORY} SELECT run_id, (count(*) OVER (PARTITION BY run_id))::INTEGER AS epochs,
  (row_number() OVER (PARTITION BY run_id ORDER BY epoch) - 1)::INTEGER AS pos, round(train_loss, 6) AS train_loss,
  round(train_acc, 6) AS train_acc, round(val_loss, 6) AS val_loss, round(val_acc, 6) AS val_acc FROM history""",
    "best_epoch": f"""WITH {HISTORY}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id
    ORDER BY val_acc DESC, epoch) AS rn FROM history WHERE val_acc > 0)
SELECT run_id, epoch, val_acc FROM ranked WHERE rn = 1""",
    "improved_epochs": f"""WITH {HISTORY} SELECT run_id, epoch, val_acc, val_acc > greatest(coalesce(max(val_acc) OVER
    (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS improved FROM history""",
    "history_snapshots": f"""WITH {HISTORY}, lasts AS (SELECT run_id, max(epoch) AS last FROM history GROUP BY run_id)
SELECT run_id, epoch, val_acc, train_s FROM history JOIN lasts USING (run_id) WHERE epoch % 10 = 0 OR epoch = last""",
    "score_logits": f"WITH {EMB_SCORED} SELECT vec_id, {_spell('logits', 10, 'l')} FROM scored",
    "predict_class": f"WITH {EMB_SCORED} SELECT vec_id, pred FROM scored",
    "softmax_probs": f"WITH {EMB_SCORED} SELECT vec_id, {_spell('p', 10, 'p')} FROM scored",
    "cross_entropy": f"WITH {EMB_SCORED} SELECT vec_id, round(loss, 6) AS loss FROM scored",
    "evaluate_test": _CLASS_REPORT,
    "train_epoch": _epoch(),
    "train_model": f"""WITH {_run()} SELECT 'run' AS run_id, epoch, round(train_loss, 6) AS train_loss,
  round(train_acc, 6) AS train_acc, round(val_loss, 6) AS val_loss, round(val_acc, 6) AS val_acc FROM history""",
    "batch_gradient": _gradient(),
    "run_status": f"""WITH {_run()}, {_manifest("SELECT row_id FROM train_rows", MANY_SHARDS)}
SELECT shard, CASE WHEN n_rows = 0 THEN 'NO_DATA' ELSE 'SUCCESS' END AS status,
  CASE WHEN n_rows > 0 AND shard = 0 THEN round((SELECT val_acc FROM best), 6) ELSE 0.0 END::DOUBLE AS best_val_acc FROM manifest""",
    "model_info": f"""WITH {_DATA_SHAPE}, counted AS (SELECT *, (f * h + 6 * h * h + h * c)::BIGINT AS total FROM shape)
SELECT 'run' AS run_id, 'OptimizedGRUModel' AS model_type, f::INTEGER AS input_size, h::INTEGER AS hidden_size,
  c::INTEGER AS num_classes, 0.2::DOUBLE AS dropout_rate, total AS total_parameters, total AS trainable_parameters FROM counted""",
    "scale_features": f"""WITH stats AS (SELECT {_STATS} FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join(
        f'round(({c} - m{i}) / s{i}, 6) AS z{i}' for i, c in enumerate(D.LINEITEM_COLUMNS))} FROM lineitem, stats""",
    "index_labels": f"WITH {EVENT_LABELS} SELECT event_id, label FROM events JOIN kinds USING (event_type)",
    "class_weights": f"""WITH {LINE} SELECT label, n, round((SELECT count(*) FROM lineitem) / (3.0 * n), 6) AS weight FROM flags""",
    "split_rows": f"SELECT event_id, {_split('event_id')} AS split FROM events",
}
