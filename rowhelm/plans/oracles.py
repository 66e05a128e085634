"""The registered queries once more, as plain SQL over the same tables.

They share no code with the operators; small builders spell out one SELECT per column.
"""

from __future__ import annotations

from rowhelm.plans import catalog
from rowhelm.plans.catalog import DRIFT_DAY, DROP_DAY, EVENT_TYPES, NEGATIVE_DAY, NULL_DAY, SHIFT_DAY
from rowhelm.operators.inject import SHIFTED_WEIGHTS
from rowhelm.operators.synth import (
    CATEGORIES,
    CUSTOMERS,
    ITEM_COUNT_WEIGHTS,
    PRICE_RANGES,
    QUANTITY_WEIGHTS,
    STATUS_WEIGHTS,
)
from rowhelm.operators.inject import NORMAL_WEIGHTS

# name -> (kind, bytes per value or None): n number, d datetime, t text
SCHEMAS = {
    "events": {"event_id": ("n", 8), "ts": ("d", 8), "user_id": ("n", 8), "event_type": ("t", None), "value": ("n", 8), "props": ("t", None)},
    "orders": {"o_orderkey": ("n", 8), "o_custkey": ("n", 8), "o_orderstatus": ("t", None), "o_totalprice": ("n", 8), "o_orderdate": ("d", 8), "o_orderpriority": ("t", None)},
    "lineitem": {
        "l_orderkey": ("n", 8), "l_partkey": ("n", 8), "l_suppkey": ("n", 8), "l_linenumber": ("n", 4), "l_quantity": ("n", 8),
        "l_extendedprice": ("n", 8), "l_discount": ("n", 8), "l_tax": ("n", 8), "l_returnflag": ("t", None), "l_linestatus": ("t", None), "l_shipdate": ("d", 8),
    },
    "customer": {"c_custkey": ("n", 8), "c_name": ("t", None), "c_nationkey": ("n", 4), "c_acctbal": ("n", 8), "c_mktsegment": ("t", None)},
    "supplier": {"s_suppkey": ("n", 8), "s_name": ("t", None), "s_nationkey": ("n", 4), "s_acctbal": ("n", 8)},
    "part": {"p_partkey": ("n", 8), "p_name": ("t", None), "p_brand": ("t", None), "p_type": ("t", None), "p_size": ("n", 4), "p_retailprice": ("n", 8)},
    "documents": {"doc_id": ("n", 8), "text": ("t", None), "lang": ("t", None), "source": ("t", None), "n_chars": ("n", 8)},
    "pages": {"page_id": ("n", 8), "url": ("t", None), "html": ("t", None)},
    "conversations": {"conv_id": ("n", 8), "turn": ("n", 8), "role": ("t", None), "text": ("t", None)},
    "embeddings": {"vec_id": ("n", 8), "embedding": ("t", None), "label": ("n", 4)},
}
PLAIN_TEXTS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "documents": ["text", "lang", "source"], "pages": ["url", "html"],
    "benchmark": ["text"], "conversations": ["role", "text"], "embeddings": [], "labels": [],
}
DATES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


def of_kind(schema: dict, kind: str) -> list[str]:
    return [c for c, (k, _) in schema.items() if k == kind]


def fraction(salt: str, *keys: str, seed: int = 42) -> str:
    text = " || '|' || ".join([f"'{seed}|{salt}'", *[f"({k})::varchar" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0::double)"


def weighted(expr: str, values: list[str], weights: list[float]) -> str:
    total, cases = 0.0, []
    for value, weight in zip(values[:-1], weights[:-1]):
        total += weight
        cases.append(f"WHEN {expr} < {round(total, 9)}::double THEN '{value}'")
    return f"CASE {' '.join(cases)} ELSE '{values[-1]}' END"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ---- planted faults ------------------------------------------------------------------

ON = "(ts::date = DATE '{}')"
NULLED_USER = (
    f"CASE WHEN {fraction('null', 'event_id')} < (CASE WHEN {ON.format(NULL_DAY)} THEN 0.2::double "
    "ELSE (day(ts) % 3)::double / 100.0::double END) THEN NULL ELSE user_id END"
)
NEGATED_VALUE = (
    f"CASE WHEN {ON.format(NEGATIVE_DAY)} AND {fraction('negative', 'event_id')} < 0.05::double THEN -abs(value) ELSE value END"
)
SHIFTED_TYPE = (
    f"CASE WHEN {ON.format(SHIFT_DAY)} THEN {weighted(fraction('shift', 'event_id'), EVENT_TYPES, SHIFTED_WEIGHTS)} ELSE event_type END"
)
KEPT = f"(NOT {ON.format(DROP_DAY)} OR {fraction('drop', 'event_id')} < 0.5::double)"

NULLED = f"(SELECT event_id, ts, {NULLED_USER} AS user_id, event_type, value, props FROM events)"
NEGATED = f"(SELECT event_id, ts, user_id, event_type, {NEGATED_VALUE} AS value, props FROM events)"
FAULTY = (
    f"(SELECT event_id, ts, {NULLED_USER} AS user_id, {SHIFTED_TYPE} AS event_type, {NEGATED_VALUE} AS value, props "
    f"FROM events WHERE {KEPT})"
)
BASELINE = f"(SELECT event_id, ts, user_id, event_type, value, props, event_type AS origin FROM events WHERE ts::date < DATE '{DRIFT_DAY}')"
CURRENT = (
    f"(SELECT event_id, ts, CASE WHEN {fraction('null', 'event_id', seed=7)} >= 0.12::double THEN user_id END AS user_id, event_type, "
    f"CASE WHEN {fraction('negative', 'event_id', seed=7)} < 0.05::double THEN -value ELSE value * 1.6::double END AS value, "
    "'k' || (event_id % 60)::varchar AS props, event_type || '/' || (event_id % 3)::varchar AS channel "
    f"FROM events WHERE ts::date >= DATE '{DRIFT_DAY}' AND {fraction('keep', 'event_id', seed=7)} < 0.4::double)"
)
BASELINE_SCHEMA = SCHEMAS["events"] | {"origin": ("t", None)}
CURRENT_SCHEMA = SCHEMAS["events"] | {"channel": ("t", None)}


DESCRIBED = (
    "(SELECT ts, 'an event of the type ' || event_type || ', as the application describes it to group ' || (event_id % 3)::varchar || ' of the users' AS event_type "
    f"FROM {FAULTY} d)"
)


def source(name: str) -> tuple[str, dict]:
    return (FAULTY, SCHEMAS["events"]) if name == "faulty_events" else (name, SCHEMAS[name])


# ---- profiles ------------------------------------------------------------------------

KEY = "CASE WHEN strlen({0}) <= 64 THEN {0} ELSE 'sha256:' || sha256({0}) END"


def column_profiles(src: str, schema: dict) -> str:
    """One row per column with every statistic; those that do not apply are NULL."""
    parts = []
    for position, (c, (kind, _)) in enumerate(schema.items()):
        n, t = kind == "n", kind == "t"
        x = f"({c})::double"

        def when(flag: bool, expr: str, dtype: str) -> str:
            return expr if flag else f"NULL::{dtype}"

        text = f"{c}::varchar"
        top = f"(SELECT {{}} FROM {src} q WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {KEY.format(text)} LIMIT 1)"
        parts.append(
            f"""SELECT {position}::bigint AS position, '{c}' AS "column", count(*) AS "count",
            count(*) - count({c}) AS null_count,
            CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) / count(*) * 100, 2) ELSE 0 END AS null_percent,
            {when(n, f'round(avg({x}), 4)', 'double')} AS mean,
            {when(n, f'round(stddev_samp({x}), 4)', 'double')} AS std,
            {when(n, f'round(min({x}), 4)', 'double')} AS min_value,
            {when(n, f'round(max({x}), 4)', 'double')} AS max_value,
            {when(n, f'round(quantile_cont({x}, 0.25), 4)', 'double')} AS percentile_25,
            {when(n, f'round(quantile_cont({x}, 0.5), 4)', 'double')} AS percentile_50,
            {when(n, f'round(quantile_cont({x}, 0.75), 4)', 'double')} AS percentile_75,
            {when(t, f'count(DISTINCT {c})', 'bigint')} AS unique_count,
            {when(t, f'round(count(DISTINCT {c}) / count({c}) * 100, 2)', 'double')} AS unique_percent,
            {when(t, f'round(sum(length({c}::varchar)) / count({c}), 2)', 'double')} AS avg_length,
            {when(t, top.format(c), 'varchar')} AS top_value,
            {when(t, top.format('count(*)'), 'bigint')} AS top_count,
            {when(kind == 'd', f"date_sub('day', min({c}), max({c}))", 'bigint')} AS date_range_days
            FROM {src} s"""
        )
    return union(parts)


def columns_of(names: list[str], select: str, where: str = "true") -> str:
    parts = []
    for name in names:
        src, schema = source(name)
        parts.append(f"SELECT '{name}' AS dataset, {select} FROM ({column_profiles(src, schema)}) p WHERE {where}")
    return union(parts)


def bytes_of(schema: dict) -> str:
    fixed = sum(w for _, w in schema.values() if w)
    texts = [f"coalesce(sum(strlen({c})), 0)" for c, (_, w) in schema.items() if w is None]
    return f"({' + '.join([f'count(*) * {fixed}', *texts])})::bigint"


def table_profiles(src: str, schema: dict) -> str:
    missing = " + ".join(f"(count(*) - count({c}))" for c in schema)
    columns = ", ".join(schema)
    return f"""SELECT count(*) AS row_count, {len(schema)}::bigint AS column_count, {bytes_of(schema)} AS est_bytes,
        ({missing})::bigint AS total_null_cells, round(({missing}) / (count(*) * {len(schema)}) * 100, 6) AS null_cell_percent,
        (count(*) - (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {src} q)))::bigint AS duplicate_rows
        FROM {src} s"""


def top_of(name: str, column: str) -> str:
    return f"""SELECT '{name}' AS dataset, '{column}' AS "column", rank, value, cnt FROM (
        SELECT {column} AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, {KEY.format(column)}) AS rank
        FROM {name} WHERE {column} IS NOT NULL GROUP BY {column}) WHERE rank <= 5"""


def top_by_value(name: str, column: str) -> str:
    """By the rule: most occurrences first, then the smaller value, however long."""
    return f"""SELECT '{name}' AS dataset, '{column}' AS "column", rank, value, cnt FROM (
        SELECT value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, value) AS rank
        FROM (SELECT {column} AS value FROM {name} WHERE {column} IS NOT NULL) GROUP BY value) WHERE rank <= 5"""


# ---- days and history ----------------------------------------------------------------

PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def volume(src: str, date: str) -> str:
    return f"""SELECT {date}::date AS day, row_number() OVER (ORDER BY {date}::date) - 1 AS day_idx, count(*) AS row_count
        FROM {src} v WHERE {date} IS NOT NULL GROUP BY {date}::date"""


def daily_columns(src: str, date: str, schema: dict) -> str:
    parts = []
    for c, (kind, _) in schema.items():
        if c == date:
            continue
        x = f"({c})::double" if kind == "n" else "NULL::double"
        parts.append(
            f"""SELECT {date}::date AS day, row_number() OVER (ORDER BY {date}::date) - 1 AS day_idx, '{c}' AS "column",
            count(*) - count({c}) AS null_count, (count(*) - count({c})) / count(*) * 100 AS null_rate,
            avg({x}) AS mean, min({x}) AS "min", max({x}) AS "max", stddev_samp({x}) AS std
            FROM {src} c WHERE {date} IS NOT NULL GROUP BY {date}::date"""
        )
    return union(parts)


def shares(src: str, date: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT {date}::date AS day, '{c}' AS "column", {c} AS category, count(*) AS cnt,
        count(*) / sum(count(*)) OVER (PARTITION BY {date}::date) AS share
        FROM {src} h WHERE {date} IS NOT NULL AND {c} IS NOT NULL GROUP BY {date}::date, {c}"""
        for c in columns
    ]
    return union(parts)


SEVERITY = "CASE WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3 THEN 'high' WHEN abs(z) >= 2 THEN 'medium' ELSE 'low' END"


def scored(series: str, value: str, partition: str = "") -> str:
    by = f'PARTITION BY {partition} ' if partition else ""
    return f"""SELECT *, CASE WHEN n >= 2 AND sd > 0 THEN (x - mu) / sd ELSE 0 END AS z FROM (
        SELECT *, ({value})::double AS x, count({value}) OVER w AS n, avg({value}) OVER w AS mu,
        stddev_pop({value}) OVER w AS sd, min({value}) OVER w AS lo
        FROM ({series}) s WINDOW w AS ({by}ORDER BY day {PAST}))"""


def finding(ord_: int, kind: str, level: str, column: str, expected: str, actual: str, z: str, rows: str, where: str, category: str = "NULL::varchar") -> str:
    return f"""SELECT day, {ord_} AS detector_ord, {kind} AS type, {level} AS severity, {column} AS "column", {category} AS category,
        round({expected}, 6) AS expected, round({actual}, 6) AS actual, {z} AS z_score FROM ({rows}) r WHERE {where}"""


def volume_findings(src: str, date: str) -> str:
    return finding(0, "CASE WHEN z < 0 THEN 'volume_drop' ELSE 'volume_spike' END", SEVERITY, "NULL::varchar", "mu", "x", "round(z, 2)",
                   scored(volume(src, date), "row_count"), "day_idx >= 5 AND abs(z) > 2.5")


def null_findings(src: str, date: str, schema: dict) -> str:
    return finding(1, "'null_rate_increase'", SEVERITY, '"column"', "mu", "x", "round(z, 2)",
                   scored(daily_columns(src, date, schema), "null_rate", '"column"'), "day_idx >= 5 AND n >= 5 AND z > 2.5 AND x > 1.0")


def negative_findings(src: str, date: str, schema: dict) -> str:
    return finding(2, "'negative_values'", "'high'", '"column"', "lo", "x", "0.0::double",
                   scored(daily_columns(src, date, schema), '"min"', '"column"'), "day_idx >= 5 AND lo >= 0 AND x < 0")


def mean_findings(src: str, date: str, schema: dict) -> str:
    return finding(3, "'mean_shift'", SEVERITY, '"column"', "mu", "x", "round(z, 2)",
                   scored(daily_columns(src, date, schema), "mean", '"column"'), "day_idx >= 5 AND n >= 5 AND x IS NOT NULL AND abs(z) > 3.0")


def share_findings(src: str, date: str, columns: list[str], limit: float = 0.15) -> str:
    """Every category on every day, absent ones as 0."""
    dense = f"""SELECT day, day_idx, "column", category, coalesce(share, 0) AS share,
        avg(coalesce(share, 0)) OVER (PARTITION BY "column", category ORDER BY day {PAST}) AS mu
        FROM (SELECT day, day_idx FROM ({volume(src, date)}) v)
        CROSS JOIN (SELECT DISTINCT "column", category FROM ({shares(src, date, columns)}) k)
        LEFT JOIN ({shares(src, date, columns)}) f USING (day, "column", category)"""
    return finding(4, "'distribution_shift'", "CASE WHEN abs(share - mu) < 0.25 THEN 'medium' ELSE 'high' END", '"column"',
                   "mu * 100", "share * 100", "0.0::double", dense, f"day_idx >= 5 AND abs(share - mu) > {limit}::double", "category")


def all_findings(src: str, date: str, schema: dict) -> str:
    return union(
        [
            volume_findings(src, date),
            null_findings(src, date, schema),
            negative_findings(src, date, schema),
            mean_findings(src, date, schema),
            share_findings(src, date, of_kind(schema, "t")),
        ]
    )


def anomalies(findings: str) -> str:
    return f'SELECT day, type, severity, "column", category, expected, actual, z_score FROM ({findings}) a'


# ---- comparison ----------------------------------------------------------------------


def _change(kind: str, severity: str, where: str, base: str = "NULL::double", cur: str = "NULL::double", change: str = "NULL::double", percent: str = "NULL::double") -> str:
    return f"""SELECT '{kind}' AS type, "column", ({base})::double AS baseline, ({cur})::double AS current,
        {change} AS change, {percent} AS change_percent, {severity} AS severity
        FROM (SELECT coalesce(c."column", b."column") AS "column", c.position AS cp, b.position AS bp,
            c.null_percent AS cn, b.null_percent AS bn, c.mean AS cm, b.mean AS bm, c.min_value AS cl, b.min_value AS bl,
            c.unique_count AS cu, b.unique_count AS bu
            FROM ({column_profiles(CURRENT, CURRENT_SCHEMA)}) c
            FULL OUTER JOIN ({column_profiles(BASELINE, BASELINE_SCHEMA)}) b ON c."column" = b."column") j WHERE {where}"""


CHANGES = {
    "cmp_row_count": f"""SELECT 'row_count_change' AS type, NULL::varchar AS "column", base::double AS baseline, cur::double AS current,
        NULL::double AS change, round((cur - base) / base * 100, 2) AS change_percent,
        CASE WHEN abs((cur - base) / base) > 0.5 THEN 'high' ELSE 'medium' END AS severity
        FROM (SELECT (SELECT count(*) FROM {CURRENT} c) AS cur, (SELECT count(*) FROM {BASELINE} b) AS base)
        WHERE base > 0 AND abs((cur - base) / base) > 0.2""",
    "cmp_null_rate": _change("null_rate_change", "CASE WHEN cn - bn > 10 THEN 'high' ELSE 'medium' END", "abs(cn - bn) > 5", "bn", "cn", change="round(cn - bn, 2)"),
    "cmp_mean": _change("mean_change", "CASE WHEN abs((cm - bm) / abs(bm)) > 0.3 THEN 'high' ELSE 'medium' END", "bm <> 0 AND abs((cm - bm) / abs(bm)) > 0.1", "bm", "cm", percent="round((cm - bm) / abs(bm) * 100, 2)"),
    "cmp_negative": _change("negative_values_appeared", "'high'", "bl >= 0 AND cl < 0", cur="cl"),
    "cmp_unique": _change("unique_count_change", "'medium'", "bu > 0 AND abs((cu - bu) / bu) > 0.2", "bu", "cu", percent="round((cu - bu) / bu * 100, 2)"),
    "schema_drift": union([_change("new_column", "'medium'", "bp IS NULL"), _change("missing_column", "'high'", "cp IS NULL")]),
}
ALL_CHANGES = union(list(CHANGES.values()))


def _customer_changes() -> str:
    """The same rules over the customers and a third of them, in place of the events."""
    part = "(SELECT c_custkey, c_name, c_nationkey, -abs(c_acctbal) AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)"
    schema = SCHEMAS["customer"]
    fewer = {c: s for c, s in schema.items() if c != "c_mktsegment"}
    swaps = [
        (column_profiles(CURRENT, CURRENT_SCHEMA), column_profiles(part, fewer)),
        (column_profiles(BASELINE, BASELINE_SCHEMA), column_profiles("customer", schema)),
        (f"FROM {CURRENT} c)", f"FROM {part} c)"),
        (f"FROM {BASELINE} b)", "FROM customer b)"),
    ]
    text = ALL_CHANGES
    for old, new in swaps:
        text = text.replace(old, new)
    return text


# ---- all -----------------------------------------------------------------------------

EVENTS, ORDERS, LINES = SCHEMAS["events"], SCHEMAS["orders"], SCHEMAS["lineitem"]
DATE_TEXT = r"'^\d{4}-\d{2}-\d{2}$'"

FAULTY_FINDINGS = all_findings(FAULTY, "ts", EVENTS)
ENRICHED = (
    "(SELECT o_orderdate, l_extendedprice, l_returnflag, o_orderpriority, p_brand FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
)


def _date_column(name: str) -> str:
    if name in DATES:
        return f"SELECT '{name}' AS dataset, '{DATES[name]}' AS date_column"
    tests = " ".join(
        f"WHEN (SELECT count({c}) > 0 AND bool_and(regexp_matches({c}, {DATE_TEXT})) FROM {name} WHERE {c} IS NOT NULL) THEN '{c}'"
        for c in PLAIN_TEXTS[name]
    )
    return f"SELECT '{name}' AS dataset, {f'CASE {tests} END' if tests else 'NULL::varchar'} AS date_column"


def _issues() -> str:
    orders = f"(SELECT * REPLACE (CASE WHEN {fraction('customer', 'o_orderkey')} >= 0.4::double THEN o_custkey END AS o_custkey) FROM orders)"
    texts = {c: s for c, s in SCHEMAS["documents"].items() if c != "doc_id"}
    sources = {n: (n, SCHEMAS[n]) for n in ("customer", "supplier")} | {
        "faulty_events": (FAULTY, EVENTS), "orders": (orders, ORDERS), "document_texts": ("documents", texts),
    }
    parts = []
    for name, (src, schema) in sources.items():
        table, columns = table_profiles(src, schema), column_profiles(src, schema)
        head = f"SELECT '{name}' AS dataset,"
        parts += [
            f"""{head} NULL::varchar AS "column", 'high_null_rate' AS issue, round(null_cell_percent, 4) AS value FROM ({table}) t WHERE null_cell_percent > 5""",
            f"""{head} NULL::varchar AS "column", 'duplicate_rows' AS issue, duplicate_rows::double AS value FROM ({table}) t WHERE duplicate_rows > 0""",
            f"""{head} "column", 'column_null_rate' AS issue, null_percent AS value FROM ({columns}) c WHERE null_percent > 20""",
            f"""{head} "column", 'negative_values' AS issue, min_value AS value FROM ({columns}) c WHERE min_value < 0""",
        ]
    return union(parts)


def _counts_by_type() -> str:
    found = union(
        [
            f"SELECT 'events' AS dataset, type FROM ({FAULTY_FINDINGS}) e",
            f"SELECT 'orders' AS dataset, type FROM ({all_findings('orders', 'o_orderdate', ORDERS)}) o",
        ]
    )
    return f"""WITH found AS ({found})
        SELECT 'total' AS scope, 'all' AS name, count(*) AS anomalies FROM found
        UNION ALL SELECT 'dataset', dataset, count(*) FROM found GROUP BY dataset
        UNION ALL SELECT 'type', type, count(*) FROM found GROUP BY type"""


PRODUCTS = f"""(SELECT product_no, printf('PROD_%04d', product_no) AS product_id, 'Product ' || product_no AS name, category,
    round(low + (high - low) * {fraction('price', 'product_no')}, 2) AS base_price
    FROM (SELECT p_partkey AS product_no, [{', '.join(f"'{c}'" for c in CATEGORIES)}][floor({fraction('category', 'p_partkey')} * {len(CATEGORIES)})::int + 1] AS category FROM part) p
    JOIN (VALUES {', '.join(f"('{c}', {low}::double, {high}::double)" for c, (low, high) in PRICE_RANGES.items())}) r(category, low, high) USING (category))"""

SYNTH_VOLUME = f"""(SELECT day, day_idx, floor(row_count * (CASE WHEN day_idx % 7 >= 5 THEN 1.2::double ELSE 1.0::double END)
    * (0.9::double + 0.2::double * {fraction('volume', 'day_idx')}))::bigint AS order_count FROM ({volume('events', 'ts')}) v)"""

_STATUS = weighted(fraction("status", "order_no"), list(STATUS_WEIGHTS), list(STATUS_WEIGHTS.values()))
_ITEM_COUNT = weighted(fraction("items", "order_no"), list(ITEM_COUNT_WEIGHTS), list(ITEM_COUNT_WEIGHTS.values()))
SYNTH_ORDERS = f"""(SELECT printf('ORD_%06d', order_no) AS order_id,
    printf('CUST_%05d', floor({fraction('customer', 'order_no')} * {CUSTOMERS})::bigint + 1) AS customer_id,
    day::timestamp + to_minutes(floor({fraction('minute', 'order_no')} * 1440)::bigint) AS order_date,
    {_STATUS} AS status, ({_ITEM_COUNT})::bigint AS item_count
    FROM (SELECT day, (earlier + i)::bigint AS order_no FROM (
        SELECT day, unnest(range(1, order_count + 1)) AS i, coalesce(sum(order_count) OVER (ORDER BY day_idx {PAST}), 0) AS earlier
        FROM {SYNTH_VOLUME} v) d) n)"""

_LINE = ("order_id", "line")
SYNTH_ITEMS = f"""(SELECT printf('ITEM_%s_%d', order_id, line) AS item_id, order_id, product_id, quantity, unit_price,
    round(unit_price * quantity, 2) AS line_total FROM (
    SELECT order_id, line, product_id, quantity, round(base_price * price_factor, 2) AS unit_price FROM (
        SELECT order_id, line, {weighted(fraction('item category', *_LINE), CATEGORIES, NORMAL_WEIGHTS)} AS category,
            {fraction('product', *_LINE)} AS product_fraction,
            ({weighted(fraction('quantity', *_LINE), list(QUANTITY_WEIGHTS), list(QUANTITY_WEIGHTS.values()))})::bigint AS quantity,
            0.9::double + 0.2::double * {fraction('item price', *_LINE)} AS price_factor
        FROM (SELECT order_id, unnest(range(1, item_count + 1)) AS line FROM {SYNTH_ORDERS} o) l) i
    JOIN (SELECT category, product_id, base_price, row_number() OVER (PARTITION BY category ORDER BY product_no) - 1 AS rank,
            count(*) OVER (PARTITION BY category) AS category_size FROM {PRODUCTS} p) r
        ON i.category = r.category AND floor(i.product_fraction * r.category_size)::bigint = r.rank) u)"""

# The same tables made under the fault plan.
def _day(number: int) -> str:
    return f"(SELECT day FROM ({volume('events', 'ts')}) v WHERE day_idx = {number})"


PLANNED_VOLUME = f"(SELECT day, day_idx, CASE WHEN day_idx = 10 THEN floor(order_count * 0.5::double)::bigint ELSE order_count END AS order_count FROM {SYNTH_VOLUME} s)"
PLANNED_ORDERS = f"""(SELECT * REPLACE (CASE WHEN order_date::date <> {_day(20)} OR {fraction('missing customer', "order_id[5:]::bigint")} >= 0.2::double
    THEN customer_id END AS customer_id) FROM {SYNTH_ORDERS.replace(SYNTH_VOLUME, PLANNED_VOLUME)} a)"""
PLANNED_LINES = f"""(SELECT printf('ITEM_%s_%d', order_id, line) AS item_id, order_id, order_date, category, product_id, quantity, unit_price,
    round(unit_price * quantity, 2) AS line_total FROM (
    SELECT i.*, product_id, CASE WHEN order_date::date = {_day(15)} AND {fraction('negative price', *_LINE)} < 0.05::double
        THEN -round(base_price * price_factor, 2) ELSE round(base_price * price_factor, 2) END AS unit_price FROM (
        SELECT order_id, line, order_date, CASE WHEN order_date::date = {_day(25)} THEN {weighted(fraction('item category', *_LINE), CATEGORIES, SHIFTED_WEIGHTS)}
            ELSE {weighted(fraction('item category', *_LINE), CATEGORIES, NORMAL_WEIGHTS)} END AS category,
            {fraction('product', *_LINE)} AS product_fraction,
            ({weighted(fraction('quantity', *_LINE), list(QUANTITY_WEIGHTS), list(QUANTITY_WEIGHTS.values()))})::bigint AS quantity,
            0.9::double + 0.2::double * {fraction('item price', *_LINE)} AS price_factor
        FROM (SELECT order_id, order_date, unnest(range(1, item_count + 1)) AS line FROM {PLANNED_ORDERS} o) l) i
    JOIN (SELECT category, product_id, base_price, row_number() OVER (PARTITION BY category ORDER BY product_no) - 1 AS rank,
            count(*) OVER (PARTITION BY category) AS category_size FROM {PRODUCTS} p) r
        ON i.category = r.category AND floor(i.product_fraction * r.category_size)::bigint = r.rank) u)"""
PLANNED_ORDERS_SCHEMA = {"order_id": ("i", None), "customer_id": ("i", None), "order_date": ("d", 8), "status": ("t", None), "item_count": ("n", 8)}
PLANNED_LINES_SCHEMA = {"order_date": ("d", 8), "category": ("t", None), "quantity": ("n", 8), "unit_price": ("n", 8), "line_total": ("n", 8)}


def _csv_types(name: str) -> str:
    """Types of the columns written as text, by patterns over all values."""
    parts = []
    for c, (kind, _) in CSV_SCHEMAS[name].items():
        text = f"strftime({c}, '%m/%d/%Y %H:%M')" if kind == "d" else f"{c}::varchar"
        all_are = "bool_and(regexp_matches(v, '{}'))".format
        parts.append(
            f"""SELECT '{name}' AS dataset, '{c}' AS "column", CASE WHEN {all_are('^[+-]?[0-9]+$')} THEN 'bigint'
            WHEN {all_are('^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')} THEN 'double' ELSE 'string' END AS type,
            CASE WHEN {all_are('^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$')} AND count(try_strptime(v, '%m/%d/%Y %H:%M')) = count(v) THEN 'M/d/yyyy H:mm' END AS date_format
            FROM (SELECT {text} AS v FROM {name}) t"""
        )
    return union(parts)


CSV_SCHEMAS = {n: SCHEMAS[n] for n in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents")} | {
    "region": {"r_regionkey": ("n", 4), "r_name": ("t", None)},
    "nation": {"n_nationkey": ("n", 4), "n_name": ("t", None), "n_regionkey": ("n", 4)},
    "labels": {"doc_id": ("n", 8), "quality": ("n", 4), "toxic": ("n", 4)},
}

ORACLES: dict[str, str] = {
    "csv_types": union([_csv_types(n) for n in CSV_SCHEMAS]),
    "date_parse_by_name": """SELECT o_orderdate::date AS day, o_orderpriority AS updated_by, count(*) AS cnt, true AS date_converted,
        false AS text_converted FROM orders GROUP BY ALL""",
    "date_column_detect": union([_date_column(n) for n in catalog.ALL_TABLES])
    + f"""\nUNION ALL SELECT 'orders_text', CASE
        WHEN (SELECT bool_and(regexp_matches(o_orderstatus, {DATE_TEXT})) FROM orders) THEN 'o_orderstatus'
        WHEN (SELECT bool_and(regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), {DATE_TEXT})) FROM orders) THEN 'o_orderdate' END""",
    "dataset_status": "SELECT dataset, CASE WHEN date_column IS NULL THEN 'no_date' WHEN days < 5 THEN 'short_history' ELSE 'ok' END AS status, date_column, days FROM ("
    + union([f"SELECT *, {f'(SELECT count(DISTINCT {DATES[n]}::date) FROM {n})' if n in DATES else 'NULL::bigint'} AS days FROM ({_date_column(n)}) d" for n in catalog.ALL_TABLES])
    + ") s",
    "daily_null_date_dropped": volume(f"(SELECT CASE WHEN {fraction('date', 'event_id')} >= 0.1::double THEN ts END AS ts FROM events)", "ts"),
    "table_profile": union([f"SELECT '{n}' AS dataset, t.* FROM ({table_profiles(*source(n))}) t" for n in ("faulty_events", "documents", "lineitem", "pages")]),
    "duplicate_rows": union(
        [
            f"SELECT '{n}' AS dataset, count(*) AS row_count, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {s} d)))::bigint AS duplicate_rows FROM {s} s"
            for n, c, s in (
                ("documents", "text, lang, source, n_chars", "documents"),
                ("lines", "l_partkey, l_quantity, l_returnflag", "lineitem"),
                ("customer_twice", "*", "(SELECT * FROM customer UNION ALL SELECT * FROM customer)"),
            )
        ]
    ),
    "est_bytes": union([f"SELECT '{n}' AS dataset, {bytes_of(source(n)[1])} AS est_bytes FROM {source(n)[0]} s" for n in ("documents", "orders", "customer", "faulty_events", "pages")]),
    "column_nulls": columns_of(["faulty_events", "lineitem", "embeddings"], 'position, "column", "count", null_count, null_percent'),
    "numeric_profile": columns_of(["orders", "customer", "faulty_events"], '"column", mean, std, min_value, max_value, percentile_25, percentile_50, percentile_75', "mean IS NOT NULL"),
    "numeric_quartiles": f'SELECT "column", percentile_25, percentile_50, percentile_75 FROM ({column_profiles("lineitem", LINES)}) p WHERE mean IS NOT NULL',
    "string_uniques": columns_of(["documents", "customer", "part", "embeddings"], '"column", unique_count, unique_percent', "unique_count IS NOT NULL"),
    "top_values": union([top_of(n, c) for n in ("documents", "orders", "conversations") for c in of_kind(SCHEMAS[n], "t")]),
    "top_values_by_text": union(
        [top_by_value(n, c) for n in ("documents", "pages", "benchmark", "conversations", "orders") for c in (of_kind(SCHEMAS[n], "t") if n in SCHEMAS else PLAIN_TEXTS[n])]
    ),
    "avg_length": columns_of(["documents", "pages", "conversations"], '"column", avg_length', "unique_count IS NOT NULL"),
    "datetime_span_days": union([f"""SELECT '{n}' AS dataset, '{c}' AS "column", min({c})::date AS first_day, max({c})::date AS last_day, date_sub('day', min({c}), max({c})) AS date_range_days FROM {n}""" for n, c in DATES.items()]),
    "column_profile": f"SELECT 'events' AS dataset, p.* FROM ({column_profiles(FAULTY, EVENTS)}) p",
    "daily_volume": volume("lineitem", "l_shipdate"),
    "daily_null_rates": f'SELECT day, day_idx, "column", null_count, round(null_rate, 6) AS null_rate FROM ({daily_columns(NULLED, "ts", EVENTS)}) d',
    "daily_numeric": f'SELECT day, day_idx, "column", round(mean, 6) AS mean, "min", "max", round(std, 6) AS std FROM ({daily_columns("lineitem", "l_shipdate", LINES)}) d WHERE mean IS NOT NULL',
    "daily_category_share": f"""SELECT day, day_idx, "column", category, cnt, round(share, 6) AS share FROM ({shares('orders', 'o_orderdate', of_kind(ORDERS, 't'))}) s
        JOIN (SELECT day, day_idx FROM ({volume('orders', 'o_orderdate')}) v) USING (day)""",
    "daily_profile": f"""WITH c AS ({daily_columns(FAULTY, 'ts', EVENTS)})
        SELECT v.day, v.day_idx, v.row_count, u.null_count AS null_users, round(u.null_rate, 6) AS null_user_rate, round(x.mean, 6) AS mean_value,
        round(x."min", 6) AS min_value, round(x."max", 6) AS max_value, round(x.std, 6) AS std_value,
        (SELECT count(*) FROM c WHERE c.day = v.day AND c.mean IS NOT NULL) AS numeric_columns, k.event_types, k.top_share
        FROM ({volume(FAULTY, 'ts')}) v JOIN c u ON u.day = v.day AND u."column" = 'user_id' JOIN c x ON x.day = v.day AND x."column" = 'value'
        JOIN (SELECT day, count(*) AS event_types, round(max(share), 6) AS top_share FROM ({shares(FAULTY, 'ts', ['event_type'])}) s GROUP BY day) k ON k.day = v.day""",
    "merged_daily_numeric": f'SELECT day, day_idx, "column", null_count, round(mean, 9) AS mean, "min", "max", round(std, 9) AS std FROM ({daily_columns("lineitem", "l_shipdate", LINES)}) d WHERE mean IS NOT NULL',
    "merged_detect_series": anomalies(union([volume_findings(FAULTY, "ts"), null_findings(FAULTY, "ts", EVENTS), negative_findings(FAULTY, "ts", EVENTS), mean_findings(FAULTY, "ts", EVENTS)])),
    "approximate_distincts": union([f"""SELECT '{c}' AS "column", count({c}) AS filled, count(DISTINCT {c}) AS unique_count, true AS within_bound FROM orders""" for c in ORDERS if c != "o_orderdate"]),
    "zscore_expanding": f"SELECT day, row_count, n AS hist_count, round(mu, 6) AS hist_mean, round(sd, 6) AS hist_std, round(z, 6) AS z FROM ({scored(volume('orders', 'o_orderdate'), 'row_count')}) s",
    "severity_bucket": f"SELECT {SEVERITY} AS severity, count(*) AS days FROM ({scored(volume('lineitem', 'l_shipdate'), 'row_count')}) s GROUP BY 1",
    "detect_volume": anomalies(volume_findings("lineitem", "l_shipdate")),
    "detect_null_rate": anomalies(null_findings(NULLED, "ts", EVENTS)),
    "detect_negative": anomalies(negative_findings(NEGATED, "ts", EVENTS)),
    "detect_mean_shift": anomalies(mean_findings("lineitem", "l_shipdate", LINES)),
    "detect_distribution": anomalies(share_findings("orders", "o_orderdate", of_kind(ORDERS, "t"))),
    "detect_all": anomalies(FAULTY_FINDINGS),
    "detect_long_categories": anomalies(share_findings(DESCRIBED, "ts", ["event_type"], 0.05)),
    "enriched_detect_distribution": anomalies(share_findings(ENRICHED, "o_orderdate", ["l_returnflag", "o_orderpriority", "p_brand"])),
    "enriched_detect_all_texts": anomalies(
        share_findings(
            "(SELECT o_orderdate, l_returnflag, l_linestatus, o_orderstatus, o_orderpriority, p_name, p_brand, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)",
            "o_orderdate", ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "p_name", "p_brand", "p_type"],
        )
    ),
    **CHANGES,
    "compare_profiles": ALL_CHANGES,
    "compare_datasets": f"""SELECT 'current' AS dataset, 'baseline' AS baseline_dataset, a.* FROM ({ALL_CHANGES}) a
        UNION ALL SELECT 'customer_part', 'customer', b.* FROM ({_customer_changes()}) b""",
    "has_changes": f"""SELECT count(*) AS changes, count(*) > 0 AS has_changes, 'drifted' AS pair FROM ({ALL_CHANGES}) c
        UNION ALL SELECT 0::bigint, false, 'itself'""",
    "quality_issues": _issues(),
    "anomalies_by_type": _counts_by_type(),
    "profile_report": f"""SELECT 'events' AS dataset, position, "column", format('{{:,}} ({{:.1f}}%)', null_count, null_percent) AS nulls,
        CASE WHEN mean IS NOT NULL THEN printf('mean %.2f, std %.2f, %.2f to %.2f', mean, std, min_value, max_value)
        WHEN unique_count IS NOT NULL THEN format('{{:,}} distinct ({{:.1f}}%)', unique_count, unique_percent)
        ELSE (SELECT min(ts)::date::varchar || ' to ' || max(ts)::date::varchar FROM {FAULTY} f) END AS stats
        FROM ({column_profiles(FAULTY, EVENTS)}) p""",
    "compare_report": f"""SELECT type, coalesce("column", '-') AS "column", coalesce(printf('%.4f', baseline), '-') AS baseline,
        coalesce(printf('%.4f', current), '-') AS current, coalesce(printf('%.2f%%', coalesce(change_percent, change)), '-') AS change,
        upper(severity) AS severity FROM ({ALL_CHANGES}) c""",
    "anomaly_report": f"""SELECT day, row_number() OVER (PARTITION BY day ORDER BY detector_ord, "column" NULLS FIRST, category NULLS FIRST) AS line_no,
        '[' || upper(severity) || '] ' || type || CASE WHEN "column" IS NULL THEN '' WHEN category IS NULL THEN ' [' || "column" || ']'
        ELSE ' [' || "column" || ':' || category || ']' END AS headline FROM ({FAULTY_FINDINGS}) f""",
    "fact_quick_stats": f"""SELECT count(*) AS row_count, min(ts)::date AS first_day, max(ts)::date AS last_day, count(*) - count(user_id) AS null_count,
        count(*) FILTER (value < 0) AS negative_count, round(count(*) / (date_diff('day', min(ts)::date, max(ts)::date) + 1), 6) AS rows_per_day FROM {FAULTY} f""",
    "inject_volume_drop": volume(f"(SELECT * FROM events WHERE {KEPT})", "ts"),
    "inject_negative": f"SELECT event_id, ts::date AS day, value FROM {NEGATED} n",
    "inject_nulls": f"SELECT event_id, ts::date AS day, user_id FROM {NULLED} n",
    "inject_category_shift": f"SELECT event_id, ts::date AS day, {SHIFTED_TYPE} AS event_type FROM events",
    "injected_vs_detected": f"""SELECT f.day, f.fault, count(a.day) AS hits, count(a.day) > 0 AS detected
        FROM (VALUES (DATE '{DROP_DAY}', 'volume_drop', 'volume_drop'), (DATE '{NEGATIVE_DAY}', 'negative_prices', 'negative_values'),
        (DATE '{NULL_DAY}', 'null_customers', 'null_rate_increase'), (DATE '{SHIFT_DAY}', 'category_shift', 'distribution_shift')) f(day, fault, sign)
        LEFT JOIN ({FAULTY_FINDINGS}) a ON a.day = f.day AND a.type = f.sign GROUP BY f.day, f.fault""",
    "synth_products": f"SELECT * FROM {PRODUCTS} p",
    "synth_daily_volume": f"SELECT * FROM {SYNTH_VOLUME} v",
    "synth_orders": f"SELECT * FROM {SYNTH_ORDERS} o",
    "synth_items": f"SELECT * FROM {SYNTH_ITEMS} i",
    "synth_order_totals": f"""SELECT o.*, total_amount FROM {SYNTH_ORDERS} o
        JOIN (SELECT order_id, round(sum(unit_price * quantity), 2) AS total_amount FROM {SYNTH_ITEMS} i GROUP BY order_id) t USING (order_id)""",
    "planned_orders": f"""SELECT o.*, total_amount FROM {PLANNED_ORDERS} o
        JOIN (SELECT order_id, round(sum(unit_price * quantity), 2) AS total_amount FROM {PLANNED_LINES} i GROUP BY order_id) t USING (order_id)""",
    "planned_items": f"SELECT item_id, order_id, product_id, quantity, unit_price, line_total FROM {PLANNED_LINES} i",
    "planned_vs_detected": f"""WITH made AS MATERIALIZED (SELECT * FROM {PLANNED_ORDERS} o), lines AS MATERIALIZED (SELECT * FROM {PLANNED_LINES} i),
        found AS ({union([all_findings('made', 'order_date', PLANNED_ORDERS_SCHEMA), all_findings('lines', 'order_date', PLANNED_LINES_SCHEMA)])})
        SELECT f.day, f.fault, count(a.day) AS hits, count(a.day) > 0 AS detected
        FROM (VALUES ({_day(10)}, 'volume_drop', 'volume_drop'), ({_day(15)}, 'negative_prices', 'negative_values'),
        ({_day(20)}, 'null_customers', 'null_rate_increase'), ({_day(25)}, 'category_shift', 'distribution_shift')) f(day, fault, sign)
        LEFT JOIN found a ON a.day = f.day AND a.type = f.sign GROUP BY f.day, f.fault""",
}
