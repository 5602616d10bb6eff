"""ANSI SQL for every query of ``concordat.plans.star_schema``, for an independent engine."""

from __future__ import annotations

ORDER_COLUMNS = ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
LINEITEM_COLUMNS = [
    "l_discount",
    "l_extendedprice",
    "l_linenumber",
    "l_linestatus",
    "l_orderkey",
    "l_partkey",
    "l_quantity",
    "l_returnflag",
    "l_shipdate",
    "l_suppkey",
    "l_tax",
]
LINEITEM_NUMBERS = [c for c in LINEITEM_COLUMNS if c not in ("l_linestatus", "l_returnflag", "l_shipdate")]
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
# A column name in quotes is safe where the name is also a keyword.
COL = '"column"'

IN_PLACE = """
    o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority"""
ORDERS = f"""s AS (SELECT * FROM orders),
t AS (SELECT {IN_PLACE} FROM orders WHERE o_orderkey % 97 <> 0)"""
PRICED_ORDERS = f"""s0 AS (SELECT * FROM orders),
t0 AS (SELECT {IN_PLACE} FROM orders WHERE o_orderkey % 97 <> 0),
s AS (SELECT * REPLACE (CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice) FROM s0),
t AS (SELECT * REPLACE (CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice) FROM t0)"""
NOISY_ORDERS = """s AS (SELECT * FROM orders),
t AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * (1 + 1e-7) ELSE o_totalprice END
                        AS o_totalprice) FROM orders)"""
RAW_LINEITEM = "s AS (SELECT * FROM lineitem)"
LINEITEM = f"""{RAW_LINEITEM},
altered AS (SELECT * REPLACE (
    CASE WHEN l_partkey % 89 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
    CASE WHEN l_suppkey % 83 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag)
    FROM s WHERE l_orderkey % 97 <> 0),
t AS (SELECT * FROM altered UNION ALL SELECT * FROM altered WHERE l_orderkey % 101 = 0)"""
DECIMALS = """* REPLACE (CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice, CAST(l_discount AS DECIMAL(6,4)) AS l_discount)"""
EXACT_LINEITEM = f"""raw_s AS (SELECT * FROM lineitem),
altered AS (SELECT * REPLACE (
    CASE WHEN l_partkey % 89 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
    CASE WHEN l_suppkey % 83 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag)
    FROM raw_s WHERE l_orderkey % 97 <> 0),
s AS (SELECT {DECIMALS} FROM raw_s),
t AS (SELECT {DECIMALS} FROM (SELECT * FROM altered UNION ALL SELECT * FROM altered WHERE l_orderkey % 101 = 0))"""
TAX = "(VALUES ('1-URGENT', 0.10), ('2-HIGH', 0.20), ('3-MEDIUM', 0.05))"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def close(a: str, b: str, absolute: float, relative: float) -> str:
    """Both null agree, one null does not, otherwise either bound is enough."""
    return (
        f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN TRUE WHEN {a} IS NULL OR {b} IS NULL THEN FALSE "
        f"ELSE abs({a} - {b}) <= {absolute} OR abs({a} - {b}) / (CASE WHEN {a} = 0 THEN 1 ELSE abs({a}) END) <= {relative} END"
    )


def payment(tail: str) -> str:
    return f"""
SELECT o_orderkey AS invoice_id, o_custkey AS vendor_id, c_name AS vendor_name, n_name AS country_code,
       c_mktsegment AS payment_terms, CASE o_orderstatus WHEN 'F' THEN 'PAID' ELSE 'PENDING' END AS payment_status,
       'EUR' AS currency, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS gross_amount,
       o_orderpriority AS tax_code, CAST(rate AS DOUBLE) AS tax_rate,
       CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * (1 - CAST(rate AS DECIMAL(6,4))), 2) AS DOUBLE) AS net_amount,
       strftime(o_orderdate, '%Y%m%d') AS posting_date,
       strftime(o_orderdate + INTERVAL 30 DAY, '%Y%m%d') AS payment_date, 'T' AS payment_method
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN {TAX} AS tax(code, rate) ON o_orderpriority = code
WHERE o_orderstatus IN ('F', 'P') {tail}"""


STEPS = f"""
SELECT c_mktsegment AS segment, count(*) AS n_orders,
       CAST(sum(coalesce(round(CAST(o_totalprice AS DECIMAL(18,2)) * (1 - CAST(rate AS DECIMAL(6,4))), 2), 0)) AS DOUBLE) AS net_total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN {TAX} AS tax(code, rate) ON o_orderpriority = code
GROUP BY c_mktsegment"""


def structural() -> str:
    def nulls(column: str) -> str:
        return (
            f"(SELECT count(*) - count({column}) FROM s) AS source_nulls, "
            f"(SELECT count(*) - count({column}) FROM t) AS target_nulls"
        )

    none = "CAST(NULL AS BIGINT) AS source_nulls, CAST(NULL AS BIGINT) AS target_nulls"
    listed = [
        ("o_orderkey", 0, 0, "integer", "integer", nulls("o_orderkey")),
        ("o_custkey", 1, 1, "integer", "string", nulls("o_custkey")),
        ("o_orderstatus", 2, 2, "string", "string", nulls("o_orderstatus")),
        ("o_totalprice", 3, 3, "float", "float", nulls("o_totalprice")),
        ("o_orderdate", 4, 4, "datetime", "datetime", nulls("o_orderdate")),
        ("o_orderpriority", 5, None, "string", None, none),
        ("o_rank", None, 5, None, "string", none),
    ]
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    rows = union(
        [
            f"SELECT {lit(c)} AS {COL}, CAST({lit(sp)} AS INTEGER) AS source_position, "
            f"CAST({lit(tp)} AS INTEGER) AS target_position, {lit(sf)} AS source_family, {lit(tf)} AS target_family, {n}"
            for c, sp, tp, sf, tf, n in listed
        ]
    )
    return f"""WITH {ORDERS}, listed AS ({rows})
SELECT *, source_position IS NOT NULL AND target_position IS NOT NULL AS names_match,
       coalesce(source_family = target_family, FALSE) AS family_match,
       coalesce(source_nulls = target_nulls, FALSE) AS nulls_match FROM listed"""


def hex_of(value: str) -> str:
    return f"md5(coalesce('v' || {value}, 'n'))"


def bits_of(hex_text: str) -> str:
    return f"CAST('0x' || substr({hex_text}, 1, 15) AS BIGINT)"


def order_text(c: str) -> str:
    return "strftime(o_orderdate, '%Y-%m-%d')" if c == "o_orderdate" else f"CAST({c} AS VARCHAR)"


ROW_BITS = bits_of(f"md5({' || '.join(hex_of(order_text(c)) for c in ORDER_COLUMNS)})")
BUCKET = f"{bits_of(f'''md5({hex_of(order_text('o_orderkey'))})''')} % 10"


def digest(side: str, group: str, bits: str) -> str:
    lead, tail = (f"{group}, ", " GROUP BY 1, 2") if group else ("", "")
    return (
        f"SELECT '{side}' AS side, {lead}count(*) AS \"rows\", CAST(sum({bits}) AS VARCHAR) AS digest_sum, "
        f"bit_xor({bits}) AS digest_xor FROM {side[0]}{tail}"
    )


def dataset_fingerprint() -> str:
    return f"WITH {PRICED_ORDERS} " + union([digest(side, "", ROW_BITS) for side in ("source", "target")])


def column_fingerprints() -> str:
    parts = [
        digest(side, f"'{c}' AS {COL}", bits_of(hex_of(order_text(c)))) for side in ("source", "target") for c in ORDER_COLUMNS
    ]
    return f"WITH {PRICED_ORDERS} " + union(parts)


def bucket_checksums() -> str:
    both = union([digest(side, f"CAST({BUCKET} AS INTEGER) AS bucket", ROW_BITS) for side in ("source", "target")])
    return f"""WITH {PRICED_ORDERS}, d AS ({both}),
a AS (SELECT * FROM d WHERE side = 'source'), b AS (SELECT * FROM d WHERE side = 'target')
SELECT bucket, coalesce(a."rows", 0) AS source_rows, a.digest_sum AS source_digest_sum, a.digest_xor AS source_digest_xor,
       coalesce(b."rows", 0) AS target_rows, b.digest_sum AS target_digest_sum, b.digest_xor AS target_digest_xor,
       a."rows" IS NOT DISTINCT FROM b."rows" AND a.digest_sum IS NOT DISTINCT FROM b.digest_sum
       AND a.digest_xor IS NOT DISTINCT FROM b.digest_xor AS matches
FROM a FULL JOIN b USING (bucket)"""


def fingerprint_match() -> str:
    altered = """t AS (SELECT * REPLACE (
    CASE WHEN l_partkey % 89 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
    CASE WHEN l_suppkey % 83 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag) FROM s)"""

    def one(c: str) -> str:
        counted = lambda side: f"SELECT {c}, count(*) FROM {side} GROUP BY {c}"
        return (
            f"SELECT '{c}' AS {COL}, (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows, "
            f"NOT EXISTS ({counted('s')} EXCEPT {counted('t')}) AND NOT EXISTS ({counted('t')} EXCEPT {counted('s')}) AS matches"
        )

    return f"WITH {RAW_LINEITEM}, {altered} " + union([one(c) for c in LINEITEM_COLUMNS])


DUPLICATES = f"""WITH {LINEITEM}
SELECT (SELECT count(*) FROM s) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)) AS source_duplicates,
       (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS target_duplicates"""

ROW_DIFF = f"""WITH {ORDERS}
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
       CAST(CASE WHEN s.o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS source_rows,
       CAST(CASE WHEN t.o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS target_rows,
       CASE WHEN t.o_orderkey IS NULL THEN 'missing_in_target' WHEN s.o_orderkey IS NULL THEN 'extra_in_target'
            ELSE 'changed' END AS difference
FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey
WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR s.o_custkey IS DISTINCT FROM t.o_custkey
   OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus OR s.o_totalprice IS DISTINCT FROM t.o_totalprice
   OR s.o_orderdate IS DISTINCT FROM t.o_orderdate OR s.o_orderpriority IS DISTINCT FROM t.o_orderpriority"""

ROW_DIFF_REPEATED = f"""WITH {LINEITEM},
content AS (SELECT {", ".join(LINEITEM_COLUMNS)}, sum(a) AS a, sum(b) AS b
            FROM (SELECT *, 1 AS a, 0 AS b FROM s UNION ALL SELECT *, 0, 1 FROM t) GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CAST(sum(a) AS BIGINT) AS source_rows, CAST(sum(b) AS BIGINT) AS target_rows,
       CASE WHEN sum(b) = 0 THEN 'missing_in_target' WHEN sum(a) = 0 THEN 'extra_in_target' ELSE 'changed' END AS difference
FROM content GROUP BY l_orderkey, l_linenumber HAVING bool_or(a <> b)"""


def cell_diff() -> str:
    def one(c: str) -> str:
        return (
            f"SELECT s.o_orderkey, '{c}' AS {COL}, CAST(s.{c} AS VARCHAR) AS source_value, "
            f"CAST(t.{c} AS VARCHAR) AS target_value, CAST(1 AS BIGINT) AS n "
            f"FROM s JOIN t ON s.o_orderkey = t.o_orderkey WHERE s.{c} IS DISTINCT FROM t.{c}"
        )

    return f"WITH {PRICED_ORDERS} " + union([one(c) for c in ORDER_COLUMNS if c != "o_orderkey"])


def totals_rows(columns: list[str], absolute: float, relative: float) -> str:
    """(column, function, source_value, target_value, agrees) over CTEs s and t."""
    rows = [
        f"SELECT '{c}' AS {COL}, '{fn.upper()}' AS \"function\", (SELECT CAST({fn}(CAST({c} AS {kind})) AS DOUBLE) FROM s) AS sv, "
        f"(SELECT CAST({fn}(CAST({c} AS {kind})) AS DOUBLE) FROM t) AS tv"
        for c in columns
        for fn, kind in (("sum", "DECIMAL(28,4)"), ("count", "DOUBLE"), ("avg", "DOUBLE"))
    ]
    return f"SELECT {COL}, \"function\", sv AS source_value, tv AS target_value, {close('sv', 'tv', absolute, relative)} AS agrees FROM ({union(rows)})"


def grand_totals() -> str:
    rows = totals_rows(["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"], 1e-6, 0.02)
    return f"""WITH {EXACT_LINEITEM}
SELECT * REPLACE (round(source_value, 4) AS source_value, round(target_value, 4) AS target_value) FROM ({rows})"""


def differences(rows: str, tolerances: dict[str, tuple[float, float]], counts: list[str] | None = None) -> str:
    pick = lambda i: " ".join(f"WHEN '{c}' THEN {t[i]!r}" for c, t in tolerances.items())
    return f"""
SELECT {COL}, source_count, target_count, round(d, 9) AS max_absolute_diff, round(r, 9) AS max_relative_diff,
       abs_tolerance, rel_tolerance, {"".join(c + ", " for c in counts or [])}
       coalesce(source_count <> target_count OR d > abs_tolerance OR r > rel_tolerance {"".join(f"OR {c} > 0 " for c in counts or [])}, FALSE) AS exceeds
FROM (SELECT *, CAST(CASE {COL} {pick(0)} END AS DOUBLE) AS abs_tolerance,
             CAST(CASE {COL} {pick(1)} END AS DOUBLE) AS rel_tolerance FROM ({rows}))"""


def rank_tolerance() -> str:
    sides = """s AS (SELECT * REPLACE (CASE WHEN l_partkey % 11 = 0 THEN CAST('inf' AS DOUBLE)
        WHEN l_partkey % 13 = 0 THEN CAST('-inf' AS DOUBLE) ELSE l_tax END AS l_tax),
    l_orderkey + 9007199254740992 AS l_big, CAST(l_extendedprice AS DECIMAL(18,2)) AS l_price, CAST(1 AS DOUBLE) AS l_flag FROM lineitem),
t AS (SELECT * REPLACE (
    CASE WHEN l_partkey % 7 = 0 THEN l_extendedprice * (1 + 1e-7) ELSE l_extendedprice END AS l_extendedprice,
    CASE WHEN l_partkey % 89 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
    CASE WHEN l_suppkey % 83 = 0 THEN NULL ELSE l_discount END AS l_discount,
    CASE WHEN l_partkey % 89 = 0 THEN l_big + 1 ELSE l_big END AS l_big) FROM s)"""
    columns = ["l_extendedprice", "l_quantity", "l_discount", "l_orderkey", "l_tax", "l_big", "l_price", "l_flag"]

    def one(c: str) -> str:
        ranked = lambda side: f"(SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS i FROM {side} WHERE {c} IS NOT NULL)"
        n = f"(SELECT count({c}) FROM s) = (SELECT count({c}) FROM t)"
        apart = "CASE WHEN a.v = b.v THEN 0 ELSE CAST(abs(a.v - b.v) AS DOUBLE) END"
        return (
            f"SELECT '{c}' AS {COL}, (SELECT count({c}) FROM s) AS source_count, (SELECT count({c}) FROM t) AS target_count, "
            f"CASE WHEN {n} THEN max({apart}) END AS d, "
            f"CASE WHEN {n} THEN max(CASE WHEN a.v = b.v THEN 0 ELSE {apart} / (CASE WHEN a.v = 0 THEN 1 ELSE abs(a.v) END) END) END AS r "
            f"FROM {ranked('s')} a JOIN {ranked('t')} b ON a.i = b.i"
        )

    tolerances = {c: (1e-6, 1e-4) for c in columns} | {"l_extendedprice": (0.1, 1e-4)}
    return f"WITH {sides} " + differences(union([one(c) for c in columns]), tolerances)


UNPAIRED = ["missing_in_target", "extra_in_target", "repeated_keys", "null_mismatches"]


def key_tolerance() -> str:
    sides = """s AS (SELECT * REPLACE (CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END AS o_custkey) FROM orders),
t0 AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * (1 + 1e-7) ELSE o_totalprice END AS o_totalprice,
                         CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE o_custkey END AS o_custkey)
       FROM orders WHERE o_orderkey % 97 <> 0),
t AS (SELECT * FROM t0 UNION ALL SELECT * FROM t0 WHERE o_orderkey % 61 = 0
      UNION ALL SELECT * REPLACE (o_orderkey + 1000000000000 AS o_orderkey) FROM t0 WHERE o_orderkey % 67 = 0),
a AS (SELECT o_orderkey AS k, count(*) AS n, max(o_totalprice) AS o_totalprice, max(o_custkey) AS o_custkey FROM s GROUP BY 1),
b AS (SELECT o_orderkey AS k, count(*) AS n, max(o_totalprice) AS o_totalprice, max(o_custkey) AS o_custkey FROM t GROUP BY 1)"""
    columns = ["o_totalprice", "o_custkey"]
    single = "a.n = 1 AND b.n = 1"

    def one(c: str) -> str:
        apart = f"CAST(abs(a.{c} - b.{c}) AS DOUBLE)"
        return (
            f"SELECT '{c}' AS {COL}, (SELECT count({c}) FROM s) AS source_count, (SELECT count({c}) FROM t) AS target_count, "
            f"max({apart}) FILTER ({single}) AS d, max({apart} / (CASE WHEN a.{c} = 0 THEN 1 ELSE abs(a.{c}) END)) FILTER ({single}) AS r, "
            f"count(*) FILTER (b.n IS NULL) AS missing_in_target, count(*) FILTER (a.n IS NULL) AS extra_in_target, "
            f"count(*) FILTER (a.n + b.n > 2) AS repeated_keys, "
            f"count(*) FILTER ({single} AND (a.{c} IS NULL) <> (b.{c} IS NULL)) AS null_mismatches "
            f"FROM a FULL JOIN b ON a.k = b.k"
        )

    return f"WITH {sides} " + differences(union([one(c) for c in columns]), {c: (1e-6, 1e-4) for c in columns}, UNPAIRED)


def custom_rules_by_query() -> str:
    def rule(name: str, sql: str, tolerance: float) -> str:
        sv, tv = sql.format(table="s"), sql.format(table="t")
        return f"SELECT 'rule_{name}' AS check_name, CASE WHEN {close('sv', 'tv', tolerance, tolerance)} THEN 'PASSED' ELSE 'FAILED' END AS status FROM (SELECT ({sv}) AS sv, ({tv}) AS tv)"

    rows = [
        rule("late_orders", "SELECT count(*) FROM {table} WHERE o_orderdate >= TIMESTAMP '1997-01-01'", 0.0),
        rule("dearest_open", "SELECT max(o_totalprice) FROM {table} WHERE o_orderstatus = 'O'", 0.5),
        "SELECT 'rule_no_such_column', 'FAILED'",
    ]
    return f"WITH s AS (SELECT * FROM orders), t AS (SELECT * REPLACE (CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice * 3 ELSE o_totalprice END AS o_totalprice) FROM orders) {union(rows)}"


# Where a column stands in each table decides; the count shows that the rows were read.
COLUMN_ORDER = """
SELECT run_id, CASE WHEN first = 'c_custkey' THEN 'PASSED' ELSE 'FAILED' END AS status, (SELECT count(*) FROM customer) AS rows
FROM (VALUES ('same', 'c_custkey'), ('turned', 'c_mktsegment')) AS v(run_id, first)"""

FAILFAST = "SELECT p_partkey, p_name, p_size, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM part"

PREVIEW = """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size,
       (SELECT count(*) FROM part) AS n_rows, (SELECT greatest(count(*) - 10, 0) FROM part) AS n_more
FROM part ORDER BY part.p_partkey LIMIT 10"""


def group_sums(by: list[str], columns: list[str]) -> str:
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in by)
    side = lambda name: f"(SELECT {', '.join(by)}, count(*) AS n, {', '.join(f'sum({c}) AS {c}' for c in columns)} FROM {name} GROUP BY ALL)"
    keys = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in by)
    parts = [
        f"SELECT {keys}, '{c}' AS {COL}, coalesce(a.n, 0) AS source_rows, coalesce(b.n, 0) AS target_rows, "
        f"coalesce(CAST(a.{c} AS DOUBLE), 0) AS source_sum, coalesce(CAST(b.{c} AS DOUBLE), 0) AS target_sum, "
        f"a.n IS NOT NULL AND b.n IS NOT NULL AND abs(coalesce(a.{c}, 0) - coalesce(b.{c}, 0)) <= 1e-6 AS agrees "
        f"FROM {side('s')} a FULL JOIN {side('t')} b ON {on}"
        for c in columns
    ]
    return f"WITH {EXACT_LINEITEM} " + union(parts)


def custom_rules() -> str:
    rules = [
        ("lowest_price", "min(o_totalprice)", 0.0),
        ("open_orders", "count(*) FILTER (o_orderstatus = 'O')", 0.02),
        ("price_spread", "max(o_totalprice) - min(o_totalprice)", 1e-9),
        ("customers", "count(DISTINCT o_custkey)", 0.0),
        ("never_null", "sum(CASE WHEN o_orderkey IS NULL THEN 1 END)", 0.0),
    ]
    parts = [
        f"SELECT rule, round(sv, 4) AS source_value, round(tv, 4) AS target_value, {close('sv', 'tv', tol, tol)} AS agrees FROM "
        f"(SELECT '{name}' AS rule, (SELECT CAST({sql} AS DOUBLE) FROM s) AS sv, (SELECT CAST({sql} AS DOUBLE) FROM t) AS tv)"
        for name, sql, tol in rules
    ]
    return f"WITH {ORDERS} " + union(parts)


def stat(name: str, c: str) -> str:
    if name in PERCENTILES:
        return f"quantile_cont(CAST({c} AS DOUBLE), {PERCENTILES[name]})"
    if name == "non_null":
        return f"CAST(count({c}) AS DOUBLE)"
    if name == "null_ratio":
        return f"(count(*) - count({c})) / count(*)"
    fn = {"mean": "avg", "stddev": "stddev_samp"}.get(name, name)
    return f"{fn}(CAST({c} AS DOUBLE))"


def stats_long(columns: list[str], names: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS {COL}, '{n}' AS stat, (SELECT {stat(n, c)} FROM s) AS sv, (SELECT {stat(n, c)} FROM t) AS tv"
            for c in columns
            for n in names
        ]
    )


STAT_NAMES = ["min", "max", "mean", "stddev", *PERCENTILES]


def side_by_side(columns: list[str], names: list[str]) -> str:
    return f"""WITH {LINEITEM}, p AS ({stats_long(columns, names)})
SELECT 'source' AS side, {COL}, stat, round(sv, 4) AS value FROM p
UNION ALL SELECT 'target', {COL}, stat, round(tv, 4) FROM p"""


RELATIVE = "abs(sv - tv) / (CASE WHEN sv = 0 THEN 1 ELSE abs(sv) END)"


def profile_deviation() -> str:
    return f"""WITH {LINEITEM}, p AS ({stats_long(LINEITEM_NUMBERS, STAT_NAMES)})
SELECT {COL}, stat, round(sv, 4) AS source_value, round(tv, 4) AS target_value, round({RELATIVE}, 4) AS relative_diff,
       coalesce({RELATIVE} > 0.01, FALSE) AS deviates FROM p"""


def confidence() -> str:
    return f"""WITH {LINEITEM}, p AS ({stats_long(LINEITEM_NUMBERS, STAT_NAMES)}),
c AS (SELECT count(*) AS n_stats, count(*) FILTER (NOT coalesce({RELATIVE} > 0.0005, FALSE)) AS n_ok FROM p)
SELECT n_stats, n_ok, round(n_ok / n_stats, 6) AS score, n_ok / n_stats >= 0.95 AS passed FROM c"""


def ratio_rows(columns: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS {COL}, (SELECT count(*) - count({c}) FROM s) AS sn, (SELECT count(*) - count({c}) FROM t) AS tn" for c in columns
    ]
    return f"""SELECT {COL}, sn AS source_nulls, tn AS target_nulls, sr AS source_null_ratio, tr AS target_null_ratio,
       abs(sr - tr) AS delta, abs(sr - tr) > 0.01 AS deviates
FROM (SELECT *, sn / (SELECT count(*) FROM s) AS sr, tn / (SELECT count(*) FROM t) AS tr FROM ({union(parts)}))"""


def null_ratio() -> str:
    return f"""WITH {LINEITEM}
SELECT * REPLACE (round(source_null_ratio, 6) AS source_null_ratio, round(target_null_ratio, 6) AS target_null_ratio,
                  round(delta, 6) AS delta) FROM ({ratio_rows(LINEITEM_COLUMNS)})"""


def cardinality_rows(columns: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS {COL}, (SELECT count(DISTINCT {c}) FROM s) AS source_cardinality, "
        f"(SELECT count(DISTINCT {c}) FROM t) AS target_cardinality"
        for c in columns
    ]
    return f"""SELECT *, abs(source_cardinality - target_cardinality) AS delta,
       abs(source_cardinality - target_cardinality) / greatest(source_cardinality, 1) > 0.01 AS deviates FROM ({union(parts)})"""


def column_checks() -> str:
    """CTE ``checks`` (comparison, layer, check_name, status), as two comparisons make them."""
    comparisons = {"altered": f"SELECT {IN_PLACE} FROM orders WHERE o_orderkey % 97 <> 0", "same": "SELECT * FROM orders"}
    parts = []
    for name, target in comparisons.items():
        sides = f"WITH s AS (SELECT * FROM orders), t AS ({target})"
        label = lambda bad: f"CASE WHEN {bad} THEN 'FAILED' ELSE 'PASSED' END AS status"
        parts += [
            f"({sides} SELECT '{name}' AS comparison, '1_structural' AS layer, 'nulls_' || {COL} AS check_name, "
            f"{label('source_nulls <> target_nulls')} FROM ({ratio_rows(ORDER_COLUMNS)}))",
            f"({sides} SELECT '{name}', '4_statistical', 'null_ratio_' || {COL}, {label('deviates')} FROM ({ratio_rows(ORDER_COLUMNS)}))",
            f"({sides} SELECT '{name}', '4_statistical', 'cardinality_' || {COL}, {label('deviates')} FROM ({cardinality_rows(ORDER_COLUMNS)}))",
            f"({sides} SELECT '{name}', '3_business_rules', 'total_' || lower(\"function\"), "
            f"CASE WHEN \"function\" = 'AVG' THEN 'SKIPPED' WHEN agrees THEN 'PASSED' ELSE 'FAILED' END "
            f"FROM ({totals_rows(['o_totalprice'], 1e-6, 1e-4)}))",
        ]
    return f"checks AS ({union(parts)})"


REPORT_SUMMARY = f"""WITH {column_checks()},
layers AS (SELECT comparison, layer, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' ELSE 'PASSED' END AS status
           FROM checks GROUP BY ALL)
SELECT 'r1' AS run_id, comparison, count(*) AS total_checks, count(*) FILTER (status = 'PASSED') AS passed,
       count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'SKIPPED') AS skipped,
       round(count(*) FILTER (status = 'PASSED') / greatest(count(*) FILTER (status <> 'SKIPPED'), 1), 4) AS pass_rate,
       count(*) FILTER (status = 'FAILED') = 0 AS equivalent,
       coalesce(string_agg(layer || '/' || check_name, ',' ORDER BY layer, check_name) FILTER (status = 'FAILED'), '') AS failures,
       (SELECT string_agg(layer || '=' || l.status, ',' ORDER BY layer) FROM layers l WHERE l.comparison = checks.comparison) AS layer_statuses
FROM checks GROUP BY comparison"""

REPORT_ROUNDTRIP = f"""WITH {column_checks()}
SELECT run_id, comparison, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' ELSE 'PASSED' END AS status
FROM checks, (VALUES ('r1'), ('r2')) AS runs(run_id) GROUP BY run_id, comparison"""


def same(a: str, b: str) -> str:
    return f"NOT EXISTS (({a}) EXCEPT ALL ({b})) AND NOT EXISTS (({b}) EXCEPT ALL ({a}))"


def two_phase_verdict() -> str:
    o, c = f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders", "SELECT * FROM customer"
    altered = f"SELECT {', '.join(ORDER_COLUMNS)} FROM (SELECT {IN_PLACE} FROM orders WHERE o_orderkey % 97 <> 0)"
    cut = "SELECT * FROM customer WHERE c_custkey % 97 <> 0"
    return f"""WITH phases AS (
SELECT 'simulated' AS phase, 1 AS ordinal, {same(o, altered)} AND {same(c, c)} AS success
UNION ALL SELECT 'recorded', 2, {same(o, o)} AND {same(c, c)}
UNION ALL SELECT 'partial', 3, {same(o, o)} AND {same(c, cut)}
UNION ALL SELECT 'without_customer', 4, FALSE)
SELECT CASE WHEN bool_or(success) THEN 'success' ELSE 'failure' END AS status,
       arg_max(phase, ordinal) FILTER (success) AS winning_phase,
       coalesce(arg_max(phase, ordinal) FILTER (success), arg_max(phase, ordinal)) AS reported_phase FROM phases"""


def compare_many() -> str:
    changed = "SELECT * REPLACE (c_acctbal + (CASE WHEN c_custkey % 89 = 0 THEN 1 ELSE 0 END) AS c_acctbal) FROM customer"
    verdict = lambda a, b: f"CASE WHEN {same(a, b)} THEN 'PASSED' ELSE 'FAILED' END"
    return f"""SELECT 'equal' AS comparison, {verdict('SELECT * FROM orders', 'SELECT * FROM orders')} AS status
UNION ALL SELECT 'changed', {verdict('SELECT * FROM customer', changed)}
UNION ALL SELECT 'surplus', {verdict('SELECT * FROM part', 'SELECT * FROM part WHERE FALSE')}
UNION ALL SELECT 'absent', {verdict('SELECT * FROM part WHERE FALSE', 'SELECT * FROM part')}"""


NORMALISE_CHAIN = """
SELECT CAST(o_orderkey AS DOUBLE) AS order_key,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS placed,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS prix,
       strftime(o_orderdate, '%Y') AS prix_1,
       CASE WHEN o_orderkey % 10 = 3 THEN 'see note' ELSE CAST(o_custkey AS VARCHAR) END AS notice
FROM orders"""

PIPELINE = """
SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, 'totals' AS outputs
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""

COMPLETENESS = """WITH found AS (
SELECT 'input' AS part, 'orders' AS table_name, (SELECT count(*) FROM orders) AS n
UNION ALL SELECT 'input', 'customer', (SELECT count(*) FROM customer)
UNION ALL SELECT 'input', 'part', (SELECT count(*) FROM part)
UNION ALL SELECT 'expected', 'orders', (SELECT count(*) FROM orders WHERE o_totalprice < 0)
UNION ALL SELECT 'expected', 'customer', (SELECT count(*) FROM customer)
UNION ALL SELECT 'model', 'orders', (SELECT count(*) FROM orders)
UNION ALL SELECT 'model', 'customer', (SELECT count(*) FROM customer WHERE c_acctbal > 1e12)
UNION ALL SELECT 'model', 'part', (SELECT count(*) FROM part WHERE p_size < 0))
SELECT t.table_name, p.part, CASE WHEN n IS NULL THEN 'missing' ELSE 'empty' END AS problem
FROM (VALUES ('orders'), ('customer'), ('part')) AS t(table_name)
CROSS JOIN (VALUES ('input'), ('expected'), ('model')) AS p(part)
LEFT JOIN found f ON f.table_name = t.table_name AND f.part = p.part WHERE n IS NULL OR n = 0"""


def full_validation() -> str:
    """Each status from the data, by a different road than the engine takes."""
    changed = "(SELECT count(*) FROM s JOIN t USING (o_orderkey) WHERE s.o_totalprice <> t.o_totalprice)"
    same_counts = "(SELECT count(*) FROM s) = (SELECT count(*) FROM t)"
    nulls = " AND ".join(f"(SELECT count({c}) FROM s) = (SELECT count({c}) FROM t)" for c in ORDER_COLUMNS)
    dup = "(SELECT count(*) FROM (SELECT DISTINCT * FROM s)) = (SELECT count(*) FROM (SELECT DISTINCT * FROM t))"
    group_gap = """(SELECT max(abs(a.x - b.x)) FROM (SELECT o_orderpriority, sum(o_totalprice) AS x FROM s GROUP BY 1) a
        JOIN (SELECT o_orderpriority, sum(o_totalprice) AS x FROM t GROUP BY 1) b USING (o_orderpriority))"""
    rank_gap = """(SELECT max(abs(a.v - b.v)) FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i FROM s) a
        JOIN (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i FROM t) b USING (i))"""
    deviating = f"(SELECT count(*) FROM ({stats_long(['o_totalprice', 'o_custkey', 'o_orderkey'], STAT_NAMES)}) WHERE {RELATIVE} > 0.01)"
    checks = [
        ("1_structural", "column_count", "TRUE"),
        ("1_structural", "column_names", "TRUE"),
        ("1_structural", "data_types", "TRUE"),
        ("1_structural", "null_counts", nulls),
        ("2_data_level", "row_count", same_counts),
        ("2_data_level", "full_dataset_hash", f"{changed} = 0"),
        ("2_data_level", "column_level_hash", f"{changed} = 0"),
        ("2_data_level", "duplicate_rows", dup),
        ("2_data_level", "bucketed_checksum", f"{changed} = 0"),
        ("2_data_level", "row_aligned_diff", f"{changed} = 0"),
        ("3_business_rules", "grand_total_aggregations", f"(SELECT bool_and(agrees) FROM ({totals_rows(['o_totalprice'], 1e-6, 1e-4)}))"),
        ("3_business_rules", "float_tolerance", f"{rank_gap} <= 0.5"),
        ("3_business_rules", "group_by_consistency", f"{group_gap} <= 1e-6"),
        ("3_business_rules", "rule_customers", "(SELECT count(DISTINCT o_custkey) FROM s) = (SELECT count(DISTINCT o_custkey) FROM t)"),
        ("4_statistical", "per_column_statistics", f"{deviating} = 0"),
        ("4_statistical", "null_ratio", f"(SELECT bool_and(NOT deviates) FROM ({ratio_rows(ORDER_COLUMNS)}))"),
        ("4_statistical", "cardinality", f"(SELECT bool_and(NOT deviates) FROM ({cardinality_rows(ORDER_COLUMNS)}))"),
        ("4_statistical", "distribution_confidence", f"{deviating} / 21 <= 0.05"),
    ]
    return f"WITH {NOISY_ORDERS} " + union(
        [f"SELECT '{layer}' AS layer, '{name}' AS check_name, CASE WHEN {ok} THEN 'PASSED' ELSE 'FAILED' END AS status" for layer, name, ok in checks]
    )


NORMALISE = """
SELECT c_custkey AS cust_key,
       CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS mkt_segment,
       c_name AS nom_complet,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS acct_bal
FROM customer"""

TEXTUAL = """x AS (SELECT 'K' || o_orderkey AS o_orderkey,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
         WHEN o_orderkey % 10 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS placed,
    CASE WHEN o_orderkey % 4 = 0 THEN 'n.c.' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
    strftime(o_orderdate, '%Y') AS season,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'C' || o_custkey END AS buyer,
    o_orderpriority AS update_mark FROM orders)"""
PARSED = "coalesce(try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%Y-%m-%d'))"
NUMERAL = "regexp_full_match({c}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
TEXT_COLUMNS = ["o_orderkey", "placed", "price", "season", "buyer", "update_mark"]


def type_evidence() -> str:
    parts = [
        f"SELECT '{c}' AS {COL}, count({c}) AS filled, count(*) FILTER (regexp_full_match({c}, '[0-9]{{4}}')) AS years, "
        f"count({PARSED.format(c=c)}) AS dates, count(*) FILTER ({NUMERAL.format(c=c)}) AS numbers FROM x"
        for c in TEXT_COLUMNS
    ]
    hint = lambda words: "(" + " OR ".join(f"contains({COL}, '{w}')" for w in words) + ")"
    dates = ["date", "time", "timestamp", "_at"]
    return f"""WITH {TEXTUAL}, e AS ({union(parts)})
SELECT *, CASE WHEN filled >= 20 AND years / filled <= 0.5 AND ({hint(dates)} OR dates / filled >= 0.8) THEN 'date'
               WHEN filled > 0 AND years / filled <= 0.5 AND NOT {hint([*dates, 'year'])} AND numbers / filled >= 0.5 THEN 'number'
               ELSE 'unchanged' END AS becomes FROM e"""


TYPE_INFERENCE = f"""WITH {TEXTUAL}
SELECT o_orderkey, strftime({PARSED.format(c='placed')}, '%Y-%m-%d %H:%M:%S') AS placed,
       TRY_CAST(price AS DOUBLE) AS price, season, buyer, CAST(NULL AS VARCHAR) AS update_mark FROM x"""

def date_election() -> str:
    """Each column read day first and month first; the reading of more values counts, day first if they are equal."""
    low = "make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate) % 12 + 1)"
    mixed = f"""CASE WHEN o_orderkey % 10 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                     ELSE strftime(o_orderdate, '%-d.%-m.%Y') END"""
    columns = {"day_first": "strftime(o_orderdate, '%d/%m/%Y')", "month_first": "strftime(o_orderdate, '%m/%d/%Y')", "either": f"strftime({low}, '%m/%d/%Y')", "mixed_day": mixed}
    texts = union([f"SELECT '{c}' AS {COL}, {text} AS v FROM orders" for c, text in columns.items()])
    iso, european = "try_strptime(v, '%Y-%m-%d')", "try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%d.%m.%Y')"
    return f"""WITH x AS ({texts}),
r AS (SELECT {COL}, coalesce({iso}, {european}) AS d, coalesce({iso}, try_strptime(v, '%m/%d/%Y')) AS m FROM x),
e AS (SELECT {COL}, count(d) AS nd, count(m) AS nm, count(*) FILTER (d <> m) AS apart,
             sum(date_diff('day', DATE '1970-01-01', d::DATE)) AS dd, sum(date_diff('day', DATE '1970-01-01', m::DATE)) AS dm FROM r GROUP BY {COL})
SELECT {COL}, CASE WHEN nd >= nm THEN 'dMy' ELSE 'Mdy' END AS date_order, CASE WHEN nd = nm THEN apart ELSE 0 END AS n_ambiguous,
       greatest(nd, nm) AS n_read, CAST(CASE WHEN nd >= nm THEN dd ELSE dm END AS BIGINT) AS days FROM e"""


RAW_CUSTOMER = """raw AS (SELECT c_custkey, c_name,
    CASE WHEN c_custkey % 19 = 0 THEN '12,5' WHEN c_custkey % 23 = 0 THEN ''
         ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS c_acctbal,
    CASE WHEN c_custkey % 29 = 0 THEN '1d' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
    CASE WHEN c_custkey % 31 = 0 THEN '31/02/2024'
         ELSE strftime(DATE '2020-01-01' + CAST(c_nationkey AS INTEGER), '%d/%m/%Y') END AS since FROM customer)"""

TYPED_INGEST = f"""WITH {RAW_CUSTOMER}
SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey,
       CAST(nullif(c_acctbal, '') AS DOUBLE) AS c_acctbal, strftime(strptime(since, '%d/%m/%Y'), '%Y-%m-%d') AS since
FROM raw WHERE c_custkey % 19 <> 0 AND c_custkey % 29 <> 0 AND c_custkey % 31 <> 0"""

TYPED_REJECTS = f"""WITH {RAW_CUSTOMER}
SELECT c_custkey, c_acctbal, c_nationkey, since,
       concat_ws(',', CASE WHEN c_custkey % 29 = 0 THEN 'c_nationkey' END, CASE WHEN c_custkey % 19 = 0 THEN 'c_acctbal' END,
                 CASE WHEN c_custkey % 31 = 0 THEN 'since' END) AS bad_columns
FROM raw WHERE c_custkey % 19 = 0 OR c_custkey % 29 = 0 OR c_custkey % 31 = 0"""

RAGGED = """
WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN '"the ""first"", ' || c_name || '"' ELSE c_name END AS raw,
                  CASE WHEN c_custkey % 13 = 0 THEN 'the "first", ' || c_name ELSE c_name END AS c_name, c_nationkey FROM customer
), y AS (SELECT concat_ws(',', c_custkey, raw, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END, CASE WHEN c_custkey % 7 = 0 THEN 'LOST' END) AS record,
                3 - (c_custkey % 11 = 0)::INTEGER + (c_custkey % 7 = 0)::INTEGER AS cells, c_custkey, c_name, c_nationkey FROM x)
SELECT record, CASE WHEN cells = 3 THEN 'not of the declared type: c_nationkey'
                    ELSE CASE WHEN cells > 3 THEN 'too wide: ' ELSE 'too narrow: ' END || cells || ' cells for 3 columns' END AS reason,
       CAST(NULL AS VARCHAR) AS c_name
FROM y WHERE cells <> 3 OR c_custkey % 77 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'row', c_name FROM y WHERE cells = 3 AND c_custkey % 77 <> 0"""

MULTILINE = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
       CASE WHEN o_orderkey % 3 = 0 THEN 'first' || chr(10) || chr(10) || 'of ' || o_orderpriority || chr(13) || chr(10) || '"second", third' ELSE o_orderpriority END AS note
FROM orders"""

CONSTRAINTS = f"""
SELECT 'not_null' AS "constraint", 'l_returnflag' AS {COL}, CAST(NULL AS VARCHAR) AS key, count(*) AS n_rows
FROM lineitem WHERE l_suppkey % 83 = 0 OR l_returnflag IS NULL HAVING count(*) > 0
UNION ALL SELECT 'primary_key', 'l_orderkey,l_linenumber', l_orderkey || '|' || l_linenumber, count(*)
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""


def inferred_profile() -> str:
    columns = {
        "part": {"p_partkey": "integer", "p_name": "string", "p_size": "integer", "p_retailprice": "float"},
        "supplier": {"s_suppkey": "integer", "s_name": "string"},
    }
    return union(
        [
            f"SELECT '{table}' AS table_name, '{c}' AS {COL}, count(*) AS \"rows\", count(coalesce(CAST({c} AS VARCHAR), '')) AS non_null, "
            f"'{kind}' AS inferred_family, count(DISTINCT {c}) AS distinct_values FROM {table}"
            for table, kinds in columns.items()
            for c, kind in kinds.items()
        ]
    )


def delimiters() -> str:
    """Separators in the text of a table written with each of them: two a line, and those inside its values."""
    marks = {"commas": "','", "semicolons": "';'", "tabs": "chr(9)", "pipes": "'|'"}
    text = "CAST(c_custkey AS VARCHAR) || c_name || c_mktsegment"
    own = {n: f"sum(length({text}) - length(replace({text}, {m}, '')))" for n, m in marks.items()}
    rows = [
        f"SELECT '{label}' AS table_name, {', '.join(f'{own[n]} + {2 if n == mine else 0} * count(*) AS {n}' for n in marks)}, {marks[mine]} AS delimiter FROM customer"
        for label, mine in (("comma", "commas"), ("semicolon", "semicolons"), ("tab", "tabs"), ("pipe", "pipes"))
    ]
    return union(rows)


SINKS = """
SELECT copy, count(*) AS n_rows, count(*) FILTER (c_custkey % 9 = 0 OR coalesce(c_mktsegment, '') = '') AS n_blank,
       CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM customer, (VALUES ('csv'), ('extra_csv'), ('table')) AS copies(copy) GROUP BY copy"""

PUBLISHED = """
SELECT o_orderstatus, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price
FROM orders GROUP BY o_orderstatus"""

ATOMIC = """
SELECT state, o_orderstatus, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders, (VALUES ('failed', 0), ('replaced', 1), ('from_itself', 2)) AS s(state, n)
WHERE (n < 1 OR o_orderkey % 97 <> 0) AND (n < 2 OR o_orderkey % 89 <> 0)
GROUP BY state, o_orderstatus"""

SCHEMA_HINTS = """
SELECT difference, count(*) AS n_keys, 'o_orderkey=integer,o_custkey=integer,o_orderstatus=string,o_totalprice=float' AS families
FROM (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'missing_in_target' ELSE 'changed' END AS difference
      FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 OR o_orderkey % 83 = 0)
GROUP BY difference"""

ISOLATION = """
SELECT * FROM (VALUES ('missing', 'FAILED', 'load_error'), ('ragged', 'FAILED', 'load_error'), ('broken', 'FAILED', 'layer_execution_error'), ('rule', 'FAILED', 'rule_rows')) AS t("case", status, failed)"""

DRILLDOWN = """
WITH h AS (SELECT *, ('0x' || substr(md5(md5('v' || o_orderkey)), 1, 15))::BIGINT % 64 AS top, ('0x' || substr(md5(md5('v' || o_orderkey)), 1, 15))::BIGINT % 4096 AS node FROM orders),
d AS (SELECT o_orderkey, top, node, 1::BIGINT AS source_rows, CASE WHEN o_orderkey % 7919 = 0 THEN 0 ELSE 1 END::BIGINT AS target_rows,
             CASE WHEN o_orderkey % 7919 = 0 THEN 'missing_in_target' ELSE 'changed' END AS difference FROM h WHERE o_orderkey % 4999 = 0 OR o_orderkey % 7919 = 0),
crowded AS (SELECT count(DISTINCT top) > 32 AS c FROM d),
moved AS (SELECT sum(CASE WHEN o_orderkey % 7919 = 0 THEN 1 ELSE 2 END)::BIGINT AS n FROM h, crowded
          WHERE CASE WHEN c THEN top IN (SELECT top FROM d) ELSE node IN (SELECT node FROM d) END)
SELECT o_orderkey, source_rows, target_rows, difference, n AS rows_shuffled FROM d, moved"""

INCREMENTAL = f"""
SELECT c AS {COL}, (SELECT count(*) FROM orders) AS "rows", (SELECT count(*) FROM orders) AS non_null, TRUE AS distinct_near, TRUE AS median_near, TRUE AS shared_near,
       (SELECT count(DISTINCT year(o_orderdate)) FROM orders WHERE year(o_orderdate) >= 1996) AS partitions_scanned
FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice'), ('o_orderstatus')) AS t(c)"""

ORACLE: dict[str, str] = {
    "payment_status_job": payment("ORDER BY o_orderkey LIMIT 50"),
    "payment_status_full": payment(""),
    "steps_ctas_chain": STEPS,
    "structural_report": structural(),
    "dataset_fingerprint": dataset_fingerprint(),
    "column_fingerprints": column_fingerprints(),
    "bucket_checksums": bucket_checksums(),
    "fingerprint_match": fingerprint_match(),
    "duplicate_rows": DUPLICATES,
    "row_diff": ROW_DIFF,
    "digest_drilldown": DRILLDOWN,
    "row_diff_repeated_keys": ROW_DIFF_REPEATED,
    "cell_diff": cell_diff(),
    "grand_totals": grand_totals(),
    "rank_tolerance": rank_tolerance(),
    "key_tolerance": key_tolerance(),
    "group_consistency": group_sums(["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"]),
    "group_consistency_many": group_sums(["l_partkey", "l_returnflag"], ["l_quantity"]),
    "custom_rules": custom_rules(),
    "custom_rules_by_query": custom_rules_by_query(),
    "column_order": COLUMN_ORDER,
    "typed_ingest_failfast": FAILFAST,
    "preview_and_fixture": PREVIEW,
    "column_profile": side_by_side(LINEITEM_NUMBERS, ["non_null", "null_ratio", *STAT_NAMES]),
    "profile_deviation": profile_deviation(),
    "confidence": confidence(),
    "incremental_profile": INCREMENTAL,
    "percentiles_by_bin": side_by_side(["l_extendedprice", "l_quantity", "l_orderkey"], list(PERCENTILES)),
    "null_ratio": null_ratio(),
    "cardinality": f"WITH {LINEITEM} {cardinality_rows(LINEITEM_COLUMNS)}",
    "report_summary": REPORT_SUMMARY,
    "report_roundtrip": REPORT_ROUNDTRIP,
    "two_phase_verdict": two_phase_verdict(),
    "compare_many": compare_many(),
    "completeness": COMPLETENESS,
    "full_validation": full_validation(),
    "normalise_nulls_trim": NORMALISE,
    "type_evidence": type_evidence(),
    "type_inference": TYPE_INFERENCE,
    "date_format_election": date_election(),
    "normalise_chain": NORMALISE_CHAIN,
    "typed_ingest": TYPED_INGEST,
    "typed_ingest_rejects": TYPED_REJECTS,
    "ragged_rejects": RAGGED,
    "multiline_ingest": MULTILINE,
    "schema_hints": SCHEMA_HINTS,
    "failure_isolation": ISOLATION,
    "constraint_report": CONSTRAINTS,
    "inferred_ingest_profile": inferred_profile(),
    "delimiter_detect": delimiters(),
    "sink_roundtrip": SINKS,
    "published_run": PUBLISHED,
    "atomic_overwrite": ATOMIC,
    "pipeline_execute": PIPELINE,
}
