"""DuckDB SQL that states, independently of the Spark code, what each registered query must return.

The driver runs these over the same parquet tables (registered as views). Table schemas are fixed
here so the SQL can be written without a Spark session.
"""

from __future__ import annotations

# ---- fixed values: schemas of the driver tables (column, Spark type) ----
SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}

# derived frames used by several queries, as SQL sources
LABELED_DOCS = ("(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
LABELED_DOCS_SCHEMA = [("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
                       ("quality", "int"), ("toxic", "int")]
TEXT_DATES = ("(SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date_text, "
              "strftime(o_orderdate, '%m/%d/%Y') AS ship_month_text, o_orderpriority AS update_note FROM orders)")
TEXT_DATES_SCHEMA = [("o_orderkey", "bigint"), ("order_date_text", "string"), ("ship_month_text", "string"),
                     ("update_note", "string")]


def kind(t: str) -> str:
    if t in ("tinyint", "smallint", "int", "bigint"):
        return "integral"
    if t in ("float", "double") or t.startswith("decimal"):
        return "numeric"
    if t == "string":
        return "string"
    if t in ("date", "timestamp", "timestamp_ntz"):
        return "datetime"
    if t == "boolean":
        return "boolean"
    return "other"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def col_stats(source: str, schema: list[tuple[str, str]], date_ok: dict[str, str] | None = None) -> str:
    """One row per column: counts, distinct, lengths, numeric and datetime stats."""
    date_ok = date_ok or {}
    parts = []
    for i, (c, t) in enumerate(schema):
        k = kind(t)
        num = k in ("integral", "numeric")
        dtm = k == "datetime"
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, '{k}' AS kind, "
            f"COUNT(*) AS n_rows, COUNT({q(c)}) AS non_null, COUNT(DISTINCT {q(c)}) AS unique_count, "
            f"{f'AVG(LENGTH({q(c)}))::DOUBLE' if k == 'string' else 'NULL::DOUBLE'} AS avg_len, "
            f"{f'MIN({q(c)})::DOUBLE' if num else 'NULL::DOUBLE'} AS num_min, "
            f"{f'MAX({q(c)})::DOUBLE' if num else 'NULL::DOUBLE'} AS num_max, "
            f"{f'AVG({q(c)})::DOUBLE' if num else 'NULL::DOUBLE'} AS mean, "
            f"{f'MEDIAN({q(c)})::DOUBLE' if num else 'NULL::DOUBLE'} AS median, "
            f"{f'STDDEV_SAMP({q(c)})::DOUBLE' if num else 'NULL::DOUBLE'} AS std, "
            f"{f'MIN({q(c)})::TIMESTAMP' if dtm else 'NULL::TIMESTAMP'} AS dt_min, "
            f"{f'MAX({q(c)})::TIMESTAMP' if dtm else 'NULL::TIMESTAMP'} AS dt_max, "
            f"{date_ok.get(c, 'FALSE')} AS date_ok "
            f"FROM {source} AS src"
        )
    return " UNION ALL ".join(parts)


SEMANTIC_CASE = """CASE
  WHEN non_null = 0 THEN 'Categorical'
  WHEN ((kind = 'integral' AND non_null = n_rows) OR kind = 'string')
       AND (CASE WHEN kind = 'string' THEN avg_len ELSE 0 END) <= 20
       AND (unique_count = n_rows
            OR (regexp_matches(lower(column_name), 'id|key|code|uuid|pk|number|no')
                AND unique_count::DOUBLE / n_rows > 0.8 AND unique_count > 5)) THEN 'ID'
  WHEN kind = 'datetime' THEN 'Datetime'
  WHEN kind = 'string' AND date_ok THEN 'Datetime'
  WHEN kind = 'boolean' THEN 'Categorical'
  WHEN unique_count <= 15 THEN 'Categorical'
  WHEN kind IN ('integral', 'numeric') THEN 'Numeric'
  WHEN kind = 'string' AND avg_len > 30 AND unique_count::DOUBLE / n_rows > 0.5 THEN 'Text'
  ELSE 'Categorical' END"""


def typed_stats(source: str, schema, date_ok=None) -> str:
    """col_stats + semantic_type + missing columns."""
    return (
        f"(SELECT *, {SEMANTIC_CASE} AS semantic_type, n_rows - non_null AS missing_count, "
        f"ROUND_EVEN(CASE WHEN n_rows = 0 THEN 0.0 ELSE (n_rows - non_null)::DOUBLE / n_rows * 100 END, 2) "
        f"AS missing_percentage, "
        f"CASE WHEN n_rows = 0 THEN 0.0 ELSE unique_count::DOUBLE / n_rows END AS unique_ratio "
        f"FROM ({col_stats(source, schema, date_ok)}))"
    )


def value_counts(source: str, schema, only: list[str] | None = None) -> str:
    """(ordinal, column_name, value, cnt) over the text form of each value."""
    parts = []
    for i, (c, t) in enumerate(schema):
        if only is not None and c not in only:
            continue
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS column_name, CAST({q(c)} AS VARCHAR) AS value, COUNT(*) AS cnt "
            f"FROM {source} AS src WHERE {q(c)} IS NOT NULL GROUP BY 1, 2, 3"
        )
    return " UNION ALL ".join(parts)


def top_values(source: str, schema, k: int = 5) -> str:
    """Top-k values of the Categorical columns with count and % of non-null (2 dp, half-even)."""
    ts = typed_stats(source, schema)
    return (
        f"SELECT v.ordinal, v.column_name, v.rnk AS rank, v.value, v.cnt AS count, "
        f"ROUND_EVEN(v.cnt::DOUBLE / s.non_null * 100, 2) AS percentage FROM "
        f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY ordinal ORDER BY cnt DESC, value ASC) AS rnk "
        f" FROM ({value_counts(source, schema)})) v JOIN {ts} s ON v.ordinal = s.ordinal "
        f"WHERE s.semantic_type = 'Categorical' AND v.rnk <= {k}"
    )


def r6(expr: str) -> str:
    return f"ROUND({expr}, 6)"
