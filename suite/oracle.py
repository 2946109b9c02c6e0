"""The same results in SQL for DuckDB, over the same tables."""

from __future__ import annotations

from rowsight.fixtures import TABLES, VIEWS, with_view
from rowsight.operators import generate
from rowsight.plans.recommend import RULES
from suite.queries import AS_OF, ASKED, ASSESSED, NAMES, SCHEMA_OF

PLACEHOLDERS = "('<NA>', '', 'NULL', 'null')"

# columns of the profiled views: (name, class, is text)
ORDERS = [("order_id", "categorical", 0), ("cust_id", "categorical", 0), ("o_orderstatus", "categorical", 1), ("o_orderdate", "temporal", 0),
          ("o_orderpriority", "categorical", 1), ("o_totalprice", "numeric", 0)]
LINEITEM = [("l_orderkey", "numeric", 0), ("l_partkey", "numeric", 0), ("l_suppkey", "numeric", 0), ("l_linenumber", "numeric", 0),
            ("l_quantity", "numeric", 0), ("l_extendedprice", "numeric", 0), ("l_discount", "numeric", 0), ("l_tax", "numeric", 0),
            ("l_shipdate", "temporal", 0), ("l_returnflag", "categorical", 1), ("l_linestatus", "categorical", 1)]
CUSTOMER = [("c_custkey", "numeric", 0), ("c_name", "categorical", 1), ("c_nationkey", "numeric", 0), ("c_acctbal", "numeric", 0), ("c_mktsegment", "categorical", 1)]
DOCUMENTS = [("doc_id", "categorical", 0), ("text", "categorical", 1), ("lang", "categorical", 1), ("source", "categorical", 1), ("n_chars", "numeric", 0),
             ("quality", "numeric", 0), ("toxic", "numeric", 0)]
KNOWN = {
    "stage_sales.public.orders": ("postgres", "dirty_orders", ORDERS),
    "PROD_SALES.PUBLIC.CUSTOMER": ("snowflake", "customer", CUSTOMER),
    "DATA_HUB.CORE.LINEITEM": ("snowflake", "dirty_lineitem", LINEITEM),
    "data_hub.core.documents": ("postgres", "doc_labels", DOCUMENTS),
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def views(*names: str) -> str:
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in names if n in VIEWS)


def percent(n: str, t: str) -> str:
    return f"CASE WHEN {t} > 0 THEN (({n} * 20000 + {t}) // (2 * {t})) / 100.0 END"


def missing(col: str, text: bool, placeholders: bool = True) -> str:
    return f"({col} IS NULL OR {col} IN {PLACEHOLDERS})" if text and placeholders else f"({col} IS NULL)"


def micros(x: str) -> str:
    return f"make_timestamp(CAST(floor({x}) AS BIGINT))"


def stats_rows(view: str, columns) -> str:
    """Every statistic of every column; times in microseconds."""
    out = []
    for i, (c, kind, text) in enumerate(columns):
        x = f"CAST(epoch_us({c}) AS DOUBLE)" if kind == "temporal" else f"CAST({c} AS DOUBLE)" if kind == "numeric" else "CAST(NULL AS DOUBLE)"
        label = f"CAST({c} AS VARCHAR)" if kind == "categorical" else "CAST(NULL AS VARCHAR)"
        mode = f"(SELECT {label} AS v, count(*) AS n FROM {view} WHERE {label} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"
        unique = f"count(DISTINCT {label})" if kind == "categorical" else "CAST(NULL AS BIGINT)"
        std = f"stddev_samp({x})" if kind == "numeric" else "CAST(NULL AS DOUBLE)"
        out.append(
            f"SELECT {i} AS ordinal, '{c}' AS column_name, '{kind}' AS type_class, count(*) AS total_rows, "
            f"count(*) FILTER (WHERE {missing(c, text)}) AS null_count, count({c}) AS count, {unique} AS uniq, "
            f"(SELECT v FROM {mode}) AS top, (SELECT n FROM {mode}) AS freq, avg({x}) AS mean, {std} AS std, min({x}) AS min, "
            f"quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75, max({x}) AS max FROM {view}"
        )
    return " UNION ALL ".join(out)


def distinct_rows(view: str) -> str:
    return f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {view}))"


def check_rows(names=KNOWN) -> str:
    """CTEs: per-column statistics and check rows of the known tables."""
    stats = " UNION ALL ".join(f"SELECT {q(d)} AS dataset_id, * FROM ({stats_rows(KNOWN[d][1], KNOWN[d][2])})" for d in names)
    nulls = f"SELECT *, {percent('null_count', 'total_rows')} AS null_percentage FROM stats WHERE null_count > 0"
    checks = []
    for d in names:
        kind, view, columns = KNOWN[d]
        head = f"{q(d)} AS dataset_id, '{kind}' AS connector"
        width = len(columns)
        dup = f"(SELECT count(*) FROM {view}) - {distinct_rows(view)}"
        checks.append(
            f"SELECT {head}, 'duplicates' AS check_name, CASE WHEN {dup} = 0 THEN 'success' ELSE 'failure' END AS status, "
            f"(SELECT count(*) FROM {view}) AS total_rows, {width} AS total_columns, {dup} AS metric_value"
        )
        checks.append(
            f"SELECT {head}, 'null_values', 'success', (SELECT count(*) FROM {view}), {width}, "
            f"(SELECT count(*) FROM nulls WHERE dataset_id = {q(d)})"
        )
        checks.append(f"SELECT {head}, 'descriptive_stats', 'success', (SELECT count(*) FROM {view}), {width}, {width}")
    made = (
        "SELECT *, status = 'success' AND NOT (check_name IN ('duplicates', 'null_values') AND metric_value > 0) AS passed "
        f"FROM ({' UNION ALL '.join(checks)})"
    )
    fixtures = views(*dict.fromkeys(KNOWN[d][1] for d in names))
    return f"WITH {fixtures}, stats AS ({stats}), nulls AS ({nulls}), checks AS ({made})"


def filled(text: str, *parts: str) -> str:
    pieces = text.split("{}")
    out = q(pieces[0])
    for p, t in zip(parts, pieces[1:]):
        out += f" || {p} || {q(t)}"
    return out


def recommendations(names=KNOWN) -> str:
    def rule(name, order, body, parts=(), title=(), priority=None, ordinal="0"):
        t, level, d = RULES[name]
        level = priority or q(level)
        return (
            f"SELECT dataset_id, '{name}' AS rule_id, {filled(t, *title)} AS title, {filled(d, *parts)} AS description, {level} AS priority, "
            f"{order} AS step, {ordinal} AS spot, {1 if name == 'cardinality' else 0} AS sub {body}"
        )

    named = "(SELECT string_agg('`' || column_name || '`', ', ' ORDER BY null_percentage DESC, ordinal) FROM (SELECT * FROM nulls n WHERE n.dataset_id = d.dataset_id AND {} ORDER BY null_percentage DESC, ordinal LIMIT 3))"
    sets = "FROM (SELECT DISTINCT dataset_id FROM checks) d"
    high, some = "n.null_percentage > 20", "n.null_percentage > 5 AND n.null_percentage <= 20"
    exists = "WHERE EXISTS (SELECT 1 FROM nulls n WHERE n.dataset_id = d.dataset_id AND {})"
    width = "(SELECT count(*) FROM {} n WHERE n.dataset_id = d.dataset_id)"
    rate = "(SELECT avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) FROM checks c WHERE c.dataset_id = d.dataset_id)"
    shown = f"format('{{:.0f}}', {rate} * 100) || '%'"
    cv = "std / abs(mean) * 100"
    parts = [
        rule("duplicates", 1, "FROM checks WHERE check_name = 'duplicates' AND metric_value > 0", ["format('{:,}', metric_value)"],
             priority="CASE WHEN metric_value > 1000 THEN 'High' ELSE 'Medium' END"),
        rule("high_nulls", 2, f"{sets} {exists.format(high)}", [named.format(high)]),
        rule("some_nulls", 3, f"{sets} {exists.format(some)}", [named.format(some)]),
        rule("many_null_columns", 4, f"{sets} WHERE {width.format('nulls')} > 5", [f"CAST({width.format('nulls')} AS VARCHAR)"]),
        rule("variability", 5, f"FROM stats WHERE std IS NOT NULL AND mean <> 0 AND {cv} > 35", ["column_name", f"format('{{:.2f}}', {cv})"], ["column_name"], ordinal="ordinal"),
        rule("cardinality", 5, "FROM stats WHERE uniq IS NOT NULL AND count > 0 AND uniq / count > 0.95 AND uniq > 100",
             ["column_name", "format('{:,}', uniq)"], ["column_name"], ordinal="ordinal"),
        rule("wide_table", 6, f"{sets} WHERE {width.format('stats')} > 10", [f"CAST({width.format('stats')} AS VARCHAR)"]),
        rule("low_pass_rate", 8, f"{sets} WHERE {rate} < 0.5", [shown]),
        rule("fair_pass_rate", 8, f"{sets} WHERE {rate} >= 0.5 AND {rate} < 0.8", [shown]),
    ]
    return (
        f"{check_rows(names)}, advice AS ({' UNION ALL '.join(parts)}) SELECT dataset_id, "
        "row_number() OVER (PARTITION BY dataset_id ORDER BY CASE priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, step, spot, sub) AS position, "
        "rule_id, title, description, priority FROM advice"
    )


def profile_select(dataset: str, view: str, columns, kinds) -> str:
    time = "type_class = 'temporal'"
    numbers = ", ".join(f"CASE WHEN NOT {time} THEN round({s}, 4) END AS {s}" for s in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    times = ", ".join(
        f"CASE WHEN {time} THEN {micros(s) if s != 'mean' else 'date_trunc(' + chr(39) + 'second' + chr(39) + ', ' + micros(s) + ')'} END AS ts_{s}"
        for s in ("mean", "min", "p25", "p50", "p75", "max")
    )
    chosen = [c for c in columns]
    rows = stats_rows(view, chosen)
    return (
        f"SELECT '{dataset}' AS dataset_id, column_name, ordinal, type_class, count, uniq AS \"unique\", top, freq, {numbers}, {times} "
        f"FROM ({rows}) WHERE type_class IN ({', '.join(map(q, kinds))})"
    )


def duplicates_sql(dataset: str, view: str, columns: str = "*") -> str:
    body = (
        f"SELECT '{dataset}' AS dataset_id, t AS total_rows, t - d AS duplicate_qty, coalesce({percent('(t - d)', 't')}, 0.0) AS duplicate_percentage, "
        f"CASE WHEN t = d THEN 'success' ELSE 'failure' END AS status "
        f"FROM (SELECT (SELECT count(*) FROM {view}) AS t, (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {view})) AS d)"
    )
    return with_view(view, body) if view in VIEWS else body


def cleansing(view: str, dataset: str, rules: list[tuple[str, str]]) -> tuple[str, str]:
    """(cleansed rows, attrition rows)"""
    kept = with_view(view, f"SELECT DISTINCT * FROM {view} WHERE " + " AND ".join(f"({r})" for _, r in rules))
    steps, before = [], f"SELECT count(*) AS n FROM {view}"
    filters = ["TRUE"]
    for i, (name, rule) in enumerate([("duplicates", "TRUE"), *rules]):
        filters.append(f"({rule})")
        after = f"SELECT count(*) AS n FROM (SELECT DISTINCT * FROM {view}) WHERE " + " AND ".join(filters)
        steps.append(
            f"SELECT '{dataset}' AS dataset_id, {i} AS step, '{name}' AS rule, a.n AS rows_before, a.n - b.n AS removed, b.n AS rows_after "
            f"FROM ({before}) a, ({after}) b"
        )
        before = after
    return kept, " UNION ALL ".join(steps)


CUSTOMER_RULES = [("required values", "email IS NOT NULL AND customer_id IS NOT NULL"), ("valid age", "age >= 18 AND age <= 100"),
                  ("income not negative", "income >= 0"), ("balance in range", "account_balance <= 1000000")]
PRODUCT_RULES = [("required values", "product_name IS NOT NULL AND product_id IS NOT NULL AND sku IS NOT NULL"), ("positive price", "price > 0"),
                 ("stock not negative", "stock_quantity >= 0"), ("valid rating", "rating >= 1 AND rating <= 5"),
                 ("weight in range", "weight IS NULL OR weight <= 1000")]
INVOICE_RULES = [("required values", "invoice_id IS NOT NULL AND customer_id IS NOT NULL AND product_id IS NOT NULL AND invoice_date IS NOT NULL"),
                 ("positive quantity", "quantity > 0"), ("positive unit price", "unit_price > 0"), ("positive total", "total_amount > 0"),
                 ("valid tax rate", "tax_rate IS NULL OR (tax_rate >= 0 AND tax_rate <= 1)"),
                 ("discount not negative", "discount_amount IS NULL OR discount_amount >= 0"), ("quantity in range", "quantity <= 1000")]


def hex52(digest: str) -> str:
    return f"CAST('0x' || substr({digest}, 1, 13) AS BIGINT)"


def chosen(column: str, rate: float, salt: str) -> str:
    return (
        f"row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':{salt}:42')) <= floor(count(*) OVER () * CAST({rate} AS DOUBLE)) AS {column}"
    )


def keyword_sql(index: str) -> str:
    """CTE body: (keyword, connector, first) from the configured sources and an index."""
    def words(db):
        return f"list_prepend({db}, list_filter(regexp_split_to_array(replace({db}, '_', ' '), '\\s+'), lambda w: length(w) >= 3))"

    staging = "['stage', 'staging', 'dev', 'development', 'test']"
    production = "['prod', 'production', 'live']"
    return f"""
      WITH sources AS (SELECT 1 AS no, 'snowflake' AS connector, 'prod_sales' AS db UNION ALL SELECT 2, 'postgres', 'stage_sales'),
      configured AS (
        SELECT 0 AS stage, no, '' AS name, connector,
               list_concat([db], CASE WHEN regexp_matches(db, 'stage|staging|dev|test') THEN {staging}
                                      WHEN regexp_matches(db, 'prod|production|live') THEN {production} ELSE [] END,
                           list_filter(regexp_split_to_array(replace(db, '_', ' '), '\\s+'), lambda w: length(w) >= 3)) AS words
        FROM sources),
      indexed AS (
        SELECT 1 AS stage, 0 AS no, full_name AS name, connector, {words("lower(split_part(full_name, '.', 1))")} AS words
        FROM {index} WHERE contains(full_name, '.')),
      written AS (
        SELECT stage, no, name, connector, unnest(words) AS keyword, generate_subscripts(words, 1) AS minor
        FROM (SELECT * FROM configured UNION ALL SELECT * FROM indexed))
      SELECT keyword, arg_max(connector, (stage, no, name, minor, connector)) AS connector, min((stage, no, name, minor)) AS first
      FROM written GROUP BY keyword"""


def options(label: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {label} = {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


def index_sql(source: str) -> str:
    low = f"({options('label', NAMES)} || '_' || CAST(vec_id AS VARCHAR))"
    return (
        f"SELECT CASE WHEN label % 2 = 0 THEN 'stage_sales.public.' || {low} ELSE 'PROD_SALES.PUBLIC.' || upper({low}) END AS full_name, "
        f"CASE WHEN label % 2 = 0 THEN {low} ELSE upper({low}) END AS table_name, "
        f"CASE WHEN label % 2 = 0 THEN 'postgres' ELSE 'snowflake' END AS connector, embedding FROM {source}"
    )


FIRST = "SELECT label, min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label"
DISTANCE = "list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def scored_sql(requests: str, index: str, pool: int) -> str:
    """CTEs up to the scored candidates."""
    env_s, env_p = "stage|staging|dev|development|test", "prod|production|live"

    def env(words):
        order = " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(words.split("|")))
        return f"(SELECT arg_min(connector, CASE keyword {order} END) FROM keywords WHERE keyword IN ({', '.join(map(q, words.split('|')))}))"

    return f"""
    WITH firsts AS ({FIRST}), requests AS ({requests}), idx AS ({index}), keywords AS ({keyword_sql('idx')}),
    words AS (SELECT request_id, unnest(w) AS word, generate_subscripts(w, 1) AS at
              FROM (SELECT request_id, regexp_split_to_array(replace(lower(text), '_', ' '), '\\s+') AS w FROM requests)),
    preferred AS (
      SELECT request_id, coalesce(
        CASE WHEN contains(lower(text), 'postgres') THEN 'postgres' WHEN contains(lower(text), 'snowflake') THEN 'snowflake' END,
        (SELECT arg_min(k.connector, w.at) FROM words w JOIN keywords k ON k.keyword = w.word WHERE w.request_id = r.request_id),
        (SELECT arg_min(k.connector, k.first) FROM keywords k WHERE contains(lower(r.text), k.keyword)),
        CASE WHEN regexp_matches(lower(text), '{env_s}') THEN {env(env_s)} WHEN regexp_matches(lower(text), '{env_p}') THEN {env(env_p)} END) AS preferred
      FROM requests r),
    near AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, full_name) AS near_rank
        FROM (SELECT r.request_id, lower(r.text) AS low, i.full_name, i.table_name, i.connector, {DISTANCE.format(a='r.embedding', b='i.embedding')} AS distance
              FROM requests r, idx i)) WHERE near_rank <= {pool}),
    boosts AS (
      SELECT n.*, p.preferred, 1 - distance AS base_score, coalesce(n.connector = p.preferred, FALSE) AS boosted,
             len(list_filter(regexp_split_to_array(trim(low), '\\s+'), lambda w: length(w) >= 3 AND contains(lower(n.table_name), w))) * CAST(0.2 AS DOUBLE) AS table_boost
      FROM near n JOIN preferred p ON p.request_id = n.request_id),
    scored AS (
      SELECT *, least(CASE WHEN boosted THEN least(base_score + CAST(0.3 AS DOUBLE), 1.0) ELSE base_score END + table_boost, 1.0) AS score FROM boosts)"""


def gate_sql(requests: str, index: str, tail: str) -> str:
    return f"""{scored_sql(requests, index, 20)},
    good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, distance, full_name) AS rank
             FROM scored WHERE near_rank <= 10 AND score >= 0.2) WHERE rank <= 3),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, distance, full_name) AS rank
             FROM scored WHERE score >= 0) WHERE rank = 1),
    counted AS (SELECT r.request_id, (SELECT count(*) FROM good g WHERE g.request_id = r.request_id) AS n FROM requests r)
    {tail}"""


GATE_TAIL = """
    SELECT c.request_id, n > 0 AS found, n AS table_count, g.full_name AS best_table,
      CASE WHEN n > 0 THEN NULL
           WHEN b.full_name IS NOT NULL THEN 'No tables found with sufficient relevance (minimum 20% match required). Best match was ''' || b.full_name
             || ''' with only ' || format('{:.1f}', b.score * 100)
             || '% relevance. Please try a more specific table name or check if the table exists in your schema index.'
           ELSE 'No relevant tables found. Please ensure the schema index is built.' END AS message
    FROM counted c LEFT JOIN good g ON g.request_id = c.request_id AND g.rank = 1 LEFT JOIN best b ON b.request_id = c.request_id"""

CONTEXT_TAIL = """
    SELECT c.request_id, CASE WHEN n > 0 THEN 'RELEVANT TABLES (ranked by relevance):' || chr(10) || chr(10) || (
        SELECT string_agg('--- Table #' || rank || ' ---' || chr(10) || 'Connector Type: ' || upper(connector) || chr(10) || 'Full Name: ' || full_name
          || chr(10) || 'Relevance: ' || format('{:.2f}', score * 100) || '%' || chr(10) || 'Metadata:' || chr(10) || 'TABLE: ' || full_name || chr(10),
          chr(10) ORDER BY rank) FROM good g WHERE g.request_id = c.request_id) END AS context
    FROM counted c"""

NAMED = r"""coalesce(nullif(regexp_extract(output, '`([^`]+\.[^`]+\.[^`]+)`', 1), ''),
    nullif(regexp_extract(output, '([A-Z_]+\.[A-Z_]+\.[A-Z_]+)', 1), ''), nullif(regexp_extract(output, '([a-z_]+\.[a-z_]+\.[a-z_]+)', 1), ''))"""
CONNECTOR = """CASE WHEN dataset_id IS NULL THEN NULL WHEN contains(lower(output), 'snowflake') THEN 'snowflake'
    WHEN contains(lower(output), 'postgres') THEN 'postgres'
    WHEN upper(dataset_id) LIKE 'STAGE%' OR contains(upper(dataset_id), '_STAGE') THEN 'postgres'
    WHEN upper(dataset_id) LIKE 'PROD%' OR contains(upper(dataset_id), '_PROD') THEN 'snowflake'
    WHEN dataset_id = upper(dataset_id) AND dataset_id <> lower(dataset_id) THEN 'snowflake' ELSE 'postgres' END"""
SUFFIX = """lower(CASE WHEN len(string_split(dataset_id, '.')) >= 3 THEN split_part(dataset_id, '.', 1) || '_' || split_part(dataset_id, '.', 3)
    ELSE replace(dataset_id, '.', '_') END)"""
VALID = "NOT (contains(output, 'No tables found with sufficient relevance') OR contains(output, 'No relevant tables found'))"


class Draw:
    """SQL for values drawn by digests of ``id``, seed 42."""

    @staticmethod
    def uniform(salt: str) -> str:
        return f"((('0x' || substr(md5(id || ':{salt}:42'), 1, 13))::UBIGINT) / 4503599627370496::DOUBLE)"

    def real(self, salt, low, high, digits=2):
        return f"round({self.uniform(salt)} * {high - low}::DOUBLE + {low}::DOUBLE, {digits})"

    def whole(self, salt, low, high):
        return f"CAST(floor({self.uniform(salt)} * {high - low + 1}) + {low} AS INTEGER)"

    def choice(self, salt, options_, capital=False):
        made = [o[:1].upper() + o[1:] if capital else o for o in options_]
        return f"([{', '.join(map(q, made))}])[{self.whole(salt, 1, len(made))}]"

    def words(self, salt, n, capital=False):
        return " || ' ' || ".join(self.choice(f"{salt}{i}", generate.WORDS, capital) for i in range(n))

    def company(self, salt):
        return f"{self.choice(salt, generate.LAST)} || ' ' || {self.choice(salt + '2', ['Group', 'Ltd', 'and Sons', 'Partners'])}"

    def address(self, salt):
        return (f"{self.whole(salt, 1, 9999)} || ' ' || {self.choice(salt + 's', generate.WORDS, True)} || ' Street, ' || {self.choice(salt + 'c', generate.CITIES)} "
                f"|| ' ' || lpad(CAST({self.whole(salt + 'z', 0, 99999)} AS VARCHAR), 5, '0')")


def made_sql(today: str) -> dict[str, str]:
    """Customers and products before any defect."""
    d, g = Draw(), generate
    day = lambda salt, low, high: f"CAST(DATE '{today}' - {d.whole(salt, low, high)} AS DATE)"
    shown = lambda columns: ", ".join(f"{v} AS {k}" for k, v in columns.items())
    first, last = d.choice("first", g.FIRST), d.choice("last", g.LAST)
    customers = {
        "customer_id": "id", "first_name": first, "last_name": last, "email": f"lower({first}) || '.' || lower({last}) || id || '@example.com'",
        "phone": f"'555-' || lpad(CAST({d.whole('phone', 0, 9999999)} AS VARCHAR), 7, '0')", "address": d.address("home"), "city": d.choice("city", g.CITIES),
        "state": d.choice("state", g.STATES), "zip_code": f"lpad(CAST({d.whole('zip', 0, 99999)} AS VARCHAR), 5, '0')", "country": d.choice("country", g.COUNTRIES),
        "date_of_birth": day("birth", 18 * 365 + 5, 85 * 365), "age": d.whole("age", 18, 85), "gender": d.choice("gender", g.GENDERS), "company": d.company("employer"),
        "job_title": d.choice("job", g.JOBS),
        "income": f"CAST(greatest(0, {d.whole('income', 25000, 150000)} + ({d.whole('age', 18, 85)} - 30) * {d.whole('slope', 500, 2000)}) AS DOUBLE)",
        "account_balance": f"CAST({d.real('balance', -5000.0, 50000.0)} AS DECIMAL(12, 2))", "credit_score": d.whole("score", 300, 850),
        "registration_date": day("registered", 0, 5 * 365), "last_login": day("login", 0, 90), "is_active": f"{d.uniform('active')} < 0.5", "customer_segment": d.choice("segment", g.SEGMENTS),
    }
    low, high = (f"(CASE category {' '.join(f'WHEN {q(c)} THEN {ends[k]}' for c, ends in g.CATEGORIES.items())} END)::DOUBLE" for k in (0, 1))
    side = " || 'x' || ".join(d.whole(f"side{i}", 5, 100) for i in range(3))
    products = {
        "product_id": "id", "sku": f"'SKU-' || {d.whole('sku', 100000, 999999)}", "product_name": d.words("name", 3, True),
        "description": f"CASE WHEN {d.uniform('long')} > 0.1::DOUBLE THEN {d.words('text', 24)} ELSE {d.words('text', 6)} END", "category": "category",
        "subcategory": d.choice("sub", g.WORDS, True), "brand": d.company("brand"), "supplier": d.company("supplier"), "price": "price",
        "cost": f"round(price * ({d.uniform('cost')} * 0.2::DOUBLE + 0.7::DOUBLE), 2)", "currency": d.choice("currency", g.CURRENCIES), "stock_quantity": "stock_quantity",
        "reorder_level": d.whole("reorder", 10, 100), "weight": d.real("weight", 0.1, 50.0), "dimensions": f"{side} || ' cm'", "color": d.choice("color", g.COLORS),
        "size": d.choice("size", g.SIZES), "material": d.choice("material", g.MATERIALS), "rating": d.real("rating", 1.0, 5.0, 1), "review_count": d.whole("reviews", 0, 5000),
        "is_available": "stock_quantity > 0", "is_featured": f"{d.uniform('featured')} < 0.5", "discount_percentage": d.real("discount", 0.0, 30.0, 1), "created_date": "created_date",
        "last_updated": f"CAST(created_date + CAST(floor({d.uniform('updated')} * (DATE '{today}' - created_date + 1)) AS INTEGER) AS DATE)",
    }
    drawn = (f"SELECT id, category, round({d.uniform('price')} * ({high} - {low}) + {low}, 2) AS price, {d.whole('stock', 0, 1000)} AS stock_quantity, {day('created', 0, 3 * 365)} AS created_date "
             f"FROM (SELECT p_partkey AS id, {d.choice('category', list(g.CATEGORIES)).replace('id ||', 'p_partkey ||')} AS category FROM part)")
    return {
        "made_customers": f"SELECT {shown(customers)} FROM (SELECT c_custkey AS id FROM customer)",
        "made_products": f"SELECT {shown(products)} FROM ({drawn})",
    }


def all_sql() -> dict[str, str]:
    sql: dict[str, str] = made_sql(AS_OF.isoformat())
    sql["scan_table"] = "SELECT * FROM lineitem"
    sql["scan_query"] = "SELECT o_custkey, count(*) AS order_count, max(o_totalprice) AS top_price FROM orders GROUP BY o_custkey"
    sql["scan_limit"] = "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100"
    sql["table_sample"] = "SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5"

    sql["dup_check"] = duplicates_sql("dirty_orders", "dirty_orders")
    sql["dup_check_hashed"] = duplicates_sql("dirty_lineitem", "dirty_lineitem")
    sql["dup_check_key"] = duplicates_sql("dirty_orders", "dirty_orders", "cust_id, o_orderstatus, o_orderdate, o_orderpriority")
    sql["dup_check_text"] = duplicates_sql("documents", "documents", "text")
    sql["dup_examples"] = (
        "SELECT l_returnflag, l_linestatus, l_shipdate, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1 "
        "ORDER BY copies DESC, l_returnflag, l_linestatus, l_shipdate LIMIT 3"
    )

    def nulled(view, columns, placeholders=True):
        return " UNION ALL ".join(
            f"SELECT {i} AS ordinal, '{c}' AS column_name, count(*) FILTER (WHERE {missing(c, t, placeholders)}) AS null_count, count(*) AS total_rows FROM {view}"
            for i, (c, _, t) in enumerate(columns)
        )

    sql["null_normalize"] = with_view("dirty_orders", "SELECT order_id, cust_id, " + ", ".join(
        f"CASE WHEN {c} NOT IN {PLACEHOLDERS} THEN {c} END AS {c}" for c in ("o_orderstatus", "o_orderpriority")
    ) + ", o_orderdate, o_totalprice FROM dirty_orders")
    sql["null_profile"] = with_view("dirty_orders", (
        f"SELECT 'dirty_orders' AS dataset_id, column_name, ordinal, null_count, {percent('null_count', 'total_rows')} AS null_percentage "
        f"FROM ({nulled('dirty_orders', ORDERS)}) WHERE null_count > 0"))
    sql["null_summary"] = with_view("doc_labels", (
        f"SELECT 'doc_labels' AS dataset_id, max(total_rows) AS total_rows, 7 AS total_columns, count(*) FILTER (WHERE null_count > 0) AS columns_with_nulls, "
        f"{percent('count(*) FILTER (WHERE null_count > 0)', '7')} AS missing_coverage, 'success' AS status FROM ({nulled('doc_labels', DOCUMENTS)})"))
    sql["null_rates"] = with_view("dirty_orders", (
        f"SELECT 'dirty_orders' AS dataset_id, column_name, ordinal, null_count, round(null_count / total_rows, 4) AS null_rate FROM ({nulled('dirty_orders', ORDERS, False)})"))
    bits = " || ".join(f"CASE WHEN {missing(c, t)} THEN '1' ELSE '0' END" for c, _, t in ORDERS)
    sql["null_patterns"] = with_view("dirty_orders", (
        f"SELECT 'dirty_orders' AS dataset_id, pattern, length(replace(pattern, '0', '')) AS missing_columns, count(*) AS row_count "
        f"FROM (SELECT {bits} AS pattern FROM dirty_orders) GROUP BY pattern"))
    sql["completeness"] = with_view("dirty_orders", (
        f"SELECT 'dirty_orders' AS dataset_id, max(total_rows) * 6 AS cells, CAST(sum(null_count) AS BIGINT) AS missing_cells, "
        f"round(1 - sum(null_count) / (max(total_rows) * 6), 4) AS completeness FROM ({nulled('dirty_orders', ORDERS)})"))

    every = ("numeric", "categorical", "temporal")
    profile = profile_select("dirty_lineitem", "dirty_lineitem", LINEITEM, ("numeric",))
    sql["numeric_profile"] = with_view("dirty_lineitem", f"SELECT dataset_id, column_name, ordinal, count, mean, std, min, p25, p50, p75, max FROM ({profile})")
    profile = profile_select("dirty_orders", "dirty_orders", ORDERS, ("categorical",))
    sql["categorical_profile"] = with_view("dirty_orders", f"SELECT dataset_id, column_name, ordinal, count, \"unique\", top, freq FROM ({profile})")
    times = "dataset_id, column_name, ordinal, count, ts_mean, ts_min, ts_p25, ts_p50, ts_p75, ts_max"
    events = [(c, "temporal" if c == "ts" else "numeric", 0) for c in ("event_id", "ts")]
    sql["temporal_profile"] = with_view("dirty_lineitem", (
        f"SELECT {times} FROM ({profile_select('events', 'events', events, ('temporal',))}) UNION ALL "
        f"SELECT {times} FROM ({profile_select('dirty_lineitem', 'dirty_lineitem', LINEITEM, ('temporal',))})"))
    sql["column_profile"] = with_view("dirty_orders", profile_select("dirty_orders", "dirty_orders", ORDERS, every))

    quick = []
    for i, (c, _, _) in enumerate(ORDERS):
        x = f"CAST({c} AS DOUBLE)" if c in ("order_id", "cust_id", "o_totalprice") else "CAST(NULL AS DOUBLE)"
        quick.append(
            f"SELECT 'dirty_orders' AS dataset_id, '{c}' AS column_name, {i} AS ordinal, count(*) AS total_rows, 6 AS total_columns, "
            f"count(*) - {distinct_rows('dirty_orders')} AS duplicate_count, round((count(*) - {distinct_rows('dirty_orders')}) / count(*), 4) AS duplicate_rate, "
            f"count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 4) AS null_rate, round(avg({x}), 4) AS mean, "
            f"round(quantile_cont({x}, 0.5), 4) AS median, round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(stddev_samp({x}), 4) AS std FROM dirty_orders"
        )
    sql["quick_profile"] = with_view("dirty_orders", " UNION ALL ".join(quick))

    fences = []
    for i, (c, kind, _) in enumerate(LINEITEM):
        if kind == "numeric":
            fences.append(
                f"SELECT 'dirty_lineitem' AS dataset_id, '{c}' AS column_name, {i} AS ordinal, any_value(n) AS count, round(any_value(lo), 4) AS lower_fence, "
                f"round(any_value(hi), 4) AS upper_fence, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS iqr_outliers, "
                f"count(*) FILTER (WHERE abs({c} - m) > 3 * s) AS z_outliers FROM dirty_lineitem, "
                f"(SELECT n, m, s, p25 - 1.5 * (p75 - p25) AS lo, p75 + 1.5 * (p75 - p25) AS hi FROM (SELECT count({c}) AS n, avg({c}) AS m, stddev_samp({c}) AS s, "
                f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75 FROM dirty_lineitem))"
            )
    sql["outlier_check"] = with_view("dirty_lineitem", " UNION ALL ".join(fences))

    tests = []
    for c, i in (("number_text", 1), ("mixed_text", 2), ("date_text", 3), ("time_text", 4), ("label_text", 5)):
        tests.append(
            f"SELECT '{c}' AS column_name, {i} AS ordinal, count({c}) AS count, count(*) FILTER (WHERE regexp_matches({c}, '^[+-]?[0-9]+$') AND TRY_CAST({c} AS BIGINT) IS NOT NULL) AS integer_count, "
            f"count(*) FILTER (WHERE regexp_matches({c}, '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) AS number_count, "
            f"count(*) FILTER (WHERE regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST({c} AS DATE) IS NOT NULL) AS date_count, "
            f"count(*) FILTER (WHERE regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]{{1,6}})?$') "
            f"AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL) AS timestamp_count FROM mixed_text"
        )
    sql["type_check"] = with_view("mixed_text", (
        "SELECT 'mixed_text' AS dataset_id, *, CASE WHEN count = 0 THEN 'empty' WHEN integer_count = count THEN 'bigint' WHEN number_count = count THEN 'double' "
        "WHEN date_count = count THEN 'date' WHEN timestamp_count = count THEN 'timestamp' ELSE 'string' END AS fits_type, "
        "greatest(number_count, date_count, timestamp_count) > 0 AND greatest(number_count, date_count, timestamp_count) < count AS mixed "
        f"FROM ({' UNION ALL '.join(tests)})"))

    only = ["stage_sales.public.orders"]
    columns = "dataset_id, connector, check_name, status, passed, total_rows, total_columns, metric_value"
    sql["assessment"] = f"{check_rows(only)} SELECT {columns} FROM checks"
    sql["assess_all"] = f"{check_rows()} SELECT {columns} FROM checks"
    price = ("(SELECT count(o_totalprice) AS n, count(*) FILTER (WHERE o_totalprice < lo OR o_totalprice > hi) AS bad FROM dirty_orders, "
             "(SELECT p25 - 1.5 * (p75 - p25) AS lo, p75 + 1.5 * (p75 - p25) AS hi FROM (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.75) AS p75 FROM dirty_orders)))")
    texts = " || ',' || ".join(f"'{c}:string:' || (SELECT count({c}) FROM dirty_orders) || ':0'" for c in ("o_orderstatus", "o_orderpriority"))
    base = "SELECT 'stage_sales.public.orders' AS dataset_id, 'postgres' AS connector"
    size = "(SELECT count(*) FROM dirty_orders) AS total_rows, 6 AS total_columns"
    sql["assessment_registered"] = (
        f"{check_rows(only)} SELECT {columns}, '' AS found FROM checks "
        f"UNION ALL {base}, 'outliers', CASE WHEN bad > 0 THEN 'failure' ELSE 'success' END, bad = 0, {size}, CAST(bad > 0 AS BIGINT), 'o_totalprice:numeric:' || n || ':' || bad FROM {price} "
        f"UNION ALL {base}, 'types', 'success', TRUE, {size}, 0, {texts}")
    sql["null_analysis"] = f"{check_rows()} SELECT dataset_id, column_name, ordinal, null_count, null_percentage FROM nulls"
    sql["assessment_summary"] = (
        f"{check_rows()} SELECT *, round(passed_checks / total_checks, 4) AS pass_rate, "
        "format('{:.1f}', passed_checks / greatest(1, passed_checks + failed_checks) * 100) || '%' AS pass_rate_text FROM ("
        "SELECT dataset_id, connector, count(*) AS total_checks, count(*) FILTER (WHERE passed) AS passed_checks, "
        "count(*) FILTER (WHERE NOT passed AND status IN ('success', 'failure')) AS failed_checks, "
        "count(*) FILTER (WHERE status NOT IN ('success', 'failure')) AS error_checks FROM checks GROUP BY ALL)"
    )
    sql["recommendations"] = recommendations()
    sql["assessment_from_json"] = recommendations(only)

    for name, view, rules in (("customers", "raw_customers", CUSTOMER_RULES), ("products", "raw_products", PRODUCT_RULES), ("invoices", "raw_invoices", INVOICE_RULES)):
        sql[f"cleanse_{name}"], _ = cleansing(view, name, rules)
    steps = " UNION ALL ".join(
        cleansing(v, n, r)[1] for n, v, r in (("customers", "raw_customers", CUSTOMER_RULES), ("products", "raw_products", PRODUCT_RULES), ("invoices", "raw_invoices", INVOICE_RULES)))
    raw = views("raw_customers", "raw_products", "raw_invoices")
    sql["cleanse_attrition"] = f"WITH {raw} {steps}"
    sql["attrition_summary"] = (
        f"WITH {raw}, steps AS ({steps}) SELECT dataset_id, max(rows_before) AS raw_rows, CAST(max(rows_before) - sum(removed) AS BIGINT) AS kept_rows, "
        f"CAST(sum(removed) AS BIGINT) AS removed_rows, {percent('CAST(sum(removed) AS BIGINT)', 'max(rows_before)')} AS removed_percentage FROM steps GROUP BY dataset_id"
    )

    sql["inject_nulls"] = (
        "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN NOT a THEN o_totalprice END AS o_totalprice, o_orderdate, CASE WHEN NOT b THEN o_orderpriority END AS o_orderpriority "
        f"FROM (SELECT *, {chosen('a', 0.15, 'null:o_totalprice')}, {chosen('b', 0.08, 'null:o_orderpriority')} FROM orders)"
    )
    part = f"{hex52(chr(109) + 'd5(CAST(o_orderkey AS VARCHAR) || ' + q(':value:o_custkey:42') + ')')} / CAST(4503599627370496 AS DOUBLE)"
    sql["inject_outliers"] = (
        f"SELECT o_orderkey, CASE WHEN b THEN CAST(floor({part} * 1000) - 1000 AS BIGINT) ELSE o_custkey END AS o_custkey, o_orderstatus, "
        "CASE WHEN a THEN CAST(999999999.99 AS DOUBLE) ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority "
        f"FROM (SELECT *, {chosen('a', 0.05, 'outlier:o_totalprice')}, {chosen('b', 0.02, 'outlier:o_custkey')} FROM orders)"
    )
    numbered = "SELECT *, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '{}')) AS i, count(*) OVER () AS n FROM orders"
    draw = hex52("md5(CAST(i AS VARCHAR) || ':draw:42')")
    sql["inject_duplicates"] = (
        f"WITH numbered AS ({numbered.format(':order:42')}), draws AS (SELECT {draw} % n + 1 AS aim FROM numbered WHERE i <= floor(n * CAST(0.08 AS DOUBLE))) "
        "SELECT * FROM orders UNION ALL SELECT o.* EXCLUDE (i, n) FROM numbered o JOIN draws d ON d.aim = o.i"
    )
    shift = hex52("md5(CAST(o_orderkey AS VARCHAR) || ':shift:42')")
    days = hex52("md5(CAST(o_orderkey AS VARCHAR) || ':days:42')")
    sql["near_duplicates"] = (
        f"WITH numbered AS ({numbered.format(':near:42')}) SELECT * FROM orders UNION ALL "
        f"SELECT (SELECT max(o_orderkey) FROM orders) + i, o_custkey, o_orderstatus, o_totalprice, CASE WHEN {shift} / CAST(4503599627370496 AS DOUBLE) < CAST(0.3 AS DOUBLE) "
        f"THEN o_orderdate + to_days(CAST({days} % 3 + 1 AS INTEGER)) ELSE o_orderdate END, o_orderpriority FROM numbered WHERE i <= floor(n * CAST(0.08 AS DOUBLE))"
    )

    db = "split_part(dataset_id, '.', 1)"
    sql["detect_connector"] = with_view("dataset_ids", (
        f"SELECT c_custkey, dataset_id, CASE WHEN contains(dataset_id, '.') AND {db} = upper({db}) AND {db} <> lower({db}) THEN 'snowflake' "
        f"WHEN contains(dataset_id, '.') AND {db} = lower({db}) AND {db} <> upper({db}) THEN 'postgres' "
        f"WHEN contains(dataset_id, '.') AND regexp_matches(lower({db}), 'prod|sales') THEN 'snowflake' "
        f"WHEN contains(dataset_id, '.') AND regexp_matches(lower({db}), 'stage|dev') THEN 'postgres' ELSE 'snowflake' END AS connector FROM dataset_ids"))
    sql["dataset_suffix"] = with_view("dataset_ids", f"SELECT c_custkey, dataset_id, {SUFFIX} AS suffix FROM dataset_ids")
    named = f"SELECT request_id, output, {NAMED} AS dataset_id FROM replies"
    sql["extract_dataset"] = with_view("replies", f"SELECT request_id, dataset_id, {CONNECTOR} AS connector FROM ({named})")
    sql["valid_responses"] = with_view("replies", f"SELECT * FROM replies WHERE {VALID}")
    low = "lower(output)"
    words = {"duplicates": "duplicate", "null_values": "null|missing data|missing value", "descriptive_stats": "descriptive stat|statistics|data summary"}
    picked = ", ".join(f"CASE WHEN regexp_matches({low}, '{p}') THEN '{c}' END" for c, p in words.items())
    sql["route_intent"] = with_view("replies", (
        "SELECT request_id, CASE WHEN action = 'check' AND named = '' THEN 'assessment' ELSE action END AS action, "
        "CASE WHEN action = 'check' AND named <> '' THEN named ELSE 'duplicates,null_values,descriptive_stats' END AS checks FROM ("
        f"SELECT request_id, concat_ws(',', {picked}) AS named, CASE WHEN regexp_matches({low}, 'save report|export report|create files') THEN 'save_report' "
        f"WHEN regexp_matches({low}, 'comprehensive report|full report|assessment report|generate report') THEN 'report' "
        f"WHEN regexp_matches({low}, 'comprehensive assessment|full assessment|all checks') THEN 'assessment' ELSE 'check' END AS action FROM replies)"))
    sql["resolve_requests"] = with_view("replies", (
        f"SELECT request_id, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, CASE WHEN NOT valid THEN 'low_relevance' WHEN dataset_id IS NULL THEN 'metadata_extraction_failed' END AS reason, "
        f"CASE WHEN ok THEN dataset_id END AS dataset_id, CASE WHEN ok THEN {CONNECTOR} END AS connector, CASE WHEN ok THEN 'comprehensive_dq_report_' || {SUFFIX} END AS file_stem "
        f"FROM (SELECT *, valid AND dataset_id IS NOT NULL AS ok FROM (SELECT *, {VALID} AS valid FROM ({named})))"))

    sql["process_requests"] = (
        f"WITH resolved AS ({sql['resolve_requests']}), "
        "known AS (SELECT * FROM (VALUES ('stage_sales.public.orders'), ('PROD_SALES.PUBLIC.CUSTOMER'), ('DATA_HUB.CORE.LINEITEM'), ('data_hub.core.documents')) AS k(report_id)), "
        "folds AS (SELECT lower(report_id) AS fold, min(report_id) AS report_id FROM known GROUP BY 1 HAVING count(*) = 1), "
        "matched AS (SELECT r.*, coalesce(k.report_id, f.report_id) AS report_id FROM resolved r LEFT JOIN known k ON r.dataset_id = k.report_id LEFT JOIN folds f ON lower(r.dataset_id) = f.fold) "
        "SELECT request_id, CASE WHEN report_id IS NULL THEN 'failed' ELSE status END AS status, CASE WHEN status = 'success' AND report_id IS NULL THEN 'table_not_found' ELSE reason END AS reason, "
        "dataset_id, connector, file_stem, report_id, format, file_stem || '.' || format AS file_name "
        "FROM matched LEFT JOIN (VALUES ('html'), ('json'), ('markdown')) AS f(format) ON report_id IS NOT NULL")
    sql["list_schemas"] = with_view("schemata", (
        "SELECT schema_name FROM schemata WHERE schema_name NOT IN ('information_schema', 'pg_catalog', 'pg_toast', 'pg_temp_1', 'pg_toast_temp_1', 'scratch') "
        "AND schema_name NOT LIKE 'pg_temp_%' AND schema_name NOT LIKE 'pg_toast_temp_%'"))
    spark_type = (
        "CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type = 'VARCHAR' THEN 'string' "
        "WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' WHEN data_type = 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END")
    sql["list_columns"] = (
        f"WITH sizes AS ({' UNION ALL '.join(f"SELECT '{t}' AS table_name, '{SCHEMA_OF.get(t, 'sales')}' AS schema_name, count(*) AS row_count FROM {t}" for t in TABLES)}) "
        f"SELECT 'snowflake' AS connector, 'PROD_SALES' AS database_name, table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name, {spark_type} AS data_type, 'YES' AS is_nullable, "
        "CAST(NULL AS VARCHAR) AS column_default, CAST(NULL AS VARCHAR) AS column_comment, schema_name, row_count FROM information_schema.columns JOIN sizes USING (table_name)")
    listed = " UNION ALL ".join(
        f"SELECT 'PROD_SALES' AS database_name, '{SCHEMA_OF.get(t, 'sales')}' AS schema_name, '{t}' AS table_name, 'BASE TABLE' AS table_type, count(*) AS row_count FROM {t}" for t in TABLES)
    sql["list_tables"] = listed
    sql["schema_fingerprint"] = (
        f"SELECT schema_name, string_agg(table_name, ',' ORDER BY table_name) AS tables, count(*) AS table_count, CAST(sum(row_count) AS BIGINT) AS row_count FROM ({listed}) GROUP BY schema_name")
    sql["fingerprint_totals"] = (
        "SELECT string_agg(schema_name, ',' ORDER BY schema_name) AS schemas, string_agg(schema_name || '=' || tables, ';' ORDER BY schema_name) AS tables_per_schema, "
        f"count(*) AS total_schemas, CAST(sum(table_count) AS BIGINT) AS total_tables FROM ({sql['schema_fingerprint']})")
    sql["build_index"] = (
        f"WITH sizes AS ({listed}), listed AS (SELECT table_name, string_agg('  - ' || column_name || ' (' || {spark_type} || ')', chr(10) ORDER BY ordinal_position) AS lines "
        "FROM information_schema.columns GROUP BY table_name) "
        "SELECT schema_name AS schema, table_name, 'indexed' AS status, 'PROD_SALES.' || schema_name || '.' || table_name AS full_name, "
        "'DATA SOURCE: SNOWFLAKE' || chr(10) || 'TABLE: PROD_SALES.' || schema_name || '.' || table_name || chr(10) || 'Type: BASE TABLE' || chr(10) "
        "|| CASE WHEN row_count > 0 THEN 'Row Count: ' || format('{:,}', row_count) || chr(10) ELSE '' END || chr(10) || 'COLUMNS:' || chr(10) || lines || chr(10) "
        "|| chr(10) || 'Created: None' || chr(10) || 'Last Modified: None' AS document, 256 AS width FROM sizes JOIN listed USING (table_name) "
        "UNION ALL SELECT 'sales', 'broken', 'failed', NULL, NULL, NULL")
    sql["schema_history"] = with_view("index_names", (
        "SELECT taken, schema_name, table_name, change FROM (WITH days AS (SELECT unnest(range(1, 7)) AS day), "
        "held AS (SELECT DISTINCT day, db AS schema_name, table_name FROM index_names JOIN part USING (p_partkey), days WHERE p_size BETWEEN day * 5 AND day * 5 + 20 OR p_size % 7 = day % 3), "
        "pairs AS (SELECT a.day + 1 AS day, a.schema_name, a.table_name, 'removed' AS change FROM held a LEFT JOIN held b ON b.day = a.day + 1 AND b.schema_name = a.schema_name AND b.table_name = a.table_name "
        "WHERE a.day < 6 AND b.day IS NULL UNION ALL SELECT a.day, a.schema_name, a.table_name, 'added' FROM held a LEFT JOIN held b ON b.day = a.day - 1 AND b.schema_name = a.schema_name AND b.table_name = a.table_name "
        "WHERE a.day > 1 AND b.day IS NULL) SELECT make_timestamp(2025, 1, CAST(day AS BIGINT), 0, 0, 0.0) AS taken, * FROM pairs)"))
    snapshot = "SELECT DISTINCT db AS schema_name, table_name FROM index_names JOIN part USING (p_partkey) WHERE "
    sql["schema_diff"] = with_view("index_names", (
        f"SELECT coalesce(a.schema_name, b.schema_name) AS schema_name, coalesce(a.table_name, b.table_name) AS table_name, "
        f"CASE WHEN a.table_name IS NULL THEN 'added' ELSE 'removed' END AS change FROM ({snapshot} p_size <= 40) a "
        f"FULL OUTER JOIN ({snapshot} p_size >= 10) b ON a.schema_name = b.schema_name AND a.table_name = b.table_name WHERE a.table_name IS NULL OR b.table_name IS NULL"))
    sql["keyword_map"] = with_view("index_names", (
        f"SELECT keyword, connector FROM ({keyword_sql(chr(40) + 'SELECT db || ' + q('.public.') + ' || table_name AS full_name, connector FROM index_names)')})"))

    sql["vector_topk"] = (
        f"SELECT request_id, item_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, item_id) AS rank "
        f"FROM (SELECT f.vec_id AS request_id, e.vec_id AS item_id, {DISTANCE.format(a='f.embedding', b='e.embedding')} AS distance FROM embeddings f, embeddings e)) WHERE rank <= 10")
    many = (f"SELECT vec_id AS request_id, {options('label', ASKED)} || ' ' || coalesce(d.text, '') AS text, embedding "
            "FROM embeddings LEFT JOIN documents d ON doc_id = vec_id")
    sql["search_tables"] = (
        f"{scored_sql(many, index_sql('embeddings'), 10)} SELECT request_id, full_name, table_name, connector, round(base_score, 6) AS base_score, boosted, round(table_boost, 6) AS table_boost, "
        "preferred AS detected_source, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, distance, full_name) AS rank "
        "FROM scored WHERE score >= CAST(0.05 AS DOUBLE)) WHERE rank <= 3")
    sql["search_gate"] = gate_sql(many, index_sql("embeddings"), GATE_TAIL)
    sql["search_context"] = gate_sql(many, index_sql("embeddings"), CONTEXT_TAIL)

    name = options("label", ASSESSED)
    stand = (f"SELECT {name} AS full_name, string_split({name}, '.')[3] AS table_name, CASE WHEN label IN (1, 2) THEN 'snowflake' ELSE 'postgres' END AS connector, embedding "
             f"FROM firsts WHERE label < {len(ASSESSED)}")
    intent = sql["route_intent"].removeprefix(f"WITH replies AS ({VIEWS['replies']}) ")
    sql["answer_requests"] = (
        f"{scored_sql(many, stand, 20)}, best AS (SELECT request_id, full_name FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, distance, full_name) AS r FROM scored) WHERE r = 1), "
        f"replies AS (SELECT request_id, text AS output FROM requests), intents AS ({intent}), found AS ({sql['assess_all']}) "
        "SELECT request_id, action, full_name AS dataset_id, check_name, status, passed, total_rows, total_columns, metric_value, CAST(NULL AS VARCHAR) AS reason "
        "FROM best JOIN intents USING (request_id) JOIN found ON dataset_id = full_name AND list_contains(string_split(intents.checks, ','), check_name)")

    def shown(x):
        return f"coalesce(CASE WHEN type_class = 'temporal' THEN substr(CAST({micros(x)} AS VARCHAR), 1, 15) ELSE format('{{:,.2f}}', {x}) END, '-') AS {x}"

    whole = lambda x, name: f"coalesce(format('{{:,}}', {x}), '-') AS \"{name}\""
    sql["format_stats"] = (
        f"{check_rows(only)} SELECT dataset_id, column_name, {whole('count', 'count')}, " + ", ".join(shown(x) for x in ("mean", "std", "min", "p25", "p50", "p75", "max"))
        + f", {whole('uniq', 'unique')}, coalesce(substr(top, 1, 15), '-') AS top, {whole('freq', 'freq')} FROM stats")
    sql["parse_reports"] = f"{check_rows()} SELECT dataset_id, check_name, status, metric_value FROM checks"
    sql["parse_null_analysis"] = (
        f"{check_rows()} SELECT dataset_id, column_name, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY null_percentage DESC, ordinal) - 1 AS INTEGER) AS ordinal, null_count, "
        "CAST(format('{:.1f}', null_percentage) AS DOUBLE) AS null_percentage FROM nulls")
    return sql
