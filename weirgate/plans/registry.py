"""All queries of the library by name, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import baseline as B
from ..operators import contracts as C
from ..operators import identity as I
from ..operators import schema as S
from ..sources import baselines
from ..sources.shared import fresh
from ..streaming import streams as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SPLIT = "2024-01-22"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("ts") < F.expr(f"timestamp_ntz'{SPLIT}'"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("ts") >= F.expr(f"timestamp_ntz'{SPLIT}'"))


# Schema


@query("SELECT c_custkey, try_cast(c_name AS INTEGER) AS c_name, CAST(NULL AS VARCHAR) AS c_phone, CASE WHEN c_name IS NOT NULL AND try_cast(c_name AS INTEGER) IS NULL THEN 1 ELSE 0 END AS n_errors FROM customer")
def s1_conform(spark, sf):
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.IntegerType()), T.StructField("c_phone", T.StringType())])
    out = S.conform(table(spark, sf, "customer"), schema)
    return out.select("c_custkey", "c_name", "c_phone", F.size("_cast_errors").alias("n_errors"))


@query("SELECT event_id, NULL::INTEGER AS kind, value AS v, NULL::INTEGER AS first, user_id::INTEGER AS second, CASE WHEN event_type = 'view' THEN 's.event_type,s.k,tags[]' ELSE 's.event_type,tags[]' END AS errors FROM events")
def s1_conform_nested(spark, sf):
    """Fields of a struct and elements of an array in other types; a required field that has no value for views."""
    number = F.when(F.col("event_type") != "view", F.col("event_id").cast("string"))
    nested = F.struct("event_type", F.col("value").cast("string").alias("v"), number.alias("k"))
    rows = table(spark, sf, "events").select("event_id", nested.alias("s"), F.array("event_type", F.col("user_id").cast("string")).alias("tags"))
    s = T.StructType([T.StructField("event_type", T.IntegerType()), T.StructField("v", T.DoubleType()), T.StructField("k", T.LongType(), False)])
    out = S.conform(rows, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("s", s), T.StructField("tags", T.ArrayType(T.IntegerType()))]))
    return out.select("event_id", F.col("s.event_type").alias("kind"), "s.v", F.col("tags")[0].alias("first"), F.col("tags")[1].alias("second"), F.array_join(F.array_sort("_cast_errors"), ",").alias("errors"))


def _shape_sql(rows: str) -> str:
    return f"""SELECT k AS path, CASE json_type(props, '$."' || k || '"') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'null' END AS json_type, count(*) AS n
FROM (SELECT props, unnest(json_keys(props)) AS k FROM ({rows})) GROUP BY 1, 2"""


@query(_shape_sql("SELECT props FROM events"))
def s2_json_shape(spark, sf):
    return S.json_shape(table(spark, sf, "events"), "props")


@query(f"""WITH b AS ({_shape_sql("SELECT props FROM events WHERE ts < TIMESTAMP '2024-01-22'")}),
a AS ({_shape_sql("SELECT json_object('k', 'v' || event_id, 'extra', event_id) AS props FROM events WHERE ts >= TIMESTAMP '2024-01-22'")}),
bs AS (SELECT path, string_agg(DISTINCT json_type, ',' ORDER BY json_type) AS types, sum(n) / (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-22') AS share FROM b GROUP BY 1),
as_ AS (SELECT path, string_agg(DISTINCT json_type, ',' ORDER BY json_type) AS types, sum(n) / (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-22') AS share FROM a GROUP BY 1)
SELECT * FROM (SELECT path, CASE WHEN bs.types IS NULL THEN 'added' WHEN as_.types IS NULL THEN 'removed' WHEN bs.types <> as_.types THEN 'retyped' WHEN abs(as_.share - bs.share) > 0.5 * bs.share THEN 'frequency' END AS change
FROM bs FULL JOIN as_ USING (path)) WHERE change IS NOT NULL""")
def s3_shape_drift(spark, sf):
    after = _scored(spark, sf).withColumn("props", F.expr("to_json(named_struct('k', concat('v', event_id), 'extra', event_id))"))
    return S.shape_drift(S.json_profile(_train(spark, sf), "props"), S.json_profile(after, "props"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def s4_column_profile(spark, sf):
    return S.column_profile(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


# Contracts


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def c1_not_null(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return C.not_null(labelled, ["quality"]).select("doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def c2_unique(spark, sf):
    return C.unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)")
def c3_references(spark, sf):
    parents = table(spark, sf, "customer").where("c_custkey % 50 <> 0")
    return C.references(table(spark, sf, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def c4_in_domain(spark, sf):
    return C.in_domain(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def c5_in_range(spark, sf):
    return C.in_range(table(spark, sf, "customer"), "c_acctbal", lo=0).select("c_custkey", "c_acctbal")


@query("SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate")
def c6_row_holds(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return C.row_holds(joined, F.col("l_shipdate") > F.col("o_orderdate")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^https://')")
def c7_matches(spark, sf):
    return C.matches(table(spark, sf, "pages"), "url", "^https://").select("page_id", "url")


@query("SELECT o_orderkey AS key, o_totalprice::DECIMAL(18,2)::DOUBLE AS declared, s AS summed FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE abs(declared - s) > 0.01")
def c8_reconciles(spark, sf):
    return C.reconciles(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "o_totalprice", F.col("l_extendedprice"))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, min(l_linenumber)::BIGINT AS lo, max(l_linenumber)::BIGINT AS hi FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber)")
def c9_sequence_complete(spark, sf):
    return C.sequence_complete(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, was AS before FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS was FROM lineitem) WHERE l_linenumber - was <> 1")
def c9_sequence_steps(spark, sf):
    return C.sequence_steps(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


_DENSE = """WITH g AS (SELECT event_type, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS period FROM (SELECT DISTINCT event_type FROM events)),
r AS (SELECT event_type, date_trunc('day', ts) AS period, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2)
"""


def _dense(spark, sf, entity):
    e = table(spark, sf, "events")
    return B.zero_fill(B.rollup(e, entity, "ts", "1 day", "value"), e, entity, "2024-01-01", "2024-01-30")


@query(_DENSE + "SELECT event_type, period::TIMESTAMP AS period, coalesce(n, 0) AS n FROM g LEFT JOIN r USING (event_type, period) WHERE coalesce(n, 0) NOT BETWEEN 50 AND 80")
def c10_volume(spark, sf):
    return C.volume(_dense(spark, sf, "event_type"), 50, 80).select("event_type", "period", "n")


def _line_rules():
    return [
        C.not_null_rule("line has a part", "l_partkey"),
        C.in_range_rule("discount", "l_discount", hi=0.09),
        C.in_domain_rule("return flag", "l_returnflag", ["A", "N"]),
        C.row_holds_rule("tax below discount", F.col("l_tax") <= F.col("l_discount"), F.col("l_linenumber").cast("string")),
    ]


_BROKEN = """SELECT 'discount' AS rule_id, l_orderkey::VARCHAR AS key FROM lineitem WHERE l_discount > 0.09
UNION ALL SELECT 'return flag', l_orderkey::VARCHAR FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT 'tax below discount', l_orderkey::VARCHAR FROM lineitem WHERE l_tax > l_discount
UNION ALL SELECT 'line has a part', l_orderkey::VARCHAR FROM lineitem WHERE l_partkey IS NULL"""


_FOUND = """SELECT 'line key' AS rule_id, l_orderkey || '|' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'order has a customer', o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)
UNION ALL SELECT 'order total', o_orderkey::VARCHAR FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE abs(o_totalprice::DECIMAL(18,2)::DOUBLE - s) > 0.01
UNION ALL SELECT 'line numbers', l_orderkey::VARCHAR FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber)"""


@query(f"{_BROKEN} UNION ALL {_FOUND}")
def c11_violations(spark, sf):
    """Row rules in one scan, and what key, reference, total and sequence rules found."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    parts = [
        C.found_violations("line key", C.unique(lines, ["l_orderkey", "l_linenumber"]), F.concat_ws("|", "l_orderkey", "l_linenumber"), F.col("n")),
        C.found_violations("order has a customer", C.references(orders, "o_custkey", table(spark, sf, "customer").where("c_custkey % 50 <> 0"), "c_custkey"), F.col("o_orderkey"), F.col("o_custkey")),
        C.found_violations("order total", C.reconciles(orders, lines, "o_orderkey", "l_orderkey", "o_totalprice", F.col("l_extendedprice")), F.col("key"), F.col("summed")),
        C.found_violations("line numbers", C.sequence_complete(lines, "l_orderkey", "l_linenumber"), F.col("l_orderkey"), F.concat_ws("-", "lo", "hi")),
    ]
    out = C.violations(lines, _line_rules(), F.col("l_orderkey"))
    for x in parts:
        out = out.unionByName(x)
    return out.select("rule_id", "key")


@query(f"""SELECT r.rule_id, (SELECT count(*) FROM lineitem) AS n_checked, count(b.key) AS n_violations, count(b.key) = 0 AS passed FROM (VALUES ('line has a part'), ('discount'), ('return flag'), ('tax below discount')) r(rule_id) LEFT JOIN ({_BROKEN}) b USING (rule_id) GROUP BY 1
UNION ALL SELECT 'line key', n, b, b = 0 FROM (SELECT count(*) AS n, count(*) FILTER (k > 1) AS b FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber))
UNION ALL SELECT 'line has an order', n, b, b = 0 FROM (SELECT count(l_orderkey) AS n, count(l_orderkey) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS b FROM lineitem)""")
def c12_contract_summary(spark, sf):
    lines = table(spark, sf, "lineitem")
    keys = C.unique_summary("line key", lines, ["l_orderkey", "l_linenumber"])
    orders = C.references_summary("line has an order", lines, "l_orderkey", table(spark, sf, "orders"), "o_orderkey")
    return C.contract_summary(lines, _line_rules()).unionByName(keys).unionByName(orders)


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_partkey IS NULL THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END + CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 1 ELSE 0 END + CASE WHEN l_tax > l_discount THEN 1 ELSE 0 END)::INTEGER AS n_reasons FROM lineitem")
def c13_quarantine(spark, sf):
    valid, rejected = C.quarantine(table(spark, sf, "lineitem"), _line_rules())
    both = valid.withColumn("_reasons", F.array().cast("array<string>")).unionByName(rejected)
    return both.select("l_orderkey", "l_linenumber", F.size("_reasons").alias("n_reasons"))


@query("SELECT 'value' AS rule_id, event_id::VARCHAR AS key, value::VARCHAR AS observed FROM events WHERE value > 200")
def c14_stream_violations(spark, sf):
    stream = X.table_stream(spark, f"{sf}/events.parquet")
    return X.drain(spark, X.stream_violations(stream, [C.in_range_rule("value", "value", hi=200.0)], F.col("event_id")), fresh(spark, "c14"), fresh(spark, "c14-checkpoint"))


# Identity


@query("SELECT c_custkey, sha256(lower(trim(c_name)) || chr(31) || coalesce(lower(trim(c_nationkey::VARCHAR)), chr(0))) AS id FROM customer")
def i1_record_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", I.record_id("c_name", "c_nationkey").alias("id"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY text")
def i2_exact_groups(spark, sf):
    return I.exact_groups(table(spark, sf, "documents"), "doc_id", ["text"])


# Distinct 5-word shingles of texts, classes of equal sets and their representatives; all pairs that share a shingle are counted.
_CLASSES = """w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM w WHERE len(w) > 0),
c AS (SELECT id, list_sort(list_distinct(g)) AS s FROM q),
r AS (SELECT s, min(id) AS id, len(s) AS size FROM c GROUP BY s),
m AS (SELECT r.id AS x, c.id AS y FROM c JOIN r USING (s) WHERE r.id < c.id),
g AS (SELECT id, size, unnest(s) AS g FROM r)"""
_ALL_PAIRS = _CLASSES + """,
p AS (SELECT a.id AS x, b.id AS y, count(*) / (any_value(a.size) + any_value(b.size) - count(*)) AS jaccard FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT x, y, jaccard FROM p WHERE jaccard >= 0.75 UNION ALL SELECT x, y, 1.0::DOUBLE FROM m)"""


def _clusters_sql(name: str, pairs: str) -> str:
    return f"""{name}_e AS (SELECT x AS a, y AS b FROM ({pairs}) UNION SELECT y, x FROM ({pairs})),
{name}_r(id, near) AS (SELECT a, a FROM {name}_e UNION SELECT r.id, e.b FROM {name}_r r JOIN {name}_e e ON e.a = r.near),
{name} AS (SELECT id, min(near) AS cluster_id FROM {name}_r GROUP BY id)"""


@query(f"""WITH {_CLASSES}, n AS (SELECT g, count(*) AS n FROM g GROUP BY g),
o AS (SELECT id, size, g, n, row_number() OVER (PARTITION BY id ORDER BY n, g) - 1 AS place FROM g JOIN n USING (g)),
f AS (SELECT g, id, size, size - place AS left_ FROM o WHERE place < size - ceil(0.75::DOUBLE * size - 1e-6) + 1 AND n > 1)
SELECT DISTINCT a.id AS x, b.id AS y FROM f a JOIN f b ON a.g = b.g AND a.id < b.id WHERE least(a.left_, b.left_) >= 0.75::DOUBLE / 1.75 * (a.size + b.size) - 1e-6 UNION ALL SELECT x, y FROM m""")
def i3_match_candidates(spark, sf):
    fresh(spark, "i3")
    return I.match_candidates(table(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH {_ALL_PAIRS} SELECT x, y, jaccard FROM pairs")
def i4_match_pairs(spark, sf):
    fresh(spark, "i4")
    return I.match_pairs(table(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH RECURSIVE {_ALL_PAIRS}, {_clusters_sql('k', 'SELECT x, y FROM pairs')} SELECT id, cluster_id FROM k")
def i5_clusters(spark, sf):
    fresh(spark, "i5")
    return I.clusters(I.match_pairs(table(spark, sf, "documents"), "doc_id", "text"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def i6_golden_record(spark, sf):
    return I.golden_record(table(spark, sf, "customer"), "c_nationkey", [F.col("c_acctbal")], "c_custkey").select("c_nationkey", "c_custkey", "c_acctbal")


@query(f"""WITH RECURSIVE {_ALL_PAIRS}, {_clusters_sql("old", "SELECT x, y FROM pairs WHERE jaccard >= 0.9")}, {_clusters_sql("new", "SELECT x, y FROM pairs")},
j AS (SELECT new.cluster_id, min(old.cluster_id) AS o, count(DISTINCT old.cluster_id) AS n FROM new LEFT JOIN old USING (id) GROUP BY 1)
SELECT id, coalesce(o, cluster_id) AS stable_id, CASE WHEN o IS NULL THEN 'new' WHEN n > 1 THEN 'merge' ELSE 'same' END AS change FROM new JOIN j USING (cluster_id)""")
def i7_update_crosswalk(spark, sf):
    fresh(spark, "i7")
    pairs = I.match_pairs(table(spark, sf, "documents"), "doc_id", "text").checkpoint()
    before = I.clusters(pairs.where("jaccard >= 0.9")).select("id", F.col("cluster_id").alias("stable_id"))
    return I.update_crosswalk(before, I.clusters(pairs))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer)
SELECT c.c_custkey AS id, r.c_custkey AS stable_id, CASE WHEN c.c_nationkey < 12 THEN 'same' ELSE 'new' END AS change
FROM customer c JOIN r ON r.c_nationkey = c.c_nationkey AND r.place = CASE WHEN c.c_nationkey < 12 THEN 1 ELSE 2 END""")
def i7_crosswalk_register(spark, sf):
    """Clusters by nation in three turns; half of the nations are away in the second, and their ids don't come again."""
    path, customers = fresh(spark, "i7r"), table(spark, sf, "customer")
    smallest = customers.groupBy("c_nationkey").agg(F.min("c_custkey").alias("cluster_id"))
    every = customers.join(smallest, "c_nationkey").select(F.col("c_custkey").alias("id"), "cluster_id", "c_nationkey")
    for turn in (every, every.where("c_nationkey < 12"), every):
        out = I.advance_crosswalk(path, turn.select("id", "cluster_id"))
    return out


@query("""SELECT user_id, event_type AS value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type""")
def i8_attribute_history(spark, sf):
    return I.attribute_history(table(spark, sf, "events"), "user_id", "ts", "event_type", "event_id")


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '^(www|m)\\.', ''), '[?#].*$', ''), '/$', '') AS key FROM pages")
def i9_canonical_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", I.canonical_key(F.col("url"), I.URL_RULES).alias("key"))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def i10_stream_first_seen(spark, sf):
    once = X.table_stream(spark, f"{sf}/events.parquet")
    stream = X.stream_first_seen(once.unionByName(X.table_stream(spark, f"{sf}/events.parquet")), ["event_id"], "ts", "60 days")
    return X.drain(spark, stream, fresh(spark, "i10"), fresh(spark, "i10-checkpoint")).select("event_id", "user_id", "event_type")


# Silent baseline


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2")
def b1_rollup(spark, sf):
    return B.rollup(table(spark, sf, "events"), "event_type", "ts", "1 day", "value")


@query(_DENSE.replace("event_type", "user_id") + "SELECT user_id, period::TIMESTAMP AS period, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM g LEFT JOIN r USING (user_id, period)")
def b2_zero_fill(spark, sf):
    return _dense(spark, sf, "user_id")


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events WHERE ts < TIMESTAMP '2024-01-22' GROUP BY 1")
def b3_fit(spark, sf):
    return _rounded(B.fit(_train(spark, sf), ["event_type"], "value"), "mean", "sd")


@query("SELECT event_type, hour(ts)::INTEGER AS season, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events WHERE ts < TIMESTAMP '2024-01-22' GROUP BY 1, 2")
def b4_fit_seasonal(spark, sf):
    return _rounded(B.fit_seasonal(_train(spark, sf), "event_type", F.hour("ts"), "value"), "mean", "sd")


@query(_DENSE + "SELECT event_type, period::TIMESTAMP AS period, coalesce(n, 0) AS n, coalesce(total, 0) AS total, round(avg(coalesce(n, 0)) OVER w, 6) AS mean, round(stddev_samp(coalesce(n, 0)) OVER w, 6) AS sd FROM g LEFT JOIN r USING (event_type, period) WINDOW w AS (PARTITION BY event_type ORDER BY period ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")
def b5_fit_trailing(spark, sf):
    return _rounded(B.fit_trailing(_dense(spark, sf, "event_type"), "event_type", 7), "mean", "sd")


@query("SELECT event_type, round(m, 6) AS median, round(quantile_cont(abs(value - m), 0.5), 6) AS mad FROM events JOIN (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY 1, m")
def b6_fit_robust(spark, sf):
    return _rounded(B.fit_robust(table(spark, sf, "events"), "event_type", "value"), "median", "mad")


_Z = """WITH f AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd FROM events WHERE ts < TIMESTAMP '2024-01-22' GROUP BY 1),
s AS (SELECT event_id, e.event_type, CASE WHEN sd > 0 THEN (value - mean) / sd END AS z FROM events e LEFT JOIN f USING (event_type) WHERE ts >= TIMESTAMP '2024-01-22')
"""


def _scores(spark, sf):
    return B.score(_scored(spark, sf), B.fit(_train(spark, sf), ["event_type"], "value"), "event_type", "value", 3.0)


@query(_Z + "SELECT event_id, event_type, round(z, 6) AS z, coalesce(abs(z) > 3, false) AS flagged FROM s")
def b7_score(spark, sf):
    return _rounded(_scores(spark, sf).select("event_id", "event_type", "z", "flagged"), "z")


@query(_Z + "SELECT t::DOUBLE AS threshold, count(*) FILTER (abs(z) > t) AS n_flagged FROM s, (VALUES (2), (3), (4)) v(t) GROUP BY 1")
def b8_shadow_sweep(spark, sf):
    return B.shadow_sweep(_scores(spark, sf), [2, 3, 4])


@query("""WITH b AS (SELECT event_type, least(floor(value / 25), 19)::INT AS bin, (ts >= TIMESTAMP '2024-01-22') AS side FROM events),
g AS (SELECT event_type, unnest(range(20))::INT AS bin FROM (SELECT DISTINCT event_type FROM events)),
h AS (SELECT g.event_type, g.bin, count(*) FILTER (side = false) + 0.5::DOUBLE AS p, count(*) FILTER (side) + 0.5::DOUBLE AS q FROM g LEFT JOIN b USING (event_type, bin) GROUP BY 1, 2),
s AS (SELECT event_type, p / sum(p) OVER (PARTITION BY event_type) AS p, q / sum(q) OVER (PARTITION BY event_type) AS q FROM h)
SELECT event_type, round(sum((q - p) * ln(q / p)), 6) AS psi FROM s GROUP BY 1""")
def b9_drift(spark, sf):
    return _rounded(B.drift(_train(spark, sf), _scored(spark, sf), "event_type", "value", 25.0, 20), "psi")


@query("SELECT user_id, was AS last_seen, ts AS seen_again FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE ts > was + INTERVAL 24 HOUR")
def b10_silence(spark, sf):
    return B.silence(table(spark, sf, "events"), "user_id", "ts", "event_id", 86_400)


_SESSIONS = """WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events),
n AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM n GROUP BY user_id, k"""


@query(_SESSIONS)
def b11_sessions(spark, sf):
    return B.sessions(table(spark, sf, "events"), "user_id", "ts", "6 hours")


@query(ORACLES["b3_fit"])
def b12_freeze_and_load(spark, sf):
    path = fresh(spark, "b12")
    baselines.freeze(B.fit(_scored(spark, sf), ["event_type"], "value"), path, "later")
    baselines.freeze(B.fit(_train(spark, sf), ["event_type"], "value"), path, "train")
    return _rounded(baselines.load(spark, path, "train"), "mean", "sd")


@query("SELECT * FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2) WHERE period + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def b13_stream_rollup(spark, sf):
    stream = X.stream_rollup(X.table_stream(spark, f"{sf}/events.parquet"), "event_type", "ts", "1 day", "value", "1 day")
    return X.drain(spark, stream, fresh(spark, "b13"), fresh(spark, "b13-checkpoint"))


@query("""WITH f AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT event_id, event_type, round((value - mean) / sd, 6) AS z, abs((value - mean) / sd) > 3 AS flagged FROM events JOIN f USING (event_type)""")
def b14_stream_score(spark, sf):
    frozen = fresh(spark, "b14-baseline")
    B.fit(table(spark, sf, "events"), ["event_type"], "value").write.parquet(frozen)
    stream = X.stream_score(X.table_stream(spark, f"{sf}/events.parquet"), spark.read.parquet(frozen), "event_type", "value", 3.0)
    return _rounded(X.drain(spark, stream, fresh(spark, "b14"), fresh(spark, "b14-checkpoint")).select("event_id", "event_type", "z", "flagged"), "z")


@query(f"SELECT user_id, session_start, n FROM ({_SESSIONS.replace('count(*) AS n FROM n', 'max(ts) AS last, count(*) AS n FROM n')}) WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def b13_stream_sessions(spark, sf):
    stream = X.stream_sessions(X.table_stream(spark, f"{sf}/events.parquet"), "user_id", "ts", "6 hours", "1 day")
    return X.drain(spark, stream, fresh(spark, "b13s"), fresh(spark, "b13s-checkpoint"))


@query("""SELECT user_id, was AS last_seen FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE ts > was + INTERVAL 24 HOUR
UNION ALL SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING epoch_ms(max(ts)) + 86400000 + 1 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""")
def b15_stream_silence(spark, sf):
    """Reports that no other follows within a day, as far as the watermark came."""
    stream = X.stream_silence(X.table_stream(spark, f"{sf}/events.parquet"), "user_id", "ts", 86_400, "1 hour")
    return X.drain(spark, stream, fresh(spark, "b15"), fresh(spark, "b15-checkpoint")).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("""SELECT user_id, event_type, was AS last_seen FROM (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was FROM events) WHERE ts > was + INTERVAL 120 HOUR
UNION ALL SELECT user_id, event_type, max(ts) AS last_seen FROM events GROUP BY 1, 2 HAVING epoch_ms(max(ts)) + 432000000 + 1 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""")
def b15_stream_silence_pairs(spark, sf):
    """Users and kinds of their events that no other of the kind follows within five days."""
    stream = X.stream_silence(X.table_stream(spark, f"{sf}/events.parquet"), ["user_id", "event_type"], "ts", 432_000, "1 hour")
    return X.drain(spark, stream, fresh(spark, "b15p"), fresh(spark, "b15p-checkpoint")).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE ts < TIMESTAMP '2024-01-22' GROUP BY 1")
def b16_fit_quantiles(spark, sf):
    return _rounded(B.fit_quantiles(_train(spark, sf), "event_type", "value", {"p50": 0.5, "p95": 0.95}), "p50", "p95")
