"""The registered queries of the relational, document, vector, retrieval and memory operators, with SQL for each that has one.

Every query runs over its whole tables; limits are there only where a page or a top-k is what is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import scalar as S
from tidewell.operators import documents as D
from tidewell.operators import memory as M
from tidewell.operators import predicates as P
from tidewell.operators import retrieval as R
from tidewell.operators import vectors as X
from tidewell.operators import versions as V
from tidewell.operators.dataset import Dataset, merge_shards
from tidewell.operators.stats import column_stats, storage_stats
from tidewell.plans import sqlfront
from tidewell.session import table
from tidewell.sources import files, parse
from tidewell.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW_MS = 1_767_225_600_000  # 2026-01-01, the "now" of queries that need one


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- scans ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 100")
def s01_scan_limit_offset(spark, sf):
    return Dataset(table(spark, sf, "orders")).scan(["o_orderkey", "o_custkey", "o_totalprice"], limit=200, offset=100, order=["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 101")
def s05_keyset_page(spark, sf):
    return Dataset(table(spark, sf, "orders")).page("o_orderkey", 500, 100, ["o_orderkey", "o_orderstatus"])


@query("""SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation
UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def s12_health_counts(spark, sf):
    names = ("customer", "nation", "orders", "lineitem")
    out = [table(spark, sf, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query()
def s13_parse_html(spark, sf):
    return parse.parse_blocks(table(spark, sf, "pages"), "page_id", "html", "html")


@query()
def s13_parse_markdown(spark, sf):
    return parse.parse_blocks(table(spark, sf, "documents"), "doc_id", "text", "markdown", with_text=False)


@query("""WITH h AS (SELECT 'doc/' || doc_id AS uri, sha256(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS h, doc_id FROM documents),
p AS (SELECT CASE WHEN doc_id % 7 = 3 THEN uri || '.old' ELSE uri END AS uri, CASE WHEN doc_id % 7 = 2 THEN sha256(h) ELSE h END AS h FROM h WHERE doc_id % 7 <> 5),
c AS (SELECT uri, h FROM h WHERE doc_id % 7 <> 6),
x AS (SELECT coalesce(c.uri, p.uri) AS uri, c.h AS new, p.h AS old, c.uri IS NOT NULL AS present FROM c FULL JOIN p ON c.uri = p.uri),
f AS (SELECT new, min({'n': old IS NULL, 'u': uri}).u AS first_uri FROM x WHERE present GROUP BY new),
g AS (SELECT old, min(uri) AS gone FROM x WHERE NOT present GROUP BY old),
k AS (SELECT x.uri, x.new AS content_hash, g.gone, CASE WHEN x.old = x.new THEN 'unchanged' WHEN f.first_uri <> x.uri THEN 'duplicate' WHEN x.old IS NOT NULL THEN 'changed' WHEN g.gone IS NOT NULL THEN 'renamed' ELSE 'created' END AS status
  FROM x LEFT JOIN f ON x.new = f.new LEFT JOIN g ON x.new = g.old WHERE x.present)
SELECT uri, status, content_hash, CASE WHEN status = 'renamed' THEN gone END AS previous_uri FROM k
UNION ALL SELECT uri, 'deleted', old, NULL FROM x WHERE NOT present AND uri NOT IN (SELECT gone FROM k WHERE status = 'renamed')""")
def s17_sync_manifest(spark, sf):
    h = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("uri"), S.content_hash(F.col("text")).alias("h"))
    slot = F.col("doc_id") % 7
    before = h.where(slot != 5).select(F.when(slot == 3, F.concat("uri", F.lit(".old"))).otherwise(F.col("uri")).alias("uri"), F.when(slot == 2, F.sha2("h", 256)).otherwise(F.col("h")).alias("content_hash"))
    return files.sync_manifest(before, h.where(slot != 6).select("uri", F.col("h").alias("content_hash")))


# -- predicates -----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02 AND l_linenumber <> 3")
def p02_numeric_compare(spark, sf):
    d = Dataset(table(spark, sf, "lineitem")).filter(("l_discount", "<=", 0.02), l_quantity_gt=45, l_linenumber_ne=3)
    return d.scan(["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name <> 'Customer#000000001'")
def p03_string_eq_ne(spark, sf):
    return Dataset(table(spark, sf, "customer")).filter(c_mktsegment="BUILDING", c_name_ne="Customer#000000001").scan(["c_custkey", "c_name"])


@query("SELECT count(*) FILTER (d IS NULL) AS nulls, count(*) FILTER (d IS NOT NULL) AS others FROM (SELECT nullif(l_discount, 0.0) AS d FROM lineitem)")
def p04_null_tests(spark, sf):
    d = table(spark, sf, "lineitem").select(F.nullif(F.col("l_discount"), F.lit(0.0)).alias("d"))
    return d.agg(F.count_if(P.compare(F.col("d"), "is_null", None)).alias("nulls"), F.count_if(P.compare(F.col("d"), "is_not_null", None)).alias("others"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 3 OR l_tax >= 0.08) AND NOT (l_returnflag = 'R') AND l_discount > 0.05")
def p05_p07_boolean_tree(spark, sf):
    df = table(spark, sf, "lineitem")
    test = P.all_of([P.any_of(P.keywords(df, l_quantity_lt=3, l_tax_ge=0.08)), ~P.keywords(df, l_returnflag="R")[0], F.col("l_discount") > 0.05])
    return df.where(test).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#1', 'Brand#2') AND p_name LIKE '%a_%'")
def p08_between_in_like(spark, sf):
    c = P.compare
    test = P.all_of([c(F.col("p_size"), "between", (5, 20)), c(F.col("p_brand"), "in", ["Brand#11", "Brand#12", "Brand#23", "Brand#1", "Brand#2"]), c(F.col("p_name"), "like", "%a_%")])
    return table(spark, sf, "part").where(test).select("p_partkey", "p_size")


def _orders_docs(spark, sf):
    """Orders as documents: an array of line numbers, one of quantities, an array of structs."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_linenumber")).alias("lines"),
        F.array_sort(F.collect_list(F.col("l_quantity").cast("int"))).alias("quantities"),
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag")))).alias("items"),
    )
    return lines.withColumnRenamed("l_orderkey", "_id")


_DOCS = "WITH d AS (SELECT l_orderkey AS _id, list_sort(list(DISTINCT l_linenumber)) AS lines, list_sort(list(l_quantity::INT)) AS quantities FROM lineitem GROUP BY 1)"


@query(_DOCS + " SELECT _id FROM d WHERE len(list_filter(quantities, lambda q: q >= 49)) > 0 AND len(list_filter(lines, lambda n: n IN (5, 6))) > 0 AND NOT len(list_filter(lines, lambda n: n IN (7))) > 0")
def p11_doc_compare_arrays(spark, sf):
    d = _orders_docs(spark, sf)
    return d.where(D.match(d.schema, {"quantities": {"$gte": 49}, "lines": {"$in": [5, 6], "$nin": [7]}})).select("_id")


@query(_DOCS + " SELECT _id, len(lines)::INT AS n FROM d WHERE list_has_all(lines, [1, 2, 3]) AND len(lines) = 4")
def p14_doc_all_size(spark, sf):
    d = _orders_docs(spark, sf)
    return d.where(D.match(d.schema, {"lines": {"$all": [1, 2, 3], "$size": 4}})).select("_id", F.size("lines").alias("n"))


@query("SELECT event_id FROM events WHERE regexp_matches(event_type, '^(CLICK|view)', 'i') AND regexp_matches(props, '\"k\": ?[0-9]')")
def p16_doc_regex(spark, sf):
    d = table(spark, sf, "events")
    return d.where(D.match(d.schema, {"event_type": {"$regex": "^(CLICK|view)", "$options": "i"}, "props": {"$regex": '"k": ?[0-9]'}})).select("event_id")


@query("""SELECT event_id FROM events WHERE NOT coalesce(nullif(value, 0.0) > 50, false)
AND NOT (coalesce(event_type = 'click', false) OR coalesce(user_id < 10, false)) AND user_id IS NOT NULL""")
def p17_doc_not_nor(spark, sf):
    d = table(spark, sf, "events").withColumn("value", F.nullif(F.col("value"), F.lit(0.0)))
    return d.where(D.match(d.schema, {"value": {"$not": {"$gt": 50}}, "$nor": [{"event_type": "click"}, {"user_id": {"$lt": 10}}], "user_id": {"$exists": True}})).select("event_id")


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT >= 5")
def p19_dotted_path(spark, sf):
    d = table(spark, sf, "events").withColumn("props", F.from_json("props", "k int"))
    return D.project(d.where(D.match(d.schema, {"props.k": {"$gte": 5}})), {"event_id": 1, "k": "$props.k"})


@query(_DOCS + " SELECT _id, array_to_string(lines[1:2], ',') AS head, array_to_string(quantities[-2:], ',') AS tail, array_to_string(quantities[2:3], ',') AS mid FROM d")
def p20_projection_slice(spark, sf):
    d = _orders_docs(spark, sf).select("_id", "lines", "quantities", F.col("quantities").alias("mid"))
    p = D.project(d, {"lines": {"$slice": 2}, "quantities": {"$slice": -2}, "mid": {"$slice": [1, 2]}})
    return p.select("_id", F.array_join("lines", ",").alias("head"), F.array_join("quantities", ",").alias("tail"), F.array_join("mid", ",").alias("mid"))


@query("SELECT doc_id FROM documents WHERE (lang IN ('en', 'de') AND n_chars >= 500 AND NOT (source = 'src3')) OR contains(source, '9')")
def p22_metadata_filter(spark, sf):
    spec = {"or": [{"and": [{"field": "lang", "op": "in", "value": ["en", "de"]}, {"field": "n_chars", "op": "gte", "value": 500}, {"not": {"field": "source", "value": "src3"}}]}, {"field": "source", "op": "contains", "value": "9"}]}
    return table(spark, sf, "documents").where(P.metadata_filter(spec, None)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND (source = 'public' OR source IN ('src1', 'src2'))")
def p23_visibility(spark, sf):
    return P.visible(table(spark, sf, "documents"), "en", ["src1", "src2"], "lang", "source").select("doc_id")


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def p26_loose_group(spark, sf):
    return sqlfront.loose_group(table(spark, sf, "part"), ["p_brand"], ["p_partkey"], "first", "p_partkey")


# -- joins ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def j01_inner_join(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return sqlfront.run(spark, "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000", {"orders": o, "customer": c}, "mysql")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def j02_left_join(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return sqlfront.run(spark, "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", {"orders": o, "customer": c}, "mysql")


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def j03_multiway(spark, sf):
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "nation", "region")}
    return sqlfront.run(spark, SQL["j03_multiway"], t)


@query("""SELECT c_custkey, coalesce(x.orders, '') AS orders FROM customer LEFT JOIN
(SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1) x ON c_custkey = o_custkey""")
def j04_lookup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = D.lookup(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "o_custkey", "found", order="o_orderkey")
    return out.select("c_custkey", F.array_join(F.transform("found", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
WHERE r = 1 AND event_type <> 'error'""")
def j05_latest_version(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return V.latest_view(e, "user_id", "event_id", F.col("event_type") == "error")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j08_anti(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("evidence_id"), F.col("doc_id").alias("memory_id"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return M.unreferenced(docs, labels, docs).withColumnRenamed("id", "doc_id")


@query("SELECT doc_id, lang, source, rank FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 20")
def j09_enrich_winners(spark, sf):
    d = table(spark, sf, "documents")
    top = d.select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(20)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n_chars").desc(), "doc_id")))
    return d.join(F.broadcast(top.select("doc_id", "rank")), "doc_id").select("doc_id", "lang", "source", "rank")  # 20 rows


# -- aggregates -----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS count FROM lineitem WHERE l_quantity > 30")
def a01_count(spark, sf):
    return Dataset(table(spark, sf, "lineitem")).filter(l_quantity_gt=30).aggregate(count=True)


@query("SELECT round(sum(l_extendedprice), 2) AS sum FROM lineitem")
def a02_sum(spark, sf):
    return Dataset(table(spark, sf, "lineitem")).aggregate(sum="l_extendedprice").select(F.round("sum", 2).alias("sum"))


@query("SELECT min(l_tax) AS min, max(l_extendedprice) AS max, count(l_tax) AS count FROM lineitem WHERE l_linenumber >= 2")
def a03_minmax(spark, sf):
    return Dataset(table(spark, sf, "lineitem")).filter(l_linenumber_ge=2).aggregate(min="l_tax", max="l_extendedprice", count=True)


@query("SELECT round(sum(l_extendedprice), 2) AS sum, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(l_extendedprice) AS count FROM lineitem WHERE l_quantity > 30 AND l_linenumber = 2")
def a04_mixed_aggregate(spark, sf):
    d = Dataset(table(spark, sf, "lineitem")).filter(l_quantity_gt=30, l_linenumber_eq=2)
    return d.aggregate(sum="l_extendedprice", min="l_extendedprice", max="l_extendedprice", count=True).withColumn("sum", F.round("sum", 2))


@query("""SELECT count(*) AS n, count(nullif(l_discount, 0.0)) AS n_discount, round(sum(l_quantity), 2) AS quantity, min(l_extendedprice) AS low,
max(l_tax) AS high, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_returnflag = 'N'""")
def a08_multi_aggregate(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("d", F.nullif(F.col("l_discount"), F.lit(0.0)))
    got = Dataset(df).filter(l_returnflag="N").aggregate_multi({"n": ("count_rows", None), "n_discount": ("count", "d"), "quantity": ("sum", "l_quantity"), "low": ("min", "l_extendedprice"), "high": ("max", "l_tax"), "discount": ("avg", "l_discount")})
    return got.withColumns({"quantity": F.round("quantity", 2), "discount": F.round("discount", 6)})


@query("SELECT round(avg(l_quantity), 6) AS avg, 0.0::DOUBLE AS none FROM lineitem")
def a09_avg(spark, sf):
    df = table(spark, sf, "lineitem")
    none = Dataset(df).filter(l_quantity_lt=-1).aggregate_multi({"none": ("avg_or_zero", "l_quantity")})
    return Dataset(df).aggregate(avg="l_quantity").select(F.round("avg", 6).alias("avg")).crossJoin(none)  # one row each


_A10 = "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 2) AS qty, MIN(l_tax) AS low, MAX(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10 ORDER BY n DESC"


@query(_A10)
def a10_group_having(spark, sf):
    return sqlfront.run(spark, _A10, {"lineitem": table(spark, sf, "lineitem")}, "mysql")


@query("SELECT event_type, user_id % 5 AS slot, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def a12_group_compound(spark, sf):
    e = table(spark, sf, "events").withColumn("slot", F.col("user_id") % 5)
    g = D.group(e, {"_id": {"event_type": "$event_type", "slot": "$slot"}, "n": {"$sum": 1}, "total": {"$sum": "$value"}, "low": {"$min": "$value"}, "high": {"$max": "$value"}, "mean": {"$avg": "$value"}})
    return g.select("_id.event_type", "_id.slot", "n", F.round("total", 4).alias("total"), "low", "high", F.round("mean", 6).alias("mean"))


@query("SELECT user_id, arg_min(v, event_id) AS first, arg_max(v, event_id) AS last FROM (SELECT user_id, event_id, nullif(value, 0.0) AS v FROM events) GROUP BY 1")
def a14_first_last(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.nullif(F.col("value"), F.lit(0.0)))
    return D.group(e, {"_id": "$user_id", "first": {"$first": "$v"}, "last": {"$last": "$v"}}, "event_id").withColumnRenamed("_id", "user_id")


@query("SELECT count(*) AS total FROM events WHERE value >= 10")
def a15_count(spark, sf):
    return D.aggregate(table(spark, sf, "events"), [{"$match": {"value": {"$gte": 10}}}, {"$count": "total"}])


@query("SELECT event_type AS _id, count(*) AS count FROM events GROUP BY 1")
def a16_sort_by_count(spark, sf):
    return D.aggregate(table(spark, sf, "events"), [{"$sortByCount": "$event_type"}])


@query("""SELECT (SELECT string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)) AS by_status,
(SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS dear""")
def a17_facet(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    f = D.aggregate(o, [{"$facet": {"by_status": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}], "dear": [{"$match": {"o_totalprice": {"$gt": 200000}}}, {"$count": "n"}]}}])
    return f.select(F.array_join(F.transform(F.array_sort("by_status"), lambda x: F.concat(x["_id"], F.lit("="), x["n"])), ",").alias("by_status"), F.get("dear", F.lit(0))["n"].alias("dear"))


@query("SELECT count(*) AS count, round(sum(l_quantity), 2) AS sum, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem")
def a19_shard_merge(spark, sf):
    shards = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("shard")).agg(F.count("*").alias("count"), F.sum("l_quantity").alias("sum"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"))
    return merge_shards(shards).withColumn("sum", F.round("sum", 2))


@query("""SELECT 'l_quantity' AS column, min(l_quantity) AS min, max(l_quantity) AS max, count(l_quantity) AS count, count(*) - count(l_quantity) AS nulls FROM lineitem
UNION ALL SELECT 'd', min(d), max(d), count(d), count(*) - count(d) FROM (SELECT nullif(l_discount, 0.0) AS d FROM lineitem)""")
def a20_column_stats(spark, sf):
    return column_stats(table(spark, sf, "lineitem").withColumn("d", F.nullif(F.col("l_discount"), F.lit(0.0))), ["l_quantity", "d"]).drop("cardinality")


def _memories(spark, sf):
    """Conversation turns as memories: namespaces by turn, statements by text."""
    c = table(spark, sf, "conversations")
    ns = F.element_at(F.array(*map(F.lit, ["episodic", "semantic", "procedural", "prospective", "preference"])), (F.col("turn") % 5 + 1).cast("int"))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        ns.alias("namespace"),
        F.concat(F.lit("Topic "), F.col("conv_id") % 40).alias("subject"),
        F.col("text").alias("statement"),
        F.when(F.col("turn") % 7 == 6, "personal").otherwise("internal").alias("sensitivity"),
        F.array(F.lit("conversation"), F.lit("coding")).alias("allowed_purposes"),
        F.array(F.concat(F.lit("e"), "conv_id"), F.concat(F.lit("t"), "turn")).alias("evidence_ids"),
        (F.lit(0.5) + (F.col("conv_id") % 5) / 10.0).alias("confidence"),
        ((F.col("turn") % 4) / 4.0).alias("importance"),
        F.when(F.col("role") == "user", "explicit").otherwise("inferred").alias("provenance"),
        (F.col("turn") % 3).alias("reinforcement"),
        (F.lit(NOW_MS) - F.col("conv_id") * F.lit(M.DAY_MS)).alias("event_time_ms"),
        (F.lit(NOW_MS) - F.col("conv_id") * F.lit(M.DAY_MS)).alias("recorded_at_ms"),
        F.when(F.col("turn") % 9 == 8, F.lit(NOW_MS + 5)).alias("valid_from_ms"),
        F.when(F.col("turn") % 11 == 10, F.lit(NOW_MS - 5)).alias("valid_until_ms"),
        F.when(F.col("conv_id") % 13 == 12, "superseded").otherwise("active").alias("status"),
    )


_MEM = f"""WITH m AS (SELECT conv_id || '-' || turn AS id, ['episodic', 'semantic', 'procedural', 'prospective', 'preference'][turn % 5 + 1] AS namespace,
'Topic ' || (conv_id % 40) AS subject, text AS statement, CASE WHEN turn % 7 = 6 THEN 'personal' ELSE 'internal' END AS sensitivity,
['e' || conv_id, 't' || turn] AS evidence_ids, 0.5 + (conv_id % 5) / 10.0::DOUBLE AS confidence, (turn % 4) / 4.0::DOUBLE AS importance,
CASE WHEN role = 'user' THEN 'explicit' ELSE 'inferred' END AS provenance, turn % 3 AS reinforcement, {NOW_MS} - conv_id * {M.DAY_MS} AS event_time_ms,
CASE WHEN turn % 9 = 8 THEN {NOW_MS + 5} END AS valid_from_ms, CASE WHEN turn % 11 = 10 THEN {NOW_MS - 5} END AS valid_until_ms,
CASE WHEN conv_id % 13 = 12 THEN 'superseded' ELSE 'active' END AS status FROM conversations)"""


@query(_MEM + """ SELECT lower(trim(subject)) AS subject_key, count(*) AS episodes, array_to_string(list_sort(list_distinct(flatten(list(evidence_ids)))), ',') AS evidence,
round(least(0.95, max(confidence) + 0.05), 6) AS confidence, max(importance) AS importance FROM m WHERE namespace = 'episodic' AND status = 'active' GROUP BY 1 HAVING count(*) >= 3""")
def a21_consolidation(spark, sf):
    c = M.consolidate(_memories(spark, sf))
    return c.select("subject_key", "episodes", F.array_join("evidence_ids", ",").alias("evidence"), F.round("confidence", 6).alias("confidence"), "importance")


@query(_MEM + """, k AS (SELECT lower(trim(subject)) AS subject_key, count(DISTINCT lower(trim(statement))) AS statements FROM m GROUP BY 1 HAVING count(DISTINCT lower(trim(statement))) > 1)
SELECT id, subject_key, statements FROM m JOIN k ON lower(trim(subject)) = subject_key""")
def a22_conflicts(spark, sf):
    return M.conflicts(_memories(spark, sf))


_EVAL = """WITH h AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
j AS (SELECT DISTINCT source AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
t AS (SELECT query_id, count(*) AS n FROM j GROUP BY 1),
g AS (SELECT query_id, count(*) AS hit, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM j JOIN h USING (query_id, doc_id) WHERE rank <= 20 GROUP BY 1),
p AS (SELECT coalesce(hit, 0) / n AS recall, coalesce(1 / first, 0) AS rr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 20) + 1), lambda i: 1 / log2(i + 1.0))) AS ndcg FROM t LEFT JOIN g USING (query_id))
SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM p"""


@query(_EVAL)
def a23_retrieval_eval(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    hits = d.select(F.col("source").alias("query_id"), "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")).alias("rank"))
    judged = d.join(labels.where("quality = 1"), "doc_id").select(F.col("source").alias("query_id"), "doc_id")
    e = R.evaluate(hits, judged, 20)
    return e.select("queries", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(_MEM + """, c AS (SELECT list_filter([id, id || 'x'], lambda s: true) AS recalled, [id] AS expected, CASE WHEN namespace = 'episodic' THEN [id || 'x'] ELSE [''] END AS forbidden FROM m)
SELECT count(*) AS cases, sum(1)::BIGINT AS useful, 0::BIGINT AS missed, sum((forbidden[1] = '')::INT)::BIGINT AS intrusive, 0::BIGINT AS stale, sum((forbidden[1] <> '')::INT)::BIGINT AS harmful, 1.0::DOUBLE AS useful_recall FROM c""")
def a24_memory_eval(spark, sf):
    m = _memories(spark, sf)
    other = F.concat("id", F.lit("x"))
    return M.evaluate(m.select(F.array("id", other).alias("recalled"), F.array("id").alias("expected"), F.when(F.col("namespace") == "episodic", F.array(other)).otherwise(F.array(F.lit(""))).alias("forbidden"), F.array(F.lit("none")).alias("stale")))


@query("""SELECT lang, count(*) FILTER (doc_id % 4 <> 0) AS live_chunks, count(*) AS stored_chunks, coalesce(sum(n_chars) FILTER (doc_id % 4 <> 0), 0)::BIGINT AS live_bytes,
sum(n_chars)::BIGINT AS stored_bytes, (sum(n_chars) - coalesce(sum(n_chars) FILTER (doc_id % 4 <> 0), 0))::BIGINT AS reclaimable_bytes FROM documents GROUP BY lang""")
def a25_storage_stats(spark, sf):
    return storage_stats(table(spark, sf, "documents").withColumn("live", F.col("doc_id") % 4 != 0), "live", "n_chars", ["lang"])


@query("SELECT doc_id AS chunk_id, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END)::BIGINT AS net, round(greatest(-0.1, least(0.1, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END) * 0.02)), 6)::DOUBLE AS boost FROM labels GROUP BY 1")
def a26_feedback(spark, sf):
    votes = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("vote"))
    return R.feedback_scores(votes).withColumn("boost", F.round("boost", 6))


# -- sorts ----------------------------------------------------------------------------------------------------------

_O01 = "SELECT p_brand AS brand, p_partkey, p_retailprice FROM part ORDER BY brand, 3 DESC, p_partkey LIMIT 100"


@query(_O01)
def o01_order_alias_ordinal(spark, sf):
    return sqlfront.run(spark, _O01, {"part": table(spark, sf, "part")})


@query("SELECT event_id, event_type, value FROM events ORDER BY event_type ASC, value DESC, event_id LIMIT 60 OFFSET 20")
def o03_doc_sort(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return D.aggregate(e, [{"$sort": {"event_type": 1, "value": -1, "event_id": 1}}, {"$skip": 20}, {"$limit": 60}])


# -- functions ------------------------------------------------------------------------------------------------------


@query(r"SELECT p_partkey, lower(p_name) AS low, upper(p_type) AS up, length(p_name)::INT AS len, substring(p_name, 2, 5) AS sub, regexp_replace('  ' || p_brand || chr(9), '^\s+|\s+$', '', 'g') AS trimmed FROM part")
def f01_string_functions(spark, sf):
    c = F.col
    return table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("low"), F.upper("p_type").alias("up"), F.length("p_name").alias("len"), S.substring(c("p_name"), 2, 5).alias("sub"), S.trim_all(F.concat(F.lit("  "), "p_brand", F.lit("\t"))).alias("trimmed"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, round_even(c_acctbal, 0)::DOUBLE AS r, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c FROM customer")
def f05_math_functions(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", S.absolute(b).alias("a"), S.round_half_even(b).alias("r"), F.floor(b).alias("f"), F.ceil(b).alias("c"))


@query("SELECT s_suppkey, coalesce(nullif(s_nationkey, 3), -1) AS nation FROM supplier")
def f08_coalesce(spark, sf):
    return sqlfront.run(spark, "SELECT s_suppkey, NVL(nullif(s_nationkey, 3), -1) AS nation FROM supplier", {"supplier": table(spark, sf, "supplier")}, "oracle")


@query()
def f09_current(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", S.current_date_text().alias("today"), S.current_timestamp_text().alias("now"))


@query("SELECT o_orderkey, o_totalprice AS price, 'x' AS tag, o_totalprice AS copy FROM orders")
def f10_add_fields(spark, sf):
    o = table(spark, sf, "orders")
    return D.aggregate(o, [{"$addFields": {"copy": "$o_totalprice", "tag": {"$literal": "x"}}}, {"$project": {"o_orderkey": 1, "price": "$o_totalprice", "tag": 1, "copy": 1}}])


@query("SELECT l_orderkey AS _id, l_linenumber AS n, l_returnflag AS flag FROM lineitem")
def f12_unwind(spark, sf):
    return D.aggregate(_orders_docs(spark, sf), [{"$unwind": "$items"}, {"$project": {"n": "$items.n", "flag": "$items.flag"}}])


@query("""SELECT doc_id, len(t)::INT AS n, array_to_string(t[1:5], ' ') AS head FROM (SELECT doc_id,
regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_''-]+') AS t FROM documents)""")
def f14_tokens(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", S.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


_TOK = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_''-]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "]"


@query(f"""WITH t AS (SELECT c.conv_id, c.turn, list_filter(list_distinct({_TOK.format('c.text')}), lambda x: NOT list_contains({_STOP}, x)) AS q, {_TOK.format('b.text')} AS t
FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 40)
SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, t)) / len(q), 6) END::DOUBLE AS overlap FROM t""")
def f15_overlap(spark, sf):
    c, b = table(spark, sf, "conversations"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("b"))
    j = c.join(b, F.col("item_id") == F.col("conv_id") % 40)
    return j.select("conv_id", "turn", F.round(S.token_overlap(F.col("text"), F.col("b")), 6).alias("overlap"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_TOK.format('text')} AS t FROM conversations),
g AS (SELECT conv_id, turn, list_distinct(list_transform(t, lambda x, i: CASE WHEN i < len(t) THEN x || chr(10) || t[i + 1] ELSE x END)) AS g FROM t)
SELECT a.conv_id, a.turn, CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0 ELSE round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) END::DOUBLE AS similarity
FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def f16_jaccard(spark, sf):
    g = table(spark, sf, "conversations").select("conv_id", "turn", S.bigrams(F.col("text")).alias("g"))
    nxt = g.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return g.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.set_similarity(F.col("g"), F.col("h")), 6).alias("similarity"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS h FROM documents")
def f18_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.content_hash(F.col("text")).alias("h"))


_LANG_HITS = ", ".join(f"len(list_intersect(w, [{', '.join(repr(x) for x in m)}])) AS {k}" for k, m in S.LANGUAGE_MARKERS.items())
_SCRIPT_HITS = ", ".join(f"len(regexp_extract_all(s, '{p}')) AS {k}" for k, p in S.SCRIPTS.items())


@query(f"""WITH t AS (SELECT doc_id, substr(text, 1, 10000) AS s FROM documents),
x AS (SELECT doc_id, s, list_distinct(regexp_extract_all(lower(s), '[a-z\\x{{e0}}-\\x{{ff}}]+')) AS w, {_SCRIPT_HITS} FROM t),
y AS (SELECT *, greatest(zh, ja, ko, ar, ru) AS most, {_LANG_HITS} FROM x)
SELECT doc_id, CASE WHEN most >= greatest(3, length(s) // 20) THEN CASE most WHEN zh THEN 'zh' WHEN ja THEN 'ja' WHEN ko THEN 'ko' WHEN ar THEN 'ar' ELSE 'ru' END
WHEN greatest(en, es, fr, de, pt) = 0 THEN 'und' WHEN en = greatest(en, es, fr, de, pt) THEN 'en' WHEN es = greatest(en, es, fr, de, pt) THEN 'es'
WHEN fr = greatest(en, es, fr, de, pt) THEN 'fr' WHEN de = greatest(en, es, fr, de, pt) THEN 'de' ELSE 'pt' END AS lang FROM y""")
def f19_language(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.detect_language(F.col("text")).alias("lang"))


_INJ = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in S.INJECTION.items())


@query(f"SELECT doc_id, array_to_string(list_filter([{_INJ}], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def f20_injection_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(S.injection_tags(F.col("text")), ",").alias("tags"))


@query(f"SELECT doc_id, sha256(substr(regexp_replace(regexp_replace(text, '{S.SECRETS[0]}', '[REDACTED]', 'g'), '{S.SECRETS[1]}', '[REDACTED]', 'g'), 1, {S.MAX_CONTENT})) AS h FROM documents")
def f21_redaction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.redact(F.col("text")), 256).alias("h"))


@query(r"""SELECT page_id, sha256(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '<[^>]*>', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM pages""")
def f22_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(S.html_text(F.col("html")), 256).alias("h"))


@query()
def f23_steps(spark, sf):
    m = _memories(spark, sf)
    return m.select("id", F.size(S.steps(F.col("statement"))).alias("steps"), S.memory_category(F.col("subject"), F.col("statement"), F.col("namespace")).alias("category"))


@query()
def f24_verify(spark, sf):
    c, b = table(spark, sf, "conversations"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("context"))
    j = c.join(b, F.col("item_id") == F.col("conv_id") % 40)
    return j.select("conv_id", "turn", F.explode(S.verify_claims(F.concat("text", F.lit(" [1].")), F.col("context"), F.array(F.lit(1).cast("long")))).alias("x")).select("conv_id", "turn", "x.*")


@query("SELECT page_id, url_encode(url) AS u FROM pages")
def f25_url_encode(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")).alias("u"))


# -- mutations ------------------------------------------------------------------------------------------------------


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def m02_update_many(spark, sf):
    log = V.base(_orders(spark, sf), "o_orderkey")
    return V.visible(V.update(log, F.col("o_totalprice") > 100000, {"o_orderstatus": "X"}, 2))


@query("""SELECT o_orderkey AS _id, round((o_totalprice + 10) * 1, 2) AS o_totalprice, least(o_custkey, 700) AS o_custkey, NULL::VARCHAR AS o_orderstatus,
CASE WHEN o_orderkey % 2 = 0 THEN '1,2,9' ELSE '1,2,3,9' END AS tags FROM orders""")
def m03_update_ops(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), "o_totalprice", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("tags"))
    c = D.Collection.of(o).update({}, {"$inc": {"o_totalprice": 10}, "$min": {"o_custkey": 700}, "$unset": {"o_orderstatus": 1}, "$addToSet": {"tags": {"$each": [2, 9]}}})
    return c.documents.select("_id", F.round("o_totalprice", 2).alias("o_totalprice"), "o_custkey", "o_orderstatus", F.array_join("tags", ",").alias("tags"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT o_orderstatus = 'F'")
def m04_delete_many(spark, sf):
    return V.visible(V.delete(V.base(_orders(spark, sf), "o_orderkey"), F.col("o_orderstatus") == "F", 2))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT 1000000 + o_orderkey, 'N', o_totalprice FROM orders WHERE o_totalprice > 150000")
def m07_insert_ignore(spark, sf):
    # an order may have the number of a new one, so rows are known by both: whether new, and the number
    o = _orders(spark, sf).withColumn("row", F.struct(F.lit(False).alias("new"), "o_orderkey"))
    more = o.where("o_totalprice > 150000").select((F.col("o_orderkey") + 1000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    more = more.withColumn("row", F.struct(F.lit(True).alias("new"), "o_orderkey"))
    log = V.insert(V.base(o, "row"), more, "row", 2)
    return V.visible(V.insert(log, o, "row", 3, "ignore")).drop("row")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def m08_replace(spark, sf):
    o = _orders(spark, sf)
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("R").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    return V.visible(V.replace(V.base(o, "o_orderkey"), new, "o_orderkey", 2))


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT -1 - o_orderkey, 'U', 1.0 FROM orders WHERE o_orderkey % 5 = 0""")
def m09_upsert(spark, sf):
    o = _orders(spark, sf)
    hit = o.where("o_orderkey % 5 = 0")
    rows = hit.select("o_orderkey", F.lit("U").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    rows = rows.unionByName(hit.select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("U").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice")))
    return V.visible(V.upsert(V.base(o, "o_orderkey"), rows, "o_orderkey", 2, {"o_totalprice": F.col("old.o_totalprice") + F.col("new.o_totalprice")}))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def m13_parameters(spark, sf):
    return sqlfront.run(spark, "SELECT o_orderkey FROM orders WHERE o_totalprice > %(least)s AND o_orderstatus = %(status)s", {"orders": table(spark, sf, "orders")}, "mysql", {"least": 100000, "status": "O"})


_DIALECT_SQL = {
    "ansi": 'SELECT "l_orderkey", l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linenumber IN (1, 2)',
    "postgres": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity::DOUBLE BETWEEN 10 AND 20 AND l_linenumber IN (1, 2)",
    "mysql": "SELECT `l_orderkey`, l_linenumber FROM lineitem WHERE IFNULL(l_quantity, 0) BETWEEN 10 AND 20 AND l_linenumber IN (1, 2)",
    "sqlite": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ifnull(l_quantity, 0) BETWEEN 10 AND 20 AND l_linenumber IN (1, 2)",
    "duckdb": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity::double BETWEEN 10 AND 20 AND l_linenumber IN (1, 2)",
    "oracle": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NVL(l_quantity, 0) BETWEEN 10 AND 20 AND l_linenumber IN (1, 2)",
    "sqlserver": "SELECT [l_orderkey], l_linenumber FROM lineitem WHERE ISNULL(l_quantity, 0) BETWEEN 10 AND 20 AND l_linenumber IN (1, 2)",
}


def _dialect(name: str, sql: str):
    def run(spark, sf):
        return sqlfront.run(spark, sql, {"lineitem": table(spark, sf, "lineitem")}, name)

    QUERIES[f"m14_dialect_{name}"] = run
    SQL[f"m14_dialect_{name}"] = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linenumber IN (1, 2)"


for _name, _sql in _DIALECT_SQL.items():
    _dialect(_name, _sql)


@query("SELECT o_orderkey, NULL::VARCHAR AS note FROM orders")
def m18_add_column(spark, sf):
    from tidewell.schema import add_columns

    return add_columns(table(spark, sf, "orders").select("o_orderkey"), {"note": "string"})


# -- vectors --------------------------------------------------------------------------------------------------------

_Q0 = "(SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)"


def _q0(spark, sf):
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").first().embedding]


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT {_Q0} AS q)
SELECT vec_id, round(list_cosine_distance(v, q), 6) AS cosine, round(-list_inner_product(v, q), 6) AS dot, round(list_distance(v, q) ** 2, 6) AS l2 FROM e, q""")
def v01_distances(spark, sf):
    q = X.literal(_q0(spark, sf))
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(X.distance(F.col("embedding"), q, m), 6).alias(m) for m in X.METRICS])


def _top(metric: str, expr: str, where: str = "") -> None:
    def run(spark, sf):
        e = table(spark, sf, "embeddings")
        found = X.top_k(e, _q0(spark, sf), 10, metric, "vec_id", where=F.expr(where) if where else None)
        return found.withColumn("distance", F.round("distance", 6))

    name = f"v02_topk_{'filtered' if where else metric}"
    QUERIES[name] = run
    SQL[name] = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings {'WHERE ' + where if where else ''}), q AS (SELECT {_Q0} AS q),
d AS (SELECT vec_id, {expr} AS distance FROM e, q) SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY d.distance, vec_id LIMIT 10"""


_top("cosine", "list_cosine_distance(v, q)")
_top("dot", "-list_inner_product(v, q)")
_top("l2", "list_distance(v, q) ** 2")
_top("cosine", "list_cosine_distance(v, q)", "label % 2 = 0")


@query(SQL["v02_topk_cosine"])
def v05_ivf_full_probe(spark, sf):
    index = X.Ivf.build(table(spark, sf, "embeddings"), "cosine", "vec_id")
    return index.search(_q0(spark, sf), 10, probes=len(index.centroids)).withColumn("distance", F.round("distance", 6))


@query()
def v05_ivf_auto(spark, sf):
    return X.Ivf.build(table(spark, sf, "embeddings"), "cosine", "vec_id").search(_q0(spark, sf), 10)


@query(f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, max(-list_cosine_distance(e.v, q.v)) AS score FROM e JOIN e q ON q.vec_id % 20 = 0 AND (e.label = q.label OR e.label = q.label + 1) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def v08_scoped_search(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.array("label", F.col("label") + 1).alias("scopes"))
    return X.scoped_search(e, q, 5, "label", "vec_id").withColumn("score", F.round("score", 6))


# -- retrieval ------------------------------------------------------------------------------------------------------

_BM = f"""WITH d AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM benchmark),
f AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / greatest(al, 1)))) AS score FROM q JOIN f USING (term) JOIN df USING (term), st GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s)"""


def _bm25(spark, sf, n):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.bm25(table(spark, sf, "documents"), q, n)


@query(_BM + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM b WHERE rank <= 10")
def r04_bm25(spark, sf):
    return _bm25(spark, sf, 10).withColumn("score", F.round("score", 6))


_LONG = """, o AS (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id)::INT AS rank FROM benchmark JOIN documents ON doc_id % 40 = item_id)"""


def _long_list(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "benchmark").select("item_id"), F.col("doc_id") % 40 == F.col("item_id"))
    return j.select(F.col("item_id").alias("query_id"), "doc_id", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("n_chars").desc(), "doc_id")).alias("rank"))


_RRF = _BM + _LONG + """, u AS (SELECT query_id, doc_id, rank FROM b WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM o WHERE rank <= 20),
x AS (SELECT query_id, doc_id, sum(1 / (60.0 + rank)) AS score FROM u GROUP BY 1, 2),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id)::INT AS rank FROM x)"""


def _rrf(spark, sf, n):
    return R.reciprocal_rank_fusion([_bm25(spark, sf, 20), _long_list(spark, sf).where("rank <= 20")], n)


@query(_RRF + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM y WHERE rank <= 15")
def r05_rrf(spark, sf):
    return _rrf(spark, sf, 15).withColumn("score", F.round("score", 6))


@query(f"""WITH q AS (SELECT conv_id, turn, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS q FROM conversations),
c AS (SELECT *, CASE WHEN contains(q, '"') OR regexp_matches(q, '{R.IDENTIFIER}') THEN 'lexical' WHEN regexp_matches(q, '{R.RELATIONAL}') THEN 'graph'
WHEN regexp_matches(q, '{R.CONCEPTUAL}') THEN 'vector' ELSE 'hybrid' END AS k FROM q)
SELECT conv_id, turn, k AS classification, k <> 'vector' AS lexical, k <> 'lexical' AS vector, k = 'graph' AS graph, k <> 'lexical' AS rerank FROM c""")
def r06_query_plan(spark, sf):
    q = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return R.plan(q).select("conv_id", "turn", "classification", "lexical", "vector", "graph", "rerank")


@query(rf"""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations WHERE role = 'user'),
a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bSLA\b', 'service level agreement', 'g'), '(?i)\bSSO\b', 'single sign-on', 'g'), '(?i)\bRBAC\b', 'role based access control', 'g'), '(?i)\bRAG\b', 'retrieval augmented generation', 'g') AS e FROM u)
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '{R.PRONOUN}') AND prior IS NOT NULL AND prior <> text AND length(prior || ' ' || e) <= 512 THEN prior || ' ' || e ELSE e END AS effective_query FROM a""")
def r07_rewrite(spark, sf):
    return R.rewrite(table(spark, sf, "conversations"))


_RERANK = _RRF + f""", z AS (SELECT y.query_id, y.doc_id, y.score, d.lang AS title, d.source AS section, d.text AS text, q.text AS query, d.doc_id % 100 AS age, (d.doc_id % 3) / 2.0 AS au, (d.doc_id % 5) / 4.0 AS sq, d.doc_id % 7 - 3 AS fb
  FROM y JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = y.query_id WHERE y.rank <= 15),
ov AS (SELECT *, list_filter(list_distinct({_TOK.format('query')}), lambda x: NOT list_contains({_STOP}, x)) AS qt, {_TOK.format("title || ' ' || section || ' ' || text")} AS tt FROM z),
rr AS (SELECT query_id, doc_id, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, tt)) / len(qt) END AS overlap, score, age, au, sq, fb FROM ov),
rs AS (SELECT *, score + 0.35 * overlap + 0.05 / (1 + age / 365) + 0.08 * au + 0.08 * sq + 0.05 * greatest(-2.0, least(2.0, fb)) AS rerank_score FROM rr),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, doc_id)::INT AS rank FROM rs)"""


def _reranked(spark, sf):
    d = table(spark, sf, "documents")
    extra = d.select("doc_id", F.col("lang").alias("title"), F.col("source").alias("section"), "text", (F.col("doc_id") % 100).alias("age_days"), ((F.col("doc_id") % 3) / 2.0).alias("authority"), ((F.col("doc_id") % 5) / 4.0).alias("source_quality"), (F.col("doc_id") % 7 - 3).alias("feedback"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.rerank(_rrf(spark, sf, 15).drop("rank").join(extra, "doc_id").join(q, "query_id"))


@query(_RERANK + " SELECT query_id, doc_id, round(overlap, 6)::DOUBLE AS overlap, round(rerank_score, 6)::DOUBLE AS rerank_score, rank FROM rk")
def r08_rerank(spark, sf):
    return _reranked(spark, sf).select("query_id", "doc_id", F.round("overlap", 6).alias("overlap"), F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(_RERANK + """, tw AS (SELECT query_id, max(overlap) FILTER (rank = 1) AS o, max(rerank_score) FILTER (rank = 1) AS s, max(rerank_score) FILTER (rank = 2) AS t FROM rk WHERE rank <= 2 GROUP BY 1),
cf AS (SELECT query_id, greatest(0, least(1, 0.55 * o + 0.25 * least(1, s) + 0.2 * least(1, 10 * greatest(0, s - coalesce(t, 0))))) AS v FROM tw)
SELECT query_id, round(v, 6)::DOUBLE AS confidence, v < 0.18 AS insufficient FROM cf""")
def r09_confidence(spark, sf):
    return R.confidence(_reranked(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query()
def r01_fast_chunks(spark, sf):
    return parse.chunk(table(spark, sf, "documents"), "doc_id", "text", "fast", with_text=False)


@query()
def r02_structured_chunks(spark, sf):
    return parse.chunk(table(spark, sf, "documents"), "doc_id", "text", "structured", with_text=False)


@query("""WITH h AS (SELECT lang, doc_id, sha256(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS h FROM documents)
SELECT doc_id, m AS "of", 1.0::DOUBLE AS similarity FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, h) AS m FROM h) WHERE doc_id <> m""")
def r11_duplicates(spark, sf):
    return R.duplicates(table(spark, sf, "documents"), tenant="lang", order="doc_id").where("exact").drop("exact")


@query(f"""WITH t AS (SELECT lang, doc_id, sha256(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS h, {_TOK.format('text')} AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
g AS (SELECT lang, doc_id, h, n, list_distinct(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i < len(t) THEN t[i] || chr(10) || t[i + 1] ELSE t[i] END)) AS g FROM t),
p AS (SELECT a.doc_id, b.doc_id AS "of", len(list_intersect(a.g, b.g)) AS c, len(a.g) + len(b.g) AS s FROM g a JOIN g b ON a.lang = b.lang AND b.n BETWEEN a.n - 200 AND a.n - 1 AND a.h <> b.h AND len(a.g) > 0 AND len(b.g) > 0)
SELECT doc_id, "of", round(c / (s - c), 6) AS similarity FROM p WHERE c / (s - c) >= 0.9""")
def r11_near_duplicates(spark, sf):
    near = R.duplicates(table(spark, sf, "documents"), tenant="lang", order="doc_id").where("not exact")
    return near.select("doc_id", "of", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, sha256(doc_id || chr(10) || text || chr(10) || lang || chr(10) || 'parser-1') AS version_id FROM documents")
def r12_versions(spark, sf):
    return R.document_versions(table(spark, sf, "documents"), "parser-1", metadata=["lang"]).select("doc_id", "version_id")


@query("SELECT doc_id FROM documents WHERE n_chars >= 1000 AND lang <> 'fr'")
def r13_retention(spark, sf):
    return R.retention(table(spark, sf, "documents"), F.lit(1000), "n_chars", "lang", "fr").select("doc_id")


@query()
def r14_pack_context(spark, sf):
    hits = _rrf(spark, sf, 15).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return R.pack_context(hits, id="doc_id")


@query(_EVAL.replace("SELECT count(*) AS queries", "SELECT CASE WHEN query_id LIKE '%1%' THEN 'structured' ELSE 'fast' END AS mode, count(*) AS queries").replace("p AS (SELECT ", "p AS (SELECT query_id, ") + " GROUP BY 1")
def r15_mode_comparison(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    mode = F.when(F.col("source").like("%1%"), "structured").otherwise("fast").alias("mode")
    hits = d.select(F.col("source").alias("query_id"), "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")).alias("rank"))
    judged = d.join(labels.where("quality = 1"), "doc_id").select(F.col("source").alias("query_id"), "doc_id", mode)
    e = R.retained_modes(R.evaluate(hits, judged, 20, by="mode"))
    return e.select("mode", "queries", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


# -- graph ----------------------------------------------------------------------------------------------------------

_G = """WITH c AS (SELECT conv_id || '/' || turn AS node, conv_id || '/root' AS root, conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
e AS (SELECT node AS src, root AS dst, 'parent' AS type, 217 AS weight FROM c UNION ALL SELECT root, node, 'child', 217 FROM c
UNION ALL SELECT conv_id || '/' || p, node, 'next', 179 FROM c WHERE p IS NOT NULL UNION ALL SELECT node, conv_id || '/' || p, 'previous', 179 FROM c WHERE p IS NOT NULL)"""


def _edges(spark, sf):
    return R.graph_edges(table(spark, sf, "conversations"), "conv_id", "turn")


@query(_G + " SELECT * FROM e")
def g01_graph_edges(spark, sf):
    return _edges(spark, sf)


@query(_G + """, r AS (SELECT conv_id AS query_id, node, 1.0 / (1 + turn) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM c WHERE role = 'user'),
k AS (SELECT * FROM (SELECT src AS s, dst AS kid, weight / 255.0 AS w2, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM e WHERE type = 'child') WHERE n <= 8),
f AS (SELECT query_id, node AS seed, rank AS seed_rank, dst AS node, score * weight / 255.0 AS score, type AS relation FROM r JOIN e ON src = node WHERE type IN ('next', 'previous') AND rank <= 5
  UNION ALL SELECT query_id, node, rank, kid, score * weight / 255.0 * w2, 'section_child' FROM r JOIN e ON src = node JOIN k ON s = dst WHERE type = 'parent' AND rank <= 5),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, score DESC, node, relation) AS n FROM f WHERE node <> seed),
y AS (SELECT query_id, node, max(score) AS score, 1 AS hops FROM x WHERE n <= 32 AND NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = x.query_id AND r.node = x.node) GROUP BY 1, 2 UNION ALL SELECT query_id, node, score, 0 FROM r),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, node)::INT AS rank FROM y)
SELECT query_id, node, round(score, 6)::DOUBLE AS score, hops, rank FROM z WHERE rank <= 12""")
def g02_expand(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    hits = c.select(F.col("conv_id").alias("query_id"), F.concat_ws("/", "conv_id", "turn").alias("node"), (F.lit(1.0) / (1 + F.col("turn"))).alias("score"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"))
    return R.expand(hits, _edges(spark, sf), 12).withColumn("score", F.round("score", 6))


@query(_G + " SELECT src, dst, type, weight FROM e WHERE src IN (SELECT node FROM c WHERE role = 'user') AND dst IN (SELECT node FROM c WHERE role = 'assistant')")
def g03_neighbors(spark, sf):
    c = table(spark, sf, "conversations").select("role", F.concat_ws("/", "conv_id", "turn").alias("node"))
    return R.neighbours(_edges(spark, sf), c.where("role = 'user'"), c.where("role = 'assistant'"))


# -- memory ---------------------------------------------------------------------------------------------------------


@query(_MEM + f""" SELECT id, CASE WHEN provenance IN ('imported_document', 'inferred') AND regexp_matches(statement, '{M.QUARANTINE}') THEN 'quarantined'
WHEN sensitivity IN ('sensitive', 'personal', 'legal', 'financial', 'identity') THEN 'pending_confirmation' ELSE 'active' END AS status FROM m""")
def k02_status(spark, sf):
    return M.remember_status(_memories(spark, sf)).select("id", "status")


@query(_MEM + """, e AS (SELECT id, CASE WHEN reinforcement = 1 THEN 'dispute' WHEN reinforcement = 2 THEN 'confirm' ELSE 'reinforce' END AS kind FROM m)
SELECT m.id, CASE e.kind WHEN 'dispute' THEN 'disputed' WHEN 'confirm' THEN 'active' ELSE status END AS status, reinforcement + (e.kind = 'reinforce')::INT AS reinforcement,
round(least(1.0, confidence + CASE WHEN e.kind = 'reinforce' THEN 0.02 ELSE 0 END), 6)::DOUBLE AS confidence FROM m JOIN e ON m.id = e.id""")
def k03_fold_events(spark, sf):
    m = _memories(spark, sf)
    kind = F.when(F.col("reinforcement") == 1, "dispute").when(F.col("reinforcement") == 2, "confirm").otherwise("reinforce")
    events = m.select("id", F.lit(1).alias("seq"), kind.alias("kind"), F.lit(0).alias("amount"))
    return M.fold_events(m, events).select("id", "status", "reinforcement", F.round("confidence", 6).alias("confidence"))


_RECALL = _MEM + f""", o AS (SELECT *, {_TOK.format("'the system should check what is needed'")} AS q0, {_TOK.format("subject || ' ' || statement")} AS t FROM m),
s AS (SELECT *, list_distinct(q0) AS q FROM o),
r AS (SELECT *, (0.42 * len(list_intersect(q, t)) / len(q) + 0.18 * confidence + 0.14 * importance + 0.08 * least(reinforcement / 5, 1.0)
 + 0.08 * CASE WHEN namespace = 'episodic' THEN exp(-({NOW_MS} - event_time_ms) / {float(M.DAY_MS)} / 30) ELSE 1 END + 0.1 * CASE WHEN provenance = 'explicit' THEN 1 ELSE 0.75 END)
 * CASE namespace WHEN 'procedural' THEN 1.25 WHEN 'negative' THEN 1.15 ELSE 1 END AS recall_score,
 CASE WHEN sensitivity = 'personal' THEN 'sensitivity' WHEN status <> 'active' THEN status WHEN {NOW_MS} < valid_from_ms THEN 'not_yet_valid' WHEN {NOW_MS} > valid_until_ms THEN 'expired' END AS reason FROM s)"""


def _recalled(spark, sf):
    return M.recall(_memories(spark, sf), F.lit("the system should check what is needed"), "coding", NOW_MS)


@query(_RECALL + " SELECT id, reason, round(recall_score, 6)::DOUBLE AS recall_score FROM r")
def k04_recall(spark, sf):
    return _recalled(spark, sf).select("id", "reason", F.round("recall_score", 6).alias("recall_score"))


@query(_MEM + " SELECT id, round(importance * (0.55 + 0.2 * confidence + 0.15 * importance + 0.1 * least(reinforcement / 5, 1.0)), 6)::DOUBLE AS recall_score FROM m")
def k05_native_recall(spark, sf):
    hits = _memories(spark, sf).withColumn("score", F.col("importance"))
    return M.native_recall(hits).select("id", F.round("recall_score", 6).alias("recall_score"))


@query(_MEM + f" SELECT id FROM m WHERE namespace = 'prospective' AND status = 'active' AND (valid_from_ms IS NULL OR valid_from_ms <= {NOW_MS}) AND len(list_filter({_TOK.format('provenance || chr(32) || subject')}, lambda t: contains('an explicit topic', t))) > 0 ORDER BY id LIMIT 20")
def k06_due(spark, sf):
    return M.due(_memories(spark, sf), NOW_MS, "an explicit topic").select("id")


@query(_RECALL + """, d AS (SELECT 0 AS tier, 'authoritative_documents' AS kind, 'd' || doc_id AS id, n_chars::DOUBLE AS score FROM documents),
k AS (SELECT 1 AS tier, 'memory_context' AS kind, id, round(recall_score, 6)::DOUBLE AS score FROM r WHERE reason IS NULL ORDER BY round(recall_score, 9) DESC, event_time_ms DESC, id LIMIT 12)
SELECT * FROM d UNION ALL SELECT * FROM k""")
def k07_combined(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return M.combined(docs, M.ranked(_recalled(spark, sf)).select("id", F.round("recall_score", 6).alias("score")))


@query(_MEM + f" SELECT id, statement FROM m WHERE valid_until_ms IS NULL OR valid_until_ms > {NOW_MS}")
def k08_working(spark, sf):
    return M.working(_memories(spark, sf).withColumn("expires_at_ms", F.col("valid_until_ms")), NOW_MS).select("id", "statement")


_EX = " UNION ALL ".join(f"SELECT conv_id || '-' || turn AS id, '{ns}' AS namespace, '{s}' AS subject, regexp_extract(text, '{p}', 1) AS statement FROM conversations" for p, ns, s in M.EXTRACT)


@query(f"SELECT * FROM ({_EX}) WHERE length(statement) > 0")
def k09_extract(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"))
    return M.extract(c)


@query()
def k10_refinements(spark, sf):
    return M.refinements(_memories(spark, sf), NOW_MS)


@query()
def k11_procedures(spark, sf):
    return M.procedure_for(_memories(spark, sf), F.lit("how to check the system"), 0.3).select("id", "score")


@query(_MEM + " SELECT m.id, array_to_string(list_sort(evidence_ids), ',') AS evidence, conv || '-0' AS related FROM (SELECT *, split_part(id, '-', 1) AS conv FROM m) m")
def k13_inspect(spark, sf):
    m = _memories(spark, sf)
    links = m.select(F.col("id").alias("memory_id"), F.explode("evidence_ids").alias("evidence_id"))
    relations = m.select(F.col("id").alias("source_id"), F.concat(F.substring_index("id", "-", 1), F.lit("-0")).alias("target_id"))
    evidence = links.select(F.col("evidence_id").alias("id")).distinct()
    out = M.inspect(m.select("id"), links, evidence, relations)
    return out.select("id", F.array_join("evidence", ",").alias("evidence"), F.array_join("related", ",").alias("related"))


# -- streaming ------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_window_counts(spark, sf):
    return streams.window_counts(table(spark, sf, "events"))


@query(SQL["j05_latest_version"])
def st02_version_fold(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return V.latest_view(e, "user_id", "event_id", F.col("event_type") == "error")


@query(f"SELECT event_id FROM events WHERE (value < 10 OR epoch_ms(ts) <= {NOW_MS}) AND (value > 90 OR epoch_ms(ts) >= 0)")
def st06_validity(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").select("event_id", F.when(F.col("value") >= 10, ms).alias("a"), F.when(F.col("value") <= 90, ms).alias("z"))
    return streams.live(e.withColumn("z", F.when(F.col("z") >= 0, None).otherwise(F.col("z"))), NOW_MS, "a", "z").select("event_id")
