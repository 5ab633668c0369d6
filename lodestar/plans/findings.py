"""Queries: fleet status, usage, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import findings as D
from lodestar.operators import fleet
from lodestar.plans.registry import Tables, query

_CLASSES = {"open": ["O"], "success": ["F"], "failed": ["P"]}
_STATE = "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'unknown' END"


@query("state_classes", f"SELECT {_STATE} AS state, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy(fleet.state_class(F.col("o_orderstatus"), _CLASSES).alias("state")).agg(F.count("*").alias("n"))


_SUMMARY = f"SELECT count(*) AS baseline, count(o) AS responded, count(*) FILTER (o) AS with_open, count(*) FILTER (f) AS with_failed, count(*) FILTER (NOT o AND NOT f) AS finished, count(*) FILTER (o IS NULL) AS pending FROM customer LEFT JOIN (SELECT o_custkey, bool_or({_STATE} = 'open') AS o, bool_or({_STATE} = 'failed') AS f FROM orders GROUP BY 1) ON c_custkey = o_custkey"


def _summary(t: Tables) -> DataFrame:
    flows = t.orders.select(F.col("o_custkey").alias("client"), fleet.state_class(F.col("o_orderstatus"), _CLASSES).alias("state"))
    return fleet.response_summary(t.customer.select(F.col("c_custkey").alias("client")), flows, "client", "state")


@query("readiness_summary", _SUMMARY)
def _(t: Tables) -> DataFrame:
    return _summary(t)


@query("readiness_class", f"SELECT baseline, responded, round(responded / baseline, 4) AS ratio, CASE WHEN responded >= 0.8 * baseline THEN 'ready' WHEN responded < 0.2 * baseline THEN 'stalled' ELSE 'waiting' END AS class FROM ({_SUMMARY})")
def _(t: Tables) -> DataFrame:
    r, b = F.col("responded"), F.col("baseline")
    return _summary(t).select("baseline", "responded", F.round(r / b, 4).alias("ratio"), F.when(r >= 0.8 * b, "ready").when(r < 0.2 * b, "stalled").otherwise("waiting").alias("class"))


@query("coverage_status", "SELECT w.client_id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'observed' WHEN n = 0 THEN 'empty' ELSE 'not_observed' END AS status FROM (SELECT DISTINCT client_id FROM clients) w LEFT JOIN (SELECT client_id, sum(coalesce(len(batch_rows), 0)) AS n FROM query_batches GROUP BY 1) s USING (client_id)")
def _(t: Tables) -> DataFrame:
    b = t.query_batches.select("client_id", F.coalesce(F.size("batch_rows"), F.lit(0)).cast("long").alias("n"))
    return fleet.coverage(t.clients, b, "client_id")


@query("domain_coverage", "SELECT artifact, count(DISTINCT client_id) AS hosts, count(DISTINCT client_id) > 10 AS wide, count(*) FILTER (user_name IS NULL) > 0 AS has_unnamed FROM component_rows GROUP BY 1")
def _(t: Tables) -> DataFrame:
    per = t.component_rows.groupBy("artifact", "client_id").agg(F.max(F.col("user_name").isNull()).alias("u"))
    return per.groupBy("artifact").agg(F.count("client_id").alias("hosts"), (F.count("client_id") > 10).alias("wide"), F.max("u").alias("has_unnamed"))


@query("time_scope_coverage", "SELECT count(*) AS artifacts, count(*) FILTER (t) AS supported, CASE WHEN count(*) = 0 THEN 'not_requested' WHEN count(*) FILTER (t) = count(*) THEN 'complete' WHEN count(*) FILTER (t) > 0 THEN 'partial' ELSE 'unsupported' END AS status FROM (SELECT artifact, bool_or(semantic = 'time') AS t FROM schema_contract GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    return fleet.scope_coverage(t.schema_contract, "artifact", F.col("semantic") == "time")


_LOG = "SELECT doc_id, unnest(regexp_extract_all(text, '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ INFO \\[op-v1-[0-9a-f]+\\] rows=\\d+ \\| flow=F\\.[0-9a-f]+')) AS line FROM documents"


def _log(t: Tables) -> DataFrame:
    pattern = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ INFO \[op-v1-[0-9a-f]+\] rows=\d+ \| flow=F\.[0-9a-f]+"
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("line"))


@query("kv_log_filter", f"SELECT doc_id, line[1:20] AS at, regexp_extract(line, 'rows=(\\d+)', 1) AS \"rows\", regexp_extract(line, 'flow=(\\S+)', 1) AS flow FROM ({_LOG}) WHERE CAST(regexp_extract(line, 'rows=(\\d+)', 1) AS INT) >= 5000 AND line[1:20] >= '2025-06-01'")
def _(t: Tables) -> DataFrame:
    x = _log(t).select("doc_id", F.substring("line", 1, 20).alias("at"), *fleet.log_fields(F.col("line"), ["rows", "flow"]))
    return x.where((F.col("rows").cast("int") >= 5000) & (F.col("at") >= "2025-06-01"))


@query("usage_rollup", f"SELECT \"month\", count(*) AS requests, sum(n) AS total FROM (SELECT op, min(\"month\") AS \"month\", max(n) AS n FROM (SELECT regexp_extract(line, 'op-v1-[0-9a-f]+') AS op, line[1:7] AS \"month\", CAST(regexp_extract(line, 'rows=(\\d+)', 1) AS BIGINT) AS n FROM ({_LOG})) GROUP BY 1) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    x = _log(t).select(F.regexp_extract("line", "op-v1-[0-9a-f]+", 0).alias("op"), F.substring("line", 1, 7).alias("month"), F.regexp_extract("line", r"rows=(\d+)", 1).cast("long").alias("n"))
    return fleet.usage_rollup(x, ["op"], ["month"], "n")


@query("usage_reconcile", "SELECT batch_id, coalesce(row_count, len(batch_rows), 0) AS used, CASE WHEN row_count IS NULL THEN 'counted' WHEN row_count = coalesce(len(batch_rows), 0) THEN 'agreed' ELSE 'conflict' END AS issue FROM query_batches")
def _(t: Tables) -> DataFrame:
    n = F.coalesce(F.size("batch_rows"), F.lit(0))
    issue = F.when(F.col("row_count").isNull(), "counted").when(F.col("row_count") == n, "agreed").otherwise("conflict")
    return t.query_batches.select("batch_id", F.coalesce("row_count", n).cast("long").alias("used"), issue.alias("issue"))


@query("retry_candidates", "SELECT client_id, attempts FROM (SELECT client_id, coalesce(a, 0) AS attempts FROM (SELECT DISTINCT client_id FROM clients WHERE client_id NOT IN (SELECT client_id FROM component_rows WHERE artifact = 'Windows.Logs.Logon')) LEFT JOIN (SELECT client_id, count(*) AS a FROM query_batches GROUP BY 1) USING (client_id)) WHERE attempts < 5")
def _(t: Tables) -> DataFrame:
    return fleet.retry_candidates(t.clients, t.component_rows.where("artifact = 'Windows.Logs.Logon'"), t.query_batches, "client_id", 5)


_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END"


@query("priority_rank", f"SELECT o_orderkey, {_RANK} AS rank, o_orderstatus FROM orders ORDER BY rank, o_orderstatus, o_orderkey LIMIT 200")
def _(t: Tables) -> DataFrame:
    r = D.rank_of(F.col("o_orderpriority"), _ORDER).cast("long")
    return t.orders.select("o_orderkey", r.alias("rank"), "o_orderstatus").orderBy("rank", "o_orderstatus", D.natural_key(F.col("o_orderkey"))).limit(200)


@query("consolidate_findings", f"SELECT artifact, doc_kind, CASE min(CASE source WHEN 'hunt-reports' THEN 1 WHEN 'mail-import' THEN 2 ELSE 3 END) WHEN 1 THEN 'hunt-reports' WHEN 2 THEN 'mail-import' ELSE arg_min(source, CASE source WHEN 'hunt-reports' THEN '1' WHEN 'mail-import' THEN '2' ELSE '3' || source END) END AS source, count(*) AS findings, count(DISTINCT client_id) AS evidence FROM documents GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return D.consolidate(t.documents, ["artifact", "doc_kind"], "source", ["hunt-reports", "mail-import"], "client_id")


@query("conflict_free_merge", "SELECT flow_id, user_name, min(artifact) AS artifact, sum(row_no) AS occurrences, min(command_text) AS representative FROM component_rows GROUP BY 1, 2 HAVING count(DISTINCT artifact) = 1")
def _(t: Tables) -> DataFrame:
    return D.merge_without_conflict(t.component_rows, ["flow_id", "user_name"], "artifact", F.col("row_no"), F.col("command_text"))


@query("timeline_topk", f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT * FROM orders ORDER BY {_RANK}, o_orderdate, o_orderkey LIMIT 150)")
def _(t: Tables) -> DataFrame:
    x = D.timeline(t.orders, F.col("o_orderdate"), D.rank_of(F.col("o_orderpriority"), _ORDER), ["o_orderkey"], 150)
    return x.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("recommend_topk", "SELECT p_partkey, score FROM (SELECT p_partkey, p_name, (CASE WHEN p_type LIKE '%BRASS%' THEN 2 ELSE 0 END) + (CASE WHEN p_size < 20 THEN 1 ELSE 0 END) AS score FROM part) ORDER BY score DESC, p_name, p_partkey LIMIT 25")
def _(t: Tables) -> DataFrame:
    score = F.when(F.col("p_type").contains("BRASS"), 2).otherwise(0) + F.when(F.col("p_size") < 20, 1).otherwise(0)
    return t.part.select("p_partkey", "p_name", score.cast("long").alias("score")).orderBy(F.desc("score"), "p_name", "p_partkey").limit(25).drop("p_name")


@query("page_slice", "SELECT doc_id, doc_kind FROM documents WHERE artifact = 'Windows.Logs.Logon' ORDER BY created_at, doc_id LIMIT 50 OFFSET 20")
def _(t: Tables) -> DataFrame:
    d = t.documents.where("artifact = 'Windows.Logs.Logon'").select("doc_id", "doc_kind", "created_at")
    return D.page(d, ["created_at", "doc_id"], 20, 50).select("doc_id", "doc_kind")


@query("ordered_distinct", "SELECT user_name, min(row_id) AS first_row FROM component_rows WHERE user_name IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.component_rows.where("user_name is not null").groupBy("user_name").agg(F.min("row_id").alias("first_row"))


@query("limit_probe", "SELECT rule_id, (SELECT count(DISTINCT rule_id) > 100 FROM golden_rules) AS truncated FROM (SELECT DISTINCT rule_id FROM golden_rules) ORDER BY rule_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return D.probe(t.golden_rules.select("rule_id").distinct(), ["rule_id"], 100)


@query("lead_rank", "SELECT artifact, user_name, n FROM (SELECT artifact, user_name, count(*) AS n FROM component_rows WHERE user_name <> '' GROUP BY 1, 2) ORDER BY n, artifact, user_name LIMIT 60")
def _(t: Tables) -> DataFrame:
    g = t.component_rows.where("user_name <> ''").groupBy("artifact", "user_name").agg(F.count("*").alias("n"))
    return g.orderBy("n", "artifact", "user_name").limit(60)


@query("combine_results", "SELECT client_id, count(*) AS unique_rows, sum(c) AS all_rows, array_to_string((list_sort(list(DISTINCT artifact)))[1:4], ',') AS artifacts FROM (SELECT client_id, artifact, md5(coalesce(command_text, '')) AS f, count(*) AS c FROM component_rows GROUP BY ALL) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    u = t.component_rows.groupBy("client_id", "artifact", F.md5(F.coalesce("command_text", F.lit(""))).alias("f")).agg(F.count("*").alias("c"))
    return u.groupBy("client_id").agg(F.count("*").alias("unique_rows"), F.sum("c").alias("all_rows"), F.array_join(F.slice(F.array_sort(F.collect_set("artifact")), 1, 4), ",").alias("artifacts"))
