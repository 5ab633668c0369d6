"""Queries: lists of what there is, texts and references, comparisons, budgets, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import fleet
from lodestar.operators import records as R
from lodestar.operators import stacks as S
from lodestar.plans.registry import Tables, query


@query("flow_rows", "SELECT client_id, flow_id, artifact, row_no, command_text FROM component_rows")
def _(t: Tables) -> DataFrame:
    return t.component_rows.select("client_id", "flow_id", "artifact", "row_no", "command_text")


@query("flow_list", "SELECT client_id, flow_id, min(artifact) AS artifact, count(*) AS n, strftime(max(received_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM component_rows GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.component_rows.groupBy("client_id", "flow_id").agg(F.min("artifact").alias("artifact"), F.count("*").alias("n"), F.date_format(F.max("received_at"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("hunt_list", "SELECT investigation_id, count(DISTINCT client_id) AS clients, count(DISTINCT request_id) AS requests, count(*) AS n FROM component_rows GROUP BY 1")
def _(t: Tables) -> DataFrame:
    # Two levels, so that no set of clients is held.
    per = t.component_rows.groupBy("investigation_id", "client_id", "request_id").agg(F.count("*").alias("c"))
    return per.groupBy("investigation_id").agg(F.count_distinct("client_id").alias("clients"), F.count_distinct("request_id").alias("requests"), F.sum("c").alias("n"))


@query("artifact_list", "SELECT artifact, count(*) AS fields, count(DISTINCT semantic) AS meanings FROM schema_contract GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.schema_contract.groupBy("artifact").agg(F.count("*").alias("fields"), F.count_distinct("semantic").alias("meanings"))


@query("one_row", "SELECT 1 AS n, 'scope' AS name")
def _(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).alias("n"), F.lit("scope").alias("name"))


@query("durations", "SELECT row_id, CASE row_no % 4 WHEN 0 THEN row_no WHEN 1 THEN row_no * 60 WHEN 2 THEN row_no * 3600 ELSE row_no * 86400 END AS seconds FROM component_rows")
def _(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, "smhd")), F.col("row_no") % 4 + 1)
    return t.component_rows.select("row_id", R.duration_seconds(F.concat(F.lit(" "), F.col("row_no").cast("string"), F.upper(unit))).alias("seconds"))


@query("embedded_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    outer = F.to_json(F.struct(F.to_json(F.struct(F.col("props").alias("inner"))).alias("record")))
    return t.events.select("event_id", R.dotted(outer, "record.inner.k").cast("long").alias("k"))


@query("first_alias", "SELECT file_id, line_no, coalesce(json_extract_string(record_json, '$.User'), json_extract_string(record_json, '$.UserName'), json_extract_string(record_json, '$.AccountName')) AS user_name FROM component_files")
def _(t: Tables) -> DataFrame:
    return t.component_files.select("file_id", "line_no", R.first_alias(F.col("record_json"), ["User", "UserName", "AccountName"]).alias("user_name"))


@query("tab_records", "SELECT row_id, artifact, coalesce(user_name, '') AS user_name, coalesce(command_text, '') || chr(9) || 'end' AS rest FROM component_rows")
def _(t: Tables) -> DataFrame:
    line = F.concat_ws("\t", "artifact", F.coalesce("user_name", F.lit("")), F.coalesce("command_text", F.lit("")), F.lit("end"))
    return t.component_rows.select("row_id", *R.tab_fields(line, ["artifact", "user_name", "rest"]))


@query("any_rule", "SELECT row_id FROM component_rows WHERE coalesce(regexp_matches(command_text, '(?i)quiet') AND artifact <> 'Generic.Net.Sockets', false) OR coalesce(regexp_matches(command_text, '(?i)^listen') AND artifact <> 'Linux.Sys.Journal', false)")
def _(t: Tables) -> DataFrame:
    rules = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(a).alias("a")) for p, a in (("(?i)quiet", "Generic.Net.Sockets"), ("(?i)^listen", "Linux.Sys.Journal"))])
    return t.component_rows.where(R.any_rule(rules, lambda r: F.regexp_like(F.col("command_text"), r["p"]) & (F.col("artifact") != r["a"]))).select("row_id")


@query("codecs", "SELECT doc_id, base64(encode(text)) AS coded, sha256(text) AS digest FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.translate(F.base64(F.encode("text", "utf-8")), "\r\n", "").alias("coded"), F.sha2(F.col("text"), 256).alias("digest"))


@query("text_search_context")
def _(t: Tables) -> DataFrame:
    return R.search(t.documents, "doc_id", ["text"], [".exe", "C:\\Windows"], [r"op-v1-[0-9a-f]+"], 20)


@query("spec_mismatches", "WITH b AS (SELECT image_path, min(launch_string) AS l, min(signer) AS s, min(description) AS d FROM autoruns_known_good WHERE batch_no = 1 AND image_path IS NOT NULL GROUP BY 1) SELECT k.record_id, b.image_path IS NOT NULL AS found, CASE WHEN b.image_path IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN k.launch_string IS DISTINCT FROM b.l THEN 'launch_string' END, CASE WHEN k.signer IS DISTINCT FROM b.s THEN 'signer' END, CASE WHEN k.description IS DISTINCT FROM b.d THEN 'description' END], lambda x: x IS NOT NULL), ',') END AS differ FROM autoruns_known_good k LEFT JOIN b ON b.image_path = k.image_path")
def _(t: Tables) -> DataFrame:
    k, fields = t.autoruns_known_good, ["launch_string", "signer", "description"]
    base = k.where("batch_no = 1 and image_path is not null").groupBy("image_path").agg(*[F.min(f).alias(f) for f in fields])
    return R.mismatches(k, base, ["image_path"], fields).select("record_id", "found", F.array_join("differ", ",").alias("differ"))


_KNOWN = "SELECT DISTINCT 'S' || lpad(CAST(row_no AS VARCHAR), 4, '0') || '-R' || row_id AS ref, CAST(row_no AS VARCHAR) AS s, CAST(row_id AS VARCHAR) AS r FROM component_rows WHERE row_no > 0 UNION SELECT 'S' || row_no || '-R0' || row_id, CAST(row_no AS VARCHAR), CAST(row_id AS VARCHAR) FROM component_rows WHERE row_no > 0 AND row_id % 3 = 0"


@query("reference_repair", f"WITH k AS ({_KNOWN}), u AS (SELECT s, r, min(ref) AS ref FROM k GROUP BY 1, 2 HAVING count(DISTINCT ref) = 1) SELECT x.row_id, coalesce(u.ref, 'S' || x.row_no || '-R' || x.row_id) AS repaired FROM component_rows x LEFT JOIN u ON u.s = CAST(x.row_no AS VARCHAR) AND u.r = CAST(x.row_id AS VARCHAR)")
def _(t: Tables) -> DataFrame:
    r = t.component_rows
    known = r.where("row_no > 0")
    refs = known.select(F.concat(F.lit("S"), F.lpad(F.col("row_no").cast("string"), 4, "0"), F.lit("-R"), F.col("row_id").cast("string")).alias("ref"))
    more = known.where("row_id % 3 = 0").select(F.concat(F.lit("S"), F.col("row_no").cast("string"), F.lit("-R0"), F.col("row_id").cast("string")).alias("ref"))
    asked = r.select("row_id", F.concat(F.lit("S"), F.col("row_no").cast("string"), F.lit("-R"), F.col("row_id").cast("string")).alias("ref"))
    return R.repair_references(asked, refs.unionByName(more)).select("row_id", "repaired")


_FAIR = "WITH d AS (SELECT flow_id, sum(coalesce(length(command_text), 0)) AS demand FROM component_rows GROUP BY 1), s AS (SELECT flow_id, demand, (100000 - sum(demand) OVER (ORDER BY demand, flow_id ROWS UNBOUNDED PRECEDING) + demand) // (count(*) OVER () - row_number() OVER (ORDER BY demand, flow_id) + 1) AS own FROM d), l AS (SELECT max(own) AS level FROM s WHERE demand > own), m AS (SELECT flow_id, demand, least(demand, greatest(coalesce((SELECT level FROM l), demand), 0)) AS share FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY share < demand ORDER BY flow_id) AS k FROM m) SELECT flow_id, demand, share + CASE WHEN share < demand AND k <= 100000 - (SELECT sum(share) FROM m) THEN 1 ELSE 0 END AS share FROM k"


@query("fair_shares", _FAIR)
def _(t: Tables) -> DataFrame:
    d = t.component_rows.groupBy("flow_id").agg(F.sum(F.coalesce(F.length("command_text"), F.lit(0))).cast("long").alias("demand"))
    return R.fair_shares(d, "flow_id", "demand", 100_000)


@query("page_with_facets", "WITH m AS (SELECT doc_id, text, created_at FROM documents WHERE artifact = 'Windows.Logs.Logon' AND doc_kind IS NOT NULL), p AS (SELECT doc_id, left(text, 300) AS text, coalesce(length(text) > 300, false) AS clipped, created_at FROM m ORDER BY created_at, doc_id LIMIT 50 OFFSET 5), s AS (SELECT *, row_number() OVER w AS r, sum(coalesce(strlen(text), 0)) OVER w AS b FROM p WINDOW w AS (ORDER BY created_at, doc_id ROWS UNBOUNDED PRECEDING)), k AS (SELECT * FROM s WHERE r = 1 OR b <= 9000) SELECT doc_id, text, clipped, (SELECT count(*) FROM m) AS matching, CASE WHEN 5 + (SELECT count(*) FROM k) < (SELECT count(*) FROM m) THEN 5 + (SELECT count(*) FROM k) END AS next_offset FROM k")
def _(t: Tables) -> DataFrame:
    d = t.documents.where("doc_kind is not null").select("doc_id", "text", "created_at", "artifact")
    return R.page(d, ["created_at", "doc_id"], {"artifact": "Windows.Logs.Logon"}, 5, 50, "text", 9000, 300).drop("created_at", "artifact")


@query("readiness_by_age", "WITH s AS (SELECT artifact, count(DISTINCT client_id) AS done, count(DISTINCT client_id) FILTER (user_name IS NULL) AS failed, date_diff('hour', min(received_at), TIMESTAMP '2025-06-01') AS age FROM component_rows GROUP BY 1), b AS (SELECT count(*) AS base FROM clients) SELECT artifact, CASE WHEN done >= base THEN 'ready' WHEN done / base >= 0.8 THEN 'ready' WHEN age >= 24 AND done / base >= 0.7 THEN 'ready' WHEN age >= 24 AND (done / base < 0.2 OR failed / base >= 0.5) THEN 'stalled' ELSE 'not_ready' END AS readiness FROM s, b")
def _(t: Tables) -> DataFrame:
    per = t.component_rows.groupBy("artifact", "client_id").agg(F.max(F.col("user_name").isNull()).alias("f"), F.min("received_at").alias("at"))
    s = per.groupBy("artifact").agg(F.count("client_id").alias("done"), F.count_if("f").alias("failed"), F.min("at").alias("at"))
    hours = F.timestamp_diff("HOUR", F.date_trunc("hour", F.col("at").cast("timestamp")), F.lit("2025-06-01").cast("timestamp"))
    base = t.clients.agg(F.count("*")).scalar()
    return s.select("artifact", fleet.readiness(F.col("done"), F.col("done"), F.col("failed"), base, hours).alias("readiness"))


@query("coverage_ladder", "SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND terminal THEN 'complete' WHEN NOT terminal THEN 'provisional' WHEN o_orderpriority = '2-HIGH' THEN 'provisional' WHEN o_orderpriority = '3-MEDIUM' THEN 'unknown' ELSE 'incomplete' END AS coverage, sum(greatest(0, o_custkey - 500)) AS accounted FROM (SELECT *, o_orderkey % 5 <> 0 AS terminal FROM orders) GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    target = F.when(F.col("o_orderpriority") == "1-URGENT", "complete").when(F.col("o_orderpriority") == "2-HIGH", "provisional").when(F.col("o_orderpriority") == "3-MEDIUM", "unknown").otherwise("incomplete")
    c = fleet.coverage_ladder(F.col("o_orderstatus") == "F", target, F.col("o_orderkey") % 5 != 0)
    return t.orders.groupBy("o_orderstatus", "o_orderpriority", c.alias("coverage")).agg(F.sum(fleet.accounted(F.col("o_custkey"), F.lit(500))).alias("accounted"))


@query("identity_hosts", "WITH s AS (SELECT DISTINCT user_name FROM component_rows WHERE artifact = 'Linux.Sys.Journal' AND user_name IS NOT NULL), h AS (SELECT r.user_name, r.client_id, count(*) AS c FROM component_rows r JOIN s USING (user_name) GROUP BY 1, 2), a AS (SELECT r.user_name, list_sort(list(DISTINCT r.artifact)) AS l FROM component_rows r JOIN s USING (user_name) GROUP BY 1) SELECT h.user_name, string_agg(client_id || '=' || c, ',' ORDER BY client_id) AS hosts, any_value(array_to_string(l, ',')) AS artifacts, true AS complete FROM h JOIN a USING (user_name) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    r = t.component_rows
    chosen = r.where("artifact = 'Linux.Sys.Journal' and user_name is not null").select("user_name").distinct()
    c = S.selected_context(r, chosen, ["user_name"], "client_id", "artifact")
    pairs = F.transform(F.array_sort(F.map_entries("hosts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return c.select("user_name", F.array_join(pairs, ",").alias("hosts"), F.array_join("categories", ",").alias("artifacts"), "complete")


_CLIENT_FIELDS = ["client_id", "hostname", "fqdn", "os_type", "os_release", "labels", "last_ip", "first_seen"]
_CLIENT_SQL = "SELECT field, array_to_string(list_filter([CASE WHEN field IN ('client_id', 'hostname', 'fqdn') THEN 'provenance_only' END, CASE WHEN field = 'labels' THEN 'array' END, CASE WHEN d <= 1 THEN 'constant' END, CASE WHEN f / n < 0.5 THEN 'very_sparse' END, CASE WHEN d / f >= 0.9 THEN 'mostly_unique_identifier' END], lambda x: x IS NOT NULL), ',') AS codes FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, count(*) FILTER (trim(CAST({f} AS VARCHAR)) <> '') AS f, count(DISTINCT CAST({f} AS VARCHAR)) FILTER (trim(CAST({f} AS VARCHAR)) <> '') AS d FROM clients" for f in _CLIENT_FIELDS) + ")"


@query("client_field_rejections", _CLIENT_SQL)
def _(t: Tables) -> DataFrame:
    p = S.field_profile(t.clients, _CLIENT_FIELDS)
    return S.rejections(p.join(S.length_percentile(t.clients, _CLIENT_FIELDS), "field", "left"), kinds=dict(t.clients.dtypes))


@query("classified_groups", "SELECT artifact, user_name, count(*) AS n, CASE WHEN user_name IS NULL OR user_name = '' THEN 'unnamed' WHEN user_name IN ('SYSTEM', 'NETWORK SERVICE') THEN 'service' ELSE 'person' END AS verdict FROM component_rows GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    def rule(f):
        named = f["user_name"].fillna("")
        return named.map(lambda u: "unnamed" if not u else "service" if u in ("SYSTEM", "NETWORK SERVICE") else "person")

    return R.classified(S.count_stack(t.component_rows, ["artifact", "user_name"]), rule)
