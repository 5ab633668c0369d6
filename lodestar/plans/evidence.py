"""Queries: evidence records, ordered packing and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import evidence as E
from lodestar.operators.numbering import numbered
from lodestar.plans.registry import Tables, query

_DEDUP = "SELECT 'ev-' || left(sha256(coalesce(artifact, '') || chr(1) || coalesce(text, '')), 24) AS evidence_id, count(*) AS occurrences, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM documents GROUP BY 1"


def _content(t: Tables) -> DataFrame:
    d = t.documents.select(F.concat(F.coalesce("artifact", F.lit("")), F.lit("\x01"), F.coalesce("text", F.lit(""))).alias("content"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return E.dedup_evidence(d, ["content"], "at")


@query("evidence_dedup", _DEDUP)
def _(t: Tables) -> DataFrame:
    return _content(t)


@query("evidence_metrics", f"SELECT sum(occurrences) AS input_rows, count(*) AS unique_rows, round(100.0 * (sum(occurrences) - count(*)) / sum(occurrences), 2) AS reduction FROM ({_DEDUP})")
def _(t: Tables) -> DataFrame:
    n = F.sum("occurrences")
    return _content(t).agg(n.alias("input_rows"), F.count("*").alias("unique_rows"), F.round(F.lit(100.0) * (n - F.count("*")) / n, 2).alias("reduction"))


@query("line_ranges", "SELECT flow_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM (SELECT flow_id, min(l) AS a, max(l) AS b FROM (SELECT flow_id, l, l - row_number() OVER (PARTITION BY flow_id ORDER BY l) AS i FROM (SELECT DISTINCT flow_id, row_no AS l FROM component_rows WHERE row_no > 0)) GROUP BY flow_id, i) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return E.line_ranges(t.component_rows, ["flow_id"], "row_no")


@query("numbered_then_filtered", "SELECT row_id, row_ref FROM (SELECT row_id, user_name, row_number() OVER (PARTITION BY flow_id ORDER BY component_name, row_no, row_id, received_at) AS row_ref FROM (SELECT DISTINCT * FROM component_rows)) WHERE user_name = 'SYSTEM'")
def _(t: Tables) -> DataFrame:
    return E.numbered_then_filtered(t.component_rows.distinct(), ["flow_id"], ["component_name", "row_no", "row_id", "received_at"], F.col("user_name") == "SYSTEM").select("row_id", F.col("row_ref").cast("long").alias("row_ref"))


@query("segment_ranges", "SELECT artifact, (n - 1) // 500 AS segment, min(n) AS row_start, max(n) AS row_end, count(*) AS n FROM (SELECT artifact, row_number() OVER (PARTITION BY artifact ORDER BY row_id) AS n FROM component_rows) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    s = E.segments(t.component_rows, ["artifact"], ["row_id"], 500)
    return s.select("artifact", F.col("segment").cast("long").alias("segment"), F.col("row_start").cast("long").alias("row_start"), F.col("row_end").cast("long").alias("row_end"), "n")


@query("bounded_prefix", "SELECT client_id, row_id FROM (SELECT client_id, row_id, sum(w) OVER v AS s, row_number() OVER v AS r FROM (SELECT client_id, row_id, any_value(coalesce(length(command_text), 0)) AS w FROM component_rows GROUP BY 1, 2) WINDOW v AS (PARTITION BY client_id ORDER BY row_id ROWS UNBOUNDED PRECEDING)) WHERE s <= 2000 AND r <= 30")
def _(t: Tables) -> DataFrame:
    once = t.component_rows.groupBy("client_id", "row_id").agg(F.max(F.coalesce(F.length("command_text"), F.lit(0))).alias("w"))
    return E.bounded_prefix(once, ["client_id"], ["row_id"], F.col("w"), 2000, 30).select("client_id", "row_id")


@query("token_chunks", "WITH RECURSIVE x AS (SELECT flow_id, n, w FROM (SELECT flow_id, row_number() OVER (PARTITION BY flow_id ORDER BY row_id) AS n, w FROM (SELECT flow_id, row_id, max(coalesce(length(command_text), 0)) AS w FROM component_rows GROUP BY 1, 2))), c AS (SELECT flow_id, n, w, 0 AS chunk, w AS total FROM x WHERE n = 1 UNION ALL SELECT x.flow_id, x.n, x.w, CASE WHEN c.total + x.w > 400 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.total + x.w > 400 THEN x.w ELSE c.total + x.w END FROM c JOIN x ON x.flow_id = c.flow_id AND x.n = c.n + 1) SELECT flow_id AS source, chunk, min(n) AS row_start, max(n) AS row_end, count(*) AS n, sum(w) AS weight FROM c GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    once = t.component_rows.groupBy("flow_id", "row_id").agg(F.max(F.coalesce(F.length("command_text"), F.lit(0))).alias("w"))
    return E.pack(once, "flow_id", ["row_id"], F.col("w"), 400)


@query("budget_selection", "WITH RECURSIVE x AS (SELECT artifact, row_id, coalesce(length(command_text), 0) AS w, row_number() OVER (PARTITION BY artifact ORDER BY length(command_text) NULLS FIRST, row_id) AS n FROM component_rows), c AS (SELECT artifact, n, row_id, w <= 5000 AS fits, CASE WHEN w <= 5000 THEN w ELSE 0 END AS used FROM x WHERE n = 1 UNION ALL SELECT x.artifact, x.n, x.row_id, c.used + x.w <= 5000, CASE WHEN c.used + x.w <= 5000 THEN c.used + x.w ELSE c.used END FROM c JOIN x ON x.artifact = c.artifact AND x.n = c.n + 1) SELECT artifact AS source, CAST(row_id AS VARCHAR) AS keep FROM c WHERE fits")
def _(t: Tables) -> DataFrame:
    return E.select_in_budget(t.component_rows, "artifact", [F.length("command_text"), F.col("row_id")], F.coalesce(F.length("command_text"), F.lit(0)), 5000, "row_id")


@query("diverse_examples", "SELECT artifact, row_id FROM (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY CASE WHEN h = 1 THEN 0 ELSE 1 END, r) AS k FROM (SELECT artifact, row_id, row_number() OVER (PARTITION BY artifact ORDER BY row_id) AS r, row_number() OVER (PARTITION BY artifact, client_id ORDER BY row_id) AS h, count(*) OVER (PARTITION BY artifact) AS n FROM (SELECT DISTINCT artifact, client_id, row_id FROM component_rows)) WHERE h = 1 OR r IN (1, n // 2 + 1, n)) WHERE k <= 40")
def _(t: Tables) -> DataFrame:
    return E.diverse(t.component_rows.select("artifact", "client_id", "row_id").distinct(), ["artifact"], "client_id", ["row_id"], 40).select("artifact", "row_id")


@query("best_candidate", "SELECT client_id, row_id FROM (SELECT client_id, row_id, row_number() OVER (PARTITION BY client_id ORDER BY CASE WHEN user_name = 'SYSTEM' THEN 0 ELSE 1 END, coalesce(length(command_text), 0) DESC, row_id) AS r FROM (SELECT DISTINCT * FROM component_rows)) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    rank = F.struct(F.when(F.col("user_name") == "SYSTEM", 0).otherwise(1).alias("a"), (-F.coalesce(F.length("command_text"), F.lit(0))).alias("b"), F.col("row_id").alias("c"))
    return t.component_rows.groupBy("client_id").agg(F.min(rank).alias("m")).select("client_id", F.col("m.c").alias("row_id"))


@query("unambiguous_key", "SELECT client_id, min(investigation_id) AS investigation_id FROM component_rows GROUP BY 1 HAVING count(DISTINCT investigation_id) = 1")
def _(t: Tables) -> DataFrame:
    # Least and greatest agree where there is only one; no set is built.
    g = t.component_rows.groupBy("client_id").agg(F.min("investigation_id").alias("investigation_id"), F.max("investigation_id").alias("z"))
    return g.where("investigation_id = z").drop("z")


@query("merge_observations", "SELECT request_id, arg_min(row_id, (received_at, row_id)) AS first_row, arg_max(row_id, (received_at, row_id)) AS last_row, sum(row_no) AS observations FROM component_rows GROUP BY 1")
def _(t: Tables) -> DataFrame:
    k = F.struct("received_at", "row_id")
    return t.component_rows.groupBy("request_id").agg(F.min(k)["row_id"].alias("first_row"), F.max(k)["row_id"].alias("last_row"), F.sum("row_no").alias("observations"))


@query("accounting_check", "WITH e AS (SELECT flow_id, count(*) AS emitted FROM component_rows GROUP BY 1), a AS (SELECT flow_id, count(*) AS accepted FROM component_rows WHERE command_text IS NOT NULL AND trim(command_text) <> '' GROUP BY 1), f AS (SELECT flow_id, count(*) AS failed FROM component_rows WHERE command_text IS NULL OR trim(command_text) = '' GROUP BY 1) SELECT e.flow_id, emitted, coalesce(accepted, 0) AS accepted, coalesce(failed, 0) AS failed, emitted = coalesce(accepted, 0) + coalesce(failed, 0) AS conserved FROM e LEFT JOIN a USING (flow_id) LEFT JOIN f USING (flow_id)")
def _(t: Tables) -> DataFrame:
    ok = F.coalesce(F.trim("command_text") != "", F.lit(False))
    g = t.component_rows.groupBy("flow_id").agg(F.count("*").alias("emitted"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("failed"))
    return g.withColumn("conserved", F.col("emitted") == F.col("accepted") + F.col("failed"))


@query("alias_assign", "WITH old AS (SELECT request_id, row_number() OVER (ORDER BY request_id) AS alias FROM (SELECT DISTINCT request_id FROM component_rows WHERE artifact = 'Linux.Sys.Journal')), new AS (SELECT DISTINCT request_id FROM component_rows WHERE request_id NOT IN (SELECT request_id FROM old)) SELECT request_id, alias FROM old UNION ALL SELECT request_id, (SELECT max(alias) FROM old) + row_number() OVER (ORDER BY request_id) FROM new")
def _(t: Tables) -> DataFrame:
    r = t.component_rows
    old = numbered(r.where("artifact = 'Linux.Sys.Journal'").select("request_id").distinct(), ["request_id"], "alias")
    return E.alias_new(r.select("request_id"), old, "request_id")


@query("running_total", "SELECT row_id, row_number() OVER v AS n, sum(w) OVER v AS n_sum FROM (SELECT row_id, max(coalesce(length(command_text), 0)) AS w FROM component_rows GROUP BY 1) WINDOW v AS (ORDER BY row_id ROWS UNBOUNDED PRECEDING)")
def _(t: Tables) -> DataFrame:
    once = t.component_rows.groupBy("row_id").agg(F.max(F.coalesce(F.length("command_text"), F.lit(0))).alias("w"))
    return numbered(once, ["row_id"], "n", F.col("w")).select("row_id", "n", "n_sum")


@query("retained_groups", "SELECT min_row, command_text, total FROM (SELECT min(row_id) AS min_row, command_text, (SELECT count(DISTINCT command_text) FROM component_rows) - 100 AS total FROM component_rows WHERE command_text IS NOT NULL GROUP BY command_text) ORDER BY min_row LIMIT 100")
def _(t: Tables) -> DataFrame:
    g = t.component_rows.where("command_text is not null").groupBy("command_text").agg(F.min("row_id").alias("min_row"))
    omitted = g.agg((F.count("*") - 100).alias("total")).scalar()
    return g.orderBy("min_row").limit(100).select("min_row", "command_text", omitted.alias("total"))


@query("incremental_reuse", "WITH b AS (SELECT component_name, md5(string_agg(DISTINCT flow_id, ',' ORDER BY flow_id)) AS f FROM component_rows WHERE row_no < 5 GROUP BY 1), a AS (SELECT component_name, md5(string_agg(DISTINCT flow_id, ',' ORDER BY flow_id)) AS f FROM component_rows GROUP BY 1) SELECT a.component_name, CASE WHEN b.f IS NULL THEN 'pending' WHEN a.f = b.f THEN 'reused' ELSE 'changed' END AS status FROM a LEFT JOIN b USING (component_name)")
def _(t: Tables) -> DataFrame:
    def prints(d: DataFrame, name: str) -> DataFrame:
        flows = d.select("component_name", "flow_id").distinct().groupBy("component_name")
        return flows.agg(F.md5(F.array_join(F.array_sort(F.collect_list("flow_id")), ",")).alias(name))

    j = prints(t.component_rows, "now").join(prints(t.component_rows.where("row_no < 5"), "was"), "component_name", "left")
    return j.select("component_name", F.when(F.col("was").isNull(), "pending").when(F.col("was") == F.col("now"), "reused").otherwise("changed").alias("status"))


@query("overlap_cursor", "SELECT row_id FROM component_rows WHERE received_at IS NULL OR (received_at > TIMESTAMP '2025-06-01' - INTERVAL 5 MINUTE AND received_at <= TIMESTAMP '2025-09-01')")
def _(t: Tables) -> DataFrame:
    low = F.lit("2025-06-01").cast("timestamp_ntz") - F.expr("interval 5 minutes")
    at = F.col("received_at").cast("timestamp_ntz")
    return t.component_rows.where(at.isNull() | ((at > low) & (at <= F.lit("2025-09-01").cast("timestamp_ntz")))).select("row_id")


@query("schema_profile", "SELECT artifact, count(*) AS n, count(user_name) AS named, count(DISTINCT component_name) AS components FROM (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY client_id, row_id, component_name) AS r FROM (SELECT DISTINCT * FROM component_rows)) WHERE r <= 20 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("artifact").orderBy("client_id", "row_id", "component_name")
    s = t.component_rows.distinct().withColumn("r", F.row_number().over(w)).where("r <= 20")
    return s.groupBy("artifact").agg(F.count("*").alias("n"), F.count("user_name").alias("named"), F.count_distinct("component_name").alias("components"))
