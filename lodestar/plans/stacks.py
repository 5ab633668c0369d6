"""Queries: stacks, known-good subtraction and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import evidence as E
from lodestar.operators import golden as G
from lodestar.operators import stacks as S
from lodestar.plans.registry import Tables, query
from lodestar.plans.scans import _IDENTITY


@query("exact_count", "SELECT count(*) AS n FROM component_rows")
def _(t: Tables) -> DataFrame:
    return t.component_rows.agg(F.count("*").alias("n"))


@query("stack_topn", "SELECT artifact, user_name, count(*) AS n FROM component_rows GROUP BY 1, 2 ORDER BY n DESC, artifact, user_name NULLS FIRST LIMIT 20")
def _(t: Tables) -> DataFrame:
    return S.count_stack(t.component_rows, ["artifact", "user_name"]).orderBy(F.desc("n"), "artifact", F.asc_nulls_first("user_name")).limit(20)


@query("inventory_stack", "SELECT r.client_id, c.fqdn, c.hostname, count(*) AS n FROM component_rows r JOIN clients c USING (client_id) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    # Counted per client first: the join sees one row per client.
    n = S.count_stack(t.component_rows, ["client_id"])
    return n.join(t.clients.select("client_id", "fqdn", "hostname"), "client_id")


@query("prevalence_stack", "SELECT event_type, count(*) AS host_count, sum(c) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 2) AS host_percent FROM (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    hosts = t.customer.agg(F.count("*").alias("hosts")).scalar()
    return S.prevalence(t.events, ["event_type"], "user_id").withColumn("host_percent", S.host_percent(F.col("host_count"), hosts))


@query("impacted_hosts", "SELECT r.artifact, r.client_id, c.fqdn, count(*) AS n FROM component_rows r JOIN clients c USING (client_id) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    n = S.count_stack(t.component_rows, ["artifact", "client_id"])
    return n.join(t.clients.select("client_id", "fqdn"), "client_id")


@query("residual_stack", f"SELECT image, launch, sig, count(*) AS total, min(batch_no) AS category FROM (SELECT translate(coalesce(image_path, ''), '{text.UPPER}', '{text.LOWER}') AS image, translate(coalesce(launch_string, ''), '{text.UPPER}', '{text.LOWER}') AS launch, coalesce(signer, '') AS sig, batch_no FROM autoruns_known_good) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    k = t.autoruns_known_good
    low = k.select(text.ascii_lower(F.coalesce("image_path", F.lit(""))).alias("image"), text.ascii_lower(F.coalesce("launch_string", F.lit(""))).alias("launch"), F.coalesce("signer", F.lit("")).alias("sig"), "batch_no")
    return low.groupBy("image", "launch", "sig").agg(F.count("*").alias("total"), F.min("batch_no").alias("category"))


_RULES = [("(?:connect|listen) .*", ".*"), (".*\\.exe\" /quiet.*", ".*"), (".*", "SYSTEM|NETWORK SERVICE")]
_RULES_SQL = "(VALUES ('(?:connect|listen) .*', '.*'), ('.*\\.exe\" /quiet.*', '.*'), ('.*', 'SYSTEM|NETWORK SERVICE')) r(command_re, user_re)"
_GROUPS = "SELECT artifact, command_text, user_name, count(*) AS total_rows, (list_sort(list(DISTINCT client_id)))[1:3] AS hosts FROM component_rows GROUP BY 1, 2, 3"
_UNMATCHED = f"NOT EXISTS (SELECT 1 FROM {_RULES_SQL} WHERE regexp_full_match(coalesce(g.command_text, ''), '(?is)' || r.command_re) AND regexp_full_match(coalesce(g.user_name, ''), '(?is)' || r.user_re))"


def _accounted(t: Tables) -> tuple[DataFrame, DataFrame]:
    rules = t.spark.createDataFrame(_RULES, "command_re string, user_re string")
    return S.accounted_stack(t.component_rows, ["artifact", "command_text", "user_name"], "client_id", rules, {"command_text": "command_re", "user_name": "user_re"}, 4, 3)


@query("accounted_stack", f"SELECT artifact, command_text, user_name, total_rows, array_to_string(hosts, ',') AS example_hosts FROM ({_GROUPS}) g WHERE total_rows <= 4 AND {_UNMATCHED}")
def _(t: Tables) -> DataFrame:
    return _accounted(t)[0].withColumn("example_hosts", F.array_join("example_hosts", ","))


@query("accounted_summary", f"WITH g AS ({_GROUPS}), r AS (SELECT * FROM g WHERE total_rows <= 4 AND {_UNMATCHED}), a AS (SELECT sum(total_rows) AS er, count(*) AS eg, coalesce(sum(total_rows) FILTER (total_rows > 4), 0) AS xr, count(*) FILTER (total_rows > 4) AS xg FROM g), b AS (SELECT coalesce(sum(total_rows), 0) AS rr, count(*) AS rg FROM r) SELECT er AS eligible_rows, eg AS eligible_groups, xr AS excluded_rows, xg AS excluded_groups, rr AS residual_rows, rg AS residual_groups, er - xr - rr AS matched_rows, eg - xg - rg AS matched_groups FROM a, b")
def _(t: Tables) -> DataFrame:
    return _accounted(t)[1]


_VIEWS = (S.StackSpec("by_user", ["user_name"], "client_id", "received_at", 50), S.StackSpec("by_artifact_user", ["artifact", "user_name"], "client_id", "received_at", 50))


def _view_sql(v: S.StackSpec) -> str:
    key = " || ' | ' || ".join(v.dims)
    filled = " AND ".join(f"{d} IS NOT NULL AND {d} <> ''" for d in v.dims)
    return f"(SELECT '{v.name}' AS \"view\", {key} AS \"key\", count(*) AS n, count(DISTINCT client_id) AS hosts, strftime(min(received_at), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(received_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM component_rows WHERE {filled} GROUP BY ALL ORDER BY n DESC, \"key\" LIMIT {v.max_groups})"


def _total_sql(v: S.StackSpec) -> str:
    filled = "(" + " AND ".join(f"{d} IS NOT NULL AND {d} <> ''" for d in v.dims) + ")"
    return f"SELECT '{v.name}' AS \"view\", sum(c) AS rows_seen, sum(c) FILTER (f) AS rows_stacked, sum(c) FILTER (NOT f) AS rows_unstacked, count(*) FILTER (f) AS group_count, count(*) FILTER (f) > {v.max_groups} AS truncated FROM (SELECT {', '.join(v.dims)}, coalesce({filled}, false) AS f, count(*) AS c FROM component_rows GROUP BY ALL)"


@query("profile_stack_views", " UNION ALL ".join(map(_view_sql, _VIEWS)))
def _(t: Tables) -> DataFrame:
    r = t.component_rows.withColumn("received_at", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss"))
    return S.stack_view(r, _VIEWS[0]).unionByName(S.stack_view(r, _VIEWS[1]))


@query("profile_stack_totals", " UNION ALL ".join(map(_total_sql, _VIEWS)))
def _(t: Tables) -> DataFrame:
    return S.stack_totals(t.component_rows, _VIEWS[0]).unionByName(S.stack_totals(t.component_rows, _VIEWS[1]))


@query("detection_discovery", "SELECT coalesce(user_name, '') AS detection, count(*) AS n, sum(coalesce(length(command_text), 0)) AS chars, max(coalesce(length(command_text), 0)) AS longest, count(*) FILTER (length(command_text) > 60) AS large_rows FROM component_rows GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return S.discovery(t.component_rows, "user_name", "command_text", 60)


_CENSUS = "SELECT artifact, count(*) AS group_count, sum(c) AS row_count, count(*) FILTER (c = 1) AS singletons, max(c) AS largest FROM (SELECT artifact, command_text, count(*) AS c FROM component_rows GROUP BY 1, 2) GROUP BY 1"


@query("stack_census", _CENSUS)
def _(t: Tables) -> DataFrame:
    return S.census(t.component_rows, ["artifact"], "command_text")


@query("stack_decision", f"SELECT *, row_count - group_count AS saved, CASE WHEN row_count >= 1000 AND ceil(row_count / 100) >= 10 AND row_count - group_count >= 100 AND (row_count - group_count) / row_count >= 0.05 THEN 'stack' ELSE 'direct' END AS route FROM ({_CENSUS})")
def _(t: Tables) -> DataFrame:
    return S.stack_or_direct(S.census(t.component_rows, ["artifact"], "command_text"))


@query("payload_groups", "SELECT command_text, count(*) AS n, strftime(min(received_at), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(received_at), '%Y-%m-%d %H:%M:%S') AS last_time FROM component_rows GROUP BY 1")
def _(t: Tables) -> DataFrame:
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t.component_rows.groupBy("command_text").agg(F.count("*").alias("n"), f(F.min("received_at")).alias("first_time"), f(F.max("received_at")).alias("last_time"))


@query("distinct_values", "SELECT DISTINCT category FROM golden_rules WHERE category IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.golden_rules.where("category is not null").select("category").distinct()


@query("representative_row", "SELECT artifact, user_name, row_id, command_text FROM (SELECT *, row_number() OVER (PARTITION BY artifact, user_name ORDER BY row_id) AS r FROM component_rows) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    # The least struct instead of a window: partial aggregation keeps hot groups small.
    return t.component_rows.groupBy("artifact", "user_name").agg(F.min(F.struct("row_id", "command_text")).alias("m")).select("artifact", "user_name", "m.row_id", "m.command_text")


@query("signature_reduction", "WITH g AS (SELECT artifact, user_name, count(*) AS c FROM component_rows GROUP BY 1, 2), w AS (SELECT artifact, sum(c) AS row_count, count(*) AS signatures FROM g GROUP BY 1), l AS (SELECT *, row_number() OVER v AS r, sum(c) OVER (v ROWS UNBOUNDED PRECEDING) AS run FROM g WINDOW v AS (PARTITION BY artifact ORDER BY c DESC, user_name NULLS FIRST)), j AS (SELECT l.*, w.row_count, w.signatures FROM l JOIN w USING (artifact) WHERE r <= 5), a AS (SELECT artifact, any_value(row_count) AS row_count, any_value(signatures) AS signatures, max(run) / any_value(row_count) AS p, min(r) FILTER (run / row_count >= 0.8) AS e, max(r) AS most FROM j GROUP BY 1), b AS (SELECT *, CASE WHEN p >= 0.8 THEN e ELSE most END AS \"leading\" FROM a) SELECT b.artifact, b.row_count, b.signatures, b.\"leading\", j.run AS leading_rows, round(j.run / b.row_count, 4) AS coverage, CASE WHEN p >= 0.8 THEN 'repetitive' WHEN p >= 0.3 THEN 'mixed' ELSE 'unique' END AS \"class\" FROM b JOIN j ON j.artifact = b.artifact AND j.r = b.\"leading\"")
def _(t: Tables) -> DataFrame:
    return S.signatures(t.component_rows, "artifact", ["user_name"])


_FIELDS = ["artifact", "user_name", "component_name", "command_text", "when_text"]
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS v FROM component_rows" for f in _FIELDS)
_PROFILE = f"SELECT field, count(*) AS row_count, count(*) FILTER (v IS NULL) AS null_count, count(*) FILTER (trim(v) = '') AS empty_count, count(*) FILTER (trim(v) <> '') AS filled_count, count(DISTINCT v) FILTER (trim(v) <> '') AS distinct_count, min(length(v)) FILTER (trim(v) <> '') AS min_length, max(length(v)) FILTER (trim(v) <> '') AS max_length, round(count(*) FILTER (trim(v) <> '') / count(*), 6) AS filled_ratio, round(count(DISTINCT v) FILTER (trim(v) <> '') / count(*) FILTER (trim(v) <> ''), 6) AS distinct_ratio, array_to_string((list_sort(list(DISTINCT v) FILTER (trim(v) <> '')))[1:3], '|') AS examples FROM ({_LONG}) GROUP BY 1"


@query("field_profile", f"SELECT p.*, q.p_length FROM ({_PROFILE}) p LEFT JOIN (SELECT field, quantile_disc(length(v), 0.95) AS p_length FROM ({_LONG}) WHERE trim(v) <> '' GROUP BY 1) q USING (field)")
def _(t: Tables) -> DataFrame:
    p = S.field_profile(t.component_rows, _FIELDS).withColumn("examples", F.array_join("examples", "|"))
    return p.join(S.length_percentile(t.component_rows, _FIELDS), "field", "left")


@query("field_rejections", f"SELECT field, array_to_string(list_filter([CASE WHEN regexp_matches(field, '(?i)(?:^|_)(?:time|date)(?:$|_)') THEN 'timestamp_field' END, CASE WHEN field = 'artifact' THEN 'provenance_only' END, CASE WHEN distinct_count <= 1 THEN 'constant' END, CASE WHEN filled_ratio < 0.5 THEN 'very_sparse' END, CASE WHEN q.p_length > 500 THEN 'excessive_length' END, CASE WHEN distinct_ratio >= 0.9 THEN 'mostly_unique_identifier' END], lambda x: x IS NOT NULL), ',') AS codes FROM ({_PROFILE}) LEFT JOIN (SELECT field, quantile_disc(length(v), 0.95) AS p_length FROM ({_LONG}) WHERE trim(v) <> '' GROUP BY 1) q USING (field)")
def _(t: Tables) -> DataFrame:
    p = S.field_profile(t.component_rows, _FIELDS).join(S.length_percentile(t.component_rows, _FIELDS), "field", "left")
    return S.rejections(p, kinds=dict(t.component_rows.dtypes))


_PATTERN_RULES = [("(?:c|d):\\\\.*", ".*--hidden.*", "(?:Naniro|Tipake).*"), (".*\\.sys", ".*", ".*")]
_PATTERN_SQL = "(VALUES ('(?:c|d):\\\\.*', '.*--hidden.*', '(?:Naniro|Tipake).*'), ('.*\\.sys', '.*', '.*')) r(i, l, s)"


def _pattern_rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_PATTERN_RULES, "i string, l string, s string").where(G.usable_rule(F.col("i")))


@query("known_good_filter", f"WITH k AS (SELECT *, {_IDENTITY} AS hk FROM autoruns_known_good) SELECT record_id FROM k WHERE (trim(coalesce(image_path, '')) <> '' OR trim(coalesce(launch_string, '')) <> '' OR trim(coalesce(signer, '')) <> '') AND hk NOT IN (SELECT hk FROM k WHERE batch_no = 1) AND NOT EXISTS (SELECT 1 FROM {_PATTERN_SQL} WHERE regexp_full_match(coalesce(image_path, ''), '(?is)' || i) AND regexp_full_match(coalesce(launch_string, ''), '(?is)' || l) AND regexp_full_match(coalesce(signer, ''), '(?is)' || s))")
def _(t: Tables) -> DataFrame:
    k, keys = t.autoruns_known_good, ["image_path", "launch_string", "signer"]
    return G.known_good_filter(k, keys, k.where("batch_no = 1"), _pattern_rules(t), dict(zip(keys, "ils", strict=True))).select("record_id")


@query("regex_rule_anti", f"SELECT DISTINCT image_path, launch_string, signer FROM autoruns_known_good WHERE NOT EXISTS (SELECT 1 FROM {_PATTERN_SQL} WHERE regexp_full_match(coalesce(image_path, ''), '(?is)' || i) AND regexp_full_match(coalesce(launch_string, ''), '(?is)' || l) AND regexp_full_match(coalesce(signer, ''), '(?is)' || s))")
def _(t: Tables) -> DataFrame:
    keys = ["image_path", "launch_string", "signer"]
    return G.subtract_patterns(t.autoruns_known_good.select(*keys).distinct(), _pattern_rules(t), dict(zip(keys, "ils", strict=True)))


@query("selected_semi", f"WITH k AS (SELECT *, {_IDENTITY} AS hk FROM autoruns_known_good) SELECT record_id FROM k WHERE hk IN (SELECT hk FROM k WHERE batch_no = 2)")
def _(t: Tables) -> DataFrame:
    k = t.autoruns_known_good
    return G.select_identities(k, k.where("batch_no = 2"), ["image_path", "launch_string", "signer"]).select("record_id")


@query("stack_context", "SELECT row_id, client_id, command_text FROM component_rows WHERE command_text IN (SELECT command_text FROM component_rows GROUP BY 1 HAVING count(*) = 2)")
def _(t: Tables) -> DataFrame:
    r = t.component_rows
    twice = r.groupBy("command_text").count().where("count = 2").select("command_text")
    return r.join(twice, "command_text", "left_semi").select("row_id", "client_id", "command_text")


@query("reconcile_status", "WITH r AS (SELECT image_path, min(description) AS description FROM autoruns_known_good WHERE batch_no > 10 GROUP BY 1), b AS (SELECT image_path, min(description) AS d FROM autoruns_known_good WHERE batch_no <= 10 AND image_path IS NOT NULL GROUP BY 1) SELECT r.image_path, r.description, CASE WHEN b.image_path IS NULL THEN 'new_identity' WHEN r.description IS NOT DISTINCT FROM b.d THEN 'already_applied' ELSE 'description_update' END AS status FROM r LEFT JOIN b ON b.image_path = r.image_path")
def _(t: Tables) -> DataFrame:
    k = t.autoruns_known_good
    return G.reconcile(k.where("batch_no > 10"), k.where("batch_no <= 10"), "image_path", "description")


@query("rule_diff", "WITH o AS (SELECT category, image_path, min(notes) AS n, 1 AS o FROM golden_rules WHERE loaded_at < TIMESTAMP '2024-11-15' GROUP BY 1, 2), w AS (SELECT category, image_path, min(notes) AS n, 1 AS w FROM golden_rules GROUP BY 1, 2) SELECT coalesce(o.category, w.category) AS category, coalesce(o.image_path, w.image_path) AS image_path, CASE WHEN o.o IS NULL THEN 'added' WHEN w.w IS NULL THEN 'removed' WHEN o.n IS NOT DISTINCT FROM w.n THEN 'unchanged' ELSE 'updated' END AS change FROM o FULL JOIN w ON o.category IS NOT DISTINCT FROM w.category AND o.image_path IS NOT DISTINCT FROM w.image_path")
def _(t: Tables) -> DataFrame:
    g = t.golden_rules
    earlier = g.where(F.col("loaded_at").cast("timestamp_ntz") < F.lit("2024-11-15").cast("timestamp_ntz"))
    return G.diff(earlier, g, ["category", "image_path"], "notes")


@query("merge_tables", "SELECT name, min(kind) AS kind, count(DISTINCT coalesce(kind, '')) AS payloads FROM (SELECT alias_name AS name, semantic AS kind FROM schema_contract UNION ALL SELECT DISTINCT artifact, 'artifact' FROM component_rows) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    a = t.schema_contract.select(F.col("alias_name").alias("name"), F.col("semantic").alias("kind"))
    b = t.component_rows.select(F.col("artifact").alias("name")).distinct().withColumn("kind", F.lit("artifact"))
    return G.merge([a, b], ["name"], "kind")


@query("rule_upsert", "WITH o AS (SELECT image_path, min(description) AS description, min(modified_time) AS modified_time FROM autoruns_known_good WHERE batch_no <= 10 AND image_path IS NOT NULL GROUP BY 1), n AS (SELECT image_path, min(description) AS description, min(modified_time) AS modified_time FROM autoruns_known_good WHERE batch_no > 10 AND image_path IS NOT NULL GROUP BY 1) SELECT coalesce(o.image_path, n.image_path) AS image_path, CASE WHEN n.image_path IS NULL THEN o.description ELSE n.description END AS description, CASE WHEN n.image_path IS NULL OR (o.image_path IS NOT NULL AND o.description IS NOT DISTINCT FROM n.description) THEN o.modified_time ELSE n.modified_time END AS modified_time FROM o FULL JOIN n ON o.image_path = n.image_path")
def _(t: Tables) -> DataFrame:
    k = t.autoruns_known_good.where("image_path is not null")
    one = lambda d: d.groupBy("image_path").agg(F.min("description").alias("description"), F.min("modified_time").alias("modified_time"))
    return G.upsert(one(k.where("batch_no <= 10")), one(k.where("batch_no > 10")), ["image_path"], "description", "modified_time")


@query("delete_by_key", "SELECT record_id FROM autoruns_known_good k WHERE NOT EXISTS (SELECT 1 FROM autoruns_known_good g WHERE g.batch_no = 3 AND g.signer IS NOT DISTINCT FROM k.signer AND g.image_path IS NOT DISTINCT FROM k.image_path)")
def _(t: Tables) -> DataFrame:
    k = t.autoruns_known_good
    return G.delete_by_key(k, k.where("batch_no = 3"), ["signer", "image_path"]).select("record_id")


@query("best_description", "SELECT image_path, arg_min(coalesce(description, ''), (CASE WHEN trim(coalesce(description, '')) = '' THEN 1 ELSE 0 END, -length(coalesce(description, '')), coalesce(description, ''))) AS description FROM autoruns_known_good GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return G.best_text(t.autoruns_known_good, ["image_path"], "description")


@query("family_variants", "SELECT signer, count(*) AS variants, sum(n) AS row_count, count(*) = 1 AS single FROM (SELECT signer, image_path, count(*) AS n FROM autoruns_known_good GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    v = S.count_stack(t.autoruns_known_good, ["signer", "image_path"])
    return v.groupBy("signer").agg(F.count("*").alias("variants"), F.sum("n").alias("row_count"), (F.count("*") == 1).alias("single"))


@query("identity_context", "WITH s AS (SELECT DISTINCT user_name FROM component_rows WHERE artifact = 'Linux.Sys.Journal' AND user_name IS NOT NULL), h AS (SELECT r.user_name, r.client_id, count(*) AS c FROM component_rows r JOIN s USING (user_name) GROUP BY 1, 2) SELECT user_name, sum(c) AS n, count(*) AS hosts, max(c) AS most_on_a_host FROM h GROUP BY 1")
def _(t: Tables) -> DataFrame:
    r = t.component_rows
    chosen = r.where("artifact = 'Linux.Sys.Journal' and user_name is not null").select("user_name").distinct()
    per_host = r.join(chosen, "user_name", "left_semi").groupBy("user_name", "client_id").agg(F.count("*").alias("c"))
    return per_host.groupBy("user_name").agg(F.sum("c").alias("n"), F.count("*").alias("hosts"), F.max("c").alias("most_on_a_host"))


@query("grouped_context", "SELECT artifact, user_name, count(*) AS n, count(DISTINCT client_id) AS hosts, array_to_string((list_sort(list(DISTINCT component_name)))[1:5], ',') AS components FROM component_rows GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    r = t.component_rows
    a = r.groupBy("artifact", "user_name", "client_id").agg(F.count("*").alias("c")).groupBy("artifact", "user_name").agg(F.sum("c").alias("n"), F.count("client_id").alias("hosts"))
    b = S.bounded_sample(r, ["artifact", "user_name"], "component_name", 5)
    j = a.join(b.select(F.col("artifact").alias("a"), F.col("user_name").alias("u"), "sample"), F.col("artifact").eqNullSafe(F.col("a")) & F.col("user_name").eqNullSafe(F.col("u")))
    return j.select("artifact", "user_name", "n", "hosts", F.array_join("sample", ",").alias("components"))


@query("latest_per_key", "SELECT client_id, row_id, artifact FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY received_at DESC, row_id DESC) AS r FROM component_rows) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    return t.component_rows.groupBy("client_id").agg(F.max(F.struct("received_at", "row_id", "artifact")).alias("m")).select("client_id", "m.row_id", "m.artifact")


@query("dedup_keep_first", "SELECT client_id, flow_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY client_id, flow_id ORDER BY row_id) AS r FROM component_rows WHERE client_id <> '' AND flow_id <> '') WHERE r = 1")
def _(t: Tables) -> DataFrame:
    filled = t.component_rows.where("client_id <> '' and flow_id <> ''")
    return E.first_by(filled, ["client_id", "flow_id"], [F.col("row_id")]).select("client_id", "flow_id", "row_id").distinct()
