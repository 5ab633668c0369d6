"""Queries: scans, filters, joins of rows with lists, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import hashing, text, times
from lodestar.operators import predicates as P
from lodestar.plans.registry import Tables, query

@query("scan_projection", "SELECT client_id, artifact, flow_id, component_name, row_no FROM component_rows WHERE artifact = 'Windows.System.TaskList' AND row_no > 3")
def _(t: Tables) -> DataFrame:
    return t.component_rows.where("artifact = 'Windows.System.TaskList' and row_no > 3").select("client_id", "artifact", "flow_id", "component_name", "row_no")


@query("json_member_projection", "SELECT event_id, event_type AS detection, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("event_type").alias("detection"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("conditional_projection", "SELECT row_id, CASE WHEN user_name IS NULL OR user_name = '' THEN 'none' ELSE user_name END AS who, CASE WHEN row_no % 2 = 0 THEN 'even' ELSE 'odd' END AS side FROM component_rows")
def _(t: Tables) -> DataFrame:
    return t.component_rows.select("row_id", F.when(P.dimension_equals(F.col("user_name"), ""), "none").otherwise(F.col("user_name")).alias("who"), F.when(F.col("row_no") % 2 == 0, "even").otherwise("odd").alias("side"))


@query("category_export", "SELECT rule_id, category, image_path FROM golden_rules WHERE category = 'Services' AND regexp_matches(image_path, '.')")
def _(t: Tables) -> DataFrame:
    return t.golden_rules.where((F.col("category") == "Services") & F.col("image_path").rlike(".")).select("rule_id", "category", "image_path")


@query("regex_include_exclude", "SELECT row_id, command_text FROM component_rows WHERE regexp_matches(command_text, '(?i)connect') AND NOT regexp_matches(command_text, '(?i):443')")
def _(t: Tables) -> DataFrame:
    return t.component_rows.where(F.col("command_text").rlike("(?i)connect") & ~F.col("command_text").rlike("(?i):443")).select("row_id", "command_text")


@query("semi_in_list", "SELECT client_id, hostname, os_type FROM clients WHERE os_type IN ('linux', 'darwin')")
def _(t: Tables) -> DataFrame:
    return t.clients.where(F.col("os_type").isin("linux", "darwin")).select("client_id", "hostname", "os_type")


@query("residual_filter", "SELECT event_id FROM events WHERE NOT coalesce(event_type = 'view' AND value < 50, false) OR coalesce(value > 45, false)")
def _(t: Tables) -> DataFrame:
    return t.events.where(P.residual((F.col("event_type") == "view") & (F.col("value") < 50), F.col("value") > 45)).select("event_id")


@query("exclude_reviewed", "SELECT row_id FROM component_rows r WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT artifact, user_name FROM component_rows WHERE user_name = 'SYSTEM' OR user_name IS NULL) x WHERE x.artifact IS NOT DISTINCT FROM r.artifact AND x.user_name IS NOT DISTINCT FROM r.user_name)")
def _(t: Tables) -> DataFrame:
    done = t.component_rows.where("user_name = 'SYSTEM' or user_name is null")
    return P.exclude_keys(t.component_rows, done, ["artifact", "user_name"]).select("row_id")


@query("stack_drilldown", "SELECT row_id FROM component_rows WHERE artifact = 'Generic.Net.Sockets' AND (user_name IS NULL OR user_name = '')")
def _(t: Tables) -> DataFrame:
    return t.component_rows.where(P.dimension_equals(F.col("artifact"), "Generic.Net.Sockets") & P.dimension_equals(F.col("user_name"), "")).select("row_id")


@query("time_scope", "SELECT client_id FROM clients WHERE (first_seen > TIMESTAMP '2024-01-01' AND first_seen < TIMESTAMP '2024-06-01') OR (last_seen > TIMESTAMP '2024-01-01' AND last_seen < TIMESTAMP '2024-06-01')")
def _(t: Tables) -> DataFrame:
    a, b = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-06-01").cast("timestamp_ntz")
    return t.clients.where(P.open_interval([F.col("first_seen").cast("timestamp_ntz"), F.col("last_seen").cast("timestamp_ntz")], a, b)).select("client_id")


@query("label_filter", "SELECT client_id, len(labels) AS n_labels FROM clients WHERE list_contains(coalesce(labels, []), 'lab') AND NOT list_contains(coalesce(labels, []), 'vip')")
def _(t: Tables) -> DataFrame:
    return t.clients.where(P.has_labels(F.col("labels"), ["lab"], ["vip"])).select("client_id", F.size("labels").cast("long").alias("n_labels"))


@query("client_search", "SELECT client_id, hostname FROM clients WHERE regexp_matches(hostname, '(?i)^ws-.*[0-7]$') AND regexp_matches(os_type, '(?i)^(windows|linux)$')")
def _(t: Tables) -> DataFrame:
    return t.clients.where(F.col("hostname").rlike("(?i)^ws-.*[0-7]$") & F.col("os_type").rlike("(?i)^(windows|linux)$")).select("client_id", "hostname")


@query("deep_search", "SELECT row_id FROM component_rows WHERE contains(lower(concat_ws(chr(31), client_id, investigation_id, request_id, artifact, flow_id, component_name, when_text, command_text, user_name)), '/quiet /log')")
def _(t: Tables) -> DataFrame:
    r = t.component_rows.drop("received_at", "row_no")
    return r.where(P.anywhere(r, "/QUIET /log")).select("row_id")


@query("deep_search_path", "SELECT row_id FROM component_rows WHERE contains(lower(concat_ws(chr(31), client_id, investigation_id, request_id, artifact, flow_id, component_name, when_text, command_text, user_name)), '.exe\" /')")
def _(t: Tables) -> DataFrame:
    r = t.component_rows.drop("received_at", "row_no")
    return r.where(P.anywhere(r, '.EXE" /')).select("row_id")


@query("deep_search_folder", "SELECT record_id FROM autoruns_known_good WHERE contains(lower(concat_ws(chr(31), hash_key, image_path, launch_string, signer, description, modified_time, origin_zone)), 'c:\\windows\\')")
def _(t: Tables) -> DataFrame:
    k = t.autoruns_known_good.drop("arrived_at", "batch_no")
    return k.where(P.anywhere(k, "C:\\Windows\\")).select("record_id")


_MATCHES = "SELECT doc_id, 'text' AS field, p.pattern, u.nth, u.match FROM documents, (VALUES ('exe', '[A-Za-z]+\\.exe'), ('op', 'op-v1-[0-9a-f]+')) p(pattern, re), LATERAL (SELECT unnest(regexp_extract_all(text, p.re)) AS match, generate_subscripts(regexp_extract_all(text, p.re), 1) AS nth) u"


def _found(t: Tables) -> DataFrame:
    return P.text_matches(t.documents, "doc_id", ["text"], {"exe": r"[A-Za-z]+\.exe", "op": "op-v1-[0-9a-f]+"})


@query("text_search_matches", _MATCHES)
def _(t: Tables) -> DataFrame:
    return _found(t).withColumn("nth", F.col("nth").cast("long"))


@query("text_search_counts", f"SELECT pattern, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_MATCHES}) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _found(t).groupBy("pattern", "doc_id").count().groupBy("pattern").agg(F.sum("count").alias("n"), F.count("*").alias("docs"))


@query("eligible_rows", "SELECT record_id FROM autoruns_known_good WHERE (coalesce(image_path, '') <> '' OR coalesce(launch_string, '') <> '') AND NOT coalesce(regexp_matches(image_path, '(?i)^File not found:'), false)")
def _(t: Tables) -> DataFrame:
    k = t.autoruns_known_good
    some = ~P.dimension_equals(k.image_path, "") | ~P.dimension_equals(k.launch_string, "")
    return k.where(some & ~F.coalesce(k.image_path.rlike("(?i)^File not found:"), F.lit(False))).select("record_id")


@query("watchlist_match", r"SELECT record_id, image_path FROM autoruns_known_good WHERE regexp_matches(image_path, '(?i)(?:^|[\\/])(?:certutil\.exe|mshta\.exe|regsvr32\.exe|rundll32\.exe|svchost\.exe|wscript\.exe)$') OR regexp_matches(image_path, '(?i)(?:vo|za|ri)\.exe$')")
def _(t: Tables) -> DataFrame:
    names = ["certutil.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe", "svchost.exe", "wscript.exe"]
    c = F.col("image_path")
    return t.autoruns_known_good.where(c.rlike(text.name_list_pattern(names)) | c.rlike(r"(?i)(?:vo|za|ri)\.exe$")).select("record_id", "image_path")


@query("reason_codes", "SELECT record_id, array_to_string(list_filter([CASE WHEN signer IS NULL OR trim(signer) = '' THEN 'unsigned' END, CASE WHEN regexp_matches(image_path, '(?i)\\\\users\\\\') THEN 'user_folder' END, CASE WHEN regexp_matches(launch_string, '(?i)--hidden') THEN 'hidden' END], lambda x: x IS NOT NULL), ',') AS reasons FROM autoruns_known_good")
def _(t: Tables) -> DataFrame:
    r = P.reasons({"unsigned": F.col("signer").isNull() | (F.trim("signer") == ""), "user_folder": F.col("image_path").rlike(r"(?i)\\users\\"), "hidden": F.col("launch_string").rlike("(?i)--hidden")})
    return t.autoruns_known_good.select("record_id", F.array_join(r, ",").alias("reasons"))


@query("glob_match", r"SELECT record_id FROM autoruns_known_good WHERE trim(coalesce(image_path, '')) <> '' AND (regexp_full_match(image_path, '(?s).*program files.*\.sys') OR contains(image_path, 'program files*.sys'))")
def _(t: Tables) -> DataFrame:
    return t.autoruns_known_good.where(text.glob_match(F.col("image_path"), "*program files**.sys")).select("record_id")


@query("prefix_match", "SELECT row_id, component_name FROM component_rows WHERE component_name = 'Windows.Logs.Logon' OR starts_with(component_name, 'Windows.Logs.Logon/')")
def _(t: Tables) -> DataFrame:
    return t.component_rows.where(P.under(F.col("component_name"), "Windows.Logs.Logon")).select("row_id", "component_name")


@query("inventory_filter", "SELECT DISTINCT artifact, alias_name FROM schema_contract WHERE regexp_matches(artifact, '(?i)^windows\\.') AND regexp_matches(semantic, '(?i)user|path|hash')")
def _(t: Tables) -> DataFrame:
    return t.schema_contract.where(P.all_of([F.col("artifact").rlike(r"(?i)^windows\."), F.col("semantic").rlike("(?i)user|path|hash")])).select("artifact", "alias_name").distinct()


@query("enrich_left", "SELECT r.row_id, r.client_id, c.hostname, c.fqdn FROM component_rows r LEFT JOIN clients c ON r.client_id = c.client_id")
def _(t: Tables) -> DataFrame:
    return t.component_rows.join(t.clients.select("client_id", "hostname", "fqdn"), "client_id", "left").select("row_id", "client_id", "hostname", "fqdn")


@query("batched_sources", "SELECT r.row_id, s.n AS source_no FROM component_rows r JOIN (VALUES ('Generic.Net.Sockets', 1), ('Linux.Sys.Journal', 2), ('Windows.Fs.Timeline', 3)) s(a, n) ON r.artifact = s.a")
def _(t: Tables) -> DataFrame:
    sources = t.spark.createDataFrame([("Generic.Net.Sockets", 1), ("Linux.Sys.Journal", 2), ("Windows.Fs.Timeline", 3)], "artifact string, source_no int")
    return t.component_rows.join(sources, "artifact").select("row_id", "source_no")


@query("explode_nested", "SELECT c.client_id, l.label FROM clients c, LATERAL (SELECT unnest(c.labels) AS label) l WHERE l.label <> 'lab'")
def _(t: Tables) -> DataFrame:
    return t.clients.select("client_id", F.explode("labels").alias("label")).where("label <> 'lab'")


@query("lookup_with_fallback", "WITH p(name, topics) AS (VALUES ('Windows.System.TaskList/Network', 'net'), ('Windows.System.TaskList', 'proc'), ('Generic.Net.Sockets', 'sock')) SELECT x.component_name, coalesce(e.topics, q.topics) AS topics, CASE WHEN e.topics IS NOT NULL THEN 'exact' WHEN q.topics IS NOT NULL THEN 'parent' ELSE 'none' END AS how FROM (SELECT DISTINCT component_name FROM component_rows) x LEFT JOIN p e ON e.name = x.component_name LEFT JOIN p q ON q.name = split_part(x.component_name, '/', 1)")
def _(t: Tables) -> DataFrame:
    p = t.spark.createDataFrame([("Windows.System.TaskList/Network", "net"), ("Windows.System.TaskList", "proc"), ("Generic.Net.Sockets", "sock")], "name string, topics string")
    x = t.component_rows.select("component_name").distinct().withColumn("parent", F.substring_index("component_name", "/", 1))
    j = x.join(p.select(F.col("name").alias("component_name"), F.col("topics").alias("e")), "component_name", "left").join(p.select(F.col("name").alias("parent"), F.col("topics").alias("q")), "parent", "left")
    return j.select("component_name", F.coalesce("e", "q").alias("topics"), F.when(F.col("e").isNotNull(), "exact").when(F.col("q").isNotNull(), "parent").otherwise("none").alias("how"))


@query("first_available", "WITH alt(wanted, pos, name) AS (VALUES ('users', 1, 'Account'), ('users', 2, 'UserName'), ('users', 3, 'User'), ('paths', 1, 'FullPath'), ('paths', 2, 'Path')) SELECT wanted, min_by(name, pos) AS name FROM alt WHERE name IN (SELECT alias_name FROM schema_contract) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    alt = t.spark.createDataFrame([("users", ["Account", "UserName", "User"]), ("paths", ["FullPath", "Path"])], "wanted string, names array<string>")
    have = t.schema_contract.select(F.col("alias_name").alias("name")).distinct()
    return alt.select("wanted", F.posexplode("names").alias("pos", "name")).join(have, "name", "left_semi").groupBy("wanted").agg(F.min_by("name", "pos").alias("name"))


@query("union_sources", "SELECT artifact, count(*) AS n FROM (SELECT artifact FROM component_rows UNION ALL SELECT artifact FROM documents UNION ALL SELECT artifact FROM query_batches) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.component_rows.select("artifact").unionByName(t.documents.select("artifact")).unionByName(t.query_batches.select("artifact")).groupBy("artifact").agg(F.count("*").alias("n"))


@query("baseline_intersect", "SELECT client_id FROM clients INTERSECT SELECT client_id FROM component_rows")
def _(t: Tables) -> DataFrame:
    return t.clients.select("client_id").intersect(t.component_rows.select("client_id"))


@query("baseline_except", "SELECT client_id FROM clients EXCEPT SELECT client_id FROM component_rows WHERE artifact = 'Generic.Net.Sockets'")
def _(t: Tables) -> DataFrame:
    return t.clients.select("client_id").subtract(t.component_rows.where("artifact = 'Generic.Net.Sockets'").select("client_id"))


@query("fingerprint", "SELECT artifact, sha256(array_to_string(list_sort(list(DISTINCT client_id)), chr(10))) AS fingerprint FROM component_rows GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.component_rows.select("artifact", "client_id").distinct().groupBy("artifact").agg(hashing.set_fingerprint(F.collect_list("client_id")).alias("fingerprint"))


def _path_sql(c: str, fold: bool = True) -> str:
    out = f"coalesce({c}, '')"
    for pattern, repl in text.PATH_RULES:
        rep = repl.replace("\\", "\\\\")
        out = f"regexp_replace({out}, '(?i){pattern}', '{rep}', 'g')"
    return f"translate({out}, '{text.UPPER}', '{text.LOWER}')" if fold else out


@query("normalize_path", f"SELECT record_id, {_path_sql('image_path')} AS path FROM autoruns_known_good")
def _(t: Tables) -> DataFrame:
    return t.autoruns_known_good.select("record_id", text.identity_path(F.col("image_path")).alias("path"))


@query("normalize_stack_text", rf"""SELECT row_id, lower(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(command_text, ''), '\s+', ' ', 'g')), '{text.USER_FOLDER}', '\1<USER>', 'g'), '{text.GUID}', '<GUID>', 'g'), '{text.SID}', '<SID>', 'g')) AS command FROM component_rows""")
def _(t: Tables) -> DataFrame:
    return t.component_rows.select("row_id", text.stack_text(F.col("command_text"), "command_line").alias("command"))


@query("truncate_text", "SELECT rule_id, CASE WHEN length(image_path_regex) > 40 THEN left(image_path_regex, 37) || '...' ELSE image_path_regex END AS short FROM autoruns_regex_rules")
def _(t: Tables) -> DataFrame:
    return t.autoruns_regex_rules.select("rule_id", text.truncated(F.col("image_path_regex"), 40).alias("short"))


@query("review_row", "SELECT record_id, array_to_string(list_filter([CASE WHEN trim(image_path) <> '' THEN 'image=' || image_path END, CASE WHEN trim(signer) <> '' THEN 'signer=' || signer END, CASE WHEN trim(description) <> '' THEN 'note=' || description END], lambda x: x IS NOT NULL)[1:2], ' | ') AS review FROM autoruns_known_good")
def _(t: Tables) -> DataFrame:
    return t.autoruns_known_good.select("record_id", text.summary({"image": F.col("image_path"), "signer": F.col("signer"), "note": F.col("description")}, 2).alias("review"))


def _json_sql(c: str) -> str:
    out = f"""replace(replace({c}, '\\', '\\\\'), '"', '\\"')"""
    for ch, letter in (("10", "n"), ("13", "r"), ("9", "t")):
        out = f"replace({out}, chr({ch}), '\\{letter}')"
    for code in (*map(ord, "&<>"), 0x2028, 0x2029):
        out = f"replace({out}, chr({code}), '\\u{code:04x}')"
    return f"'\"' || {out} || '\"'"


_IDENTITY = f"""sha1('{{' || chr(10) || ' "ImagePath": ' || {_json_sql(_path_sql('image_path'))} || ',' || chr(10) || ' "LaunchString": ' || {_json_sql(_path_sql('launch_string'))} || ',' || chr(10) || ' "Signer": ' || {_json_sql(f"translate(coalesce(signer, ''), '{text.UPPER}', '{text.LOWER}')")} || chr(10) || '}}')"""


@query("hash_identity", f"""SELECT record_id, sha1('{{' || chr(10) || ' "ImagePath": ' || {_json_sql(_path_sql('image_path'))} || ',' || chr(10) || ' "LaunchString": ' || {_json_sql(_path_sql('launch_string'))} || ',' || chr(10) || ' "Signer": ' || {_json_sql(f"translate(coalesce(signer, ''), '{text.UPPER}', '{text.LOWER}')")} || chr(10) || '}}') AS hash_key FROM autoruns_known_good""")
def _(t: Tables) -> DataFrame:
    return t.autoruns_known_good.select("record_id", hashing.identity_key(F.col("image_path"), F.col("launch_string"), F.col("signer")).alias("hash_key"))


@query("epoch_normalize", "SELECT row_id, CASE WHEN n >= 100000000000000000 THEN n // 1000 WHEN n >= 100000000000000 THEN n WHEN n >= 100000000000 THEN n * 1000 ELSE n * 1000000 END AS row_us, CASE WHEN n > 1000000000000000000 THEN n // 1000 WHEN n > 1000000000000000 THEN n WHEN n > 1000000000000 THEN n * 1000 ELSE n * 1000000 END AS hunt_us, CASE length(when_text) WHEN 10 THEN n * 1000000 WHEN 13 THEN n * 1000 WHEN 16 THEN n WHEN 19 THEN n // 1000 END AS digits_us FROM (SELECT row_id, when_text, CAST(when_text AS BIGINT) AS n FROM component_rows WHERE regexp_full_match(when_text, '[0-9]{10}|[0-9]{13}|[0-9]{16}|[0-9]{19}'))")
def _(t: Tables) -> DataFrame:
    r = t.component_rows.where(F.col("when_text").rlike(r"\A(\d{10}|\d{13}|\d{16}|\d{19})\z"))
    n = F.col("when_text").try_cast("long")
    return r.select("row_id", times.epoch_micros(n, "row").alias("row_us"), times.epoch_micros(n, "hunt").alias("hunt_us"), times.epoch_micros(n, "digits").alias("digits_us"))


@query("utc_canonical", "SELECT doc_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", times.utc_text(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("created"))


@query("json_path", "SELECT file_id, line_no, json_extract_string(record_json, '$.Details.Key') AS key, json_extract_string(record_json, '$.Tags[0]') AS tag FROM component_files")
def _(t: Tables) -> DataFrame:
    return t.component_files.select("file_id", "line_no", F.get_json_object("record_json", "$.Details.Key").alias("key"), F.get_json_object("record_json", "$.Tags[0]").alias("tag"))


@query("array_ops", "SELECT client_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), ['all', 'all']))), ',') AS tags, list_contains(coalesce(labels, []), 'lab') AS is_lab, len(list_filter(coalesce(labels, []), lambda x: length(x) > 4)) AS long_ones FROM clients")
def _(t: Tables) -> DataFrame:
    have = F.coalesce(F.col("labels"), F.array().cast("array<string>"))
    more = F.concat(have, F.array(F.lit("all"), F.lit("all")))
    return t.clients.select("client_id", F.array_join(F.array_sort(F.array_distinct(more)), ",").alias("tags"), F.array_contains(have, "lab").alias("is_lab"), F.size(F.filter(have, lambda x: F.length(x) > 4)).cast("long").alias("long_ones"))


@query("ratio_round", "SELECT artifact, round(count(user_name) / count(*), 4) AS named, round(100.0 * count(DISTINCT client_id) / count(*), 2) AS percent, CAST(ceil(count(*) / 100.0) AS BIGINT) AS chunks FROM component_rows GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.component_rows.groupBy("artifact").agg(F.round(F.count("user_name") / F.count("*"), 4).alias("named"), F.round(F.lit(100.0) * F.count_distinct("client_id") / F.count("*"), 2).alias("percent"), F.ceil(F.count("*") / 100.0).cast("long").alias("chunks"))


@query("regex_extract_all", "SELECT name, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+\\.exe'))) AS name FROM documents) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+\.exe"), F.lit(0)))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("nested_build", "SELECT client_id, '{\"host\":\"' || hostname || '\",\"zone\":\"' || time_zone || '\"}' AS rule, split_part(time_zone, '/', 1) AS area FROM clients")
def _(t: Tables) -> DataFrame:
    return t.clients.select("client_id", F.to_json(F.struct(F.col("hostname").alias("host"), F.col("time_zone").alias("zone"))).alias("rule"), F.element_at(F.split("time_zone", "/"), 1).alias("area"))
