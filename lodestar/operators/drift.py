"""Schemas that drift between files: rescue-column ingestion and a report of every change.

A target schema holds one typed column per meaning of the contract. A record's fields go to it by the names the contract knows; what is
unknown or doesn't cast stays as JSON in a rescue column. Unknown names are then approved by what they hold: names spelled
like a known one, and names whose values look like those of one known meaning. Rescued values of approved names are
replayed into the typed columns. The change report is made from the ingested table: what went into a typed column, what was
rescued and what was null in each file, compared from file to file.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.session import written

#: Types of the columns of meanings that aren't texts.
TYPES = {
    "eid": "bigint", "pid": "bigint", "size": "bigint", "score": "double", "entropy": "double", "signed": "boolean",
    "time": "timestamp", "tags": "array<string>", "details": "map<string,string>",
}
#: Least likeness (cosine of value shapes) and lead over the next meaning for a name to be approved by its values.
LIKENESS, LEAD = 0.6, 0.1
#: Up to so many approved names are written into the plan; more are joined.
LITERAL_NAMES = 1000
_IDS = ("file_id", "request_id", "component_name", "exported_at", "line_no")


def target(contract: DataFrame) -> dict[str, str]:
    """Column name to type, one for each meaning of the contract; the driver sees one row per column of the table."""
    got = [r[0] for r in contract.select("semantic").where("semantic is not null").distinct().collect()]
    return {m: TYPES.get(m, "string") for m in sorted(got)}


def spelled(name: Column) -> Column:
    """A name without case, signs and spaces."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def _kind(v: Column, raw: Column) -> Column:
    """The JSON type of a variant; whether a number is an integer is seen in its text, which 9.0 has and the variant not."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.isNull() | (s == "VOID"), "null")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise(F.when(raw.rlike(r"^-?\d+$"), "integer").otherwise("number"))
    )


def _plain(kind: Column, raw: Column) -> Column:
    """The text of a single value, of a list of one too; null for others."""
    listed = F.from_json(raw, "array<string>")
    return F.when(kind == "array", F.when(F.size(listed) == 1, listed[0])).when(~kind.isin("object", "null"), raw)


def _json(kind: Column, raw: Column) -> Column:
    """The JSON of a value: its raw text, quoted if it is a string."""
    listed = F.to_json(F.array(raw))
    return F.when(kind == "string", F.substring(listed, 2, F.length(listed) - 2)).otherwise(raw)


def _raw(kind: Column, json: Column) -> Column:
    """The opposite."""
    return F.when(kind == "string", F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>")[0]).otherwise(json)


def read_fields(raw: DataFrame) -> DataFrame:
    """Records once each (by file_id and line_no) with `fields`: name, kind and raw, the plain text of a string and the JSON of all else.

    `fields` is null where record_json is no object.
    """
    once = raw.select(*_IDS, "record_json").distinct()
    once = once.withColumns({"_v": F.from_json("record_json", T.MapType(T.StringType(), T.VariantType())), "_t": F.from_json("record_json", "map<string,string>")})
    zipped = F.arrays_zip(F.map_keys("_v").alias("name"), F.map_values("_v").alias("v"), F.map_values("_t").alias("raw"))
    fields = F.transform(zipped, lambda e: F.struct(e["name"].alias("name"), _kind(e["v"], e["raw"]).alias("kind"), e["raw"].alias("raw")))
    return once.select(*_IDS, fields.alias("fields"))


def _shape(kind: Column, raw: Column) -> Column:
    """What a value looks like: its type, coarse size and pattern; a list of one counts as what it holds."""
    text = _plain(kind, raw)
    bare = F.regexp_replace(text, r"\s", "")
    size = F.concat(F.lit("integer:"), F.length(bare))
    digits = F.concat(F.lit("number:"), F.length(F.substring_index(bare, ".", -1)))
    return (
        F.when(kind == "integer", size)
        .when(kind == "boolean", "boolean")
        .when(kind == "object", "object")
        .when(text.isNull(), F.concat(F.lit("list:"), F.when(raw.rlike(r'^\["[A-Za-z]+"'), "word").otherwise("other")))
        .when(bare.rlike(r"^-?\d+$"), size)
        .when(bare.rlike(r"^-?\d+\.\d+$"), digits)
        .when(kind == "number", "number")
        .when(F.lower(bare).isin("true", "false", "yes", "no"), "boolean")
        .when(text.rlike(r"^[0-9A-Fa-f]{32,128}$"), "hex")
        .when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}(:\d+)?$|^[0-9A-Fa-f]*:[0-9A-Fa-f:]+$"), "address")
        .when(text.rlike(r"^\d{4}-\d\d-\d\d"), "time")
        .when(text.contains("/") | text.contains("\\"), "path")
        .when(text.rlike(r"^[A-Za-z0-9_.\- ]{1,40}$"), "word")
        .otherwise("text")
    )


def approvals(read: DataFrame, contract: DataFrame) -> DataFrame:
    """(name, semantic, how) of every field name that can be given a meaning: `contract`, `spelling` or `values`.

    The look of a name's values is compared with that of the names known by contract or spelling, over all records.
    """
    known = contract.select(F.col("alias_name").alias("name"), "semantic").where("name is not null and semantic is not null")
    # An alias that the contract gives two meanings has the lesser one.
    by_name = known.groupBy("name").agg(F.min("semantic").alias("by_name"))
    by_spelling = known.groupBy(spelled(F.col("name")).alias("spelling")).agg(F.min("semantic").alias("by_spelling"))
    values = read.select(F.inline("fields"))
    seen = F.when(F.col("kind") != "null", _shape(F.col("kind"), F.col("raw")))
    shapes = written(values.groupBy("name", seen.alias("shape")).agg(F.count("*").alias("n")))
    names = shapes.select("name").unionByName(by_name.select("name")).distinct()
    given = written(
        names.join(by_name, "name", "left")
        .withColumn("spelling", spelled(F.col("name")))
        .join(by_spelling, "spelling", "left")
        .select("name", F.coalesce("by_name", "by_spelling").alias("semantic"), F.when(F.col("by_name").isNotNull(), "contract").when(F.col("by_spelling").isNotNull(), "spelling").alias("how"))
    )
    shapes = shapes.where("shape is not null")
    unit = Window.partitionBy("name")
    of_name = shapes.withColumn("w", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(unit)))
    of_meaning = shapes.join(given.where("semantic is not null").select("name", "semantic"), "name").groupBy("semantic", "shape").agg(F.sum("n").alias("n"))
    of_meaning = of_meaning.withColumn("u", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("semantic"))))
    open_names = of_name.join(given.where("semantic is null").select("name"), "name")
    alike = open_names.join(of_meaning.select("semantic", "shape", "u"), "shape").groupBy("name", "semantic").agg(F.sum(F.col("w") * F.col("u")).alias("cos"))
    best = alike.groupBy("name").agg(F.max(F.struct("cos", "semantic")).alias("m"), F.array_sort(F.collect_list("cos")).alias("all"))
    lead = F.col("m.cos") - F.coalesce(F.try_element_at("all", F.lit(-2)), F.lit(0.0))
    by_values = best.where((F.col("m.cos") >= LIKENESS) & (lead >= LEAD)).select("name", F.col("m.semantic").alias("semantic"), F.lit("values").alias("how"))
    return given.where("semantic is not null").unionByName(by_values)


def _castable(semantic: Column, kind: Column, raw: Column, to: Mapping[str, str]) -> Column:
    """Whether a value goes into the column of its meaning; a JSON null is no value."""

    def of(kinds: str) -> Column:
        return semantic.isin(*[m for m, t in to.items() if t == kinds])

    text = _plain(kind, raw)
    out = F.when(semantic.isNull() | (kind == "null"), F.lit(False)).when(of("string"), text.isNotNull())
    out = out.when(of("array<string>"), kind != "object").when(of("map<string,string>"), kind == "object")
    for t in sorted({t for t in to.values() if t not in ("array<string>", "map<string,string>", "string")}):
        out = out.when(of(t), text.try_cast(t).isNotNull())
    return F.coalesce(out, F.lit(False))


def _value(field: Column, to: str) -> Column:
    """A castable field in the type of its column."""
    kind, raw = field["kind"], field["raw"]
    if to == "array<string>":
        return F.when(kind == "array", F.from_json(raw, to)).when(raw.isNotNull(), F.array(raw))
    if to.startswith("map"):
        return F.from_json(raw, to)
    return _plain(kind, raw) if to == "string" else _plain(kind, raw).try_cast(to)


def _with_meanings(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with `_meaning`, name to semantic of (at least) those names in `fields` that `names` knows.

    Few names are a constant of the plan; more are looked up once per distinct set of names and joined by the whole set.
    """
    one = names.groupBy("name").agg(F.min("semantic").alias("semantic"))
    few = one.limit(LITERAL_NAMES + 1).collect()
    if len(few) <= LITERAL_NAMES:
        pairs = [F.lit(x) for r in few for x in (r["name"], r["semantic"])]
        return rows.withColumn("_meaning", F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>"))
    rows = rows.withColumn("_names", F.array_sort(F.transform("fields", lambda e: e["name"])))
    sets = rows.select("_names").distinct()
    known = sets.select("_names", F.explode(F.array_distinct("_names")).alias("name")).join(one, "name")
    known = known.groupBy("_names").agg(F.map_from_entries(F.collect_list(F.struct("name", "semantic"))).alias("_meaning"))
    return rows.join(known, "_names", "left").drop("_names")


def _take(rows: DataFrame, names: DataFrame, to: Mapping[str, str], filled: bool = False) -> DataFrame:
    """rows with the typed columns taken from `fields` by names; of several names of one meaning the first that casts.

    Where `filled`, rows are an ingested table, and only its null columns are filled.
    """
    rows = _with_meanings(rows, names)
    meant = F.transform("fields", lambda e: F.struct(F.try_element_at("_meaning", e["name"]).alias("semantic"), e["name"].alias("name"), e["kind"].alias("kind"), e["raw"].alias("raw")))
    rows = rows.withColumn("_meant", meant)
    free = (lambda m: ~F.array_contains(F.map_keys("typed"), m)) if filled else (lambda m: F.lit(True))
    ok = F.filter("_meant", lambda e: _castable(e["semantic"], e["kind"], e["raw"], to) & free(e["semantic"]))
    rows = rows.withColumn("_ok", F.array_sort(ok))  # by meaning, then name
    first = F.filter("_ok", lambda e, i: (i == 0) | (F.try_element_at("_ok", F.greatest(i, F.lit(1)))["semantic"] != e["semantic"]))
    rows = rows.withColumn("_first", first)
    rows = rows.withColumns({"_by": F.map_from_arrays(F.transform("_first", lambda e: e["semantic"]), F.col("_first")), "_used": F.transform("_first", lambda e: e["name"])})
    taken = F.transform_values("_by", lambda _, e: F.struct(e["name"].alias("name"), e["kind"].alias("kind")))
    left = F.filter("fields", lambda e: ~F.array_contains(F.col("_used"), e["name"]) & (e["kind"] != "null"))
    kept = F.map_from_entries(F.transform(left, lambda e: F.struct(e["name"], F.struct(e["kind"].alias("kind"), _json(e["kind"], e["raw"]).alias("json")))))
    nulls = F.transform(F.filter("fields", lambda e: e["kind"] == "null"), lambda e: e["name"])
    value = {m: _value(F.try_element_at("_by", F.lit(m)), t) for m, t in to.items()}
    return rows.select(
        *_IDS,
        *[(F.coalesce(F.col(f"`{m}`"), v) if filled else v).alias(m) for m, v in value.items()],
        (F.map_concat("typed", taken) if filled else taken).alias("typed"),
        kept.alias("rescued"),
        (F.col("nulls") if filled else nulls).alias("nulls"),
    )


def replay(ingested: DataFrame, names: DataFrame, to: Mapping[str, str]) -> DataFrame:
    """An ingested table with rescued values of approved names cast into typed columns that are null; raw files aren't read.

    A value that goes into a column leaves `rescued`; what is there already stays.
    """
    fields = F.transform(F.map_entries("rescued"), lambda e: F.struct(e["key"].alias("name"), e["value"]["kind"].alias("kind"), _raw(e["value"]["kind"], e["value"]["json"]).alias("raw")))
    return _take(ingested.withColumn("fields", fields), names, to, True)


def ingest(raw: DataFrame, contract: DataFrame, names: DataFrame | None = None, read: DataFrame | None = None) -> DataFrame:
    """Every record of every file in one consistent table.

    file_id, request_id, component_name, exported_at, line_no; one typed column per meaning of the contract (texts unless TYPES
    says otherwise); typed, a map from meaning to name and JSON type of the field in its column; rescued, a map from name to JSON
    type and JSON of the fields that no column took (unknown name, value that doesn't cast, second name of one meaning); nulls,
    the names of JSON nulls. A null, broken or non-object record keeps its ids with nulls elsewhere. Rows delivered twice are
    one record. `names` gives approvals; by default they are made from all of raw. Names of the contract are cast first, then
    rescued values of names approved otherwise are replayed.
    """
    read = read if read is not None else written(read_fields(raw))
    names = names if names is not None else written(approvals(read, contract))
    to = target(contract)
    return replay(_take(read, names.where("how = 'contract'"), to), names.where("how <> 'contract'"), to)


def table_fields(ingested: DataFrame) -> DataFrame:
    """(ids, name, kind, semantic) of every field in an ingested table: typed, rescued or null; a record without any has a null name."""
    typed = F.transform(F.map_entries("typed"), lambda e: F.struct(e["value"]["name"].alias("name"), e["value"]["kind"].alias("kind"), e["key"].alias("semantic")))
    rescued = F.transform(F.map_entries("rescued"), lambda e: F.struct(e["key"].alias("name"), e["value"]["kind"].alias("kind"), F.lit(None).cast("string").alias("semantic")))
    nulls = F.transform("nulls", lambda n: F.struct(n.alias("name"), F.lit("null").alias("kind"), F.lit(None).cast("string").alias("semantic")))
    return ingested.select(*_IDS, F.inline_outer(F.concat(typed, rescued, nulls)))


def changes(ingested: DataFrame, names: DataFrame) -> DataFrame:
    """(file_id, field_name, change_kind, new_name): what each file changed against the one before it in its series.

    Series are the files of one request_id and component_name by exported_at, then file_id. A field counts once it occurs in
    any record, null or not; its type is that of its values (number where integers and other numbers mix; several types,
    joined, where others mix; none where all are null, which is no change of type). A removed and an added name of one
    meaning are one `renamed`; names without a meaning stand for themselves by their spelling.
    """
    fields = (
        table_fields(ingested)
        .groupBy("request_id", "component_name", "file_id", "name")
        .agg(F.array_sort(F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))).alias("k"), F.min("semantic").alias("semantic"), F.min("exported_at").alias("at"))
        .withColumn("k", F.when(F.size(F.array_except("k", F.array(F.lit("integer"), F.lit("number")))) == 0, F.slice(F.reverse("k"), 1, 1)).otherwise(F.col("k")))
        .select("request_id", "component_name", "file_id", "name", "at", "semantic", F.array_join("k", "|").alias("kind"))
    )
    fields = written(fields)
    per_field = fields.where("name is not null").select("file_id", "name", "kind")
    # A name means what its column means where it went into one, else what it was approved for.
    means = fields.where("semantic is not null").select("name", "semantic").unionByName(names.select("name", "semantic")).groupBy("name").agg(F.min("semantic").alias("semantic"))
    files = fields.groupBy("request_id", "component_name", "file_id").agg(F.min("at").alias("at"))
    order = Window.partitionBy("request_id", "component_name").orderBy("at", "file_id")
    steps = files.select("file_id", F.lag("file_id").over(order).alias("before")).where("before is not null")
    now = per_field.join(steps.select("file_id"), "file_id")
    was = steps.join(per_field.withColumnRenamed("file_id", "before"), "before").select("file_id", "name", F.col("kind").alias("old"))
    both = now.join(was, ["file_id", "name"], "full_outer")
    retyped = both.where("kind != '' and old != '' and kind != old").select("file_id", F.col("name").alias("field_name"), F.lit("retyped").alias("change_kind"), F.lit("").alias("new_name"))
    side = both.where("kind is null or old is null").select("file_id", "name", F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change_kind"))
    meant = side.join(means, "name", "left").withColumn("semantic", F.coalesce(F.concat(F.lit("="), "semantic"), spelled(F.col("name"))))
    nth = Window.partitionBy("file_id", "semantic", "change_kind").orderBy("name")
    meant = meant.withColumn("nth", F.row_number().over(nth))
    pair = meant.groupBy("file_id", "semantic", "nth").agg(F.min(F.when(F.col("change_kind") == "removed", F.col("name"))).alias("old_name"), F.min(F.when(F.col("change_kind") == "added", F.col("name"))).alias("now_name"))
    moved = pair.select(
        "file_id",
        F.coalesce("old_name", "now_name").alias("field_name"),
        F.when(F.col("old_name").isNull(), "added").when(F.col("now_name").isNull(), "removed").otherwise("renamed").alias("change_kind"),
        F.when(F.col("old_name").isNotNull() & F.col("now_name").isNotNull(), F.col("now_name")).otherwise("").alias("new_name"),
    )
    return retyped.unionByName(moved)


def drift_found(raw: DataFrame, contract: DataFrame) -> DataFrame:
    """p5_found: (file_id, field_name, change_kind, new_name), from the ingested table as it is written."""
    read = written(read_fields(raw))
    names = written(approvals(read, contract))
    return changes(written(ingest(raw, contract, names, read)), names)
