"""The queries of this subpackage and, where SQL can state them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import dedup, encode, history, language, leaks, split, terms
from lodestar.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: split.oversized_found(table(s, d, "query_batches"), table(s, d, "analysis_limits")),
        "p1_pieces": lambda s, d: split.split_batches(table(s, d, "query_batches"), table(s, d, "analysis_limits")),
        "p2_found": lambda s, d: terms.terms_found(table(s, d, "golden_rules"), table(s, d, "autoruns_known_good")),
        "p3_found": lambda s, d: dedup.copies_found(table(s, d, "golden_rules"), table(s, d, "autoruns_known_good")),
        "p3_records": lambda s, d: dedup.records_collapsed(table(s, d, "golden_rules"), table(s, d, "autoruns_known_good")),
        "p6_found": lambda s, d: history.repeats_found(table(s, d, "autoruns_known_good"), table(s, d, "autoruns_regex_rules")),
        "p6_batches": lambda s, d: history.batches_screened(table(s, d, "autoruns_known_good"), table(s, d, "autoruns_regex_rules")),
        "p7_ids": lambda s, d: encode.encode_corpus(table(s, d, "documents")),
        "p8_found": lambda s, d: leaks.leaks_found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_matches": lambda s, d: leaks.find_leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_clean": lambda s, d: leaks.without_leaks(table(s, d, "documents"), leaks.find_leaks(table(s, d, "documents"), table(s, d, "eval_items"))).select("doc_id", "text"),
        "p9_found": lambda s, d: language.languages_found(table(s, d, "documents")),
        "p9_spans": lambda s, d: language.label_spans(table(s, d, "documents")),
        "p9_segments": lambda s, d: language.label_segments(table(s, d, "documents")),
    }


_SIZED = "SELECT batch_id, maximum_evidence_tokens_per_item AS t, maximum_analysis_item_rows AS m, len(batch_rows) AS n, unnest(batch_rows) AS x, generate_subscripts(batch_rows, 1) AS i FROM query_batches JOIN analysis_limits USING (limits_id)"
_P1 = f"""WITH s AS ({_SIZED}), z AS (SELECT *, coalesce(ceil(length(x) / 4.0), 0) AS size FROM s)
SELECT batch_id, CAST(0 AS BIGINT) AS row_no FROM z GROUP BY batch_id HAVING sum(size) > any_value(t) OR any_value(n) > any_value(m)
UNION ALL SELECT batch_id, i FROM z WHERE size > t"""

_SPACE = r"[\t-\r\x{85}\p{Z}]"


def _terms_sql(field: str, table_name: str, id_col: str, words: bool) -> str:
    folded = f"translate(v, '{terms.UPPER}', '{terms.LOWER}')"
    found = f"list_distinct(regexp_extract_all({folded}, '[\\p{{L}}\\p{{N}}_]+'))" if words else f"[regexp_replace({folded}, '^{_SPACE}+|{_SPACE}+$', '', 'g')]"
    rows = f"(SELECT DISTINCT {id_col}, {field} AS v FROM {table_name} WHERE regexp_replace({field}, '{_SPACE}+', '', 'g') <> '')"
    return (
        f"SELECT '{field}' AS field_name, term, CASE WHEN n = 1 THEN 'rare' ELSE 'common' END AS mark "
        f"FROM (SELECT term, count(*) AS n FROM (SELECT unnest({found}) AS term FROM {rows}) GROUP BY 1) WHERE n = 1 OR n > 0.05 * (SELECT count(*) FROM {rows})"
    )


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p2_found": " UNION ALL ".join([_terms_sql("image_path", "golden_rules", "rule_id", True), _terms_sql("signer", "golden_rules", "rule_id", False), _terms_sql("launch_string", "autoruns_known_good", "record_id", True)]),
    }
