"""Detection for SQL: functions of a session that the optimizer inlines, over any catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import catalogs as C
from . import text as X


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, catalog: Sequence[C.Pattern] = C.PERSONAL, suffix: str = "pii") -> None:
    """Makes two functions of the catalog's patterns, case ignored: the table function find_<suffix>(doc), which gives
    (type, match) of every match (none for null), and count_<suffix>(doc), their number (0 for null). An empty catalog is a ValueError."""
    if not catalog:
        raise ValueError("the catalog has no patterns")
    rules = [(_quoted(p.name), _quoted(X.flagged(p.regex, True))) for p in catalog]
    found = ", ".join(f"transform(regexp_extract_all(coalesce(doc, ''), {regex}, 0), m -> named_struct('type', {name}, 'match', m))" for name, regex in rules)
    counts = " + ".join(f"regexp_count(coalesce(doc, ''), {regex})" for _, regex in rules)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION find_{suffix}(doc STRING) RETURNS TABLE (type STRING, match STRING) RETURN SELECT x.type, x.match FROM explode(flatten(array({found}))) AS t(x)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION count_{suffix}(doc STRING) RETURNS BIGINT RETURN CAST({counts} AS BIGINT)")
