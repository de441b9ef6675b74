"""Registered queries read patterns as their SQL does: beside letters beyond ASCII, too."""

import itertools

import pandas as pd
import pytest

from docsieve.functions import catalogs as C
from docsieve.functions import text as X
from docsieve.plans import queries, sql
from tests.duck import TABLES, assert_same

HITS = ("10.0.0.1", "12/12/2020", "2020-1-2", "219 est", "3 oak lane", "a.b+c@d-e.org", "123-45-6789", "1234 5678 9012 3456", "E12345", "ab-12345-xy", "corp", "/usr/bin_", "secret", "ſecret", "acceſs", "restricted", "https://a/b", "HTTPſ://K",
        "AB0123456789ABCDEF", "123456789012", "user/a.b", "XY-123-Z9", "SECRET", "Manager", "IT  Team", "MyRole", "Dev-x", "arn:aws:iam:eu:123456789012:role\ry", "22/tcp", "port 8080", "udp", "user: bob", "10.1.2.3/8", "ſK-12345-Ks", "ab%+-ſ@kK.sſ", "555-123-4567", "anan İanan")
AROUND = ("ü", "é", "ſ", "K", "ß", "１", "_", " ", "\x0b", "\x1f", "\xa0", " ", "İ", "ı", "𝒳", "")
TEXTS = [f"{a}{h}{b} x" for h, a, b in itertools.product(HITS, AROUND, AROUND)] + [f"c {a} 5{b}x st" for a, b in itertools.product(AROUND, AROUND)] + ["", "１２３-45-6789", "7\x0bSt", "8 a\x0bSt 22\n", "ends 22\n", "ends 22"]
QUERIES = ("pii_matches", "clean_lines", "pii_doc_counts", "pii_risk_scores", "label_risk", "pii_risk_histogram", "pii_recommendations", "pii_type_counts", "redact_mask", "redact_remove", "redact_replace", "redact_report", "specialized_counts", "documents_security", "extract_ip_addresses", "extract_ports", "dictionary_scan")


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        (d / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    for t, frame in {"documents": pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS}), "labels": pd.DataFrame({"doc_id": range(len(TEXTS)), "quality": [i % 2 for i in range(len(TEXTS))]})}.items():
        (d / f"{t}.parquet").unlink()
        frame.to_parquet(d / f"{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_beside_other_letters(spark, odd, name):
    assert_same(queries.QUERIES[name](spark, odd), sql.ORACLE[name], odd)


@pytest.mark.parametrize(("regex", "case"), [(p.regex, True) for p in C.PERSONAL] + [(p.regex, False) for p in C.SPECIALIZED if p.name != "port_range"] + [(r, True) for c in C.CATEGORIES for r in c.patterns] + [(r, not case) for _, r, _, case in C.STRUCTURED])
def test_pattern_equals_sql(spark, odd, regex, case):
    hits = spark.read.parquet(f"{odd}/documents.parquet").selectExpr("doc_id", "text").withColumn("m", X.spans(X.F.col("text"), X.flagged(regex, case, True)))
    got = hits.selectExpr("doc_id", "inline(m)").selectExpr("doc_id", "text as match", "cast(start as long) as start_at")
    assert_same(got, f"SELECT doc_id, h.text AS match, h.s AS start_at FROM (SELECT doc_id, unnest({sql.hits('text', regex, case)}) AS h FROM documents)", odd)
