import pytest
from pyspark.sql import functions as F

from docsieve.functions import catalogs as C
from docsieve.functions import text as X
from docsieve.operators import pii
from docsieve.sources.providers import Gazetteer, entities
from tests import model

SAMPLE = "John Doe's email is john.doe@example.com and his phone number is (555) 123-4567. His SSN is 123-45-6789 and he lives at 123 Main Street, Anytown, NY. The meeting with Acme Corporation is scheduled for tomorrow."
EDGES = ["", "   ", "10.0.0.1:8080 5551234567890123", "meet E123456789 now", "a b\x1cc", "１２３-45-6789", "ſecret SECRET", "ends 8080", "x" * 50, "C:\\temp\\a and /usr/bin", "call 1-800-555-0199.", "Österreich 12.12.2020 12/12/2020é"]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


@pytest.mark.parametrize("mode", pii.MODES)
def test_redaction_equals_model(spark, sf, mode):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in EDGES + [SAMPLE]], "text string"))
    got = rows.select("text", pii.redact(F.col("text"), mode).alias("clean")).collect()
    assert [(r.text, r.clean) for r in got if r.clean != model.redact(r.text, mode)] == []


def test_golden(spark):
    assert one(spark, SAMPLE, pii.redact(F.col("text"))) == "John Doe's email is [EMAIL] and his phone number is [PHONE]. His SSN is [SSN] and he lives at [ADDRESS], Anytown, NY. The meeting with Acme [PII] is scheduled for tomorrow."
    risk = one(spark, SAMPLE, pii.risk(pii.detect(F.col("text"))))
    assert (risk.risk_level, risk.risk_score, risk.pii_count) == ("CRITICAL", 17, 5)
    assert risk.recommendations[-1].startswith("Email addresses") and len(risk.recommendations) == 5


def test_overlapping_findings_cut_into_each_other(spark):
    assert one(spark, "10.0.0.1:8080 5551234567890123", pii.redact(F.col("text"))) == "[IP_ADDRESS]:8 [PHONE]_CARD]"


def test_findings_lie_where_they_say(spark, sf):
    bad = spark.read.parquet(f"{sf}/documents.parquet").select("text", F.inline(pii.detect(F.col("text"), ["anan"])).alias("kind", "type", "found", "start", "end", "confidence"))
    assert bad.where("substring(text, start + 1, end - start) <> found").count() == 0


def test_long_inputs_do_not_exhaust_the_stack(spark):
    url, domain = "http://" + "a" * 50_000, ".".join(["ab"] * 20_000)
    assert one(spark, url, F.size(X.spans(F.col("text"), X.flagged(C.PERSONAL[5].regex, True)))) == 1
    regex = next(e[1] for e in C.STRUCTURED if e[0] == "domains")
    assert one(spark, domain, F.regexp_count("text", F.lit(X.flagged(regex, False)))) > 0


def test_client_names_may_overlap(spark):
    hits = one(spark, "Anananx anan", X.literal_hits(F.col("text"), "anan"))
    assert [(h.start, h.end, h.text) for h in hits] == [(0, 4, "Anan"), (2, 6, "anan"), (8, 12, "anan")]


def test_recogniser_is_pluggable(spark):
    found = entities(Gazetteer({"John Doe": "PERSON"}), F.col("text"))
    df = spark.createDataFrame([("I met John Doe.",), (None,), ("",)], "text string").withColumn("e", found)
    assert [r[0] for r in df.select(pii.redact(F.col("text"), entities=F.col("e"))).collect()] == ["I met [PERSON].", None, ""]


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    assert [r[0] for r in df.select(pii.redact(F.col("text"))).collect()] == [None, ""]
    assert [r[0] for r in df.select(F.size(pii.detect(F.col("text")))).collect()] == [0, 0]


def test_unknown_mode_raises():
    with pytest.raises(ValueError):
        pii.redact(None, "shred")


def test_specialised_keeps_white_space(spark):
    assert one(spark, "see  role/admin\nnow", pii.redact_specialized(F.col("text"))) == "see  [AWS_RESOURCE]\nnow"
    assert one(spark, "port 22/tcp", pii.redact_specialized(F.col("text"))) == "port [PORT_RANGE]/tcp"
    assert one(spark, "from Dev-box on", pii.redact_specialized(F.col("text"), "mask")) == "from ******* on"


def test_nested_schema(spark):
    df = spark.sql("select struct('role/a' as x, array('role/b', 'c') as y, map('k', 'role/d') as m, array(array('role/e')) as deep) as doc, 1 as n")
    row = pii.clean_nested(df).first()
    assert row.doc.x == "[AWS_RESOURCE]" and row.doc.y == ["[AWS_RESOURCE]", "c"] and row.doc.m == {"k": "[AWS_RESOURCE]"} and row.doc.deep == [["role/e"]] and row.n == 1


def test_sheet_modes(spark):
    df = spark.createDataFrame([("Ann", 1), (None, 2)], "`Employee Full Name` string, n int")
    assert [r[0] for r in pii.redact_sheet(df, C.SENSITIVE_SHEET, C.SHEET_REPLACEMENTS).collect()] == ["[REDACTED NAME]", None]
    assert [r[0] for r in pii.redact_sheet(df, C.SENSITIVE_SHEET, C.SHEET_REPLACEMENTS, "remove").collect()] == [None, None]
    assert pii.sheet_statistics(df, C.SENSITIVE_SHEET).first().cells == 1


def test_redacting_clean_text_changes_nothing(spark):
    text = "Nothing to see here, really."
    assert one(spark, text, pii.redact(F.col("text"))) == text


def test_specialised_patterns_are_scanned_for_only_where_they_can_match(spark):
    texts = EDGES + ["Ann Lee ſecurity", "Jo Doe Manager at 10.0.0.1/8", "IT Team", "CERTIFICATION OF A B", "arn:aws:iam::123456789012:role/x", "AB0123456789ABCDEFGH", "ABCDEFGHIJKLMNOPQRSTUV", "XY-123-Z9 SECRET", "İT Dept MyRoles Stage-1", "plain", "policy/ab_c", "Jo Doe ENGİNEER", "Jo Doe enGINEer"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    t = F.col("text")
    named = lambda p: lambda x: F.struct(F.lit(p.name).alias("type"), x["start"].alias("start"), x["end"].alias("end"))
    plain = F.concat(*[F.transform(X.spans(t, X.flagged(p.regex, False)), named(p)) for p in (C.TITLED_NAME, *C.SPECIALIZED)])
    for r in df.select(t, pii.specialized_findings(t).alias("a"), plain.alias("b")).collect():
        assert [(f.type, f.start, f.end) for f in r.a or []] == [tuple(x) for x in r.b], r.text
    assert all(p.needs for p in C.SPECIALIZED if p.name != "aws_role_id")
