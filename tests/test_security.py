import time

from pyspark.sql import functions as F

from docsieve.operators import geometry, regions, report, security


def test_analysis_of_a_note(spark):
    df = spark.createDataFrame([(1, "Deny TCP port 22. Firewall rule set. High severity intrusion detected! CVE-2023-1234 is a critical vulnerability."), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in security.analyze(df).collect()}
    assert "Firewall Rules: Deny TCP port 22" in rows[1].key_findings
    assert rows[1].total_findings > 5 and rows[1].description.startswith("Contains")
    assert rows[2].total_findings == 0 and rows[2].description == "No significant security content detected"
    assert rows[3].confidence_score == 0


def test_entities(spark):
    df = spark.createDataFrame([(1, "From 10.0.0.1 port 0022 or 70000 via ssh to a.example.com at 2024-01-02T03:04:05, user: bob, /etc/passwd")], "doc_id long, text string")
    got = {}
    for r in security.entities(df).collect():
        got.setdefault(r.kind, []).append(r.value)
    assert got["ip_addresses"] == ["10.0.0.1"] and got["protocols"] == ["SSH"] and got["usernames"] == ["bob"]
    assert "22" in got["ports"] and "70000" not in got["ports"]
    assert got["timestamps"] == ["2024-01-02T03:04:05"] and "/etc/passwd" in got["file_paths"]


def test_fuzzy_keywords_equal_a_plain_search():
    import random

    from docsieve.functions import catalogs as C

    def plain(text):
        t = text.lower().strip()
        for k in C.REGION_KEYWORDS:
            parts = [("fuzzy_keyword", t)] + [("partial_keyword", t[i : i + len(k)]) for i in range(len(t) - len(k) + 1) if len(t) > len(k)]
            like = [(kind, regions.indel_ratio(x, k)) for kind, x in parts]
            if any(v >= 80 for _, v in like):
                return next(x for x in like if x[1] >= 80)
        return None

    r = random.Random(0)
    for _ in range(1500):
        text = "".join(r.choice("rolepcyaswiamtkn é-") for _ in range(r.randrange(14)))
        if r.random() < 0.5:
            k = list(r.choice(C.REGION_KEYWORDS))
            k[r.randrange(len(k))] = r.choice("xyz ")
            text = text[: r.randrange(4)] + "".join(k) + text[:3]
        assert regions.fuzzy_keyword(text) == plain(text), text


def test_fuzzy_keywords():
    assert regions.indel_ratio("polcy", "policy") == 200 * 5 / 11
    assert regions.fuzzy_keyword("polcy")[0] == "fuzzy_keyword"
    assert regions.fuzzy_keyword("my passwrd here") is not None
    assert regions.fuzzy_keyword(None) is None and regions.indel_ratio("", "") == 100


def test_region_ladder(spark):
    df = spark.createDataFrame([("a secret", []), ("blue", ["my password"]), ("zzzz", ["qqqq"]), (None, None)], "text string, near array<string>")
    got = [r[0] for r in df.select(regions.classify(F.col("text"), F.col("near"))).collect()]
    assert [(g.type, g.confidence) for g in got] == [("sensitive_words", 95.0), ("contextual_sensitive_words", 85.0), (None, None), (None, None)]


def test_reports_of_no_results(spark):
    empty = spark.createDataFrame([], report.RESULTS)
    assert report.overview(empty).first().total_files == 0
    assert {r.risk_level: r.files for r in report.risk_histogram(empty).collect()} == {"LOW": 0, "MEDIUM": 0, "HIGH": 0, "CRITICAL": 0}
    assert report.csv_rows(empty).count() == 0 and report.pages(empty).count() == 0


def test_suppression_keeps_the_surest(spark):
    df = spark.sql("select array(named_struct('x',0,'y',0,'w',10,'h',10,'confidence',0.5D), named_struct('x',1,'y',1,'w',10,'h',10,'confidence',0.9D), named_struct('x',50,'y',0,'w',5,'h',5,'confidence',0.1D)) as b")
    assert [(k.x, k.confidence) for k in df.select(geometry.suppress(F.col("b"))).first()[0]] == [(1, 0.9), (50, 0.1)]
    assert len(df.select(geometry.group_near(F.col("b"))).first()[0]) == 2
    assert df.select(geometry.bounds(F.col("b"))).first()[0].w == 55
    assert df.select(geometry.suppress(F.array().cast("array<struct<x:int,y:int,w:int,h:int,confidence:double>>"))).first()[0] == []


def test_best_text_with_long_runs_of_spaces(spark):
    # a strip that tries the run again from each of its characters takes minutes
    text = "a" + " " * 500_000 + "b"
    began = time.monotonic()
    df = spark.createDataFrame([(text,), (text + "\x1c 　",), ("  x\x1fy ",)], "text string")
    got = [r[0] for r in df.select(security.best_text(F.array("text", F.lit("q")))).collect()]
    assert got == [text, text, "x\x1fy"]
    assert time.monotonic() - began < 30


ODD = ["Deny TCP port 22. Deny TCP port 22! Policy: a￿b. Alert severity", "ſecurity group rule; Policy: é. policy: É? IPS ips", "", None, "no", "￿￿ deny udp 1 allow tcp 2￿"]


def test_rows_equal_those_of_topics(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id int, text string")
    whole = security.topics(df)
    want = whole.select("doc_id", "category", F.inline("keywords")).select("doc_id", "category", "keyword", "sentence", "start").collect()
    assert sorted(security.keyword_rows(df).collect()) == sorted(want) and len(want) > 10
    want = whole.select("doc_id", "category", F.inline("patterns")).select("doc_id", "category", "pattern", "text", "context", "start").collect()
    assert sorted(security.pattern_rows(df).collect()) == sorted(want) and len(want) > 5
    assert all(t is None or t[r.start :].startswith(r.text) for r in want for t in [ODD[r.doc_id]])
    lines = security.analyze(df).select("doc_id", F.posexplode("key_findings")).collect()
    assert sorted(map(tuple, security.key_findings(df).collect())) == sorted(map(tuple, lines)) and lines
    same = ["doc_id", "categories_found", "total_findings", "confidence_score", "recommendations", "description"]
    assert sorted(map(str, security.descriptions(df).select(same).collect())) == sorted(map(str, security.analyze(df).select(same).collect()))


def test_hits_do_not_carry_what_no_one_reads(spark, sf):
    from docsieve.plans import queries

    plan = queries.keyword_hits(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and plan.count("regexp_extract_all") < 5 and "cve-" not in plan
    for name in ("key_findings", "security_recommendations", "security_summary"):
        assert " split(" not in queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
