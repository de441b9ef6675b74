import pytest
from pyspark.sql import functions as F

from docsieve.functions import catalogs as C
from docsieve.functions import registered
from docsieve.operators import pii


def test_sql_functions_equal_the_operator(spark, sf):
    registered.register(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "mail A@B.org or 10.0.0.1")], "doc_id long, text string"))
    docs.createOrReplaceTempView("some_docs")
    found = spark.sql("SELECT doc_id, type, match FROM some_docs, LATERAL find_pii(text)")
    want = docs.select("doc_id", F.inline(pii.detect(F.col("text")))).select("doc_id", "type", F.col("text").alias("match"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    total = spark.sql("SELECT sum(count_pii(text)) FROM some_docs").first()[0]
    assert total == want.count() > 0
    assert [tuple(r) for r in spark.sql("SELECT doc_id, count_pii(text) FROM some_docs WHERE doc_id IN (-1, -2)").orderBy("doc_id").collect()] == [(-2, 0), (-1, 0)]


def test_own_catalog(spark):
    registered.register(spark, [C.Pattern("ticket", r"\bit's-\d+", "[TICKET]")], "tickets")
    assert [tuple(r) for r in spark.sql("SELECT * FROM find_tickets('IT''S-7 and it''s-12')").collect()] == [("ticket", "IT'S-7"), ("ticket", "it's-12")]
    with pytest.raises(ValueError):
        registered.register(spark, [])
