"""The two fitted models against plain versions of their definitions."""

import random
from collections import Counter
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import lang_ppm, quality_gam, sp_codec
from docsieve.llm.queries import PIECES
from docsieve.llm.shared import hash_share
from tests.duck import connect


class PlainPpm:
    """Method C by dictionaries, a byte at a time."""

    def __init__(self, texts):
        self.nodes = {}
        for data in texts:
            padded = b"\n" * 3 + data
            for i in range(3, len(padded)):
                for k in range(4):
                    self.nodes.setdefault(padded[i - k : i], Counter())[padded[i]] += 1

    def bits(self, context, byte):
        node = self.nodes.get(context)
        below = lambda: self.bits(context[1:], byte) if context else 8.0
        if node is None:
            return below()
        total = sum(node.values()) + len(node)
        return log2(total / node[byte]) if node[byte] else log2(total / len(node)) + below()

    def length(self, data):
        padded = b"\n" * 3 + data
        return sum(self.bits(padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))


TEXTS = {"de": "über den wäldern liegt ein grauer nebel und die straße ist nass", "el": "η γλώσσα είναι παλιά και όμορφη", "ja": "日本語の文章はここにあります。とても短い", "ru": "это короткий текст на русском языке", "zh": "这是一个中文句子用来测试"}


def test_code_lengths_are_exact(monkeypatch):
    r = random.Random(0)
    train = {k: [" ".join(r.sample(t.split(), len(t.split()))).encode() for _ in range(4)] for k, t in TEXTS.items()}
    counts = [np.unique(np.concatenate([lang_ppm.codes(t) for t in train[k]]), return_counts=True) for k in sorted(train)]
    model = lang_ppm.Model(sorted(train), counts)
    tests = [t.encode() for t in TEXTS.values()] + [bytes(r.randrange(256) for _ in range(60)), b"a", "mixed übер 日本".encode(), b""]
    want = [[PlainPpm(train[k]).length(t) for k in sorted(train)] for t in tests]
    assert np.allclose(model.lengths(tests), want)
    monkeypatch.setattr(lang_ppm, "BLOCK", 50)
    assert np.allclose(model.lengths(tests), want)


def test_five_scripts(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(list(TEXTS[k]), k=40)) if k in ("ja", "zh") else " ".join(r.choices(TEXTS[k].split(), k=12)), k) for i, k in enumerate(sorted(TEXTS) * 30)]
    got = lang_ppm.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: k for i, _, k in rows}
    assert all(g.lang_pred == want[g.doc_id] for g in got) and any(g.held_out for g in got)


def test_rows_are_drawn_at_any_size(spark):
    ids = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    assert ids.where(hash_share(F.col("h"), 10, 5)).count() == 200_000
    assert 800 < ids.where(hash_share(F.col("h"), 3000, 600_000)).count() < 1200
    # one in thirty million still draws: the smallest hashes of many
    limit = (3000 << 62) // 10**11
    assert 0 < limit < 1 << 62 and spark.sql("SELECT 1L AS h").where(hash_share(F.col("h"), 3000, 10**11)).count() == 1


def test_op5_equals_a_fit_of_its_own(spark, sf):
    from zlib import crc32

    from docsieve.llm import queries

    con = connect(sf)
    texts = dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    labels = [(i, q) for i, q in con.sql("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall() if i in texts and crc32(str(i).encode()) % 5]
    x, y = np.array([quality_gam.features(texts[i].encode()) for i, _ in labels]), np.array([float(q) for _, q in labels])
    order = np.lexsort([*x.T, y, np.array([i for i, _ in labels])])
    model = quality_gam.fit(x[order], y[order])

    def plain(data):
        total = model.intercept
        own = quality_gam.features(data)
        b = [sum(e <= v for e in edges) for v, edges in zip(own, model.edges, strict=True)]
        total += sum(t[k] for t, k in zip(model.tables, b, strict=True)) + sum(t[b[i], b[j]] for i, j, t in model.pairs)
        return 1 / (1 + np.exp(-total))

    for r in queries.op5_quality_gam(spark, sf).collect():
        assert abs(r.score - plain(texts[r.doc_id].encode())) < 1e-6 and r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}", 9.9, 8.8, "x") for i in range(40)], "doc_id long, text string, score double, score_ double, ids string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit("y").alias("text"))
    kept = quality_gam.drop_poor(docs, labels)
    assert kept.columns == docs.columns and {(r.score, r.score_) for r in kept.collect()} == {(9.9, 8.8)}
    for call in (lambda: quality_gam.score(docs, quality_gam.Gam()), lambda: sp_codec.encode(docs, PIECES), lambda: sp_codec.decode(docs, PIECES, text_col="text")):
        with pytest.raises(ValueError):
            call()
