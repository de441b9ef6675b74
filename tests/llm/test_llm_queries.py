"""The registered queries against SQL or against brute force on the small tables."""

import hashlib
import html
import re

import numpy as np
import pytest
import xxhash

from docsieve.llm import license_scan, queries, simhash, sql
from tests.duck import assert_same, connect


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_equals_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), sql.ORACLE[name], sf)


def documents(sf):
    return dict(connect(sf).sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def test_op1_base_places(spark, sf):
    docs = documents(sf)
    rows = queries.op1_license_scan(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(docs[r.doc_id]))
        places, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op2_articles(spark, sf):
    pages = dict(connect(sf).sql("SELECT page_id, coalesce(html, '') FROM pages").fetchall())
    rows = queries.op2_html_main(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)
        if body:
            marked = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\x00", body.group(1))))
            blocks = (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in marked.split("\x00"))
            assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_op3_whole_items(spark, sf):
    held = set(connect(sf).sql("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall())
    assert {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, sf).collect()} == held


def test_op5_held_out_accuracy(spark, sf):
    labels = dict(connect(sf).sql("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall())
    rows = queries.op5_quality_gam(spark, sf).collect()
    assert len(rows) == len(documents(sf)) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    judged = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean(judged) >= 0.8


def test_op6_equals_library(spark, sf):
    import sentencepiece as spm

    sp, docs = spm.SentencePieceProcessor(model_file=queries.PIECES), documents(sf)
    for r in queries.op6_sentencepiece(spark, sf).collect():
        ids = sp.encode(docs[r.doc_id])
        assert r.same_text and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


def test_op8_covers_equal_passages(spark, sf):
    words = {i: t.encode().lower().split() for i, t in documents(sf).items()}
    holders = {}
    for i, w in words.items():
        for p in range(len(w) - 49):
            holders.setdefault(tuple(w[p : p + 50]), set()).add(i)
    found = {i: set() for i in words}
    for r in queries.op8_substring_dedup(spark, sf).collect():
        assert r.n_words >= 50 and r.identity >= 0.8
        found[r.doc_id].update(range(r.start_word, r.end_word))
    for i, w in words.items():
        for p in range(len(w) - 49):
            if len(holders[tuple(w[p : p + 50])]) > 1:
                assert set(range(p, p + 50)) <= found[i]


def test_op9_held_out_accuracy(spark, sf):
    langs = dict(connect(sf).sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    rows = queries.op9_language_id(spark, sf).collect()
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out and r.doc_id in langs]) >= 0.9


def test_op10_equals_brute_force(spark, sf):
    docs, prints = documents(sf), {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    forest = simhash.Forest(len(ids))
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 4:
                forest.join(a, b)
    for r in queries.op10_simhash(spark, sf).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == ids[forest.find(ids.index(r.doc_id))]


def test_pipeline_equals_its_parts(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(docs.count())
    final = p.run(spark, sf)
    assert sorted(sizes, reverse=True) == sizes and final.count() == sizes[-1]
    assert {r.doc_id for r in final.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) == len(texts)


def test_pipeline_on_odd_rows(spark, sf, tmp_path):
    """Nulls, repeated rows and ids, clashing columns, a very long text, against the stages' own statements."""
    import corpus_pipeline as p

    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(60).collect()]
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(i, t) for i, t in enumerate(good)] + [(0, good[0]), (0, good[5]), (None, good[7]), (None, None), (70, None), (71, ""), (72, good[9] + " " + leak), (73, " ".join(good) * 20)]
    columns = "doc_id long, text string, score double, ids string, text_key string, id long"
    spark.createDataFrame([(i, t, 9.0, "x", "y", 3) for i, t in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = docs.selectExpr("doc_id", "cast(length(text) > 40 as int) AS quality").where("doc_id < 60")
    labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    texts = []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.where("score != 9 OR ids != 'x' OR id != 3").isEmpty(), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        texts.append([(r.doc_id, r.text) for r in docs.collect()])
    bodies = [t or "" for _, t in texts[1]]
    assert len(set(bodies)) == len(bodies) and set(bodies) == {t or "" for _, t in texts[0]}
    assert not any(leak in (t or "") for _, t in texts[3])
    got = p.run(spark, str(tmp_path))
    assert sorted((r.doc_id or -1) for r in got.collect()) == sorted((i or -1) for i, _ in texts[3])
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
