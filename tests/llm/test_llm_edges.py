"""Nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import chat_format, decontam, exact_dedup, html_main, lang_ppm, license_scan, quality_gam, simhash, sp_codec, substring_dedup
from docsieve.llm.lcs import common
from docsieve.llm.queries import PIECES

SCHEMA = "doc_id long, text string, lang string, source string, key string, score double, fp long, words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "k", 0.5, 7, "w") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (4, "one"), (None, "one"), (5, "x " * 60_000), (6, "\x00 é 日本 ▁  "), (7, None)]

OPERATORS = {
    "license": lambda d: license_scan.scan(d),
    "exact": lambda d: exact_dedup.exact_groups(d),
    "quality": lambda d: quality_gam.quality_scores(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "pieces": lambda d: sp_codec.round_trips(d, PIECES),
    "encode": lambda d: sp_codec.decode(sp_codec.encode(d, PIECES), PIECES),
    "language": lambda d: lang_ppm.identify(d),
    "simhash": lambda d: simhash.near_groups(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_odd_row(spark, name):
    assert OPERATORS[name](docs(spark, ODD)).count() == len(ODD)
    assert OPERATORS[name](docs(spark, ODD).where("false")).count() == 0


def test_odd_rows_elsewhere(spark):
    bench = spark.createDataFrame([(1, None), (None, "a b c d e f g"), (2, ""), (3, "short"), (4, prose(1, 30)), (4, prose(1, 30))], "item_id long, text string")
    assert decontam.contaminated(docs(spark, ODD), bench).count() == 0
    assert decontam.contaminated(docs(spark, ODD).where("false"), bench).count() == 0
    assert substring_dedup.repeated_passages(docs(spark, ODD)).count() == 0
    assert substring_dedup.repeated_passages(docs(spark, ODD).where("false")).count() == 0
    pages = spark.createDataFrame([(1, None, None), (1, "http://a/b", "<p>x"), (None, "", ""), (2, "odd url", "<<<>>> &amp &#x;")], "page_id long, url string, html string")
    assert html_main.extract(pages).count() == 4
    assert html_main.extract(pages.where("false")).count() == 0


def test_exact_groups_with_ties(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(spark, ODD)).collect()}
    assert (1, 7, 3, False) in got and (7, 7, 3, True) in got and (2, 7, 3, False) in got
    assert (4, 4, 3, True) in got and (None, 4, 3, False) in got
    kept = exact_dedup.drop_exact_copies(docs(spark, ODD))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7] and kept.columns == docs(spark, ODD).columns


def test_small_buckets_give_the_same_groups(spark):
    rows = docs(spark, [(i, prose(i % 7, 40)) for i in range(60)])
    small, large = exact_dedup.exact_groups(rows, capacity=600), exact_dedup.exact_groups(rows)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert {r.keep_id for r in small.collect()} == set(range(53, 60))


def test_directory_doubles_only_for_overfull_buckets():
    sizes = np.full(1024, 100)
    sizes[[5, 6, 700]] = [2000, 900, 5000]
    made = exact_dedup.Directory(sizes, 1500)
    buckets = made.in_order()
    assert len(made.slots) == 1 << made.depth and len(buckets) == len(made.buckets)
    assert sum(n for _, _, n in buckets) == sizes.sum() and all(n <= 1500 or d == 10 for _, d, n in buckets)
    ends = [(p << (64 - d), (p + 1) << (64 - d)) for p, d, _ in buckets]
    assert ends[0][0] == 0 and ends[-1][1] == 1 << 64 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    for slot, b in enumerate(made.slots.tolist()):
        p, d, _ = made.buckets[b]
        assert slot >> (made.depth - d) == p
    # buckets that aren't overfull stay whole
    assert all(d == 0 or sizes[(p >> 1) << (11 - d) : ((p >> 1) + 1) << (11 - d)].sum() > 1500 for p, d, _ in buckets)


def test_directory_of_a_hundred_terabytes():
    r = np.random.default_rng(0)
    began = time.perf_counter()
    made = exact_dedup.Directory(r.poisson(2400, 1 << 22) * 10_000, 128 << 20)
    starts = exact_dedup.owners(made.in_order(), 128 << 20, 10_000)
    assert time.perf_counter() - began < 30 and len(starts) > 500_000 and all(n <= 128 << 20 for _, _, n in made.buckets)


def test_rows_of_one_id_are_kept_by_their_text(spark):
    rows = docs(spark, [(1, "a"), (2, "a"), (1, "b"), (3, "c"), (3, "c"), (1, None), (1, "")])
    assert sorted((r.doc_id, r.text or "") for r in exact_dedup.drop_exact_copies(rows).collect()) == [(1, ""), (1, "b"), (2, "a"), (3, "c")]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(rows).collect()]
    assert sorted(got) == [(1, 1, 1, True), (1, 1, 2, False), (1, 1, 2, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, False), (3, 3, 2, True)]
    prints = simhash.keep_one_of_each(docs(spark, [(1, prose(1, 60)), (1, prose(2, 60)), (2, prose(1, 60)), (1, prose(1, 60))]))
    assert sorted((r.doc_id, r.text) for r in prints.collect()) == sorted([(1, prose(1, 60)), (1, prose(2, 60))])


def sent_and_compared(batches, starts=(0,)):
    import pyarrow as pa

    tables = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "key", "sha", "text"]) for rows in batches]
    sent = list(exact_dedup._local_chains(list(starts))(iter(tables)))
    return [r for b in sent for r in b.to_pylist()], [r for b in exact_dedup._compare(iter(sent)) for r in b.to_pylist()]


def test_equal_hashes_are_compared_by_bytes():
    sent, rows = sent_and_compared([[(1, 9, "a", "x"), (2, 9, "a", "y"), (3, 9, "a", "x")]])
    assert [r["members"] for r in sent] == [[1, 3], [2]]
    assert {(r["no"], r["keep_id"], r["group_size"]) for r in rows if r["group_size"]} == {(0, 3, 2), (1, 2, 1)}


def test_a_hot_text_is_sent_once_a_task():
    sent, rows = sent_and_compared([[(i + 10 * k, 9, "a", "hot") for i in range(10)] for k in range(50)])
    assert sum(r["body"] is not None for r in sent) == 1 and len(sent) == 50
    totals = [r for r in rows if r["group_size"]]
    assert [(r["keep_id"], r["group_size"], r["members"]) for r in totals] == [(499, 500, [499])]
    assert sorted(i for r in rows if not r["group_size"] for i in r["members"]) == list(range(499))


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame([(1, "A train leaves Boston at 40 km per hour and another train follows it from the same place at 60 km per hour, when do both trains meet")], "item_id long, text string")
    same = "Well. A train leaves Denver at 35 miles per hour and another train follows it from the same place at 90 miles per hour, when do both trains meet. So."
    rows = docs(spark, [(1, same), (2, "A train leaves late and nobody follows it anywhere in the rain."), (3, prose(1, 200)), (4, same + " " + same)])
    assert sorted(r.doc_id for r in decontam.contaminated(rows, bench).collect()) == [1, 4]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(rows, bench).collect()) == [2, 3]


def test_inserted_dropped_and_recased_words(spark):
    text = "A train leaves Boston at 40 km per hour and another train follows it from the same place at 60 km per hour, so when do both of the trains meet on their way to the far coast"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    w = text.split()
    copies = [" ".join(w[:18] + ["very"] + w[18:]), " ".join(w[:17] + w[18:]), text.lower(), text.upper(), text.replace("Boston", "St. Louis").replace("60", "3/4")]
    rows = docs(spark, [(k, f"{prose(k, 20)} {c} {prose(k + 50, 20)}") for k, c in enumerate(copies)] + [(9, prose(9, 200)), (10, " ".join(w[:12]))])
    assert sorted(r.doc_id for r in decontam.contaminated(rows, bench).collect()) == [0, 1, 2, 3, 4]


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "take 5 then add 5 and add 5 and then add 5 again and then add 5 and add 5 once more and add 5 more")], "item_id long, text string")
    steady = "take 7 then add 7 and add 7 and then add 7 again and then add 7 and add 7 once more and add 7 more"
    mixed = "take 1 then add 2 and add 3 and then add 4 again and then add 6 and add 7 once more and add 8 more"
    assert [r.doc_id for r in decontam.contaminated(docs(spark, [(1, steady), (2, mixed)]), bench).collect()] == [1]


def test_pieces_equal_library_on_odd_texts():
    import sentencepiece as spm

    with open(PIECES, "rb") as f:
        encoder = sp_codec.Encoder(sp_codec.PieceModel(f.read()))
    sp, r = spm.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    texts = ["".join(r.choice(" \n\tabcétheüñ日本é0193.,! 　😀ᚠin") for _ in range(r.randrange(70))) for _ in range(3000)] + ["", " ", " " * 900, "a" * 3000]
    assert all(list(a) == sp.encode(t) for a, t in zip(encoder.encode(texts), texts, strict=True))


def test_unigram_forward_pass_is_optimal():
    model = sp_codec.PieceModel.__new__(sp_codec.PieceModel)
    model.scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.5, "aba": -9.0, "bb": -4.0, "abab": -5.5}
    model.ids = {p: i for i, p in enumerate(model.scores)}
    model.bpe, model.least, model.byte_ids, model.unknown = False, -20.0, {}, 99
    model.tails = {p[-3:]: sorted({len(q) for q in model.ids if q[-3:] == p[-3:]} | {1, 2}, reverse=True) for p in model.ids if len(p) > 2}
    encoder, words = sp_codec.Encoder(model), sorted({"".join(random.Random(i).choice("ab") for _ in range(i % 9 + 1)) for i in range(60)})
    encoder.solve(words)
    names = {i: p for p, i in model.ids.items()}

    def best(w):
        table = [0.0] + [-1e9] * len(w)
        for e in range(1, len(w) + 1):
            table[e] = max(table[s] + model.scores.get(w[s:e], -1e9) for s in range(e))
        return table[-1]

    for w in words:
        got = encoder.known[w]
        assert "".join(names[i] for i in got) == w and abs(sum(model.scores[names[i]] for i in got) - best(w)) < 1e-9


def test_reply_trees(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good <|end|> \\ [x] </s>", 1.0), (1, 4, 3, "user", None, 0.0), (1, 5, 2, "user", "m", 0.0), (2, 9, 77, None, None, None), (3, 1, 2, "user", "a", 0.0), (3, 2, 1, "user", "b", 0.0)],
        "conv_id long, node long, parent long, role string, text string, score double",
    )
    best = {r.conv_id: r for r in chat_format.read_back(chat_format.format_trees(nodes)).collect()}
    assert [(t.role, t.text) for t in best[1].turns] == [("user", "q"), ("assistant", "good <|end|> \\ [x] </s>"), ("user", "")]
    assert best[1].trained == ["good <|end|> \\ [x] </s>"] and "</s>" not in best[1].formatted
    assert [(t.role, t.text) for t in best[2].turns] == [("", "")] and 3 not in best
    assert chat_format.format_trees(nodes, branches=5).where("conv_id = 1").count() == 2
    assert chat_format.format_trees(nodes.where("false")).count() == 0


def test_long_conversation_by_doubling(spark):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(200)] + [(2, None, None, None), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat_format.digests(chat_format.chains(turns)).collect()}
    assert rows[1].n_turns == 200 and rows[1].loss_chars == sum(len(f"t{t}") for t in range(1, 200, 2))
    assert rows[2].n_turns == 2 and rows[2].loss_chars == 0


def test_trees_equal_a_plain_walk(spark):
    r, rows = random.Random(4), []
    for conv in [*range(25), None]:
        ids = r.sample(range(100), r.randrange(1, 30))
        if r.random() < 0.6:
            ids.sort()
        for k, node in enumerate(ids):
            parent = None if not k or r.random() < 0.05 else ids[k - 1] if r.random() < 0.7 else r.choice(ids[:k])
            rows.append((conv, node, parent, r.choice(["user", "assistant", None]), r.choice([None, "", "a <b", "x" * r.randrange(9)]), r.choice([None, 1.0, -1.0, 0.5]), "other"))
    nodes = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double, formatted string")

    def best(conv, branches):
        own = {n: (p, role or "", text or "", score or 0.0) for c, n, p, role, text, score, _ in rows if c == conv}
        found = []
        for leaf in set(own) - {p for p, *_ in own.values()}:
            path = [leaf]
            while own[path[-1]][0] is not None:
                path.append(own[path[-1]][0])
            found.append((-sum(own[n][3] for n in path) / len(path), -len(path), leaf, [own[n][1:3] for n in path[::-1]]))
        return [f[3] for f in sorted(found)[:branches]]

    for branches in (1, 3):
        got = {}
        for x in chat_format.read_back(chat_format.format_trees(nodes, branches)).collect():
            got.setdefault(x.conv_id, {})[x.branch] = [(t.role, t.text) for t in x.turns]
            assert x.trained == [t.text for t in x.turns if t.role == "assistant"]
        assert set(got) == {*range(25), None}
        for conv, have in got.items():
            assert [have[k] for k in sorted(have)] == best(conv, branches)


def test_nameless_and_long_conversations(spark):
    turns = [(None, 1, "user", "q", 1), (None, 2, "assistant", "a" * 300_000, 1), (7, None, None, None, 1), (7, 1, "assistant", "x", 1), (7, 1, "assistant", "x", 1)]
    got = {r.conv_id: r for r in chat_format.digests(chat_format.chains(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, node int"))).collect()}
    assert got[None].n_turns == 2 and got[None].loss_chars == 300_000 and got[7].n_turns == 3 and got[7].loss_chars == 2
    assert chat_format.digests(chat_format.chains(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_fuzzy_and_shared_passages(spark):
    passage = prose(5, 80).split()
    edited = passage[:30] + ["other"] + passage[31:55] + passage[56:]
    rows = [(k, " ".join([prose(100 + k, 40), " ".join(edited if k % 3 == 0 else passage), prose(200 + k, 40)])) for k in range(1, 40)] + [(99, prose(999, 300))]
    found = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in found} == set(range(1, 40))
    assert all(abs(r.n_words - 80) <= 12 for r in found if r.role == "copy")
    assert len(found) <= 39 * 4  # two links a copy and the stretches they point to, not 39 * 38 pairs


def test_recall_of_edited_passages(spark):
    r, rows, words = random.Random(0), [], [f"w{i}" for i in range(2000)]
    some = lambda n: r.choices(words, [1 / (i + 1) for i in range(2000)], k=n)
    for i in range(0, 240, 2):
        passage, edited = some(60), []
        for j, w in enumerate(passage):  # every tenth word replaced, dropped or followed by another
            kind = r.choice("rdf") if (j + i) % 10 == 9 else "w"
            edited += {"r": ["other"], "d": [], "f": [w, "other"], "w": [w]}[kind]
        rows += [(i, " ".join(some(60) + passage + some(60))), (i + 1, " ".join(some(60) + edited + some(60)))]
    found = {(x.doc_id, x.rep_doc_id) for x in substring_dedup.repeated_passages(docs(spark, rows)).collect() if x.role == "copy"}
    assert found <= {(i + 1, i) for i in range(0, 240, 2)} and len(found) >= 0.9 * 120


def test_passages_of_frequent_lines(spark):
    one, two = prose(31, 30), prose(32, 30)
    rows = [(k, " ".join([prose(300 + k, 40), (one, two)[k % 2], prose(400 + k, 40)])) for k in range(1, 60)]
    rows += [(k, " ".join([prose(300 + k, 40), one, two, prose(400 + k, 40)])) for k in (70, 90)] + [(k, " ".join([(one, two)[k % 2], prose(500 + k, 40)])) for k in range(71, 90)]
    for parts in (1, 5):
        found = substring_dedup.repeated_passages(docs(spark, rows).repartition(parts)).collect()
        assert [(r.doc_id, r.n_words, r.rep_doc_id) for r in found if r.role == "copy"] == [(90, 60, 70)]


def test_partners_behind_other_holders(spark):
    passage = prose(41, 60).split()
    edited = [w if j % 10 else "other" for j, w in enumerate(passage)]
    parts = [" ".join(passage[j + 1 : j + 10]) for j in range(0, 60, 10)]
    around = lambda k, text: (k, " ".join([prose(600 + k, 20), text, prose(4000 + k, 20)]))
    for copies in (1, 50):  # each part has that many holders before, between and behind the two documents
        ids = [start + i for start in (1, 1001, 2001) for i in range(6 * copies)]
        rows = [around(k, parts[n % 6]) for n, k in enumerate(ids)] + [around(1000, " ".join(passage)), around(2000, " ".join(edited))]
        found = substring_dedup.repeated_passages(docs(spark, sorted(rows)).coalesce(1)).collect()
        assert {(r.doc_id, r.rep_doc_id) for r in found if r.role == "copy"} == {(2000, 1000)}


def test_chains_follow_both_orders():
    pos, rpos = [0, 10, 20, 30, 30], [100, 110, 5, 130, 6]
    longest = max(substring_dedup.chains(pos, rpos), key=len)
    assert [(pos[i], rpos[i]) for i in longest] == [(0, 100), (10, 110), (30, 130)]


def test_common_subsequence_is_longest():
    r = random.Random(0)
    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = common(a, b)
        assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got) and got == sorted(got)


def test_hot_bucket_links_alike(spark):
    r = np.random.default_rng(1)
    centre = r.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False)) for c in centre for _ in range(60)} | {int(x) for x in r.integers(0, 1 << 63, 100)}
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)], "fp long")
    from docsieve.llm.components import connected
    from docsieve.llm.shared import Workspace

    def roots(bucket):
        space = Workspace(spark, "t")
        return {(x.node, x.root) for x in connected(simhash.links(classes, space, bucket), space).collect()}

    u = np.array(sorted(fps), dtype=np.uint64)
    forest = simhash.Forest(len(u))
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4):
            forest.join(i, int(j))
    joined = {tuple(sorted(int(x) for x in u[[k for k in range(len(u)) if forest.find(k) == f]].view(np.int64))) for f in {forest.find(k) for k in range(len(u))}}
    want = {(n, g[0]) for g in joined if len(g) > 1 for n in g}
    assert roots(4) == want and roots(simhash.BUCKET) == want


def test_thresholds_add_up():
    chosen, cost = simhash.allocate([[0.0, 5.0, 9.0], [0.0, 1.0, 2.0], [0.0, 4.0, 50.0]], 0)
    assert sum(chosen) == 0 and cost == 6.0 and chosen == [-1, 1, 0]


def test_page_parts():
    page = "<html><head><title>T</title></head><body><header>top</header><div class='cookie-notice'>we</div><nav>x</nav><aside>a</aside><div id=content><h1>Title</h1><p>One &amp; two<br>three<p>Four</p><div class='reader-comments'><p>nice</p></div><form>f</form><span class=ad>buy</span> tail</div><footer>f</footer><script>var a='<p>no</p>'</script>"
    assert html_main.main_text(html_main.blocks(page), set()) == "Title\n\nOne & two three\n\nFour\n\ntail"
    headed = "<div class='site-header'>Logo</div><div class='post-header'><h1>H</h1></div><p>P</p>"
    assert html_main.main_text(html_main.blocks(headed), set()) == "H\n\nP"
    nested = "<nav>open <article><header><h1>H</h1></header><p>P</p><section class=comments><article>c</article></section></article> after"
    assert html_main.main_text(html_main.blocks(nested), set()) == "H\n\nP"


def test_language_of_letterless_text(spark):
    rows = docs(spark, [(i, f"the house and the garden {i} words") for i in range(40)] + [(100, "123 !?"), (101, None)])
    got = {r.doc_id: r for r in lang_ppm.identify(rows).collect()}
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[0].lang_pred == "en" and got[0].score == 1.0


def test_licence_templates(spark):
    text = "Released under the MIT License. Code here; all   rights\nReserved -- Licensed under CC BY-NC 4.0. all rights reserved"
    r = license_scan.scan(docs(spark, [(1, text), (2, "mit and license apart"), (3, "acc bye"), (4, "GNU General Public License version 3"), (5, "the mit license")])).orderBy("doc_id").collect()
    assert r[0].base_labels == "cc-by,reserved" and r[0].labels == "cc-by,cc-by-nc-4.0,mit,reserved" and r[0].n_base == 3
    assert r[1].labels == "" and r[1].score == 0 and r[2].n_base == 0
    assert r[3].labels == "gpl,gpl-3.0" and r[4].labels == ""


def test_gam_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 12))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    assert quality_gam.Gam().scores(x)[0] == 0.5
