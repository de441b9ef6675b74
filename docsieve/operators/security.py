"""Security content: topics, confidence, key findings, recommendations, descriptions and entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import catalogs as C
from docsieve.functions.text import SPACES, context, flagged, folded, half_up, let, lowered, sentences, spans, strip, word_count, word_guard

PATTERN_HITS = "array<struct<pattern:int,text:string,context:string,start:int,end:int>>"
KEYWORD_HITS = "array<struct<keyword:string,sentence:string,context:string,start:int,end:int>>"
PLACES = "array<struct<category:string,pattern:int,text:string,start:int,end:int>>"


class Search:
    """One search of a text for all words that tell what to scan it for: those that patterns begin with, and keywords."""

    def __init__(self, categories: Sequence[C.Category], keywords: bool = True):
        masks: dict[str, int] = {}
        self.bits: dict[str, int] = {}
        named = [(r, word_guard(r)) for c in categories for r in c.patterns] + [(c.name, c.keywords) for c in categories if keywords]
        for name, words in named:
            # beyond 63 names bits are shared, which only lets more be scanned for
            bit = self.bits.setdefault(name, 1 << len(self.bits) % 63) if words else 0
            for w in words:
                masks[w] = masks.get(w, 0) | bit
        self.words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(m).cast("long").alias("mask")) for w, m in sorted(masks.items())])

    def held(self, text: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` of a struct with the words in the text and the bits of what they let be scanned for."""
        found = let(folded(text), lambda low: F.filter(self.words, lambda w: F.contains(low, w["word"])))
        pack = lambda ws: F.struct(F.transform(ws, lambda w: w["word"]).alias("words"), F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(w["mask"])).alias("gates"))
        return let(let(found, pack), body)

    def may(self, held: Column, name: str, found: Column, none: Column) -> Column:
        return F.when(held["gates"].bitwiseAND(F.lit(self.bits[name])) != 0, found).otherwise(none) if name in self.bits else found

    def keywords(self, held: Column, category: C.Category, found: Callable[[Column], Column], none: Column) -> Column:
        """``found`` of the keywords of a topic that the text holds, in the topic's order."""
        return self.may(held, category.name, let(F.array_intersect(F.array(*map(F.lit, category.keywords)), held["words"]), found), none)


def pattern_hits(text: Column, search: Search, held: Column, category: C.Category, located: bool = True, ascii_only: bool = False) -> Column:
    """Matches of a topic's patterns, in the catalog's order and then by place, with 100 characters around; their texts
    alone if they aren't to be located."""

    def numbered(k: int):
        return lambda x: F.struct(F.lit(k).alias("pattern"), strip(x["text"]).alias("text"), context(text, x["start"], x["end"]).alias("context"), x["start"].alias("start"), x["end"].alias("end"))

    def scan(k: int, regex: str) -> Column:
        pattern = flagged(regex, True, ascii_only)
        if located:
            return search.may(held, regex, F.transform(spans(text, pattern), numbered(k)).cast(PATTERN_HITS), F.array().cast(PATTERN_HITS))
        return search.may(held, regex, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(strip(x).alias("text"))), F.array().cast("array<struct<text:string>>"))

    return F.concat(*[scan(k, regex) for k, regex in enumerate(category.patterns)])


def keyword_hits(text: Column, parts: Column, search: Search, held: Column, category: C.Category, located: bool = True) -> Column:
    """For each sentence (with its lower-cased form) and keyword in it (as a substring) the first occurrence; a repeated
    sentence counts at its first place. The sentences alone if they aren't to be located."""

    def hit(s: Column):
        def at(k: Column) -> Column:
            if not located:
                return F.struct(s["said"].alias("sentence"))
            start = F.instr(text, s["said"]) - 1 + F.instr(s["low"], k) - 1
            return F.struct(k.alias("keyword"), s["said"].alias("sentence"), context(text, start, start + F.char_length(k)).alias("context"), start.alias("start"), (start + F.char_length(k)).alias("end"))

        return at

    def of(ws: Column):
        return lambda s: F.transform(F.filter(ws, lambda k: F.contains(s["low"], k)), hit(s))

    kind = KEYWORD_HITS if located else "array<struct<sentence:string>>"
    return search.keywords(held, category, lambda ws: F.flatten(F.transform(parts, of(ws))).cast(kind), F.array().cast(kind))


def confidence(n_patterns: Column, n_keywords: Column, words: Column) -> Column:
    """0.3 for up to ten findings, 0.3 for keyword density, 0.4 for up to five patterns; 0 without findings."""
    total = n_patterns + n_keywords
    density = F.when(words > 0, n_keywords / words).otherwise(F.lit(0.0))
    value = F.least(total / 10.0, F.lit(1.0)) * 0.3 + F.least(density * 100, F.lit(1.0)) * 0.3 + F.least(n_patterns / 5.0, F.lit(1.0)) * 0.4
    return F.when(total == 0, F.lit(0.0)).otherwise(half_up(value, 3))


def topic_array(text: Column, categories: Sequence[C.Category] = C.CATEGORIES, located: bool = True, ascii_only: bool = False) -> Column:
    """An array with a struct for each topic: category, position, weight, patterns, keywords, finding_count, confidence."""
    search = Search(categories)

    def scanned(t: Column, parts: Column, words: Column, held: Column) -> Column:
        rows = F.array(
            *[
                F.struct(
                    F.lit(c.name).alias("category"), F.lit(k).alias("position"), F.lit(c.weight).alias("weight"), pattern_hits(t, search, held, c, located, ascii_only).alias("patterns"), keyword_hits(t, parts, search, held, c, located).alias("keywords")
                )
                for k, c in enumerate(categories)
            ]
        )

        def counted(r: Column) -> Column:
            n, m = F.size(r["patterns"]).cast("long"), F.size(r["keywords"]).cast("long")
            same = [r[x].alias(x) for x in ("category", "position", "weight", "patterns", "keywords")]
            return F.struct(*same, (n + m).alias("finding_count"), confidence(n, m, words).alias("confidence"))

        return F.transform(rows, counted)

    def read(t: Column) -> Column:
        said = F.transform(sentences(t), lambda s: F.struct(s.alias("said"), lowered(s).alias("low")))
        return search.held(t, lambda h: let(said, lambda s: let(word_count(t), lambda w: scanned(t, s, w, h))))

    return let(F.coalesce(text, F.lit("")), read)


def topics(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", categories: Sequence[C.Category] = C.CATEGORIES) -> DataFrame:
    """A row for each document and topic."""
    return df.select(F.col(id_col), F.inline(topic_array(F.col(text_col), categories)))


def pattern_rows(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", categories: Sequence[C.Category] = C.CATEGORIES, ascii_only: bool = False) -> DataFrame:
    """(id, category, pattern, text, context, start): a row for each match of a topic's pattern, as ``topics`` has them."""

    search = Search(categories, keywords=False)

    def scan(t: Column, held: Column, c: C.Category, k: int) -> Column:
        place = lambda x: F.struct(F.lit(c.name).alias("category"), F.lit(k).alias("pattern"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))
        return search.may(held, c.patterns[k], F.transform(spans(t, flagged(c.patterns[k], True, ascii_only)), place).cast(PLACES), F.array().cast(PLACES))

    found = lambda t: search.held(t, lambda h: F.concat(*[scan(t, h, c, k) for c in categories for k in range(len(c.patterns))]))
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.inline(found(F.col(text_col))))
    return rows.select(F.col("__id").alias(id_col), "category", "pattern", strip(F.col("text")).alias("text"), context(F.col("__text"), F.col("start"), F.col("end")).alias("context"), "start")


def keyword_rows(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", categories: Sequence[C.Category] = C.CATEGORIES) -> DataFrame:
    """(id, category, keyword, sentence, start): a row for each sentence and keyword in it, as ``topics`` has them."""
    words = F.array(*[F.struct(F.lit(c.name).alias("category"), F.lit(k).alias("keyword")) for c in categories for k in c.keywords])
    held = lambda low, ws: let(low, lambda t: F.filter(ws, lambda w: F.contains(t, w["keyword"])))
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.explode(F.array(held(lowered(F.col(text_col)), words))).alias("__held")).where(F.size("__held") > 0)
    said = texts.select("*", F.explode(sentences(F.col("__text"))).alias("sentence"))
    at = F.instr(F.col("__text"), F.col("sentence")) - 1
    placed = said.select("__id", "sentence", at.alias("__at"), F.inline(held(lowered(F.col("sentence")), F.col("__held"))))
    return placed.select(F.col("__id").alias(id_col), "category", "keyword", "sentence", (F.col("__at") + F.instr(lowered(F.col("sentence")), F.col("keyword")) - 1).alias("start"))


def count_array(text: Column, categories: Sequence[C.Category] = C.CATEGORIES, ascii_only: bool = False) -> Column:
    """An array with a struct for each topic: category, weight, n_patterns, n_keywords, finding_count, confidence; no finding is located."""
    zero, search = F.lit(0).cast("long"), Search(categories)

    def patterns(t: Column, held: Column, c: C.Category) -> Column:
        return sum((search.may(held, r, F.regexp_count(t, F.lit(flagged(r, True, ascii_only))), F.lit(0)) for r in c.patterns), F.lit(0)).cast("long")

    def keywords(said: Column, held: Column, c: C.Category) -> Column:
        count = lambda ws: F.aggregate(said, zero, lambda n, s: n + F.size(F.filter(ws, lambda k: F.contains(s, k))))
        return search.keywords(held, c, count, zero)

    def read(t: Column) -> Column:
        said = F.transform(sentences(t), lowered)

        def rows(held: Column, s: Column, words: Column) -> Column:
            found = F.array(*[F.struct(F.lit(c.name).alias("category"), F.lit(c.weight).alias("weight"), patterns(t, held, c).alias("n_patterns"), keywords(s, held, c).alias("n_keywords")) for c in categories])
            return F.transform(
                found,
                lambda r: F.struct(
                    *[r[x].alias(x) for x in ("category", "weight", "n_patterns", "n_keywords")], (r["n_patterns"] + r["n_keywords"]).alias("finding_count"), confidence(r["n_patterns"], r["n_keywords"], words).alias("confidence")
                ),
            )

        return search.held(t, lambda h: let(said, lambda s: let(word_count(t), lambda w: rows(h, s, w))))

    return let(F.coalesce(text, F.lit("")), read)


def topic_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", categories: Sequence[C.Category] = C.CATEGORIES, ascii_only: bool = False) -> DataFrame:
    """(id, category, n_patterns, n_keywords, finding_count, confidence): a row for each document and topic."""
    return df.select(F.col(id_col), F.inline(count_array(F.col(text_col), categories, ascii_only))).drop("weight")


def descriptions(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", categories: Sequence[C.Category] = C.CATEGORIES, ascii_only: bool = False) -> DataFrame:
    """(id, categories_found, total_findings, confidence_score, recommendations, description), from counts alone."""

    def of(ts: Column) -> Column:
        found, sure = _found(ts), _sure(ts, categories)
        said = let(F.struct(found.alias("f"), sure.alias("s")), lambda x: F.struct(x["f"].alias("categories_found"), describe(x["f"], x["s"]).alias("description")))
        return let(said, lambda x: F.struct(x["categories_found"].alias("categories_found"), _total(ts).alias("total_findings"), _score(ts).alias("confidence_score"), _advice(ts, categories).alias("recommendations"), x["description"].alias("description")))

    # explode keeps the optimizer from copying the counts into every column that is taken from them
    return df.select(F.col(id_col), F.explode(F.array(let(count_array(F.col(text_col), categories, ascii_only), of))).alias("a")).select(id_col, "a.*")


def _total(ts: Column) -> Column:
    return F.aggregate(ts, F.lit(0).cast("long"), lambda a, t: a + t["finding_count"])


def _score(ts: Column) -> Column:
    weighted = F.aggregate(ts, F.lit(0.0), lambda a, t: a + t["confidence"] * t["weight"])
    weights = F.aggregate(ts, F.lit(0.0), lambda a, t: a + t["weight"])
    return half_up(weighted / weights, 3)


def _advice(ts: Column, categories: Sequence[C.Category]) -> Column:
    none = F.array().cast("array<string>")

    def of(t: Column) -> Column:
        out = none
        for c in categories:
            out = F.when(t["category"] == c.name, F.array(*map(F.lit, c.recommendations))).otherwise(out)
        return F.when(t["confidence"] > 0.5, out).otherwise(none)

    general = F.when(F.size(F.filter(ts, lambda t: t["confidence"] > 0.3)) > 2, F.array(*map(F.lit, C.GENERAL_RECOMMENDATIONS))).otherwise(none)
    return F.sort_array(F.array_distinct(F.concat(F.flatten(F.transform(ts, of)), general)))


def _found(ts: Column) -> Column:
    return F.transform(F.filter(ts, lambda t: t["finding_count"] > 0), lambda t: t["category"])


def _sure(ts: Column, categories: Sequence[C.Category]) -> Column:
    def called(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for c in categories:
            out = F.when(t["category"] == c.name, F.lit(c.description)).otherwise(out)
        return out

    return F.transform(F.filter(ts, lambda t: t["confidence"] > 0.5), called)


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def topic_highlights(t: Column) -> Column:
    """Up to three pattern hits, or up to two sentences cut to 100 characters, of a topic whose confidence is over 0.3."""
    by_pattern = F.transform(F.slice(t["patterns"], 1, 3), lambda p: F.concat(title(t["category"]), F.lit(": "), p["text"]))
    said = F.slice(F.array_sort(F.array_distinct(F.transform(t["keywords"], lambda k: k["sentence"]))), 1, 2)
    by_sentence = F.transform(said, lambda s: F.concat(title(t["category"]), F.lit(": "), F.substring(s, 1, 100), F.lit("...")))
    none = F.array().cast("array<string>")
    return F.when(t["confidence"] <= 0.3, none).when(F.size(t["patterns"]) > 0, by_pattern).otherwise(by_sentence)


def highlights(ts: Column) -> Column:
    """The first ten of the topics' highlights."""
    return F.slice(F.array_distinct(F.flatten(F.transform(ts, topic_highlights))), 1, 10)


def describe(found: Column, sure: Column) -> Column:
    """An English list of the topics that are sure, or of those found at all. Both are arrays in the catalog's order."""
    n = F.size(sure)
    listed = (
        F.when(n == 1, sure[0])
        .when(n == 2, F.concat(sure[0], F.lit(" and "), sure[1]))
        .otherwise(F.concat(F.array_join(F.slice(sure, 1, n - 1), ", "), F.lit(", and "), F.get(sure, n - 1)))
    )
    return (
        F.when(F.size(found) == 0, F.lit("No significant security content detected"))
        .when(n > 0, F.concat(F.lit("Contains "), listed))
        .otherwise(F.concat(F.lit("Contains security-related content ("), F.array_join(found, ", "), F.lit(")")))
    )


def summary(ts: Column, categories: Sequence[C.Category] = C.CATEGORIES) -> Column:
    """Of an array of topics: categories_found, total_findings, confidence_score, key_findings, recommendations (sorted),
    description, and the topics without their findings."""
    found, sure = _found(ts), _sure(ts, categories)
    return F.struct(
        found.alias("categories_found"),
        _total(ts).alias("total_findings"),
        _score(ts).alias("confidence_score"),
        highlights(ts).alias("key_findings"),
        _advice(ts, categories).alias("recommendations"),
        let(F.struct(found.alias("f"), sure.alias("s")), lambda x: describe(x["f"], x["s"])).alias("description"),
        F.transform(ts, lambda t: F.struct(t["category"].alias("category"), t["confidence"].alias("confidence"), t["finding_count"].alias("finding_count"))).alias("categories"),
    )


def analysis(text: Column, categories: Sequence[C.Category] = C.CATEGORIES) -> Column:
    """The summary of a text as one struct; nothing is located or shuffled."""
    return let(topic_array(text, categories, located=False), lambda ts: summary(ts, categories))


def analyze(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", categories: Sequence[C.Category] = C.CATEGORIES) -> DataFrame:
    """One row a document with its summary."""
    # explode keeps the optimizer from copying the analysis into every column that is taken from it
    return df.select(F.col(id_col), F.explode(F.array(analysis(F.col(text_col), categories))).alias("a")).select(id_col, "a.*")


def key_findings(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", categories: Sequence[C.Category] = C.CATEGORIES, ascii_only: bool = False) -> DataFrame:
    """(id, position, finding): the key findings of ``analyze`` as rows."""
    found = let(topic_array(F.col(text_col), categories, False, ascii_only), highlights)
    return df.select(F.col(id_col), F.posexplode(found).alias("position", "finding"))


def entities(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", kinds: Sequence[str] | None = None, ascii_only: bool = False) -> DataFrame:
    """(id, kind, value, context, start): addresses, ports, protocols, domains, paths, user names and timestamps."""
    text = F.col(text_col)

    def of(kind: str, regex: str, group: int, case: bool) -> Column:
        pattern = flagged(regex, not case, ascii_only)

        def value(hit: Column) -> Column:
            got = F.regexp_extract(hit["text"], pattern, group) if group else hit["text"]
            if kind == "ports":
                return got.cast("int").cast("string")
            return F.upper(got) if kind == "protocols" else got

        hits = F.transform(spans(text, pattern), lambda x: F.struct(F.lit(kind).alias("kind"), value(x).alias("value"), context(text, x["start"], x["end"], 50).alias("context"), x["start"].alias("start")))
        return F.filter(hits, lambda h: h["value"].cast("int").between(1, 65535)) if kind == "ports" else hits

    chosen = [e for e in C.STRUCTURED if kinds is None or e[0] in kinds]
    return df.select(id_col, F.inline(F.concat(*[of(*e) for e in chosen])))


def best_text(candidates: Column) -> Column:
    """Of an array of texts the one of the highest score: words, share of word characters, words of over one letter; the
    first wins ties."""

    def score(t: Column) -> Column:
        # of a stripped text that isn't empty: no word is empty
        good = F.char_length(F.regexp_replace(t, r"[^\p{L}\p{N}\t\n\f\r ]+", ""))
        return let(F.split(t, f"{SPACES}+"), lambda words: F.size(words) + good / F.char_length(t) + F.size(F.filter(words, lambda w: F.char_length(w) > 1)))

    kept = F.filter(F.transform(candidates, lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: t != "")
    scored = F.transform(kept, lambda t, i: F.struct(score(t).alias("score"), (-i).alias("back"), t.alias("text")))
    return let(scored, lambda s: F.coalesce(F.array_max(s)["text"], F.lit("")))
