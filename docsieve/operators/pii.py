"""Detection, redaction and risk of personal data, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions import catalogs as C
from docsieve.functions.text import flagged, folded, let, literal_hits, normalize, post_process, spans, squeeze

MODES = ("replace", "mask", "remove")
FINDING = "array<struct<kind:string,type:string,text:string,start:int,end:int,confidence:double>>"


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")


def _lookup(default, key: Column, value: str) -> Column:
    """A table of the catalogs as a CASE; what isn't in it gets the default."""
    out = F.lit(default)
    for p in (*C.PERSONAL, *C.ENTITIES):
        if getattr(p, value) != default:
            out = F.when(key == p.name, F.lit(getattr(p, value))).otherwise(out)
    return out


def weight(key: Column) -> Column:
    return _lookup(1, key, "weight")


def placeholder(key: Column) -> Column:
    return _lookup("[PII]", key, "replacement")


def _found(kind: str, name: str, hits: Column, confidence: float | None) -> Column:
    sure = F.lit(confidence).cast("double")
    return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("type"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), sure.alias("confidence")))


def _guarded(text: Column, patterns: Sequence[C.Pattern], scan, none: Column, wrap) -> Column:
    """Scans a text for each pattern that it can match at all: most texts lack what most patterns need, and a search for a
    string or a digit is much cheaper than a scan."""

    def body(g: Column) -> Column:
        def may(p: C.Pattern) -> Column:
            if p.needs == C.DIGIT:
                return g["digit"]
            out = F.lit(False)
            for w in p.needs:
                out = out | F.contains(g["low"], F.lit(w))
            return out if p.needs else F.lit(True)

        return wrap([F.when(may(p), scan(p)).otherwise(none) for p in patterns])

    return let(F.struct(folded(text).alias("low"), text.rlike(r"\p{Nd}").alias("digit")), body)


def detect(text: Column, client_names: Sequence[str] = (), entities: Column | None = None, patterns: Sequence[C.Pattern] = C.PERSONAL, ascii_only: bool = False) -> Column:
    """Findings of a text: recognised entities (if a recogniser's column is given), then patterns in the catalog's order,
    then client names in alphabetical order; each with its place in code points. ``ascii_only``: see ``flagged``."""
    none = F.array().cast(FINDING)
    scan = lambda p: _found("pattern", p.name, spans(text, flagged(p.regex, True, ascii_only)), None).cast(FINDING)
    parts = [entities.cast(FINDING)] if entities is not None else []
    if patterns:
        parts.append(_guarded(text, patterns, scan, none, lambda xs: F.concat(*xs)))
    parts += [_found("client_name", "client_name", literal_hits(text, n), None) for n in sorted({n.lower() for n in client_names if n})]
    return F.concat(*parts).cast(FINDING)


def pattern_counts(text: Column, patterns: Sequence[C.Pattern] = C.PERSONAL, ascii_only: bool = False) -> Column:
    """A struct with the number of matches of each pattern; nothing is located."""
    scan = lambda p: F.coalesce(F.regexp_count(text, F.lit(flagged(p.regex, True, ascii_only))), F.lit(0)).cast("long")
    wrap = lambda xs: F.struct(*[x.alias(p.name) for x, p in zip(xs, patterns, strict=True)])
    return _guarded(text, patterns, scan, F.lit(0).cast("long"), wrap)


def with_counts(df: DataFrame, text_col: str = "text", *keep: str, ascii_only: bool = False) -> DataFrame:
    """The columns ``keep`` and one count column a pattern."""
    # explode keeps the optimizer from copying the scan into every column that is taken from it
    return df.select(*keep, F.explode(F.array(pattern_counts(F.col(text_col), ascii_only=ascii_only))).alias("__c")).select(*keep, "__c.*")


def counted_score() -> Column:
    """The risk score from the columns of ``with_counts``."""
    return sum((F.col(p.name) * p.weight for p in C.PERSONAL), F.lit(0)).cast("long")


def statistics(findings: Column) -> Column:
    """Totals, and counts by type of entities and of patterns."""
    of = lambda kind: F.filter(findings, lambda f: f["kind"] == kind)

    def counted(some: Column) -> Column:
        types = F.transform(some, lambda f: f["type"])
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)).cast("long"))))

    return F.struct(
        F.size(of("entity")).cast("long").alias("total_entities"),
        F.size(of("pattern")).cast("long").alias("total_patterns"),
        F.size(of("client_name")).cast("long").alias("total_client_names"),
        counted(of("entity")).alias("entity_types"),
        counted(of("pattern")).alias("pattern_types"),
    )


def replacement(text: Column, kind: Column, mode: str) -> Column:
    """What stands for a finding: its placeholder, as many asterisks, or nothing."""
    _check(mode)
    if mode == "replace":
        return placeholder(kind)
    return F.repeat(F.lit("*"), F.char_length(text)) if mode == "mask" else F.lit("")


def _fold(text: Column, ordered: Column, spaced: bool) -> Column:
    """Applies replacements from the last start to the first, each at its original place in what is left so far; so
    overlapping findings cut into each other's replacements."""
    alnum = lambda c: c.rlike(r"^[\p{L}\p{N}]$")

    def step(done: Column, x: Column) -> Column:
        before = F.substring(done, F.lit(1), x["start"])
        after = F.substring(done, x["end"] + 1, F.char_length(done))
        if not spaced:
            return F.concat(before, x["by"], after)
        pre = F.when((x["start"] > 0) & alnum(F.substring(done, x["start"], F.lit(1))), F.lit(" ")).otherwise(F.lit(""))
        post = F.when(alnum(F.substring(done, x["end"] + 1, F.lit(1))), F.lit(" ")).otherwise(F.lit(""))
        return F.concat(before, pre, x["by"], post, after)

    return F.aggregate(ordered, text, step)


def _ordered(findings: Column, by) -> Column:
    """Replacements by descending start; findings at one place keep their order."""
    rows = F.transform(findings, lambda f, i: F.struct((-f["start"]).alias("down"), i.alias("seq"), f["start"].alias("start"), f["end"].alias("end"), by(f).alias("by")))
    return F.array_sort(rows)


def redact(text: Column, mode: str = "replace", client_names: Sequence[str] = (), entities: Column | None = None, findings: Column | None = None, ascii_only: bool = False) -> Column:
    """The text with all findings replaced and white space squeezed; null stays null."""
    _check(mode)
    found = findings if findings is not None else detect(text, client_names, entities, ascii_only=ascii_only)
    return let(found, lambda fs: squeeze(_fold(text, _ordered(fs, lambda f: replacement(f["text"], f["type"], mode)), spaced=True)))


def risk_score(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0), lambda n, f: n + weight(f["type"])).cast("long")


def risk_level(score: Column) -> Column:
    out = F.lit(C.RISK_LEVELS[-1][0])
    for name, most in reversed(C.RISK_LEVELS[:-1]):
        out = F.when(score <= most, F.lit(name)).otherwise(out)
    return out


def advice(level: Column, has: dict[str, Column]) -> Column:
    """Recommendations by level, then for what was found."""
    base = F.array().cast("array<string>")
    for name, lines in C.RISK_ADVICE.items():
        base = F.when(level == name, F.array(*map(F.lit, lines))).otherwise(base)
    more = F.array(*[F.when(has[name], F.lit(line)) for name, line in C.FOUND_ADVICE])
    return F.concat(base, F.filter(more, lambda x: x.isNotNull()))


def risk(findings: Column) -> Column:
    """risk_level, risk_score, pii_count and recommendations of a text's findings."""
    score = risk_score(findings)
    of = F.transform(F.filter(findings, lambda f: f["kind"] == "pattern"), lambda f: f["type"])
    has = {name: F.array_contains(of, name) for name, _ in C.FOUND_ADVICE}
    return F.struct(risk_level(score).alias("risk_level"), score.alias("risk_score"), F.size(findings).cast("long").alias("pii_count"), advice(risk_level(score), has).alias("recommendations"))


def report(text: Column, client_names: Sequence[str] = (), entities: Column | None = None, ascii_only: bool = False) -> Column:
    """Findings, risk and a preview of the redacted text in one struct."""

    def of(fs: Column) -> Column:
        clean = redact(text, findings=fs)
        level = risk(fs)
        return F.struct(
            F.char_length(text).alias("text_length"),
            fs.alias("pii_findings"),
            statistics(fs).alias("statistics"),
            level.alias("risk_analysis"),
            let(clean, lambda c: F.when(F.char_length(c) > 500, F.concat(F.substring(c, 1, 500), F.lit("..."))).otherwise(c)).alias("cleaned_preview"),
            level["risk_level"].isin("HIGH", "CRITICAL").alias("requires_cleaning"),
        )

    return let(detect(text, client_names, entities, ascii_only=ascii_only), of)


def specialized_findings(text: Column, entities: Column | None = None) -> Column:
    """Findings of the specialised catalog: entities, names with titles, then patterns in order."""

    def scan(p: C.Pattern) -> Column:
        kind, sure = ("entity", 1.0) if p is C.TITLED_NAME else ("pattern", None)
        return _found(kind, p.name, spans(text, flagged(p.regex, False)), sure).cast(FINDING)

    parts = [entities.cast(FINDING)] if entities is not None else []
    parts.append(_guarded(text, (C.TITLED_NAME, *C.SPECIALIZED), scan, F.array().cast(FINDING), lambda xs: F.concat(*xs)))
    return F.concat(*parts).cast(FINDING)


def specialized_placeholder(kind: Column) -> Column:
    out = F.lit("[REDACTED]")
    for p in (*C.SPECIALIZED, C.Pattern("PERSON", "", "[PERSON]"), C.Pattern("ORG", "", "[ORG]"), C.Pattern("DATE", "", "[DATE]")):
        out = F.when(kind == p.name, F.lit(p.replacement)).otherwise(out)
    return out


def redact_specialized(text: Column, mode: str = "replace", entities: Column | None = None) -> Column:
    """The specialised redaction: no spacing, white space stays; empty texts pass."""
    _check(mode)
    by = lambda f: specialized_placeholder(f["type"]) if mode == "replace" else replacement(f["text"], f["type"], mode)
    # most strings of a nested schema hold nothing, and have nothing to fold
    fold = lambda fs: F.when(F.size(fs) == 0, text).otherwise(_fold(text, _ordered(fs, by), spaced=False))
    return F.when(text == "", text).otherwise(let(specialized_findings(text, entities), fold))


def clean_line(text: Column, mode: str = "replace", client_names: Sequence[str] = (), ascii_only: bool = False) -> Column:
    """A line of a scanned page: normalised, redacted, spaced again."""
    return let(normalize(text), lambda t: post_process(redact(t, mode, client_names, ascii_only=ascii_only)))


def clean_nested(df: DataFrame, mode: str = "replace") -> DataFrame:
    """The specialised redaction of every string in a nested schema; lists directly inside lists stay as they are."""

    def walk(column: Column, kind: T.DataType, in_list: bool = False) -> Column:
        if isinstance(kind, T.StringType):
            return redact_specialized(column, mode)
        if isinstance(kind, T.StructType):
            return F.when(column.isNotNull(), F.struct(*[walk(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.MapType):
            return F.transform_values(column, lambda _, v: walk(v, kind.valueType))
        if isinstance(kind, T.ArrayType) and not in_list:
            return F.transform(column, lambda x: walk(x, kind.elementType, True))
        return column

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def clean_columns(df: DataFrame, mode: str = "replace", client_names: Sequence[str] = (), columns: dict[str, str] = C.SHEET_COLUMNS) -> DataFrame:
    """Columns known to hold personal data are replaced whole; other strings of over two characters are redacted."""
    _check(mode)

    def one(f: T.StructField) -> Column:
        column = F.col(f"`{f.name}`")
        kind = columns.get(f.name.lower())
        if kind is not None:
            text = F.coalesce(column.cast("string"), F.lit("None"))
            return replacement(text, F.lit(kind), mode).alias(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.when(F.char_length(column) > 2, redact(column, mode, client_names)).otherwise(column).alias(f.name)
        return column.alias(f.name)

    return df.select(*map(one, df.schema.fields))


def column_statistics(df: DataFrame, client_names: Sequence[str] = (), columns: dict[str, str] = C.SHEET_COLUMNS) -> DataFrame:
    """One row: total_fields, fields_with_pii, pii_instances over all cells, from one pass."""
    known, free = F.lit(0), F.lit(0)
    with_pii, total = [], F.lit(len(df.columns))
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if f.name.lower() in columns:
            known = known + 1
            with_pii.append(F.lit(1))
        elif isinstance(f.dataType, T.StringType):
            n = F.when(F.char_length(column) > 2, F.size(detect(column, client_names))).otherwise(F.lit(0))
            n = F.coalesce(n, F.lit(0))
            free = free + n
            with_pii.append((n > 0).cast("int"))
    some = sum(with_pii, F.lit(0))
    return df.select(total.alias("t"), some.alias("s"), (known + free).alias("i")).agg(F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("total_fields"), F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("fields_with_pii"), F.coalesce(F.sum("i"), F.lit(0)).cast("long").alias("pii_instances"))


def redact_sheet(df: DataFrame, sensitive: dict[str, str], replacements: dict[str, str], mode: str = "replace") -> DataFrame:
    """Whole-column redaction of a sheet: non-null cells of a sensitive column get its constant, or null in ``remove``."""
    _check(mode)

    def one(name: str) -> Column:
        kind = sensitive.get(name.lower())
        column = F.col(f"`{name}`")
        if kind is None:
            return column
        return (F.lit(None).cast("string") if mode == "remove" else F.when(column.isNotNull(), F.lit(replacements.get(kind, "[REDACTED]")))).alias(name)

    return df.select(*map(one, df.columns))


def sheet_statistics(df: DataFrame, sensitive: dict[str, str]) -> DataFrame:
    """(column_name, pii_type, cells): non-null cells of each sensitive column, from one aggregation."""
    names = [n for n in df.columns if n.lower() in sensitive]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, pii_type string, cells long")
    counted = df.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(sensitive[n.lower()]).alias("pii_type"), F.col(f"`{n}`").alias("cells")) for n in names])
    return counted.select(F.inline(rows))
