"""Column functions on text: spans of matches, contexts, words, white space."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and str.strip see it.
SPACES = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: The same, as characters.
SPACE_CHARACTERS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

SPAN = "array<struct<text:string,start:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where the optimizer would copy its expression to every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flagged(regex: str, ignore_case: bool, ascii_only: bool = False) -> str:
    """The regex with Unicode classes, so that it matches what Python's ``re`` does; or with ASCII ones, as SQL engines do."""
    if ascii_only:
        return ("(?i)" if ignore_case else "") + _ascii(regex, ignore_case)
    return ("(?iuU)" if ignore_case else "(?U)") + regex


_TOKEN = re.compile(r"\[\^?(?:\\.|[^\]\\])*\]|\\.|\(\?[:=]|.", re.S)
_BORDER = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def _heads(tokens: list[str]) -> list[str]:
    """The tokens of which one must come first, where that is plain to see; else none."""
    choices = [tokens]
    if tokens and tokens[0] in ("(", "(?:"):
        end = tokens.index(")")
        if tokens[end + 1 : end + 2] in (["?"], ["*"]) or {"(", "(?:"} & set(tokens[1:end]):
            return []
        cuts = [0, *(i for i in range(1, end) if tokens[i] == "|"), end]
        choices = [tokens[a + 1 : b] for a, b in itertools.pairwise(cuts)]
    plain = lambda c: c and c[0] != r"\b" and (len(c[0]) > 1 and c[0][0] in "[\\" or c[0].isalnum() or c[0] == "/") and c[1:2] not in (["?"], ["*"]) and c[1:3] != ["{", "0"]
    return [c[0] for c in choices] if all(map(plain, choices)) else []


def _ascii(regex: str, ignore_case: bool) -> str:
    """A regex without flags of its own as RE2 reads it, in Java's syntax: digits, white space, word characters and borders
    of words are ASCII, a dot stops at newlines only, ``$`` is the very end. Without regard to case, s and k match the long s
    and the Kelvin sign too. Java's own ``\\b`` takes letters beyond ASCII for word characters in some versions."""
    alike = {"s": "\u017f", "k": "\u212a"} if ignore_case else {}
    fixed = {r"\s": r"[\t\n\f\r ]", ".": r"[^\n]", "$": r"\z"}
    tokens = _TOKEN.findall(regex)

    def one(token: str) -> str:
        if token[0] == "[" and len(token) > 1 or token == r"\w":
            head, body = re.fullmatch(r"(\[\^?)(.*)\]", token, re.S).groups() if token[0] == "[" else ("[", token)
            more = "".join(x for c, x in alike.items() if re.match(f"[{body}]", c, re.I | re.A))
            # in front, where a hyphen that ends the class makes no range of them
            return head + more + re.sub("^-", r"\\-", body.replace(r"\s", r"\t\n\f\r ")) + "]"
        return f"[{token}{alike[token.lower()]}]" if token.lower() in alike else fixed.get(token, token)

    def border(i: int) -> str:
        # before what opens a pattern it is tried at every character, so what must follow is looked at first
        heads = _heads(tokens[i + 1 :]) if i == 0 or tokens[i - 1] == "|" else []
        if not heads:
            return _BORDER
        beyond = any(re.match(h, chr(c), re.I | re.A) for h in heads for c in range(128) if not re.match(r"\w", chr(c)))
        beyond = beyond or any(re.match(h, c, re.I | re.A) for h in heads for c in alike)
        return f"(?=[{''.join(dict.fromkeys(map(one, heads)))}])" + (_BORDER if beyond else r"(?<!\w)")

    return "".join(border(i) if t == r"\b" else one(t) for i, t in enumerate(tokens))


def lowered(text: Column) -> Column:
    """The text in lower case, with as many code points: Spark makes two of a capital I with a dot, SQL engines an i."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def strip(text: Column) -> Column:
    """White space off both ends; no regex, which would try a long run inside the text again from each of its characters."""
    return F.trim(text, F.lit(SPACE_CHARACTERS))


def squeeze(text: Column) -> Column:
    """White space runs become one space; none stays at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACES}+", " "))


def spans(text: Column, regex: str) -> Column:
    """All matches with their places (code points from 0), in order, without a UDF.

    What lies between matches gives the places: the i-th starts after the first i gaps and the matches before it. No
    pattern may match the empty string. Texts without a match are scanned once.
    """
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    none = F.lit(None).cast(SPAN)
    # split compiles its regex for every text, but not a single character; U+FFFF is none, so texts hardly hold it
    gaps = F.when(F.contains(text, F.lit("\uffff")), F.split(text, regex, -1)).otherwise(F.split(F.regexp_replace(text, regex, "\uffff"), "\uffff", -1))

    def place(m: Column) -> Column:
        lengths = F.transform(F.arrays_zip(F.transform(gaps, F.char_length).alias("g"), F.transform(m, F.char_length).alias("m")), lambda x: F.struct(x["g"].alias("g"), F.coalesce(x["m"], F.lit(0)).alias("m")))

        def starts(n: Column) -> Column:
            ends = lambda i: F.aggregate(F.slice(n, 1, i + 1), F.lit(0), lambda a, x: a + x["g"] + x["m"])
            return F.transform(m, lambda x, i: F.struct(x.alias("text"), (ends(i) - F.char_length(x)).alias("start"), ends(i).alias("end")))

        return F.when(F.size(m) > 0, let(lengths, starts)).otherwise(F.coalesce(none, F.array().cast(SPAN)))

    return F.when(text.isNull(), F.array().cast(SPAN)).otherwise(let(found, place))


def context(text: Column, start: Column, end: Column, around: int = 100) -> Column:
    """The stretch of ``text`` around a place, stripped, with dots where it is cut."""
    first = F.greatest(F.lit(0), start - around)
    last = F.least(F.char_length(text), end + around)
    return F.concat(F.when(first > 0, F.lit("...")).otherwise(F.lit("")), strip(F.substring(text, first + 1, last - first)), F.when(last < F.char_length(text), F.lit("...")).otherwise(F.lit("")))


def sentences(text: Column) -> Column:
    """Stretches up to and with their closing marks, stripped, without empty ones."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def word_count(text: Column) -> Column:
    """Words and marks, each mark by itself."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).cast("long")


def half_up(value: Column, digits: int) -> Column:
    """Rounded on the double itself, alike in every engine."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def literal_hits(text: Column, name: str) -> Column:
    """Places of ``name`` in the text, whatever the case; hits may overlap. The lower-cased text is cut before every hit, so
    the lengths of the pieces give the places in one pass."""
    low, key = lowered(text), name.lower()
    n = len(key)

    def place(pieces: Column) -> Column:
        def starts(sizes: Column) -> Column:
            at = F.transform(pieces, lambda x, i: F.when((i > 0) | F.startswith(low, F.lit(key)), F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, y: a + y)))
            return F.transform(F.filter(at, lambda p: p.isNotNull()), lambda p: F.struct(F.substring(text, p + 1, F.lit(n)).alias("text"), p.alias("start"), (p + n).alias("end")))

        return let(F.transform(pieces, F.char_length), starts)

    cut = F.split(low, f"(?={re.escape(key)})", -1)
    return F.when(F.contains(low, F.lit(key)), let(cut, place)).otherwise(F.array().cast(SPAN))


def normalize(text: Column) -> Column:
    """Mends what recognition of scanned text leaves: stray tildes and hyphens in words, spacing of marks."""
    t = F.regexp_replace(text, r"[\r\n\t\f\x0B]+", " ")
    t = F.regexp_replace(t, r"(?U)(?<=\w)~(?=\w)", "")
    t = F.regexp_replace(t, r"(?U)(?<=\w)-(?=\w)", " ")
    t = F.regexp_replace(t, rf"{SPACES}+", " ")
    return strip(F.regexp_replace(t, rf"{SPACES}*([.,!?]){SPACES}*", "$1 "))


def post_process(text: Column) -> Column:
    """Spaces around placeholders and behind full stops."""
    t = F.regexp_replace(text, rf"{SPACES}*\[([^\]]+)\]{SPACES}*", " [$1] ")
    t = F.regexp_replace(t, rf"{SPACES}+", " ")
    return strip(F.regexp_replace(t, r"(?U)\.(?=\w)", ". "))


def folded(text: Column) -> Column:
    """The text for the search of lower-case ASCII words: letters that match ASCII ones without regard to case become those."""
    low = lowered(text)
    for other, letter in (("ſ", "s"), ("ı", "i"), ("K", "k")):
        low = F.replace(low, F.lit(other), F.lit(letter))
    return low


def word_guard(regex: str) -> tuple[str, ...]:
    """Strings of which a text must hold one to match a pattern that begins with a choice of words, or a word; else none."""
    m = re.match(r"\\b(?:\(\?:([^()]+)\)|([a-z][a-z-]+))", regex)
    if not m:
        return ()
    words = [re.match(r"[a-z0-9-]*", w)[0] for w in (m[1] or m[2]).split("|")]
    return tuple(words) if all(words) else ()
