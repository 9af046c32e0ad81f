"""Text functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Question words, filler and glue of German and English that carry no meaning in a search.
STOPWORDS = (
    "der die das den dem des ein eine einen einem eines und oder aber ist sind war waren wird werden hat haben kann können "
    "für mit von zu auf in im an am als auch sich nicht man wie was wenn dass es sie er ich wir bei "
    "the a an and or but is are was were be of to in on at for with that this it as "
    "welche welcher welches welchen wer wann wo warum wieso weshalb wodurch womit wofür worum wozu "
    "gibt geben gab gibts sagt sagte steht macht soll sollen muss müssen darf dürfen will wollen "
    "hier dort dabei damit dazu daran davon denn noch schon nur auch sehr mehr etwa also "
    "which what when where why how who does do did can could should would there about some"
).split()
# Suffixes, the first that leaves five letters is cut.
SUFFIXES = ("ungen", "enen", "erin", "innen", "chen", "lein", "isch", "en", "er", "es", "em", "et", "e", "n", "s")
# Parts at which long compounds are split.
COMPOUND = "befragung|erfahrung|kompetenz|veranstaltung|bewertung|prüfung|klausur|ergebnis|unterricht|lehrende[nr]?|studier|schulung|beratung|verwaltung|entwicklung|forschung|bildung|nutzung|anwendung|sitzung|modul"
#: White space as Unicode and the usual text tools see it; engines' own \s differ.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NO_WS = "[^" + WS[1:]
#: The same characters one by one.
WS_CHARACTERS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
DIGITS = r"^[\p{Nd}²³¹⁰-⁹₀-₉]+$"
WORD = r"[\p{L}\p{N}_]+"
POSITIONAL = r"^(S\. \d+|Folie \d+|\d+(:\d+)?:\d{2})$"
CHUNK, OVERLAP = 900, 150


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def size(c: Column | str) -> Column:
    return F.length(_col(c)).cast("bigint")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(_col(c), F.lit(WS_CHARACTERS))


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(_col(c), f"{WS}+", " "))


def capitals(c: Column | str) -> Column:
    """In capitals letter by letter: one whose capital is several letters (sharp s, ligatures) stays as it is."""
    pieces = F.split(_col(c), r"(?<=[^\x00-\x7F])|(?=[^\x00-\x7F])", -1)
    return F.array_join(F.transform(pieces, lambda x: F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(x)), "")


def tidy(c: Column | str) -> Column:
    """Hard blanks as blanks, runs of blanks as one, at most one empty line."""
    c = F.regexp_replace(_col(c), " ", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


#: Names that a reader of HTML takes without their semicolon, the longest first.
_LOOSE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: What numbers 128 to 159 mean on the web, in order; a blank is a number without a meaning.
_WEB = "\u20ac \u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152 \u017d  \u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153 \u017e\u0178"


def entities(c: Column | str) -> Column:
    """Named and numeric character references resolved, as a reader of HTML does."""
    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")  # one literal: a plan holds it some ten times

    def resolved(piece: Column) -> Column:
        return once(F.regexp_extract(piece, r"^(#\d+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1), lambda mark: F.when(mark == "", F.concat(F.lit("&"), piece)).otherwise(of(piece, mark)))

    def of(piece: Column, mark: Column) -> Column:
        rest = lambda m: F.substring(piece, F.length(m) + 1, F.length(piece))
        digits = F.regexp_extract(mark, r"^#[xX]?([0-9a-fA-F]+)", 1)
        digits = F.regexp_replace(digits, "^0+(?=.)", "")
        number = F.when(F.length(digits) > 8, F.lit(1 << 40)).when(mark.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
        web = F.substring(F.lit(_WEB), (number - 127).cast("int"), F.lit(1))
        beyond = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        char = F.when(beyond, F.lit("\ufffd")).when(number.between(128, 159) & (web != " "), web).otherwise(plain)
        loose = F.regexp_extract(mark, "^(" + "|".join(_LOOSE) + ")", 1)
        return (
            F.when(mark.startswith("#"), F.concat(char, rest(mark)))
            .when(F.map_contains_key(named, mark), F.concat(F.element_at(named, mark), rest(mark)))
            .when(loose != "", F.concat(F.element_at(named, loose), rest(loose)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    text = lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), resolved), ""))
    return once(_col(c), lambda c: F.when(c.contains("&"), once(F.split(c, "&", -1), text)).otherwise(c))


def strip_html(c: Column | str) -> Column:
    """Tags as blanks, character references resolved, white space collapsed."""
    return collapse(entities(F.regexp_replace(_col(c), "<[^>]+>", " ")))


def stem(c: Column) -> Column:
    """The first suffix cut that leaves at least five letters."""
    out = F.when(F.length(c) <= 5, c)
    for last in dict.fromkeys(s[-1] for s in SUFFIXES):  # most words are too short, or end in none of a few letters
        own = None
        for s in (s for s in SUFFIXES if s.endswith(last)):
            test = c.endswith(s) & (F.length(c) >= 5 + len(s))
            cut = F.substring(c, F.lit(1), F.length(c) - len(s))
            own = F.when(test, cut) if own is None else own.when(test, cut)
        out = out.when(c.endswith(last), own.otherwise(c))
    return out.otherwise(c)


def _with_stem(c: Column) -> Column:
    s = stem(c)
    return F.when(s != c, F.array(c, s)).otherwise(F.array(c))


_built: dict[tuple[str, str], Column] = {}


def built(name: str, make: Callable[[], Column]) -> Column:
    """A long expression over named columns, put together once a session: that takes a second."""
    key = (SparkContext.getOrCreate().applicationId, name)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def tokens(c: Column | str) -> Column:
    """Search terms: words, their stems, and the parts of long compounds (repeats stay)."""
    return built(f"tokens {c}", lambda: _tokens(c)) if isinstance(c, str) else _tokens(c)


def _tokens(c: Column | str) -> Column:
    words = F.filter(F.transform(F.regexp_extract_all(_col(c), F.lit(WORD), F.lit(0)), F.lower), kept)
    return F.flatten(F.transform(words, expanded))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """An array that is made of a value which is made once and used several times."""
    return F.flatten(F.transform(F.array(value), f))


def counted(c: Column | str) -> Column:
    """Different search terms of a text, as an array of (``term``, its count ``tf``, ``len``: terms in all), made within the row."""
    begins = lambda s: F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)))
    runs = lambda s, b: F.transform(b, lambda p, i: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(b, i + 1), F.size(s)) - p).cast("bigint").alias("tf"), F.size(s).cast("bigint").alias("len")))
    return _bound(F.sort_array(tokens(c)), lambda s: _bound(begins(s), lambda b: runs(s, b)))


def by_term(c: Column | str) -> Column:
    """Chunks (array of ``slot`` and ``terms`` as counted) by term: an array of (``term``, ``bits`` of its slots, ``top`` share of a chunk, ``hits`` in order of slots)."""
    hits = F.transform(_col(c), lambda x: F.transform(x["terms"], lambda t: F.struct(t["term"].alias("term"), x["slot"].alias("slot"), t["tf"].alias("tf"), t["len"].alias("len"))))
    begins = lambda s: F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["term"] != x["term"]), i)))
    hit = lambda h: F.struct(h["slot"].alias("slot"), h["tf"].alias("tf"), h["len"].alias("len"))
    run = lambda s, p, end: F.transform(F.slice(s, p + 1, end - p), hit)
    runs = lambda s, b: F.transform(b, lambda p, i: F.struct(F.get(s, p)["term"].alias("term"), run(s, p, F.coalesce(F.get(b, i + 1), F.size(s))).alias("hits")))
    bits = lambda h: F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["slot"])))
    top = lambda h: F.array_max(F.transform(h, lambda x: x["tf"] / x["len"]))
    told = lambda r: F.struct(r["term"].alias("term"), bits(r["hits"]).alias("bits"), top(r["hits"]).alias("top"), r["hits"].alias("hits"))
    return F.transform(_bound(F.sort_array(F.flatten(hits)), lambda s: _bound(begins(s), lambda b: runs(s, b))), told)


def kept(w: Column) -> Column:
    """Whether a lower-cased word is searched for."""
    return (F.length(w) >= 2) & ~w.rlike(DIGITS) & ~w.isin(STOPWORDS)


def expanded(w: Column) -> Column:
    """The terms of one kept word."""
    parts = F.transform(F.split(F.regexp_replace(w, f"(?i)({COMPOUND})", "\u0001$1\u0001"), "\u0001"), strip)
    parts = F.filter(parts, lambda p: (F.length(p) >= 4) & (p != w) & ~p.isin(STOPWORDS))
    return F.when(F.length(w) > 11, F.concat(_with_stem(w), F.flatten(F.transform(parts, _with_stem)))).otherwise(_with_stem(w))


def chunks(c: Column | str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed greedily into chunks; longer ones cut with an overlap."""
    c = _col(c)
    paragraphs = F.filter(F.transform(F.split(c, f"\n{WS}*\n"), strip), lambda p: p != "")
    none = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        b, o = acc["b"], acc["o"]
        fits = F.length(b) + F.length(p) + 2 <= chunk
        flushed = F.when(b != "", F.concat(o, F.array(b))).otherwise(o)
        long = F.length(p) > chunk
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(p) - 1, F.lit(0)), F.lit(chunk - overlap)), lambda i: F.substring(p, i + 1, F.lit(chunk)))
        joined = F.when(b == "", p).otherwise(F.concat(b, F.lit("\n\n"), p))
        return F.struct(
            F.when(fits, joined).when(long, F.lit("")).otherwise(p).alias("b"),
            F.when(fits, o).when(long, F.concat(flushed, cut)).otherwise(flushed).alias("o"),
        )

    def closed(a: Column) -> Column:
        rest = F.when(a["b"] != "", F.concat(a["o"], F.array(a["b"]))).otherwise(a["o"])
        return F.when((a["b"] == "") & (F.size(a["o"]) == 0), F.array(F.substring(c, 1, chunk))).otherwise(rest)

    return F.aggregate(paragraphs, F.struct(F.lit("").alias("b"), none.alias("o")), step, closed)


def doc_id(c: Column | str) -> Column:
    """Short stable key of an activity."""
    return F.substring(F.sha1(_col(c).cast("binary")), 1, 10)


def namespace(c: Column | str) -> Column:
    """What stands before the first colon of a course reference, ``unknown`` without a colon."""
    c = _col(c)
    return F.when(c.contains(":"), F.split_part(c, F.lit(":"), F.lit(1))).otherwise("unknown")


def stamp(seconds: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def citation(title: str, locator: str, course: str, folder: str) -> Column:
    """``title, locator (course / folder)``; blanks are left out."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    head = F.concat_ws(", ", filled(title), filled(locator))
    tail = F.concat_ws(" / ", filled(course), filled(folder))
    return F.when(tail != "", F.concat(head, F.lit(" ("), tail, F.lit(")"))).otherwise(head)


def quoted(c: Column) -> Column:
    """Percent-encoded, blanks as %20 and slashes kept."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def positional(c: Column | str) -> Column:
    """Whether a locator names a page, a slide or a time."""
    return _col(c).rlike(POSITIONAL)


def cited(answer: Column | str, n_sources: Column) -> Column:
    """Valid source numbers that an answer cites, ascending."""
    found = F.regexp_extract_all(_col(answer), F.lit(r"[\[［【]\s*(\d+)\s*[\]］】]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: (x >= 1) & (x <= n_sources))))


def renumbered(answer: Column | str, numbers: Column) -> Column:
    """The answer with valid citations numbered from 1 in ASCII brackets; others stay."""
    answer = _col(answer)
    mark = F.regexp_replace(answer, r"([\[［【]\s*\d+\s*[\]］】])", "\u0001$1\u0001")

    def piece(x: Column) -> Column:
        n = F.regexp_extract(x, r"^[\[［【]\s*(\d+)\s*[\]］】]$", 1).try_cast("int")
        at = F.array_position(numbers, n)
        return F.when(at > 0, F.concat(F.lit("["), at.cast("string"), F.lit("]"))).otherwise(x)

    return F.when(F.size(numbers) == 0, answer).otherwise(F.array_join(F.transform(F.split(mark, "\u0001"), piece), ""))


def clean_ocr(c: Column | str) -> Column:
    """A reader's text without its reasoning or a fence around it; ``NO_TEXT`` is empty."""
    c = strip(F.regexp_replace(_col(c), r"(?is)<think>.*?</think>", ""))
    c = F.when(c.rlike(r"(?s)^```[A-Za-z]*\n.*\n```$"), strip(F.regexp_replace(c, r"(?s)^```[A-Za-z]*\n(.*)\n```$", "$1"))).otherwise(c)
    return F.when(c == "NO_TEXT", "").otherwise(c)


def snippet(c: Column | str, width: int = 320) -> Column:
    """A preview cut at a word, with a mark if it begins inside a sentence."""
    c = strip(c)
    c = F.when(c.rlike(r"^[a-zäöüß.,;:)\]]"), F.concat(F.lit("… "), c)).otherwise(c)
    return F.when(F.length(c) > width, F.concat(F.regexp_replace(F.substring(c, 1, width), f"{WS}+{NO_WS}*\\z", ""), F.lit(" …"))).otherwise(c)
