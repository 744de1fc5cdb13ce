"""Cleaning of extracted text: from plain normalisation to dropping lines and blocks that carry no content.

All of it is regular expressions and array functions, so it runs in the JVM, one row at a time and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import let

# Fixed value: blanks of any script, as (?U)\s has them.
WHITE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Patterns of lines, blocks and sections that carry no content. A line matches as a whole unless the pattern begins with .*
DOTS = r"\s*(?:\.|·|•|_|-){4,}\s*"
PAGE = r"(?i)\s*(?:page\s+)?\d+\s*/\s*\d+\s*"
PAGE_OR_NUMBER = r"(?i)\s*(?:page\s+)?\d+\s*(?:/\s*\d+)?\s*"
HEADER = r"(?i)\s*(?:ESC Guidelines(?: \d+)?|ESC 20\d{2}|European Heart Journal.*|Supplementary (?:Table|Figure|text).*)\s*"
HEADER_OR_DATA = r"(?i)\s*(?:European Heart Journal.*|ESC Guidelines(?: \d+)?|ESC 20\d{2}|Supplementary (?:data|figure|table|text).*)\s*"
CONTENTS = r"(?i)\s*(?:\d+(?:\.\d+)*\s+)?[A-Z]?[A-Za-z][^\n]{5,}\.{3,}\s*\d+\s*"
AUTHORS = "Authors?/Task Force Members?|Document Reviewers?|Author/Task Force Member affiliations?|ESC Clinical Practice Guidelines Committee|Working Groups:|Councils:|Associations:|Patient Forum:"
RIGHTS = "Disclaimer:|The ESC Guidelines represent|No commercial use is authorized|Permission can be obtained|All rights reserved|This article has been co-published|The articles are identical except"
MORE_RIGHTS = RIGHTS + "|Published on behalf of|For permissions, please email"
SYMBOLS = r"[^\p{L}\p{N}]{3,}"
URL = r"(?i)(?=[hw])\b(?:https?://|www\.)\S+"
EMAIL = r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"
DOI = r"(?i)(?=d)\bdoi\s*:\s*\S+"
DOI_URL = r"(?i)(?=[hd])\b(?:https?://)?doi\.org/\S+"
JOURNALS = "N Engl J Med|Lancet|Eur Heart J|JAMA|Circulation"
MORE_JOURNALS = JOURNALS + "|BMJ|Chest"
ABBREVIATION = r"[A-Z][A-Z0-9/\-+]{1,20}\s+[A-Z][^\n]{2,}"
CAPITALS = r"[A-Z0-9/\-+()., ]+"
MARKERS = "all rights reserved|no commercial use is authorized|permission can be obtained|disclaimer:|document reviewers:|authors/task force members|patient forum:|author/task force member affiliations".split("|")
MORE_MARKERS = "all rights reserved|no commercial use is authorized|permission can be obtained|document reviewers|authors/task force members|author/task force member affiliations|patient forum|published on behalf of|for permissions, please email|conflict of interest|supplementary data".split("|")


@dataclass(frozen=True)
class Rules:
    """What tells the two deep strategies apart."""

    noise: tuple[str, ...]
    url_below: int
    repeated_upto: int
    capitals_below: int
    reference: str
    journals: str
    markers: tuple[str, ...]
    headers: bool
    doi_urls: bool


DEEP = Rules(
    (DOTS, PAGE, HEADER, CONTENTS, rf"(?i)\s*(?:{AUTHORS}).*", rf"(?i)\s*(?:{RIGHTS}).*", SYMBOLS), 200, 80, 80,
    rf"(?i)\s*\d+\.\s+[A-Z][A-Za-z'`’\-]+.*(?:\d{{4}}|{JOURNALS}).*", JOURNALS, tuple(MARKERS), False, False,
)
GUIDELINE = Rules(
    (DOTS, PAGE_OR_NUMBER, HEADER_OR_DATA, CONTENTS, rf"(?i)\s*(?:{AUTHORS}|Affiliations?:).*", rf"(?i)\s*(?:{MORE_RIGHTS}).*"), 250, 100, 100,
    rf"(?i)\s*\d+\.\s+.+(?:\d{{4}}|{MORE_JOURNALS}).*", MORE_JOURNALS, tuple(MORE_MARKERS), True, True,
)


def _whole(x: Column, pattern: str) -> Column:
    return x.rlike(f"^(?:{pattern})$")


def _replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def _has(text: Column, signs: Iterable[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(x)) for x in signs))


def _where(text: Column, signs: Iterable[str], *steps: tuple[str, str]) -> Column:
    """_replaced() in texts that have one of some signs, without which the steps find nothing.

    Signs are looked for among the bytes, far faster than any pattern, and the text is computed once, though it is read several times.
    """
    return let(text, lambda t: F.when(_has(t, signs), _replaced(t, *steps)).otherwise(t))


def _where_low(text: Column, *cases: tuple) -> Column:
    """One _where() after another for cases (signs, *steps) with signs in lower case, for those in any case. What a step puts in makes no sign of a later one."""

    def all_(t: Column, low: Column) -> Column:
        out = t
        for signs, *steps in cases:
            out = F.when(_has(low, signs), _replaced(out, *steps)).otherwise(out)
        return out

    return let(text, lambda t: let(F.lower(t), lambda low: all_(t, low)))


def _stripped(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def _newlines(text: Column) -> Column:
    return _where(F.coalesce(text, F.lit("")), "\x00\r", (r"\x00", ""), (r"\r\n?", "\n"))


def _squashed(text: Column) -> Column:
    """Runs of spaces and tabs as one space; single spaces, which most are, stay without being matches."""
    return _where(text, ("\t", "  "), (r"[ \t]{2,}|\t", " "))


def basic(text: Column) -> Column:
    """Without NUL, line ends as LF, runs of blanks as one, at most one empty line in a row; null gives the empty text."""
    return _stripped(_replaced(_squashed(_newlines(text)), (r"\n{3,}", "\n\n")))


def noisy(line: Column, rules: Rules) -> Column:
    """Is a line one of those that carry no content? What is rare is looked for only where a sign of it is there."""
    return let(F.lower(line), lambda low: _noisy(line, low, rules))


def _noisy(line: Column, low: Column, rules: Rules) -> Column:
    plain = "|".join(f"(?:{p})" for p in rules.noise if p != CONTENTS)
    out = _whole(line, plain) | (_has(line, ["..."]) & _whole(line, CONTENTS))
    out = out | ((F.length(line) < rules.url_below) & _has(low, ("://", "www.")) & line.rlike(URL))
    out = out | (_has(line, "@") & line.rlike(EMAIL)) | _has(low, ("doi:", "doi.org/") if rules.doi_urls else ["doi:"])
    return (line != "") & (out | ((F.length(line) <= 2) & ~line.rlike("[A-Za-z0-9]")))


def unrepeated(lines: Column, upto: int) -> Column:
    """Without the short lines that occur three times and more, whatever their case: headers and footers of pages."""
    line = lambda x, i: F.struct(F.when((x != "") & (F.length(x) <= upto), F.lower(x)).alias("key"), i.alias("at"), x.alias("line"))

    def rest(ls: Column) -> Column:
        # In order, a line occurs three times if it equals both of some two next to it.
        near = lambda i, *steps: [F.get(ls, i + k)["key"] for k in steps]
        often = lambda x, i: (x["key"] == near(i, -2)[0]) | (x["key"] == near(i, 2)[0]) | reduce(and_, (x["key"] == y for y in near(i, -1, 1)))
        return F.filter(ls, lambda x, i: ~F.coalesce(often(x, i), F.lit(False)))

    kept = F.transform(let(F.sort_array(F.transform(lines, line)), rest), lambda x: F.struct(x["at"], x["line"]))
    return F.transform(F.sort_array(kept), lambda x: x["line"])


def low_value(block: Column, rules: Rules) -> Column:
    """Is a block of lines a list of references, of abbreviations, or boilerplate?"""
    return let(F.filter(F.split(block, "\n", -1), lambda x: F.trim(x) != ""), lambda lines: _low_value(block, lines, rules))


def _low_value(block: Column, lines: Column, rules: Rules) -> Column:
    n = F.size(lines)
    hits = lambda f: F.size(F.filter(lines, f))
    many = lambda least, part: F.greatest(F.lit(least), F.floor(n / part))
    journals = rules.journals.split("|")
    named = hits(lambda x: _has(x, journals) & x.rlike(rf"\b(?:{rules.journals})\b")) >= many(4, 3)
    references = named | (hits(lambda x: _whole(x, rules.reference)) >= many(4, 3))
    short = hits(lambda x: _whole(x, ABBREVIATION)) >= many(6, 2)
    abbreviations = short | (hits(lambda x: (F.length(x) < rules.capitals_below) & _whole(x, CAPITALS)) >= many(6, 2))
    if rules.headers:
        references = references | block.rlike(r"(?im)^\s*(?:references|bibliography)\s*$")
        abbreviations = abbreviations | block.rlike(r"(?im)^\s*abbreviations(?: and acronyms)?\s*$")
    found = let(F.lower(block), lambda low: F.filter(F.array(*map(F.lit, rules.markers)), lambda m: F.contains(low, m)))
    return ((n >= 4) & references) | ((n >= 8) & abbreviations) | (F.size(found) >= 2)


def _body(text: Column, rules: Rules) -> Column:
    """Text of the lines and blocks that carry content."""
    marks = "–—•" if rules is DEEP else "•"
    text = _squashed(_where(text, marks, (f"[{marks}]", "-")))
    lines = F.transform(F.split(text, "\n", -1), _stripped)
    lines = unrepeated(F.filter(lines, lambda x: ~noisy(x, rules)), rules.repeated_upto)
    blocks = F.filter(F.split(F.array_join(lines, "\n"), r"\n{2,}", -1), lambda b: F.trim(b) != "")
    blocks = F.transform(blocks, lambda b: F.trim(b, F.lit("\n")))
    return F.array_join(F.filter(blocks, lambda b: ~low_value(b, rules)), "\n\n")


def _unhyphened(text: Column) -> Column:
    return _where(text, ["-\n"], (r"(?U)((?=.-\n)\w)-\n(\w)", "$1$2"))


_ASCII_WHITE = " \t\n\x0B\f\r"


def _joined(text: Column) -> Column:
    """Lines of a sentence as one."""
    text = _squashed(_where(text, "\n", (r"\n(?!\n)(?<![\n.!?]\n)", " ")))
    return _where(text, ["\n\n\n"], (r"\n{3,}", "\n\n"))


def _tidy(text: Column) -> Column:
    """Without blanks before marks and inside of parentheses."""
    text = _where(text, (" ,", " :", " ;"), (r" ([,:;])", "$1"))
    inside = lambda t: (_has(t, "(") & _has(t, [f"({x}" for x in _ASCII_WHITE])) | (_has(t, ")") & _has(t, [f"{x})" for x in _ASCII_WHITE]))
    return let(text, lambda t: F.when(inside(t), _replaced(t, (r"\(\s+", "("), (r"\s+\)", ")"))).otherwise(t))


def _unspaced(text: Column) -> Column:
    return _where(text, [" \n"], (r" +\n", "\n"))


_LINKS = (("://", "www."), (URL, "")), ("@", (EMAIL, ""))


def deep(text: Column) -> Column:
    """basic(), then without noise, repeated headers, reference lists and abbreviations; sentences joined across line ends."""
    read = _unhyphened(_where(_newlines(text), "￾þ", ("￾", ""), ("þ", "+")))
    out = _where_low(_body(read, DEEP), (["doi"], (DOI, "")), *_LINKS)
    out = _unspaced(_tidy(_joined(out)))
    section = r"(?is)\n\s*{}\b.*?(?=\n\s*\d+\s+[A-Z]|\z)"
    out = _where_low(
        out,
        (["references"], (r"(?is)\n\s*15\s+References\b.*$", "")),
        (["abbreviations and acronyms"], (section.format(r"1\s+Abbreviations and acronyms"), "\n")),
        (["table of contents"], (section.format("Table of contents"), "\n")),
    )
    return _stripped(out)


def guideline(text: Column) -> Column:
    """deep() for guidelines: also without bare page numbers, blocks under headers of references, and what follows those headers."""
    read = _unhyphened(_where(_newlines(text), "￾–—", ("￾", ""), ("[–—]", "-")))
    out = _where_low(_body(read, GUIDELINE), *_LINKS, (["doi"], (DOI, ""), (DOI_URL, "")))
    out = _tidy(_unspaced(_joined(out)))
    after = lambda name: (rf"(?is)\n\s*{name}\s*\n.*$", "")
    out = _where_low(out, (["references"], after("references")), (["bibliography"], after("bibliography")), (["acknowled"], after("acknowledg?e?ments")))
    return _stripped(out)


STRATEGIES = {"none": lambda text: text, "basic": basic, "deep": deep, "medical_guideline_deep": guideline}


def cleaned(docs: DataFrame, strategy: str = "basic", text_col: str = "text") -> DataFrame:
    """docs with the text cleaned by the strategy of this name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown cleaning strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return docs.withColumn(text_col, STRATEGIES[strategy](F.col(text_col)))
