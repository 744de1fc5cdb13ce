"""Column functions over text: tokens, normal forms and set measures. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the keyword search leaves out.
SEARCH_STOPWORDS = (
    "a an and are as at be by for from has he in is it its of on or that the to was were will with this these those "
    "can could should would may might about into than then them they their there here what when where which who why how your you our we"
).split()
#: Words that answers are not judged by.
ANSWER_STOPWORDS = "the a an to and or of in for on with is are was were by that this these those from as at be it its into than then their there".split()
#: Words that questions and guidance texts aren't compared by.
GUIDANCE_STOPWORDS = (
    "about according after all and are based been for from guidance has have into most not that the their this treatment "
    "what with would patient variables management follow relevant document grounded available data should could regarding focus clinical"
).split()
#: What splits words, in any script.
BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once per row, also where f uses it inside of a lambda, which Spark would compute anew for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _but(words_: list[str]) -> str:
    """An expression for any of some words, by their first letters."""
    firsts: dict[str, list[str]] = {}
    for w in words_:
        firsts.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in firsts.items())


_LETTER = r"[\p{L}\p{N}_]"


def tokens(text: Column, stopwords: list[str] = SEARCH_STOPWORDS) -> Column:
    """Words of two and more ASCII letters and digits, in lower case and in order, repeats kept, stopwords left out.

    A run that has any other letter, digit or underscore isn't such a word. Null gives no tokens. One expression does all.
    """
    skip = f"(?!(?:{_but(stopwords)})(?!{_LETTER}))" if stopwords else ""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?<!{_LETTER}){skip}([a-z0-9]{{2,}}+)(?!{_LETTER})"))


def runs(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, in lower case and in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))


def terms(text: Column, stopwords: list[str], least: int = 3) -> Column:
    """Distinct runs of at least `least` ASCII letters and digits outside stopwords, in order of their first occurrence."""
    return F.array_distinct(F.filter(runs(text), lambda x: (F.length(x) >= least) & ~F.array_contains(words(stopwords), x)))


def informative(text: Column) -> Column:
    """Distinct runs of three and more characters outside ANSWER_STOPWORDS."""
    return terms(text, ANSWER_STOPWORDS)


def plain(text: Column) -> Column:
    """Runs joined by single spaces."""
    return F.array_join(runs(text), " ")


def squeezed(text: Column) -> Column:
    """Words joined by single spaces, whatever blank stood between them."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common(a, b) / both)


def coverage(a: Column, b: Column) -> Column:
    """Share of the distinct items of a that b has; 0 if a is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(common(a, b) / F.size(F.array_distinct(a)))


def set_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of the overlap's shares of both sets; 1 if both are empty, 0 if only one is."""
    n = common(a, b)
    p, r = n / F.size(a), n / F.size(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(n == 0, 0.0).otherwise(2 * p * r / (p + r))


def slug(value: Column, default: str = "run") -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", default).otherwise(out)
