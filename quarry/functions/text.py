"""Scalar text functions, as expressions over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.schema import DEFAULT_WORDS

#: Letters, digits and underscore of any script, as both Java and RE2 spell them.
W = r"\p{L}\p{N}_"
#: The same for patterns of Spark alone: Java tests the ranges in turn, and most characters are of the first ones.
WORDLY = r"a-zA-Z0-9_\p{L}\p{N}"
#: White space that is not one plain space already, so that the spaces between words are no matches.
RUNS = r"\s{2,}|[\t\n\x0B\f\r]"
# Words without weight in overlap scores, and the suffixes that are stripped, in this order.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need", "dare", "ought",
    "used", "not", "no", "it", "its", "i", "we", "you", "he", "she", "they", "that", "this", "these", "those",
]
SUFFIXES = ["ings", "ing", "tion", "tions", "ed", "er", "ly", "s"]
#: A word, and the longest suffix that leaves three letters; of the suffixes, none ends another one that stands before it.
STEM = "^(.{3,}?)(?:" + "|".join(SUFFIXES) + ")$"
#: What is stripped at a word's end before.
TRAILING = r"[.,!?;:\"']+$"
# How a sentence starts that speaks about the documents instead of the matter.
META_PREFIXES = ["according to", "based on the", "the documents", "the context", "i cannot determine", "the provided", "as mentioned"]
#: Elements that go with all they hold.
DROPPED_TAGS = ["script", "style", "noscript", "header", "footer", "nav", "aside"]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def filled(c: Column, default: Column) -> Column:
    """c, or the default where c is null or blank."""
    return F.coalesce(F.when(F.trim(c) != "", c), default)


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), RUNS, " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, RUNS, " "))


def clean_text(c: Column) -> Column:
    """Text of markup: dropped elements go whole, tags and comments become spaces, entities are read, odd characters become spaces.

    Texts without a tag or an entity pass by the patterns for these. Odd characters and white space make one run, which
    becomes one space.
    """
    given = text_or_empty(c)
    out = F.regexp_replace(given, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", " ")
    out = F.when(F.contains(given, F.lit("<")), F.regexp_replace(out, r"(?s)<[^>]*>", " ")).otherwise(given)
    read = out
    for name, value in ENTITIES.items():
        read = F.replace(read, F.lit(name), F.lit(value))
    out = F.when(F.contains(given, F.lit("&")), read).otherwise(out)
    kept = rf"{WORDLY}.,;:!?\-()/"
    return F.trim(F.regexp_replace(out, rf"[^{kept}]{{2,}}|[^{kept} ]", " "))


def clean_text_sql(x: str) -> str:
    """The same in DuckDB SQL."""
    out = f"regexp_replace(coalesce({x}, ''), '<!--.*?-->', ' ', 'gs')"
    for tag in DROPPED_TAGS:
        out = f"regexp_replace({out}, '<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'gis')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'gs')"
    for name, value in ENTITIES.items():
        out = f"replace({out}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    out = f"regexp_replace({out}, '[^{W}\\s.,;:!?\\-()/]', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def word_count(c: Column) -> Column:
    n = F.regexp_count(text_or_empty(c), F.lit(f"[{WORDLY}]+"))
    return F.when(n > 0, n).otherwise(F.lit(DEFAULT_WORDS)).cast("int")


def is_english(text: Column, lang: Column | None = None) -> Column:
    """By the language column where there is one, else by the share of ASCII letters; under 60 characters never."""
    sample = F.substring(F.trim(text_or_empty(text)), 1, 2500)
    ratio = F.regexp_count(sample, F.lit("[A-Za-z]")) / F.greatest(F.char_length(sample), F.lit(1))
    rule = ratio > 0.55
    if lang is not None:
        rule = F.coalesce(lang == "en", rule)
    return (F.char_length(F.trim(text_or_empty(text))) >= 60) & rule


def words(c: Column) -> Column:
    """Tokens of the lower-cased text, split at white space."""
    return F.filter(F.split(F.lower(text_or_empty(c)), r"\s+"), lambda t: t != "")


def bare(w: Column) -> Column:
    """The word in lower case without trailing punctuation."""
    return F.rtrim(F.lower(w), F.lit(".,!?;:\"'"))


def cut(b: Column) -> Column:
    """A bare word without the first suffix that leaves three letters. Ends are compared one by one, which a pattern would try at every letter."""
    out = None
    for x in SUFFIXES:
        ends = F.endswith(b, F.lit(x)) & (F.char_length(b) >= len(x) + 3)
        rest = F.substring(b, F.lit(1), F.char_length(b) - len(x))
        out = F.when(ends, rest) if out is None else out.when(ends, rest)
    return out.otherwise(b)


def stem(w: Column) -> Column:
    """cut() of bare(), which is made once for all ends. Of a column of its own both are faster by themselves."""
    return F.get(F.transform(F.array(bare(w)), cut), F.lit(0))


def claims(c: Column, most: int | None = 10) -> Column:
    """Sentences of 20 characters or more that speak about the matter, the first ones; all with most None."""
    marked = F.regexp_replace(F.trim(text_or_empty(c)), r"([.!?])\s+", "$1\u0001")
    kept = F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: F.char_length(s) >= 20)
    about = "^(" + "|".join(META_PREFIXES) + ")"
    kept = F.filter(kept, lambda s: ~F.lower(s).rlike(about))
    return kept if most is None else F.slice(kept, 1, most)


def excerpt(c: Column, n: int | Column) -> Column:
    """The first n characters; '' for null."""
    return F.substring(text_or_empty(c), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def embed_input(title: Column, body: Column, most: int = 512) -> Column:
    """'title. body' with the body cut to so many words; the part that is there if the other is empty."""
    cut = F.array_join(F.slice(F.filter(F.split(text_or_empty(body), r"\s+"), lambda t: t != ""), 1, most), " ")
    title = F.trim(text_or_empty(title))
    return F.trim(F.when((title != "") & (cut != ""), F.concat(title, F.lit(". "), cut)).otherwise(F.concat(title, cut)))


def build_context(docs: Column, most: int = 1200) -> Column:
    """Numbered blocks of an array of (title, source, date, text); the date is told only with a source."""

    def block(d: Column, i: Column) -> Column:
        source = F.when(text_or_empty(d["source"]) != "", F.concat(F.lit(" ("), d["source"], F.when(text_or_empty(d["date"]) != "", F.concat(F.lit(", "), d["date"])).otherwise(""), F.lit(")"))).otherwise("")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), text_or_empty(d["title"]), source, F.lit("\n"), F.substring(text_or_empty(d["text"]), 1, most))

    return F.array_join(F.transform(docs, block), "\n\n")
