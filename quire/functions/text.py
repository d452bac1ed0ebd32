"""Text expressions. Every function takes and returns a Column and stays inside codegen."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode white space, spelled out so that it does not depend on regex flags.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Something else, at any place.
NOT_SPACE = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
# The mark of a sentence end, and what stands before a mark that the text itself holds.
MARK, HIDE = "\u0001", "\u0002"

# Shortened words after which a full stop does not end a sentence.
ABBREVIATIONS = (
    "e.g", "i.e", "etc", "cf", "vs", "al", "approx", "resp", "fig", "eq", "sec", "ch", "ex",
    "no", "vol", "pp", "ref", "mr", "mrs", "ms", "dr", "prof", "st", "inc", "ltd", "jr", "sr",
)
# Parts of font names that mean a fixed-width face.
MONOSPACE_MARKERS = (
    "mono", "courier", "consol", "menlo", "inconsolata", "cmtt", "typewriter", "source code",
    "fira code", "jetbrains", "cascadia", "andale", "lucida console", "terminal", "hack-",
    "ubuntu mono",
)
# Display names of language tags.
LANGUAGE_NAMES = {
    "zh-cn": "Simplified Chinese", "zh-hans": "Simplified Chinese",
    "zh-tw": "Traditional Chinese", "zh-hant": "Traditional Chinese",
    "en": "English", "ja": "Japanese", "ko": "Korean", "fr": "French",
    "de": "German", "es": "Spanish", "pt": "Portuguese", "ru": "Russian",
    "it": "Italian", "ar": "Arabic", "hi": "Hindi", "vi": "Vietnamese",
    "th": "Thai", "id": "Indonesian", "tr": "Turkish", "pl": "Polish",
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c: str | Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(_col(c), F.lit(pattern), F.lit(by))


def _inked(letter: Column) -> Column:
    """Whether the code of a letter lies in a range without white space."""
    return letter.between(0x21, 0x7E) | letter.between(0xA1, 0x167F)


def strip(c: str | Column) -> Column:
    """Drop white space, Unicode included, at both ends."""
    bare = F.btrim(_col(c), F.lit(SPACES))
    if not isinstance(c, str):
        return bare
    # most texts begin and end with a letter or mark of a range without white space, which is seen sooner
    first, last = F.ascii(c), F.ascii(F.right(F.col(c), F.lit(1)))
    return F.when(_inked(first) & _inked(last), F.col(c)).otherwise(bare)


# White space other than a plain space. Letters of the first 256 are one look into a table; the others are only
# tried where a letter lies in their range.
_ODD_SPACE = (
    r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]"
)


def collapse_ws(c: str | Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    one = replace_all(c, rf"{SPACE}+", " ")
    if isinstance(c, str):  # most texts have single plain spaces only, and writing each anew is most of the work
        one = F.when(F.contains(F.col(c), F.lit("  ")) | F.col(c).rlike(_ODD_SPACE), one).otherwise(F.col(c))
    return F.trim(one)


def word_count(c: str | Column) -> Column:
    """Words between white space: gaps of the stripped text plus one, none if it is empty."""
    bare = strip(c)
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(f"{SPACE}+")) + 1)


def words_up_to(c: str | Column, most: int) -> Column:
    """The same of stripped text, and ``most`` + 1 for every text of more than ``most`` words, which is read
    no further than that."""
    more = rf"\A(?:{NOT_SPACE}++{SPACE}++){{{most}}}{NOT_SPACE}"
    return F.when(_col(c).rlike(more), most + 1).otherwise(word_count(c))


def first_words(c: str | Column, n: int) -> Column:
    """The first ``n`` words with punctuation removed."""
    plain = F.trim(replace_all(c, r"[^\p{L}\p{N} ]"))
    return F.array_join(F.slice(F.split(plain, " +"), 1, n), " ")


def _foldings() -> dict[str, str]:
    """Letters that case folding takes to something else than lower case, built from the standard
    library. A capital sigma is among them, as lower case depends on what follows it. Cherokee
    letters, which fold to capitals, are left to lower case, which tells them apart just as well."""
    out = {"Σ": "σ"}
    for i in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        c = chr(i)
        if c.casefold() != c.lower() and not (0x13A0 <= i <= 0x13FD or 0xAB70 <= i <= 0xABBF):
            out[c] = c.casefold()
    return out


_FOLDINGS = _foldings()


def _letters(of: Iterable[str]) -> str:
    """A class of these letters, neighbours as ranges: a pattern tries the parts of a class one by one."""
    parts: list[list[int]] = []
    for i in sorted(map(ord, of)):
        if parts and parts[-1][1] == i - 1:
            parts[-1][1] = i
        else:
            parts.append([i, i])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in parts) + "]"


# Letters that fold to one other; sharp s, the only common one that folds to several, is replaced by itself.
_SINGLE = {a: b for a, b in _FOLDINGS.items() if len(b) == 1}
_SHARP = "ß"
# None of them is plain, which is seen at once; a class has its parts tried one by one.
_RARE = r"(?=[^\x00-\x7F])" + _letters(_FOLDINGS)
_SEVERAL = r"(?=[^\x00-\x7F])" + _letters(a for a, b in _FOLDINGS.items() if len(b) > 1 and a != _SHARP)


def fold_case(c: str | Column) -> Column:
    """Full case folding. Plain text (as many bytes as letters) and text without one of the rare
    letters take the short way, lower case; only text that is not plain is searched for them, and only
    text with one of the rarest is taken letter by letter."""
    col = _col(c)
    table = F.create_map(*(F.lit(x) for pair in _FOLDINGS.items() for x in pair))
    letters = F.transform(F.split(col, ""), lambda x: F.coalesce(F.try_element_at(table, x), x))
    short = F.replace(F.translate(col, "".join(_SINGLE), "".join(_SINGLE.values())), F.lit(_SHARP), F.lit(_FOLDINGS[_SHARP]))
    plain = F.length(col) == F.octet_length(col)
    folded = F.when(col.rlike(_SEVERAL), F.array_join(letters, "")).otherwise(short)
    return F.when(plain, F.lower(col)).otherwise(F.lower(F.when(col.rlike(_RARE), folded).otherwise(col)))


@F.pandas_udf(T.StringType())
def fold_case_exact(s: pd.Series) -> pd.Series:
    """Full Unicode case folding, for text where ``fold_case`` is not enough."""
    return s.map(lambda v: None if v is None else v.casefold())


@F.pandas_udf(T.StringType())
def fold_math(s: pd.Series) -> pd.Series:
    """Mathematical letters back to plain ones (NFKC). For equation text only."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def short_hash(c: str | Column) -> Column:
    return F.substring(F.sha2(_col(c), 256), 1, 16)


def content_id(c: str | Column) -> Column:
    """First 16 hex digits of the SHA-256 of the stripped text."""
    return short_hash(strip(c))


def binary_id(c: str | Column) -> Column:
    return short_hash(_col(c).cast("binary"))


def cache_key(text: str | Column, target_lang: str, model: str) -> Column:
    lead = f"{model}\x00{target_lang}\x00"
    whole = F.concat(F.lit(lead), _col(text))
    if not isinstance(text, str) or lead[0] in SPACES:
        return content_id(whole)
    # nothing to strip at its end in most texts, which is seen sooner
    return F.when(_inked(F.ascii(F.right(F.col(text), F.lit(1)))), short_hash(whole)).otherwise(content_id(whole))


def is_monospace(c: str | Column) -> Column:
    pattern = "|".join(MONOSPACE_MARKERS)
    return F.coalesce(fold_case(c).rlike(pattern), F.lit(False))


def language_name(tag: str | Column, fallback: str) -> Column:
    """Display name of a tag; empty or ``auto`` gives the fallback, unknown the tag itself."""
    pairs = [F.lit(v) for kv in LANGUAGE_NAMES.items() for v in kv]
    tag = _col(tag)
    blank = tag.isNull() | (tag == "") | (tag == "auto")
    return F.when(blank, F.lit(fallback)).otherwise(
        F.coalesce(F.element_at(F.create_map(*pairs), F.lower(tag)), tag)
    )


# A full stop, the quotes or brackets closing after it, and the space.
_CLOSERS = "[\"'’”)\\]]*"
_TAIL = rf"\.{_CLOSERS} "
_ABBREV = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)


def segment(c: str | Column) -> Column:
    """Sentences of a text as an array; empty text gives an empty array."""
    return segment_plain(collapse_ws(c))


def segment_plain(c: str | Column) -> Column:
    """The same of a text whose white space is collapsed already. It is looked at several times, so it is
    best a column of its own.

    A mark goes in at every place that can end a sentence, two rules take back marks that look
    further than the place itself, and the text is split at what is left. Every rule only keeps
    a mark out, so doubt leaves the sentence whole.
    """
    # No mark after a full stop that follows a shortened word or one letter (an initial, a list
    # letter), or comes before a lower-case letter. What stands before is only looked at there.
    # An end mark is looked for first, as one class of letters; what it is comes after.
    stop = rf"(?<=\.)(?<!(?<![\p{{L}}\p{{N}}_.])(?:\p{{L}}|(?iu:{_ABBREV}))\.){_CLOSERS} (?!\p{{Ll}})"
    plain = _col(c)
    marked = F.contains(plain, F.lit(MARK)) | F.contains(plain, F.lit(HIDE))
    hidden = F.replace(F.replace(plain, F.lit(HIDE), F.lit(HIDE + "\u0004")), F.lit(MARK), F.lit(HIDE + "\u0003"))
    t = replace_all(F.when(marked, hidden).otherwise(plain), rf"[.!?](?:(?<=[!?]){_CLOSERS} |{stop})", f"$0{MARK}")
    # after a token with a full stop inside: an acronym or a version
    t = replace_all(t, rf"(\.{WORD}*{_TAIL}){MARK}", "$1")
    # after a number that opens the sentence: a list number
    t = replace_all(t, rf"(^|{MARK})(\p{{Nd}}+{_TAIL}){MARK}", "$1$2")
    parts = F.filter(F.transform(F.split(t, MARK), lambda p: F.trim(p)), lambda p: p != "")
    shown = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit(HIDE + "\u0003"), F.lit(MARK)), F.lit(HIDE + "\u0004"), F.lit(HIDE)))
    return F.when(marked, shown).otherwise(parts)


SENTENCE_ENDS = ".!?:;"


def ends_sentence(c: str | Column) -> Column:
    return _col(c).rlike(rf"[{SENTENCE_ENDS}]{SPACE}*\z")


# What counts as markup, in pages and in notes.
HTML_MARKUP = r"(?is:<(script|style|nav|footer)[^>]*>.*?</\1>)|<[^>]+>|&nbsp;?"
MD_IMAGE, MD_LINK, MD_CODE = r"!\[([^\]]*)\]\([^)]*\)", r"\[([^\]]+)\]\([^)]*\)", r"`([^`]+)`"
# Only a line feed ends a line: other separators may stand in emphasis.
MD_EMPHASIS = r"(?d)(\*\*|__|\*|_)(?=\S)(.+?)(?<=\S)\1"


def html_to_text(c: str | Column) -> Column:
    """Readable text of a page: no script, style, navigation or footer, no tags."""
    bare = replace_all(c, HTML_MARKUP, " ")
    return collapse_ws(F.replace(bare, F.lit("&amp;"), F.lit("&")))


def join_soft_hyphens(c: str | Column) -> Column:
    """A word broken over a line end with a hyphen, between lower-case letters, is rejoined."""
    return replace_all(c, r"([a-z])-\n([a-z])", "$1$2")


def strip_markdown(c: str | Column) -> Column:
    """Inline markup out, words in: images to alt text, links to labels, code and emphasis bare."""
    t = replace_all(replace_all(replace_all(c, MD_IMAGE, "$1"), MD_LINK, "$1"), MD_CODE, "$1")
    for _ in range(2):  # emphasis inside emphasis
        t = replace_all(t, MD_EMPHASIS, "$2")
    return collapse_ws(t)
