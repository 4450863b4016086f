"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Languages and their numbers.
LANGUAGES = {"auto": 0, "zh": 3, "en": 4, "yue": 7, "ja": 11, "ko": 12, "nospeech": 13}


#: What counts as white space in targets.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that tokens do not begin with.
SKIPPED = "!,?、。！，；？：「」︰『』《》"
#: Marks beyond ASCII that cleaning drops (all of ASCII's go as well).
DROPPED = "，。！？：；、（）“”‘’【】《》…"
#: White space other than the blank, and controls, formats and private characters, as classes that Java and RE2 both know.
_UNSEEN = "\\p{Cc}\\p{Cf}\\p{Co}\\p{Zl}\\p{Zp}\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: A token: one letter of a script without cases, a tag, or anything else and the ASCII characters that follow it.
TOKEN = rf"\p{{Lo}}|<[\x00-\x08\x0b\x0c\x0e-\x1f!-=?-\x7f]*>?|[^\p{{Lo}}\p{{Zs}}<{SKIPPED} \t\r\n][\x00-\x08\x0b\x0c\x0e-\x1f!-\x7f]*"
MARKS = rf"[{_UNSEEN}!-/:-@\[-`{{-~{DROPPED}]"


def train_target(c: Column) -> Column:
    """Keeps ASCII letters, white space and . , ! ? ' in lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(c, f"[^A-Za-z{SPACES}.,!?']+", "")), F.lit(SPACES))


def decode_target(c: Column) -> Column:
    """As train_target, without the apostrophe."""
    return F.trim(F.lower(F.regexp_replace(c, f"[^A-Za-z{SPACES}.,!?]+", "")), F.lit(SPACES))


def characterize(c: Column) -> Column:
    """The scorer's tokens: letters of scripts without cases one by one, tags, and runs up to white space or a character beyond ASCII.

    Marks of SKIPPED, blanks and unassigned characters are left out where a token would begin.  Null gives null.
    """
    return F.regexp_extract_all(c, F.lit(TOKEN.replace(r"[^\p{Lo}", r"[^\p{Cn}\p{Lo}")), F.lit(0))


def normalize(tokens: Column, ignore: Column | None = None, case_sensitive: bool = False, split: Column | None = None) -> Column:
    """Upper case, then without the words of `ignore`, without tags, without empty tokens, and words of the map `split` as their parts."""
    x = tokens if case_sensitive else F.transform(tokens, F.upper)
    if ignore is not None:
        x = F.filter(x, lambda t: ~F.array_contains(ignore, t))
    x = F.filter(F.transform(x, strip_tags), lambda t: t != "")
    if split is None:
        return x
    return F.flatten(F.transform(x, lambda t: F.coalesce(F.element_at(split, t), F.array(t))))


def words(c: Column) -> Column:
    """What the scorer compares: normalize(characterize(c)); a null text has none."""
    return F.coalesce(normalize(characterize(c)), F.expr("cast(array() as array<string>)"))


def strip_tags(c: Column) -> Column:
    """Removes <...>; a tag that does not end reaches to the end."""
    return F.regexp_replace(c, "(?s)<[^>]*>?", "")


def clean_marks(c: Column) -> Column:
    """Drops punctuation of ASCII and of DROPPED, and what is not printable; blanks and other marks stay."""
    return F.regexp_replace(c, MARKS.replace("[", r"[\p{Cn}\p{Cs}", 1), "")


def tokens(c: Column) -> Column:
    """Upper-cased white-space tokens."""
    return F.filter(F.split(F.upper(c), r"[ \t\n\r\f\x0b]+"), lambda x: x != "")


#: Symbols that do not count in a token's cluster.
UNCOUNTED = "&'@℃=.-_#+;"


def cluster(c: Column) -> Column:
    """Number, English or Other for ASCII tokens; the symbols & ' @ ℃ = . - _ # + ; do not count."""
    bare = F.regexp_replace(c, r"[&'@℃=.\-_#+;]", "")
    return F.when(bare.rlike("^[0-9]+$"), "Number").when(bare.rlike("^[A-Za-z]+$"), "English").otherwise("Other")


@F.pandas_udf(T.StringType())
def cluster_of(c: pd.Series) -> pd.Series:
    """Number, Mandarin, English, Japanese or Other by the names of the token's characters; symbols that do not count are left out."""
    # fixed values: how the names of characters begin, and the kinds they stand for
    kinds = (("DIGIT", "Number"), ("CJK UNIFIED IDEOGRAPH", "Mandarin"), ("CJK COMPATIBILITY IDEOGRAPH", "Mandarin"), ("LATIN CAPITAL LETTER", "English"), ("LATIN SMALL LETTER", "English"), ("HIRAGANA LETTER", "Japanese"))
    memo: dict[str, str] = {}

    def kind(x: str) -> str:
        if x not in memo:
            name = unicodedata.name(x, "")
            memo[x] = "" if x in UNCOUNTED else next((k for start, k in kinds if name.startswith(start)), "Other")
        return memo[x]

    def whole(t: str | None) -> str:
        found = {kind(x) for x in t or ""} - {""}
        return found.pop() if len(found) == 1 else "Other"

    return c.map(whole)


def columns(text: str | None) -> int:
    """Columns that a text takes: two for wide and ambiguous characters of East Asia, else one."""
    return sum(1 + (unicodedata.east_asian_width(x) in "AFW") for x in text or "")


@F.pandas_udf(T.IntegerType())
def width(c: pd.Series) -> pd.Series:
    return c.map(columns)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]*)$", 1))


def language_id(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[c], F.lit(0))
