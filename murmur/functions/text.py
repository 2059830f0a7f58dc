"""Text normalisation and tokenisation as native Spark column expressions.

The rules run in this order (each one can be switched off):

1. lower-case, strip surrounding white space
2. ``http...`` runs -> `` URL ``; ``@name`` -> `` USER ``
3. optional ``rt`` removal
4. a space on both sides of every listed punctuation mark
5. a space on both sides of every digit run
6. ``#`` -> space
7. runs of spaces -> one space

then white-space split, and (unless ``keep_all``) dropping of one-character
tokens, stop words and ``rt``.

Everything compiles to JVM expressions (``regexp_replace``, ``split``,
higher-order ``filter``), so it stays inside whole-stage code generation and
never leaves the executor JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference rules) --------------------------
# Punctuation marks that get a space on each side, in the order the
# reference lists them (":" and '"' appear twice there; the entry "‰a" is two
# characters and is kept as written).
PUNCTUATION = [
    ",", ":", ".", "(", ")", "!", "?", ":", ";", "/", '"', "*", "^", "'",
    "_", "[", "]", "+", "-", '"', "`", "~", "=", "â", "Â", "…",
    "‘", "’", "”", "“", "‹", "‰a", "«", "»",
    "″", "′",
]
# Tags that replace links and user names, and the token always dropped.
URL_TAG = "URL"
USER_TAG = "USER"
REPOST_TOKEN = "rt"
# --- end of fixed values ----------------------------------------------------

# White space as Python's unicode ``split()``/``strip()`` sees it.  Written
# with ``\x{..}`` escapes so the same class works in Java regex and RE2.
WS_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# ASCII-only word characters: the reference regexes run without the UNICODE
# flag, while Java's ``\b`` and ``\w`` would treat accented letters as word
# characters.  ``_ASCII_B`` is an ASCII word boundary for Java.
_W = "[A-Za-z0-9_]"
_ASCII_B = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_NON_WS = r"[^ \t\n\r\f\x0b]"

URL_PATTERN_JAVA = f"http{_NON_WS}*{_ASCII_B}"
USER_PATTERN_JAVA = f"@{_W}*{_ASCII_B}"
RT_PATTERN_JAVA = f"{_ASCII_B}rt{_ASCII_B}"
# RE2 (DuckDB) word boundaries are ASCII already.
URL_PATTERN_RE2 = rf"http{_NON_WS}*\b"
USER_PATTERN_RE2 = rf"@{_W}*\b"
RT_PATTERN_RE2 = r"\brt\b"


def _punctuation_class() -> str:
    singles = list(dict.fromkeys(p for p in PUNCTUATION if len(p) == 1))
    return "[" + "".join("\\" + c if c in "\\]^-[" else c for c in singles) + "]"


def _punctuation_pattern() -> str:
    multi = [p for p in dict.fromkeys(PUNCTUATION) if len(p) > 1]
    alts = "|".join(re.escape(m) for m in multi)
    return f"({PUNCT_CLASS}|{alts})" if alts else f"({PUNCT_CLASS})"


PUNCT_CLASS = _punctuation_class()
PUNCT_PATTERN = _punctuation_pattern()
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"
# the white-space characters of WS_CLASS, for trimming
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


# What the rules and the split leave of two characters or more: digit runs, and
# runs without separators or digits.  Java looks the single characters below U+0100 of
# a class up in a table and tries everything else one by one, so those stand singly in
# the class, and the separators above are made spaces before.
_SEPARATORS = WS_CHARS + "#" + "".join(dict.fromkeys(p for p in PUNCTUATION if len(p) == 1))
WIDE_SEPARATORS = "".join(c for c in _SEPARATORS if ord(c) > 0xFF)
_IN_WORD = "[^" + "".join(f"\\x{ord(c):02x}" for c in _SEPARATORS if ord(c) <= 0xFF) + "0123456789]"
WORD_PATTERN = f"[0123456789][0123456789]+|{_IN_WORD}{_IN_WORD}+"

# all patterns that the rules use: part of the key of what is stored
RULES = [WS_CLASS, WS_CHARS, URL_PATTERN_JAVA, USER_PATTERN_JAVA, RT_PATTERN_JAVA, PUNCT_PATTERN, WIDE_SEPARATORS, WORD_PATTERN, URL_TAG, USER_TAG, REPOST_TOKEN]


def normalize_format(text: Column | str) -> Column:
    """Drop carriage returns, turn line feeds into spaces."""
    return F.replace(F.replace(_c(text), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def normalize_punctuation(text: Column | str, url: bool = True, username: bool = True,
                          hashtag: bool = True, punctuation: bool = True,
                          rt: bool = False, numbers: bool = True) -> Column:
    """The normalisation rules 1-7 above, as one column expression.

    Fewer passes than rules: every rule only inserts spaces around what it
    matches (or replaces a match by a tag), and runs of spaces collapse at
    the end, so the punctuation and digit rules share one regex pass, the
    two-character mark is a literal replace, and the link / user-name
    regexes run only on rows that contain ``http`` / ``@``.
    """
    s = _tagged(F.btrim(F.lower(_c(text)), F.lit(WS_CHARS)), url, username)
    if rt:
        s = F.regexp_replace(s, RT_PATTERN_JAVA, "")
    if punctuation:
        s = _marks_apart(s)
    alts = []
    if punctuation:
        alts.append(PUNCT_CLASS)
    if numbers:
        alts.append("[0-9]+")
    if alts:
        s = F.regexp_replace(s, "(" + "|".join(alts) + ")", " $1 ")
    if hashtag:
        s = F.translate(s, "#", " ")
    return F.regexp_replace(s, " +", " ")


def _tagged(s: Column, url: bool = True, username: bool = True) -> Column:
    """Links and user names as tags."""
    if url:
        s = _once(s, lambda x: F.when(F.instr(x, "http") > 0, F.regexp_replace(x, URL_PATTERN_JAVA, f" {URL_TAG} ")).otherwise(x))
    if username:
        s = _once(s, lambda x: F.when(F.instr(x, "@") > 0, F.regexp_replace(x, USER_PATTERN_JAVA, f" {USER_TAG} ")).otherwise(x))
    return s


def _once(s: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of ``s``, which is computed once, however often the rule names it."""
    return F.get(F.transform(F.array(s), rule), 0)


def _marks_apart(s: Column) -> Column:
    """Spaces around the marks of two characters."""
    for multi in dict.fromkeys(p for p in PUNCTUATION if len(p) > 1):
        s = F.replace(s, F.lit(multi), F.lit(f" {multi} "))
    return s


def split_words(text: Column | str) -> Column:
    """White-space split without empty strings (Python ``str.split()``)."""
    return F.filter(F.split(_c(text), f"{WS_CLASS}+"), lambda t: t != F.lit(""))


def valid_tokens(tokens: Column | str, stoplist: Iterable[str] | None = None,
                 keep_all: bool = False) -> Column:
    """Keep tokens longer than one character that are not stop words or ``rt``.

    The stop list is inlined as an ``IN`` list, which Catalyst turns into a
    hash-set lookup (``InSet``) for lists longer than a few entries, so the
    cost per token does not grow with the list.  Lists are word-list files,
    bounded by :data:`murmur.functions.wordlists.MAX_INLINE_WORDS`.
    """
    if keep_all:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: (F.length(t) > 1) & ~t.isin(_stop(stoplist)))


def _stop(stoplist: Iterable[str] | None) -> list[str]:
    return list(dict.fromkeys(list(stoplist or []) + [REPOST_TOKEN]))


def clean_and_tokenize(text: Column | str, stoplist: Iterable[str] | None = None,
                       keep_all: bool = False, **rules) -> Column:
    """normalise -> split -> token validity; an ``array<string>`` column.

    Under the default rules the tokens that are kept are read off the tagged text in
    one pass: spaces around marks would only be put in to be split at, and tokens of
    one character made to be dropped."""
    if not keep_all and not rules:
        s = _marks_apart(_tagged(F.lower(_c(text))))
        s = _once(s, lambda x: F.when(F.octet_length(x) > F.length(x), F.translate(x, WIDE_SEPARATORS, " " * len(WIDE_SEPARATORS))).otherwise(x))
        words = F.regexp_extract_all(s, F.lit(WORD_PATTERN), F.lit(0))
        return F.filter(words, lambda t: ~t.isin(_stop(stoplist)))
    return valid_tokens(split_words(normalize_punctuation(text, **rules)), stoplist, keep_all)


def word_to_identifier(word: Column | str) -> Column:
    """Every non-word character becomes ``_`` (used for augmented words)."""
    return F.regexp_replace(_c(word), "[^A-Za-z0-9_]", "_")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
