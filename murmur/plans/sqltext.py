"""DuckDB spellings of the text rules, for the oracle statements."""

from __future__ import annotations

# The rules written out once more, on purpose: a statement that took its
# patterns from the module under test would agree with any mistake there.
WS_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"
URL_PATTERN_RE2 = r"http[^ \t\n\r\f\x0b]*\b"
USER_PATTERN_RE2 = r"@[A-Za-z0-9_]*\b"
RT_PATTERN_RE2 = r"\brt\b"
PUNCT_PATTERN = r"""([,:.()!?;/"*\^'_\[\]+\-`~=âÂ…‘’”“‹«»″′]|‰a)"""
URL_TAG, USER_TAG, REPOST_TOKEN = "URL", "USER", "rt"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm_format(expr: str) -> str:
    return f"translate({expr}, chr(10) || chr(13), ' ')"


def norm_punct(expr: str, url=True, username=True, hashtag=True, punctuation=True,
               rt=False, numbers=True) -> str:
    s = f"regexp_replace(lower({expr}), {lit(STRIP_PATTERN)}, '', 'g')"
    if url:
        s = f"regexp_replace({s}, {lit(URL_PATTERN_RE2)}, ' {URL_TAG} ', 'g')"
    if username:
        s = f"regexp_replace({s}, {lit(USER_PATTERN_RE2)}, ' {USER_TAG} ', 'g')"
    if rt:
        s = f"regexp_replace({s}, {lit(RT_PATTERN_RE2)}, '', 'g')"
    if punctuation:
        s = f"regexp_replace({s}, {lit(PUNCT_PATTERN)}, ' \\1 ', 'g')"
    if numbers:
        s = f"regexp_replace({s}, '([0-9]+)', ' \\1 ', 'g')"
    if hashtag:
        s = f"translate({s}, '#', ' ')"
    return f"regexp_replace({s}, ' +', ' ', 'g')"


def split_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {lit(WS_CLASS + '+')}), lambda t: t <> '')"


def valid(expr: str, stop: list[str] | None) -> str:
    words = list(dict.fromkeys(list(stop or []) + [REPOST_TOKEN]))
    inlist = ", ".join(lit(w) for w in words)
    return f"list_filter({expr}, lambda t: length(t) > 1 AND t NOT IN ({inlist}))"


def clean_tokens(expr: str, stop: list[str] | None) -> str:
    return valid(split_words(norm_punct(norm_format(expr))), stop)
