"""Word lists: stop words, keywords, probe words.

Lists are read from text files with :func:`murmur.sources.io.read_word_list`.  The
default stop list below is our own short list of function words of the four
corpus languages; it is a parameter, not a value the rules depend on.
"""

from __future__ import annotations

# Longest list inlined into an expression; longer lists go through a
# broadcast anti-join on the exploded token table instead.
MAX_INLINE_WORDS = 50_000

DEFAULT_STOPWORDS = [
    "the", "and", "of", "to", "a", "in", "is", "it", "that", "for", "on", "with", "as",
    "was", "by", "at", "be", "this", "are", "from", "or", "an",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "qui", "que", "pour",
    "el", "los", "las", "y", "del", "por", "con", "se",
    "der", "die", "das", "und", "ist", "zu", "den", "mit", "von",
]
