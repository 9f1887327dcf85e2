"""Text expressions: decoding, previews, words, labels, keyword strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 characters that count as white space: Unicode White_Space plus U+001C..U+001F.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
#: Runs of letters, marks and digits that hold a letter; written so that no regex engine has to go back.
WORD = r"[\p{M}\p{N}]*\p{L}[\p{L}\p{M}\p{N}]*"
PREFIX_CHARS = 5000
PREVIEW_WORDS = 500


def decode(content: Column) -> Column:
    """UTF-8 bytes to text: undecodable bytes dropped, line ends folded to ``\\n``."""
    text = content.cast("string")
    # U+FFFD marks bad bytes; those that the file itself holds are put aside meanwhile
    aside = F.replace(F.replace(text, F.lit("\ufdd0"), F.lit("\ufdd0\ufdd1")), F.lit("\ufffd"), F.lit("\ufdd0\ufdd2"))
    good = F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit(""))
    back = F.replace(F.replace(good, F.lit("\ufdd0\ufdd2"), F.lit("\ufffd")), F.lit("\ufdd0\ufdd1"), F.lit("\ufdd0"))
    text = F.when(F.is_valid_utf8(text), text).otherwise(back)
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def text_prefix(content: Column, max_chars: int = PREFIX_CHARS) -> Column:
    """The first ``max_chars`` code points of decoded content."""
    return F.substring(decode(content), 1, max_chars)


def squeeze(text: Column) -> Column:
    """White space runs to one blank, none at either end."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " "))


def word_preview(text: Column, max_words: int = PREVIEW_WORDS) -> Column:
    """The first ``max_words`` words joined by single blanks."""
    return F.substring_index(squeeze(text), " ", max_words)


def word_count(squeezed: Column) -> Column:
    """Words in a text that is already squeezed."""
    return F.when(
        squeezed != "", F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1
    ).otherwise(0)


def words(text: Column) -> Column:
    """Runs of letters, marks and digits with a letter among them, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def is_blank(text: Column) -> Column:
    return squeeze(text) == ""


def capitalise(label: Column) -> Column:
    """First letter upper, all others lower (a label such as ``HR`` becomes ``Hr``)."""
    head = F.upper(F.substring(label, 1, 1))
    rest = F.lower(F.substring(label, F.lit(2), F.length(label)))
    return F.concat(
        F.substring(head, 1, 1), F.lower(F.substring(head, F.lit(2), F.length(head))), rest
    )


def keyword_string(keywords: Column) -> Column:
    return F.array_join(keywords, ", ")


def parse_keywords(text: Column) -> Column:
    """Split at commas, strip each part, drop the empty ones."""
    return F.filter(F.transform(F.split(text, ","), squeeze_ends), lambda k: k != "")


def squeeze_ends(text: Column) -> Column:
    """Strip white space at both ends only."""
    return F.regexp_replace(text, rf"^{WHITESPACE}|{WHITESPACE}\z", "")
