"""Text expressions, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a general-purpose language's string strip takes it: Unicode white space and the separators 1C-1F.
BLANK = r"[\s\x1c-\x1f]"
#: The same, character by character.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A token: two word characters or more.
TOKEN = r"[\p{L}\p{N}_]{2,}"
SENTENCE = rf"(?U)[^。！？.!?]*[。！？.!?]+{BLANK}*|[^。！？.!?]+"
#: What stands between paragraphs: a blank line.
PARAGRAPHS = rf"(?U)\n{BLANK}*\n"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def tokenize(c: str | Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), F.lit(0))


def capitals(c: str | Column) -> Column:
    """Every letter in upper case that has one letter for it (sharp s: the capital one); the others stay."""
    large = lambda x: F.when(x == "ß", "ẞ").when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)
    return F.array_join(F.transform(F.split(_col(c), ""), large), "")


def ngrams(tokens: Column) -> Column:
    """Tokens, then neighbouring pairs joined by a blank."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>")))


def split_sentences(c: str | Column) -> Column:
    """Pieces that end after a run of sentence marks and the white space behind it; blank pieces go."""
    return F.filter(F.regexp_extract_all(_col(c), F.lit(SENTENCE), F.lit(0)), lambda s: strip(s) != "")


def text_profile(c: str | Column) -> dict[str, Column]:
    """chars, lines, words and a 200-character preview on one line."""
    t = _col(c)
    return {"chars": F.length(t), "lines": F.size(F.split(t, "\n")), "words": F.regexp_count(t, F.lit(r"(?U)[^\s\x1c-\x1f]+")), "preview": F.translate(F.substring(t, 1, 200), "\n", " ")}
