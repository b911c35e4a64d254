"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values, from the Unicode rules for word boundaries: marks that hold two letters together, and
# two digits. "don't", "e.g", "3.14" and "a_b" are one word each.
BETWEEN_LETTERS = "'\u2019.:\u00b7\u2027"
BETWEEN_DIGITS = "'\u2019.,;"

# A word has letters, digits, combining marks and underscores, and at least one letter or digit.
WORD_PATTERN = (
    r"_*[\p{L}\p{N}][\p{L}\p{M}\p{N}_]*"
    rf"(?:(?:(?<=[\p{{L}}\p{{M}}])[{BETWEEN_LETTERS}](?=\p{{L}})|(?<=\p{{N}})[{BETWEEN_DIGITS}](?=\p{{N}}))"
    r"[\p{L}\p{M}\p{N}_]+)*"
)

# Fixed values, by script: ideographs and hiragana, each a word of its own; katakana, words by the run; signs
# that make up pictures, with what modifies or joins them.
SINGLE = r"\u2E80-\u2FDF\u3005-\u3007\u3021-\u3029\u3038-\u303B\u3041-\u3096\u309D-\u309F\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{1B001}-\x{1B11F}\x{20000}-\x{3FFFF}"
KATAKANA = r"\u30A1-\u30FA\u30FC-\u30FF\u31F0-\u31FF\uFF66-\uFF9F"
PICTURE = r"\u2600-\u27BF\u2B00-\u2BFF\x{1F000}-\x{1F1E5}\x{1F200}-\x{1F3FA}\x{1F400}-\x{1FAFF}"
REGION, TONE, SELECTOR, JOINER = r"\x{1F1E6}-\x{1F1FF}", r"\x{1F3FB}-\x{1F3FF}", r"\uFE0F", r"\u200D"
MAX_WORD = 255

_OWN_LETTER = rf"[\p{{L}}&&[^{SINGLE}{KATAKANA}]]"
_PICTURE = rf"[{PICTURE}](?:[{TONE}]|{SELECTOR})?"
_SCRIPT_PATTERN = "|".join(
    (
        rf"[{SINGLE}]\p{{M}}*",
        rf"[{KATAKANA}][{KATAKANA}\p{{M}}_]*",
        rf"{_PICTURE}(?:{JOINER}{_PICTURE})*",
        rf"[{REGION}]{{2}}",
        WORD_PATTERN.replace(r"\p{L}\p{N}]", rf"\p{{L}}\p{{N}}&&[^{SINGLE}{KATAKANA}]]")
        .replace(r"[\p{L}\p{M}\p{N}_]", rf"[\p{{L}}\p{{M}}\p{{N}}_&&[^{SINGLE}{KATAKANA}]]")
        .replace(r"(?=\p{L})", rf"(?={_OWN_LETTER})"),
    )
)
# Texts that may need the rules by script, or have words that may be too long. One range is tested quickly.
_SCRIPTED = rf"[\u2600-\x{{10FFFF}}]|(?<!\S)\S{{{MAX_WORD + 1}}}"

# Whitespace as Python's str.strip sees it; Spark's own trim removes spaces only.
STRIP_CHARS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def words(text: Column) -> Column:
    """Lower-cased words in order; an empty array for null or blank text.

    Ideographs and hiragana are words one by one, katakana by the run, and so are pictures with what is joined to
    them. Words of more than ``MAX_WORD`` characters come in parts of that length.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(lowered, F.lit(_SCRIPT_PATTERN), F.lit(0))
    cut = F.flatten(
        F.transform(
            found,
            lambda w: F.when(F.length(w) <= MAX_WORD, F.array(w)).otherwise(
                F.regexp_extract_all(w, F.lit(rf"(?s).{{1,{MAX_WORD}}}"), F.lit(0))
            ),
        )
    )
    # Few texts need the longer pattern; it gives the same words for all others.
    return F.when(lowered.rlike(_SCRIPTED), cut).otherwise(F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP_CHARS))


def compose(title: Column, text: Column) -> Column:
    """``strip(title + newline + text)``; a document without a title keeps its text untouched."""
    body = F.coalesce(text, F.lit(""))
    return F.when(F.coalesce(title, F.lit("")) == "", body).otherwise(
        strip(F.concat(title, F.lit("\n"), body))
    )


def term_bucket(term: Column, dim: int) -> Column:
    """Position of a term in a hashed vector: first 32 bits of its MD5, modulo ``dim``."""
    head = F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(dim)).cast("int")
