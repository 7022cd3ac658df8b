"""Text clean-up expressions. Digits are ASCII 0-9; letters are any Unicode letter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from cotejo.functions import sequences

# Letters a recogniser writes where the form has a digit.
CONFUSABLE_LETTERS = "lI|OoSsBZzG"
CONFUSABLE_DIGITS = "11100558226"

# Characters dropped by the general clean-up.
GENERAL_NOISE = " .,-_/\\"

# Words printed on the form itself.
FORM_WORDS = ("cédula", "cedula", "of", "can", "firma", "nombre", "documento", "hicx6", "hicx", "firmas")
ROW_FORM_WORDS = ("cédula", "cedula", "of", "can", "firma", "nombre", "documento", "firmas")

# Particles kept in lower case inside a name.
NAME_PARTICLES = ("de", "del", "y", "e", "la", "las", "los")
NAME_PUNCTUATION = ".,;:()[]{}"

# Accented letters and their plain forms.
ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"

# Every blank that separates words (ASCII and Unicode).
BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def digits_only(text: Column) -> Column:
    """Every digit of the line as one number, whatever interrupts it."""
    return F.regexp_replace(text, "[^0-9]+", "")


def digit_runs(text: Column, shortest: int = 7, longest: int = 10) -> Column:
    """All greedy, non-overlapping runs of ``shortest``..``longest`` digits, in text order."""
    return F.regexp_extract_all(text, F.lit("[0-9]{%d,%d}" % (shortest, longest)), F.lit(0))


def all_digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def clean_general(text: Column, noise: str = GENERAL_NOISE) -> Column:
    return F.translate(text, noise, "")


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def fix_confusable_letters(text: Column) -> Column:
    """Turn look-alike letters into digits, then keep digits only."""
    return digits_only(F.translate(text, CONFUSABLE_LETTERS, CONFUSABLE_DIGITS))


def letter_ratio(text: Column) -> Column:
    """Share of letters and blanks; NULL for empty text."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", ""))
    return kept / F.nullif(F.length(text), F.lit(0))


def _mentions(text: Column, words) -> Column:
    return F.lower(text).rlike("|".join(words))


def looks_like_name(text: Column, min_ratio: float = 0.7) -> Column:
    """Mostly letters, two characters or more, no word of the printed form, not a bare number."""
    bare_number = F.replace(text, F.lit(" "), F.lit("")).rlike("^[0-9]+$")
    return F.coalesce(
        (F.length(text) >= 2) & ~_mentions(text, FORM_WORDS) & (letter_ratio(text) >= min_ratio) & ~bare_number,
        F.lit(False),
    )


def looks_like_row_name(text: Column, min_ratio: float = 0.7) -> Column:
    """The row-wise variant: trims first and knows a shorter list of form words."""
    t = F.trim(text)
    return F.coalesce(
        (F.length(t) >= 2) & (letter_ratio(t) >= min_ratio) & ~_mentions(t, ROW_FORM_WORDS), F.lit(False)
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _without_final_dots(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\.+$", "")


def is_valid_name(text: Column) -> Column:
    """Four characters or more, with two words of 2+ characters or one of 4+."""
    t = _without_final_dots(text)
    long_words = F.filter(_words(t), lambda w: F.length(w) >= 2)
    single = (F.size(long_words) == 1) & (F.length(F.try_element_at(long_words, F.lit(1))) >= 4)
    return F.coalesce((F.length(t) >= 4) & ((F.size(long_words) >= 2) | single), F.lit(False))


def _strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")


def _capitalize(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    title = F.when(first == "ß", "Ss").otherwise(F.upper(first))
    return F.concat(title, F.lower(F.substr(word, F.lit(2))))


def _cased(word: Column, i: Column) -> Column:
    lowered = F.lower(word)
    return F.when((i > 0) & lowered.isin(*NAME_PARTICLES), lowered).otherwise(_capitalize(word))


def format_name(text: Column) -> Column:
    """Title case with lower-case particles. "First word" goes by source index, so a first word that strips to
    nothing leaves no forced capital."""
    long_words = F.filter(_words(_without_final_dots(text)), lambda w: F.length(w) >= 2)
    stripped = F.transform(long_words, lambda w, i: _cased(_strip_punctuation(w), i))
    return F.array_join(F.filter(stripped, lambda w: w != ""), " ")


def format_name_rowwise(text: Column) -> Column:
    """As :func:`format_name`, but punctuation goes from the whole string only and one-letter words stay."""
    words = _words(_strip_punctuation(normalize_whitespace(text)))
    return F.array_join(F.transform(words, _cased), " ")


def clean_printed_name(text: Column) -> Column:
    """Upper-case letters of a printed field, blanks collapsed."""
    one_line = F.translate(text, "\n\r", "  ")
    return normalize_whitespace(F.upper(F.regexp_replace(one_line, r"[^A-ZÁÉÍÓÚÑa-záéíóúñ\s]", "")))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def full_name(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


@F.pandas_udf(T.DoubleType())
def _matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    found = sequences.ratios([None if x is None else x for x in a], [None if y is None else y for y in b])
    return pd.Series(found).astype(object).where(~pd.isna(found), None)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity 2M / (len a + len b), NULL for a NULL. There is no built-in for it, so it runs as one
    Arrow function over distinct pairs of a batch; callers filter with cheaper predicates first."""
    return _matcher_ratio(a, b)


def surely_similar(a: Column, b: Column, ratio: float) -> Column:
    """A JVM-side sufficient test for ``sequence_ratio(a, b) >= ratio``.

    The longest matching block is at least as long as the common prefix or suffix, so a common edge of k characters
    with 2k / (len a + len b) >= ratio settles the question without Python."""
    total = F.length(a) + F.length(b)
    k = F.ceil(total * (ratio / 2) - 1e-9).cast("int")
    edge = (F.left(a, k) == F.left(b, k)) | (F.right(a, k) == F.right(b, k))
    fits = (k <= F.least(F.length(a), F.length(b))) & (k * 2.0 / total >= ratio)
    return F.coalesce((a == b) | (fits & edge), F.lit(False))
