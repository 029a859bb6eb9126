"""Text columns: one definition for the cleaned and the natural view of a ticket."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.functions.vectors import bind

# (?U): word edges, digits and blanks follow Unicode.
_U = "(?U)"
# The blanks of Unicode, spelled out: a plain class is much faster to test than a property.
_BLANKS = r" \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# All abbreviations share their word edges, so one test covers them.
_ANY_ABBREVIATION = _U + r"\b(?:" + "|".join(p.removeprefix(r"\b").removesuffix(r"\b") for p, _ in fixed.ABBREVIATIONS) + r")\b"
# What a text must contain for an artefact to be there; checked before the pattern is tried.
_ARTEFACT_MARKS = (("http", "www."), ("@",), ("mu-",), ())


def clean_text(text: Column) -> Column:
    """Lower-case, blank artefacts, expand abbreviations, keep a-z, squeeze blanks.

    Most texts hold no address and no abbreviation, so cheap tests decide whether the patterns run.
    """
    out = F.lower(text)
    for pattern, marks in zip(fixed.ARTEFACTS, _ARTEFACT_MARKS):
        out = bind(out, _blanking(pattern, marks))
    out = bind(out, _expand_abbreviations)
    # Everything but a-z becomes one blank: the same as blanking first and squeezing after.
    return F.coalesce(F.trim(F.regexp_replace(out, "[^a-z]+", " ")), F.lit(""))


def _blanking(pattern: str, marks: tuple[str, ...]):
    def blank(text: Column) -> Column:
        blanked = F.regexp_replace(text, _U + pattern, " ")
        if not marks:
            return blanked
        found = F.lit(False)
        for mark in marks:
            found = found | F.contains(text, F.lit(mark))
        return F.when(found, blanked).otherwise(text)
    return blank


def _expand_abbreviations(text: Column) -> Column:
    rewritten = text
    for pattern, replacement in fixed.ABBREVIATIONS:
        rewritten = F.regexp_replace(rewritten, _U + pattern, replacement)
    return F.when(text.rlike(_ANY_ABBREVIATION), rewritten).otherwise(text)


def build_text(subject: Column, description: Column) -> Column:
    """The cleaned subject twice, then the cleaned description."""
    return weighted_text(clean_text(subject), clean_text(description))


def weighted_text(subject_clean: Column, description_clean: Column) -> Column:
    """The same from fields that are already clean, so no text is cleaned twice."""
    return F.trim(F.concat_ws(" ", subject_clean, subject_clean, description_clean))


def raw_text(subject: Column, description: Column) -> Column:
    """`Subject. Description` as written, blanks squeezed."""
    edge = _U + r"^\s+|\s+$"
    subject = F.regexp_replace(F.coalesce(subject, F.lit("")), edge, "")
    description = F.regexp_replace(F.coalesce(description, F.lit("")), edge, "")
    joined = F.concat(subject, F.lit(". "), description)
    return F.trim(F.regexp_replace(joined, _U + r"\s+", " "))


def token_count(text: Column) -> Column:
    """Number of blank-separated tokens, 0 for an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{_BLANKS}]+")), F.lit(0)).cast("long")


def is_test_ticket(subject: Column, description: Column) -> Column:
    pattern = "(?Ui)" + fixed.TEST_TICKET
    return _match(subject, pattern) | _match(description, pattern)


def lacks_text(subject: Column, description: Column) -> Column:
    return (_match(description, "(?Ui)" + fixed.JUNK_DESCRIPTION)
            & (F.length(F.coalesce(subject, F.lit(""))) < fixed.SHORT_SUBJECT))


def _match(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern)


def fix_tokens(text: Column) -> Column:
    """Distinct a-z words longer than two letters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"))
    return F.array_distinct(F.filter(words, lambda word: F.length(word) > 2))


def jaccard(left: Column, right: Column) -> Column:
    return ratio_or_zero(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right)))


def same_fix(left: Column, right: Column) -> Column:
    """An empty token set matches nothing."""
    return (F.size(left) > 0) & (F.size(right) > 0) & (jaccard(left, right) >= fixed.SAME_FIX)


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _plain_latin() -> tuple[str, str]:
    """Accented letters and their base letters, by Unicode decomposition."""
    blocks = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in blocks]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    pairs = [(c, base) for c, base in pairs if len(base) == 1 and base != c]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def strip_accents(text: Column) -> Column:
    accented, plain = _plain_latin()
    return F.regexp_replace(F.translate(text, accented, plain), r"\p{M}+", "")


def words(text: Column) -> Column:
    """Word tokens of two or more characters, lower-cased, accents stripped."""
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(r"(?U)(\b\w\w+\b)"))


def clean_words(cleaned: Column) -> Column:
    """The same of a cleaned text, which has nothing but a-z and single blanks."""
    return F.filter(F.split(cleaned, " "), lambda word: F.length(word) >= 2)


def ngrams(tokens: Column) -> Column:
    """Single words followed by neighbouring pairs; the lambda binds the word list once."""
    return bind(tokens, _with_pairs)


def _with_pairs(tokens: Column) -> Column:
    shorter = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, 1, shorter), F.slice(tokens, 2, shorter),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, pairs)
