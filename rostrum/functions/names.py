"""Names of members and parties as column expressions, and string similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.functions.text import one_spaced

MAX_NAME = 45
CONJUNCTIONS = ("ve", "ile")
_ACCENTS = ("çğıöşüâîûÇĞİÖŞÜÂÎÛI", "cgiosuaiucgiosuaiui")


def normalize_mp_name(name: Column) -> Column:
    """Up to the first apostrophe-like mark, then the first comma or semicolon; single spaces."""
    name = F.get(F.split(name, "['’‛`]"), F.lit(0))
    return F.coalesce(one_spaced(F.get(F.split(name, "[,;]"), F.lit(0))), F.lit(""))


def strip_possessive(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?iu)['’]?\s*(?:nın|nin|nun|nün|ın|in|un|ün)$", ""))


def has_conjunction(name: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(name), " "), F.array(*map(F.lit, CONJUNCTIONS)))


def is_valid_name(name: Column, max_length: int = MAX_NAME) -> Column:
    return (F.length(name) <= max_length) & ~has_conjunction(name)


def name_problems(name: Column, max_length: int = MAX_NAME) -> Column:
    return F.array_compact(F.array(F.when(F.length(name) > max_length, "too long"), F.when(has_conjunction(name), "conjunction")))


def first_words(name: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(one_spaced(name), " "), 1, n), " ")


def clean_party_name(party: Column) -> Column:
    """Up to and with `Partisi`, else `Parti`, else as it is."""
    party = F.trim(party)
    upto = lambda w: F.nullif(F.regexp_extract(party, rf"(?i)^(.*?{w})\b", 1), F.lit(""))
    return F.coalesce(upto("Partisi"), upto("Parti"), party)


def party_without_term(party: Column) -> Column:
    """Without the `N.dönem ` prefix; if nothing else is left, as it is."""
    bare = F.trim(F.regexp_replace(party, r"^\d+\.dönem\s+", ""))
    return F.when(bare == "", party).otherwise(bare)


def folded(name: Column) -> Column:
    """Without accents, lower case: names that a lenient pattern would match are equal here."""
    return F.lower(F.translate(name, *_ACCENTS))


def member_id(name: Column) -> Column:
    return F.substring(F.md5(name), 1, 8)


@F.pandas_udf(T.DoubleType())
def ratio(candidate: pd.Series, query: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of lower-cased strings; the candidate is the first sequence."""
    matcher, out, last = SequenceMatcher(), [], None
    for a, b in zip(candidate, query, strict=True):
        if a is None or b is None:
            out.append(None)
            continue
        if b != last:
            matcher.set_seq2(b.lower())
            last = b
        matcher.set_seq1(a.lower())
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def length_bound(a: Column, b: Column) -> Column:
    """The most that `ratio` can be for strings of these lengths."""
    x, y = F.length(a), F.length(b)
    return 2.0 * F.least(x, y) / F.greatest(x + y, F.lit(1))


def letters_bound(a: Column, b: Column) -> Column:
    """The most that `ratio` can be for strings of these letters: matching blocks can't hold more than both have."""
    letters = lambda x: F.split(F.lower(x), "")
    count = lambda x, c: F.size(F.filter(letters(x), lambda y: y == c))
    both = F.aggregate(F.array_distinct(letters(a)), F.lit(0), lambda s, c: s + F.least(count(a, c), count(b, c)))
    return 2.0 * both / F.greatest(F.length(a) + F.length(b), F.lit(1))


def stance(parties: Column, topics: Column) -> Column:
    """A sentence on distinct parties (without terms) and the first topic."""
    bare = F.array_sort(F.array_distinct(F.transform(parties, party_without_term)))
    shown = F.when(F.size(bare) > 0, F.array_join(bare, ", ")).otherwise("Unknown party")
    top = F.get(topics, F.lit(0))
    return F.when(F.coalesce(F.size(topics), F.lit(0)) <= 0, F.concat(F.lit("Member of "), shown, F.lit(" with parliamentary activity."))).otherwise(F.concat(F.lit("Served in "), shown, F.lit(" with focus on "), top, F.lit(" and related parliamentary matters.")))


# What a letter of a name may stand for in a transcript, where it is more than the letter itself.
SPELLINGS = {
    "ç": "cç", "Ç": "cÇC", "ğ": "gğ", "Ğ": "gĞG", "ı": "ıiItT", "i": "ıiItTÎî", "I": "iİıIîÎ", "İ": "İIitTÎî", "ö": "oöOÖ", "Ö": "oöOÖ", "ş": "sşSŞ",
    "Ş": "sşSŞ", "ü": "uüUÜ", "Ü": "uüUÜ", "â": "aâAÂ", "Â": "aâAÂ", "î": "iîIÎtT", "Î": "iîIÎtT", "û": "uûUÛ", "Û": "uûUÛ",
}


def spelling_key(name: Column) -> Column:
    """Equal for a name and everything that its lenient pattern matches: folded, and t, which scans confuse with i, as i."""
    return F.translate(folded(name), "t", "i")


def lenient_pattern(name: Column) -> Column:
    """A regular expression of the spellings of a name in transcripts; other signs stand for themselves."""
    classes = F.create_map(*[F.lit(x) for c, of in SPELLINGS.items() for x in (c, f"[{of}]")])
    plain = lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.array_join(F.transform(F.split(name, ""), lambda c: F.coalesce(F.element_at(classes, c), plain(c))), "")
