"""Text of charts, lyrics and file names, as columns; all stay in the JVM.

Null in, null out, unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plain_letters(form: str) -> dict[str, str]:
    """Characters of one letter or digit a to z or 0 to 9 once they are taken apart (in a
    normal form, without combining marks), by that character."""
    out = {}
    for c in map(chr, (*range(0xAA, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF60))):
        parts = [x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x)]
        if len(parts) == 1 and parts[0].isascii() and parts[0].isalnum():
            out[c] = parts[0].lower()
    return out


#: Of words, compatible characters count too (full width letters, raised digits); of letters not.
WORD_LETTERS, PURE_LETTERS = _plain_letters("NFKD"), _plain_letters("NFD")


def _several_letters() -> dict[str, str]:
    """Letters and digits of all other characters that come apart into some (ligatures, fractions, units)."""
    out = {}
    for c in map(chr, range(0xAA, 0x10000)):
        letters = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if x.isascii() and x.isalnum())
        if letters and c not in WORD_LETTERS:
            out[c] = letters
    return out


SEVERAL_LETTERS = _several_letters()
#: The language names that headers use, and their codes.
LANGUAGES = {
    "spanish": "es", "español": "es", "espanol": "es", "english": "en", "french": "fr", "français": "fr",
    "german": "de", "deutsch": "de", "italian": "it", "portuguese": "pt", "português": "pt", "japanese": "ja",
    "korean": "ko", "chinese": "zh", "catalan": "ca", "catalán": "ca", "gallego": "gl", "dutch": "nl",
    "swedish": "sv", "finnish": "fi", "russian": "ru", "polish": "pl", "turkish": "tr", "latin": "la",
}
#: Marks around a word that are not shown.
MARKS = '.,;:!?"“”()¿¡'
OUTER_MARKS = f"[{MARKS}]"
#: What stands between performers.
BETWEEN_ARTISTS = r"(?i)\s+y\s+|\s+e\s+|\s*&\s*|\s*,\s*|\s+feat\.?\s+|\s+ft\.?\s+|\s+con\s+|\s+vs\.?\s+|\s+with\s+|\s+\+\s+|\s+x\s+"
#: Audio file endings that are kept.
AUDIO_ENDINGS = (".mp3", ".ogg", ".wav", ".m4a", ".flac", ".opus")
#: Characters that a path's component may not have, and the header of charts with relative beats.
UNSAFE = r"[^A-Za-z0-9 ._()'\-áéíóúñüÁÉÍÓÚÑÜ]"
RELATIVE = r"(?im)^#RELATIVE\s*:\s*yes"


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def plain(x: Column) -> Column:
    """ASCII only, which most words are: as many bytes as characters."""
    return F.octet_length(x) == F.char_length(x)


def has_key(x: Column) -> Column:
    """word_key(x) is not empty; asked of plain words without making the key."""
    return F.when(plain(x), x.rlike("[A-Za-z0-9]")).otherwise(word_key(x) != "")


def unaccented(x: Column, letters: dict[str, str] = WORD_LETTERS) -> Column:
    """Lower case without accents: characters that come apart into a letter or digit and
    marks are that letter or digit, and combining marks go."""
    low = F.lower(x)
    apart = F.regexp_replace(F.translate(low, "".join(letters), "".join(letters.values())), r"\p{M}", "")
    return F.when(plain(low), low).otherwise(apart)


#: ASCII characters that no key has.
NO_KEY = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def word_key(x: Column) -> Column:
    """What two spellings of a word share: a to z and digits, of ligatures and the like all of them."""
    near = unaccented(x)
    letters = F.create_map(*(F.lit(v) for pair in SEVERAL_LETTERS.items() for v in pair))
    apart = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(letters, c), c)), "")
    far = F.regexp_replace(unaccented(apart), "[^a-z0-9]", "")
    return F.when(plain(near), F.translate(near, NO_KEY, "")).otherwise(far)


def letters_key(x: Column) -> Column:
    return F.regexp_replace(unaccented(x, PURE_LETTERS), "[^a-z]", "")


def display(x: Column) -> Column:
    """Without outer white space and punctuation."""
    return stripped(F.regexp_replace(stripped(x), f"^{OUTER_MARKS}+|{OUTER_MARKS}+$", ""))


def word_display(x: Column) -> Column:
    """display() of a word that has no white space: a trim."""
    return F.btrim(x, F.lit(MARKS))


def lyric_text(x: Column) -> Column:
    """Lower case without punctuation, single spaces."""
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def number_of(x: Column) -> Column:
    """A decimal number with comma or point; null if it is none."""
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def number_text(x: Column) -> Column:
    """At most four decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", "")


def slug(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, 80)


def base_name(x: Column) -> Column:
    return F.regexp_extract(x, r"([^/]*)$", 1)


def path_part(x: Column, fallback: Column, most: int = 80) -> Column:
    """One safe component of a path; the fallback if nothing is left. Null is empty."""
    safe = F.regexp_replace(base_name(stripped(F.coalesce(x, F.lit("")))), UNSAFE, "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(safe, "^[ .]+|[ .]+$", ""), 1, most), F.lit("")), fallback)


def audio_name(x: Column) -> Column:
    """input with the file's ending if it is known, else .mp3."""
    ending = F.lower(F.regexp_extract(base_name(F.coalesce(x, F.lit("audio.mp3"))), r"[^.](\.[^.]*)$", 1))
    return F.concat(F.lit("input"), F.when(ending.isin(*AUDIO_ENDINGS), ending).otherwise(".mp3"))


def artists(x: Column) -> Column:
    """Performers named in an artist string, of two characters or more."""
    return F.filter(F.transform(F.split(x, BETWEEN_ARTISTS), stripped), lambda p: F.char_length(p) > 1)


def several_artists(x: Column) -> Column:
    return F.size(artists(x)) >= 2


def language_code(x: Column, default: str = "auto") -> Column:
    """Code of a language name; the default if it is unknown or null."""
    codes = F.create_map(*(F.lit(v) for pair in LANGUAGES.items() for v in pair))
    return F.coalesce(F.try_element_at(codes, F.lower(stripped(x))), F.lit(default))


def language_group(code: Column) -> Column:
    return F.when(code.isin("es", "en"), code).otherwise("other")


def chosen_language(x: Column, default: str = "es") -> Column:
    """Two small letters or auto; else the default."""
    return F.when(x.rlike(r"^([a-z]{2}|auto)$"), x).otherwise(default)


def one_of(x: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(x.isin(*allowed), x).otherwise(default)


def title_of(stem: Column, given: Column, tag: Column) -> Column:
    """Given, else what follows " - " in the file's stem, else the tag, else the stem."""
    named = F.when(F.instr(stem, " - ") > 0, F.regexp_extract(stem, r"^.*? - ([\s\S]*)$", 1))
    return stripped(F.coalesce(F.nullif(given, F.lit("")), named, F.nullif(tag, F.lit("")), F.nullif(stem, F.lit("")), F.lit("Untitled")))


def artist_of(stem: Column, given: Column, tag: Column) -> Column:
    named = F.when(F.instr(stem, " - ") > 0, F.substring_index(stem, " - ", 1))
    return stripped(F.coalesce(F.nullif(given, F.lit("")), named, F.nullif(tag, F.lit("")), F.lit("Unknown")))


def is_hold(text: Column) -> Column:
    """A note that only continues the syllable before it."""
    return stripped(text).isin("~", "")


def starts_hold(text: Column) -> Column:
    return F.startswith(stripped(text), F.lit("~"))


def relative_beats(text: Column) -> Column:
    """Charts whose beats restart on every line, as the profile tells them."""
    return F.instr(F.element_at(F.split(F.upper(text), "E\n"), 1), "#RELATIVE") > 0


def relative_header(text: Column) -> Column:
    """The same as the replay tells it: a header within the first 4096 bytes."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), 1, 4096), "ISO-8859-1")
    return head.rlike(RELATIVE)
