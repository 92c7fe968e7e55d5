"""Text and identity scalars as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Every Latin letter up to U+024F whose canonical decomposition starts with another letter."""
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _folding()
#: Combining marks; without counterparts in the target, ``translate`` drops them.
MARKS = "".join(map(chr, range(0x300, 0x370)))
#: The short fold of directory fields: fixed values.
SHORT_FROM, SHORT_TO = "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"


_PLAIN = str.maketrans({**dict(zip(FOLD_FROM, FOLD_TO)), **dict.fromkeys(MARKS)})


def plain_text(text: str) -> str:
    """``plain`` of a Python string."""
    return text.translate(_PLAIN).lower()


def plain(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(c, FOLD_FROM + MARKS, FOLD_TO))


def fold(c: Column) -> Column:
    """Lower case without diacritics, white space collapsed."""
    return F.trim(F.regexp_replace(plain(c), "\\s+", " "))


def short_fold(c: Column) -> Column:
    return F.lower(F.translate(c, SHORT_FROM, SHORT_TO))


def place_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def tokens(c: Column, least: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of the folded text, in order."""
    words = F.filter(F.split(plain(c), "[^\\p{L}\\p{N}]+"), lambda w: F.char_length(w) >= least)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(list(stop))) if stop else words)


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


def emails(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), 1), F.lower))


def clean_emails(values: Column) -> Column:
    kept = F.transform(values, lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.filter(kept, lambda v: (F.char_length(v) <= 254) & v.rlike(f"^{EMAIL}$")))


def clean_phones(values: Column) -> Column:
    """Numbers of 7 to 15 digits that aren't dates, times, zeros or one digit over and over."""
    spaced = F.transform(values, lambda v: F.trim(F.regexp_replace(v, "[^0-9+]+", " ")))

    def real(v: Column) -> Column:
        d = F.regexp_replace(v, "[^0-9]", "")
        n = F.char_length(d)
        date = d.rlike("^(19|20)[0-9]{6}([0-9]{4,6})?$")
        clock = d.rlike("^(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{6}$") | v.rlike("^[0-9]{1,2} ?[0-9]{1,2} ?0{5,}$")
        return n.between(7, 15) & ((n <= 9) | d.startswith("598")) & ~d.rlike("^([0-9])\\1*$") & ~date & ~clock

    return F.array_distinct(F.filter(spaced, real))


def phone_identity(c: Column) -> Column:
    """One key for a number however it is written: digits, and the country prefix as a leading zero."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.char_length(d) < 7, "").when(d.rlike("^598[0-9]{8}$"), F.concat(F.lit("0"), F.substring(d, 4, 8))).otherwise(d)


def messaging_url(c: Column) -> Column:
    d = F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^00", "")
    full = F.when(d.rlike("^0[0-9]{8}$"), F.concat(F.lit("598"), F.substring(d, 2, 8))).when(d.rlike("^[249][0-9]{7}$"), F.concat(F.lit("598"), d)).otherwise(d)
    return F.concat(F.lit("https://wa.me/"), full)


#: Words of names that don't tell people apart.
PARTICLES = ("de", "del", "la", "las", "los", "y")


def folded_words(folded: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(folded, "[^a-z0-9]+", " "), " "), lambda w: (F.char_length(w) >= 2) & ~w.isin(*PARTICLES))


def names_likely_same(a: Column, b: Column) -> Column:
    """Equal names, or two shared words that are at least two thirds of the shorter name."""
    return folded_likely_same(fold(a), fold(b))


def folded_likely_same(a: Column, b: Column) -> Column:
    """``names_likely_same`` of names that are folded."""
    x, y = folded_words(a), folded_words(b)
    shared = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    return (a == b) | ((F.size(x) > 1) & (F.size(y) > 1) & (shared >= 2) & (shared / F.greatest(F.lit(1), F.least(F.size(x), F.size(y))) >= 0.66))


#: Marks of a PDF's bytes, and the letters that count as text.
BINARY_MARKS = "%pdf-|endobj|xref|startxref|/flatedecode|/xobject|/font|/colorspace"
LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"


def clean_document(c: Column, most: int = 50000) -> Column:
    """Text without control noise, or empty if it looks like the bytes of a file."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.replace(c, F.lit("\x00"), F.lit(" ")), F.lit("\r"), F.lit("\n")), "[ \\t]+", " "), "\\n{3,}", "\n\n"))
    low = F.lower(t)
    alpha = F.regexp_count(t, F.lit(f"[{LETTERS}]"))
    odd = F.regexp_count(t, F.lit(f"[^\\s{LETTERS}0-9@._%+\\-:,;()/]"))
    bad = (F.regexp_count(low, F.lit(BINARY_MARKS)) >= 3) | low.startswith("%pdf-") | ((F.char_length(t) > 200) & (odd > alpha * 0.35))
    return F.when(bad, "").otherwise(F.substring(t, 1, most))


def readable(c: Column) -> Column:
    compact = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))
    n = F.char_length(compact)
    letters = F.regexp_count(compact, F.lit(f"[{LETTERS}]"))
    return (n >= 80) & (letters / F.greatest(F.lit(1), n) >= 0.55) & (F.regexp_count(compact, F.lit("%PDF-|endobj|xref|/FlateDecode|/XObject")) < 5)


#: Accented letters as entities give plain ones.
ENTITIES = tuple((f"&{x}{mark};", x) for mark, letters in (("acute", "aeiouAEIOU"), ("tilde", "nN"), ("uml", "uU")) for x in letters)


def html_text(c: Column) -> Column:
    t = F.regexp_replace(c, "(?is)<(script|style)\\b.*?</\\1>", " ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), *ENTITIES):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def preview(c: Column, most: int = 420) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("..."))).otherwise(c)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again, if that leaves fewer telltale letters."""
    marks = lambda x: F.regexp_count(x, F.lit("[ÃÂ]"))
    latin = c.rlike("^[\\x00-\\xff]*$")
    again = F.when(latin, F.decode(F.encode(F.when(latin, c).otherwise(F.lit("")), "ISO-8859-1"), "UTF-8"))
    return F.when(latin & (marks(c) > 0) & (marks(again) < marks(c)) & ~F.contains(again, F.lit("�")), again).otherwise(c)


def document_fingerprint(text: Column) -> Column:
    return F.concat(F.lit("text-sha256:"), F.sha2(F.trim(text), 256))


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[;,|]"), lambda x: F.trim(x)), lambda x: x != "")
