"""Months of experience that a text shows in an area, as columns: date ranges near its terms, and amounts in words.

Everything is an array of occurrences with offsets in the folded text, built by Spark's own pattern functions; so it runs inside
the JVM over whole texts. Months count from year 0, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veinwork.functions.dates import covered_months
from veinwork.functions.text import plain, plain_text

#: Month names and their short forms, with the month of the year from 0. Fixed values.
MONTHS = {
    "enero": 0, "ene": 0,
    "febrero": 1, "feb": 1,
    "marzo": 2, "mar": 2,
    "abril": 3, "abr": 3,
    "mayo": 4, "may": 4,
    "junio": 5, "jun": 5,
    "julio": 6, "jul": 6,
    "agosto": 7, "ago": 7,
    "septiembre": 8, "setiembre": 8, "sep": 8, "set": 8,
    "octubre": 9, "oct": 9,
    "noviembre": 10, "nov": 10,
    "diciembre": 11, "dic": 11,
}
#: Words for an end that hasn't come. Fixed values.
STILL = ("actualidad", "actual", "presente", "hoy")
#: Characters on either side of a range in which a term of the area counts; longer ranges (in months) are no employment; the largest amount.
NEAR, MOST_MONTHS, MOST_AMOUNT = 180, 600, 59
#: Words between a term and an amount after it, and between an amount and a term after it; characters that may stand in between. Fixed values.
BEFORE_AMOUNT = ("durante", "por", "con", "cuento con", "experiencia de", "experiencia")
AFTER_AMOUNT = ("de experiencia", "trabajando", "como", "en el area de", "en")
APART, CLOSE = 100, 35

_MONTH = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
#: A date is a year, after a month as a number or a name, or none.
_DATE = rf"(?:([0-9]{{1,2}})[/.\-]|({_MONTH})\.?\s+(?:de\s+)?)?([0-9]{{4}})"
_RANGE = rf"{_DATE}\s*(?:-|–|—|a|hasta)\s*(?:{_DATE}|({'|'.join(STILL)}))"
_AMOUNT = r"([0-9]{1,2})\s*(anos?|mes(?:es)?)"
_SENTENCE = r"[^.;\n]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def occurrences(text: Column, pattern: str) -> Column:
    """Every match of a pattern in order: array of (at, found), ``at`` from 0. What lies between matches tells where they are.

    ``text`` is looked at several times, so it has to be a column or ``bound``. A text without a match is only searched once.
    """
    none = F.array().cast("array<struct<at:int,found:string>>")
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return bound(found, lambda all_: F.when(F.size(all_) > 0, bound(F.split(text, pattern, -1), lambda between: _placed(all_, between))).otherwise(none))


def _placed(found: Column, between: Column) -> Column:
    ends = F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<at:int,found:string>>").alias("all"))

    def add(done: Column, pair: Column) -> Column:
        at = done["to"] + F.char_length(pair["between"])
        one = F.struct(at.cast("int").alias("at"), pair["found"].alias("found"))
        return F.struct((at + F.char_length(pair["found"])).alias("to"), F.concat(done["all"], F.array(one)).alias("all"))

    pairs = F.transform(found, lambda m, k: F.struct(F.get(between, k).alias("between"), m.alias("found")))
    return F.aggregate(pairs, ends, add, lambda done: done["all"])


def _month(found: Column, group: int, end: bool) -> Column:
    """The month of the date whose parts are the groups from ``group`` on: the first or (for an end) the last one it may mean."""
    part = lambda k: F.regexp_extract(found, _RANGE, group + k)
    number = F.least(F.lit(11), F.greatest(F.lit(0), part(0).try_cast("int") - 1))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair]), part(1))
    month = F.when(part(0) != "", number).when(part(1) != "", named).otherwise(11 if end else 0)
    return part(2).try_cast("int") * 12 + month + (1 if end else 0)


def ranged_months(folded: Column, terms: list[str], present: Column) -> Column:
    """Months covered by all date ranges that have a term near them; overlaps count once."""

    def span(x: Column) -> Column:
        still = F.regexp_extract(x["found"], _RANGE, 7) != ""
        around = F.substring(folded, F.greatest(F.lit(1), x["at"] + 1 - NEAR), F.char_length(x["found"]) + NEAR + F.least(x["at"], F.lit(NEAR)))
        near = bound(around, lambda text: reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms]))
        return F.struct(_month(x["found"], 1, False).alias("s"), F.when(still, present).otherwise(_month(x["found"], 4, True)).alias("e"), near.alias("near"))

    spans = F.filter(F.transform(occurrences(folded, _RANGE), span), lambda x: x["near"] & (x["e"] > x["s"]) & (x["e"] - x["s"] <= MOST_MONTHS))
    return covered_months(F.array_sort(F.array_distinct(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))))


def stated_months(folded: Column, terms: list[str]) -> Column:
    """The most months that a sentence states for a term: an amount linked to the term before it or the one after it.

    An amount belongs to a term before it if no other linked amount stands in between, and to a term after it if it isn't
    inside the stretch of an earlier amount and its term.
    """
    linked = rf"(?:{'|'.join(BEFORE_AMOUNT)})\s*(?:mas de\s*)?"

    def months(x: Column) -> Column:
        n = F.regexp_extract(x["found"], _AMOUNT, 1).try_cast("int")
        of_years = F.contains(x["found"], F.lit("ano"))
        return F.when(n.between(1, MOST_AMOUNT), F.when(of_years, n * 12).otherwise(n)).otherwise(0)

    def of_term(amounts: Column, term: str) -> Column:
        t = re.escape(term)
        left = rf"{t}(?:(?!{linked}[0-9]{{1,2}}\s*(?:ano|mes)){_SENTENCE}){{0,{APART}}}{linked}$"
        right = rf"^{_SENTENCE}{{0,{APART}}}?(?:{'|'.join(AFTER_AMOUNT)})\s*{_SENTENCE}{{0,{CLOSE}}}{t}"
        far = APART + 2 * len(max(BEFORE_AMOUNT, key=len)) + len(term) + 20

        def before(x: Column) -> Column:
            start = F.greatest(F.lit(0), x["at"] - far)
            return F.substring(folded, start + 1, x["at"] - start).rlike(left)

        def step(done: Column, x: Column) -> Column:
            end = x["at"] + F.char_length(x["found"])
            after = F.char_length(F.regexp_extract(F.substring(folded, end + 1, F.lit(APART + CLOSE + len(term) + 40)), right, 0))

            def reached(reach: Column) -> Column:
                taken = (x["at"] >= done["reach"]) & (reach > 0)
                counts = taken | before(x)
                return F.struct(F.greatest(done["most"], F.when(counts, months(x)).otherwise(0)).alias("most"), F.when(taken, end + reach).otherwise(done["reach"]).alias("reach"))

            return bound(after, reached)

        most = F.aggregate(amounts, F.struct(F.lit(0).alias("most"), F.lit(0).alias("reach")), step, lambda done: done["most"])
        return F.when(F.contains(folded, F.lit(term)), most).otherwise(0)  # both ways of linking name the term

    found = lambda amounts: F.when(F.size(amounts) > 0, F.greatest(*[of_term(amounts, t) for t in terms], F.lit(0))).otherwise(0)
    return bound(occurrences(folded, _AMOUNT), found)


def relevant_months(text: Column, terms: tuple[str, ...], as_of: Column) -> Column:
    """Months in an area that a text shows, or null without any; ``present`` is the month after that of ``as_of``."""
    own = list(dict.fromkeys(map(plain_text, terms)))
    if not own:
        return F.lit(None).cast("int")
    present = F.year(as_of) * 12 + F.month(as_of)
    months = lambda folded: F.greatest(ranged_months(folded, own, present).cast("int"), stated_months(folded, own))
    shown = lambda folded: bound(months(folded), lambda n: F.when(n != 0, n))
    return bound(plain(F.coalesce(text, F.lit(""))), shown)
