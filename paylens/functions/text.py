"""Reading values from document text with native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one. The pattern is tried once, in lambdas and branches too, where nullif() tries it twice."""
    return let(F.regexp_extract(text, pattern, group), lambda found: F.when(found != "", found))


def first_of(text: Column, patterns: list[str], group: int = 1) -> Column:
    return F.coalesce(*[first_match(text, p, group) for p in patterns])


def either(words: list[str], gap: str = r"[\s-]*") -> str:
    """A pattern for any of the words, the longest first; a space in one stands for white space, a hyphen or nothing.

    No letter stands right before or after it. Where no first letter of a word stands, nothing else is tried.
    """
    firsts = "".join(sorted({re.escape(w[0]) for w in words}))
    ordered = sorted(words, key=lambda w: (-len(w), w))
    plain = "|".join(gap.join(p.replace(".", r"\.") for p in w.split()) for w in ordered)
    return rf"(?=[{firsts}])(?<!\p{{L}})(?:{plain})(?!\p{{L}})"


def mentions(lower: Column, words: list[str]) -> Column:
    """Whether the longest part of any of the words, between spaces or hyphens, is in a text in lower case: a cheap test before a pattern is tried.

    Two letters that patterns take for s and i aren't those in lower case: a text with one passes.
    """
    parts: list[str] = []
    for w in sorted((w.lower().replace("-", " ").split() for w in words), key=lambda w: (len(w), w)):
        if not any(p in part for p in parts for part in w):  # else a text with this word has the part of another one
            parts.append(max(w, key=len))
    out = F.contains(lower, F.lit(parts[0]))
    for p in [*parts[1:], "\u017f", "\u0131"]:
        out = out | F.contains(lower, F.lit(p))
    return out


def in_any_case(text: Column, lower: Column, body: Callable[[Column, str], Column]) -> Column:
    """body(text, "(?iu)"), or the faster body(text in lower case, "") where that finds the same: patterns have no capitals.

    Letters that patterns take for s and i, but that aren't those in lower case, are tried in the text as it is.
    """
    odd = F.contains(text, F.lit("\u017f")) | F.contains(text, F.lit("\u0131")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, body(text, "(?iu)")).otherwise(body(lower, ""))


def lowered(text: Column, lower: Column | None, body: Callable[[Column], Column]) -> Column:
    """body(text in lower case), which is taken from lower where it is given."""
    return let(F.lower(text), body) if lower is None else body(lower)


def money_value(raw: Column) -> Column:
    """A number from a money token: the last comma or dot is a decimal mark by what follows it."""
    def parsed(s: Column) -> Column:
        dotless = F.replace(s, F.lit("."), F.lit(""))
        comma = F.replace(dotless, F.lit(","), F.lit("."))
        whole = F.replace(s, F.lit(","), F.lit(""))
        value = F.when(s.rlike(r",\d{1,2}$"), comma).when(s.rlike(r"^-?\d{1,2},\d{3}$"), F.replace(s, F.lit(","), F.lit("."))).when(s.rlike(r"^-?\d{1,3}(\.\d{3})+$"), dotless).otherwise(whole)
        return value.try_cast("double")

    return let(F.regexp_replace(F.regexp_replace(raw, r"(?i)\b[A-Z]{2,3}\b", ""), r"[€$£¥\s]", ""), parsed)


# Month names by their first letters (Dutch, English, German, French, Spanish).
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fev": 2, "fév": 2, "mrt": 3, "maa": 3, "mar": 3, "mär": 3, "apr": 4, "avr": 4, "abr": 4, "mei": 5, "may": 5, "mai": 5,
    "jun": 6, "juin": 6, "jul": 7, "juil": 7, "aug": 8, "aoû": 8, "ago": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "dec": 12, "dez": 12, "déc": 12, "dic": 12,
}
DATE = r"\d{1,2}\.?\s+\p{L}{3,12}\.?\s+\d{4}|\p{L}{3,12}\.?\s+\d{1,2},?\s+\d{4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}|\d{1,2}[/\-.]\d{1,2}[/\-.](?:\d{4}|\d{2})(?!\d)"


def date_value(raw: Column, month_first: Column | None = None) -> Column:
    """A date from day-first numbers, year-first numbers or a day and month name in either order; null if there is no such day.

    Years of two digits are of this century. month_first reads numbers with slashes as month, day, year where
    it is true and the first can be a month.
    """
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def made(year: Column, month: Column, day: Column) -> Column:
        whole = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        return F.try_to_date(F.concat_ws("-", whole, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    def named(parts: Column, year: int, month: int, day: int) -> Column:
        name = F.lower(parts[month])
        return made(parts[year], F.coalesce(F.try_element_at(names, F.substring(name, 1, 4)), F.try_element_at(names, F.substring(name, 1, 3))), parts[day])

    def numbers(parts: Column) -> Column:
        turned = F.lit(False) if month_first is None else month_first & F.contains(parts[0], F.lit("/")) & (parts[1].cast("int") <= 12)
        return F.when(turned, made(parts[3], parts[1], parts[2])).otherwise(made(parts[3], parts[2], parts[1]))

    def groups(s: Column, pattern: str) -> Column:
        """The whole match and its groups."""
        return F.array(*[F.regexp_extract(s, pattern, i) for i in range(4)])

    def parsed(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\d{1,2}[/\-.]\d{1,2}[/\-.](?:\d{4}|\d{2})$"), let(groups(s, r"^(\d+)[/\-.](\d+)[/\-.](\d+)$"), numbers))
            .when(s.rlike(r"^\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}$"), let(groups(s, r"^(\d+)[/\-.](\d+)[/\-.](\d+)$"), lambda p: made(p[1], p[2], p[3])))
            .when(s.rlike(r"^\d{1,2}\.?\s+\p{L}{3,12}\.?\s+\d{4}$"), let(groups(s, r"^(\d+)\.?\s+(\p{L}+)\.?\s+(\d+)$"), lambda p: named(p, 3, 2, 1)))
            .when(s.rlike(r"^\p{L}{3,12}\.?\s+\d{1,2},?\s+\d{4}$"), let(groups(s, r"^(\p{L}+)\.?\s+(\d+),?\s+(\d+)$"), lambda p: named(p, 3, 1, 2)))
        )

    return let(F.trim(raw), parsed)


def words_in(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
