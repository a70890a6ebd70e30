"""Scalar text functions: cleaning, escaping, previews, slugs. All are Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
#: Unicode's space separators; fixed values.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Phrases that mark an answer without information; fixed values, English then Russian.
NO_INFO = (
    "there is no",
    "no information",
    "does not contain information",
    "i do not know",
    "sorry",
    "the letter",
    "does not have a specific meaning",
    "please provide",
    "нет информации",
    "не содержат информации",
    "я не знаю",
    "извините",
    "уточните вопрос",
    "сведения отсутствуют",
)


def strip(c: Column) -> Column:
    """Both ends without Unicode white space, as a general-purpose ``strip`` does."""
    return F.regexp_replace(c, STRIP, "")


def clean_text(c: Column) -> Column:
    """Tags (at least one character between the brackets) removed, then stripped."""
    return strip(F.regexp_replace(c, "<[^>]++>", ""))


def html_escape(c: Column) -> Column:
    """& < > and both quotes as entities, the ampersand first."""
    return reduce(lambda s, x: F.replace(s, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), c)


def plain_title(c: Column) -> Column:
    """A title as the source has it on one line: space separators off both ends, then each run of ASCII white space one
    blank, then ``&lt;``, ``&gt;`` and ``&amp;`` replaced in this order; other references stay as written."""
    one_line = F.regexp_replace(F.btrim(c, F.lit(SPACES)), r"[\t\n\f\r ]+", " ")
    return reduce(lambda s, x: F.replace(s, F.lit(x[0]), F.lit(x[1])), (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")), one_line)


def lines(c: Column) -> Column:
    """All line ends that Unicode knows; a text that ends with one has a last empty line."""
    return F.split(c, LINE_END, -1)


def preview(c: Column) -> Column:
    """What follows the first two lines, without line ends around it."""
    rest = F.array_join(F.slice(lines(c), 3, F.greatest(F.size(lines(c)), F.lit(1))), "\n")
    return F.coalesce(F.regexp_replace(rest, r"^\n+|\n+$", ""), F.lit(""))


def normalised_layout(c: Column) -> Column:
    """Each bullet as an item on a line of its own, at most one empty line, single blanks, stripped."""
    c = F.regexp_replace(c, "•", "\n* ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, " {2,}", " "))


def without_index(c: Column) -> Column:
    """A heading without the numbering in front of it."""
    return F.regexp_replace(c, r"(?U)^[\s:.0-9]+", "")


def escape_underscores(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("\\_"))


def is_no_info(c: Column) -> Column:
    low = F.lower(strip(c))
    return reduce(lambda a, p: a | F.contains(low, F.lit(p)), NO_INFO[1:], F.contains(low, F.lit(NO_INFO[0])))


def language_by_script(c: Column) -> Column:
    """English, Russian or Arabic by which script has most letters; null without letters. Ties: in that order."""
    latin, cyrillic, arabic = (F.length(F.regexp_replace(c, f"[^{r}]", "")) for r in ("A-Za-z", "Ѐ-ӿ", "؀-ۿ"))
    most = F.greatest(latin, cyrillic, arabic)
    return F.when(most == 0, None).when(latin == most, "English").when(cyrillic == most, "Russian").otherwise("Arabic")


def slug(path: Column) -> Column:
    """A url path as a file name: outer slashes gone, inner ones as underscores."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, "/+$", ""), "^/+", ""), F.lit("/"), F.lit("_"))


def joined_bullets(c: Column) -> Column:
    """In each line, what follows a dash and a blank: its first two ``<br>`` become ``: `` and ``. ``, blanks are single.

    Parts without text are left out, and so is a ``<br>`` at the end of the line.
    """
    single = lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))

    def one(line: Column) -> Column:
        before, item = (F.regexp_extract(line, r"(?U)^(.*?)(-[^\S\n].*)$", k) for k in (1, 2))
        parts = F.filter(F.transform(F.split(F.regexp_replace(item, "<br>$", ""), "<br>", 3), single), lambda x: x != "")
        shown = F.concat(F.get(parts, F.lit(0)), *(F.coalesce(F.concat(F.lit(mark), F.get(parts, F.lit(k))), F.lit("")) for k, mark in ((1, ": "), (2, ". "))))
        return F.when((item != "") & (F.size(parts) > 0), F.concat(before, shown)).otherwise(line)

    return F.array_join(F.transform(F.split(F.regexp_replace(c, r"(?U)<br>\s+<br>", "<br>"), "\n", -1), one), "\n")


def without_link_pipes(c: Column) -> Column:
    """No links whose text stands between bars, plain blanks, joined bullets, bars without their backslash, stripped."""
    c = F.regexp_replace(F.replace(c, F.lit("\xa0"), F.lit(" ")), r"(?s)\[\s*\|\s*.*?\|\s*\]\(.*?\)", "")
    return strip(F.replace(joined_bullets(c), F.lit("\\|"), F.lit("|")))


def bearer_token(header: Column) -> Column:
    """The token of an authorization header of that scheme, else null."""
    token = F.regexp_extract(header, r"(?s)^(?i:bearer) (.+)$", 1)
    return F.when(token != "", token)


def capitalised(c: Column) -> Column:
    """The first character in upper case, the others in lower case."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def iso_time(c: Column) -> Column:
    """A timestamp from ISO 8601 text, with or without zone; null where it is none."""
    return F.try_to_timestamp(c)


def day_text(c: Column) -> Column:
    """A timestamp as a day, with the name of the weekday."""
    return F.date_format(c, "yyyy-MM-dd EEEE")


def file_extension(name: Column) -> Column:
    """From the last dot on, empty for names that only begin with dots."""
    return F.regexp_extract(name, r"[^.].*(\.[^.]*)$", 1)
