"""Text expressions: stripping, normalising, titles, paragraphs, links, cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode blanks, and the separators that count as blank besides: one by one, and as a class.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = r"[\p{Z}\s\x{1c}-\x{1f}\x{85}]"
#: What a line doesn't hold when a text is split into lines for its title.
LINE_END = r"\n\r\x0B\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
#: Arabic letter forms that are folded, one to one.
FOLD_FROM, FOLD_TO = "أإآٱىؤئة", "اااايويه"
#: Fixed value: Arabic diacritics and tatweel.
MARKS = r"[\x{64B}-\x{65F}\x{670}\x{640}]"
#: A range around all these, which is quickly looked for.
FOLDED = r"[\x{622}-\x{671}]"
#: Fixed value: characters that are trimmed from the end of a link.
TRAILING = ".,;:!?)]}\"'"
#: Fixed value: what stands in the place of the text that a request leaves out.
TRUNCATED = "\n\n[Job description truncated]"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where `c` is computed once however often `f` uses it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), 0)


def strip(c: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def normalize_text(c: Column) -> Column:
    """Lower case, Arabic forms folded, marks dropped; letters, digits and single spaces are left. Null is empty."""
    low = F.lower(F.coalesce(c, F.lit("")))
    arabic = F.regexp_replace(F.translate(low, FOLD_FROM, FOLD_TO), MARKS, "")
    folded = F.when(F.octet_length(low) == F.length(low), low).when(low.rlike(FOLDED), arabic).otherwise(low)
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def first_line_title(c: Column) -> Column:
    """First line that isn't blank, stripped; empty if there is none."""
    line = F.substring_index(F.ltrim(F.coalesce(c, F.lit("")), F.lit(BLANKS)), "\n", 1)
    return strip_end(F.regexp_replace(line, rf"(?s)[{LINE_END}].*+", ""))


def unix_lines(c: Column) -> Column:
    """The text with line feeds for all line ends."""
    feed = F.lit("\n")
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), feed), F.lit("\r"), feed)


def after_title(c: Column) -> Column:
    """The lines after the first that isn't blank; empty if there is none."""
    return F.regexp_replace(unix_lines(c), rf"\A{BLANK}*+[^\n]*+\n?", "")


def normalize_paragraphs(c: Column) -> Column:
    """Stripped lines; runs of blank lines become one, single line ends a space, runs of spaces one."""
    text = F.array_join(F.transform(F.split(unix_lines(c), "\n"), strip), "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\n(?<!\n\n)(?!\n)", " ")
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def extract_url(c: Column) -> Column:
    """First http(s) link without trailing punctuation; a closing parenthesis stays if the link has opened it. Empty if there is none."""

    def trimmed(url: Column) -> Column:
        base = F.rtrim(url, F.lit(TRAILING))
        count = lambda x, char: F.length(x) - F.length(F.replace(x, F.lit(char), F.lit("")))
        tail = F.substring(url, F.length(base) + 1, F.length(url))
        # of the parentheses closed behind the base as many stay as are open there
        stay = F.least(count(tail, ")"), count(base, "(") - count(base, ")"))
        return F.when(stay > 0, F.concat(base, F.call_function("substring_index", tail, F.lit(")"), stay), F.lit(")"))).otherwise(base)

    url = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)https?://\S+", 0)
    return bound(url, lambda u: F.when(F.instr(F.lit(TRAILING), F.right(u, F.lit(1))) > 0, trimmed(u)).otherwise(u))


def contains_keyword(text: Column, keyword: Column) -> Column:
    """Whether a normalised text has the words of a normalised keyword next to each other; an empty keyword is never there."""
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (keyword != "") & padded(text).contains(padded(keyword))


def csv_items(c: Column) -> Column:
    """Items of a comma-separated list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def lenient_bool(c: Column) -> Column:
    """1, true, yes and y in any case are true; anything else, null too, is false."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def truncate_text(c: Column, limit: int = 3500, marker: str = TRUNCATED) -> Column:
    """At most `limit` characters, with a marker if any were cut."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(marker))).otherwise(c)


def truncate_ellipsis(c: Column, limit: int) -> Column:
    """At most `limit` characters; if cut, they end in three dots."""
    return F.when(F.length(c) > limit, F.concat(strip_end(F.left(c, F.lit(max(limit - 3, 0)))), F.lit("..."))).otherwise(c)


def truncate_html(c: Column, limit: int) -> Column:
    """As truncate_ellipsis, for markup with bold spans: no tag is left cut or open."""

    def whole(cut: Column) -> Column:
        last = lambda x: F.when(cut.contains(x), F.length(cut) - F.instr(F.reverse(cut), x) + 1).otherwise(0)
        return F.when(last("<") > last(">"), strip_end(F.left(cut, last("<") - 1))).otherwise(cut)

    def closed(text: Column) -> Column:
        count = lambda x: (F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))) / F.lit(len(x))
        return F.concat(text, F.repeat(F.lit("</b>"), F.greatest((count("<b>") - count("</b>")).cast("int"), F.lit(0))), F.lit("..."))

    short = lambda text: bound(bound(strip_end(F.left(text, F.lit(max(limit - 3, 0)))), whole), closed)
    return bound(c, lambda text: F.when(F.length(text) > limit, short(text)).otherwise(text))


def escape_html(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def first_nonempty(*columns: Column | str) -> Column:
    """The first that is neither null nor empty; else empty."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns), F.lit(""))
