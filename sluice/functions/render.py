"""Messages: private ones and those for subscribers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.identity import source_display
from sluice.functions.text import bound, escape_html, first_nonempty, strip, truncate_ellipsis, truncate_html

#: Lengths that a message and its parts may have, the marks of its sections, and the headings in the functions below.
MESSAGE, DESCRIPTION, REASON = 4000, 3000, 1200
RULE = "────────────────────────"


def _sections(*parts: Column) -> Column:
    return truncate_html(F.array_join(F.array_compact(F.array(*parts)), "\n\n"), MESSAGE)


def _if(c: Column, heading: str) -> Column:
    """A section with `c`, escaped, below its heading; null if `c` is empty."""
    return bound(c, lambda text: F.when(text != "", F.concat(F.lit(heading), escape_html(text))))


def _description() -> Column:
    return _if(truncate_ellipsis(first_nonempty("description"), DESCRIPTION), f"{RULE}\n\n📋 <b>Description</b>\n\n")


def render_private() -> Column:
    """Message to the owner, from title, description, source, budget, categories (array), reason and ai_used."""
    e = lambda c: escape_html(first_nonempty(c))
    how = F.when(F.coalesce("ai_used", F.lit(False)), "🧠 <b>AI Recommendation</b>").otherwise("⚡ <b>Direct Match</b>")
    head = F.concat(F.lit("🚀 <b>New Freelance Opportunity</b>\n\n"), how, F.lit("\n\n🏢 <b>Platform</b>\n"), e("source"), F.lit("\n\n📄 <b>Project</b>\n"), e("title"))
    return _sections(
        head, _if(first_nonempty("budget"), "💰 <b>Budget</b>\n"), _description(),
        F.when(F.size("categories") > 0, F.concat(F.lit("🏷 <b>Categories</b>\n"), escape_html(F.array_join("categories", " • ")))),
        _if(truncate_ellipsis(first_nonempty("reason"), REASON), f"{RULE}\n\n💡 <b>Reason</b>\n\n"),
    )


def render_subscriber(names: Mapping[str, str] | None = None) -> Column:
    """Message to subscribers, from title, description, source, categories (array) and category_name; neither budget nor reason."""
    shown = source_display(first_nonempty("source"), names or {})
    head = F.concat(F.lit("🚀 <b>New "), escape_html(first_nonempty(strip(first_nonempty("category_name")), F.lit("Freelance"))), F.lit(" Opportunity</b>\n\n📄 <b>"), escape_html(first_nonempty("title")), F.lit("</b>\n🏢 <b>Platform</b>\n"), escape_html(shown))
    tags = F.array_join(F.transform("categories", lambda c: F.concat(F.lit("#"), F.replace(c, F.lit(" "), F.lit("")))), " ")
    return _sections(head, _description(), F.when(F.size("categories") > 0, F.concat(F.lit(f"{RULE}\n🏷 <b>Tags</b>\n"), escape_html(tags))))
