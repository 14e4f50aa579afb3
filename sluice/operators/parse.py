"""Posts from feeds: layouts, links, one schema for all feeds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import after_title, extract_url, first_line_title, first_nonempty, normalize_paragraphs, strip


@dataclass(frozen=True)
class Labels:
    """Labels of a labelled layout, and what in a source's name tells it (compared in lower case)."""

    sources: Sequence[str] = ("labelled",)
    title: str = "Title"
    description: str = "Details"
    budget: str = "Budget"


#: The Arabic labels of the layout that the tests use.
ARABIC = Labels(sources=("labelled",), title="عنوان المشروع", description="تفاصيل المشروع", budget="الميزانية")


def _laid(description: Column, paragraphs: bool) -> Column:
    return normalize_paragraphs(description) if paragraphs else description


def parse_labelled(text: Column, labels: Labels = ARABIC, paragraphs: bool = True) -> dict[str, Column]:
    """Title, description and budget after their labels; a missing title is the first line, a missing description the whole text."""
    text = F.coalesce(text, F.lit(""))
    title = rf"(?Uid){labels.title}\s*:\s*(.+)"
    description = rf"(?Us){labels.description}\s*:\s*(.*?)(?:\s*{labels.budget}|\z)"
    budget = rf"(?Ud){labels.budget}\s*:\s*(.+)"
    found = lambda p: strip(F.regexp_extract(text, p, 1))
    return {
        "title": F.when(text.rlike(title), found(title)).otherwise(first_line_title(text)),
        "description": _laid(F.when(text.rlike(description), F.regexp_extract(text, description, 1)).otherwise(text), paragraphs),
        "budget": F.when(text.rlike(budget), found(budget)).otherwise(""),
    }


def button_url(buttons: Column) -> Column:
    """First link of rows of buttons, null if there is none."""
    return F.get(F.filter(F.transform(F.flatten(F.filter(buttons, lambda r: r.isNotNull())), lambda b: b["url"]), lambda u: u.isNotNull() & (u != "")), 0)


def parse_posts(posts: DataFrame, labels: Labels = ARABIC, paragraphs: bool = True) -> DataFrame:
    """`posts` (source, text, maybe buttons) with title, description, budget, url and raw_text.

    Sources whose name contains a marker of `labels` have the labelled layout;
    others take the first line as title and the rest as description. Without
    `paragraphs` the blanks of descriptions stay as they are: their words are the
    same, so this is enough, and cheaper, where only words are looked at.
    """
    source, text = F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.lit(False)
    for marker in labels.sources:
        named = named | F.lower(source).contains(marker) | source.contains(marker)
    labelled = parse_labelled(text, labels, paragraphs)
    generic = {"title": first_line_title(text), "description": _laid(after_title(text), paragraphs), "budget": F.lit("")}
    parsed = {k: F.when(named, labelled[k]).otherwise(generic[k]) for k in generic}
    link = first_nonempty(extract_url(text), button_url(F.col("buttons"))) if "buttons" in posts.columns else extract_url(text)
    return posts.withColumns({**parsed, "url": link, "raw_text": text})


def feed_to_jobs(projects: DataFrame, platform: str = "Feed") -> DataFrame:
    """Feed projects (poll_source, uid, platform, title, description, price, project_link) as posts."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return projects.select(
        F.col("poll_source").alias("identity"), F.col("uid").cast("string").alias("job_id"), first_nonempty("platform", F.lit(platform)).alias("source"),
        text("title").alias("title"), text("description").alias("description"), text("price").alias("budget"), text("project_link").alias("url"),
        F.concat(text("title"), F.lit("\n\n"), text("description")).alias("raw_text"),
    )


def unify_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds in one table; columns that a feed lacks are null."""
    out = feeds[0]
    for other in feeds[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
