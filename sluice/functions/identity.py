"""Identities: deterministic job ids, project ids, source names."""

from __future__ import annotations

from collections.abc import Mapping
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of job ids.
JOB_NAMESPACE = UUID("6f6e6465-7370-4a6f-6273-7570706f7274")
#: A project id in a link: digits after /project/, then a separator or the end.
PROJECT_ID = r"(?U)/project/(\d+)(?:[/?#\-\s]|\z)"


def uuid5(name: Column, namespace: UUID = JOB_NAMESPACE) -> Column:
    """Name-based UUID (version 5) of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def job_uuid(identity: Column, job_id: Column) -> Column:
    """Id of a post: the same for the same feed identity and post id, whatever the feed is called."""
    return uuid5(F.concat(F.coalesce(identity.cast("string"), F.lit("")), F.lit(":"), F.coalesce(job_id.cast("string"), F.lit(""))))


def legacy_job_uuid(source: Column, identity: Column, job_id: Column) -> Column:
    """The id that older rows have, from the display source; null where it is the same."""
    return F.when(~source.eqNullSafe(identity), job_uuid(source, job_id))


def project_id(url: Column, pattern: str = PROJECT_ID) -> Column:
    """Project id in a link, null if there is none."""
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def source_display(source: Column, names: Mapping[str, str]) -> Column:
    """Display name of the first pattern that a source contains in any case; else the source."""
    out = source
    for pattern, name in reversed(names.items()):
        out = F.when(F.lower(source).contains(pattern), name).otherwise(out)
    return out
