"""Column functions for paths, slugs, links and sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.schemas import TYPE_TO_DIR


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slugify(text: str | Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def meeting_slug(day: str | Column, title: str | Column) -> Column:
    return F.concat_ws("-", F.date_format(_c(day), "yyyy-MM-dd"), slugify(title))


def dated_path(raw_class: str | Column, captured_at: str | Column, file_name: str | Column) -> Column:
    """Where a raw item is filed away: raw/<class>/YYYY/MM/<file>."""
    return F.concat(F.lit("raw/"), _c(raw_class), F.lit("/"), F.date_format(_c(captured_at), "yyyy/MM"), F.lit("/"), _c(file_name))


def type_dir(kind: str | Column) -> Column:
    """Directory of a page type; null for a type that the vocabulary lacks."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in TYPE_TO_DIR.items() for x in pair)), _c(kind))


def wikilinks(body: str | Column) -> Column:
    """Slugs that a body links to: [[slug]], [[slug|label]], [[slug#heading]]."""
    return F.transform(F.regexp_extract_all(_c(body), F.lit(r"\[\[([^\]|#]+)")), lambda x: F.trim(x))


def content_key(content: str | Column) -> Column:
    return F.sha2(_c(content), 256)


def age_days(day: str | Column, as_of: str | Column) -> Column:
    return F.datediff(_c(as_of), _c(day))


def normalised(text: str | Column) -> Column:
    """Trimmed, with runs of white space as single blanks."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def is_empty(values: str | Column) -> Column:
    """Missing, null or without elements."""
    return F.coalesce(F.size(_c(values)), F.lit(0)) <= 0


def append_bullet(body: str | Column, heading: str | Column, bullet: str | Column) -> Column:
    """`body` with a bullet first under the heading, which is added at the end if the body lacks it.

    A section that has the bullet already stays as it is; the same line under other headings doesn't count.
    """
    title = F.concat(F.lit("## "), _c(heading))
    line = F.concat(F.lit("- "), _c(bullet))
    lines = F.split(_c(body), "\n")
    place = F.array_position(lines, title).cast("int")
    after = F.slice(lines, place + 1, F.greatest(F.size(lines) - place, F.lit(0)))
    ends = F.array_position(F.transform(after, lambda x: x.rlike("^#{1,2} ")), F.lit(True)).cast("int")
    section = F.when(ends > 0, F.slice(after, F.lit(1), ends - 1)).otherwise(after)
    with_line = F.concat(F.slice(lines, F.lit(1), place), F.array(line), after)
    return F.when((place > 0) & F.array_contains(section, line), _c(body)).when(place > 0, F.array_join(with_line, "\n")).otherwise(F.concat(_c(body), F.lit("\n\n"), title, F.lit("\n"), line))


def append_bullets(body: str | Column, heading: str | Column, bullets: Column) -> Column:
    """What `append_bullet` gives for one bullet after the other, in a single step: the last comes first, and those that the section has are left out."""
    title = F.concat(F.lit("## "), _c(heading))
    new = F.array_distinct(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)))
    lines = F.split(_c(body), "\n")
    place = F.array_position(lines, title).cast("int")
    after = F.slice(lines, place + 1, F.greatest(F.size(lines) - place, F.lit(0)))
    ends = F.array_position(F.transform(after, lambda x: x.rlike("^#{1,2} ")), F.lit(True)).cast("int")
    section = F.when(ends > 0, F.slice(after, F.lit(1), ends - 1)).otherwise(after)
    fresh = F.reverse(F.array_except(new, section))
    with_lines = F.concat(F.slice(lines, F.lit(1), place), fresh, after)
    own = F.concat(_c(body), F.lit("\n\n"), title, F.lit("\n"), F.array_join(F.reverse(new), "\n"))
    return F.when(F.size(new) == 0, _c(body)).when(place > 0, F.array_join(with_lines, "\n")).otherwise(own)


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters and digits, of any script."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def terms_of(question: str) -> list[str]:
    """What `tokens` gives for a question, on the driver."""
    return sorted(set("".join(c if c.isalnum() else " " for c in question.lower()).split()))
