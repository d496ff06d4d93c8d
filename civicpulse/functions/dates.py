"""Date functions; anything that does not parse becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date layouts found on pages.
POST_LAYOUT = "MMM d, yyyy, h:mm a"
REVIEW_LAYOUT = "MMMM d, yyyy"
RELATIVE = r"^(?:Yesterday|Today), (\d{1,2}:\d{2} [AP]M)"
REVIEWED_ON = r"^Reviewed ([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})"


def epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis.try_cast("bigint"))


def at_time(day: Column, clock: Column) -> Column:
    """Combine a date and a ``h:mm AM`` clock string."""
    stamp = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock)
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd h:mm a"))


def post_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(POST_LAYOUT))


def forum_time(text: Column, as_of: Column) -> Column:
    """Absolute, ``Today, ...`` and ``Yesterday, ...`` stamps relative to ``as_of``."""
    clock = F.nullif(F.regexp_extract(text, RELATIVE, 1), F.lit(""))
    today = F.to_date(as_of)
    return (
        F.when(F.contains(text, F.lit("Yesterday")), at_time(F.date_sub(today, 1), clock))
        .when(F.contains(text, F.lit("Today")), at_time(today, clock))
        .otherwise(post_date(text))
    )


def review_date(title: Column, text: Column) -> Column:
    """The date attribute, else the date in ``Reviewed <Month d, yyyy>``."""
    in_text = F.nullif(F.regexp_extract(text, REVIEWED_ON, 1), F.lit(""))
    stamp = F.coalesce(F.nullif(title, F.lit("")), in_text)
    return F.try_to_timestamp(stamp, F.lit(REVIEW_LAYOUT))
