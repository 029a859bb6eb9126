"""Row-level expressions over decisions, times, labels and similarities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.functions import text as T
from queuemill.functions.vectors import bind
from queuemill.runtime import blank_to_null, present


def text_shape(subject: Column, description: Column) -> Column:
    """log1p of words, characters and subject words, then three yes/no marks."""
    subject_words = F.log1p(T.token_count(subject).cast("double"))
    return bind(T.raw_text(subject, description), lambda whole: F.array(
        F.log1p(T.token_count(whole).cast("double")),
        F.log1p(F.length(whole).cast("double")),
        subject_words,
        F.contains(whole, F.lit("?")).cast("double"),
        whole.rlike(r"(?U)\d").cast("double"),
        whole.rlike("(?i)" + fixed.URGENT).cast("double")))


def time_features(created: Column) -> Column:
    """Cyclic hour and weekday, weekend mark, working-hours mark; unreadable times get defaults."""
    at = F.try_to_timestamp(created, F.lit("yyyy-MM-dd HH:mm"))
    hour = F.coalesce(F.hour(at), F.lit(fixed.DEFAULT_HOUR)).cast("double")
    day = F.coalesce(F.weekday(at), F.lit(fixed.DEFAULT_WEEKDAY)).cast("double")
    turn = 2 * math.pi
    return F.array(
        F.sin(turn * hour / 24), F.cos(turn * hour / 24),
        F.sin(turn * day / 7), F.cos(turn * day / 7),
        (day >= 5).cast("double"),
        ((hour >= 8) & (hour < 17)).cast("double"))


def one_hot(value: Column, vocabulary: Column) -> Column:
    """1.0 at the value's place in the training vocabulary, all zeros when unknown."""
    return F.transform(vocabulary, lambda v: (v == F.coalesce(value, F.lit(""))).cast("double"))


def ticket_ref(ticket_id: Column) -> Column:
    return F.format_string(fixed.REF_FORMAT, ticket_id)


def is_numeric_ref(value: Column) -> Column:
    return F.trim(value).rlike(r"^\d+$")


def overridden(suggested: Column, chosen: Column) -> Column:
    """True only when both are present and differ."""
    return present(suggested) & present(chosen) & F.coalesce(suggested != chosen, F.lit(False))


def provenance(row=F.col) -> Column:
    """enriched > corrected > confirmed > none."""
    flag = lambda name: F.coalesce(row(name), F.lit(False))
    corrected = (flag("rejected") | present(row("referred_to"))
                 | flag("category_overridden") | flag("team_overridden"))
    chosen = present(row("chosen_category")) | present(row("chosen_team"))
    return (F.when(flag("enriched"), fixed.ENRICHED)
            .when(corrected, fixed.CORRECTED)
            .when(chosen, fixed.CONFIRMED))


def choice(chosen: Column, suggested: Column) -> Column:
    return F.coalesce(blank_to_null(chosen), blank_to_null(suggested))


def truncated(value: Column, limit: int) -> Column:
    return F.substring(F.coalesce(value, F.lit("")), 1, limit)


def applicability(similarity: Column) -> tuple[Column, Column, Column]:
    """Band label, observed rate and floor; below every floor counts as the lowest band."""
    last_floor, last_label, last_rate = fixed.APPLICABILITY[-1]
    label, rate, floor = F.lit(last_label), F.lit(last_rate), F.lit(last_floor)
    for low, name, observed in reversed(fixed.APPLICABILITY[:-1]):
        at_least = similarity >= low
        label = F.when(at_least, name).otherwise(label)
        rate = F.when(at_least, observed).otherwise(rate)
        floor = F.when(at_least, low).otherwise(floor)
    return label, rate, floor


def softmax(margins: Column) -> Column:
    """Margins to a ranking score that sums to one; NULL marks a class the model never saw."""
    above = lambda p: F.transform(p["m"], lambda x: F.coalesce(F.exp(x - p["peak"]), F.lit(0.0)))
    powers = bind(F.struct(margins.alias("m"), F.array_max(margins).alias("peak")), above)
    summed = lambda v: F.struct(v.alias("v"), F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x).alias("total"))
    return bind(bind(powers, summed), lambda p: F.transform(p["v"], lambda x: x / F.greatest(p["total"], F.lit(1e-12))))
