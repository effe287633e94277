"""Dates, numbers, arrays, JSON and hashes as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response lengths that targets are rounded to.
TARGETS = (50, 100, 250, 500, 1000, 2000)


# Dates


def iso_date(text: Column) -> Column:
    """The date that starts a string; null where it is none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def book_date(text: Column) -> Column:
    """Five spellings of a date; a month alone is its last day, a year alone its last day."""
    bare = F.btrim(F.regexp_replace(text, r"\[[^\]]*\]", ""))
    day = lambda pattern: F.try_to_date(bare, pattern)
    month = F.last_day(F.try_to_date(F.concat(F.regexp_replace(bare, ",? +", " "), F.lit(" 1")), "MMMM yyyy d"))
    year = F.when(bare.rlike(r"^\d{4}$"), F.try_to_date(F.concat(bare, F.lit("-12-31")), "yyyy-MM-dd"))
    return F.coalesce(day("MMMM d, yyyy"), F.when(bare.rlike(r"^[A-Za-z]+,? +\d{4}$"), month), day("yyyy-MM-dd"), year)


def edition_date(header: Column) -> Column:
    """The updated date of a book header, else its release date."""
    line = lambda label: F.nullif(F.regexp_extract(header, rf"(?im)^\s*{label}:\s*(.+?)\s*$", 1), F.lit(""))
    return F.coalesce(book_date(line("Most recently updated")), book_date(line("Release date")))


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


# Numbers


def nearest_target(words: Column, targets: Sequence[int] = TARGETS) -> Column:
    """The nearest target; the first one wins ties."""
    ranked = F.array(*[F.struct(F.abs(words - t).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(targets)])
    return F.array_min(ranked)["t"]


def length_adherence(words: Column, target: Column) -> Column:
    return F.when(words <= 0, F.lit(0.0)).otherwise(F.least(words, target).cast("double") / F.greatest(words, target))


def reward(probability: Column, words: Column, target: Column) -> Column:
    return (1 - probability) * length_adherence(words, target)


def token_limit(target: Column, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(64), F.ceil(target * F.lit(1.6)) + 16)).cast("long")


def backoff(attempt: Column, most: float, key: Column) -> Column:
    """Seconds to wait: 2 to the power of the attempt, at most ``most``, and a share of a second drawn by the key's hash."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(most)) + hash_int(key) / F.lit(4294967296.0)


def billable_units(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / 1000)).cast("long")


def score(probability: Column) -> Column:
    return F.round(probability * 100, 4)


def softmax2(human: Column, ai: Column, temperature: float) -> Column:
    """The second of two classes' probabilities at a temperature."""
    return 1 / (1 + F.exp((human - ai) / temperature))


def token_budget(words: Column, least: int, factor: float, extra: int) -> Column:
    return F.greatest(F.lit(least), F.ceil(words * F.lit(factor)) + extra).cast("long")


def axis_top(value: Column) -> Column:
    return F.greatest(F.lit(10), F.ceil(value * F.lit(1.15) / 5) * 5).cast("long")


def spread_pair(first: Column, second: Column, gap: float = 5.0, top: float = 100.0) -> tuple[Column, Column]:
    """Two labels moved apart around their middle if they stand closer than the gap."""
    wide, middle = F.abs(first - second) >= gap, (first + second) / 2
    return F.when(wide, first).otherwise(F.greatest(F.lit(0.0), middle - gap / 2)), F.when(wide, second).otherwise(F.least(F.lit(top), middle + gap / 2))


def percentage(text: Column) -> Column:
    """A number of 0 to 100, with or without a percent sign; null otherwise."""
    value = F.regexp_replace(F.btrim(text), "%$", "").try_cast("double")
    return F.when(value.between(0, 100), value)


# Arrays


def even_index(position: Column, count: Column, limit: int) -> Column:
    """Whether the item at a position (from 0) of ``count`` is one of ``limit`` evenly spaced ones."""
    if limit == 1:
        return (count <= 1) | (position == F.floor(count / 2))
    picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (count - 1) / (limit - 1), 0).cast("long"))
    return (count <= limit) | F.array_contains(picks, position.cast("long"))


def evenly_spaced(items: Column, limit: int) -> Column:
    n = F.size(items)
    if limit == 1:
        picked = F.array(F.get(items, F.floor(n / 2).cast("int")))
    else:
        picked = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.get(items, F.bround(i * (n - 1) / (limit - 1), 0).cast("int")))
    return F.when(n <= limit, items).otherwise(picked)


def causal_row(ids: Column, width: Column, pad: int, eos: int, fixed: bool) -> Column:
    """Ids with the end id right after them (variable) or in the last slot (fixed), padded to the width."""
    fill = F.array_repeat(F.lit(pad), (width - F.size(ids) - 1).cast("int"))
    end = F.array(F.lit(eos))
    return F.concat(ids, fill, end) if fixed else F.concat(ids, end, fill)


def causal_mask(ids: Column, width: Column, fixed: bool) -> Column:
    fill = F.array_repeat(F.lit(0), (width - F.size(ids) - 1).cast("int"))
    ones = F.transform(ids, lambda x: F.lit(1))
    return F.concat(ones, fill, F.array(F.lit(1))) if fixed else F.concat(ones, F.array(F.lit(1)), fill)


# JSON and hashes


def json_score(text: Column, field: str = "ai_score") -> Column:
    """An integer of 0 to 100 in a JSON object; null for other numbers, booleans, strings and broken JSON."""
    raw = F.regexp_extract(text, rf'"{field}"\s*:\s*(-?\d+)\s*[,}}]', 1)
    value = F.when(F.get_json_object(text, f"$.{field}").rlike(r"^-?\d+$"), raw.try_cast("int"))
    return F.when(value.between(0, 100), value)


def canonical_json(**fields: Column) -> Column:
    """A compact JSON object with sorted keys; strings are quoted, numbers are not."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def hash_int(text: Column) -> Column:
    """The first 32 bits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def hash_seed(text: Column) -> Column:
    """The first 64 bits of the SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def rank_key(*parts: Column) -> Column:
    """A hash that orders rows the same way wherever they are."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
