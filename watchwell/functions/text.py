"""Scalar functions over text, times and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """An ISO-8601 text as a UTC instant; without a zone it is UTC; null if blank or wrong."""
    t = F.trim(text)
    plain = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(t))
    basic = F.when(t.rlike(r"^\d{8}T\d{6}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss")))
    return F.coalesce(plain, basic)


def iso_utc(ts: Column) -> Column:
    """An instant as ISO-8601 text in UTC; the fraction only where there is one; "" if null."""
    fraction = F.when(F.unix_micros(ts) % 1_000_000 == 0, "").otherwise(F.date_format(ts, ".SSSSSS"))
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00")), F.lit(""))


def zoned_instant(text: Column, zone: str) -> Column:
    """An ISO-8601 text as a UTC instant; without a zone it is local to ``zone``."""
    t = F.trim(text)
    stated = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(stated, instant(t)).otherwise(F.to_utc_timestamp(instant(t), zone))


def shown(text: Column, zone: str, missing: str = "—", invalid: str = "Fecha inválida", zoneless: str = "Fecha sin zona") -> Column:
    """A display time in ``zone``, or a word for what is missing, wrong or without a zone."""
    t = F.coalesce(F.trim(text), F.lit(""))
    when = instant(t)
    stated = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    wall = F.date_format(F.from_utc_timestamp(when, zone), "dd/MM/yyyy HH:mm:ss")
    return F.when(t == "", missing).when(when.isNull(), invalid).when(~stated, zoneless).otherwise(wall)


def keyword_class(name: Column, category: Column) -> Column:
    """Event class by words in name and category."""
    text = F.lower(F.concat_ws(" ", name, category))
    has = lambda *words: text.rlike("|".join(words))
    return F.when(has("lockout"), "lockout").when(has("fail", "error"), "failure").when(has("success"), "success").otherwise("other")


def canonical_user(value: Column) -> tuple[Column, Column]:
    """The user's name in lower case, without domain, and how it was written."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    slash, at = F.contains(v, F.lit("\\")), F.contains(v, F.lit("@"))
    name = F.when(slash, F.substring_index(v, "\\", -1)).when(at, F.substring_index(v, "@", 1)).otherwise(v)
    kind = F.when(v == "", "missing").when(slash, "domain_backslash_user").when(at, "email_like").otherwise("other")
    return name, kind


def pseudonym(value: Column, secret: bytes, prefix: str) -> Column:
    """prefix_ and 24 hexadecimal digits of HMAC-SHA256; blank stays blank.

    The pads are as good as the secret and are part of the plan: keep plans and
    event logs of such jobs to yourself.
    """
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(value, "UTF-8")), 256))
    digest = F.sha2(F.concat(pad(0x5C), inner), 256)
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(prefix + "_"), F.left(digest, F.lit(24))))


def weight(text: Column) -> tuple[Column, Column]:
    """A whole number from 1 up, else 1; and whether it was one."""
    n = F.trim(text).try_cast("bigint")
    good = F.coalesce(F.trim(text).rlike(r"^[+]?\d+$") & (n >= 1), F.lit(False))
    return F.when(good, n).otherwise(F.lit(1).cast("long")), good


def service(text: Column) -> Column:
    """A trimmed service id; n/a is none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(t) == "n/a", "").otherwise(t)


def display_name(service_id: Column, label: Column) -> Column:
    """The label, else the readable end of a URL or URN."""
    tail = F.substring_index(F.regexp_replace(F.regexp_replace(service_id, r"[?#].*$", ""), r"[/:]+$", ""), "/", -1)
    tail = F.initcap(F.trim(F.regexp_replace(F.substring_index(tail, ":", -1), r"[-_.]+", " ")))
    return F.coalesce(label, F.when(tail == "", service_id).otherwise(tail))


def restricted(hour: Column, start: int, end: int) -> Column:
    """Whether an hour lies in [start, end), past midnight if end <= start; all day if equal."""
    if start == end:
        return F.lit(True)
    inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
    return inside


def listed(flags: Column, wanted: Sequence[str]) -> Column:
    """Flags that are wanted, sorted."""
    return F.array_sort(F.array_intersect(flags, F.array(*(F.lit(w) for w in wanted))))
