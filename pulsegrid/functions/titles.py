"""Titles: percent-decoding, labels, addresses and folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that have no accent to take off, and what they become (fixed values).
PLAIN = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ø": "o", "đ": "d", "ł": "l", "ð": "d", "ı": "i"}


def _marked() -> dict[str, str]:
    """Small letters with accents up to U+1EFF and the letter that is left without them."""
    pairs = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x1F00))
    return {c: d[0] for c, d in pairs if len(d) > 1 and d[0] < "\u0250" and all(map(unicodedata.combining, d[1:]))}


def folded(text: Column) -> Column:
    """Lower case without accents, for comparing what people type."""
    marked = _marked()
    out = F.translate(F.lower(text), "".join(marked), "".join(marked.values()))
    for a, b in PLAIN.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_titles(rows: DataFrame, title: str = "title") -> DataFrame:
    """Percent-decode once (titles that would not be UTF-8 stay raw), then underscores for spaces; all in the JVM."""
    raw = F.col(title)
    # an escape that isn't one stands for itself; a plus sign is no space here
    coded = F.regexp_replace(F.replace(raw, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(coded)
    lossy = F.contains(decoded, F.lit("\ufffd")) & ~F.contains(F.upper(raw), F.lit("%EF%BF%BD")) & ~F.contains(raw, F.lit("\ufffd"))
    clean = F.when(F.contains(raw, F.lit("%")) & ~lossy & decoded.isNotNull(), decoded).otherwise(raw)
    return rows.withColumn(title, F.replace(clean, F.lit(" "), F.lit("_")))


def label(title: Column) -> Column:
    """A title as people read it: without a bracketed end, spaces for underscores."""
    return F.regexp_replace(F.replace(title, F.lit("_"), F.lit(" ")), r" \([^)]*\)$", "")


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.left(text, F.lit(n - 1))), F.lit("…"))).otherwise(text)


def wiki_url(lang: Column, title: Column) -> Column:
    """Address of an article; characters that would end or change it are escaped."""
    for a, b in (("%", "%25"), ("?", "%3F"), ("#", "%23"), ('"', "%22"), (" ", "_")):
        title = F.replace(title, F.lit(a), F.lit(b))
    return F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), title)


def infobox_time(text: Column) -> Column:
    """The time of a "timestamp = …" line of an infobox; null without one."""
    return F.try_to_timestamp(F.regexp_extract(text, r"\|\s*timestamp\s*=\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def place_parts(place: Column) -> Column:
    """struct(km, town, region) of "12 km NNE of Town, Region"; a place without a distance is a town."""
    far = place.rlike(r"^\d+ km .* of ")
    km = F.when(far, F.regexp_extract(place, r"^(\d+) km", 1).try_cast("int"))
    return F.struct(km.alias("km"), F.when(far, F.regexp_extract(place, " of (.+), ", 1)).otherwise(place).alias("town"), F.when(F.contains(place, F.lit(", ")), F.substring_index(place, ", ", -1)).alias("region"))
