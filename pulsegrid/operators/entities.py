"""Entities: classes by priority, deaths near a day, gender, and titles by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(claims: DataFrame, classes: DataFrame) -> DataFrame:
    """(qid, entity_class): the class of highest priority that one of an entity's types belongs to, else "other".
    classes (member, entity_class, priority) is a fixed rule table."""
    kinds = claims.select("qid", F.explode("p31").alias("member")).join(F.broadcast(classes), "member")
    best = kinds.groupBy("qid").agg(F.min(F.struct("priority", "entity_class")).alias("x"))
    return claims.select("qid").join(best, "qid", "left").select("qid", F.coalesce("x.entity_class", F.lit("other")).alias("entity_class"))


def died_near(is_human: Column, dates: Column, start: Column, before: int = 1, after: int = 7) -> Column:
    """A human with a valid date of death from before days after the start to after days before it."""
    gap = lambda d: F.datediff(start, d.try_cast("date"))
    return is_human & F.coalesce(F.exists(dates, lambda d: F.coalesce(gap(d).between(-before, after), F.lit(False))), F.lit(False))


def gender(values: Column, female: list[int], male: list[int]) -> Column:
    """female or male if all values say so; null without values; else other."""
    inside = lambda s: F.size(F.array_except(values, F.array(*[F.lit(x).cast("long") for x in s]))) == 0
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, None).when(inside(female), "female").when(inside(male), "male").otherwise("other")


def titles_by_language(links: DataFrame) -> DataFrame:
    """(qid, titles): a map from language to title."""
    first = links.groupBy("qid", "lang").agg(F.min("title").alias("title"))
    return first.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("lang", "title"))).alias("titles"))


def category(entity_class: Column, is_human: Column, dates: Column, start: Column) -> Column:
    """What an event is filed under: a death near its start, else the class of its entity."""
    return F.when(died_near(is_human, dates, start), "death").otherwise(entity_class)


CLAIM = "struct<mainsnak:struct<datavalue:struct<value:string>>>"


def claims_of(rows: DataFrame, body: str = "body") -> DataFrame:
    """(qid, p31, p17, dates_of_death) of entity documents in JSON: item numbers as arrays, and the dates of death as far as
    they are days (a year or month alone is none)."""
    value = f"struct<claims:map<string,array<{CLAIM}>>>"
    parsed = rows.select("qid", F.from_json(body, value).alias("j"))
    own = lambda p: F.coalesce(F.transform(F.element_at("j.claims", p), lambda c: c["mainsnak"]["datavalue"]["value"]), F.array().cast("array<string>"))
    numbers = lambda p: F.transform(F.filter(own(p), lambda v: v.rlike("^Q[0-9]+$")), lambda v: F.substring(v, 2, 20).cast("long"))
    dates = F.filter(F.transform(own("P570"), lambda v: F.substring(v, 2, 10)), lambda d: d.try_cast("date").isNotNull())
    return parsed.select("qid", numbers("P31").alias("p31"), numbers("P17").alias("p17"), dates.alias("dates_of_death"))
