"""What a text says of the things in a caller's dictionary: which it names, where it was written, and how much of that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators import lexicon
from newsloom.session import counted, cut

# Fixed value: how a report says where it was written.
DATELINE = r"^\s*([\p{Lu}\p{Lo}][\p{L}\p{M} .'-]{1,40}?)\s*(?:,\s*\p{L}[\p{L}\p{M} ]{1,20}\s*\d{1,2}\s*)?[:—–-]{1,2}\s"


def dateline(body: Column) -> Column:
    """The place before the dash or colon that a body begins with; null without one or if it has more than four words."""
    said = F.trim(F.regexp_extract(body, DATELINE, 1))
    return F.when((said != "") & (F.size(F.split(said, " ")) <= 4), said)


def resolve(names: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """names joined with the entity of each name, letter case and outer space aside; a name of several entities gives each of them."""
    key = lambda c: F.lower(F.trim(c))
    known = entities.select("entity", F.explode("names").alias("__nl_n")).select("entity", key(F.col("__nl_n")).alias("__nl_k")).where("__nl_k != ''").distinct()
    return names.withColumn("__nl_k", key(F.col(name))).join(counted(known), "__nl_k").drop("__nl_k")


def capped(found: DataFrame, key: str, family: str, order: list[Column], caps: dict[str, int], otherwise: int = 1) -> DataFrame:
    """found with counted: whether a row is among the first of its family in its key, as many as the family's cap."""
    most = F.lit(otherwise)
    for name, n in caps.items():
        most = F.when(F.col(family) == name, n).otherwise(most)
    rank = F.row_number().over(Window.partitionBy(key, family).orderBy(*order))  # as many rows as a text names things
    return found.withColumn("counted", rank <= most)


def collect(texts: DataFrame, entities: DataFrame, key: str, title: str, body: str, caps: dict[str, int] | None = None) -> DataFrame:
    """key, entity, family, place, counted: the things that each text names in its title or body.

    entities: entity, names (array), family. place: title (also if the body names it too), dateline
    or body. Of each family only as many count as its cap says, those in the title first.
    """
    entities = cut(entities.select("entity", "names", "family"))  # else each use would gather the names again
    names = entities.select("entity", F.explode("names").alias("name"))
    part = lambda c, where: texts.select(F.struct(F.col(key).alias("key"), F.lit(where).alias("place")).alias("at"), F.col(c).alias("text"))
    named = lexicon.mentions(part(title, 0).unionByName(part(body, 2)), names, "at", "text").select(F.col("at.key").alias(key), "entity", "at.place")
    written = resolve(texts.select(F.col(key), dateline(F.col(body)).alias("__nl_d")).where("__nl_d IS NOT NULL"), entities, "__nl_d").select(key, "entity", F.lit(1).alias("place"))
    found = named.unionByName(written).groupBy(key, "entity").agg(F.min("place").alias("place"))
    found = found.join(counted(entities.select("entity", "family").distinct()), "entity")
    found = capped(found, key, "family", [F.col("place"), F.col("entity")], caps or {}, 1 if caps else 1 << 30)
    label = F.element_at(F.array(*[F.lit(x) for x in ("title", "dateline", "body")]), F.col("place") + 1)
    return found.select(key, "entity", "family", label.alias("place"), "counted")
