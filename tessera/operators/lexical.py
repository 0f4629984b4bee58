"""Retrieval over chunks, entities and topics: chunks(chunk, ...), mentions(chunk, entity), topics(chunk, topic).

Every mode gives (chunk, score), best first, ties by chunk, `k` rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import vectors


def _best(scored: DataFrame, k: int) -> DataFrame:
    return scored.groupBy("chunk").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "chunk").limit(k)


def by_chunk(chunks: DataFrame, vector: list[float], k: int = 10) -> DataFrame:
    """Chunks(chunk, embedding) nearest to a vector."""
    return vectors.top_k(chunks, vector, k, key="chunk").select("chunk", "score")


def by_chunk_semantic(chunks: DataFrame, mentions: DataFrame, vector: list[float], k: int = 10, seeds: int = 5, decay: float = 0.5) -> DataFrame:
    """The nearest chunks, and those that mention what they mention, at a share of the best score that led to them."""
    near = by_chunk(chunks, vector, seeds)
    said = mentions.join(near, "chunk").groupBy("entity").agg(F.max("score").alias("score"))
    more = mentions.join(said, "entity").select("chunk", (F.col("score") * decay).alias("score"))
    return _best(near.unionByName(more), k)


def entities_named(entities: DataFrame, terms: list[str]) -> DataFrame:
    """(entity, hits) of entities(entity, name) whose names hold any of the terms, ignoring case."""
    low = F.lower("name")
    hits = sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))
    return entities.select("entity", hits.alias("hits")).filter("hits > 0")


def by_entity(mentions: DataFrame, entities: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """Chunks that mention the entities named, by the number of term hits of different entities."""
    found = entities_named(entities, terms)
    return _best(mentions.distinct().join(found, "entity").groupBy("chunk").agg(F.sum("hits").alias("score")), k)


def near_entities(mentions: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(entity, together): the entities that most chunks mention together with any of seeds(entity), seeds left out."""
    m = mentions.distinct()
    own = m.join(seeds.select("entity").distinct(), "entity", "left_semi").select("chunk").distinct()
    other = m.join(own, "chunk", "left_semi").join(seeds.select("entity"), "entity", "left_anti")
    return other.groupBy("entity").agg(F.count("*").alias("together")).orderBy(F.desc("together"), "entity").limit(most)


def by_entity_context(mentions: DataFrame, entities: DataFrame, terms: list[str], k: int = 10, most: int = 5) -> DataFrame:
    """Chunks of the entities named and of their context; an entity named counts double."""
    seeds = entities_named(entities, terms).select("entity")
    weight = seeds.withColumn("w", F.lit(2)).unionByName(near_entities(mentions, seeds, most).select("entity", F.lit(1).alias("w")))
    return _best(mentions.distinct().join(weight, "entity").groupBy("chunk").agg(F.sum("w").alias("score")), k)


def by_entity_network(mentions: DataFrame, entities: DataFrame, terms: list[str], k: int = 10, most: int = 5) -> DataFrame:
    """As by_entity_context, and one step farther: the context's own context; 4, 2 and 1 by distance."""
    seeds = entities_named(entities, terms).select("entity")
    one = near_entities(mentions, seeds, most).select("entity")
    two = near_entities(mentions, seeds.unionByName(one), most).select("entity")
    weight = seeds.withColumn("w", F.lit(4)).unionByName(one.withColumn("w", F.lit(2))).unionByName(two.withColumn("w", F.lit(1)))
    return _best(mentions.distinct().join(weight, "entity").groupBy("chunk").agg(F.sum("w").alias("score")), k)


def by_topic(topics: DataFrame, names: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """Chunks of the topics(chunk, topic) whose names(topic, name) hold a term, by the number of hits."""
    low = F.lower("name")
    hits = sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))
    found = names.select("topic", hits.alias("hits")).filter("hits > 0")
    return _best(topics.distinct().join(found, "topic").groupBy("chunk").agg(F.sum("hits").alias("score")), k)


def of_class(entities: DataFrame, kind: str, limit: int) -> DataFrame:
    """The first entities(entity, kind, ...) of a class."""
    return entities.filter(F.col("kind") == kind).orderBy("entity").limit(limit)
