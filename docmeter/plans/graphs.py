"""Queries over the extracted graphs: merged entities and edges, implicit nodes, rankings, local search, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docmeter.operators.graph import connected_components, label_propagation
from docmeter.functions.metrics import rounded
from docmeter.session import table

#: Tokens that a local search may spend on relationships.
BUDGET = 300


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each relationship once, with both ends; the strength is clamped to 1..10, a missing one stays null."""
    rows = table(spark, sf_dir, "relationships").distinct().where(F.col("source").isNotNull() & F.col("target").isNotNull())
    return rows.withColumn("strength", F.when(F.col("strength").isNotNull(), F.least(F.lit(10), F.greatest(F.lit(1), F.col("strength")))))


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges: how often each pair was stated, the mean strength (5 where it is missing) and the score."""
    edge = [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]
    mean = F.avg(F.coalesce("strength", F.lit(5)))
    return relationships(spark, sf_dir).where("source <> target").groupBy("graph_id", *edge).agg(
        F.count(F.lit(1)).alias("weight"), rounded(mean).alias("mean_strength"), F.round(F.count(F.lit(1)) * F.greatest(F.lit(0.1), mean / 10), 3).alias("score"),
    )


def merged_edge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the merged edges say: their distinct descriptions in the order of records, as a digest, and their text units."""
    rows = relationships(spark, sf_dir).where("source <> target").withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    key = ["graph_id", "a", "b"]
    stated = rows.where(F.coalesce(F.trim("description"), F.lit("")) != "").groupBy(*key, "description").agg(F.min("relationship_id").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "description")))
    texts = stated.groupBy(*key).agg(F.count(F.lit(1)).alias("n_descriptions"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["description"]), "\n"), 256).alias("digest"))
    units = rows.groupBy(*key).agg(F.count_distinct("text_unit_id").alias("n_units"))
    return units.join(texts, key, "left").select(*key, F.coalesce("n_descriptions", F.lit(0)).alias("n_descriptions"), "digest", "n_units")


def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a graph by name: the type of the first record, and the number of records and of distinct text units."""
    rows = table(spark, sf_dir, "entities", "entity_id", "graph_id", "name", "type", "text_unit_ids").where(F.col("name").isNotNull())
    merged = rows.groupBy("graph_id", "name").agg(F.min_by("type", F.when(F.col("type").isNotNull(), F.col("entity_id"))).alias("type"), F.count(F.lit(1)).alias("n_records"))
    units = rows.select("graph_id", "name", F.explode(F.array_distinct("text_unit_ids")).alias("unit")).where(F.col("unit").isNotNull()).distinct().groupBy("graph_id", "name").agg(F.count(F.lit(1)).alias("n_units"))
    return merged.join(units, ["graph_id", "name"], "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))


def folded_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of an entity in the order of records, each appended unless the text so far holds it. Equal ones are one
    before they meet."""
    rows = table(spark, sf_dir, "entities", "entity_id", "graph_id", "name", "description").where(F.col("name").isNotNull() & F.col("description").isNotNull() & (F.col("description") != ""))
    once = rows.groupBy("graph_id", "name", "description").agg(F.min("entity_id").alias("first"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "description")))
    text = F.aggregate(ordered, F.lit(""), lambda s, x: F.when(s.contains(x["description"]), s).when(s == "", x["description"]).otherwise(F.concat(s, F.lit(" "), x["description"])))
    return once.groupBy("graph_id", "name").agg(F.sum("n").alias("n"), text.alias("t")).where("n > 1").select("graph_id", "name", F.sha2("t", 256).alias("digest"), F.length("t").alias("n_chars"))


def implicit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of relationships that no entity record names, and in how many relationships they are."""
    rows = relationships(spark, sf_dir)
    ends = rows.select("graph_id", "relationship_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("name"))
    known = table(spark, sf_dir, "entities", "graph_id", "name").distinct()
    return ends.join(known, ["graph_id", "name"], "left_anti").groupBy("graph_id", "name").agg(F.count(F.lit(1)).alias("n_relationships"))


def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.upper(F.coalesce(F.trim("type"), F.lit("UNKNOWN")))
    kind = F.when(label.isin("PERSON", "CHARACTER"), "PERSON").when(label.startswith("ORG"), "ORGANISATION").otherwise(label)
    return table(spark, sf_dir, "entities", "type").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_entities"))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten heaviest edges of each node."""
    edges = merged_edges(spark, sf_dir)
    both = edges.select("graph_id", F.col("a").alias("name"), F.col("b").alias("other"), "weight", "mean_strength").unionByName(edges.select("graph_id", F.col("b").alias("name"), F.col("a").alias("other"), "weight", "mean_strength"))
    rank = Window.partitionBy("graph_id", "name").orderBy(F.desc("weight"), F.desc("mean_strength"), "other")
    return both.withColumn("rank", F.row_number().over(rank)).where("rank <= 10")


def top_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir)


def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = merged_edges(spark, sf_dir)
    ends = edges.select("graph_id", F.explode(F.array("a", "b")).alias("name"), "weight")
    return ends.groupBy("graph_id", "name").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))


def unit_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text units of each graph by the entities and relationships that name them: the five first."""
    entities = table(spark, sf_dir, "entities", "graph_id", "name", "text_unit_ids").select("graph_id", F.explode(F.array_distinct("text_unit_ids")).alias("unit"))
    stated = relationships(spark, sf_dir).select("graph_id", F.col("text_unit_id").alias("unit")).where(F.col("unit").isNotNull())
    hits = entities.unionByName(stated).where(F.col("unit").isNotNull()).groupBy("graph_id", "unit").agg(F.count(F.lit(1)).alias("n_hits"))
    rank = Window.partitionBy("graph_id").orderBy(F.desc("n_hits"), "unit")
    return hits.withColumn("rank", F.row_number().over(rank)).where("rank <= 5")


def local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the best connected node of each graph: its relationships in order of weight, as long as they fit the budget; the
    first that does not ends the list."""
    best = Window.partitionBy("graph_id").orderBy(F.desc("weight"), F.desc("degree"), "name")
    centers = node_degrees(spark, sf_dir).withColumn("n", F.row_number().over(best)).where("n = 1").select("graph_id", "name")
    lines = _top(spark, sf_dir).join(centers, ["graph_id", "name"])
    line = F.concat_ws(" -- ", "name", "other")
    cost = F.greatest(F.lit(1), F.floor(F.length(line) / 4) + F.col("weight"))
    spent = F.sum("cost").over(Window.partitionBy("graph_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("cost", cost).withColumn("spent", spent).where(F.col("spent") <= BUDGET).select("graph_id", "name", "other", "rank", "spent")


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected parts of the graphs: the node with the smallest name stands for each, with the number of nodes."""
    parts = connected_components(merged_edges(spark, sf_dir).select("graph_id", "a", "b"))
    return parts.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("n_nodes"))


def _communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_propagation(merged_edges(spark, sf_dir).select("graph_id", "a", "b", "weight"))


def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the graphs by propagation of labels along weighted edges, with their sizes."""
    return _communities(spark, sf_dir).groupBy("graph_id", "community").agg(F.count(F.lit(1)).alias("n_nodes"))


def community_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five first communities of each graph by how many of its ten best connected nodes they hold, then by size."""
    parts = _communities(spark, sf_dir)
    best = Window.partitionBy("graph_id").orderBy(F.desc("weight"), F.desc("degree"), "name")
    entries = node_degrees(spark, sf_dir).withColumn("n", F.row_number().over(best)).where("n <= 10").select("graph_id", "name", F.lit(1).alias("entry"))
    sized = parts.join(entries, ["graph_id", "name"], "left").groupBy("graph_id", "community").agg(F.count("entry").alias("n_matches"), F.count(F.lit(1)).alias("n_nodes"))
    rank = Window.partitionBy("graph_id").orderBy(F.desc("n_matches"), F.desc("n_nodes"), "community")
    return sized.where("n_matches > 0").withColumn("rank", F.row_number().over(rank)).where("rank <= 5")


QUERIES = {
    "merged_edges": merged_edges, "merged_entities": merged_entities, "folded_descriptions": folded_descriptions, "implicit_nodes": implicit_nodes, "type_labels": type_labels, "top_relationships": top_relationships,
    "node_degrees": node_degrees, "unit_ranking": unit_ranking, "local_search": local_search, "graph_components": graph_components, "graph_communities": graph_communities,
    "merged_edge_texts": merged_edge_texts, "community_ranking": community_ranking,
}

_REL = "(SELECT relationship_id, graph_id, source, target, description, text_unit_id, CASE WHEN strength IS NOT NULL THEN least(10, greatest(1, strength)) END AS strength FROM (SELECT DISTINCT * FROM relationships) WHERE source IS NOT NULL AND target IS NOT NULL)"
_EDGES = f"""(SELECT graph_id, least(source, target) AS a, greatest(source, target) AS b, count(*) AS weight, round(avg(coalesce(strength, 5)) + 1e-9, 6) AS mean_strength,
    round(count(*) * greatest(0.1::DOUBLE, avg(coalesce(strength, 5)) / 10), 3) AS score FROM {_REL} WHERE source <> target GROUP BY ALL)"""
_TOP = f"""(SELECT graph_id, name, other, weight, mean_strength, CAST(row_number() OVER (PARTITION BY graph_id, name ORDER BY weight DESC, mean_strength DESC, other) AS INT) AS rank FROM (
    SELECT graph_id, a AS name, b AS other, weight, mean_strength FROM {_EDGES} UNION ALL SELECT graph_id, b, a, weight, mean_strength FROM {_EDGES}) QUALIFY rank <= 10)"""
_DEGREES = f"(SELECT graph_id, name, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT graph_id, a AS name, weight FROM {_EDGES} UNION ALL SELECT graph_id, b, weight FROM {_EDGES}) GROUP BY ALL)"

_LABELS = "l0 AS (SELECT DISTINCT graph_id, a AS name, a AS community FROM both_ways)" + "".join(
    f""", l{i} AS (SELECT graph_id, name, community FROM (SELECT e.graph_id, e.a AS name, l.community, sum(e.weight) AS w FROM both_ways e JOIN l{i - 1} l ON l.graph_id = e.graph_id AND l.name = e.b GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY graph_id, name ORDER BY w DESC, community) = 1)"""
    for i in range(1, 6)
)
_COMMUNITIES = f"both_ways AS (SELECT graph_id, a, b, weight FROM {_EDGES} UNION ALL SELECT graph_id, b, a, weight FROM {_EDGES}), {_LABELS}"

SQL = {
    "graph_components": f"""WITH RECURSIVE both_ways AS (SELECT graph_id, a, b FROM {_EDGES} UNION SELECT graph_id, b, a FROM {_EDGES}),
        reached AS (SELECT DISTINCT graph_id, a AS name, a AS other FROM both_ways UNION SELECT r.graph_id, r.name, e.b FROM reached r JOIN both_ways e ON e.graph_id = r.graph_id AND e.a = r.other)
        SELECT graph_id, component, count(*) AS n_nodes FROM (SELECT graph_id, name, min(other) AS component FROM reached GROUP BY ALL) GROUP BY ALL""",
    "graph_communities": f"WITH {_COMMUNITIES} SELECT graph_id, community, count(*) AS n_nodes FROM l5 GROUP BY ALL",
    "community_ranking": f"""WITH {_COMMUNITIES}, e AS (SELECT graph_id, name FROM {_DEGREES} QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, degree DESC, name) <= 10),
        s AS (SELECT graph_id, community, count(e.name) AS n_matches, count(*) AS n_nodes FROM l5 LEFT JOIN e USING (graph_id, name) GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY n_matches DESC, n_nodes DESC, community) AS INT) AS rank FROM s WHERE n_matches > 0 QUALIFY rank <= 5""",
    "folded_descriptions": """SELECT graph_id, name, sha256(t) AS digest, length(t) AS n_chars FROM (
        SELECT graph_id, name, count(*) AS n, list_reduce(list(description ORDER BY entity_id), lambda s, x: CASE WHEN contains(s, x) THEN s ELSE s || ' ' || x END) AS t
        FROM entities WHERE name IS NOT NULL AND description <> '' GROUP BY graph_id, name) WHERE n > 1""",
    "merged_edge_texts": f"""WITH r AS (SELECT *, least(source, target) AS a, greatest(source, target) AS b FROM {_REL} WHERE source <> target),
        d AS (SELECT graph_id, a, b, description, min(relationship_id) AS i FROM r WHERE trim(description, ' ') <> '' GROUP BY ALL),
        t AS (SELECT graph_id, a, b, count(*) AS n_descriptions, sha256(string_agg(description, chr(10) ORDER BY i)) AS digest FROM d GROUP BY ALL), u AS (SELECT graph_id, a, b, count(DISTINCT text_unit_id) AS n_units FROM r GROUP BY ALL)
        SELECT u.graph_id, u.a, u.b, coalesce(n_descriptions, 0) AS n_descriptions, digest, n_units FROM u LEFT JOIN t USING (graph_id, a, b)""",
    "merged_edges": f"SELECT * FROM {_EDGES}",
    "merged_entities": """SELECT graph_id, name, arg_min(type, entity_id) FILTER (type IS NOT NULL) AS type, count(*) AS n_records, CAST(len(list_distinct(flatten(list(coalesce(text_unit_ids, []))))) AS BIGINT) AS n_units
        FROM entities WHERE name IS NOT NULL GROUP BY graph_id, name""",
    "implicit_nodes": f"""WITH e AS (SELECT DISTINCT graph_id, relationship_id, unnest([source, target]) AS name FROM {_REL})
        SELECT graph_id, name, count(*) AS n_relationships FROM e ANTI JOIN (SELECT graph_id, name FROM entities WHERE name IS NOT NULL) k USING (graph_id, name) GROUP BY graph_id, name""",
    "type_labels": """SELECT CASE WHEN l IN ('PERSON', 'CHARACTER') THEN 'PERSON' WHEN l LIKE 'ORG%' THEN 'ORGANISATION' ELSE l END AS kind, count(*) AS n_entities
        FROM (SELECT upper(coalesce(trim(type), 'UNKNOWN')) AS l FROM entities) GROUP BY kind""",
    "top_relationships": f"SELECT * FROM {_TOP}",
    "node_degrees": f"SELECT * FROM {_DEGREES}",
    "unit_ranking": f"""WITH h AS (SELECT graph_id, unit, count(*) AS n_hits FROM (SELECT graph_id, unnest(list_distinct(text_unit_ids)) AS unit FROM entities UNION ALL SELECT graph_id, text_unit_id FROM {_REL}) WHERE unit IS NOT NULL GROUP BY ALL)
        SELECT graph_id, unit, n_hits, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY n_hits DESC, unit) AS INT) AS rank FROM h QUALIFY rank <= 5""",
    "local_search": f"""WITH c AS (SELECT graph_id, name FROM {_DEGREES} QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, degree DESC, name) = 1),
        l AS (SELECT t.*, greatest(1, length(t.name || ' -- ' || t.other) // 4 + t.weight) AS cost FROM {_TOP} t JOIN c USING (graph_id, name)),
        s AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY graph_id ORDER BY rank) AS BIGINT) AS spent FROM l)
        SELECT graph_id, name, other, rank, spent FROM s WHERE spent <= {BUDGET}""",
}
