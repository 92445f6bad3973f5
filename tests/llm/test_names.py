import math

from pyspark.sql import functions as F

from docmeter.llm import names as N


#: Scans of the largest plan of clusters().
MOST_SCANS = 6


def grouped(spark, *spellings, graph=1):
    others = [(g, f"{first} {last}{g}") for g in range(50, 90) for first in ("Anna", "Robert", "William", "Margaret") for last in ("Torv", "Benn")]
    rows = [(graph, s, 3) for s in spellings] + [(g, s, 3) for g, s in others]
    df = spark.createDataFrame([(*r, "x") for r in rows], "graph_id bigint, name string, uses bigint, center string")
    found = N.clusters(df).where(F.col("graph_id") == graph).collect()
    assert len(found) == len(set(spellings))
    out = {}
    for r in found:
        out.setdefault(r["center"], set()).add(r["name"])
    return sorted(map(sorted, out.values()))


def test_variants_of_a_person(spark):
    same = ["Robert Yaronham", "Yaronham, Robert", "R. Yaronham", "Bob Yaronham", "ROBERT YARONHAM", "Robert  Yaronham ", "Rob. Yaronham", "Dr. Yaronham", "RobertYaronham", "Robert Yarohnam", "Robert K. Yaronham"]
    assert grouped(spark, *same) == [sorted(same)]


def test_variants_of_an_organisation(spark):
    same = ["Falthemark Institute of Soil Chemistry", "Falthemark Inst. of Soil Chemistry", "Soil Chemistry, Falthemark Institute", "The Falthemark Institute of Soil Chemistry", "F.I.S.C.", "FALTHEMARK INSTITUTE OF SOIL CHEMISTRY"]
    other = ["Falthemark Historical Society"]
    assert grouped(spark, *same, *other) == sorted([sorted(same), other])


def test_like_names_stay_apart(spark):
    assert len(grouped(spark, "Ilse Malvaston", "Nathaniel Malvaston", "Malvaston", "Ilse Pelonach", "chapter 439", "chapter 811", "old violin of Falworth", "old violin of Fallund")) == 8


def test_blank_and_odd_names(spark):
    entities = spark.createDataFrame([(1, "A B", "t"), (1, None, "t"), (1, "  ", "t"), (None, "A B", "t")], "graph_id bigint, name string, source string")
    relations = spark.createDataFrame([(1, "A B", "!!!"), (1, "", " ")], "graph_id bigint, source string, target string")
    assert sorted((r["name"], r["uses"]) for r in N.spellings(entities, relations).collect()) == [("!!!", 1), ("A B", 2)]
    assert grouped(spark, "!!!", "???", "x" * 3000, "Ä") == sorted([["!!!"], ["???"], ["x" * 3000], ["Ä"]])


def test_empty(spark):
    assert N.clusters(spark.createDataFrame([], "graph_id bigint, name string, uses bigint")).count() == 0


def test_collision_curve():
    n = N.bands(0.4, 0.95, 3)
    assert 1 - (1 - 0.4**3) ** n >= 0.95 > 1 - (1 - 0.4**3) ** (n - 1)
    assert N.bands(0.8, 0.95, 3) < n


def test_banding_recall_against_brute_force(spark):
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(7, 11))) for _ in range(150)]
    words += [w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in words for i in [rng.randint(0, len(w) - 2)]]
    words = sorted(set(words))
    df = spark.createDataFrame([(1, w) for w in words], "graph_id bigint, token string")
    a, b = df.withColumnRenamed("token", "a"), df.withColumnRenamed("token", "b")
    every = {(r["a"], r["b"]) for r in a.join(b, "graph_id").where("a < b").where(N._alike(F.col("a"), F.col("b")) | N._nearly(F.col("a"), F.col("b"))).collect()}
    found = {(r["a"], r["b"]) for r in N.similar_tokens(df).collect()}
    assert found <= every and len(found) >= 0.9 * len(every) and math.isfinite(len(found))


def nodes_of(spark, rows):
    forms = spark.createDataFrame(rows, "graph_id bigint, name string").withColumn("uses", F.lit(1)).withColumn("tokens", F.array_sort(N.tokens_of(F.col("name"))))
    return N.nodes_of(forms.withColumn("canon", F.concat_ws(" ", "tokens"))).persist()


def recall(nodes):
    """Strict links found and those that brute force finds."""
    a, b = [nodes.select("graph_id", F.col("canon").alias(c)) for c in ("ca", "cb")]
    every = {tuple(r)[:3] for r in N.verified(a.join(b, "graph_id").where("ca < cb"), nodes).where("strict").collect()}
    found = {tuple(r)[:3] for r in N.links(nodes).where("strict AND a < b").collect()}
    assert found <= every
    return len(found), len(every)


def test_recall_of_names_against_brute_force(spark):
    """Names of common and short words, in one graph of many names and many of few."""
    import random

    rng = random.Random(11)
    given = ["Robert", "Anna", "Margaret", "William", "Li", "Ann", "Rosa", "Hugo"]
    last = ["Torv", "Lee", "Wu", "Smith", "Benn", "Harker", "Norden", "Castellan"]
    organised = ["National Library of {}", "{} Institute of Soil Chemistry", "{} Historical Society"]

    def slip(name):
        i = rng.randrange(1, len(name) - 1)
        return rng.choice([name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[:i] + name[i + 1 :], name[:i] + name[i] + name[i:], " ".join(reversed(name.split())), f"{name[0]}. {name.split()[-1]}"])

    plain = [f"{g} {x}" for g in given for x in last] + [o.format(x) for o in organised for x in last]
    rows = [(graph, n) for graph in range(1, 12) for n in rng.sample(plain, 20)] + [(99, n) for n in plain] + [(99, f"{g} {x}ington{i}") for g in given for i, x in enumerate(last)]
    nodes = nodes_of(spark, sorted(set(rows) | {(g, slip(n)) for g, n in rows}))
    found, every = recall(nodes)
    assert every > 200 and found >= 0.95 * every


def test_a_surname_that_a_graph_is_full_of(spark):
    """One surname holds a third of a graph: the slips of each name are found, other given names are no candidates."""
    given = ["Robert", "Anna", "Margaret", "William", "Rosa", "Hugo", "Petra", "Kenji", "Ursula", "Viggo", "Olga", "Edith"]
    rows = [(1, f"{g} Yaronham") for g in given] + [(1, f"{g[0]}{g[2]}{g[1]}{g[3:]} Yaronham") for g in given] + [(1, "Yaronham")] + [(1, f"{g} {x}") for g in given for x in ("Pelonach", "Ilanlund")]
    nodes = nodes_of(spark, rows)
    found, every = recall(nodes)
    assert found == every
    many = nodes.where(F.array_contains("tokens", "yaronham")).count()
    assert N.candidates(nodes).where("ca LIKE '%yaronham%' AND cb LIKE '%yaronham%'").count() < many * (many - 1) / 3


def test_stars_take_the_best_center(spark):
    nodes = spark.createDataFrame([(1, x, 1) for x in "abcde"], "graph_id bigint, canon string, uses bigint")
    pairs = [("a", "b", 0.9), ("a", "c", 0.9), ("c", "d", 0.8)]
    edges = spark.createDataFrame([(1, x, y, s) for a, b, s in pairs for x, y in ((a, b), (b, a))], "graph_id bigint, a string, b string, similarity double")
    got = {r["canon"]: r["center"] for r in N.stars(nodes, edges).collect()}
    assert set(got) == set("abcde") and got["e"] == "e" and all(got[got[x]] == got[x] for x in got)


def test_no_plan_is_large(spark):
    """The driver holds the scans and broadcasts of a whole plan at once: it takes many small plans, none of many scans."""
    status, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    known = {e.executionId() for e in scala_list(spark, status.executionsList())}
    assert len(grouped(spark, "Robert Yaronham", "R. Yaronham", "Yaronham", "Falthemark Institute of Soil Chemistry", "F.I.S.C.", "Ann Lee", "Lee")) == 3
    bus.waitUntilEmpty()
    new = [e.executionId() for e in scala_list(spark, status.executionsList()) if e.executionId() not in known]
    scans = [sum(n.name().startswith("Scan") for n in scala_list(spark, status.planGraph(i).allNodes())) for i in new]
    assert scans and max(scans) <= MOST_SCANS


def scala_list(spark, values):
    return list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(values))
