"""Problem 5: spellings of the same person or organisation.

Names are reduced to tokens, which get MinHash signatures over padded 2-grams; banding, with the number of bands taken from
the collision curve, finds what is similar within a graph. Distinctive tokens (those that few graphs use) are banded one by
one: names that share one, or have similar ones, are candidates if another token of theirs begins or ends alike. Names
without a distinctive token (frequent given name and surname, short words) are banded whole, over the 2-grams of all their
tokens, against all names of the graph. Monge-Elkan similarity over all tokens verifies the candidates, star clustering
groups the names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from docmeter.session import cut, stored, table

ROWS = 3
#: Tokens of this Jaccard similarity over padded 2-grams (two letters swapped in a word of six) are found with RECALL.
SIMILARITY, RECALL = 0.4, 0.95
#: The same for whole names (a given name of six letters with an initial for a surname of eight).
WHOLE_SIMILARITY = 0.45
#: A token is distinctive if it has four letters or more, unless more graphs use it than both of these say.
COMMON_GRAPHS, COMMON_SHARE = 3, 0.01
SEED = 20_260_617
#: Least mean similarity of the tokens of the shorter and of the longer name, for organisations and for other names.
SHORTER, LONGER_ORGANISATION, LONGER_OTHER = 0.82, 0.8, 0.6
#: The same for a spelling that stands alone and is used less than RARE times the mean of its kind.
LOOSE, RARE = 0.74, 0.8

# Accented letters and the letters that stand for them.
ACCENTED = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōőřśşšťùúûüūůýÿźżž"
UNACCENTED = "aaaaaaaaacccdeeeeeeeiiiiilnnnooooooooorssstuuuuuuyyzzz"

# Titles and small words that do not tell names apart.
DROPPED = ["dr", "prof", "professor", "capt", "captain", "mr", "mrs", "ms", "miss", "sir", "dame", "lord", "lady", "rev", "the", "of", "for", "and", "in", "at"]

# Abbreviations in names of organisations.
ABBREVIATIONS = {
    "inst": "institute", "assoc": "association", "assn": "association", "ass": "association", "univ": "university", "u": "university", "dept": "department", "dep": "department",
    "lab": "laboratory", "labs": "laboratory", "lib": "library", "natl": "national", "nat": "national", "ntl": "national", "soc": "society", "bros": "brothers", "co": "company",
    "ltd": "limited", "publ": "publishing", "pub": "publishing", "tech": "technology", "technol": "technology", "res": "research", "hist": "historical", "sci": "science", "eng": "engineering", "biol": "biology", "intl": "international", "corp": "corporation",
}

# Words that mark organisations.
ORGANISATION = ["institute", "association", "university", "department", "laboratory", "library", "society", "brothers", "company", "limited", "publishing", "shipping", "corporation", "national", "historical"]

# Short forms of given names.
NICKNAMES = {
    "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bill": "william", "billy": "william", "will": "william", "chuck": "charles", "charlie": "charles", "dolly": "dorothea", "dot": "dorothea", "dora": "dorothea",
    "abby": "abigail", "becky": "rebecca", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "eliza": "elizabeth", "harry": "henry", "hank": "henry", "vicky": "victoria", "alex": "alexander", "sandy": "alexander",
    "ben": "benjamin", "benny": "benjamin", "andy": "andrew", "drew": "andrew", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine", "greg": "gregory", "ted": "theodore", "teddy": "theodore", "theo": "theodore",
    "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "ed": "edward", "eddie": "edward", "ned": "edward", "tom": "thomas", "tommy": "thomas", "sam": "samuel", "sammy": "samuel", "nate": "nathaniel", "nat": "nathaniel",
    "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "pat": "patricia", "patty": "patricia", "trish": "patricia", "fred": "frederick", "freddy": "frederick", "freddie": "frederick", "sue": "susannah", "susie": "susannah", "josie": "josephine", "jo": "josephine",
    "pip": "philippa", "pippa": "philippa", "len": "leonard", "lenny": "leonard", "leo": "leonard", "tilly": "matilda", "tilda": "matilda", "mattie": "matilda", "mike": "michael", "dick": "richard", "rick": "richard", "dan": "daniel", "tony": "anthony", "nick": "nicholas", "joe": "joseph", "dave": "david", "steve": "stephen",
}

INITIALISM = r"^\s*(?:\p{Lu}\.?){3,7}\s*$"


def bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The bands that find a pair of the given similarity with the given probability: 1 - (1 - s^rows)^bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def is_organisation(tokens: Column) -> Column:
    """Whether a token is, but for two slips, a word that marks organisations."""
    marks = F.array(*[F.lit(w) for w in ORGANISATION])
    return F.exists(tokens, lambda t: F.exists(marks, lambda m: (t == m) | ((F.length(t) >= 6) & (F.abs(F.length(t) - F.length(m)) <= 2) & (F.levenshtein(t, m) <= 2))))


def tokens_of(name: Column) -> Column:
    """The tokens of a name, as typed: accents, case, titles, small words and marks taken away, short forms written out. Of
    the initials of a person only the first stays, and none beside a given name."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"(\p{Ll})(\p{Lu}\p{Ll})", "$1 $2"), r"(?<=\p{Ll})( +)(\p{Lu})(\p{Lu})$", "$1$2 $3")
    folded = F.regexp_replace(F.translate(F.lower(spaced), ACCENTED, UNACCENTED), r"\bu\.? of\b", "university of")
    joined = F.regexp_replace(F.regexp_replace(folded, r"['’\-]", ""), r"\b(\p{L})\.(?=\p{L}\b)", "$1 ")
    raw = F.filter(F.split(joined, r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.isin(DROPPED))
    organised = is_organisation(raw) | F.exists(raw, lambda t: t.isin([a for a in ABBREVIATIONS if len(a) > 2]))
    long_forms, given = _map(ABBREVIATIONS), _map(NICKNAMES)
    people = F.transform(raw, lambda t: F.coalesce(given[t], t))
    words, letters = F.filter(people, lambda t: F.length(t) > 1), F.filter(people, lambda t: F.length(t) == 1)
    return F.when(organised, F.transform(raw, lambda t: F.coalesce(long_forms[t], t))).when(F.size(words) >= 2, words).when(F.size(words) == 1, F.concat(words, F.slice(letters, 1, 1))).otherwise(people)


def spellings(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Distinct graph_id and name over the three name columns; null and blank names are left out, null graphs too."""
    columns = [(entities, "name"), (relationships, "source"), (relationships, "target")]
    parts = [df.select("graph_id", F.col(c).alias("name")) for df, c in columns]
    names = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return names.where(F.col("graph_id").isNotNull() & F.col("name").rlike(r"(?U)[^\s\p{Z}]")).groupBy("graph_id", "name").agg(F.count(F.lit(1)).alias("uses"))


def signatures(texts: list[str], n: int) -> np.ndarray:
    """n MinHash values (columns) of the padded 2-grams of each text (rows); the words of a text are padded one by one.

    A 2-gram is hashed once, and each of the n functions multiplies that hash by an odd number and adds another."""
    codes = np.frombuffer("".join(f"#{t.replace(' ', '#')}#" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) + 2 for t in texts])
    grams = codes[:-1] << np.uint64(21) | codes[1:]
    grams[ends[:-1] - 1] = grams[ends[:-1] - 2]  # the mark between two texts is no gram: one of its text stands in
    grams = (grams + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    grams = (grams ^ grams >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    begins = np.concatenate([[0], ends[:-1]])
    rng = np.random.default_rng(SEED)
    factors, offsets = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    return np.stack([np.minimum.reduceat(grams * f + o, begins) for f, o in zip(factors, offsets)], axis=1)


def band_keys(n: int):
    """A column function: the n band keys of a text, each a hash of ROWS MinHash values."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=object)
        parts = signatures(texts.tolist(), n * ROWS).reshape(len(texts), n, ROWS)
        key = np.arange(n, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
        for i in range(ROWS):
            key = (key ^ parts[:, :, i]) * np.uint64(0xE7037ED1A0B428DB)
            key ^= key >> np.uint64(31)
        return pd.Series(list(key.astype(np.int64)))

    return keys


def _alike(a: Column, b: Column) -> Column:
    """Whether two tokens differ by one letter or by two that changed places."""
    slips = F.levenshtein(a, b)
    same_letters = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    shorter = F.least(F.length(a), F.length(b))
    return ((slips <= 1) & (shorter >= 4)) | ((slips == 2) & same_letters & (shorter >= 4)) | ((slips == 2) & (shorter >= 12))


def _nearly(a: Column, b: Column) -> Column:
    """Whether two tokens differ by no more than a third of their letters, three at most."""
    slips = F.levenshtein(a, b)
    return (slips <= 3) & (slips * 3 <= F.greatest(F.length(a), F.length(b))) & (F.least(F.length(a), F.length(b)) >= 5)


def _spread(rows: DataFrame) -> DataFrame:
    """rows in a given number of partitions: signatures are work, however few bytes the names are."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """graph_id, a and b (a < b): pairs of nearly equal tokens of a graph, found by MinHash banding."""
    keys = band_keys(bands())
    banded = stored(_spread(tokens.select("graph_id", "token")).withColumn("key", F.explode(keys("token"))), "bands")
    pairs = banded.withColumnRenamed("token", "a").join(banded.withColumnRenamed("token", "b"), ["graph_id", "key"]).where(F.col("a") < F.col("b"))
    return pairs.where(_alike(F.col("a"), F.col("b")) | _nearly(F.col("a"), F.col("b"))).select("graph_id", "a", "b").distinct()


def similar_names(nodes: DataFrame, bare: DataFrame) -> DataFrame:
    """graph_id, ca and cb (ca < cb): nodes of bare (graph_id, canon) and the nodes of their graph whose whole names are
    similar, found by MinHash banding; names with different numbers are not."""
    keys = band_keys(bands(WHOLE_SIMILARITY))
    named = nodes.where(F.size("tokens") > 0).join(bare.select("graph_id").distinct(), "graph_id", "left_semi").select("graph_id", "canon", F.array_join(F.filter("tokens", lambda t: t.rlike(r"\d")), " ").alias("numbers"))
    banded = stored(_spread(named).withColumn("key", F.explode(keys("canon"))), "whole")
    left = banded.join(bare.select("graph_id", "canon"), ["graph_id", "canon"], "left_semi").withColumnRenamed("canon", "a")
    pairs = left.join(banded.withColumnRenamed("canon", "b"), ["graph_id", "key", "numbers"]).where("a <> b")
    return pairs.select("graph_id", F.least("a", "b").alias("ca"), F.greatest("a", "b").alias("cb")).distinct()


def _token_similarity(a: Column, b: Column) -> Column:
    initial = (F.length(a) == 1) | (F.length(b) == 1)
    return (
        F.when(a == b, 1.0)
        .when(initial, F.when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 0.9).otherwise(0.0))
        .when(a.rlike(r"\d") | b.rlike(r"\d"), 0.0)
        .when(F.startswith(a, b) | F.startswith(b, a), 0.92)
        .when(_alike(a, b) | ((F.levenshtein(a, b) <= 1) & (F.least(F.length(a), F.length(b)) >= 3)), 0.9)
        .when(_nearly(a, b), 0.6)
        .when((F.levenshtein(a, b) <= 3) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.levenshtein(a, b) * 2 <= F.greatest(F.length(a), F.length(b))), 0.5)
        .otherwise(0.0)
    )


def monge_elkan(a: Column, b: Column) -> Column:
    """The mean over the tokens of a of the similarity of the most similar token of b."""
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: _token_similarity(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def nodes_of(names: DataFrame) -> DataFrame:
    """One row per graph and bag of tokens: canon, tokens, rank (2: two words or more, 1: a word and initials, 0: a word),
    organisation and uses; names whose tokens are the same are one node."""
    nodes = names.groupBy("graph_id", "canon").agg(F.first("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("spellings"))
    words = F.size(F.filter("tokens", lambda t: F.length(t) >= 3))
    return nodes.withColumns({
        "rank": F.when(words >= 2, 2).when(F.size("tokens") >= 2, 1).otherwise(0),
        "organisation": is_organisation(F.col("tokens")),
    })


def _distinctive(nodes: DataFrame) -> DataFrame:
    """graph_id, canon and token: the distinctive tokens of each node."""
    tokens = nodes.select("graph_id", "canon", F.explode(F.array_distinct("tokens")).alias("token")).where(F.length("token") >= 4)
    counted = tokens.groupBy("token").agg(F.count_distinct("graph_id").alias("n"))
    n_graphs = nodes.agg(F.count_distinct("graph_id")).scalar()
    common = counted.where((F.col("n") > COMMON_GRAPHS) & (F.col("n") > COMMON_SHARE * n_graphs)).select("token")
    return tokens.join(common, "token", "left_anti")


def _ends(others: Column) -> Column:
    """How the other tokens of a name begin and end. Of two tokens that differ by a slip, or of which one is the initial or
    the beginning of the other, the first or the last letters are the same."""
    return F.array_distinct(F.concat(F.transform(others, lambda t: F.concat(F.lit("^"), F.substring(t, 1, 1))), F.transform(F.filter(others, lambda t: F.length(t) >= 3), lambda t: F.concat(F.lit("$"), F.substring(t, -1, 1)))))


def candidates(nodes: DataFrame) -> DataFrame:
    """graph_id, ca and cb (ca < cb): the pairs of nodes to verify.

    Names meet on a distinctive token and an end of another one, so that a surname that a large share of a graph bears is
    split by the names beside it; a name without another token meets all that have its own. The parts are stored one by one:
    all scans and broadcasts of one plan are in the driver's memory at once."""
    rare = stored(_distinctive(nodes), "tokens")
    own = rare.select("graph_id", "token").distinct()
    near = similar_tokens(own)
    both = own.select("graph_id", F.col("token").alias("a"), F.col("token").alias("b")).unionByName(near).unionByName(near.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, "similar")
    others = F.filter("tokens", lambda t: t != F.col("token"))
    sides = stored(rare.join(nodes.select("graph_id", "canon", "tokens", "organisation"), ["graph_id", "canon"]).withColumn("others", others).select("graph_id", "canon", "token", "organisation", "others"), "sides")
    several = sides.where(F.size("others") > 0).select("graph_id", "token", "organisation", "canon", F.explode(_ends(F.col("others"))).alias("end"))
    alone = sides.where(F.size("others") == 0).select("graph_id", F.col("token").alias("a"), "organisation", F.col("canon").alias("x"))
    every = sides.select("graph_id", F.col("token").alias("b"), "organisation", F.col("canon").alias("y"))
    left, right = several.withColumnRenamed("token", "a").withColumnRenamed("canon", "x"), several.withColumnRenamed("token", "b").withColumnRenamed("canon", "y")
    met = left.join(both, ["graph_id", "a"]).join(right, ["graph_id", "b", "organisation", "end"]).where("x < y").select("graph_id", "x", "y")
    single = alone.join(both, ["graph_id", "a"]).join(every, ["graph_id", "b", "organisation"]).where("x <> y").select("graph_id", "x", "y")
    pairs = stored(met.unionByName(single).select("graph_id", F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).distinct(), "pairs")
    bare = stored(nodes.join(rare.select("graph_id", "canon").distinct(), ["graph_id", "canon"], "left_anti").select("graph_id", "canon"), "bare")
    return stored(pairs.unionByName(similar_names(nodes, bare)).distinct(), "candidates")


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, a, b, similarity and strict of the pairs (graph_id, ca, cb) that Monge-Elkan similarity of their tokens
    verifies; they must have more than initials in common, and an organisation is never a person. Pairs that are not strict
    only count for rare spellings."""
    columns = nodes.select("graph_id", "canon", "tokens", "organisation")
    a, b = [columns.select("graph_id", F.col("canon").alias(f"c{x}"), F.col("tokens").alias(f"t{x}"), F.col("organisation").alias(f"o{x}")) for x in "ab"]
    word = lambda x, y: (F.length(x) >= 2) & (F.length(y) >= 2) & (_token_similarity(x, y) >= 0.6)
    shared = F.exists("ta", lambda x: F.exists("tb", lambda y: word(x, y)))
    known = pairs.join(a, ["graph_id", "ca"]).join(b, ["graph_id", "cb"]).where("oa = ob").where(shared)
    swap = F.size("ta") > F.size("tb")
    short, long = F.when(swap, F.col("tb")).otherwise(F.col("ta")), F.when(swap, F.col("ta")).otherwise(F.col("tb"))
    scored = known.withColumns({"short": short, "long": long}).withColumn("s", monge_elkan(F.col("short"), F.col("long"))).where(F.col("s") >= LOOSE).withColumn("l", monge_elkan(F.col("long"), F.col("short")))
    least = F.when(F.col("oa"), LONGER_ORGANISATION).otherwise(F.when(F.size("short") == 1, 0.0).otherwise(LONGER_OTHER))
    strict = (F.col("s") >= SHORTER) & (F.col("l") >= least)
    return scored.where(F.col("l") >= F.least(least, F.lit(LOOSE))).select("graph_id", F.col("ca").alias("a"), F.col("cb").alias("b"), ((F.col("s") * 2 + F.col("l")) / 3).alias("similarity"), strict.alias("strict"))


def links(nodes: DataFrame) -> DataFrame:
    """The verified pairs of nodes, in both directions."""
    found = stored(verified(candidates(nodes), nodes), "links")
    return found.unionByName(found.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"), "similarity", "strict"))


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, canon and center of each node: star clustering.

    A node is a center if none of its free neighbours has more neighbours (ties: more uses, then the smaller name); its
    free neighbours join the most similar center. This repeats until no free node has a free neighbour. It ends: in every
    round the greatest free node of each connected part is a center. Parts are the spellings of a few names, so few rounds
    are needed.
    """
    degree = edges.groupBy("graph_id", "a").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "canon")
    order = F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.col("uses"), F.xxhash64("canon").alias("h"), F.col("canon"))
    ranked = stored(nodes.join(degree, ["graph_id", "canon"], "left").select("graph_id", "canon", order.alias("o")), "ranked")
    free = cut(edges.join(ranked.withColumnRenamed("canon", "a").withColumnRenamed("o", "oa"), ["graph_id", "a"]).join(ranked.withColumnRenamed("canon", "b").withColumnRenamed("o", "ob"), ["graph_id", "b"]))
    members = None
    while not free.isEmpty():
        centers = free.groupBy("graph_id", "a", "oa").agg(F.max("ob").alias("top")).where(F.col("oa") > F.col("top")).select("graph_id", F.col("a").alias("center"))
        best = F.max(F.struct("similarity", F.col("ob").alias("o"), F.col("b").alias("center"))).alias("best")
        joined = free.join(centers.withColumnRenamed("center", "b"), ["graph_id", "b"], "left_semi").groupBy("graph_id", "a").agg(best).select("graph_id", F.col("a").alias("canon"), F.col("best.center").alias("center"))
        taken = cut(joined.unionByName(centers.select("graph_id", F.col("center").alias("canon"), "center")))
        members = taken if members is None else members.unionByName(taken)
        gone = taken.select("graph_id", "canon")
        free = cut(free.join(gone.withColumnRenamed("canon", "a"), ["graph_id", "a"], "left_anti").join(gone.withColumnRenamed("canon", "b"), ["graph_id", "b"], "left_anti"))
    alone = nodes.select("graph_id", "canon", F.col("canon").alias("center"))
    return alone if members is None else members.unionByName(alone.join(members, ["graph_id", "canon"], "left_anti"))


def with_rare(grouped: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """grouped (graph_id, canon, center) after spellings that stand alone and are seldom used joined the star of a name that
    resembles them less than strictly: the most similar one, if it has more spellings or more uses."""
    sized = grouped.join(nodes.select("graph_id", "canon", "uses", "spellings"), ["graph_id", "canon"])
    sizes = sized.groupBy("graph_id", "center").agg(F.sum("uses").alias("uses"), F.sum("spellings").alias("spellings"))
    mean = sizes.agg(F.avg("uses")).scalar()
    order = F.struct("spellings", "uses", "center")
    sizes = sizes.select("graph_id", "center", order.alias("o"), ((F.col("spellings") == 1) & (F.col("uses") < RARE * mean)).alias("rare"))
    placed = edges.where(~F.col("strict"))
    for side in ("a", "b"):
        star = grouped.join(sizes, ["graph_id", "center"]).select("graph_id", F.col("canon").alias(side), F.col("center").alias(f"center_{side}"), F.col("o").alias(f"o_{side}"), F.col("rare").alias(f"rare_{side}"))
        placed = placed.join(star, ["graph_id", side])
    fits = placed.where(F.col("rare_a") & (F.col("o_b") > F.col("o_a")) & (F.col("center_a") != F.col("center_b")))
    moves = fits.groupBy("graph_id", "center_a").agg(F.max(F.struct("similarity", "o_b")).alias("m")).select("graph_id", F.col("center_a").alias("center"), F.col("m.o_b.center").alias("target"))
    moves = stored(moves, "moves")
    ends = moves.join(moves.select("graph_id", F.col("center").alias("target"), F.col("target").alias("further")), ["graph_id", "target"], "left").select("graph_id", "center", F.coalesce("further", "target").alias("target"))
    return grouped.join(ends, ["graph_id", "center"], "left").select("graph_id", "canon", F.coalesce("target", "center").alias("center"))


def clusters(names: DataFrame) -> DataFrame:
    """graph_id, name and center (the cluster) of each spelling; names has graph_id, name and uses.

    Names of two words or more make the stars. A name that is a word, or a word with initials, then joins the star it
    fits best; one that fits two equally well stays alone, and so does an initialism that several stars have. Names
    without letters and digits stay alone. An empty table gives no rows.

    What several steps read is stored, and each plan stays small: the driver holds the scans and broadcasts of a whole plan
    at once.
    """
    forms = names.select("graph_id", "name", "uses").withColumns({"ordered": tokens_of(F.col("name")), "initialism": F.col("name").rlike(INITIALISM)})
    forms = stored(forms.withColumns({"tokens": F.array_sort("ordered"), "canon": F.when(F.col("initialism") | (F.size("ordered") == 0), F.concat(F.lit("="), F.regexp_replace("name", r"[\s.]", ""))).otherwise(F.concat_ws(" ", F.array_sort("ordered")))}), "names")
    nodes = stored(nodes_of(forms.where(~F.col("initialism"))), "nodes")
    edges = links(nodes)
    full = nodes.where(F.col("rank") == 2)
    keys = nodes.select("graph_id", "canon", "rank")
    marked = stored(edges.join(keys.withColumnRenamed("canon", "a").withColumnRenamed("rank", "ra"), ["graph_id", "a"]).join(keys.withColumnRenamed("canon", "b").withColumnRenamed("rank", "rb"), ["graph_id", "b"]), "marked")
    between = marked.where((F.col("ra") == 2) & (F.col("rb") == 2)).select("graph_id", "a", "b", "similarity", "strict")
    grouped = stored(stars(full, between.where("strict").drop("strict")), "stars")
    grouped = stored(with_rare(grouped, nodes, between), "grouped")

    # partial names: the best similarity to any member of each star, then the best star if it is the only best
    partial = marked.where(F.col("strict") & (F.col("ra") < 2) & (F.col("rb") == 2)).join(grouped.withColumnRenamed("canon", "b"), ["graph_id", "b"]).groupBy("graph_id", "a", "center").agg(F.max("similarity").alias("similarity"))
    tops = Window.partitionBy("graph_id", "a")
    attached = partial.withColumn("top", F.max("similarity").over(tops)).where(F.col("similarity") >= F.col("top") - 0.01).groupBy("graph_id", "a").agg(F.count(F.lit(1)).alias("n"), F.min("center").alias("center"))
    attached = stored(attached.where(F.col("n") == 1).select("graph_id", F.col("a").alias("canon"), "center"), "attached")
    rest = stored(nodes.where(F.col("rank") < 2).join(attached, ["graph_id", "canon"], "left_anti"), "rest")
    loose = rest.select("graph_id", F.col("canon").alias("a"))
    loose_edges = marked.where(F.col("strict") & (F.col("ra") < 2) & (F.col("rb") < 2)).join(loose, ["graph_id", "a"], "left_semi").join(loose.withColumnRenamed("a", "b"), ["graph_id", "b"], "left_semi").select("graph_id", "a", "b", "similarity")
    every = stored(grouped.unionByName(attached).unionByName(stars(rest, stored(loose_edges, "loose"))), "every")

    named = stored(forms.where(~F.col("initialism")).join(every, ["graph_id", "canon"]).select("graph_id", "name", "ordered", "center"), "named")
    letters = F.array_join(F.transform("ordered", lambda t: F.substring(t, 1, 1)), "")
    short = named.where((F.size("ordered") >= 3) & ~F.contains("name", F.lit(",")) & is_organisation(F.col("ordered"))).select("graph_id", letters.alias("letters"), "center").distinct()
    single = short.groupBy("graph_id", "letters").agg(F.count(F.lit(1)).alias("n"), F.min("center").alias("center")).where(F.col("n") == 1).drop("n")
    initialisms = forms.where(F.col("initialism")).select("graph_id", "name", "canon", F.lower(F.regexp_replace("name", r"[\s.]", "")).alias("letters"))
    initialisms = initialisms.join(single, ["graph_id", "letters"], "left").select("graph_id", "name", F.coalesce("center", "canon").alias("center"))
    return named.select("graph_id", "name", "center").unionByName(initialisms)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings(table(spark, sf_dir, "entities", "graph_id", "name"), table(spark, sf_dir, "relationships", "graph_id", "source", "target"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, name_a, name_b: every pair of different spellings of one entity of a graph, name_a the smaller one."""
    grouped = stored(clusters(_names(spark, sf_dir)), "clusters")
    left, right = grouped.withColumnRenamed("name", "name_a"), grouped.withColumnRenamed("name", "name_b")
    return left.join(right, ["graph_id", "center"]).where(F.col("name_a") < F.col("name_b")).select("graph_id", "name_a", "name_b")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, name, entity (the most typical spelling's tokens) of each spelling."""
    return clusters(_names(spark, sf_dir)).withColumnRenamed("center", "entity")


def spelling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct spellings of each graph and their uses."""
    return _names(spark, sf_dir)


QUERIES = {"p5_found": found, "p5_entities": entities, "p5_spellings": spelling_rows}

SQL = {
    "p5_spellings": r"""
        WITH n AS (
            SELECT graph_id, name FROM entities UNION ALL SELECT graph_id, source FROM relationships UNION ALL SELECT graph_id, target FROM relationships)
        SELECT graph_id, name, count(*) AS uses FROM n
        WHERE graph_id IS NOT NULL AND trim(name, chr(160) || chr(9) || chr(10) || ' ') <> '' GROUP BY graph_id, name""",
}
