"""Problem 6: encoding of all texts with a public byte-level BPE tokenizer, and decoding.

Each task splits its texts into words and gives the distinct ones to DuckDB. A recursive query holds a row per word and
token position; it joins neighbours to the merge table, contracts each word's pair of the least rank, leftmost first, until
no pair of any word can merge; an ordered aggregation gives the ids. The merge table (one row per merge of the vocabulary,
about 50,000, whatever the corpus) is read on the driver and sent to the tasks.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import duckdb
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from docmeter.session import table

TOKENIZERS = os.environ.get("DOCMETER_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the pattern that splits text into words before the merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: New words that one DuckDB query encodes, and encoded words that a task keeps; both bound memory only.
WORDS_PER_QUERY, WORDS_KEPT = 20_000, 400_000

#: Words of more bytes than this are merged apart: the recursive query keeps the rows of all its rounds, and a long word has
#: many of both.
LONG_WORD = 1_000

#: One round: the pair of the least rank of each word of a table is contracted, wherever the word has it.
ROUND = """
    WITH pairs AS (
        SELECT s.word, s.pos, s.token, m.rank, m.merged,
               min(m.rank) OVER (PARTITION BY s.word) AS least
        FROM (SELECT word, pos, token, lead(token) OVER (PARTITION BY word ORDER BY pos) AS following FROM step WHERE NOT done) s
        LEFT JOIN merges m ON m.lhs = s.token AND m.rhs = s.following),
    hits AS (SELECT *, coalesce(rank = least, FALSE) AS hit FROM pairs),
    runs AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS run FROM hits),
    -- in a run of equal pairs (as in aaaa) every second one, from the left, is contracted
    taken AS (SELECT *, hit AND row_number() OVER (PARTITION BY word, hit, run ORDER BY pos) % 2 = 1 AS take FROM runs),
    shifted AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), FALSE) AS swallowed FROM taken)
    SELECT word, pos, CASE WHEN take THEN merged ELSE token END AS token, least IS NULL AS done
    FROM shifted WHERE NOT swallowed
"""

MERGE_WORDS = f"""
WITH RECURSIVE step AS (
    SELECT word, pos, token, FALSE AS done FROM bytes_of
    UNION ALL
    ({ROUND})
)
SELECT word, list(token ORDER BY pos) AS ids FROM step WHERE done GROUP BY word
"""


def vocabulary(name: str = "byte_bpe_50k", root: str = TOKENIZERS) -> pa.Table:
    """id and bytes of each token, in the order of ids."""
    with open(os.path.join(root, f"{name}.tiktoken"), "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return pa.table({"id": pa.array([int(i) for _, i in pairs], pa.int32()), "bytes": pa.array([base64.b64decode(b) for b, _ in pairs], pa.binary())})


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    the others, in order, for the characters from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_table(name: str = "byte_bpe_50k", root: str = TOKENIZERS) -> tuple[pa.Table, list[int]]:
    """The merges (lhs, rhs, merged as ids, and rank) and the id of each single byte."""
    with open(os.path.join(root, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    sides = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = pa.table({
        "lhs": pa.array([ids[a] for a, _ in sides], pa.int32()), "rhs": pa.array([ids[b] for _, b in sides], pa.int32()),
        "merged": pa.array([ids[a + b] for a, b in sides], pa.int32()), "rank": pa.array(range(len(sides)), pa.int32()),
    })
    alphabet = byte_alphabet()
    single = [0] * 256
    for character, byte in alphabet.items():
        single[byte] = ids[character]
    return merges, single


def connect(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    """A DuckDB of one task: one thread, little memory, the given tables."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    for name, rows in tables.items():
        con.register("given", rows)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        con.unregister("given")
    return con


def _bytes_of(single: list[int], words: list[str]) -> pd.DataFrame:
    """word (its place in words), pos and token of each byte."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = [len(b) for b in raw]
    word = pd.Series(range(len(raw))).repeat(lengths).to_numpy()
    return pd.DataFrame({"word": word, "pos": [i for n in lengths for i in range(n)], "token": [single[b] for x in raw for b in x]}).astype("int32")


def encode_words(con: duckdb.DuckDBPyConnection, single: list[int], words: list[str]) -> dict[str, list[int]]:
    """The ids of distinct words, in no order. Words of one byte, or that no merge changes, come out as their bytes."""
    short = [w for w in words if len(w) * 4 <= LONG_WORD or len(w.encode("utf-8", "surrogatepass")) <= LONG_WORD]
    con.register("bytes_of", _bytes_of(single, short))
    rows = con.sql(MERGE_WORDS).to_arrow_table()
    con.unregister("bytes_of")
    known = dict(zip([short[i] for i in rows["word"].to_pylist()], rows["ids"].to_pylist()))
    return known | {w: encode_long_word(con, single, w) for w in words if w not in known}


def encode_long_word(con: duckdb.DuckDBPyConnection, single: list[int], word: str) -> list[int]:
    """The ids of one word by the same rounds, each in place of the one before."""
    con.register("bytes_of", _bytes_of(single, [word]))
    con.execute("CREATE OR REPLACE TEMP TABLE step AS SELECT *, FALSE AS done FROM bytes_of")
    con.unregister("bytes_of")
    while con.execute("SELECT count(*) FROM step WHERE NOT done").fetchone()[0]:
        con.execute(f"CREATE OR REPLACE TEMP TABLE following AS {ROUND}")
        con.execute("DROP TABLE step")
        con.execute("ALTER TABLE following RENAME TO step")
    ids = con.execute("SELECT list(token ORDER BY pos) FROM step").fetchone()[0]
    con.execute("DROP TABLE step")
    return ids


def encode(texts: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", root: str = TOKENIZERS) -> DataFrame:
    """key and ids (a list of integers) of each row of texts; null and empty texts have the empty list.

    Special tokens do not exist: their strings in a text are ordinary text. Every row comes out once, repeated keys as
    often as they are there; an empty table gives no rows and other columns are not read. Whole texts are encoded, very
    long ones too.
    """
    spark = texts.sparkSession
    merges, single = merge_table(name, root)
    sent = spark.sparkContext.broadcast((merges, single))
    kind = texts.schema[key].dataType
    rows = texts.select(texts[key].alias("key"), texts[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, bytes_ = sent.value
        con, split = connect(merges=table_), regex.compile(WORDS)
        known: dict[str, list[int]] = {}
        for batch in batches:
            parts = [split.findall(t) if t else [] for t in batch.column(1).to_pylist()]
            if len(known) > WORDS_KEPT:
                known.clear()
            new = list({w for p in parts for w in p if w not in known})
            for i in range(0, len(new), WORDS_PER_QUERY):
                known |= encode_words(con, bytes_, new[i : i + WORDS_PER_QUERY])
            ids = [[i for w in p for i in known[w]] for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return rows.mapInArrow(run, f"key {kind.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", root: str = TOKENIZERS) -> DataFrame:
    """key and text of each list of ids; the empty list and null give the empty text, broken characters the mark U+FFFD."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary(name, root))
    kind = encoded.schema[key].dataType
    rows = encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect(vocabulary=sent.value)
        for batch in batches:
            con.register("lists", pa.table({"row": pa.array(range(batch.num_rows), pa.int32()), "ids": batch.column(1)}))
            joined = con.sql(
                "SELECT l.row, string_agg(hex(v.bytes), '' ORDER BY l.pos) AS h FROM (SELECT row, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM lists) l JOIN vocabulary v USING (id) GROUP BY l.row"
            ).to_arrow_table()
            con.unregister("lists")
            found = dict(zip(joined["row"].to_pylist(), joined["h"].to_pylist()))
            texts = [bytes.fromhex(found.get(i, "")).decode("utf-8", "replace") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return rows.mapInArrow(run, f"key {kind.simpleString()}, text string").withColumnRenamed("key", key)


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: the tokens of every document."""
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: every document, encoded and decoded again; a null text comes back empty."""
    return decode(ids(spark, sf_dir), "doc_id", "ids")


QUERIES = {"p6_ids": ids, "p6_decoded": decoded}

SQL = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
