"""Problem 2: texts that lost their end.

A stack automaton reads each text: brackets, quotations, elements of markup, fences, log lines of JSON, escapes and
characters cut to pieces leave something open where the text breaks off. Texts without a sentence end are then held against the endings that are
usual in their source: counts over the whole corpus say how often the last words of a text end a text or a line there, and
how often they go on; a last word that mostly occurs as the beginning of others was cut within.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docmeter.llm.pairs import OPENING, is_copy, is_cut, marked, open_ends, plain_words
from docmeter.llm.rules import shown
from docmeter.llm.segments import looked_up
from docmeter.session import stored, table

#: A word is common if at least this share of the documents has it (so at most words per document / COMMON words are).
COMMON = 0.0001
#: An open ending is usual in a source if it was seen this often, in this share of the texts that end with these words,
#: and does not go on more than GOES_ON times as often.
SEEN, SHARE, GOES_ON = 2, 0.15, 3.0
#: It must also make up this share of what follows the first two of the three words, whatever that is.
FOLLOWS = 0.02
#: Three words seen less often than this say too little; then the last two are judged.
ENOUGH = 5
#: A word is a beginning if longer words that begin with it are so many times as frequent.
BEGINNING = 5

# Elements of markup that must be closed (others, such as p and li, need not be).
ELEMENTS = "a article b blockquote body code div em h1 h2 h3 h4 h5 h6 html i main ol pre script section span strong style sub sup table tbody thead title u ul".split()

_MARKS = re.compile(r'''[:;=]-?[()DPp]|\\.?|</?[A-Za-z][A-Za-z0-9]{0,11}(?:\s[^<>]*)?>|["“”„«»()\[\]{}「」『』]|```|\n\s*\n''', re.S)
_CLOSES = {")": "(", "]": "[", "}": "{", "»": "«", "」": "「", "』": "『"}
_BROKEN = re.compile(r"""(?:�[\s…]*|[\ud800-\udfff]|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#?\w{0,7})|%[0-9A-Fa-f]?(?<=[\w/]%)|%[0-9A-Fa-f](?<=[\w/]%.)|</?[A-Za-z][^<>\s]{0,30}|<)$""")
_PIECES = re.compile(r"""(?<=[.!?。！？])(["”»'’)\]]*)\s+(?!\d)|(?<=[:;=][()])\s+|(?<=[。！？])|\n+""")
_ENDED = re.compile(r"""(?:[.!?。！？]["”»'’)\]*_`]*|…["”»]|[:;=]-?[()DPp])\s*$""")
_TOKEN = re.compile(r"https?://\S+|[一-鿿]|[^\W\d_]+(?:['’-]\w+)*|\d[\d.,]*\d|\d|[^\w\s\"“”„«»'’…�]")
_LAST_MARKS = re.compile(r"""[\s.!?。！？"”»'’)\]*_`]+$""")


def open_marks(text: str) -> bool:
    """Whether the automaton still has an open mark after the text. Straight quotation marks, which look alike on both
    sides, and curved ones must close within their paragraph, brackets too, as smileys and list marks may stand alone; an
    element of markup must close before the end; a log line must close its braces and strings."""
    last_line = text.rstrip("\n").rpartition("\n")[2]
    if last_line.lstrip().startswith(("{", "[{")):
        return _open_json(last_line)
    stack: list[str] = []
    elements: list[str] = []
    fence = False
    for mark in _MARKS.findall(text):
        if mark == "```":
            fence = not fence
        elif mark[0] in ":;=\\" or fence:
            continue
        elif mark[0] == "\n":
            stack.clear()
        elif mark[0] == "<":
            name = mark.strip("</>").split()[0].lower()
            if mark[1] == "/":  # closes all that was opened within it
                del elements[len(elements) - elements[::-1].index(name) - 1 if name in elements else len(elements) :]
            elif name in ELEMENTS and not mark.endswith("/>"):
                elements.append(name)
        elif mark in ("“", "„", "«", "(", "[", "{", "「", "『"):
            stack.append(mark)
        elif mark == '"':
            stack.pop() if stack and stack[-1] == '"' else stack.append('"')
        elif mark == "”":
            if stack and stack[-1] in ("“", "„"):
                stack.pop()
        elif stack and stack[-1] == _CLOSES.get(mark):
            stack.pop()
    return fence or bool(stack) or bool(elements)


def _open_json(line: str) -> bool:
    depth, inside, escaped = 0, False, False
    for c in line:
        if inside:
            inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return inside or depth > 0


def _tokens(piece: str, common: frozenset[str]) -> list[str]:
    """Words and marks of a sentence or line, without the end of a sentence: common words as they are, numbers as 0, web
    addresses as U, all other words as N."""
    bare = _LAST_MARKS.sub("", piece) or piece
    out = []
    for t in _TOKEN.findall(bare):
        low = t.lower()
        out.append("U" if "://" in t else "0" if t[0].isdigit() else low if not t[0].isalpha() or all(w in common for w in low.split("-")) else "N")
    return out


def _key(tokens: list[str], i: int) -> str:
    return " ".join((["^", "^"] + tokens)[i : i + 3])


def common_words(documents: DataFrame, text: str = "text") -> list[str]:
    """Words of at least the share COMMON of the documents that are written small more often than with a capital."""
    words = documents.select(F.explode(F.array_distinct(F.split(text, r"[^\p{L}'’]+"))).alias("w")).where(F.col("w") != "")
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    small = counts.groupBy(F.lower("w").alias("w")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(0)).alias("small"))
    total = documents.count()
    return [r[0] for r in small.where((F.col("n") >= max(3, COMMON * total)) & (F.col("small") * 2 >= F.col("n"))).select("w").collect()]


def endings(documents: DataFrame, common: list[str]) -> DataFrame:
    """source, key (three last words), and how often, in the texts of the source, the words go on (mid), end a sentence that
    ends a text (full), end a line (line) or end a text without an end of a sentence (bare)."""
    sent = documents.sparkSession.sparkContext.broadcast(frozenset(common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            counts: Counter[tuple[str, str, int]] = Counter()
            for source, text in zip(batch["source"], batch["text"]):
                pieces = _split(text)
                for j, (piece, line_end) in enumerate(pieces):
                    tokens = _tokens(piece, known)
                    for i in range(len(tokens) - 1):
                        counts[source, _key(tokens, i), 0] += 1
                    if tokens:
                        last, ended = j == len(pieces) - 1, bool(_ENDED.search(piece))
                        kind = (1 if ended else 3) if last else (2 if line_end and not ended else -1)
                        if kind >= 0:
                            counts[source, _key(tokens, len(tokens) - 1), kind] += 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["source", "key", "kind", "n"])

    rows = documents.select(F.coalesce("source", F.lit("")).alias("source"), "text").mapInPandas(run, "source string, key string, kind int, n bigint")
    kinds = {"mid": 0, "full": 1, "line": 2, "bare": 3}
    return rows.groupBy("source", "key").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(name) for name, k in kinds.items()])


def _split(text: str) -> list[tuple[str, bool]]:
    """Sentences and lines of a text, and whether a line ends with each; blank ones are left out."""
    out, start = [], 0
    for m in _PIECES.finditer(text):
        end = m.end(1) if m.group(1) is not None else m.start()
        piece = text[start:end]
        if piece.strip():
            out.append((piece, m.group().startswith("\n")))
        elif out and m.group().startswith("\n"):
            out[-1] = (out[-1][0], True)
        start = m.end()
    if text[start:].strip():
        out.append((text[start:], False))
    return out


def _end(text: str | None, known: frozenset[str]) -> tuple[bool, bool, str, str | None]:
    pieces = _split(text) if text else []
    if not pieces:
        return False, True, "", None
    piece = pieces[-1][0].rstrip()
    tokens = _tokens(piece, known)
    ended = bool(_ENDED.search(piece))
    found = re.search(r"[^\W\d_]+(?=[…�\s]*$)", piece)
    return bool(_BROKEN.search(piece)) or open_marks(text), ended, _key(tokens, len(tokens) - 1) if tokens else "", found.group().lower() if found and not ended else None


def with_ends(rows: DataFrame, common: list[str]) -> DataFrame:
    """rows with what the end of their text shows: structure (something is open), ended (a sentence ends it), key (the last
    three words) and word (the last one, in lower case; null if a mark or a number ends the text)."""
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(common))

    @F.pandas_udf("structure boolean, ended boolean, key string, word string")
    def ends(texts: pd.Series) -> pd.DataFrame:
        seen = {text: _end(text, sent.value) for text in texts.unique()}
        return pd.DataFrame([seen[text] for text in texts], columns=["structure", "ended", "key", "word"])

    return rows.withColumn("end__", ends("text")).select(*rows.columns, "end__.*")


@F.pandas_udf(T.BooleanType())
def is_open(texts: pd.Series) -> pd.Series:
    """Whether the automaton has something open after a text, or a character or an escape is cut to pieces at its end."""
    return texts.map(lambda t: bool(t) and (bool(_BROKEN.search(t.rstrip())) or open_marks(t))).astype(bool)


def word_counts(documents: DataFrame) -> DataFrame:
    """word, in lower case, and n: how often it occurs."""
    words = documents.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 1)
    return stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")


def beginnings(counts: DataFrame) -> DataFrame:
    """word: those of word_counts() for which longer words that begin with them are at least BEGINNING times as frequent."""
    shorter = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))
    longer = counts.where(F.length("word") > 1).select(F.explode(shorter).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n_longer"))
    return counts.join(longer, "word").where(F.col("n_longer") >= BEGINNING * F.col("n")).select("word")


def usual_endings(seen: DataFrame) -> DataFrame:
    """source and key of the three words after which texts of the source usually end without an end of a sentence; sure if
    the last one is a known word that sentences or lines end with too."""
    parts = F.split("key", " ")
    rows = seen.withColumns({"before": F.concat_ws(" ", F.slice(parts, 1, 2)), "two": F.concat_ws(" ", F.slice(parts, 2, 2)), "all": F.col("mid") + F.col("full") + F.col("line") + F.col("bare")})
    after = rows.groupBy("source", "before").agg(F.sum("all").alias("n_before"))
    pairs = rows.groupBy("source", "two").agg(*[F.sum(c).alias(f"{c}_2") for c in ("mid", "full", "line", "bare")])
    joined = rows.where("bare > 0").join(after, ["source", "before"]).join(pairs, ["source", "two"])
    few = F.col("all") < ENOUGH
    mid, full, line, bare = [F.when(few, F.col(f"{c}_2")).otherwise(F.col(c)) for c in ("mid", "full", "line", "bare")]
    closed = line + bare
    # an unknown last word may be a part of one: then sentences or lines must end this way too
    known = ~F.col("key").rlike("(^| )N$") | (full + line >= SEEN)
    follows = F.col("before").startswith("^") | few | (closed + full >= FOLLOWS * F.col("n_before"))
    return joined.where(known & follows & (closed >= SEEN) & (closed >= SHARE * (closed + full)) & (mid <= GOES_ON * closed)).select("source", "key", (~F.col("key").rlike("(^| )N$") & (full + line >= SEEN)).alias("sure"))


def distinct_texts(documents: DataFrame, *columns: str) -> DataFrame:
    """source and text (and columns that depend on them) of each distinct text of a source: copies, under whatever ids, are
    one witness of how texts end."""
    return documents.select(F.coalesce("source", F.lit("")).alias("source"), "text", *columns, F.sha2("text", 256).alias("hash")).dropDuplicates(["source", "hash"]).drop("hash")


def cut_documents(documents: DataFrame) -> DataFrame:
    """doc_id, cut and evidence of each document with a text; documents has doc_id, source and text.

    evidence says what told: structure (something is open), within_word (the last word is the beginning of others) or
    unusual_ending; it is null for complete texts. Null, empty and blank texts are left out. A null source is one source.
    Repeated rows come out as often as they are there, but a text counts once in what is usual in its source. An empty table
    gives no rows, other columns are not read. Whole texts are read, very long ones too.
    """
    written = documents.select("doc_id", "source", "text").where(F.length(shown(F.col("text"))) > 0)
    common = common_words(written)
    once = stored(distinct_texts(written), "texts")
    usual = usual_endings(stored(endings(once, common), "endings")).withColumn("usual", F.lit(True))
    ends = stored(with_ends(written.withColumn("source", F.coalesce("source", F.lit(""))), common).drop("text"), "ends")
    begun = beginnings(word_counts(once)).withColumn("begun", F.lit(True))
    complete = F.col("structure") | F.col("ended")  # the end alone tells
    judged = looked_up(looked_up(ends.where(~complete), usual, ["source", "key"], "doc_id"), begun, ["word"], "doc_id")
    within, ending = F.coalesce("begun", F.lit(False)) & ~F.coalesce("sure", F.lit(False)), F.coalesce("usual", F.lit(False))
    told = judged.select("doc_id", F.when(within, "within_word").when(~ending, "unusual_ending").alias("evidence"))
    told = told.unionByName(ends.where(complete).select("doc_id", F.when(F.col("structure"), "structure").alias("evidence")))
    return told.select("doc_id", F.col("evidence").isNotNull().alias("cut"), "evidence")


def going_endings(seen: DataFrame) -> DataFrame:
    """source and key of the three words, the last one known, after which texts nearly always go on: in the source or, if
    it has them less than ENOUGH times, the last two of them in all sources."""
    rows = seen.withColumns({"two": F.concat_ws(" ", F.slice(F.split("key", " "), 2, 2)), "ends": F.col("full") + F.col("line") + F.col("bare")})
    pairs = rows.groupBy("two").agg(F.sum("mid").alias("mid_2"), F.sum("ends").alias("ends_2"))
    few = F.col("mid") + F.col("ends") < ENOUGH
    mid, ends = [F.when(few, F.col(f"{c}_2")).otherwise(F.col(c)) for c in ("mid", "ends")]
    return rows.where("bare > 0").join(pairs, "two").where(~F.col("key").rlike("(^| )[N0U]$") & (mid >= ENOUGH) & (mid > GOES_ON * ends)).select("source", "key")


def with_own_evidence(rows: DataFrame, once: DataFrame, key: str) -> DataFrame:
    """rows (key, source, text) and what each says of its end by itself: structure (something is open), going (texts go on
    after its last words), alone (its last word is never anything but the end of an open text) and begun (it also is the
    beginning of longer words that are BEGINNING times as frequent). once has the distinct texts of each source."""
    common = common_words(once)
    going = going_endings(stored(endings(once, common), "endings")).withColumn("going", F.lit(True))
    counts = word_counts(once)
    last = with_ends(once.where("open"), common).where(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n_last"))
    words = counts.join(last, "word").select("word", (F.col("n") <= F.col("n_last")).alias("alone"))
    words = stored(words.join(beginnings(counts).withColumn("begun", F.lit(True)), "word", "left"), "last")
    ends = stored(with_ends(rows, common).withColumnRenamed("key", "key__"), "ends")
    judged = looked_up(looked_up(ends, going.withColumnRenamed("key", "key__"), ["source", "key__"], key), words, ["word"], key)
    flag = {c: F.coalesce(c, F.lit(False)) for c in ("going", "alone", "begun")}
    return judged.select(*rows.columns, "structure", (flag["going"] & ~F.col("ended")).alias("going"), flag["alone"].alias("alone"), (flag["alone"] & flag["begun"]).alias("begun"))


def cut_answers(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """result_id, model, cut and evidence of each answer with a text; a result's copies come out once.

    An answer that the automaton leaves open or that ends in a broken character is cut, whatever mark ends it (evidence
    structure); one with an open end also if its call billed as many tokens as its limit allows (limit), or by the evidence
    of open_ends(): a neighbour that goes on (neighbour), a spike (spike), last words that go on (going), a last word that is
    the beginning of others (within_word), or a source that usually ends its sentences (baseline). One that gives back its
    question to the end is complete, whatever mark is missing. Null calls, counts and limits give no such evidence; null,
    empty and blank answers are left out.
    """
    q, a = [F.regexp_replace(plain_words(F.col(c)), OPENING, "") for c in ("question", "predicted_answer")]
    one = results.select("result_id", "call_id", F.col("architecture").alias("source"), F.col("response_token_count").alias("length"), shown(F.col("predicted_answer")).alias("text"), q.alias("q"), a.alias("a")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    last = [F.element_at(F.split(c, " "), -1) for c in ("q", "a")]
    one = one.withColumn("asked", F.coalesce(is_copy(F.col("q"), F.col("a")) & (F.levenshtein(*last) <= 1), F.lit(False))).drop("q", "a")
    answers = stored(marked(one), "answers")
    ends = open_ends(answers)
    kind = F.when(F.col("structure"), "structure").when(is_cut(ends), F.when(F.col("shortened"), "neighbour").when(F.col("spike"), "spike").when(F.col("going"), "going").when(F.col("begun"), "within_word").otherwise("baseline"))
    opened = ends.select("result_id", "call_id", "asked", (F.col("n_words") >= 3).alias("long"), kind.alias("kind"))
    closed = answers.where(~F.col("open")).select("result_id", "call_id", "asked", F.lit(False).alias("long"), F.when(is_open("text"), "structure").alias("kind"))
    rows = opened.unionByName(closed)
    calls = ledger.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.first("model", True).alias("model"), F.max(F.coalesce(F.col("output_tokens") >= F.col("max_tokens"), F.lit(False))).alias("at_limit"))
    unknown = rows.where(F.col("call_id").isNull()).withColumns({"model": F.lit(None).cast("string"), "at_limit": F.lit(False)})
    joined = rows.where(F.col("call_id").isNotNull()).join(calls, "call_id", "left").unionByName(unknown)
    evidence = F.when(~F.col("asked"), F.coalesce(F.col("kind"), F.when(F.coalesce("at_limit", F.lit(False)) & F.col("long"), "limit")))
    return joined.select("result_id", "model", evidence.isNotNull().alias("cut"), evidence.alias("evidence")).dropDuplicates(["result_id"])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "source", "text")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "architecture_results", "result_id", "call_id", "architecture", "response_token_count", "predicted_answer", "question")
    return cut_answers(results, table(spark, sf_dir, "ledger", "call_id", "model", "output_tokens", "max_tokens"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, record_id and evidence: what told that the record was cut, one row per cut record."""
    answers = _answers(spark, sf_dir).where("cut").select(F.lit("architecture_results").alias("table_name"), F.col("result_id").alias("record_id"), "evidence")
    documents = cut_documents(_documents(spark, sf_dir)).where("cut").dropDuplicates(["doc_id"])
    return answers.unionByName(documents.select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("record_id"), "evidence"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, record_id: one row per cut record."""
    return evidence(spark, sf_dir).select("table_name", "record_id")


def _rates(flagged: DataFrame, by: str) -> DataFrame:
    n, cut = F.count(F.lit(1)), F.count_if("cut")
    return flagged.groupBy(by).agg(n.alias("n_texts"), cut.alias("n_cut"), (cut / n).alias("rate"))


def model_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a text, cut ones and their rate per model; answers without a known call have a null model."""
    return _rates(_answers(spark, sf_dir), "model")


def source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text, cut ones and their rate per source."""
    documents = _documents(spark, sf_dir)
    return _rates(documents.select("doc_id", "source").join(cut_documents(documents), "doc_id"), "source")


QUERIES = {"p2_found": found, "p2_model_rates": model_rates, "p2_source_rates": source_rates, "p2_evidence": evidence}
