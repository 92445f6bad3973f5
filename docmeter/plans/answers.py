"""Queries over texts of answers, questions and documents: normalisation, overlap metrics, letters, keys, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmeter.functions import text as T
from docmeter.functions.metrics import accuracy, best_f1, evidence_f1, reference_tokens, rounded
from docmeter.operators.overlap import sentence_hits
from docmeter.session import table

ARCHITECTURES = ["flat", "naive_rag", "raptor", "graphrag"]
#: A sentence of so many distinct words counts as a hit if a text has this share of them.
HIT_WORDS, HIT_SHARE = 6, 0.85


def answers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each result once (copies agree but for received_at)."""
    return table(spark, sf_dir, "architecture_results", "result_id", *columns).distinct()


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold answers of each question that has some."""
    return table(spark, sf_dir, "scored_cells", "qid", "gold_answers").where(F.size("gold_answers") > 0).distinct()


def normalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir, "predicted_answer").select("result_id", T.normalize_text(F.col("predicted_answer")).alias("answer"))


def answer_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, approximate model tokens and characters of the answers per architecture."""
    rows = answers(spark, sf_dir, "architecture", "predicted_answer").where(F.col("predicted_answer").isNotNull())
    n = F.size(T.tokens(F.col("predicted_answer")))
    return rows.groupBy("architecture").agg(F.sum(n).alias("n_tokens"), F.sum(T.approx_tokens(F.col("predicted_answer"))).alias("approx_tokens"), F.sum(F.length("predicted_answer")).alias("n_chars"))


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "papers", "paper_id", "title").select("paper_id", T.title_key(F.col("title")).alias("title_key"), T.slug(F.col("title")).alias("slug"), F.substring(F.sha2("title", 256), 1, 12).alias("digest"))


def call_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content key of each stored call (model, stage, prompt), and how many calls share it."""
    key = F.substring(F.sha2(F.concat_ws("\x1f", "model", F.coalesce("stage", F.lit("")), F.coalesce("prompt_hash", F.lit(""))), 256), 1, 16)
    rows = table(spark, sf_dir, "ledger", "call_id", "model", "stage", "prompt_hash").distinct()
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n_calls")).where("n_calls > 1")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """result_id, architecture, question_id and best token F1 of each answer against the gold answers of its question; the
    tokens of a question's gold answers are worked out once."""
    pool = gold(spark, sf_dir).select(F.col("qid").alias("question_id"), reference_tokens(F.col("gold_answers")).alias("g"))
    rows = answers(spark, sf_dir, "architecture", "question_id", "predicted_answer").withColumn("p", T.tokens(F.col("predicted_answer")))
    return rows.join(pool, "question_id").select("result_id", "architecture", "question_id", best_f1(F.col("p"), F.col("g")).alias("f1"))


def answer_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best token F1 of each answer against the gold answers of its question."""
    return _best(spark, sf_dir).select("result_id", rounded("f1").alias("f1"))


def gold_rescoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median best F1 per architecture over all questions with gold answers; one without an answer counts 0."""
    pool = gold(spark, sf_dir).select(F.col("qid").alias("question_id"))
    asked = pool.select("question_id", F.explode(F.array(*[F.lit(a) for a in ARCHITECTURES])).alias("architecture"))
    best = _best(spark, sf_dir).groupBy("architecture", "question_id").agg(F.max("f1").alias("f1"))
    filled = asked.join(best, ["architecture", "question_id"], "left")
    f1 = F.coalesce("f1", F.lit(0.0))
    return filled.groupBy("architecture").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(F.col("f1").isNull()).alias("n_missing"), rounded(F.avg(f1)).alias("mean_f1"), rounded(F.median(f1)).alias("median_f1"))


def evidence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 between the evidence sentences of flat and of each other architecture for the same question, on average."""
    rows = answers(spark, sf_dir, "architecture", "question_id", "run_index", "retrieved_evidence_sentences").where(F.size("retrieved_evidence_sentences") > 0)
    flat = rows.where(F.col("architecture") == "flat").select("question_id", "run_index", F.col("retrieved_evidence_sentences").alias("gold"))
    pairs = rows.where(F.col("architecture") != "flat").join(flat, ["question_id", "run_index"])
    return pairs.groupBy("architecture").agg(F.count(F.lit(1)).alias("n_pairs"), rounded(F.avg(evidence_f1(F.col("retrieved_evidence_sentences"), F.col("gold")))).alias("evidence_f1"))


def evidence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence sentences of each architecture, those that a document of their paper holds word for word, and hits: these
    and those of six distinct words or more of which a document has 85 %. Sentences without words are left out.

    Copies of a result state the same sentences, so results need not be made distinct first.
    """
    stated = table(spark, sf_dir, "architecture_results", "architecture", "paper_id", "retrieved_evidence_sentences").where(F.col("paper_id").isNotNull())
    stated = stated.select("architecture", "paper_id", F.explode("retrieved_evidence_sentences").alias("s"))
    sentences = stated.select("architecture", "paper_id", T.normalize_text(F.col("s")).alias("sentence"))
    sentences = sentences.groupBy("paper_id", "sentence").agg(F.collect_set(F.struct("architecture")).alias("by"))  # structs: a set has no nulls
    documents = table(spark, sf_dir, "documents", "doc_id", "paper_id", "text").where(F.col("paper_id").isNotNull() & F.col("text").isNotNull())
    lengths = documents.select("paper_id", F.length("text").cast("long").alias("n_text"), F.lit(0).cast("long").alias("n_said"))
    lengths = lengths.unionByName(stated.select("paper_id", F.lit(0).cast("long").alias("n_text"), F.length("s").cast("long").alias("n_said")))
    documents = documents.withColumn("text", T.normalize_text(F.col("text")))
    found = sentence_hits(sentences, documents, lengths, HIT_WORDS, HIT_SHARE)
    return found.select(F.explode("by").alias("by"), "held", "hit").groupBy("by.architecture").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("held").alias("n_held"), F.count_if("hit").alias("n_hits"))


def choice_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters read from the answers of the multiple-choice set."""
    return answers(spark, sf_dir, "dataset", "predicted_answer").where(F.col("dataset") == "novelqa").select("result_id", T.choice_letter(F.col("predicted_answer")).alias("letter"))


def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the letters of the grid with the letter that most people gave, per architecture."""
    votes = table(spark, sf_dir, "letter_votes", "question_id", "annotator", "predicted_letter_rescored").distinct()
    letter = F.upper(F.regexp_extract("predicted_letter_rescored", r"([A-Da-d])", 1))
    counts = votes.select("question_id", letter.alias("letter")).where("letter <> ''").groupBy("question_id", "letter").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy("question_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "letter")).alias("b")).select("question_id", F.col("b.letter").alias("gold"))
    rows = table(spark, sf_dir, "predictions", "arch", "paper_id", "question_id", "run_index", "predicted_letter").distinct().join(modal, "question_id")
    return rows.groupBy("arch").agg(F.count(F.lit(1)).alias("n_rows"), rounded(F.avg(accuracy(F.col("predicted_letter"), F.col("gold")))).alias("accuracy"))


def hedged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "source", "text").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(T.is_hedge(F.col("text"))).alias("n_hedged"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered prompt of each question: evidence in order, then the question; its digest and length."""
    rows = answers(spark, sf_dir, "question", "retrieved_evidence_sentences")
    context = F.array_join(F.filter("retrieved_evidence_sentences", lambda s: F.trim(s) != ""), "\n\n")
    prompt = F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer:"))
    return rows.select("result_id", F.sha2(prompt, 256).alias("prompt_hash"), F.length(prompt).alias("n_chars"))


def linear_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper as one text (title, then abstract, without empty parts): its digest and approximate tokens."""
    parts = F.filter(F.array("title", "abstract"), lambda p: F.coalesce(F.trim(p), F.lit("")) != "")
    whole = F.array_join(parts, "\n\n")
    return table(spark, sf_dir, "papers", "paper_id", "title", "abstract").select("paper_id", F.sha2(whole, 256).alias("digest"), T.approx_tokens(whole).alias("approx_tokens"))


def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents hold: digest, first document and copies."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_documents")).where("n_documents > 1")


QUERIES = {
    "normalized_answers": normalized_answers, "answer_lengths": answer_lengths, "title_keys": title_keys, "call_keys": call_keys, "answer_f1": answer_f1, "gold_rescoring": gold_rescoring,
    "evidence_overlap": evidence_overlap, "evidence_hits": evidence_hits, "choice_letters": choice_letters, "choice_accuracy": choice_accuracy, "hedged_documents": hedged_documents, "prompts": prompts,
    "linear_papers": linear_papers, "repeated_texts": repeated_texts,
}

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({x}, '')), '{_PUNCT}', ''), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x0b]+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def _norm(x: str) -> str:
    return f"array_to_string({_toks(x)}, ' ')"


def _f1(p: str, g: str) -> str:
    common = f"coalesce(list_sum(list_transform(list_distinct({p}), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({g}, lambda x: x = w))))), 0)"
    return f"CASE WHEN len({p}) + len({g}) = 0 THEN 1.0 ELSE 2.0 * {common} / (len({p}) + len({g})) END"


_ANSWERS = "(SELECT DISTINCT result_id, architecture, dataset, paper_id, question_id, run_index, question, predicted_answer, retrieved_evidence_sentences FROM architecture_results)"
_GOLD = "(SELECT DISTINCT qid, gold_answers FROM scored_cells WHERE len(gold_answers) > 0)"
_BEST = f"""(SELECT result_id, architecture, question_id, coalesce(max(f1), 0) AS f1 FROM (
    SELECT result_id, architecture, question_id, CASE WHEN r IS NOT NULL THEN {_f1('p', 'g')} END AS f1 FROM (
        SELECT result_id, architecture, question_id, r, {_toks('predicted_answer')} AS p, {_toks('r')} AS g FROM (
            SELECT a.result_id, a.architecture, a.question_id, a.predicted_answer, unnest(gold_answers) AS r FROM {_ANSWERS} a JOIN {_GOLD} ON question_id = qid))) GROUP BY ALL)"""
_HEDGES = "[" + ", ".join(f"'{h}'" for h in T.HEDGES) + "]"
_SETS = f"list_distinct(list_filter(list_transform(X, lambda s: {_norm('s')}), lambda s: s <> ''))"


SQL = {
    "normalized_answers": f"SELECT result_id, {_norm('predicted_answer')} AS answer FROM {_ANSWERS}",
    "answer_lengths": f"""SELECT architecture, CAST(sum(len({_toks('predicted_answer')})) AS BIGINT) AS n_tokens, CAST(sum(greatest(1, length(predicted_answer) // 4)) AS BIGINT) AS approx_tokens,
        CAST(sum(length(predicted_answer)) AS BIGINT) AS n_chars FROM {_ANSWERS} WHERE predicted_answer IS NOT NULL GROUP BY architecture""",
    "title_keys": """SELECT paper_id, regexp_replace(translate(lower(title), 'àáâãäåāăąçćĉčďèéêëēĕęěĝğĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž', 'aaaaaaaaaccccdeeeeeeeegghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz'), '[^a-z0-9]', '', 'g') AS title_key,
        coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') AS slug, substr(sha256(title), 1, 12) AS digest FROM papers""",
    "call_keys": """SELECT substr(sha256(concat_ws(chr(31), model, coalesce(stage, ''), coalesce(prompt_hash, ''))), 1, 16) AS key, count(*) AS n_calls
        FROM (SELECT DISTINCT call_id, model, stage, prompt_hash FROM ledger) GROUP BY key HAVING count(*) > 1""",
    "answer_f1": f"SELECT result_id, round(f1 + 1e-9, 6) AS f1 FROM {_BEST}",
    "gold_rescoring": f"""WITH b AS (SELECT architecture, question_id, max(f1) AS f1 FROM {_BEST} GROUP BY ALL),
        g AS (SELECT qid AS question_id, architecture FROM {_GOLD} CROSS JOIN (SELECT DISTINCT architecture FROM architecture_results))
        SELECT g.architecture, count(*) AS n_questions, count(*) FILTER (f1 IS NULL) AS n_missing, round(avg(coalesce(f1, 0)) + 1e-9, 6) AS mean_f1, round(median(coalesce(f1, 0)) + 1e-9, 6) AS median_f1
        FROM g LEFT JOIN b USING (architecture, question_id) GROUP BY g.architecture""",
    "evidence_overlap": f"""WITH r AS (SELECT result_id, architecture, question_id, run_index, {_SETS.replace('X', 'retrieved_evidence_sentences')} AS s FROM {_ANSWERS} WHERE len(retrieved_evidence_sentences) > 0)
        SELECT r.architecture, count(*) AS n_pairs, round(avg(CASE WHEN len(r.s) + len(f.s) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(r.s, f.s)) / (len(r.s) + len(f.s)) END) + 1e-9, 6) AS evidence_f1
        FROM r JOIN r f ON r.question_id = f.question_id AND r.run_index = f.run_index AND f.architecture = 'flat' WHERE r.architecture <> 'flat' GROUP BY r.architecture""",
    "evidence_hits": f"""WITH s AS (SELECT DISTINCT architecture, paper_id, array_to_string(w, ' ') AS sentence FROM (
            SELECT architecture, paper_id, {_toks('s')} AS w FROM (SELECT architecture, paper_id, unnest(retrieved_evidence_sentences) AS s FROM {_ANSWERS} WHERE paper_id IS NOT NULL)) WHERE len(w) > 0),
        o AS (SELECT paper_id, sentence, list_distinct(string_split(sentence, ' ')) AS w FROM (SELECT DISTINCT paper_id, sentence FROM s)),
        d AS (SELECT paper_id, array_to_string(w, ' ') AS t, list_distinct(w) AS w FROM (SELECT paper_id, {_toks('text')} AS w FROM documents WHERE paper_id IS NOT NULL AND text IS NOT NULL)),
        h AS (SELECT o.paper_id, o.sentence, bool_or(contains(' ' || d.t || ' ', ' ' || o.sentence || ' ')) AS held, bool_or(len(o.w) >= 6 AND len(list_intersect(o.w, d.w)) / len(o.w) >= 0.85) AS near
            FROM o JOIN d ON o.paper_id = d.paper_id GROUP BY ALL)
        SELECT architecture, count(*) AS n_sentences, count(*) FILTER (held) AS n_held, count(*) FILTER (held OR near) AS n_hits FROM s LEFT JOIN h USING (paper_id, sentence) GROUP BY architecture""",
    "choice_letters": f"""WITH p AS (SELECT result_id, regexp_extract_all(regexp_replace(predicted_answer, '^\\s+|\\s+$', '', 'g'), '[\\pL\\pN'']+|\\n|[^\\s\\pL\\pN]') AS p FROM {_ANSWERS} WHERE dataset = 'novelqa'),
        w AS (SELECT result_id, i, p[i] AS x, p[i + 1] AS y, p[i + 2] AS z, p[i + 3] AS u, len(p) AS n FROM (SELECT result_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
        c AS (SELECT result_id, CASE
            WHEN i = 1 AND x = '(' AND y BETWEEN 'A' AND 'Z' AND length(y) = 1 AND z = ')' AND n <= 4 THEN 1
            WHEN i = 1 AND x BETWEEN 'A' AND 'Z' AND length(x) = 1 AND (n = 1 OR y IN ('.', ':', ')', chr(10)) OR n = 2 AND y IN ('!', '?')) THEN 2
            WHEN lower(x) IN ('option', 'answer', 'choice') AND regexp_full_match(CASE WHEN lower(y) IN ('is', ':') THEN z ELSE y END, '[A-Za-z]') THEN 3
            WHEN x = '(' AND (regexp_full_match(y, '[A-Za-z]') AND z = ')' OR lower(y) = 'option' AND regexp_full_match(z, '[A-Za-z]') AND u = ')') THEN 4 END AS kind, i,
            CASE WHEN i = 1 AND n <= 4 AND x = '(' AND z = ')' THEN y WHEN x = '(' AND lower(y) = 'option' THEN z WHEN x = '(' THEN y WHEN length(x) = 1 THEN x WHEN lower(y) IN ('is', ':') THEN z ELSE y END AS letter FROM w)
        SELECT result_id, upper(letter) AS letter FROM p LEFT JOIN (SELECT result_id, arg_min(letter, kind * 100000 + i) AS letter FROM c WHERE kind IS NOT NULL GROUP BY result_id) USING (result_id)""",
    "choice_accuracy": """WITH v AS (SELECT question_id, upper(regexp_extract(predicted_letter_rescored, '([A-Da-d])', 1)) AS letter FROM (SELECT DISTINCT question_id, annotator, predicted_letter_rescored FROM letter_votes)),
        m AS (SELECT question_id, letter AS gold FROM (SELECT question_id, letter, count(*) AS n FROM v WHERE letter <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, letter) = 1)
        SELECT arch, count(*) AS n_rows, round(avg(CASE WHEN upper(trim(predicted_letter)) = gold THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS accuracy
        FROM (SELECT DISTINCT arch, paper_id, question_id, run_index, predicted_letter FROM predictions) JOIN m USING (question_id) GROUP BY arch""",
    "hedged_documents": f"SELECT source, count(*) AS n_documents, count(*) FILTER (len(list_filter({_HEDGES}, lambda h: contains(lower(coalesce(text, '')), h))) > 0) AS n_hedged FROM documents GROUP BY source",
    "prompts": f"""SELECT result_id, sha256(p) AS prompt_hash, length(p) AS n_chars FROM (SELECT result_id, 'Context:' || chr(10) || coalesce(array_to_string(list_filter(retrieved_evidence_sentences, lambda s: trim(s) <> ''), chr(10) || chr(10)), '')
        || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || 'Answer:' AS p FROM {_ANSWERS})""",
    "linear_papers": """SELECT paper_id, sha256(w) AS digest, greatest(1, length(w) // 4) AS approx_tokens FROM (
        SELECT paper_id, array_to_string(list_filter([title, abstract], lambda p: coalesce(trim(p), '') <> ''), chr(10) || chr(10)) AS w FROM papers)""",
    "repeated_texts": "SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS n_documents FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
}
