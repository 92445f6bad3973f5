"""Sentences that documents of their paper hold: cut into groups of bounded size, matched in numpy within each.

No pair of a sentence and a document is ever a row. A paper up to BLOCK characters lies in one group with others; a larger
one is a grid of groups, in which every part of its sentences meets every part of its documents.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from docmeter.session import bounded, stored

#: Characters of documents, and of sentences, that a group holds, or so.
BLOCK = 4_000_000
#: Words times documents of a paper whose bits are set at once, and numbers of 64 bits that are counted in at once.
CELLS, COUNTED = 32_000_000, 32_768
#: Sentences that may miss more words than this are counted in one by one.
MISSES = 8


def sentence_hits(sentences: DataFrame, documents: DataFrame, lengths: DataFrame, least: int, share: float, block: int = BLOCK) -> DataFrame:
    """sentences with held (a document of the paper has the sentence word for word) and hit (held, or of its distinct words,
    `least` or more, a document has `share`). Sentences without words are left out.

    sentences: paper_id, sentence (each once for a paper) and other columns; documents: paper_id, doc_id, text; both are words
    with single spaces. lengths: paper_id, n_text, n_said, whose sums are about the characters of a paper's documents and sentences."""
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(c), F.lit(0)) / block)).cast("int")
    all_chars = (F.coalesce(F.sum("n_text"), F.lit(0)) + F.coalesce(F.sum("n_said"), F.lit(0))).alias("n")
    sizes = stored(lengths.groupBy("paper_id").agg(all_chars, parts("n_text").alias("text_parts"), parts("n_said").alias("said_parts")), "sizes")
    groups = 1 + (sizes.agg(F.sum("n")).first()[0] or 0) // block
    large = bounded(sizes.where((F.col("text_parts") > 1) | (F.col("said_parts") > 1)).drop("n"))  # fewer papers than groups times two

    def placed(rows: DataFrame, by: Column, own: str, other: str) -> DataFrame:
        rows = rows.join(large, "paper_id", "left")
        whole = F.col(own).isNull()
        place = F.when(whole, F.concat(F.lit("-"), F.pmod(F.xxhash64("paper_id"), F.lit(groups)))).otherwise(F.concat(F.lit("="), "paper_id"))
        rows = rows.withColumns({"place": place, own: F.when(whole, 0).otherwise(F.pmod(F.xxhash64(by), F.col(own)).cast("int"))})
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))

    keys = ["place", "text_parts", "said_parts"]
    left = placed(sentences, F.col("sentence"), "said_parts", "text_parts").groupBy(*keys)
    right = placed(documents.select("paper_id", "doc_id", "text"), F.col("doc_id"), "text_parts", "said_parts").select(*keys, "paper_id", "text").groupBy(*keys)
    schema = StructType([*sentences.schema, StructField("held", BooleanType()), StructField("hit", BooleanType())])
    found = left.cogroup(right).applyInArrow(partial(_matched, columns=sentences.columns, least=least, share=share), schema)
    rest = [F.first(c).alias(c) for c in sentences.columns if c not in ("paper_id", "sentence")]
    return found.groupBy("paper_id", "sentence").agg(*rest, F.bool_or("held").alias("held"), F.bool_or("hit").alias("hit"))


def _matched(sentences: pa.Table, texts: pa.Table, columns: list[str], least: int, share: float) -> pa.Table:
    """The sentences of a group, with held and hit as far as the texts of the group tell."""
    sentences = sentences.select(columns).filter(pc.not_equal(sentences["sentence"], "")).sort_by("paper_id")
    held = hit = np.zeros(len(sentences), bool)
    if len(sentences) and len(texts):
        held, hit = matches(sentences["paper_id"], sentences["sentence"], texts["paper_id"], texts["text"], least, share)
    return sentences.append_column("held", pa.array(held)).append_column("hit", pa.array(hit))


def _words(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each has."""
    lists = pc.split_pattern(texts, " ")
    flat = pc.list_flatten(lists)
    return flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat, pc.list_value_length(lists).to_numpy().astype(np.int64)


def matches(papers: pa.ChunkedArray, sentences: pa.ChunkedArray, text_papers: pa.ChunkedArray, texts: pa.ChunkedArray, least: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """held and hit of each sentence among the texts of its paper; papers ascend."""
    flat, sizes = _words(sentences)
    numbered = flat.dictionary_encode()
    words, n_words = numbered.indices.to_numpy().astype(np.int64), len(numbered.dictionary)
    names = pc.unique(papers)
    paper = pc.index_in(papers, value_set=names).to_numpy().astype(np.int64)
    text_paper = pc.index_in(text_papers, value_set=names)
    order = pc.array_sort_indices(text_paper).to_numpy()[: len(text_paper) - text_paper.null_count]  # nulls, papers without sentences, come last
    text_paper = text_paper.take(pa.array(order)).to_numpy().astype(np.int64)
    flat, text_sizes = _words(texts.take(pa.array(order)))
    # one row of word numbers, -1 for words that no sentence has and after each text
    document = np.repeat(np.arange(len(text_sizes)), text_sizes)
    at = np.arange(len(document)) + document
    row = np.full(len(document) + len(text_sizes) + 1, -1, np.int64)
    row[at] = pc.fill_null(pc.index_in(flat, value_set=numbered.dictionary), -1).to_numpy()
    known = row[at] >= 0
    at, document = at[known], document[known]
    held = _held(words, np.cumsum(sizes) - sizes, sizes, paper, row, at, text_paper[document], n_words)
    # distinct words of the sentences that aren't held
    pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n_words + words)
    of, word = pairs // n_words, pairs % n_words
    open_ = ~held & (np.bincount(of, minlength=len(sizes)) >= least)
    of, word = of[open_[of]], word[open_[of]]
    hit, lookup = held.copy(), np.full(n_words, -1, np.int64)
    ends = np.searchsorted(paper, np.arange(len(names) + 1))
    first, last = np.searchsorted(of, ends[:-1]), np.searchsorted(of, ends[1:])
    text_ends = np.searchsorted(text_paper, np.arange(len(names) + 1))
    text_first, text_last = np.searchsorted(document, text_ends[:-1]), np.searchsorted(document, text_ends[1:])
    document_words = row[at]
    for k in range(len(names)):
        a, b, c, d = first[k], last[k], text_first[k], text_last[k]
        if a < b and c < d:
            hit[_near(of[a:b], word[a:b], document[c:d], document_words[c:d], lookup, least, share)] = True
    return held, hit


def _held(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, roots: np.ndarray, row: np.ndarray, at: np.ndarray, at_roots: np.ndarray, n_words: int) -> np.ndarray:
    """Whether each sentence (sizes words from begins on) stands in the row, from one of the places `at` with its root on.

    The sentences are a tree of which a level is made at a time; places go down it, and those that leave it are dropped."""
    found = np.zeros(len(sizes), bool)
    left, node, place = np.arange(len(sizes)), roots, at_roots
    for j in range(sizes.max()):
        going = sizes[left] > j
        left, node = left[going], node[going]
        level, node = np.unique(node * n_words + words[begins[left] + j], return_inverse=True)
        ending, last = np.full(len(level), -1), sizes[left] == j + 1
        ending[node[last]] = left[last]
        word = row[at + j]
        key = np.where(word < 0, -1, place * n_words + word)
        place = np.searchsorted(level, key)
        place[place == len(level)] = 0
        same = level[place] == key
        at, place = at[same], place[same]
        if not len(at):
            break
        ended = ending[place]
        found[ended[ended >= 0]] = True
    return found


def misses(n: int, share: float) -> int:
    """How many of n words may be missing."""
    m = 0
    while (n - m - 1) / n >= share:
        m += 1
    return m


def _near(of: np.ndarray, word: np.ndarray, document: np.ndarray, document_words: np.ndarray, lookup: np.ndarray, least: int, share: float) -> np.ndarray:
    """Of the sentences of a paper (of, word: their distinct words) those of which a document has the share.

    Each word has a bit per document. The words of a sentence are gone through, rarest first, and for each number of misses
    that is allowed there are the bits of the documents that have missed no more so far. For very long sentences these would
    be many; there the words that each document has are counted. lookup: -1 for every word."""
    used, word = np.unique(word, return_inverse=True)
    lookup[used] = np.arange(len(used))
    local = lookup[document_words]
    lookup[used] = -1
    document, local = document[local >= 0], local[local >= 0]
    _, document, n = np.unique(document, return_inverse=True, return_counts=True)
    able = n >= least - misses(least, share)  # others have too few of any sentence's words
    keep = able[document]
    document, local = (np.cumsum(able) - 1)[document[keep]], local[keep]
    if not len(document):
        return of[:0]
    n_documents = int(document[-1]) + 1
    word = word[np.lexsort((np.bincount(local, minlength=len(used))[word], of))]
    sentence, begins, n = np.unique(of, return_index=True, return_counts=True)
    open_ = np.ones(len(sentence), bool)
    step = min(max(1, CELLS // len(used) // 64), -(-n_documents // 64)) * 64
    for start in range(0, n_documents, step):
        a, b = np.searchsorted(document, (start, start + step))
        cells = np.zeros((len(used), step), bool)
        cells[local[a:b], document[a:b] - start] = True
        bits = np.packbits(cells, axis=1).view(np.uint64)
        for size in np.unique(n[open_]).tolist():
            rows, m = np.flatnonzero(open_ & (n == size)), misses(size, share)
            if m > MISSES:
                for one in rows:
                    open_[one] = (cells[word[begins[one] : begins[one] + size]].sum(axis=0, dtype=np.int32) < size - m).all()
                continue
            for i in range(0, len(rows), batch := max(1, COUNTED * 64 // step)):
                some = rows[i : i + batch]
                where = word[begins[some][:, None] + np.arange(size)]
                so_far = [np.full((len(some), step // 64), -1, np.int64).view(np.uint64) for _ in range(m + 1)]
                for j in range(size):
                    has = bits[where[:, j]]
                    for k in range(m, 0, -1):
                        so_far[k] &= has
                        so_far[k] |= so_far[k - 1]
                    so_far[0] &= has
                    if j >= m and ((j - m) % 3 == 0 or j == size - 1):
                        going = so_far[m].any(axis=1)
                        if not going.all():
                            some, where, so_far = some[going], where[going], [x[going] for x in so_far]
                        if not len(some):
                            break
                open_[some] = False
    return sentence[~open_]
