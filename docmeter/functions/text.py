"""Text columns: normalisation, tokens, keys, rendering and parsing, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Phrases that hedge an answer.
HEDGES = [
    "does not specify", "does not mention", "not specified", "not mentioned", "provided text does not", "no information", "cannot be determined", "unable to determine",
    "does not provide", "not stated", "does not state", "text does not", "is not specified", "unknown",
]

# Words that announce the letter of an answer, and words or marks that may stand between.
ANNOUNCING, BETWEEN = ["option", "answer", "choice"], ["is", ":"]

# Marks after a letter that begins an answer, and those after one that is all of it.
AFTER_FIRST, AFTER_ONLY = [".", ":", ")", "\n"], [".", ":", ")", "!", "?"]

#: A text as words, marks and ends of lines.
PIECES = r"[\p{L}\p{N}']+|\n|[^\s\p{L}\p{N}]"

def normalize_text(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, the words a, an and the removed, white space collapsed and trimmed; null gives
    the empty string."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """The words of the normalised text; none for an empty one."""
    return F.filter(F.split(normalize_text(text), " "), lambda w: w != "")


def collapse(text: Column) -> Column:
    """Trimmed lower case with single spaces; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def title_key(text: Column) -> Column:
    """Lower case letters and digits of a title; Latin letters lose their accents."""
    accented = "àáâãäåāăąçćĉčďèéêëēĕęěĝğĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
    plain = "aaaaaaaaaccccdeeeeeeeegghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
    return F.regexp_replace(F.translate(F.lower(text), accented, plain), "[^a-z0-9]", "")


def slug(text: Column) -> Column:
    """Runs of other characters become one dash, none at the ends; an empty result is x."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("x"))


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def is_hedge(text: Column) -> Column:
    """Whether the text holds one of the hedging phrases; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(h) for h in HEDGES]), lambda h: F.contains(low, h))


def first_group(text: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def choice_letter(answer: Column) -> Column:
    """The letter that a multiple-choice answer names; null if it names none.

    The answer is read as words and marks. A capital letter counts if it is all there is, perhaps in brackets or before a
    mark, or if it begins the answer before a mark that sets it off. Else the first letter that an announcing word
    introduces counts, else the first one alone in brackets, perhaps after the word option; there case does not matter."""
    pieces = F.regexp_extract_all(F.regexp_replace(answer, r"^\s+|\s+$", ""), F.lit(f"({PIECES})"), F.lit(1))
    size, at = F.size(pieces), lambda i: F.get(pieces, i if isinstance(i, Column) else F.lit(i))
    letter = lambda x: x.rlike("^[A-Za-z]$")
    capital = lambda x: x.rlike("^[A-Z]$")
    places = F.filter(F.transform(pieces, lambda x, i: i), lambda i: i < size - 1)
    bracketed = F.when((at(0) == "(") & capital(at(1)) & (at(2) == ")") & (size <= 4), at(1))
    first = F.when(capital(at(0)) & ((size == 1) | at(1).isin(AFTER_FIRST) | ((size == 2) & at(1).isin(AFTER_ONLY))), at(0))
    after = lambda i: i + 1 + F.lower(at(i + 1)).isin(BETWEEN).cast("int")
    announced = F.filter(F.transform(F.filter(places, lambda i: F.lower(at(i)).isin(ANNOUNCING)), lambda i: at(after(i))), letter)
    inside = lambda i: i + 1 + (F.lower(at(i + 1)) == "option").cast("int")
    alone = F.transform(F.filter(places, lambda i: (at(i) == "(") & letter(at(inside(i))) & (at(inside(i) + 1) == ")")), lambda i: at(inside(i)))
    return F.upper(F.coalesce(bracketed, first, F.get(announced, F.lit(0)), F.get(alone, F.lit(0))))


def choice_by_text(answer: Column, options: Column) -> Column:
    """The letter of the first option (an array of texts, A first) that the answer equals, or else holds as whole words, case
    aside; null if there is none."""
    low = F.lower(F.trim(answer))
    texts = F.transform(options, lambda o: F.lower(F.trim(o)))
    equal = F.array_position(texts, low)
    held = F.transform(texts, lambda o: (o != "") & F.concat(F.lit(" "), F.regexp_replace(low, r"(?U)\W+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.trim(F.regexp_replace(o, r"(?U)\W+", " ")), F.lit(" "))))
    place = F.when(equal > 0, equal).otherwise(F.array_position(held, F.lit(True)))
    return F.when(place > 0, F.char(F.lit(64) + place))
