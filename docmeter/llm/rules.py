"""Fixed word lists and patterns of the text rules (problems 1 and 2), and the column functions built from them."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Characters that show nothing.
INVISIBLE = "​‌‍⁠﻿­"

# Labels that models put before an answer.
ANSWER_LABELS = ["final answer", "answer", "response", "antwort", "réponse", "respuesta", "risposta", "resposta", "ответ", "答案", "回答", "a"]

# Fillers that stand for no answer.
EMPTY_WORDS = ["null", "none", "nil", "nan", "n/a", "na", "undefined", "empty", "<empty>", "<none>", "[]", "{}", "()"]

# Words that say that the document lacks the answer. Such an answer is sound.
UNSTATED = [
    r"\bunanswerable\b", r"\bnot (?:stated|mentioned|specified|given|said|provided|reported|answered|discussed|known)\b",
    r"\b(?:paper|text|novel|document|context|passage|author|authors|article|book|story|section)s? (?:does not|do not|doesn't|don't|never|gives? no|has no|offers? no|did not|is silent)\b",
    r"\b(?:cannot|can't|can not) be (?:answered|determined|found|inferred)\b", r"\bno (?:information|answer|mention) (?:is|in|about|on|was)\b",
    r"\bnicht (?:gesagt|genannt|erwähnt|angegeben|beantwortet)\b", r"\bne (?:le )?(?:précise|dit|mentionne|donne)\b", r"\bno (?:lo )?(?:indica|dice|menciona|precisa|especifica)\b",
    r"\bnon (?:lo )?(?:dice|indica|precisa|menziona|specifica)\b", r"\bnão (?:o )?(?:diz|indica|menciona|informa)\b", r"не (?:указано|сказано|говорится|упоминается|сообщает)", r"(?:没有|未)(?:提到|说明|提及|给出|指出)",
]

# Phrases in which a speaker declines to answer, by kind of phrase.
REFUSAL = [
    # the speaker is unable or not allowed
    r"\bI(?: am|'m) (?:afraid|sorry|unable|not able|not allowed|not permitted|not going to|not in a position|not comfortable)\b",
    r"\bI (?:cannot|can't|can not|could not|couldn't|will not|won't|would not|must not|may not|am unable to|refuse to|decline to) (?:be able to )?(?:answer|help|assist|discuss|provide|comply|respond|share|continue|engage|fulfil|fulfill|support|say|comment|talk|quote|offer|give|go|do)\b",
    r"\bI (?:have to|must|need to|will|would rather|'d rather|prefer to) (?:decline|refuse|pass|stop here|skip)\b", r"\bI(?:'d| would)? (?:rather|prefer) not\b", r"\bI (?:pass|decline|refuse)\b", r"\bI do(?:n't| not) (?:feel comfortable|have access|wish to|want to)\b",
    r"\bI(?: am|'m) (?:not )?(?:permitted|allowed|authori[sz]ed) to\b", r"\bnot something I(?:'m| am| can| could| will|'ll)\b", r"\bam unable to (?:respond|answer|comply|help|assist)\b",
    # rules and policies
    r"\b(?:policy|policies|guidelines|instructions|rules|terms)\b.{0,40}\b(?:not allow|not permit|prevent|forbid|prohibit|prohibits|disallow)", r"\bagainst (?:my|our|the) (?:guidelines|policies|policy|instructions|rules)\b", r"\b(?:not permitted|not allowed|prohibited|forbidden|blocked) by (?:the|our|my)\b",
    r"^(?:request|access|query) (?:denied|refused|rejected|blocked)\b", r"\bas an? (?:AI|artificial|assistant|language model)\b",
    # closing the subject
    r"^(?:sorry|apologies|my apologies|i apologi[sz]e|unfortunately),? (?:but |however )?(?:I|this|that|we)\b.{0,60}\b(?:not|n't|unable|decline|off)\b", r"^no comment\b", r"\boff[- ]limits\b", r"\b(?:talk|speak|chat) about something else\b", r"\bchange the subject\b",
    r"\bfind (?:that|it|this) out (?:by )?yourself\b", r"\bthere will be no answer\b", r"\bI am not going to (?:say|answer|tell)\b", r"\bplease ask (?:something else|another)\b.{0,20}$",
    # other languages
    r"\b(?:darf|kann|möchte|werde|will) ich .{0,40}\bnicht\b", r"\bich (?:darf|kann|möchte|werde|will)\b.{0,60}\bnicht (?:beantworten|helfen|antworten|sagen|unterstützen)\b", r"\btut mir leid\b.{0,40}\b(?:nicht|kein)", r"\bdabei kann ich nicht\b",
    r"\bje (?:suis désolée?|regrette)\b.{0,60}\b(?:pas|impossible)\b", r"\bje ne (?:peux|suis|veux|souhaite|vais)\b.{0,20}\bpas\b", r"\blo siento\b.{0,40}\bno (?:puedo|me)\b", r"\bno (?:me está permitido|puedo (?:ayudar|responder|contestar|hablar)|estoy autorizad)",
    r"\bmi dispiace\b.{0,40}\bnon posso\b", r"\bnon (?:mi è permesso|posso (?:aiutar|rispondere|parlare)|sono autorizzat)", r"\b(?:sinto muito|desculpe)\b.{0,40}\bnão\b", r"\bnão (?:posso|me é permitido|estou autorizad)", r"\b(?:извините|простите|к сожалению)\b.{0,40}\bне (?:могу|имею)", r"\bя не могу (?:ответить|помочь|отвечать)", r"(?:抱歉|对不起).{0,20}(?:不能|无法)", r"我(?:不能|无法)(?:回答|帮助|协助|讨论)",
]

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is are was were that this which who what how does do did with for from by on at as it its be been has have had an or not no only they their there than more because into again once".split(),
    "de": "der die das und ist sind war waren nicht mit für von auf dem den des ein eine einer eines wird werden wurde wurden zu zum zur im am bei als auch welche welcher welches wer wie warum sie er es sich nur dass weil nach vor aus über kein keine jede jeder einem einen hat haben".split(),
    "fr": "le la les des du un une et est sont était ne pas que qui dans pour par sur avec au aux ce cette ces il elle ils elles se sa son ses en plus quel quelle quels quelles comment pourquoi combien parce où mais à été être avait seul".split(),
    "es": "el los las del una y es son no que en para por con se su sus lo al como más quién qué cuál cuántos cuántas cómo cuánto según sólo solo pero este esta entre fue porque respecto allí durante tiene".split(),
    "it": "il lo gli dei della delle del un una e è sono non che in per con si suo sua al alla nel nella da di come più chi quale quali quanto quanti quante perché dopo ogni solo ha dove questo viene su per".split(),
    "pt": "o os as do da dos das um uma e é são não que em para por com se seu sua no na nos nas ao como mais quem qual quais quanto quantos quantas porque só foi este esta pelo pela".split(),
}

# Letters that only some of the languages above use, by language.
OWN_LETTERS = {"de": "äöüß", "fr": "çœêèàùûîôë", "es": "ñ¿¡", "it": "ìò", "pt": "ãõ"}


def shown(text: Column) -> Column:
    """text (null: empty) without invisible characters and white space around it."""
    seen = F.translate(F.coalesce(text, F.lit("")), INVISIBLE, "")
    space = r"(?U)[\s\p{Z}\p{Cntrl}]"
    around = F.substring(seen, 1, 1).rlike(space) | F.substring(seen, -1, 1).rlike(space)
    return F.when(around, F.regexp_replace(seen, r"(?U)^[\s\p{Z}\p{Cntrl}]+|[\s\p{Z}\p{Cntrl}]+$", "")).otherwise(seen)


def without_label(text: Column) -> Column:
    """Shown text without answer tags, code fences and a leading label such as "Answer:"."""
    seen = shown(text)
    bare = F.when(seen.contains("<") | seen.contains("```"), F.regexp_replace(seen, r"(?i)</?(?:answer|response|output|final|text|p|div|span|b|i)\s*/?>|```\w*", " ")).otherwise(seen)
    label = "|".join(re.escape(x) for x in ANSWER_LABELS)
    return shown(F.when(bare.rlike("[:：]"), F.regexp_replace(bare, rf"(?i)^[\s*_#>]*\s*(?:{label})\s*[*_]*\s*[:：]\s*[*_]*", "")).otherwise(bare))


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns (without escapes in capitals) is in text, case aside. All are one alternation, over the
    text in lower case; those that begin at the edge of a word stand behind one test for such an edge, and behind one for
    their first letter, so that most places of a text are passed at once."""
    low = [p.lower() for p in patterns]
    edge = [p.removeprefix(r"\b") for p in low if p.startswith(r"\b")]
    by_letter: dict[str, list[str]] = {}
    for p in edge:
        by_letter.setdefault(p[0] if p[0].isalpha() and p[1:2] not in ("?", "*", "+", "{") else "", []).append(p)
    groups = [f"{x}(?:{'|'.join(f'(?:{p.removeprefix(x)})' for p in found)})" for x, found in by_letter.items()]
    parts = [f"(?:{p})" for p in low if not p.startswith(r"\b")] + ([rf"\b(?:{'|'.join(groups)})"] if edge else [])
    return F.lower(text).rlike("(?U)" + "|".join(parts))
