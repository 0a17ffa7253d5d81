"""Question and answer pairs with a defect: empty, refusal, copied, other_language or truncated.

Copies are measured by walking the answer through the suffix automaton of its
question; refusals by an automaton of the forms they take, and by what is left of the
answer without them; the language by votes of function words that only one
language has; cut ends by truncation.find_truncated_answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.arrow import map_rows
from gradeloom.llm.automaton import SuffixAutomaton, covered
from gradeloom.llm.pages import HYPHENS, PAGE_NUMBER
from gradeloom.llm.wordlists import ALL_FUNCTION_WORDS, FUNCTION_WORDS

# How refusals are said: slots parted by plus signs, alternatives by bars; a slot with a question mark may be left out.
REFUSAL_FORMS = """
i|we + ?really|simply|honestly|just + do not|don't|dont|did not|didn't|cannot|can't|can not|could not|couldn't|will not|won't|am not able to|am unable to|was unable to|was not able to|do not want to|have not|haven't|have never|never + know|remember|recall|answer|understood|understand|do|write|explain|solve|attempt|study|studied|learn|learned|learnt|help|help with|assist|provide|transcribe|read|think of
cannot|can't|could not|couldn't + be + provided|answered + by me
i'm|i am + not able to|unable to|not going to
not + able to|possible for me to|attempting|attempted|answered|in the syllabus|in our syllabus
unable to + answer|read|help|write
i|we + refuse to|decline to|would rather not|prefer not to|give up|pass|skip|leave it|leave this|forgot|have forgotten|am leaving this|am going to skip|won't be answering|have no clue|have no idea|had no idea|had no clue
i'd rather not
no + idea|clue|answer from my side
i was|we were + never taught
it is|it's + not possible + ?for me|for us + to
nothing + comes to mind|i can write|to say
there is nothing i can write
my mind + went blank|is blank
please excuse me from
leaving this blank
skipping + ?this|this one|this part|this question
will come back if time allows
as an ai|as an automated assistant|as a language model
out of syllabus
?yo + no + ?lo + sé|recuerdo|conozco|entiendo|entendí|estudié|aprendí
no + puedo|pude|quiero|voy a|sabría|podría + responder|contestar|ayudar|resolver|hacer|explicar|recordar
?no tengo + ni idea
prefiero + no responder|no contestar|no escribir
dejo + esta parte|esta pregunta|en blanco
lo dejo así
sin respuesta
olvidé todo|he olvidado|me rindo|paso de esta
je ne + sais|connais|comprends|me souviens + pas|rien|pas la réponse|pas de
je ne + peux|veux|pourrais + pas + ?répondre|expliquer|faire
je n'ai + pas|rien|jamais + étudié|appris|compris|su
je + préfère ne pas|refuse de|passe|abandonne|laisse cette partie|laisse cette question
j'abandonne|aucune idée|sans réponse
j'ai + ?tout + oublié
ich + weiß|kenne|wusste + nichts|es nicht|das nicht|nicht|die antwort nicht|die antwort|keine antwort
ich + kann|konnte|möchte|will + diese frage|das|hier|es|dazu + nicht|nichts + ?beantworten|antworten|lösen|sagen
kann ich + das|diese frage|hier + nicht + ?beantworten|antworten
ich habe + das|es|alles|alles über|nichts|dieses kapitel|dieses thema + ?nicht + gelernt|vergessen|verstanden
nicht + beantworten|antworten|gelernt
keine + ahnung|antwort
ich gebe + ?bei dieser aufgabe|bei dieser frage|hier + auf
ich + lasse es aus|lasse das aus|überspringe
vergessen
मुझे|मुझको|मैं|हमें + ?इसका|इसके बारे में|यह + ?उत्तर + नहीं|याद नहीं + ?पता|आता|मालूम|दे सकता|दे सकती
उत्तर नहीं + दे सकता|दे सकती|आता|पता
नहीं पढ़ा
"""
# The same for refusals without a subject: behind a word of content they are said of something else.
BARE_FORMS = """
cannot|can't|could not|couldn't|dont|don't|do not|did not|didn't + know|remember|recall|answer|understand
"""
# Phrases that only look like a refusal.
NO_REFUSALS = "i don't know of any|i do not know of any|no idea can|no clue can"
# Words that open an excuse; what follows them to the end of the sentence belongs to it.
EXCUSE_OPENERS = frozenset("because since as porque pues parce car weil da denn क्योंकि".split())
# Phrases that go with a refusal: addresses, apologies, pleas, and words for what is refused.
EXCUSES = """
my time is over|time is over|time is up|maybe next time|better luck next time|i hope you understand|give me grace marks|give grace marks|grace marks|this question at this time|at this time|this page|this image|this topic|about this topic|from this question|for this part|this chapter|on purpose|completely
se acabó el tiempo|la respuesta a esta pregunta|esta pregunta|este tema|a esto|qué decir sobre
le temps est fini|ce chapitre|à cette question|cette partie
die zeit ist um|auf diese frage|dieses kapitel|diese frage|dieser aufgabe
sir|madam|sir/madam|dear examiner|examiner|note to marker|note|apologies|honestly|to be frank|frankly|sorry|i'm sorry|i am sorry|unfortunately|please|lo siento|perdone|perdón|disculpe|désolé|désolée|pardon|excusez-moi|leider|entschuldigung|es tut mir leid|क्षमा करें|माफ़ कीजिए
"""
# Words that introduce a repeated question, or set one instruction for another.
FRAME_WORDS = frozenset(
    "ans answer answering asked asks question questions task says write mention talk tell state list give name explain describe define discuss compare justify evaluate outline"
    " draw sketch show account comment contrast examine identify assess consider here following reads repeated again"
    " pregunta respuesta escriba mencione explique describa defina compare hable diga"
    " question réponse écrivez mentionnez expliquez décrivez définissez comparez parlez dites"
    " frage antwort schreiben nennen erklären beschreiben definieren vergleichen erläutern sagen sie".split()
)
# Names of languages, as questions use them to ask for one.
LANGUAGE_NAMES = {
    "english": "en", "inglés": "en", "anglais": "en", "englisch": "en", "अंग्रेज़ी": "en", "german": "de", "alemán": "de", "allemand": "de", "deutsch": "de",
    "french": "fr", "francés": "fr", "français": "fr", "französisch": "fr", "spanish": "es", "español": "es", "espagnol": "es", "spanisch": "es", "hindi": "hi", "हिंदी": "hi",
}
_UNREAD = re.compile(r"\[(?:illegible|unclear|unreadable)\]|\?\?+|_{3,}")
#: Words that an excuse may have behind its opening.
MOST_EXCUSE = 9
#: Words of content that a refusal may hold besides its phrases, to name its topic or an excuse.
MOST_OTHER = 7
_PERSONS = frozenset("i me my ich je yo mir mich se lo this it".split())
_ASKS = re.compile(r"\b(?:in|into|en|auf|ins|al|to)\s+(" + "|".join(LANGUAGE_NAMES) + r")\b|(हिंदी|अंग्रेज़ी) में", re.IGNORECASE)
_PLACEHOLDER = re.compile(r"^[\W_]*(?:(?:n\s?/\s?a|na|nil|none|null|blank|left blank|no answer|not answered|empty|sin respuesta|en blanco|vide|leer|tbd|xxx+)[\W_]*)?$", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_MARKS = re.compile(r"[(\[]\s*\d+\s*(?:m|marks?|puntos|points|punkte)?\s*[)\]]\s*$", re.IGNORECASE)
_SHARED = {w for w in ALL_FUNCTION_WORDS if sum(w in ws for ws in FUNCTION_WORDS.values()) > 1}
_OWN = {w: x for x, ws in FUNCTION_WORDS.items() for w in ws if w not in _SHARED}

#: Automata made on first use. A cache decorator would travel to the executors by name, and they need no copy of this package.
_MADE: dict[str, object] = {}


def _words(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().replace("’", "'"))


def _tree(phrases: Iterable[str]) -> dict:
    root: dict = {}
    for phrase in phrases:
        node = root
        for word in _words(phrase) if not re.search("[ऀ-ॿ]", phrase) else phrase.split():
            node = node.setdefault(word, {})
        node[""] = True
    return root


def _phrases(text: str) -> list[str]:
    return [phrase for line in text.strip().split("\n") for phrase in line.split("|")]


def _spoken(forms: str) -> Iterator[str]:
    """Every phrase that the forms allow."""
    for line in filter(None, forms.split("\n")):
        slots = [[*slot.removeprefix("?").split("|"), *([""] if slot[0] == "?" else [])] for slot in line.split(" + ")]
        yield from (" ".join(filter(None, choice)) for choice in product(*slots))


def _trees() -> tuple[dict, dict, dict, dict]:
    if "trees" not in _MADE:
        _MADE["trees"] = _tree(_spoken(REFUSAL_FORMS)), _tree(_phrases(EXCUSES)), _tree(NO_REFUSALS.split("|")), _tree(_spoken(BARE_FORMS))
    return _MADE["trees"]


def _endings() -> frozenset[tuple[str, ...]]:
    """The last words, up to four, of refusals and excuses of more than one short word."""
    if "endings" not in _MADE:
        known = [*_spoken(REFUSAL_FORMS + BARE_FORMS), *_phrases(EXCUSES)]
        _MADE["endings"] = frozenset(tuple(w[-4:]) for phrase in known for w in (_words(phrase),) if len(w) > 1 or len(phrase) > 6)
    return _MADE["endings"]


def ends_in_excuse(tail: str) -> bool:
    """True if the last words of a text, up to four, end a phrase of refusal or excuse."""
    words = _words(tail)[-4:]
    return any(tuple(words[-k:]) in _endings() for k in range(1, len(words) + 1))


def plain_answer(text: str) -> str:
    """An answer without page numbers, likely running headers and line breaks; broken words are joined."""
    if "\n" not in text:
        return text.strip()
    lines = text.split("\n")
    if len(lines) > 1 and not text.isupper():  # a text in capitals alone has no headings to tell apart
        lines = [line for line in lines if not PAGE_NUMBER.match(line) and not _heading(line)] or lines
    joined = re.sub(rf"(?<=\w)[{re.escape(HYPHENS)}]\n+(?=\w)", "", "\n".join(lines))
    return joined.replace("\n", " ").strip()


def _heading(line: str) -> bool:
    words = line.split()
    if len(words) < 2 or line.rstrip()[-1:] in ".?!,;:" or not line[:1].isupper():
        return False
    named = sum(w[:1].isupper() or not w[:1].isalpha() for w in words)
    return named * 4 >= len(words) * 3 or bool(re.search(r"\d{4,}", line))


def is_refusal(answer: str, question: str | None = None) -> bool:
    """True if an answer only says that none is given: a phrase of refusal, and hardly anything else but excuses and the topic."""
    trees = _trees()
    answer = _UNREAD.sub(" ", answer)
    words = _words(answer) if not re.search("[ऀ-ॿ]", answer) else re.split(r"[\s।,.!?;:]+", answer)
    topic = set(_words(question or ""))
    i, refused, rest, said = 0, False, 0, False
    while i < len(words):
        step, kind = 0, None
        for tree in trees[:3] if said else trees:
            node, j, end = tree, i, 0
            while j < len(words) and words[j] in node:
                node = node[words[j]]
                j += 1
                if "" in node:
                    end = j - i
            if end > step:
                step, kind = end, tree
        if kind is trees[2]:
            return False
        refused |= kind is trees[0] or kind is trees[3]
        said = not step
        if not step:
            w = words[i]
            if refused and w in EXCUSE_OPENERS:
                i += MOST_EXCUSE
                continue
            rest += bool(w) and w not in ALL_FUNCTION_WORDS and w not in topic and w not in _PERSONS
            if rest > MOST_OTHER:
                return False
            step = 1
        i += step
    return refused and rest * 2 <= len(words)


def copied_shares(answer: list[str], prompt: list[str]) -> tuple[float, float]:
    """How much of an answer lies in substrings of its prompt, and how much of the prompt these make up, both in letters of words.

    The answer is walked through the suffix automaton of the prompt. A run
    counts from two words on, a single word if it is one of content. Words that
    frame a question and words of grammar that stand outside of runs are passed over.
    """
    automaton = SuffixAutomaton(prompt)
    runs: list[int] = []
    back = [0] * len(prompt)
    for word, (size, end) in zip(answer, automaton.matches(answer)):
        runs.append(size if size > 1 or word not in ALL_FUNCTION_WORDS else 0)
        if size:
            back[end] = max(back[end], runs[-1])
    inside = outside = 0
    for word, hit in zip(answer, covered(runs)):
        if hit:
            inside += len(word)
        elif word not in FRAME_WORDS and word not in ALL_FUNCTION_WORDS:
            outside += len(word)
    given = sum(len(word) for word, hit in zip(prompt, covered(back)) if hit)
    return inside / max(1, inside + outside), given / max(1, sum(map(len, prompt)))


def is_copied(answer: str, question: str, of_answer: float = 0.75, of_prompt: float = 0.65) -> bool:
    """True if an answer only gives its question again, whole or slightly reworded, once or more.

    At least of_answer of it comes from the question, and it gives of_prompt of
    the question: less is an answer that takes up its words. An answer is walked
    to its end unless words of its own, which no walk can cover, outweigh of_answer before.
    """
    words, prompt = _words(answer), _words(_MARKS.sub("", question.strip()))
    asked, left = set(prompt), (1 - of_answer) * sum(map(len, words))
    for word in words:
        if word not in asked and word not in FRAME_WORDS and word not in ALL_FUNCTION_WORDS:
            left -= len(word)
            if left < 0:
                return False
    shares = copied_shares(words, prompt)
    return shares[0] >= of_answer and shares[1] >= of_prompt


def language_votes(text: str) -> dict[str, int]:
    """Votes for each language: words that only it uses for grammar; Devanagari letters count for Hindi by fives."""
    votes = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in _words(text):
        x = _OWN.get(w)
        if x:
            votes[x] += 1
    votes["hi"] += len(re.findall("[ऀ-ॿ]", text)) // 5
    return votes


def foreign(answer: str, language: str | None, question: str | None) -> bool:
    """True if an answer is wholly in a language that is neither the pair's nor one its question asks for."""
    votes = language_votes(answer)
    best = max(votes, key=votes.__getitem__)
    if not language or best == language or votes[best] < 2 or votes.get(language, 0) * 6 > votes[best]:
        return False
    asked = {LANGUAGE_NAMES[(a or b).lower()] for a, b in _ASKS.findall(question or "")}
    return best not in asked


def defect_of(question: str | None, answer: str | None, language: str | None) -> str | None:
    """empty, refusal, copied or other_language, the first that holds; None for a pair without these."""
    text = plain_answer(answer or "")
    bare = re.sub("[​‌‍⁠﻿]", "", text)
    if _PLACEHOLDER.match(bare):
        return "empty"
    if is_refusal(text, question):
        return "refusal"
    if question and is_copied(text, question):
        return "copied"
    return "other_language" if foreign(text, language, question) else None


def find_defects(pairs: DataFrame, truncated: DataFrame) -> DataFrame:
    """block_id, defect: every defective pair with its one defect.

    pairs: block_id, question_text, answer_text, lang (of the pair). truncated:
    block_id. A pair with several defects has the first of empty, refusal,
    copied, truncated, other_language. Null and blank answers are empty; a null
    question can't be copied; a null language has no other. Repeated rows count
    once, other columns are ignored.
    """

    def judge(rows: Iterable[tuple]) -> Iterator[tuple]:
        for block, question, answer, language in rows:
            defect = defect_of(question, answer, language)
            if defect:
                yield block, defect, ("empty", "refusal", "copied", "", "other_language").index(defect)

    narrow = pairs.select(F.col("block_id").cast("bigint"), "question_text", "answer_text", "lang")
    found = map_rows(narrow, "block_id bigint, defect string, rank int", judge)
    cut = truncated.select(F.col("block_id").cast("bigint"), F.lit("truncated").alias("defect"), F.lit(3).alias("rank"))
    return found.unionByName(cut).groupBy("block_id").agg(F.min_by("defect", "rank").alias("defect"))
