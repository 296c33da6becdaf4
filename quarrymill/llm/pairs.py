"""Question-answer pairs whose answer is useless, with the kind of defect.

Method: prompt and answer are aligned by shingle containment and by the longest common subsequence to find copies
(characters instead of words in scripts without blanks); sentences of the answer are aligned with refusal templates,
whole phrases and slots with gaps for the topic; truncation is decided as in ``truncation``; language by
script and by counts of function words.

A pair is a user message with at least one assistant message before the next user message or the end; its answer is
the content of the last of these. One defect a pair, the first of: empty, truncated, refusal, copy, other_language.

Edge cases: null, blank and placeholder answers are ``empty``; a null or blank question can't be copied and has no
language; null structs and other roles are passed over but keep their position; of redelivered rows one counts;
short values, numbers and code have no language; texts of any length are compared whole; extra columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.truncation import judge, once_each, scan_texts
from quarrymill.llm.words import WORD, lcs_length, runs, words
from quarrymill.session import cut_lineage

#: Answers that say nothing, as words. Fixed values.
PLACEHOLDERS = {"", "null", "none", "nil", "nan", "n a", "na", "empty", "blank", "no content", "no answer", "no response", "no output", "no reply", "undefined", "missing", "tbd", "todo", "void", "nichts", "leer", "kein inhalt", "vide", "aucun", "rien", "sin contenido", "vacío", "nada", "нет", "пусто", "нет ответа"}

#: What a refusal says, as word sequences in which the topic is left out. Fixed values.
REFUSALS = [
    "i can t help with", "i cannot help with", "i can t assist with", "i cannot assist with", "i am unable to help with", "i m unable to help with",
    "i m unable to provide that information", "i am unable to provide that information", "i can t provide that information", "i cannot provide that information",
    "i am not able to assist with a request", "i m not able to assist with a request", "i am not able to help with", "i m not able to help with",
    "i must decline to discuss", "i have to decline", "i must decline", "i decline to answer", "i won t be answering anything", "i won t be able to help", "i will not answer",
    "i do not have permission to respond", "i don t have permission to respond", "helping with isn t something i can do", "that isn t something i can do", "is not something i can help with",
    "my guidelines keep me from commenting", "my guidelines do not allow me", "i don t feel comfortable going into", "i do not feel comfortable", "i would rather not take part", "i d rather not discuss", "i prefer not to discuss",
    "falls outside of what i m allowed to talk about", "is outside of what i m allowed to discuss",
    "no puedo ayudarte con", "no puedo ayudarle con", "prefiero no tratar", "prefiero no hablar de", "no me es posible responder sobre", "debo rechazar esta petición", "no puedo responder sobre", "no estoy autorizado a hablar de",
    "je ne peux pas vous aider avec", "je ne peux pas t aider avec", "je préfère ne pas parler de", "je dois refuser cette demande", "il m est impossible de répondre au sujet de", "je ne suis pas en mesure de",
    "dabei kann ich nicht helfen", "damit kann ich nicht helfen", "zu darf ich keine auskunft geben", "ich bin nicht in der lage zu behandeln", "diese bitte über muss ich ablehnen", "ich möchte nicht über sprechen", "dazu kann ich nichts sagen",
    "я не могу помочь с темой", "я не вправе отвечать про", "мне придётся отказаться обсуждать", "мне нельзя говорить о", "я не могу ответить на вопрос о", "я предпочёл бы не обсуждать",
]

_DO = {
    "en": "help|assist|answer|answering|respond|responding|reply|discuss|discussing|provide|providing|comply|fulfill|fulfil|complete|comment|commenting|share|sharing|engage|support|advise|address|accommodate|talk",
    "de": "helfen|weiterhelfen|beantworten|antworten|sprechen|sagen|behandeln|besprechen|unterstützen|kommentieren|auskunft|erfüllen|nachkommen|eingehen", "es": "ayudar|ayudarte|ayudarle|ayudaros|responder|contestar|tratar|hablar|comentar|discutir|proporcionar|compartir|cumplir|asistir|atender",
    "fr": "aider|répondre|parler|discuter|fournir|traiter|commenter|partager|satisfaire|accéder|aborder|assister|donner", "ru": "помочь|помогать|ответить|отвечать|обсуждать|обсудить|говорить|комментировать|предоставить|выполнить|рассказать",
}
#: Refusals as slots that follow each other within a few words; a slot's alternatives stand between ``|``. Contractions
#: are written out. Fixed values.
SLOTS = [
    f"i|we not|unable {_DO['en']}", "i|we not comfortable", "i must|have|need decline|refuse", "i decline|refuse", f"i rather|prefer not {_DO['en']}|go|take", "not something i can|am|may", "my guidelines|policy|policies|rules|instructions|programming not|keep|prevent|forbid|prohibit", "outside|beyond i allowed|permitted|able",
    f"ich|mir|wir nicht|keine|nichts {_DO['de']}", "ich|muss ablehnen", f"no puedo|podemos|podré|posible|autorizado|debo {_DO['es']}", f"prefiero no {_DO['es']}", "debo rechazar|declinar", f"ne peux|puis|pouvons|suis|souhaite|vais|saurais pas {_DO['fr']}", f"préfère ne pas {_DO['fr']}", "dois refuser|décliner", f"impossible de {_DO['fr']}",
    f"я|мы|мне не|нельзя {_DO['ru']}", "придётся|вынужден|вынуждена отказаться|отказать",
]
#: Refusals in scripts without blanks. Fixed values.
ASIAN_REFUSAL = re.compile(r"(?:我|我们)[^。！？\n]{0,6}(?:无法|不能|不可以|不便|没办法|拒绝)[^。！？\n]{0,8}(?:帮|协助|回答|提供|讨论|满足|完成|评论|处理|透露|答复)|(?:お手伝い|お答え|回答|対応|お応え)(?:することは)?(?:は)?できません|(?:도와|답변|도움을)[^.\n]{0,8}수 없")
#: Words of sentences that go with a refusal: courtesies, rules, other offers. Fixed values.
COURTESY = frozenset("sorry apologize apologise apologies unfortunately guidelines policy policies rules unable understand appreciate feel please let happy glad else instead qualified expert professional safety harm harmful sensitive appropriate inappropriate request topic leider entschuldigung bitte gern gerne richtlinien regeln verständnis siento disculpa disculpe favor políticas normas otra désolé désolée regrette règles merci autre извините простите пожалуйста правила сожалею другим".split())
CONTRAST = frozenset("but however aber jedoch pero mais cependant но однако".split())

#: Function words by language. Fixed values.
FUNCTION_WORDS = {
    "en": "the a an of and in to is that this it for on with as by are was be if when which each every another our one same after before how why what should can you not but there we near without within by until while because so near i me if",
    "de": "der die das den dem ein eine und nicht nur sondern auch mit von zu im ist es sich dass wenn weil obwohl während nachdem bei nach alle viele einige manche diese unsere werden warum wie kann ich ohne vor seit bitte weshalb wieso trotz über unter durch um aus als auch noch nur hat haben wird wurde",
    "fr": "le la les un une des et est que qui dans pour sur avec ne pas nos ces certains quelques plusieurs lorsque avant après dès bien de du au aux il on en sans mais pourquoi comment tu vous nous cette cet leur leurs quel quelle sous depuis souvent",
    "es": "el la los las un una y que de en con para por no se es nuestros estos muchos algunos varios cuando si aunque desde después sin pero qué cómo puedo pocas veces durante del al estas nuestras tras hasta entre según sobre cada tú usted",
    "ru": "и в на не что с по при эти такие все многие некоторые наши когда если хотя пока только без после как почему а к из за от до для мы вы они бы ли же уже ещё со некоторых такие многие",
    "it": "il lo gli una e che di con per non si è della nel alcuni molti questi quando perché come dopo prima senza anche sono del dei",
    "pt": "o os as um uma e que de em com para por não se é do da dos das nossos estes muitos alguns quando porque como depois sem também são",
}
#: Frequent words of further languages an answer may be in. Fixed values.
OTHER_WORDS = {
    "nl": "het een van dat niet zijn op voor met hij maar ook wordt naar bij deze", "pl": "się nie jest na to że jak ale przez oraz który dla są gdy po od", "sv": "och att det som är på inte för med den av till har ett när eller", "no": "og ikke det som er på av til med har jeg når eller den fra ved",
    "cs": "se že je na není jako ale který pro když jsou nebo podle jeho aby po", "tr": "bir ve bu için ile değil olarak daha gibi kadar sonra çok ama olan her ne", "uk": "і та що не це як але для його від також якщо після або вони про", "fi": "ja on ei että se joka mutta kun myös ovat tai niin kuin jos sen voi",
}
KNOWN = {w: tuple(k for k, v in FUNCTION_WORDS.items() if w in v.split()) for v0 in FUNCTION_WORDS.values() for w in v0.split()}

#: Names of languages as questions use them. Fixed values.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés английском английский английски inglese inglês", "de": "german deutsch allemand alemán немецком немецкий немецки tedesco alemão",
    "fr": "french französisch français francés французском французский французски francese francês", "es": "spanish spanisch espagnol español испанском испанский испански spagnolo espanhol",
    "ru": "russian russisch russe ruso русском русский русски", "zh": "chinese chinesisch chinois chino китайском китайский китайски mandarin", "ja": "japanese japanisch japonais japonés японском",
    "it": "italian italienisch italien italiano итальянском", "pt": "portuguese portugiesisch portugais portugués португальском", "ko": "korean koreanisch coréen coreano корейском",
}
NAMED = {w: k for k, v in LANGUAGE_NAMES.items() for w in v.split()}

_OTHERS = [frozenset(v.split()) for v in OTHER_WORDS.values()]

CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.DOTALL)
ASIAN = re.compile(r"[㐀-鿿぀-ヿ가-힯]")
HAN, KANA, HANGUL = re.compile(r"[㐀-鿿]"), re.compile(r"[぀-ヿ]"), re.compile(r"[가-힯]")
SENTENCE = re.compile(r"(?<=[.?!。？！])\s+|\n+|(?<=[。？！])")
INVISIBLE = re.compile(r"[​-‏⁠﻿­]")

SHINGLE = 3


def is_empty(answer: str | None) -> bool:
    """Whether an answer of any length says nothing: blanks, signs alone, or a placeholder."""
    if not answer:
        return True
    found = [m[0].lower() for m in islice(WORD.finditer(INVISIBLE.sub("", answer)), 4)]
    if not found:  # signs alone: a number or a bare operator would have had letters or digits
        return True
    return len(found) <= 3 and " ".join(found) in PLACEHOLDERS


_TEMPLATES = [t.split() for t in REFUSALS]
_ANCHORS = {max((w for w in t if len(w) > 1), key=len) for t in _TEMPLATES}
_SLOTS = [[frozenset(x.split("|")) for x in t.split()] for t in SLOTS]
_SLOT_ANCHORS = frozenset().union(*(t[-1] for t in _SLOTS))
_WRITTEN_OUT = {"m": ["am"], "t": ["not"], "cannot": ["can", "not"], "won": ["will"], "ll": ["will"], "d": ["would"], "ve": ["have"]}
_ALL_ANCHORS = _ANCHORS | _SLOT_ANCHORS


def refuses(sentence: list[str], least: float = 0.99) -> bool:
    """Whether the words of a sentence hold those of a refusal template in order."""
    have = set(sentence)
    if have & _ANCHORS:
        for t in _TEMPLATES:
            if sum(w in have for w in t) >= least * len(t) and lcs_length(t, sentence) >= least * len(t):
                return True
    return bool(have & _SLOT_ANCHORS) and slots_align([x for w in sentence for x in _WRITTEN_OUT.get(w, [w])])


def slots_align(sentence: list[str], gap: int = 4) -> bool:
    """Whether a template's slots are met in order, each within ``gap`` words of the one before, and the sentence
    doesn't go on to say something else behind a ``but``."""
    for t in _SLOTS:
        for start in (i for i, w in enumerate(sentence) if w in t[0]):
            at = start
            for slot in t[1:]:
                at = next((j for j in range(at + 1, min(len(sentence), at + 2 + gap)) if sentence[j] in slot), -1)
                if at < 0:
                    break
            if at < 0:
                continue
            behind = next((j for j in range(at + 1, len(sentence)) if sentence[j] in CONTRAST), len(sentence))
            if len(sentence) - behind <= 6 or not COURTESY.isdisjoint(sentence[behind:]):
                return True
    return False


def is_refusal(answer: str, answer_words: list[str] | None = None) -> bool:
    """Whether the answer only declines: at most one sentence before the refusal, and behind it at most two that are
    neither courtesies nor reasons for declining, however long the answer is."""
    found = words(answer) if answer_words is None else answer_words
    asian = not answer.isascii() and ASIAN_REFUSAL.search(answer) is not None
    if not asian and _ALL_ANCHORS.isdisjoint(found):
        return False
    sentences = list(islice((s for s in SENTENCE.split(answer) if s and not s.isspace()), 2))
    for k, s in enumerate(sentences):
        if (asian and ASIAN_REFUSAL.search(s)) or refuses(words(s)):
            rest = [s for s in SENTENCE.split(answer) if s and not s.isspace()][k + 1 :]
            return len(rest) <= 2 or sum(COURTESY.isdisjoint(words(x)) for x in rest) <= 2
    return False


def copies(question: list[str], answer: list[str], *, least: float = 0.6, gap: int = 6, share: float = 0.35) -> bool:
    """Whether the answer only gives the question back.

    Shingle containment picks candidates; then the longest common subsequence must hold ``least`` of the question,
    and the words of the answer that no shared pair of words covers must be few (``share``) and scattered (no run
    of over ``gap``): an answer that adds something has a whole run of its own.
    """
    if not question or not answer:
        return False
    if len(question) < SHINGLE or len(answer) < SHINGLE:
        return question == answer
    have = set(answer)
    if sum(w in have for w in question) < least * len(question):  # the subsequence can't be longer
        return False
    sq, sa = runs(question, SHINGLE), runs(answer, SHINGLE)
    if len(sq & sa) < 0.2 * min(len(sq), len(sa)):
        return False
    if lcs_length(question, answer) < least * len(question):
        return False
    two = runs(question, 2)
    covered = bytearray(len(answer))
    for i in range(len(answer) - 1):
        if (answer[i], answer[i + 1]) in two:
            covered[i] = covered[i + 1] = 1
    own = [len(r) for r in bytes(covered).split(b"\x01") if r]
    return sum(own) <= max(4, share * len(answer)) and max(own, default=0) <= gap


def extends(question: str, answer: str, raw: str, at_least: int = 12) -> bool:
    """Whether the answer begins with the whole of a (cut) question, goes on, and ends with the question's end:
    it may be that question as it stood before the cut. ``question`` and ``answer``: the words, joined."""
    if len(question) < at_least or len(answer) <= len(question) or not answer.startswith(question[: max(at_least, len(question) - 14)]):
        return False
    return _ends_there(raw, question.count(" ") + 1)


def _ends_there(raw: str, n: int, units: Callable[[str], list[str]] = words) -> bool:
    """Whether an answer that gives back a cut question in its first ``n`` words ends where that question may have."""
    rest = CODE.sub("", raw).strip()
    end = max(rest.rfind("?"), rest.rfind("？"))
    if end >= 0:
        return len(words(rest[end + 1 :])) <= 3
    passed = 0
    for k, paragraph in enumerate(parts := rest.split("\n\n")):  # a request without question mark ends its paragraph
        passed += len(units(paragraph))
        if passed >= n:
            return k == len(parts) - 1
    return True


def characters(text: str) -> list[str]:
    """The letters and digits of a text in a script without blanks."""
    return list("".join(words(text)))


def stretch_end(question: list[str], answer: list[str], tail: int = 6) -> int | None:
    """Where in the answer the question, aligned near the answer's beginning, ends; None if its end isn't there.

    The last shared pair among the question's ``tail`` last words counts, near the place it has in the question; the
    words behind it (a fragment, a changed word) are passed over."""
    where: dict[tuple[str, str], list[int]] = {}
    slack = 8 + len(question) // 10
    for i, two in enumerate(zip(answer[: len(question) + slack], answer[1:])):
        where.setdefault(two, []).append(i)
    for j in range(len(question) - 2, max(-1, len(question) - 2 - tail), -1):
        near = [i for i in where.get((question[j], question[j + 1]), ()) if abs(i - j) <= slack]
        if near:
            return min(len(answer), min(near, key=lambda i: abs(i - j)) + len(question) - j)
    return None


def restores(question: str, answer: str, asked: list[str], said: list[str], at_least: int = 6) -> bool:
    """Whether the answer, perhaps behind a wrapper and slightly changed, gives back a (cut) question and then only
    goes on to that question's end: as ``extends``, but aligned by ``copies`` instead of letter for letter."""
    units = words
    if len(asked) < at_least and ASIAN.search(question):
        units, asked, said = characters, characters(question), characters(answer)
    if len(asked) < at_least or len(said) <= len(asked):
        return False
    have = set(said)
    if sum(w in have for w in asked) < 0.6 * len(asked):
        return False
    end = stretch_end(asked, said)
    return end is not None and copies(asked, said[:end]) and _ends_there(answer, end, units)


def foreign(found: list[str], own: str, least: int = 4) -> bool:
    """Whether prose that no list of ``FUNCTION_WORDS`` tells is in another language than ``own``: words of a further
    language are frequent in it, and those of ``own`` are few."""
    mine = sum(own in KNOWN.get(w, ()) for w in found)
    other = max(sum(w in have for w in found) for have in _OTHERS)
    return other >= least and other >= 3 * mine and other >= 0.12 * len(found)


def language(text: str | None, found: list[str] | None = None, least: int = 2) -> str | None:
    """The language that most of the prose of ``text`` is in; None for code, values and texts too short to tell.

    ``found``: the words of the text, if the caller has them."""
    if not text:
        return None
    prose = text
    if found is None or "`" in text:
        prose = CODE.sub(" ", text)
        found = words(prose)
    han = kana = hangul = 0
    if not prose.isascii() and ASIAN.search(prose):
        han, kana, hangul = len(HAN.findall(prose)), len(KANA.findall(prose)), len(HANGUL.findall(prose))
    if han + kana + hangul >= 4 and han + kana + hangul >= 2 * sum(w.isascii() for w in found):
        return "ko" if hangul > han + kana else "ja" if kana * 4 > han else "zh"
    score = dict.fromkeys(FUNCTION_WORDS, 0)
    for w, n in Counter(w for w in found if w in KNOWN).items():
        for k in KNOWN[w]:
            score[k] += n
    first, second = sorted(score.values(), reverse=True)[:2]
    if first < least or first < 1.3 * second or first < 4 and first < 2 * second + 1:
        return None  # too little, or too mixed, to tell; short texts need a clearer lead
    return max(score, key=score.__getitem__)


def pair_defect(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair but for truncation; ``extension`` if the answer is a copy once the question is cut."""
    if is_empty(answer):
        return "empty"
    said = words(answer)
    if is_refusal(answer, said):
        return "refusal"
    if not question or not question.strip():
        return None
    asked = words(question)
    if copies(asked, said) or ASIAN.search(question) and copies(characters(question), characters(answer)):
        return "copy"
    of_question = language(question, asked)
    of_answer = language(answer, said) if of_question else None
    if of_answer and of_question != of_answer and of_answer not in {NAMED[w] for w in asked if w in NAMED}:
        return "other_language"
    if of_question and not of_answer and not any(w in NAMED for w in asked) and foreign(words(CODE.sub(" ", answer)) if "`" in answer else said, of_question):
        return "other_language"
    if asked[:2] == said[:2] and extends(" ".join(asked), " ".join(said), answer) or restores(question, answer, asked, said):
        return "extension"
    return None


def pairs_of(roles: list, contents: list) -> Iterator[tuple[int, int]]:
    """(position of the user message, position of its answer)."""
    user = reply = None
    for pos, role in enumerate(roles):
        if role == "user":
            if user is not None and reply is not None:
                yield user, reply
            user, reply = pos, None
        elif role == "assistant":
            reply = pos
    if user is not None and reply is not None:
        yield user, reply


def _pair_rows(record: str, roles: list, contents: list) -> Iterator[tuple]:
    for user, reply in pairs_of(roles, contents):
        # a pair's row: n_chars holds the position of the answer, state the defect
        yield ("p", record, user, None, None, None, reply, pair_defect(contents[user], contents[reply]), None, None, None, None)


def broken_pairs(conversations: DataFrame) -> DataFrame:
    """(id, user_pos, defect) of every pair with a useless answer."""
    scanned = cut_lineage(scan_texts(conversations, _pair_rows))
    cut = judge(scanned.where("kind = 'v'"), scanned.where("kind = 'w'")).where("cut AND field = 'content'").select("id", F.col("msg_pos").alias("pos"), "role")
    pairs = once_each(scanned.where("kind = 'p'"), ["id", "msg_pos"]).select("id", F.col("msg_pos").alias("user_pos"), F.col("n_chars").alias("answer_pos"), F.col("state").alias("found"))
    answers = cut.where("role = 'assistant'").select("id", F.col("pos").alias("answer_pos"), F.lit(True).alias("answer_cut"))
    questions = cut.where("role = 'user'").select("id", F.col("pos").alias("user_pos"), F.lit(True).alias("question_cut"))
    defect = (
        F.when(F.col("found") == "empty", "empty")
        .when(F.coalesce("answer_cut", F.lit(False)), "truncated")
        .when((F.col("found") == "extension") & F.coalesce("question_cut", F.lit(False)), "copy")
        .when(F.col("found") != "extension", F.col("found"))
    )
    return pairs.join(answers, ["id", "answer_pos"], "left").join(questions, ["id", "user_pos"], "left").withColumn("defect", defect).where("defect IS NOT NULL").select("id", "user_pos", "defect")
