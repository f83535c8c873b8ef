"""Broken prompt and response pairs.

Per pair, in this order: an answer without content, a refusal (grammar of an
opening, an inability and a closing), an answer that only gives the question back
(greedy string tiling), another language than the question's (script, function
words), an answer that breaks off (a pushdown parser over fences, brackets,
quotations, lists and markup; words that end no sentence; a word cut short), and
an anchor that its document does not hold.

A cut between two words of a well-formed clause leaves nothing open for a parser.
Those are found by counts over all answers: a context of two to four words after
which answers practically always go on.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import stage

#: A context counts from so many occurrences on, and goes on if it ends answers at most this often.
LEAST_SEEN, MOST_ENDED = 8, 0.15
#: Anchors of a document that are looked up together.
TOGETHER = 500
#: Least share of the question's words that a copy repeats.
COPIED = 0.75

# Answers that say nothing.
PLACEHOLDERS = frozenset("none null nil nan na n/a undefined blank empty answer a response tbd todo unknown_answer".split())

# Function words per language.
FUNCTION_WORDS = {
    "en": "the a an of and in on at to was were is are it they them who which where when what why how because that this there had have with for from by both as no not be been so but after before between over did could while all than their his her only",
    "fr": "le la les un une des du de et en à au aux dans sur il elle ils elles était étaient est sont qui que quoi où quand pourquoi comment combien car ce cette cet ces ne pas pour par avec sans y avait tout tous deux sont se fut parce sur après avant entre leur son sa ses nombre quel quelle",
    "de": "der die das den dem des ein eine einen einem einer und in im am an auf zu zum zur war waren ist sind es sie er ihn wer was wo wann warum wie weil dass nicht mit für von vom bei nach vor sowohl als auch beide über stand um hatte hatten viele sich keine kein nur so aber wegen trafen",
    "es": "el la los las un una unos unas de del y en a al era eran fue fueron es son que quién quien dónde donde cuándo cuando cómo como por porque no se su sus con para sin había tanto ambos más lo le les este esta estaba estaban hubo cuántos cuántas qué cantidad entre sobre total vieron",
    "it": "il lo la gli le un una uno di del della dei delle e in nel nella a al alla era erano è sono fu furono che chi dove quando perché come non si con per da dal sia tutto tutti quel quella quelle quello quei più ci c'erano erano entrambi lungo presso trovava dopo prima loro suo sua cosa",
    "pt": "o a os as um uma de do da dos das e em no na nos nas era eram foi foram é são que quem onde quando porque como não se com para por mais ao à havia tanto ambos sobre ele ela eles elas isso estava estavam total seu sua até",
    "nl": "de het een en van in op aan te was waren is zijn er zij hij wie wat waar wanneer waarom hoe omdat dat niet met voor door naar bij zowel als ook beide over ze hun deze die had hadden om maar nog toen",
    "pl": "i w na z do o u po od za się nie to jest był była było byli ich jego jej gdzie kiedy który która które oraz tym tego tej a ale że jak przy razem było wiedzieli rozmawiali sprawie przez dla",
    "sv": "och i på av en ett den det de som var är inte med för till från där när varför hur om att han hon båda men vid sig sin hade efter mellan över",
    "da": "og i på af en et den det de som var er ikke med for til fra der når hvorfor hvor om at han hun begge men ved sig sin havde efter mellem over",
    "cs": "a v na z do o u po od za se ne to je byl byla bylo byli jejich jeho její kde kdy který která které tím toho té ale že jak při pro celkem oba věděli mluvili",
    "ro": "și în pe de la un o al ale cu nu se era erau este sunt care unde când cum pentru din au fost mai ambii despre după între lor",
    "tr": "ve bir bu da de ile için olan oldu idi değil ne kim nerede çünkü gibi daha çok her iki toplam hakkında sonra",
    "fi": "ja on oli olivat ei se ne joka missä kun koska kuin myös molemmat että sitä niitä hän he yhteensä jälkeen",
    "hu": "és a az egy volt voltak van nem hogy ki hol mikor mert mint is mindkettő összesen után között ezt azt",
}
_LISTS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}

# Words that end no sentence.
NO_END = frozenset(
    "the a an of and or at to from with by for in into who whose because although while than between about nor "
    "le la les un une des du de et ou à au aux dans qui que dont où pour était étaient "
    "der die das den dem des ein eine einen einem einer und oder im am zum zur mit für von vom sowohl als "
    "el los las una unos unas del y en al quien con para por tanto como".split()
)

# Refusal grammar: opening? inability closing?  Fixed values per language.
_OPEN = r"(?:(?:i['’]?m |i am |we['’]?re )?(?:so |very |really )?sorry|i apologi[sz]e|my apologies|apologies|unfortunately|regrettably|hmm+|well|as an? (?:ai|assistant|language model|ai language model)|désolée?|je suis désolée?|malheureusement|pardon|en tant qu['’](?:assistante?|ia|intelligence artificielle)|(?:es )?tut mir leid|entschuldigung|leider|bedaure|als (?:ki|assistent(?:in)?|sprachmodell)|lo siento|lamentablemente|desafortunadamente|perdón|como (?:asistente|ia|modelo)(?: de lenguaje)?)"
_CANNOT = "|".join(
    [
        r"(?:but )?(?:i|we) (?:can(?:not|['’]t| not)|could not|couldn['’]t|won['’]t|will not|do not|don['’]t|must decline|have to decline|decline|refuse|am (?:not able|unable)|['’]m (?:not able|unable)|have no (?:access|information|answer|idea)|would rather not|prefer not)\b",
        r"(?:but )?i['’]m (?:not able|unable)\b",
        r"(?:but )?(?:this|that|it) is (?:not something (?:i|we) can|impossible for (?:me|us)|beyond what i|not possible for me)\b",
        r"(?:but )?there (?:is|was) (?:not enough|no|insufficient) (?:information|context|data)\b",
        r"(?:but )?the (?:text|passage|context|chapter|document) (?:does not|doesn['’]t) (?:let|allow|enable|give|provide|contain|say)\b",
        r"(?:mais )?je (?:ne (?:peux|puis|dispose|sais|suis|saurais|trouve)|n['’](?:ai|arrive)|préfère ne|refuse|dois (?:décliner|refuser)|suis (?:incapable|dans l['’]impossibilité))\b",
        r"(?:il (?:m['’]?est|est) )?impossible (?:de|pour moi)\b",
        r"(?:le|ce) (?:texte|passage|document|chapitre) ne (?:me )?(?:permet|contient|donne|dit)\b",
        r"(?:aber )?(?:das |dazu |darauf |dabei |hier(?:bei|zu)? )?(?:kann|darf|möchte|weiß|habe|muss) ich\b.*\b(?:nicht|nichts|kein\w*|ablehnen|leider)\b",
        r"(?:aber )?ich (?:kann|darf|möchte|weiß|habe|muss|bin)\b.*\b(?:nicht|nichts|kein\w*|ablehnen|lage|außerstande)\b",
        r"(?:das|dies|es) ist mir nicht\b", r"(?:der text|die passage|das kapitel) (?:reicht|enthält|gibt|erlaubt)\b.*\b(?:nicht|kein\w*)\b", r"(?:dazu|darüber|hierzu) (?:liegen|fehlen|gibt)\b",
        r"(?:pero )?(?:yo )?no (?:puedo|podría|sé|dispongo|tengo|estoy (?:en condiciones|autorizad)|me es posible|cuento con)\b",
        r"(?:me es |es )?imposible (?:responder|contestar|saber|para mí)\b", r"(?:prefiero no|debo (?:rechazar|declinar)|me niego)\b", r"el (?:texto|pasaje|capítulo) no (?:me )?(?:permite|contiene|da|dice)\b", r"no hay (?:suficiente|información)\b",
    ]
)
_REFUSAL = regex.compile(rf"^(?:{_OPEN}[\s,;:.!–—-]*(?:but |mais |aber |pero )?)*(?:{_CANNOT})", regex.I)
_ONLY_OPEN = regex.compile(rf"^(?:{_OPEN}[\s,;:.!–—-]*)+$", regex.I)

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?([A-Za-z][\w-]*)[^<>]*?(/?)>")
_VOID = frozenset("br hr img input meta link wbr".split())
_STRONG_END = re.compile(r"[.!?…。！？][\s\"'”’»)\]*_]*$")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "’’": "‘‘", "」": "「"}
_OPENERS = frozenset(_PAIRS.values())
_SCRIPTS = {"CYRILLIC": "ru", "CJK": "zh", "HIRAGANA": "ja", "KATAKANA": "ja", "HANGUL": "ko", "ARABIC": "ar", "HEBREW": "he", "GREEK": "el", "DEVANAGARI": "hi", "THAI": "th"}


def visible(text: str | None) -> str:
    """A text without invisible characters, trimmed; null is empty."""
    if not text:
        return ""
    return "".join(c for c in text if c.isascii() or unicodedata.category(c) not in ("Cf", "Cc")).strip()


def is_empty(answer: str) -> bool:
    """Nothing said: no letter or digit, or a placeholder alone."""
    bare = re.sub(r"<[^<>]*>", "", answer).strip().strip("[](){}<>*_\"'.:-`“”!? \t\n").lower()
    return not any(c.isalnum() for c in bare) or bare in PLACEHOLDERS


def is_refusal(answer: str) -> bool:
    plain = re.sub(r"\s+", " ", answer).lstrip("\"'“«*- ")
    return bool(_REFUSAL.match(plain) or _ONLY_OPEN.match(plain))


def _same_word(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def tiles(a: list[str], b: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first.

    Words are compared once per pair of distinct words; the lengths of all common
    runs follow from the end backwards, row by row.
    """
    if not a or not b:
        return []
    va, vb = {w: i for i, w in enumerate(dict.fromkeys(a))}, {w: i for i, w in enumerate(dict.fromkeys(b))}
    alike = np.zeros((len(va), len(vb)), dtype=bool)
    for x, i in va.items():
        for y, j in vb.items():
            alike[i, j] = x == y or (abs(len(x) - len(y)) <= 1 and _same_word(x, y))
    same = alike[np.ix_([va[w] for w in a], [vb[w] for w in b])]
    out = []
    while True:
        run = np.zeros(len(b) + 1, dtype=np.int32)
        best = (0, 0, 0)
        for i in range(len(a) - 1, -1, -1):
            row = np.zeros(len(b) + 1, dtype=np.int32)
            row[:-1] = np.where(same[i], run[1:] + 1, 0)
            j = int(row.argmax())
            if row[j] >= best[2]:
                best = (i, j, int(row[j]))
            run = row
        i, j, n = best
        if n < least:
            return out
        same[i : i + n, :] = False
        same[:, j : j + n] = False
        out.append(best)


def is_copied(question: str, answer: str) -> bool:
    """Only the question again, once or more, whatever its case and slips.

    Copies are tiled off one after the other from the front, each with a word or
    two of its own at most, and nothing may be left: a real answer after the
    question stays, also one that takes its words from it.
    """
    q, a = _WORD.findall(question.lower()), _WORD.findall(answer.lower())
    if len(q) < 3 or len(a) < COPIED * len(q):
        return False
    known = set(q)
    if sum(w in known for w in a) < 0.5 * len(a):
        return False
    copies = 0
    while a:
        found = tiles(a[: len(q) + 3], q)
        covered = sum(n for _, _, n in found)
        if covered < COPIED * len(q):
            break
        end = max(i + n for i, _, n in found)
        if end - covered > max(1, len(q) // 10):
            return False
        copies += 1
        a = a[end:]
    return copies > 0 and not a


def _script(text: str) -> str | None:
    """Language group by script if letters outside Latin are a third or more."""
    if text.isascii():
        return None
    n: Counter = Counter()
    letters = 0
    for c in text:
        if c.isalpha():
            letters += 1
            if ord(c) > 0x36F:
                name = unicodedata.name(c, "").split(" ")[0]
                n[_SCRIPTS.get(name, "") or ""] += 1
    n.pop("", None)
    if n and (top := n.most_common(1)[0])[1] * 4 >= letters:
        return top[0]
    return None


def language_scores(text: str) -> dict[str, int]:
    """Function words of each language among a text's small-letter words.

    Words inside names ("Gate of X") do not count, for names keep their language.
    """
    found = re.findall(r"[^\W_]+(?:['’][^\W_]+)?", text)
    if text.upper() == text or not any(w[0].islower() for w in found):
        found = [w.lower() for w in found]
    seen = set()
    for k, w in enumerate(found):
        inside = 0 < k < len(found) - 1 and found[k - 1][:1].isupper() and found[k + 1][:1].isupper()
        if inside and w in ("of", "de", "von", "di", "van"):
            continue
        low = w.lower()
        if k == 0 or not w[0].isupper():
            seen.add(low)
            for mark in "'’":
                if mark in low:
                    seen |= {low.split(mark)[0] + "e", low.split(mark)[1]} if low.split(mark)[0] in ("l", "d", "qu", "s", "c", "n", "j") else {low.split(mark)[0]}
    return {k: len(seen & v) for k, v in _LISTS.items()}


def is_other_language(question: str, answer: str) -> bool:
    """The answer's language is clear, and clearly not the question's."""
    sq, sa = _script(question), _script(answer)
    if sq or sa:
        return sq != sa
    q, a = language_scores(question), language_scores(answer)
    mine = max(q.values())
    if mine < 2:
        return False
    spoken = [k for k, v in q.items() if v >= mine - (mine >= 4)]
    best = max(a.values())
    return best >= 2 and best - max(a[k] for k in spoken) >= 2


def open_constructs(text: str) -> list[str]:
    """Pushdown parse: what is still open at the end of a text."""
    stack: list[str] = []
    fences = text.count("```")
    if fences % 2:
        stack.append("```")
    body = re.sub(r"```.*?```", " ", text, flags=re.S)
    pos = 0
    for m in _TAG.finditer(body):
        tag = m[1].lower()
        if tag in _VOID or m[2]:
            continue
        if m[0][1] == "/":
            if f"<{tag}>" in stack:
                del stack[len(stack) - 1 - stack[::-1].index(f"<{tag}>") :]
        else:
            stack.append(f"<{tag}>")
    body = _TAG.sub(" ", body)
    for pos, c in enumerate(body):
        if c == '"':
            if '"' in stack:
                del stack[len(stack) - 1 - stack[::-1].index('"') :]
            else:
                stack.append('"')
        elif c == "“" and "„" in stack:  # German closing mark
            del stack[len(stack) - 1 - stack[::-1].index("„") :]
        elif c in _OPENERS or c == "„":
            stack.append(c)
        elif c in _PAIRS:
            want = _PAIRS[c]
            if want in stack:
                del stack[len(stack) - 1 - stack[::-1].index(want) :]
            elif c == "”" and "„" in stack:
                stack.remove("„")
    lines = body.rstrip().split("\n")
    if re.fullmatch(r"\s*(?:[-*•]|\d+[.)])\s*", lines[-1]) and len(lines) > 1:
        stack.append("list")
    return stack


def breaks_off(question: str, answer: str, context: str | None) -> bool:
    """Signs within the pair that an answer was cut."""
    text = answer.rstrip()
    if re.search(r"[,;:(\[{«“„–—&/]$", text) or (len(text) > 1 and text.endswith(" -")):
        return True
    if open_constructs(text) or re.search(r"\w\s*(?:\.\.\.|…)$", text):
        return True
    if _STRONG_END.search(text):
        return False
    found = _WORD.findall(text)
    if len(found) < 2:
        return False
    last = found[-1]
    if last in NO_END:
        return True
    # a word cut short: the beginning of a word at hand, and no word itself
    near = _WORD.findall(f"{question} {context or ''}")
    return not last.isdigit() and last not in near and last not in found[:-1] and any(w.startswith(last) and len(w) > len(last) for w in near)


def shape(text: str) -> list[str]:
    """Words of a text with runs of capitalised words as N and numbers as #."""
    out: list[str] = ["^"]
    for m in re.finditer(r"[^\W_]+|[,;]", text):
        w = m[0]
        s = "#" if w.isdigit() else "N" if w[0].isupper() and len(out) > 1 or (w[0].isupper() and w not in _INITIALS) else w.lower()
        if s == "N" and (out[-1] == "N" or out[-2:] == ["N", "of"]):
            del out[len(out) - (out[-1] == "of") :]
            continue
        out.append(s)
    return out


# First words that are no names.
_INITIALS = frozenset("The A An At In On It They There Because According Exactly For From By After Before Es Sie Er Im Am Auf Weil Der Die Das En El La Los Las Fue Había Se Porque Le Les À Il Elle Ils C Où Qui Wer Wo Wie Who Where What Which Why How".split())


def contexts(s: list[str], end: int) -> list[str]:
    """The contexts of four, three and two words before position ``end``."""
    return [" ".join(s[max(0, end - n) : end]) for n in (4, 3, 2) if end - n >= -1 and end >= 2]


def _goes_on(answers: DataFrame) -> DataFrame:
    """Counts of contexts over all answers: (context, seen, ended)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            ended: Counter = Counter()
            for t in b["answer"]:
                s = shape(visible(t).rpartition(": ")[2])
                for k in range(2, len(s) + 1):
                    for c in dict.fromkeys(contexts(s, k)):
                        seen[c] += 1
                        ended[c] += k == len(s)
            yield pd.DataFrame({"context": list(seen), "seen": list(seen.values()), "ended": [ended[c] for c in seen]}).astype({"seen": "int64", "ended": "int64"})

    return answers.mapInPandas(count, "context string, seen long, ended long").groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))


def squeezed(c: Column) -> Column:
    """Lower case, any white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "))


def missing_anchors(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """result_id of rows whose anchor is blank or not in their document's text.

    Distinct (document, anchor) pairs are looked up, ``TOGETHER`` or so of one
    document in one row, so a text is normalised and sent once for so many anchors
    and a document with very many is spread.  Only documents that are asked for
    are read into the join; one that does not exist or has no text holds no anchor.
    """
    r = rows.select("result_id", F.col("source_doc_id").alias("doc_id"), squeezed(F.col("retrieval_anchor")).alias("anchor"))
    asked = r.filter("doc_id is not null and anchor <> ''").select("doc_id", "anchor").distinct()
    many = asked.groupBy("doc_id").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")).filter("parts > 1")
    lists = asked.join(many, "doc_id", "left").groupBy("doc_id", F.pmod(F.xxhash64("anchor"), F.coalesce("parts", F.lit(1))).alias("part")).agg(F.collect_list("anchor").alias("anchors"))
    texts = documents.filter("text is not null").select("doc_id", squeezed(F.col("text")).alias("_text"))
    held = lists.join(texts, "doc_id").select("doc_id", F.explode(F.filter("anchors", lambda a: F.contains(F.col("_text"), a))).alias("anchor")).distinct()
    return r.join(held, ["doc_id", "anchor"], "left_anti").select("result_id").distinct()


def defects(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(result_id, defect): each broken pair with its one defect.

    ``rows``: result_id, question, expected_answer, retrieval_anchor,
    source_doc_id, context.  A null question compares with nothing; a null answer
    is empty.  Rows delivered twice count once; other columns are ignored.
    """
    slim = rows.select("result_id", F.col("question").alias("question"), F.col("expected_answer").alias("answer"), "context").filter("result_id is not null")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds, tails = [], []
            for q, a, c in zip(b["question"], b["answer"], b["context"]):
                q, a = visible(q), visible(a)
                kind, tail = None, None
                if is_empty(a):
                    kind = "empty_answer"
                elif is_refusal(a):
                    kind = "refusal"
                elif is_copied(q, a):
                    kind = "copied_question"
                elif is_other_language(q, a):
                    kind = "other_language"
                elif breaks_off(q, a, c if isinstance(c, str) else None):
                    kind = "truncated_answer"
                elif not _STRONG_END.search(a):
                    s = shape(a.rpartition(": ")[2])
                    tail = contexts(s, len(s)) if len(s) > 5 else None
                kinds.append(kind)
                tails.append(tail)
            yield pd.DataFrame({"result_id": b["result_id"], "defect": kinds, "tails": tails})

    judged = stage(slim.mapInPandas(judge, "result_id long, defect string, tails array<string>"), "judged")
    clear = judged.filter("defect is not null").select("result_id", "defect")
    tails = judged.filter("defect is null and tails is not null").select("result_id", F.posexplode("tails").alias("pos", "context"))
    known = tails.join(_goes_on(slim.select("answer")).filter(F.col("seen") >= LEAST_SEEN), "context")
    longest = known.groupBy("result_id").agg(F.min_by(F.col("ended") / F.col("seen"), "pos").alias("share"))
    cut = longest.filter(F.col("share") <= MOST_ENDED).select("result_id", F.lit("truncated_answer").alias("defect"))
    lost = missing_anchors(rows.filter("result_id is not null"), documents).select("result_id", F.lit("anchor_missing").alias("defect"))
    order = F.when(F.col("defect") == "anchor_missing", 2).otherwise(1)
    return clear.unionByName(cut).unionByName(lost).groupBy("result_id").agg(F.min(F.struct(order.alias("o"), "defect")).alias("d")).select("result_id", "d.defect")
