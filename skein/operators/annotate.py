"""Events and properties from annotated tokens, and pronouns resolved by rules.

The relational part works on a ``tokens`` table (doc_id, seg_id, sent_id, tok_id,
text, lemma, pos, dep, head, ent_type, ent_id) from any annotator; ``annotate`` is
a rule-based one that needs no model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import is_noise, normalize_entity_text

TOKENS = "doc_id long, seg_id int, sent_id int, tok_id int, text string, lemma string, pos string, dep string, head int, ent_type string, ent_id int"
# Entity labels of participants and of places.
PARTICIPANTS, PLACES = ("PERSON", "ORG", "NORP"), ("GPE", "LOC", "FAC")
# Personal pronouns that stand for one person.
PRONOUNS = "he him his himself she her hers herself"
_PLACE_WORDS = frozenset("ford market pass quay gate tower hollow bridge street square river hill harbour bay island".split())
_GROUP_WORDS = frozenset("company brotherhood order house disciples guild society".split())
_PREPOSITIONS = frozenset("in at of from with near outside under against".split())
_WORD = re.compile(r"[^\W_]+|[^\w\s]")


def annotate(segments: DataFrame) -> DataFrame:
    """Tokens of segments (doc_id, segment_id, text) by rules.

    Sentences end at stops. Runs of capitalised words (links inside) are entities:
    a place or group by their words, else a person. The first word after the
    subject that ends like a past tense is the root verb.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for d, g, t in zip(b["doc_id"], b["segment_id"], b["text"]) for r in _annotate_one(d, g, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOKENS.split(", ")]).astype({"ent_id": "Int32", "head": "Int32"})

    return segments.select("doc_id", "segment_id", "text").mapInPandas(run, TOKENS)


def _annotate_one(doc: int, seg: int, text: str | None) -> list[tuple]:
    out, tok, ent = [], 0, 0
    for s, sentence in enumerate(x for x in re.split(r"(?<=[.!?])\s+|\n+", text or "") if x.strip()):
        words = _WORD.findall(sentence)
        labels: list[tuple[str, int | None]] = [("", None)] * len(words)
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and (words[j][0].isupper() or (words[j] == "of" and j > i and j + 1 < len(words) and words[j + 1][0].isupper())):
                j += 1
            if j - i >= 2 or (j > i and i > 0):
                low = {w.lower() for w in words[i:j]}
                kind = "LOC" if low & _PLACE_WORDS else "ORG" if low & _GROUP_WORDS else "PERSON"
                labels[i:j] = [(kind, ent)] * (j - i)
                ent += 1
            i = max(j, i + 1)
        verb = next((k for k in range(1, len(words)) if labels[k][1] is None and re.fullmatch(r"[a-z]+(?:ed|ought|ept|ost|ent|old|id)", words[k])), None)
        subject = next((k for k in range(verb - 1, -1, -1) if labels[k][1] is not None or words[k].lower() in PRONOUNS.split()), None) if verb is not None else None
        thing = next((k for k in range(verb + 1, len(words)) if words[k].isalpha() and labels[k][1] is None and len(words[k]) > 3), None) if verb is not None else None
        base = tok
        for k, w in enumerate(words):
            pos, dep, head = ("PROPN" if labels[k][1] is not None else "X"), "dep", base + (verb if verb is not None else 0)
            if k == verb:
                pos, dep, head = "VERB", "ROOT", base + k
            elif k == subject:
                dep = "nsubj"
            elif k == thing:
                pos, dep = "NOUN", "dobj"
            elif k > 0 and w.lower() in _PREPOSITIONS and labels[k - 1][1] is not None and labels[k][1] is None and k + 1 < len(words) and words[k + 1].isalnum():
                pos, dep, head = "ADP", "prep", base + k - 1
            elif k > 1 and words[k - 1].lower() in _PREPOSITIONS and labels[k - 2][1] is not None and labels[k - 1][1] is None and w.isalnum():
                dep, head = "pobj", base + k - 1
            lemma = re.sub(r"(?<=[a-z]{3})ed$", "", w.lower()) if k == verb else w.lower()
            out.append((doc, seg, s, tok, w, lemma, pos, dep, head, labels[k][0] or None, labels[k][1]))
            tok += 1
    return out


def sentence_entities(tokens: DataFrame) -> DataFrame:
    """(doc_id, seg_id, sent_id, name, label, pos): entities of each sentence.

    Normalised names once per sentence: the first position stays, the last label
    wins; noise words are left out.
    """
    key = ["doc_id", "seg_id", "sent_id"]
    t = tokens.filter("ent_id is not null").groupBy(*key, "ent_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("tok_id", "text"))).getField("text"), " ").alias("span"), F.first("ent_type").alias("label"), F.min("tok_id").alias("pos"))
    t = t.withColumn("name", normalize_entity_text(F.col("span"))).filter(~is_noise(F.col("name")))
    return t.groupBy(*key, "name").agg(F.max_by("label", "pos").alias("label"), F.min("pos").alias("pos"))


def extract_events(tokens: DataFrame) -> DataFrame:
    """One event per root verb with a subject; one per segment that has none.

    Rows: doc_id, seg_id, sent_id, title, action, outcome, summary, source_text,
    participants, locations.  A noise subject gives way to the sentence's first
    participant; the source text holds two sentences on either side.
    """
    key = ["doc_id", "seg_id", "sent_id"]
    ordered = lambda c: F.array_join(F.sort_array(F.collect_list(F.struct("tok_id", c))).getField(c), " ")
    sents = tokens.groupBy(*key).agg(ordered("text").alias("sentence"))
    w = Window.partitionBy("doc_id", "seg_id").orderBy("sent_id").rowsBetween(-2, 2)
    sents = sents.withColumn("source_text", F.array_join(F.collect_list(F.trim("sentence")).over(w), " "))
    verb = tokens.filter("dep = 'ROOT' and pos = 'VERB'").select(*key, F.col("tok_id").alias("v"), F.col("lemma").alias("action"))
    child = tokens.filter("dep <> 'ROOT'").select(*key, F.col("head").alias("v"), "tok_id", "text", "dep", "ent_id")
    subj = child.filter("dep in ('nsubj', 'nsubjpass')").groupBy(*key, "v").agg(F.min_by(F.struct("text", "ent_id"), "tok_id").alias("s"))
    what = child.filter("dep in ('dobj', 'attr', 'pobj')").groupBy(*key, "v").agg(F.array_join(F.sort_array(F.collect_list(F.struct("tok_id", "text"))).getField("text"), " ").alias("outcome"))
    ents = sentence_entities(tokens)
    names = lambda labels: F.sort_array(F.collect_list(F.when(F.col("label").isin(*labels), F.struct("pos", "name")))).getField("name")
    who = ents.groupBy(*key).agg(names(PARTICIPANTS).alias("participants"), names(PLACES).alias("locations"))
    spans = tokens.filter("ent_id is not null").groupBy(*key, "ent_id").agg(ordered("text").alias("span"))
    none = F.array().cast("array<string>")
    ev = verb.join(subj, [*key, "v"]).withColumn("ent_id", F.col("s.ent_id")).join(spans, [*key, "ent_id"], "left").join(what, [*key, "v"], "left").join(who, key, "left").join(sents, key)
    subject = F.coalesce(normalize_entity_text(F.col("span")), F.col("s.text"))
    people = F.coalesce("participants", none)
    subject = F.when(is_noise(subject) & (F.size(people) > 0), F.get(people, F.lit(0))).otherwise(subject)
    cols = ["doc_id", "seg_id", "sent_id", "title", "action", "outcome", "summary", "source_text", "participants", "locations"]
    events = ev.select(*key, F.substring(F.concat_ws(" ", subject, "action"), 1, 80).alias("title"), "action", F.coalesce("outcome", F.lit("")).alias("outcome"), F.col("sentence").alias("summary"), "source_text", people.alias("participants"), F.coalesce("locations", none).alias("locations"))
    segs = sents.groupBy("doc_id", "seg_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("sent_id", "sentence"))).getField("sentence"), " ").alias("text"))
    segs = segs.join(events.select("doc_id", "seg_id"), ["doc_id", "seg_id"], "left_anti").join(ents.groupBy("doc_id", "seg_id").agg(names(PARTICIPANTS).alias("participants"), names(PLACES).alias("locations")), ["doc_id", "seg_id"], "left")
    whole = segs.select("doc_id", "seg_id", F.lit(0).alias("sent_id"), F.substring("text", 1, 80).alias("title"), F.lit("").alias("action"), F.lit("").alias("outcome"), F.col("text").alias("summary"), F.col("text").alias("source_text"), F.array_distinct(F.coalesce("participants", none)).alias("participants"), F.array_distinct(F.coalesce("locations", none)).alias("locations"))
    return events.select(*cols).unionByName(whole.select(*cols))


def extract_properties(tokens: DataFrame) -> DataFrame:
    """(doc_id, seg_id, entity, attribute, value) by four dependency patterns.

    An attribute of a copula is a type, an adjective a condition, a preposition
    with its object a relation named by it, an apposition a role.  The subject
    must be part of a named entity and no noise word.
    """
    key = ["doc_id", "seg_id", "sent_id"]
    t = tokens.select(*key, "tok_id", "text", "lemma", "dep", "head", "ent_id")
    ent = t.filter("ent_id is not null").groupBy(*key, "ent_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("tok_id", "text"))).getField("text"), " ").alias("entity"))
    named = t.filter("ent_id is not null").join(ent, [*key, "ent_id"]).select(*key, F.col("tok_id").alias("n"), F.col("head").alias("n_head"), F.col("dep").alias("n_dep"), "entity")
    child = t.select(*key, F.col("tok_id").alias("c"), F.col("head").alias("c_head"), F.col("dep").alias("c_dep"), F.col("text").alias("c_text"))

    def rows(df: DataFrame, attribute: Column, value: Column) -> DataFrame:
        return df.select(*key, "entity", attribute.alias("attribute"), value.alias("value"))

    subj = named.filter("n_dep in ('nsubj', 'nsubjpass')")
    kind = rows(subj.join(child.filter("c_dep = 'attr'"), key).filter("c_head = n_head"), F.lit("type"), F.col("c_text"))
    cond = rows(named.join(child.filter("c_dep = 'amod'"), key).filter("c_head = n"), F.lit("condition"), F.col("c_text"))
    role = rows(named.join(child.filter("c_dep = 'appos'"), key).filter("c_head = n"), F.lit("role"), F.col("c_text"))
    prep = named.join(child.filter("c_dep = 'prep'"), key).filter("c_head = n").join(child.filter("c_dep = 'pobj'").select(*key, F.col("c_head").alias("p"), F.col("c_text").alias("o")), key).filter("p = c")
    rel = rows(prep, F.lower("c_text"), F.concat_ws(" ", "c_text", "o"))
    out = kind.unionByName(cond).unionByName(role).unionByName(rel).withColumn("entity", normalize_entity_text(F.col("entity")))
    return out.filter(~is_noise(F.col("entity"))).select("doc_id", "seg_id", "entity", "attribute", "value").distinct()


def resolve_pronouns(tokens: DataFrame) -> DataFrame:
    """(doc_id, seg_id, text): pronouns replaced by the last person named so far.

    The person may be named in the pronoun's own sentence.  The window runs over
    the sentences of one segment.
    """
    key = ["doc_id", "seg_id"]
    spans = tokens.filter("ent_type = 'PERSON'").groupBy(*key, "sent_id", "ent_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("tok_id", "text"))).getField("text"), " ").alias("person"), F.max("tok_id").alias("at"))
    last = spans.groupBy(*key, "sent_id").agg(F.max_by("person", "at").alias("person"))
    sents = tokens.select(*key, "sent_id").distinct().join(last, [*key, "sent_id"], "left")
    w = Window.partitionBy(*key).orderBy("sent_id").rowsBetween(Window.unboundedPreceding, 0)
    sents = sents.withColumn("person", F.last("person", ignorenulls=True).over(w))
    t = tokens.join(sents, [*key, "sent_id"])
    word = F.when(F.lower("text").isin(*PRONOUNS.split()) & F.col("person").isNotNull(), F.col("person")).otherwise(F.col("text"))
    g = t.select(*key, "tok_id", word.alias("word")).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("tok_id", "word"))).getField("word"), " ").alias("text"))
    return g.withColumn("text", F.regexp_replace("text", r" ([.,;:!?])", "$1"))
