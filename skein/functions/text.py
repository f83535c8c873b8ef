"""Text functions as columns: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no key terms.
TERM_STOP_WORDS = (
    "the a an and or but of in on at to for with by from is was are were be been "
    "being has have had do does did will would could should may might shall can "
    "this that these those it its he she they we you i s t"
).split()
# Words that carry no answer.
ANSWER_STOP_WORDS = (
    "the a an is was were are and or to of in it he she they his her their this that with for on at by from as had have has "
    "be been being what who how when where which s not but so if then than into"
).split()
# Pronouns and general nouns that name nobody.
NOISE_WORDS = (
    "i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours ourselves "
    "they them their theirs themselves who whom whose which that this these those one ones thing things everyone someone anyone nobody "
    "man men woman women person people guy guys all both each other another others"
).split()
# Phrases of factual and of creative requests.
FACTUAL = "what is|who is|when did|where is|how many|tell me about|define|what are"
CREATIVE = "write|imagine|create|invent|pretend|make up|generate|design|compose"
#: Key terms kept of one record.
TERM_CAP = 20


def trim_all(c: Column) -> Column:
    """Trim white space of any kind, as opposed to blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def key_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, no stop words, two letters or more."""
    found = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*TERM_STOP_WORDS))


def array_tokens(arr: Column) -> Column:
    """Key tokens of all strings of an array, in order; null elements have none."""
    return F.flatten(F.transform(F.coalesce(arr, F.array().cast("array<string>")), key_tokens))


def join_terms(tokens: Column, cap: int = TERM_CAP) -> Column:
    """The first ``cap`` distinct tokens in order, joined by blanks."""
    return F.array_join(F.slice(F.array_distinct(tokens), 1, cap), " ")


def properties_map(json: Column) -> Column:
    """Properties as a map; null, blank and broken JSON give an empty map."""
    return F.coalesce(F.from_json(F.coalesce(blank_to_null(json), F.lit("{}")), "map<string,string>"), F.create_map().cast("map<string,string>"))


def entity_key_terms(name: Column, kind: Column, props: Column) -> Column:
    """Tokens of name, type and property values."""
    return join_terms(F.concat(key_tokens(name), key_tokens(kind), array_tokens(F.map_values(props))))


def event_key_terms(participants: Column, action: Column, outcome: Column, locations: Column, title: Column) -> Column:
    """Tokens of participants, action, outcome, locations, title."""
    return join_terms(F.concat(array_tokens(participants), key_tokens(action), key_tokens(outcome), array_tokens(locations), key_tokens(title)))


def event_variants(participants: Column, action: Column, outcome: Column, locations: Column, title: Column, summary: Column) -> Column:
    """Array of (variant, terms): five angles on an event, empty ones left out."""
    p, l, a, o, t, s = array_tokens(participants), array_tokens(locations), key_tokens(action), key_tokens(outcome), key_tokens(title), key_tokens(summary)
    angles = [("who_what", [p, a]), ("who_result", [p, o]), ("where_what", [l, a]), ("cause_effect", [a, o]), ("summary", [t, s, p])]
    made = F.array(*[F.struct(F.lit(n).alias("variant"), join_terms(F.concat(*parts)).alias("terms")) for n, parts in angles])
    return F.filter(made, lambda v: v["terms"] != "")


def entity_variants(name: Column, kind: Column, props: Column, aliases: Column) -> Column:
    """Array of (variant, terms): name with type, name with properties, each alias."""
    n, k = key_tokens(name), key_tokens(kind)
    first = F.array(
        F.struct(F.lit("name_type").alias("variant"), join_terms(F.concat(n, k)).alias("terms")),
        F.struct(F.lit("name_props").alias("variant"), join_terms(F.concat(n, array_tokens(F.map_values(props)))).alias("terms")),
    )
    more = F.transform(
        F.coalesce(aliases, F.array().cast("array<string>")),
        lambda x, i: F.struct(F.concat(F.lit("alias_"), i.cast("string")).alias("variant"), join_terms(F.concat(key_tokens(x), F.when(F.size(key_tokens(x)) > 0, k).otherwise(F.array().cast("array<string>")))).alias("terms")),
    )
    return F.filter(F.concat(first, more), lambda v: v["terms"] != "")


def word_set(c: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def strip_html(c: Column) -> Column:
    """Tags to blanks, common entities resolved once, white space collapsed."""
    text = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return trim_all(F.regexp_replace(text, r"\s+", " "))


def body_of(html: Column) -> Column:
    """Content of the body element, or the whole text where there is none."""
    return F.coalesce(blank_to_null(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)), html)


def clean_book_text(html: Column) -> Column:
    """Book pages to text: no style and script, tags to blanks, line structure kept."""
    text = F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"&#?[\p{L}\p{N}_]+;", " ")
    return trim_all(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def strip_credits(html: Column) -> Column:
    """Tags out, white space collapsed, the chapter's line of credits dropped."""
    text = trim_all(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))
    return trim_all(F.regexp_replace(text, r"Chapter \d+:.*?Translator:.*?Editor:\s*\S+", ""))


def normalize_name(c: Column) -> Column:
    """A name without a closing possessive and closing marks."""
    return F.regexp_replace(F.regexp_replace(trim_all(c), "[’'‘]s$", ""), r"[!?,.]+$", "")


def normalize_entity_text(c: Column) -> Column:
    """A mention without possessives, leading determiner and closing marks."""
    text = trim_all(F.regexp_replace(c, r"'s\b", ""))
    text = F.regexp_replace(text, r"^(?i)(all|the|a|an|this|these|those|some|any)\s+", "")
    return trim_all(F.regexp_replace(text, r"[!?,. ]+$", ""))


def is_noise(c: Column) -> Column:
    """Whether a mention names nobody: a noise word or one letter at most."""
    return F.lower(trim_all(c)).isin(*NOISE_WORDS) | (F.length(trim_all(c)) <= 1)


def is_factual(c: Column) -> Column:
    """A factual request: a factual phrase and no creative verb."""
    return ~F.rlike(c, F.lit(rf"(?i)\b({CREATIVE})\b")) & F.rlike(c, F.lit(rf"(?i)\b({FACTUAL})\b"))


def slug(c: Column, size: int = 20) -> Column:
    """Other characters than letters and digits to underscores, cut to ``size``."""
    return F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]", "_"), 1, size)


def file_slug(c: Column) -> Column:
    """A file name of a record: word characters, hyphens, blanks as underscores."""
    return F.replace(trim_all(F.regexp_replace(c, r"[^\p{L}\p{N}_\s-]", "")), F.lit(" "), F.lit("_"))


def mention_count(text: Column, phrase: Column) -> Column:
    """Occurrences of a phrase that don't overlap, ignoring case."""
    t, p = F.lower(text), F.lower(phrase)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")).otherwise(0)


def word_count(c: Column) -> Column:
    return F.when(trim_all(c) == "", 0).otherwise(F.size(F.split(trim_all(c), r"\s+")))
