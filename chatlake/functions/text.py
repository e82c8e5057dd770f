"""Column functions on message texts; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Stop words by language.
STOP_WORDS = {
    "ru": (
        "а без более бы был была были было быть в вам вас ваш весь вдруг ведь во "
        "вот впрочем все всё всего всех всю вы где да даже два для до другой его "
        "ее ей ему если есть ещё же за здесь и из или им иногда их к каждый как "
        "когда конечно которого которые кто куда ли лучше между меня мне много "
        "может можно можешь мой моя мы на надо наконец нам нас не него нее ней "
        "нельзя нет ни нибудь никогда ним них ничего но ну о об один он она они "
        "опять от перед по под после потом потому почему при про раз разве с сам "
        "свою себе себя сейчас со совсем так также такой там тебе тебя тем теперь "
        "то тогда тоже того той только том тот три тут ты у уж уже хорошо хоть "
        "чего чем через что чтоб чтобы чуть эти этих это этого этой этом этот я "
        "сколько какой какие какая какое"
    ).split(),
    "en": "the and of to in is it that for on with as was by at be this are or an".split(),
}
#: Phrases in quotation marks, straight or typographic, and CamelCase words.
QUOTED, CAMEL = '["«“]([^"»”]+)["»”]', r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"
#: A question with one of these asks for an overview.
OVERVIEW_PHRASES = ["проанализируй", "обзор", "обобщи", "тренды", "расскажи", "о чём", "о чем", "подведи итог", "суммируй", "summary"]


def detect_language(text: Column, share: float = 0.30) -> Column:
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    cyrillic = F.char_length(F.regexp_replace(text, r"[^\x{0400}-\x{04FF}]", ""))
    return F.when(F.coalesce(letters, F.lit(0)) == 0, F.lit("unknown")).when(cyrillic / letters >= share, F.lit("ru")).otherwise(F.lit("en"))


def hashtags(text: Column) -> Column:
    """All tags of a text, in order; null when there is none."""
    found = F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), 1)
    return F.when(F.size(found) > 0, found)


def first_by_lower(words: Column) -> Column:
    """Distinct by lower case, the first form of each kept, in order."""
    return F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(w)), acc).otherwise(F.concat(acc, F.array(w))))


def query_keywords(text: Column) -> Column:
    """Quoted phrases, tags, CamelCase words, and words of 5 letters or more."""
    quoted = F.filter(F.transform(F.regexp_extract_all(text, F.lit(QUOTED), 1), lambda x: F.trim(x)), lambda x: x != "")
    tags = F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), 1)
    camel = F.regexp_extract_all(text, F.lit(CAMEL), 1)
    long_words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]{5,})"), 1)
    return first_by_lower(F.concat(quoted, tags, camel, long_words))


def expand_keywords(phrases: Column) -> Column:
    """Each phrase and its words of 3 characters or more, distinct by lower case."""
    return first_by_lower(F.flatten(F.transform(phrases, lambda p: F.concat(F.array(p), F.filter(F.split(p, " "), lambda w: F.char_length(w) >= 3)))))


def bm25_terms(text: Column, language: str = "ru") -> Column:
    """Query terms with boosts: struct(term, boost); words of 10 characters or more weigh 5."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")), r"\s+"), lambda w: F.char_length(w) >= 2)
    wanted = F.filter(words, lambda w: ~w.isin(STOP_WORDS[language]))
    chosen = F.array_distinct(F.when(F.size(wanted) > 0, wanted).otherwise(words))
    return F.transform(chosen, lambda w: F.struct(w.alias("term"), F.when(F.char_length(w) >= 10, 5.0).otherwise(1.0).alias("boost")))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def count_tokens(text: Column) -> Column:
    """Words and single other marks: the default token counter."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")), F.lit(0)).cast("long")


def truncate_tokens(text: Column, most: Column | int) -> Column:
    """The text up to the end of its token number `most`: tokens, with the blanks before them, leave nothing out."""
    pieces = F.regexp_extract_all(text, F.lit(r"\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 0)
    return F.array_join(F.slice(pieces, F.lit(1), F.lit(most) if isinstance(most, int) else most.cast("int")), "")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_text(text: Column) -> Column:
    """Escaped, with bold and italic marks and without heading marks."""
    bold = F.regexp_replace(escape_html(text), r"\*\*([^*]+)\*\*", "<b>$1</b>")
    return F.regexp_replace(F.regexp_replace(bold, r"\*([^*\n]+)\*", "<i>$1</i>"), r"(?m)^#{1,6} +", "")


def html_refs(text: Column, links: Column) -> Column:
    """Replaces `[msg_id: N]` (any blanks) by N's link; links: map of id (string) to URL; ids without one vanish."""
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[msg_id:\s*(\d+)\]"), 1))
    text = F.regexp_replace(text, r"\[msg_id:\s*(\d+)\]", "[msg_id: $1]")
    linked = lambda n: F.when(links[n].isNotNull(), F.concat(F.lit('<a href="'), links[n], F.lit('">[link]</a>'))).otherwise(F.lit(""))
    return F.aggregate(ids, html_text(text), lambda acc, n: F.replace(acc, F.concat(F.lit("[msg_id: "), n, F.lit("]")), linked(n)))


def extract_json(text: Column) -> Column:
    """The JSON object in a model's answer: inside a code fence, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).when(braces != "", braces)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def is_overview(text: Column) -> Column:
    return F.lower(text).rlike("|".join(OVERVIEW_PHRASES))


def content_score(text: Column) -> Column:
    return F.least(F.char_length(text) / 100, F.lit(5.0))


def snippet(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def skip_lines(text: Column) -> Column:
    """Without [SKIP] and blank lines; null when nothing is left."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.contains(line, F.lit("[SKIP]")) & (F.trim(line) != "")), "\n")
    return F.when(kept != "", kept)


def backfilled_hashtags(text: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(hashtags(text), F.array().cast("array<string>")), F.lower))
