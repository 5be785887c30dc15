"""Text as column expressions: normal forms, tokens, language, intent, trigrams, Markdown stripping."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters whose accents are dropped; other scripts keep their marks.
ACCENTED = "àáâãäåāăąèéêëēĕėęěìíîïĩīĭįòóôõöōŏőùúûüũūŭůűųçćĉċčñńņňýÿŷśŝşšșţťțžźżğģĝď"
PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiiioooooooouuuuuuuuuucccccnnnnyyyssssstttzzzgggd"

#: Language detection by script, first match wins (fixed values).
SCRIPTS = [("\\p{IsDevanagari}", "hi"), ("\\p{IsHebrew}", "he"), ("\\p{IsCyrillic}", "ru"), ("\\p{IsArabic}", "ar"), ("\\p{IsHan}", "zh")]
#: Stopwords that vote for a language, ties going to the language listed first (fixed values).
STOPWORDS = {
    "ro": "si de la cu ce este sunt care pentru din nu ca lui un o sa se mai dumnezeu cum pe ma imi",
    "en": "the and of is are what why how for from not that this with do does god about in to i my me you it on at by be was were have has when who can should will after before again over",
    "es": "el los las una que por para como dios con",
    "fr": "le les des une que pour dans dieu avec est",
    "de": "der die das und ist nicht gott wie was mit",
}
#: Words that open a question, by language (fixed values).
INTERROGATIVES = {
    "en": ["what", "why", "how", "when", "where", "who", "which", "can", "should", "is", "are", "do", "does", "did", "will", "would"],
    "ro": ["ce", "de ce", "cum", "cand", "unde", "cine", "care", "pot", "este", "sunt"],
    "hi": ["kya", "kyon", "kaise", "kab", "kahan", "kaun"],
}
#: (lexical, semantic) fusion weights by intent (fixed values).
FUSION_WEIGHTS = {"conversational": (0.6, 1.4), "navigational": (1.4, 0.6)}
TOKENS_PER_WORD = 1.35
#: Endings that stemming drops from a word, by dictionary; stand-ins for the stemmers of a full-text engine.  Other languages are not stemmed.
ENDINGS = {
    "en": "ings|ing|edly|ed|ly|es|s",
    "fr": "ements|ement|ions|ion|es|e|s",
    "es": "amente|mente|os|as|es|o|a|s",
    "de": "ungen|ung|en|er|em|es|e",
    "ro": "urilor|ului|ilor|uri|ul|ii|le",
}
LEAST_STEM = 3


def unaccent(text: Column) -> Column:
    """Lower case, accents dropped from Latin letters only."""
    return F.translate(F.lower(F.trim(text)), ACCENTED, PLAIN)


def _blanked(text: Column, keep: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(unaccent(F.coalesce(text, F.lit(""))), f"[^{keep}]+", " "), "\\s+", " "))


def normalized(text: Column) -> Column:
    """Letters, numbers and marks, single blanks."""
    return _blanked(text, "\\p{L}\\p{N}\\p{M}")


def routable(text: Column) -> Column:
    """Like ``normalized`` but keeps ``: . , -``."""
    return _blanked(text, "\\p{L}\\p{N}\\p{M}:.,\\-")


def words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def ngrams(parts: Column, n: int) -> Column:
    """Runs of ``n`` words joined by blanks."""
    return F.when(
        F.size(parts) >= n, F.transform(F.sequence(F.lit(1), F.size(parts) - (n - 1)), lambda i: F.array_join(F.slice(parts, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def tokens(norm: Column) -> Column:
    """Distinct words, pairs and triples."""
    parts = words(norm)
    return F.array_distinct(F.concat(parts, ngrams(parts, 2), ngrams(parts, 3)))


def detect_language(norm: Column, hint: Column | None = None) -> Column:
    """Script first, then most stopwords, then the hint, then English."""
    parts = words(norm)
    votes = {lang: F.size(F.array_intersect(parts, F.array(*map(F.lit, stops.split())))) for lang, stops in STOPWORDS.items()}
    most = F.greatest(*votes.values())
    by_script = F.when(F.lit(False), "")
    for pattern, lang in SCRIPTS:
        by_script = by_script.when(norm.rlike(pattern), lang)
    by_words = F.when(most == 0, F.coalesce(hint if hint is not None else F.lit(None).cast("string"), F.lit("en")))
    for lang, n in votes.items():
        by_words = by_words.when(n == most, lang)
    return F.coalesce(by_script, by_words)


def dictionary(lang: Column) -> Column:
    """The dictionary that a language tag's primary part names, else ``simple``."""
    tag = F.substring_index(F.lower(F.coalesce(lang, F.lit(""))), "-", 1)
    return F.when(tag.isin(*ENDINGS), tag).otherwise("simple")


def stemmed(parts: Column, lang: Column) -> Column:
    """Words without the ending that the language's dictionary drops; at least ``LEAST_STEM`` letters stay."""
    out, name = parts, dictionary(lang)
    for code, endings in ENDINGS.items():
        out = F.when(name == code, F.transform(parts, _dropping(endings))).otherwise(out)
    return out


def _dropping(endings: str):
    return lambda w: F.regexp_replace(w, f"^(.{{{LEAST_STEM},}}?)({endings})$", "$1")


STOPS = sorted({w for stops in STOPWORDS.values() for w in stops.split()})


def lexemes(norm: Column, lang: Column) -> Column:
    """Distinct stems of the words that are no stopword of any language."""
    kept = F.array_except(words(norm), F.array(*map(F.lit, STOPS)))
    return F.array_distinct(stemmed(kept, lang))


def intent(norm: Column, lang: Column, scripture: Column, navigational: Column, entity: Column) -> Column:
    """scripture, navigational, entity, conversational or topical: the first that holds; the flags come from the lookups."""
    return (
        F.when(scripture, "scripture")
        .when(navigational, "navigational")
        .when(entity, "entity")
        .when(conversational(norm, lang), "conversational")
        .otherwise("topical")
    )


def fusion_weight(intent_: Column, arm: int) -> Column:
    """Weight of the lexical (0) or semantic (1) arm for an intent."""
    out = F.lit(1.0)
    for name, weights in FUSION_WEIGHTS.items():
        out = F.when(intent_ == name, weights[arm]).otherwise(out)
    return out


def conversational(norm: Column, lang: Column) -> Column:
    """At least three words, opening with an interrogative of the language (English where it has none)."""
    parts = words(norm)
    first, two = F.try_element_at(parts, F.lit(1)), F.array_join(F.slice(parts, 1, 2), " ")
    hit = F.when(F.lit(False), False)
    for code in [c for c in INTERROGATIVES if c != "en"]:
        hit = hit.when(lang == code, first.isin(INTERROGATIVES[code]) | two.isin(INTERROGATIVES[code]))
    hit = hit.otherwise(first.isin(INTERROGATIVES["en"]) | two.isin(INTERROGATIVES["en"]))
    return (F.size(parts) >= 3) & F.coalesce(hit, F.lit(False))


def estimate_tokens(text: Column) -> Column:
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != ""))
    return F.ceil(n * F.lit(TOKENS_PER_WORD)).cast("bigint")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word padded by two blanks before and one after."""
    padded = F.transform(words(normalized(text)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


#: Markdown to plain text, step by step: pattern (without look-around, so that RE2 takes it too) and what stands in its place.
MARKDOWN = [
    ("\\A---\\r?\\n(?s:.*?)\\r?\\n---\\r?\\n", ""),  # front matter that is left
    ("(?s:```.*?```|~~~.*?~~~)", " "),
    ("(?m)^[ \\t]{0,3}>[ \\t]?", ""),
    ("!\\[[^\\]]*\\]\\([^)]*\\)", " "),  # images go, their descriptions with them
    ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
    ("(?m)^[ \\t]{0,3}#{1,6}[ \\t]+", ""),
    ("(?m)^[ \\t]{0,3}([-*_][ \\t]*){3,}$", " "),
    ("(?m)^[ \\t]{0,3}([*+-]|[0-9]+\\.)[ \\t]+", ""),
    ("\\*{1,3}([^*\\n]+)\\*{1,3}", "$1"),
    ("_{1,3}([^_\\n]+)_{1,3}", "$1"),
    ("`([^`]*)`", "$1"),
    ("<[^>]+>", " "),
    ("\\|", " "),
    ("[ \\t]+", " "),
    ("\\n{3,}", "\n\n"),
]


def stripped_markdown(text: Column) -> Column:
    """Plain text of Markdown: front matter, code, quotes, images, links, headings, lists, emphasis, tags and table pipes."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in MARKDOWN:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, "^[ \\n]+|[ \\n]+$", "")


_COMPILED = [(re.compile(pattern), to.replace("$", "\\")) for pattern, to in MARKDOWN]


def plain(markdown: str) -> str:
    """``stripped_markdown`` of one string."""
    for pattern, to in _COMPILED:
        markdown = pattern.sub(to, markdown)
    return markdown.strip(" \n")


def snippet(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut after the last sentence end in them if there is one, else at a word with an ellipsis."""
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, "(?s)^(.*[.!?])(?:\\s.*)?$", 1)
    word = F.concat(F.regexp_replace(head, "\\s+\\S*$", ""), F.lit("…"))
    return F.when(F.length(text) <= limit, text).when(sentence != "", sentence).otherwise(word)


def skeleton(term: Column) -> Column:
    """Letters only, doubled letters single, vowels after the first letter dropped: for spotting misspellings."""
    letters = F.regexp_replace(unaccent(term), "[^a-z]", "")
    return F.concat(F.substring(letters, 1, 1), F.regexp_replace(F.regexp_replace(F.substring(letters, F.lit(2), F.length(letters)), "[aeiouy]", ""), "([a-z])\\1+", "$1"))
