"""Expressions on dialogue text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hesitation sounds. The first pattern holds in every language; the second ones are words in German.
HESITATION = r"^(?:u+h+m*|u+m{2,}|h+m+|m{2,}|ä+h+m*|a+h+m+|ö+h+m*|e+h+m*|e{2,}h*m*|e+r+m+|e+r{2,}|e+u+h+|heu+h*)$"
HESITATION_NOT_GERMAN = r"^(?:um|er)$"

# Frequent function words by which the language of a stretch of talk is told.
FUNCTION_WORDS = {
    "en": "the an is are was were i'm i you we they it that there this to of for on at and with would have has could can please which what how my your not or but".split(),
    "de": "der die das den dem ein eine einen einem ist sind war ich sie wir es und für im am auf mit von zu nicht noch bitte haben habe hat kann wie an auch oder aber mein ihr".split(),
    "es": "el la los las un una es son está estaba yo usted y para por con de del en que no se me mi su al hay tiene puede qué cómo cuánto pero más lo".split(),
    "fr": "le la les un une est sont était je vous nous et pour par avec de du des en que ne pas se mon votre au aux il elle quelle comment mais plus à j'ai".split(),
    "it": "il lo la gli le un una è sono era io lei e per con di del della in che non si mi ho al c'è può quale come ma più alle nella".split(),
    "pt": "o a os as um uma é são estava eu você e para por com de do da em que não se meu seu ao há tem pode qual como mas mais no na".split(),
    "nl": "de het een is zijn was ik u wij en voor van met op aan te niet nog naar heeft heb kan hoe dat die maar mijn uw".split(),
}


def tokens(text: Column) -> Column:
    """Lower-case words of a text: runs of letters, digits and inner apostrophes or colons (9:15)."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "[’ʼ`]", "'")), F.lit(r"[\p{L}\p{N}]+(?:[':][\p{L}\p{N}]+)*"), F.lit(0))


def bare(word: Column) -> Column:
    """A word without case and outer punctuation."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def is_in(word: Column, lang: str) -> Column:
    return word.isin(*FUNCTION_WORDS[lang])


def hits(words: Column, lang: str) -> Column:
    """How many of the words of an array are function words of a language."""
    known = F.array(*[F.lit(w) for w in FUNCTION_WORDS[lang]])
    return F.size(F.filter(words, lambda w: F.array_contains(known, w)))


# Texts that stand for a missing value once case and punctuation are gone.
STAND_IN = r"^(?:null|none|nil|na|n a|nan|empty|missing|undefined|blank|no (?:answer|response|reply|text|prediction)|keine antwort|sin respuesta)$"


def is_empty(text: Column) -> Column:
    """Null, without a word, or only a stand-in for a missing value."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return (plain == "") | plain.rlike(STAND_IN)


def spoken(words: Column) -> Column:
    """The words of an array without hesitation sounds."""
    return F.filter(words, lambda w: ~w.rlike(HESITATION))
