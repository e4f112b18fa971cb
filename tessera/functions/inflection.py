"""Inflection of Russian phrases by case (TXT-28): the longest ending of a word that a table of paradigms knows.

A phrase's head is inflected: its adjectives and its first noun, in each part that a comma or "и" begins. What follows the
head (mostly genitives) stays, and so do abbreviations, numbers and words that aren't in the nominative.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.values import bound

CASES = {"nom": 0, "gen": 1, "dat": 2, "acc": 3, "ins": 4, "loc": 5}
#: Endings of the nominative and of the other cases (genitive, dative, accusative, instrumental, prepositional) in
#: their place, as in any grammar. Adjectives and participles.
ADJECTIVES = {
    "ый": "ого ому ый ым ом", "ой": "ого ому ой ым ом", "ий": "его ему ий им ем", "кий": "кого кому кий ким ком", "гий": "гого гому гий гим гом", "хий": "хого хому хий хим хом", "щийся": "щегося щемуся щийся щимся щемся",
    "ая": "ой ой ую ой ой", "яя": "ей ей юю ей ей", "шая": "шей шей шую шей шей", "щая": "щей щей щую щей щей", "жая": "жей жей жую жей жей", "чая": "чей чей чую чей чей", "щаяся": "щейся щейся щуюся щейся щейся",
    "ое": "ого ому ое ым ом", "ее": "его ему ее им ем", "кое": "кого кому кое ким ком", "гое": "гого гому гое гим гом", "хое": "хого хому хое хим хом", "щееся": "щегося щемуся щееся щимся щемся",
    "ые": "ых ым ые ыми ых", "ние": "них ним ние ними них", "кие": "ких ким кие кими ких", "гие": "гих гим гие гими гих", "щие": "щих щим щие щими щих", "шие": "ших шим шие шими ших", "щиеся": "щихся щимся щиеся щимися щихся",
}
#: Nouns, things more than persons. A word that ends in -ние is a noun in the singular.
NOUNS = {
    "": "а у  ом е", "ж": "жа жу ж жом же", "ч": "ча чу ч чом че", "ш": "ша шу ш шом ше", "щ": "ща щу щ щом ще", "ц": "ца цу ц цем це", "й": "я ю й ем е", "ий": "ия ию ий ием ии",
    "тель": "теля телю тель телем теле", "арь": "аря арю арь арём аре", "ень": "ня ню ень нем не", "ь": "и и ь ью и",
    "а": "ы е у ой е", "га": "ги ге гу гой ге", "ка": "ки ке ку кой ке", "ха": "хи хе ху хой хе", "жа": "жи же жу жей же", "ча": "чи че чу чей че", "ша": "ши ше шу шей ше", "ща": "щи ще щу щей ще", "ца": "цы це цу цей це",
    "я": "и е ю ей е", "ия": "ии ии ию ией ии", "ья": "ьи ье ью ьей ье",
    "о": "а у о ом е", "е": "я ю е ем е", "ие": "ия ию ие ием ии", "це": "ца цу це цем це", "ще": "ща щу ще щем ще", "мя": "мени мени мя менем мени",
    "часток": "частка частку часток частком частке", "селок": "селка селку селок селком селке", "сёлок": "сёлка сёлку сёлок сёлком сёлке", "еулок": "еулка еулку еулок еулком еулке", "рынок": "рынка рынку рынок рынком рынке", "лец": "льца льцу льца льцем льце", "вец": "вца вцу вца вцом вце", "этаж": "этажа этажу этаж этажом этаже",
}
_SKIPPED = r"(?U)^(?:\p{Lu}{2,}|.|или|не)$"
#: What stands after these isn't in the nominative.
_PREPOSITIONS = ("в", "во", "на", "по", "под", "над", "для", "при", "без", "от", "из", "до", "за", "с", "со", "к", "ко", "о", "об", "у")
_NOT_NOMINATIVE = r"(?:ого|его|ому|ему|ым|им|ых|их|ыми|ими|ой|ей|ую|юю|ов|ев|ам|ям|ами|ями|ах|ях|ы|и|у|ю|ом|ем)$"
_LONGEST = 6
_TABLE = ";".join(f"{kind}{ending}={'|'.join([ending, *forms.split(' ')])}" for kind, words in (("a", ADJECTIVES), ("n", NOUNS)) for ending, forms in words.items())


def _forms(word: Column, kind: str) -> Column:
    """Endings in the six cases, by the longest ending of the word that the table has; NULL where it has none."""
    table = F.str_to_map(F.lit(_TABLE), F.lit(";"), F.lit("="))
    found = F.transform(F.sequence(F.lit(_LONGEST), F.lit(0), F.lit(-1)), lambda n: F.when(F.length(word) > n, F.try_element_at(table, F.concat(F.lit(kind), F.right(word, n)))))
    return F.split(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)), r"\|")


def _tokens(phrase: Column) -> Column:
    """Words and what stands between them: struct(token, low, adjective, noun, begins, closes)."""

    def read(t: Column) -> Column:
        low = F.lower(t)
        usual = t.rlike(r"(?U)^[\p{L}-]+$") & ~t.rlike(_SKIPPED) & ~low.isin(*_PREPOSITIONS)
        # -ние is a noun (здание) rather than adjectives in the plural
        adjective = F.when(usual & ~low.rlike("[аеио]ние$"), _forms(low, "a"))
        return F.struct(t.alias("token"), low.alias("low"), adjective.alias("adjective"), F.when(usual, _forms(low, "n")).alias("noun"), (t.rlike("[,;]") | (low == "и")).alias("begins"), low.isin(*_PREPOSITIONS).alias("closes"))

    return F.transform(F.regexp_extract_all(F.coalesce(phrase, F.lit("")), F.lit(r"((?U)[\p{L}-]+|[^\p{L}-]+)"), F.lit(1)), read)


def _step(state: Column, t: Column) -> Column:
    """Whether the head's noun has been seen, and for each token the endings that it takes: NULL for those that stay."""
    other_case = (F.length(F.get(t["noun"], F.lit(0))) <= 1) & t["low"].rlike(_NOT_NOMINATIVE)
    takes = F.when(~state["headed"], F.coalesce(t["adjective"], F.when(~other_case, t["noun"])))
    headed = F.when(t["begins"], False).otherwise(state["headed"] | t["closes"] | (t["adjective"].isNull() & t["noun"].isNotNull()))
    return F.struct(headed.alias("headed"), F.concat(state["forms"], F.array(takes)).alias("forms"))


def _shown(at: int):
    def show(t: Column, forms: Column) -> Column:
        stem = F.substring(t["token"], F.lit(1), F.length(t["token"]) - F.length(forms[0]))
        return F.coalesce(F.concat(stem, forms[at]), t["token"])

    return show


def inflected(phrase: Column, *cases: str) -> Column:
    """TXT-28: struct of the phrase in each of the cases (nom, gen, dat, acc, ins, loc); NULL as the empty text."""

    def take(x: Column) -> Column:
        return F.struct(*(F.array_join(F.zip_with(x["tokens"], x["forms"], _shown(CASES[c])), "").alias(c) for c in cases))

    def forms_of(tokens: Column) -> Column:
        start = F.struct(F.lit(False).alias("headed"), F.array().cast("array<array<string>>").alias("forms"))
        return F.struct(tokens.alias("tokens"), F.aggregate(tokens, start, _step, lambda s: s["forms"]).alias("forms"))

    return bound(bound(_tokens(phrase), forms_of), take)
