"""Language of a text by script, and for Latin script by frequent words and letters of a declared set of languages."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.udf import scalar

# Frequent words of each language; scripts that one language of the set has for itself.
WORDS = {
    "eng": "the and of to in is that it was for on are with as his they be at this have from or by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know",
    "deu": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich ihr wir",
    "fra": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son les mais comme ou si leur y dont elle cette ces aux je nous vous être avoir été fait deux même aussi bien sans tout peut après",
    "spa": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está mi porque qué sólo han yo hay vez puede todos así nos",
    "ita": "di e il la che in a per un è del della con non si da una le i dei nel alla al sono più come anche lo gli ha ma se delle ci o questo su suo dal nella stato essere fra tra loro hanno era dopo tutti quando molto",
    "por": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus",
    "nld": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen",
    "swe": "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har inte hans honom skulle hennes där min man ej vid kunde något från ut när efter upp vi dem vara vad över än",
    "dan": "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være",
    "pol": "i w na z do się nie to że jest o jak a po co tak za od by być dla już tylko ale czy był jego ich przez przy są może ten ma pod ja także oraz bardzo które który więc jeszcze",
    "tur": "bir ve bu da de için ile çok daha olarak olan gibi kadar sonra ne o ben sen değil var yok ama her en mi mı ki şey ya göre bütün kendi",
    "fin": "ja on ei se että hän oli mutta ovat kun niin myös joka sen ole kuin tai minä sinä he me te mitä jos vain nyt hänen ollut sitten kaikki",
}
SCRIPTS = [("HIRAGANA", "jpn"), ("KATAKANA", "jpn"), ("HANGUL", "kor"), ("CJK", "cmn"), ("CYRILLIC", "rus"), ("ARABIC", "ara"), ("HEBREW", "heb"), ("GREEK", "ell"), ("THAI", "tha"), ("DEVANAGARI", "hin"), ("ARMENIAN", "hye"), ("GEORGIAN", "kat"), ("TAMIL", "tam"), ("BENGALI", "ben")]
CODES = sorted({*WORDS, *(c for _, c in SCRIPTS)})
_SPEAKERS: dict[str, list[str]] = {}
for _code, _words in WORDS.items():
    for _word in dict.fromkeys(_words.split()):
        _SPEAKERS.setdefault(_word, []).append(_code)
_RUN = re.compile(r"[^\W\d_]+")
LETTERS = {"deu": "äöüß", "fra": "éèêàçùœ", "spa": "ñ¿¡áíóú", "por": "ãõç", "swe": "åäö", "dan": "æøå", "pol": "ąęłńśźżó", "tur": "ğşıç", "fin": "äö", "ita": "àèìòù"}


def ranked(text: str, only: frozenset[str] = frozenset(), ignore: frozenset[str] = frozenset()) -> list[tuple[str, float]]:
    """Languages with scores, the best first; `only`, if it names a known one, beats `ignore`."""
    keep = (lambda c: c in only) if only else (lambda c: c not in ignore)
    letters = {c: n for c, n in Counter(text).items() if c.isalpha()}
    if not letters:
        return []
    total = sum(letters.values())
    names = [(unicodedata.name(c, ""), n) for c, n in letters.items()]
    latin = sum(n for x, n in names if x.startswith("LATIN"))
    if latin * 2 < total:
        seen = {}
        for prefix, code in SCRIPTS:
            n = sum(n for x, n in names if x.startswith(prefix))
            # Kana among ideographs tells Japanese from Chinese.
            seen[code] = seen.get(code, 0) + (n * 10 if prefix in ("HIRAGANA", "KATAKANA") else n)
        return sorted(((c, n / total) for c, n in seen.items() if n and keep(c)), key=lambda x: (-x[1], x[0]))
    text = text.lower()
    words, marks, known = Counter(_RUN.findall(text)), Counter(text), Counter()
    for w, n in words.items():
        for code in _SPEAKERS.get(w, ()):
            known[code] += n
    count = max(1, sum(words.values()))
    score = {c: known[c] / count + 0.5 * sum(marks[x] for x in LETTERS.get(c, "")) / total for c in WORDS if keep(c)}
    return sorted(((c, s) for c, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))


def _codes(codes) -> frozenset[str]:
    return frozenset(c.lower() for c in codes or () if c.lower() in CODES)


def detect_text(text: str, min_length: int = 10, only=(), ignore=()) -> str:
    if len(text.encode()) < min_length:
        return "und"
    found = ranked(text, _codes(only), _codes(ignore))
    return found[0][0] if found else "und"


def detect(text: Column, min_length: int = 10, only=(), ignore=()) -> Column:
    """The code of the language, 'und' for texts of fewer bytes than min_length and where nothing fits."""
    return scalar(lambda t: detect_text(t, min_length, only, ignore), "string")(text)


def detect_if_long(text: Column, min_length: int = 10, only=(), ignore=()) -> Column:
    """As detect, with null for short texts."""
    return F.when(F.octet_length(text) >= min_length, detect(text, 0, only, ignore))


def detect_all(text: Column, min_length: int = 10, only=(), ignore=()) -> Column:
    """At most one code with its score."""

    def run(t: str):
        found = ranked(t, _codes(only), _codes(ignore))[:1] if len(t.encode()) >= min_length else []
        return [{"code": c, "score": float(s)} for c, s in found]

    return scalar(run, "array<struct<code:string,score:double>>")(text)


def language_exists(code: Column) -> Column:
    return F.lower(code).isin(CODES)
