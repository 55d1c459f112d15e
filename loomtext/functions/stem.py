"""Snowball stemmers from their published descriptions: English (Porter 2), German, Danish, Norwegian, Swedish here, six more languages beside."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import stem_romance as romance
from loomtext.functions import text as tx
from loomtext.functions.udf import scalar

_VOWELS = "aeiouy"
# Fixed values of the English algorithm.
_SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_DYING = {"dying": "die", "lying": "lie", "tying": "tie"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _region(w: str, start: int, vowels: str) -> int:
    """The place after the first consonant that follows a vowel from start on."""
    for i in range(max(1, start + 1), len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _short_syllable(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS and w[-1] not in "wxY"


def english(word: str) -> str:
    w = word.replace("’", "'").replace("‘", "'")
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _DYING:
        return _DYING[w]
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w, 0, _VOWELS)
    r2 = _region(w, r1, _VOWELS)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # Past and progressive forms.
    for s in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(s):
            if s.startswith("eed"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in _VOWELS for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                    w = w[:-1]
                elif r1 >= len(w) and _short_syllable(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + to
            break
    else:
        if w.endswith("logi") and len(w) - 3 >= r1:
            w = w[:-1]
        elif w.endswith("ogi") and len(w) > 3 and w[-4] == "l" and len(w) - 3 >= r1:
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and len(w) > 2 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_UMLAUT = "aeiouyäöü"


def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{_UMLAUT}])u(?=[{_UMLAUT}])", "U", w)
    w = re.sub(f"(?<=[{_UMLAUT}])y(?=[{_UMLAUT}])", "Y", w)
    first = _region(w, 0, _UMLAUT)
    r2 = _region(w, first, _UMLAUT)
    r1 = max(first, 3)
    # Endings of nouns and adjectives.
    for s in ("ern", "em", "er", "en", "es", "e"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)]
                if s in ("en", "es", "e") and w.endswith("niss"):
                    w = w[:-1]
            break
    else:
        if w.endswith("s") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] in "bdfghklmnrt":
            w = w[:-1]
    for s in ("est", "en", "er"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("st") and len(w) - 2 >= r1 and len(w) >= 6 and w[-3] in "bdfghklmnt":
            w = w[:-2]
    # Derivations.
    for s in ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"):
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                rest = w[: -len(s)]
                if s in ("end", "ung"):
                    w = rest
                    if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                        w = w[:-2]
                elif s in ("ig", "ik", "isch"):
                    if not rest.endswith("e"):
                        w = rest
                else:
                    w = rest
                    tails = ("er", "en") if s in ("lich", "heit") else ("lich", "ig")
                    for t in tails:
                        if w.endswith(t) and len(w) - len(t) >= (r1 if s in ("lich", "heit") else r2):
                            w = w[: -len(t)]
                            break
            break
    return w.translate(str.maketrans("äöüUY", "aouuy"))


def _nordic(w: str, vowels: str, first: str, s_after: str, to: dict[str, str] | None = None, s_after_k: bool = False) -> tuple[str, int]:
    """The first step of the Nordic algorithms: the longest ending of `first` in R1 goes (or becomes another), or an s after certain letters."""
    r1 = max(3, _region(w, 0, vowels))
    for e in sorted([*first.split(), "s"], key=len, reverse=True):
        if w.endswith(e) and len(w) - len(e) >= r1:
            if e != "s":
                return w[: -len(e)] + (to or {}).get(e, ""), r1
            if w[-2] in s_after or s_after_k and w[-2] == "k" and w[-3] not in vowels:
                return w[:-1], r1
            break
    return w, r1


def danish(word: str) -> str:
    vowels = "aeiouyæåø"
    pair = lambda w, r1: w[:-1] if w.endswith(("gd", "dt", "gt", "kt")) and len(w) - 2 >= r1 else w
    w, r1 = _nordic(word, vowels, "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret", "abcdfghjklmnoprtvyzå")
    w = pair(w, r1)
    if w.endswith("igst"):
        w = w[:-2]
    for e in ("elig", "els", "lig", "ig"):
        if w.endswith(e) and len(w) - len(e) >= r1:
            w = pair(w[: -len(e)], r1)
            break
    else:
        if w.endswith("løst") and len(w) - 4 >= r1:
            w = w[:-1]
    if len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in vowels:
        w = w[:-1]
    return w


def norwegian(word: str) -> str:
    vowels = "aeiouyæåø"
    w, r1 = _nordic(word, vowels, "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast erte ert", "bcdfghjlmnoprtvyz", {"erte": "er", "ert": "er"}, True)
    if w.endswith(("dt", "vt")) and len(w) - 2 >= r1:
        w = w[:-1]
    for e in ("hetslov", "eleg", "elig", "elov", "slov", "leg", "eig", "lig", "els", "lov", "ig"):
        if w.endswith(e) and len(w) - len(e) >= r1:
            return w[: -len(e)]
    return w


def swedish(word: str) -> str:
    vowels = "aeiouyäåö"
    w, r1 = _nordic(word, vowels, "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast", "bcdfghjklmnoprtvy")
    if w.endswith(("dd", "gd", "nn", "dt", "gt", "kt", "tt")) and len(w) - 2 >= r1:
        w = w[:-1]
    for e, to in (("fullt", "full"), ("löst", "lös"), ("lig", ""), ("els", ""), ("ig", "")):
        if w.endswith(e) and len(w) - len(e) >= r1:
            return w[: -len(e)] + to
    return w


STEMMERS = {
    "english": english, "german": german, "danish": danish, "norwegian": norwegian, "swedish": swedish, "french": romance.french, "spanish": romance.spanish,
    "portuguese": romance.portuguese, "italian": romance.italian, "dutch": romance.dutch, "russian": romance.russian,
}


def stemmer(language: str):
    fn = STEMMERS.get(language.lower())
    if fn is None:
        raise ValueError(f"unknown stemmer language: {language}")
    return fn


@lru_cache(1 << 16)
def stem_once(word: str, language: str = "english") -> str:
    return stemmer(language)(word)


def stem_words(words: Column, language: str = "english") -> Column:
    """The stem of each word."""
    stemmer(language)
    return scalar(lambda ws: [stem_once(w, language) for w in ws], "array<string>")(words)


def stem_word(word: Column, language: str = "english") -> Column:
    """The stem of a word."""
    stemmer(language)
    return scalar(lambda w: stem_once(w, language), "string")(word)


def stem_counts(docs: DataFrame, text: str = "text", language: str = "english", *, min_token_bytes: int = 2, stopwords_en: bool = False) -> DataFrame:
    """(stem, n) over all texts: tokens are counted first, so that each distinct one is stemmed once."""
    tokens = docs.select(F.explode(_stemmed_tokens(F.col(text), language, min_token_bytes, stopwords_en)).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return tokens.select(stem_word(F.col("t"), language).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


def _stemmed_tokens(text: Column, language: str, min_token_bytes: int, stopwords_en: bool) -> Column:
    words = tx.longer_than(tx.tokens(text), min_token_bytes)
    return tx.without(words, tx.STEM_STOPWORDS) if stopwords_en and language == "english" else words


def tokenize_and_stem(text: Column, language: str = "english", *, min_token_bytes: int = 2, stopwords_en: bool = False) -> Column:
    """Stems of the tokens of a text; stop words go only for the language 'english', spelt so."""
    return stem_words(_stemmed_tokens(text, language, min_token_bytes, stopwords_en), language)
