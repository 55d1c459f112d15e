"""Snowball stemmers from their published descriptions: French, Spanish, Portuguese, Italian, Dutch, Russian.

Regions are places in the word: R1 is what follows the first consonant after a vowel, R2 the same within R1, RV as each
language says. An ending counts if it starts at or after the region's place.
"""

from __future__ import annotations

import re


def _after(w: str, start: int, vowels: str) -> int:
    """The place after the first consonant that follows a vowel from start on."""
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _rv(w: str, vowels: str) -> int:
    """RV of Spanish, Portuguese and Italian."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


def _longest(w: str, endings: list[str], start: int = 0) -> str:
    """The longest ending of w from start on; empty if there is none."""
    return next((e for e in endings if w.endswith(e) and len(w) - len(e) >= start), "")


def _sorted(text: str) -> list[str]:
    return sorted(text.split(), key=len, reverse=True)


class _Word:
    """A word with its regions; `drop` takes endings off."""

    def __init__(self, w: str, vowels: str, rv: int):
        self.w, self.rv = w, rv
        self.r1 = _after(w, 0, vowels)
        self.r2 = _after(w, self.r1, vowels)

    def ends(self, e: str, region: int) -> bool:
        return self.w.endswith(e) and len(self.w) - len(e) >= region

    def drop(self, e: str, to: str = "") -> None:
        self.w = self.w[: len(self.w) - len(e)] + to

    def drop_in(self, region: int, *endings: str) -> bool:
        """Takes off the first of the endings that the word has, if it is in the region."""
        for e in endings:
            if self.w.endswith(e):
                if self.ends(e, region):
                    self.drop(e)
                    return True
                return False
        return False


# --- Spanish

# Fixed values of the Spanish algorithm.
_ES_PRONOUNS = _sorted("me se sela selo selas selos la le lo las les los nos")
_ES_DELETE = _sorted("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos")
_ES_IC = _sorted("adora ador ación adoras adores aciones ante antes ancia ancias")
_ES_TO = [("logías", "log"), ("logía", "log"), ("uciones", "u"), ("ución", "u"), ("encias", "ente"), ("encia", "ente")]
_ES_Y = _sorted("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_GU = _sorted("en es éis emos")
_ES_VERBS = _sorted(
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis "
    "asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
_ACUTE = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    vowels = "aeiouáéíóúü"
    x = _Word(word, vowels, _rv(word, vowels))
    if p := _longest(x.w, _ES_PRONOUNS, x.rv):
        rest = x.w[: len(x.w) - len(p)]
        verb = _longest(rest, ["iéndo", "ándo", "ár", "ér", "ír"], x.rv)
        if verb:
            x.w = rest[: len(rest) - len(verb)] + verb.translate(_ACUTE)
        elif _longest(rest, ["iendo", "ando", "ar", "er", "ir"], x.rv) or _longest(rest, ["yendo"], x.rv) and rest.endswith("uyendo"):
            x.w = rest
    before = x.w
    _spanish_suffix(x)
    if x.w == before:
        if (e := _longest(x.w, _ES_Y, x.rv)) and x.w[: len(x.w) - len(e)].endswith("u"):
            x.drop(e)
        elif e := _longest(x.w, sorted(_ES_GU + _ES_VERBS, key=len, reverse=True), x.rv):
            x.drop(e)
            if e in _ES_GU and x.w.endswith("gu"):
                x.w = x.w[:-1]
    if e := _longest(x.w, ["os", "a", "o", "á", "í", "ó"], x.rv):
        x.drop(e)
    elif e := _longest(x.w, ["e", "é"], x.rv):
        x.drop(e)
        if x.w.endswith("gu") and len(x.w) - 1 >= x.rv:
            x.w = x.w[:-1]
    return x.w.translate(_ACUTE)


def _spanish_suffix(x: _Word) -> None:
    found = max((e for e in [*_ES_DELETE, *_ES_IC, *(a for a, _ in _ES_TO), "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"] if x.w.endswith(e)), key=len, default="")
    if not found or not x.ends(found, x.r1 if found == "amente" else x.r2):
        return
    x.drop(found, dict(_ES_TO).get(found, ""))
    if found in _ES_IC:
        x.drop_in(x.r2, "ic")
    elif found == "amente":
        if x.w.endswith("iv"):
            if x.drop_in(x.r2, "iv"):
                x.drop_in(x.r2, "at")
        else:
            x.drop_in(x.r2, "os", "ic", "ad")
    elif found == "mente":
        x.drop_in(x.r2, "ante", "able", "ible")
    elif found in ("idad", "idades"):
        x.drop_in(x.r2, "abil", "ic", "iv")
    elif found in ("iva", "ivo", "ivas", "ivos"):
        x.drop_in(x.r2, "at")


# --- Portuguese

# Fixed values of the Portuguese algorithm; a~ and o~ are nasal vowels.
_PT_DELETE = _sorted("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância")
_PT_TO = [("logias", "log"), ("logia", "log"), ("uço~es", "u"), ("uça~o", "u"), ("ências", "ente"), ("ência", "ente")]
_PT_VERBS = _sorted(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o "
    "ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis "
    "ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)


def portuguese(word: str) -> str:
    vowels = "aeiouáéíóúâêô"
    w = word.replace("ã", "a~").replace("õ", "o~")
    x = _Word(w, vowels, _rv(w, vowels))
    _portuguese_suffix(x)
    if x.w == w and (e := _longest(x.w, _PT_VERBS, x.rv)):
        x.drop(e)
    if x.w != w:
        if x.ends("i", x.rv) and x.w.endswith("ci"):
            x.drop("i")
    elif e := _longest(x.w, ["os", "a", "i", "o", "á", "í", "ó"], x.rv):
        x.drop(e)
    if e := _longest(x.w, ["e", "é", "ê"], x.rv):
        x.drop(e)
        if x.w.endswith(("gu", "ci")) and len(x.w) - 1 >= x.rv:
            x.w = x.w[:-1]
    elif x.w.endswith("ç"):
        x.drop("ç", "c")
    return x.w.replace("a~", "ã").replace("o~", "õ")


def _portuguese_suffix(x: _Word) -> None:
    found = max((e for e in [*_PT_DELETE, *(a for a, _ in _PT_TO), "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"] if x.w.endswith(e)), key=len, default="")
    if found in ("ira", "iras"):
        if x.ends(found, x.rv) and x.w[: len(x.w) - len(found)].endswith("e"):
            x.drop(found, "ir")
        return
    if not found or not x.ends(found, x.r1 if found == "amente" else x.r2):
        return
    x.drop(found, dict(_PT_TO).get(found, ""))
    if found == "amente":
        if x.w.endswith("iv"):
            if x.drop_in(x.r2, "iv"):
                x.drop_in(x.r2, "at")
        else:
            x.drop_in(x.r2, "os", "ic", "ad")
    elif found == "mente":
        x.drop_in(x.r2, "ante", "avel", "ível")
    elif found in ("idade", "idades"):
        x.drop_in(x.r2, "abil", "ic", "iv")
    elif found in ("iva", "ivo", "ivas", "ivos"):
        x.drop_in(x.r2, "at")


# --- Italian

# Fixed values of the Italian algorithm.
_IT_PRONOUNS = _sorted("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_IT_DELETE = _sorted("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti")
_IT_IC = _sorted("azione azioni atore atori")
_IT_TO = [("logia", "log"), ("logie", "log"), ("uzione", "u"), ("uzioni", "u"), ("usione", "u"), ("usioni", "u"), ("enza", "ente"), ("enze", "ente")]
_IT_RV = _sorted("amento amenti imento imenti")
_IT_VERBS = _sorted(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete "
    "eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo "
    "ono uta ute uti uto ar ir"
)


def italian(word: str) -> str:
    vowels = "aeiouàèìòù"
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = re.sub(rf"(?<=[{vowels}])[ui](?=[{vowels}])", lambda m: m[0].upper(), w)
    x = _Word(w, vowels, _rv(w, vowels))
    if p := _longest(x.w, _IT_PRONOUNS, x.rv):
        rest = x.w[: len(x.w) - len(p)]
        if _longest(rest, ["ando", "endo"], x.rv):
            x.w = rest
        elif _longest(rest, ["ar", "er", "ir"], x.rv):
            x.w = rest + "e"
    before = x.w
    _italian_suffix(x)
    if x.w == before and (e := _longest(x.w, _IT_VERBS, x.rv)):
        x.drop(e)
    if e := _longest(x.w, ["a", "e", "i", "o", "à", "è", "ì", "ò"], x.rv):
        x.drop(e)
        if x.ends("i", x.rv):
            x.drop("i")
    if x.w.endswith(("ch", "gh")) and len(x.w) - 1 >= x.rv:
        x.w = x.w[:-1]
    return x.w.lower()


def _italian_suffix(x: _Word) -> None:
    found = max((e for e in [*_IT_DELETE, *_IT_IC, *(a for a, _ in _IT_TO), *_IT_RV, "amente", "ità", "ivo", "ivi", "iva", "ive"] if x.w.endswith(e)), key=len, default="")
    region = x.rv if found in _IT_RV else x.r1 if found == "amente" else x.r2
    if not found or not x.ends(found, region):
        return
    x.drop(found, dict(_IT_TO).get(found, ""))
    if found in _IT_IC:
        x.drop_in(x.r2, "ic")
    elif found == "amente":
        if x.w.endswith("iv"):
            if x.drop_in(x.r2, "iv"):
                x.drop_in(x.r2, "at")
        else:
            x.drop_in(x.r2, "abil", "os", "ic")
    elif found == "ità":
        x.drop_in(x.r2, "abil", "ic", "iv")
    elif found in ("ivo", "ivi", "iva", "ive") and x.drop_in(x.r2, "at"):
        x.drop_in(x.r2, "ic")


# --- French

# Fixed values of the French algorithm.
_FR_DELETE = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_FR_IC = "atrice ateur ation atrices ateurs ations".split()
_FR_TO = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
_FR_OTHER = "ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()
_FR_I = _sorted("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it")
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_FR_VERBS = sorted(["ions", *_FR_E, *_FR_A], key=len, reverse=True)
_FR_VOWELS = "aeiouyâàëéêèïîôûù"


def french(word: str) -> str:
    v = _FR_VOWELS
    w = re.sub(rf"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), word)
    w = re.sub(rf"(?<=[{v}])y|y(?=[{v}])", "Y", w).replace("qu", "qU")
    if len(w) > 2 and (w[0] in v and w[1] in v or w[:3] in ("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    x = _Word(w, v, rv)
    done, on = _french_suffix(x)
    changed = done
    if not done or on:
        changed = _french_i(x) or _french_verb(x) or done
    if changed:
        if x.w.endswith("Y"):
            x.drop("Y", "i")
        elif x.w.endswith("ç"):
            x.drop("ç", "c")
    else:
        if x.w.endswith("s") and len(x.w) > 1 and x.w[-2] not in "aiouès":
            x.w = x.w[:-1]
        e = _longest(x.w, ["ière", "Ière", "ion", "ier", "Ier", "e"], x.rv)
        if e == "ion":
            if x.ends("ion", x.r2) and x.w[: len(x.w) - 3].endswith(("s", "t")) and len(x.w) - 4 >= x.rv:
                x.drop("ion")
        elif e:
            x.drop(e, "" if e == "e" else "i")
    if x.w.endswith(("enn", "onn", "ett", "ell", "eill")):
        x.w = x.w[:-1]
    x.w = re.sub(rf"[éè]([^{v}]+)$", r"e\1", x.w)
    return x.w.lower()


def _french_suffix(x: _Word) -> tuple[bool, bool]:
    """Whether a suffix went, and whether the verb endings are still to be looked at."""
    e = max((s for s in [*_FR_DELETE, *_FR_IC, *_FR_TO, *_FR_OTHER] if x.w.endswith(s)), key=len, default="")
    before = x.w
    if e in ("amment", "emment"):
        if x.ends(e, x.rv):
            x.drop(e, "ant" if e[0] == "a" else "ent")
    elif e in ("ment", "ments"):
        stem = x.w[: len(x.w) - len(e)]
        if stem and stem[-1] in _FR_VOWELS and len(stem) - 1 >= x.rv:
            x.w = stem
    elif e in ("issement", "issements"):
        stem = x.w[: len(x.w) - len(e)]
        if x.ends(e, x.r1) and stem and stem[-1] not in _FR_VOWELS:
            x.w = stem
    elif e == "eaux":
        x.drop("eaux", "eau")
    elif e == "aux":
        if x.ends(e, x.r1):
            x.drop(e, "al")
    elif e in ("euse", "euses"):
        if x.ends(e, x.r2):
            x.drop(e)
        elif x.ends(e, x.r1):
            x.drop(e, "eux")
    elif e in ("ement", "ements"):
        if x.ends(e, x.rv):
            x.drop(e)
            if x.w.endswith("iv"):
                if x.drop_in(x.r2, "iv"):
                    x.drop_in(x.r2, "at")
            elif x.w.endswith("eus"):
                if not x.drop_in(x.r2, "eus") and x.ends("eus", x.r1):
                    x.drop("eus", "eux")
            elif x.w.endswith(("abl", "iqU")):
                x.drop_in(x.r2, "abl", "iqU")
            elif x.ends("ièr", x.rv) or x.ends("Ièr", x.rv):
                x.drop("ièr", "i")
    elif e and x.ends(e, x.r2):
        x.drop(e, _FR_TO.get(e, ""))
        if e in _FR_IC:
            _french_ic(x)
        elif e in ("ité", "ités"):
            if x.w.endswith("abil"):
                if not x.drop_in(x.r2, "abil"):
                    x.drop("abil", "abl")
            elif x.w.endswith("ic"):
                _french_ic(x)
            else:
                x.drop_in(x.r2, "iv")
        elif e in ("if", "ive", "ifs", "ives") and x.drop_in(x.r2, "at"):
            _french_ic(x)
    return x.w != before, x.w != before and e in ("amment", "emment", "ment", "ments")


def _french_ic(x: _Word) -> None:
    if x.w.endswith("ic") and not x.drop_in(x.r2, "ic"):
        x.drop("ic", "iqU")


def _french_i(x: _Word) -> bool:
    e = _longest(x.w, _FR_I, x.rv)
    stem = x.w[: len(x.w) - len(e)]
    if e and len(stem) - 1 >= x.rv and stem[-1] not in _FR_VOWELS:
        x.w = stem
        return True
    return False


def _french_verb(x: _Word) -> bool:
    e = _longest(x.w, _FR_VERBS, x.rv)
    if not e or e == "ions" and not x.ends(e, x.r2):
        return False
    x.drop(e)
    if e in _FR_A and x.ends("e", x.rv):
        x.drop("e")
    return True


# --- Dutch


def dutch(word: str) -> str:
    v = "aeiouyè"
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(r"^y", "Y", w)
    w = re.sub(rf"(?<=[{v}])y", "Y", w)
    w = re.sub(rf"(?<=[{v}])i(?=[{v}])", "I", w)
    x = _Word(w, v, 0)
    x.r1, least = max(3, x.r1) if x.r1 < len(w) or len(w) > 3 else len(w), x.r1
    x.r2 = _after(w, least, v)

    def undouble() -> None:
        if x.w.endswith(("kk", "dd", "tt")):
            x.w = x.w[:-1]

    def drop_en(e: str) -> bool:
        stem = x.w[: len(x.w) - len(e)]
        if x.ends(e, x.r1) and stem and stem[-1] not in v and not stem.endswith("gem"):
            x.w = stem
            undouble()
            return True
        return False

    def drop_e() -> bool:
        if x.ends("e", x.r1) and len(x.w) > 1 and x.w[-2] not in v:
            x.w = x.w[:-1]
            undouble()
            return True
        return False

    if e := _longest(x.w, ["heden", "ene", "en", "se", "s"]):
        if e == "heden":
            if x.ends(e, x.r1):
                x.drop(e, "heid")
        elif e in ("ene", "en"):
            drop_en(e)
        elif x.ends(e, x.r1) and (stem := x.w[: len(x.w) - len(e)]) and stem[-1] not in v + "j":
            x.w = stem
    e_went = drop_e()
    if x.ends("heid", x.r2) and not x.w[:-4].endswith("c"):
        x.drop("heid")
        if x.w.endswith("en"):
            drop_en("en")
    e = _longest(x.w, ["lijk", "baar", "end", "ing", "bar", "ig"])
    if e and x.ends(e, x.r2):
        if e in ("end", "ing"):
            x.drop(e)
            if x.ends("ig", x.r2) and not x.w[:-2].endswith("e"):
                x.drop("ig")
            else:
                undouble()
        elif e == "ig":
            if not x.w[:-2].endswith("e"):
                x.drop(e)
        elif e == "lijk":
            x.drop(e)
            drop_e()
        elif e == "baar" or e_went:
            x.drop(e)
    x.w = re.sub(rf"([^{v}])(aa|ee|oo|uu)([^{v}I])$", lambda m: m[1] + m[2][0] + m[3], x.w)
    return x.w.lower()


# --- Russian

# Fixed values of the Russian algorithm: endings after а or я, and endings after anything.
_RU_GERUND = _sorted("в вши вшись"), _sorted("ив ивши ившись ыв ывши ывшись")
_RU_ADJECTIVE = _sorted("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_PARTICIPLE = _sorted("ем нн вш ющ щ"), _sorted("ивш ывш ующ")
_RU_VERB = _sorted("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"), _sorted("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_RU_NOUN = _sorted("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def russian(word: str) -> str:
    v = "аеиоуыэюя"
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in v), len(w))
    x = _Word(w, v, rv)

    def drop(endings: tuple[list[str], list[str]]) -> bool:
        first, second = endings
        for e in sorted(first + second, key=len, reverse=True):
            if x.ends(e, rv):
                if e in second and e not in first or len(x.w) - len(e) - 1 >= rv and x.w[len(x.w) - len(e) - 1] in "ая":
                    x.drop(e)
                    return True
                if e in first:
                    return False
        return False

    if not drop(_RU_GERUND):
        x.drop_in(rv, "ся", "сь")
        if e := _longest(x.w, _RU_ADJECTIVE, rv):
            x.drop(e)
            drop(_RU_PARTICIPLE)
        elif not drop(_RU_VERB) and (e := _longest(x.w, _RU_NOUN, rv)):
            x.drop(e)
    if x.ends("и", rv):
        x.drop("и")
    x.drop_in(max(x.r2, rv), "ость", "ост")
    if x.ends("нн", rv):
        x.w = x.w[:-1]
    elif e := _longest(x.w, ["ейше", "ейш"], rv):
        x.drop(e)
        if x.ends("нн", rv):
            x.w = x.w[:-1]
    elif x.ends("ь", rv):
        x.drop("ь")
    return x.w
