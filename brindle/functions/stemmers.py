"""Stemmers of further languages, after the published descriptions of the Snowball algorithms: tables of endings, few rules."""

from __future__ import annotations

import re
from functools import lru_cache


def region(w: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(w, start)
    return m.end() if m else len(w)


def longest(w: str, endings: tuple[str, ...], start: int) -> str | None:
    """The longest of endings (longer ones first) that w has from `start` on."""
    return next((e for e in endings if w.endswith(e) and len(w) - len(e) >= start), None)


def by_length(endings: str) -> tuple[str, ...]:
    return tuple(sorted(endings.split(), key=len, reverse=True))


# -- fixed values: the endings of the published descriptions ---------------------------------------------------------------

SWEDISH = by_length("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast")
DANISH = by_length("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret")
NORWEGIAN = by_length("erte ert a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast")
NORWEGIAN_LAST = by_length("leg eleg ig eig lig elig els lov elov slov hetslov")
SPANISH_PRONOUNS = by_length("me se sela selo selas selos la le lo las les los nos")
SPANISH_PLAIN = by_length("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos")
SPANISH_AFTER_IC = by_length("adora ador ación adoras adores aciones ante antes ancia ancias")
SPANISH_VERBS = by_length(
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
SPANISH_AFTER_GU = ("emos", "éis", "en", "es")
SPANISH_FORMS = by_length(" ".join((*SPANISH_VERBS, *SPANISH_AFTER_GU)))
SPANISH_Y = by_length("ya ye yan yen yeron yendo yo yó yas yes yais yamos")


# -- northern languages ------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def swedish(w: str) -> str:
    r1 = max(3, region(w, "aeiouyäåö"))
    end = longest(w, SWEDISH, r1)
    if end:
        w = w[: -len(end)]
    elif len(w) > r1 and w.endswith("s") and w[-2:-1] in tuple("bcdfghjklmnoprtvy"):
        w = w[:-1]
    if longest(w, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        w = w[:-1]
    end = longest(w, ("fullt", "löst", "lig", "els", "ig"), r1)
    return w[:-1] if end in ("fullt", "löst") else w[: -len(end)] if end else w


@lru_cache(maxsize=100_000)
def danish(w: str) -> str:
    vowels = "aeiouyæåø"
    r1 = max(3, region(w, vowels))
    end = longest(w, DANISH, r1)
    if end:
        w = w[: -len(end)]
    elif len(w) > r1 and w.endswith("s") and w[-2:-1] in tuple("abcdfghjklmnoprtvyzå"):
        w = w[:-1]
    pairs = ("gd", "dt", "gt", "kt")
    if longest(w, pairs, r1):
        w = w[:-1]
    if w.endswith("igst"):
        w = w[:-2]
    end = longest(w, ("elig", "løst", "lig", "els", "ig"), r1)
    if end == "løst":
        w = w[:-1]
    elif end:
        w = w[: -len(end)]
        if longest(w, pairs, r1):
            w = w[:-1]
    double = len(w) > 1 and w[-1] == w[-2] and w[-1] not in vowels
    return w[:-1] if double and len(w) - 1 >= r1 else w


@lru_cache(maxsize=100_000)
def norwegian(w: str) -> str:
    vowels = "aeiouyæåø"
    r1 = max(3, region(w, vowels))
    end = longest(w, NORWEGIAN, r1)
    if end in ("erte", "ert"):
        w = w[: -len(end)] + "er"
    elif end:
        w = w[: -len(end)]
    elif len(w) > r1 and re.search(rf"([bcdfghjlmnoprtvyz]|[^{vowels}]k)s$", w):
        w = w[:-1]
    if longest(w, ("dt", "vt"), r1):
        w = w[:-1]
    end = longest(w, NORWEGIAN_LAST, r1)
    return w[: -len(end)] if end else w


# -- German --------------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def german(w: str) -> str:
    vowels = "aeiouyäöü"
    w = w.replace("ß", "ss")
    # a consonant's use of u and y is written in capitals
    w = re.sub(rf"(?<=[{vowels}])[uy](?=[{vowels}])", lambda m: m[0].upper(), w)
    first = region(w, vowels)
    r1, r2 = max(3, first), region(w, vowels, first)

    end = longest(w, ("ern", "em", "er", "en", "es", "e", "s"), r1)
    if end == "s":
        w = w[:-1] if w[-2:-1] in tuple("bdfghklmnrt") else w
    elif end:
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]

    end = longest(w, ("est", "en", "er", "st"), r1)
    if end == "st":
        w = w[:-2] if len(w) >= 6 and w[-3] in "bdfghklmnt" else w
    elif end:
        w = w[: -len(end)]

    end = longest(w, ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"), r2)
    if end in ("end", "ung"):
        w = w[:-3]
        if longest(w, ("ig",), r2) and not w.endswith("eig"):
            w = w[:-2]
    elif end in ("ig", "ik", "isch"):
        w = w[: -len(end)] if w[-len(end) - 1 : -len(end)] != "e" else w
    elif end in ("lich", "heit"):
        w = w[:-4]
        w = w[:-2] if longest(w, ("er", "en"), r1) else w
    elif end == "keit":
        w = w[:-4]
        more = longest(w, ("lich", "ig"), r2)
        w = w[: -len(more)] if more else w
    return w.lower().translate(str.maketrans("äöü", "aou"))


# -- Spanish -------------------------------------------------------------------------------------------------------------------

_PLAIN_VOWELS = str.maketrans("áéíóú", "aeiou")


def _spanish_verb_region(w: str, vowels: str) -> int:
    if len(w) < 2:
        return len(w)
    if w[1] not in vowels:
        m = re.compile(f"[{vowels}]").search(w, 2)
    elif w[0] in vowels:
        m = re.compile(f"[^{vowels}]").search(w, 2)
    else:
        return min(3, len(w))
    return m.end() if m else len(w)


def _spanish_noun(w: str, r1: int, r2: int) -> str:
    """Without a noun's or an adverb's ending; w itself where there is none."""
    cut = lambda x, *ends: next((x[: -len(e)] for e in ends if x.endswith(e) and len(x) - len(e) >= r2), x)
    ends = by_length(" ".join((*SPANISH_PLAIN, *SPANISH_AFTER_IC, "logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos")))
    end = next((e for e in ends if w.endswith(e)), None)
    if end is None or len(w) - len(end) < (r1 if end == "amente" else r2):
        return w
    root = w[: -len(end)]
    if end in SPANISH_AFTER_IC:
        return cut(root, "ic")
    if end in ("logía", "logías"):
        return root + "log"
    if end in ("ución", "uciones"):
        return root + "u"
    if end in ("encia", "encias"):
        return root + "ente"
    if end == "amente":
        after = cut(root, "iv")
        return cut(after, "at") if after != root else cut(root, "os", "ic", "ad")
    if end == "mente":
        return cut(root, "ante", "able", "ible")
    if end in ("idad", "idades"):
        return cut(root, "abil", "ic", "iv")
    return cut(root, "at") if end in ("iva", "ivo", "ivas", "ivos") else root


@lru_cache(maxsize=100_000)
def spanish(w: str) -> str:
    vowels = "aeiouáéíóúü"
    rv, r1 = _spanish_verb_region(w, vowels), region(w, vowels)
    r2 = region(w, vowels, r1)

    pronoun = longest(w, SPANISH_PRONOUNS, rv)
    if pronoun:
        verb = w[: -len(pronoun)]
        form = longest(verb, ("iéndo", "iendo", "ándo", "ando", "ár", "ér", "ír", "ar", "er", "ir"), rv)
        if form:
            w = verb[: -len(form)] + form.translate(_PLAIN_VOWELS)
        elif longest(verb, ("yendo",), rv) and verb.endswith("uyendo"):
            w = verb

    noun = _spanish_noun(w, r1, r2)
    if noun != w:
        w = noun
    else:
        end = longest(w, SPANISH_Y, rv)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = longest(w, SPANISH_FORMS, rv)
            if end:
                w = w[: -len(end)]
                if end in SPANISH_AFTER_GU and w.endswith("gu"):
                    w = w[:-1]
    end = longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if end:
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN_VOWELS)
