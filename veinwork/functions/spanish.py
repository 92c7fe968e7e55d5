"""Spanish words reduced to stems, by the published Snowball algorithm, and the words that carry no meaning."""

from __future__ import annotations

VOWELS = "aeiouáéíóúü"
_ACCENTS = str.maketrans("áéíóú", "aeiou")
#: Suffixes of the algorithm: fixed values.
_PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
_STANDARD = {
    "": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias".split(),
    "log": ["logía", "logías"],
    "u": ["ución", "uciones"],
    "ente": ["encia", "encias"],
    "amente": ["amente"],
    "mente": ["mente"],
    "idad": ["idad", "idades"],
    "iv": "iva ivo ivas ivos".split(),
}
_ACIONES = {"acion", "aciones", "ación"}
_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_GU_VERBS = ["en", "es", "éis", "emos"]
_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_ENDINGS = "os a o á í ó".split()
#: Words of no meaning: fixed values.
STOP = frozenset(
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os es son era eran fue fueron ser soy eres somos sea sean he has ha hemos han haya hayan había habían tengo tiene tienen tenía".split()
)


def _after(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for k in range(start + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def _regions(word: str) -> tuple[int, int, int]:
    n = len(word)
    rv = n
    if n > 2:
        if word[1] not in VOWELS:
            rv = next((k + 1 for k in range(2, n) if word[k] in VOWELS), n)
        elif word[0] in VOWELS:
            rv = next((k + 1 for k in range(2, n) if word[k] not in VOWELS), n)
        else:
            rv = 3
    r1 = _after(word, 0)
    return rv, r1, _after(word, r1)


def _longest(word: str, suffixes, start: int = 0) -> str | None:
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= start), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    rv, r1, r2 = _regions(word)
    word = _without_pronoun(word, rv)
    shorter = _without_standard(word, r1, r2)
    if shorter == word:
        shorter = _without_verb(word, rv)
    return _without_rest(shorter, rv).translate(_ACCENTS)


def _without_pronoun(word: str, rv: int) -> str:
    p = _longest(word, _PRONOUNS)
    if not p or len(word) - len(p) < rv:
        return word
    left = word[: -len(p)]
    accented = _longest(left, ("iéndo", "ándo", "ár", "ér", "ír"), rv)
    if accented:
        return left[: -len(accented)] + accented.translate(_ACCENTS)
    if _longest(left, ("iendo", "ando", "ar", "er", "ir"), rv) or (left.endswith("yendo") and len(left) - 5 >= rv and left[:-5].endswith("u")):
        return left
    return word


def _cut(word: str, endings, start: int) -> str:
    s = _longest(word, endings, start)
    return word[: -len(s)] if s else word


def _without_standard(word: str, r1: int, r2: int) -> str:
    s = _longest(word, [x for group in _STANDARD.values() for x in group] + ["acion"])
    if not s:
        return word
    at, kind = len(word) - len(s), next((k for k, group in _STANDARD.items() if s in group), "ic")
    left = word[:at]
    if kind == "amente":
        if at < r1:
            return word
        if left.endswith("iv") and at - 2 >= r2:
            return _cut(left[:-2], ["at"], r2)
        return _cut(left, ["os", "ic", "ad"], r2)
    if at < r2:
        return word
    if kind in ("log", "u", "ente"):
        return left + kind
    if kind == "ic":
        return _cut(left, ["ic"], r2)
    if kind == "mente":
        return _cut(left, ["ante", "able", "ible"], r2)
    if kind == "idad":
        return _cut(left, ["abil", "ic", "iv"], r2)
    if kind == "iv":
        return _cut(left, ["at"], r2)
    return left


def _without_verb(word: str, rv: int) -> str:
    s = _longest(word, _Y_VERBS, rv)
    if s and word[: -len(s)].endswith("u"):
        return word[: -len(s)]
    s = _longest(word, _VERBS + _GU_VERBS, rv)
    if not s:
        return word
    left = word[: -len(s)]
    return left[:-1] if s in _GU_VERBS and left.endswith("gu") else left


def _without_rest(word: str, rv: int) -> str:
    s = _longest(word, _ENDINGS, rv)
    if s:
        return word[: -len(s)]
    s = _longest(word, ("e", "é"), rv)
    if s:
        left = word[:-1]
        return left[:-1] if left.endswith("gu") and len(left) - 1 >= rv else left
    return word
