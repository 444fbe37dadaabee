"""Spanish suffix stripping after the published Snowball description."""

from __future__ import annotations

_VOWELS = frozenset("aeiouáéíóúü")
# The suffix classes of the published algorithm.
_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_GERUNDS_ACCENTED = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
_GERUNDS = "ando iendo ar er ir".split()
_NOUNS = (
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas "
    "amiento amientos imiento imientos"
).split()
_AGENTS = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_E_VERBS = "en es éis emos".split()
_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré "
    "erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron "
    "ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_RESIDUAL = "os a o á í ó".split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def _longest(word: str, suffixes: list[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _after_vowel_consonant(word: str, start: int) -> int:
    """Position after the first consonant that follows a vowel, from ``start``."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    first, second = word[0] in _VOWELS, word[1] in _VOWELS
    if not second:
        return next((i + 1 for i in range(2, len(word)) if word[i] in _VOWELS), len(word))
    if first:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in _VOWELS), len(word))
    return 3


def stem_spanish(word: str) -> str:
    word = word.lower()
    rv = _verb_region(word)
    r1 = _after_vowel_consonant(word, 0)
    r2 = _after_vowel_consonant(word, r1)

    def within(suffix: str, region: int) -> bool:
        return bool(suffix) and word.endswith(suffix) and len(word) - len(suffix) >= region

    pronoun = _longest(word, _PRONOUNS)
    if within(pronoun, rv):
        rest = word[: -len(pronoun)]
        accented = _longest(rest, list(_GERUNDS_ACCENTED))
        bare = _longest(rest, _GERUNDS)
        if accented and len(rest) - len(accented) >= rv:
            word = rest[: -len(accented)] + _GERUNDS_ACCENTED[accented]
        elif bare and len(rest) - len(bare) >= rv or rest.endswith("uyendo") and len(rest) - 5 >= rv:
            word = rest

    before = word

    def strip_in(region: int, *suffixes: str) -> bool:
        nonlocal word
        s = _longest(word, list(suffixes))
        if within(s, region):
            word = word[: -len(s)]
            return True
        return False

    suffix = _longest(word, [*_NOUNS, *_AGENTS, *_REPLACED, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"])
    if suffix == "amente":
        if strip_in(r1, suffix):
            if strip_in(r2, "iv"):
                strip_in(r2, "at")
            else:
                strip_in(r2, "os", "ic", "ad")
    elif within(suffix, r2):
        if suffix in _REPLACED:
            word = word[: -len(suffix)] + _REPLACED[suffix]
        else:
            word = word[: -len(suffix)]
            if suffix in _AGENTS:
                strip_in(r2, "ic")
            elif suffix == "mente":
                strip_in(r2, "ante", "able", "ible")
            elif suffix in ("idad", "idades"):
                strip_in(r2, "abil", "ic", "iv")
            elif suffix in ("iva", "ivo", "ivas", "ivos"):
                strip_in(r2, "at")

    if word == before:
        y_verb = _longest(word, _Y_VERBS)
        if within(y_verb, rv) and word[: -len(y_verb)].endswith("u"):
            word = word[: -len(y_verb)]
        else:
            # the longest verb suffix inside the region
            found = max((s for s in [*_E_VERBS, *_VERBS] if within(s, rv)), key=len, default="")
            if found:
                word = word[: -len(found)]
                if found in _E_VERBS and word.endswith("gu"):
                    word = word[:-1]

    last = _longest(word, [*_RESIDUAL, "e", "é"])
    if within(last, rv):
        word = word[: -len(last)]
        if last in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_ACUTE)
