"""English stems by the published Snowball rules, for words of letters and digits without apostrophes."""

from __future__ import annotations

import re
from functools import lru_cache

# Words with stems of their own, and words whose stem is known after the plural has gone.
OWN_STEM = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Beginnings after which the first region starts.
REGION_PREFIX = ("gener", "commun", "arsen")
# What a suffix becomes, for the second and third step; `li`, `ogi` and `ative` have conditions.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
    "ative": "",
}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
BEFORE_LI = "cdeghkmnrt"
DOUBLES = "bdfgmnprt"

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _any_of(suffixes) -> re.Pattern:
    """The longest of these suffixes: the search from the left finds it first."""
    return re.compile(f"(?:{'|'.join(suffixes)})$")


_PLURAL = _any_of(("sses", "ied", "ies", "us", "ss", "s"))
_PAST = _any_of(("eedly", "ingly", "edly", "eed", "ing", "ed"))
_SECOND, _THIRD, _FOURTH = _any_of(SECOND), _any_of(THIRD), _any_of(FOURTH)


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin."""

    def after(begin: int) -> int:
        found = _REGION.search(word, begin)
        return found.end() if found else len(word)

    first = next((len(p) for p in REGION_PREFIX if word.startswith(p)), None)
    first = after(0) if first is None else first
    return first, after(first)


def _without_plural(word: str) -> str:
    found = _PLURAL.search(word)
    if not found:
        return word
    suffix, rest = found.group(), word[: found.start()]
    if suffix == "sses":
        return rest + "ss"
    if suffix in ("ied", "ies"):
        return rest + ("i" if len(rest) > 1 else "ie")
    return rest if suffix == "s" and re.search(r"[aeiouy].", rest) else word


def _without_past(word: str, first: int) -> str:
    found = _PAST.search(word)
    if not found:
        return word
    rest = word[: found.start()]
    if found.group().startswith("eed"):
        return rest + "ee" if found.start() >= first else word
    if not re.search("[aeiouy]", rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if re.search(rf"([{DOUBLES}])\1$", rest):
        return rest[:-1]
    return rest + "e" if first >= len(rest) and _SHORT.search(rest) else rest


def _second(word: str, first: int) -> str:
    found = _SECOND.search(word)
    if not found or found.start() < first:
        return word
    suffix, rest = found.group(), word[: found.start()]
    if suffix == "ogi" and not rest.endswith("l") or suffix == "li" and rest[-1:] not in tuple(BEFORE_LI):
        return word
    return rest + SECOND[suffix]


def _third(word: str, first: int, second: int) -> str:
    found = _THIRD.search(word)
    if not found or found.start() < (second if found.group() == "ative" else first):
        return word
    return word[: found.start()] + THIRD[found.group()]


def _fourth(word: str, second: int) -> str:
    found = _FOURTH.search(word)
    if not found or found.start() < second:
        return word
    rest = word[: found.start()]
    return word if found.group() == "ion" and not rest.endswith(("s", "t")) else rest


def _last_letter(word: str, first: int, second: int) -> str:
    rest = word[:-1]
    if word.endswith("e") and (len(rest) >= second or len(rest) >= first and not _SHORT.search(rest)):
        return rest
    return rest if word.endswith("ll") and len(rest) >= second else word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in OWN_STEM:
        return OWN_STEM[word]
    # A y that is a consonant is marked by a capital.
    word = re.sub("^y", "Y", word)
    word = re.sub("([aeiouy])y", r"\1Y", word)
    first, second = _regions(word)
    word = _without_plural(word)
    if word in FINISHED:
        return word
    word = _without_past(word, first)
    word = re.sub("(?<=.)(?<=[^aeiouy])[yY]$", "i", word) if len(word) > 2 else word
    word = _second(word, first)
    word = _third(word, first, second)
    word = _fourth(word, second)
    return _last_letter(word, first, second).lower()
