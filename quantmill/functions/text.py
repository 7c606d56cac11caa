"""Text analysis: cleaning, tokens, stop words, stemming, span splicing and masking."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

NOT_WORD = r"[^\p{L}\p{N}]+"
#: Marks that are dropped as tokens; $ and % are kept.
PUNCTUATION = "!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Common English words that carry no meaning for ranking.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don "
    "down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me "
    "more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the "
    "their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with you your yours yourself yourselves".split()
)


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda x: x != "")


def strip_text(text: Column) -> Column:
    """Without white space of any kind, no-break blanks included, at both ends."""
    return F.regexp_replace(text, r"^[\s\u00A0]+|[\s\u00A0]+$", "")


def unit_key(unit: Column) -> Column:
    """A unit as it is compared: lower case, without white space at the ends."""
    return F.lower(strip_text(unit))


#: Latin letters that are no plain letter with marks.
_LETTERS = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "ng", "Ŋ": "NG", "µ": "u", "¼": "1/4", "½": "1/2", "¾": "3/4"}


def _plain_letters() -> dict[str, str]:
    """What the characters of the Latin blocks become: their compatible form without marks, where that is ASCII."""
    out = dict(_LETTERS)
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain.isascii() and plain.strip() and c not in out:
            out[c] = plain
    out["\u00a0"] = " "
    return out


_PLAIN = _plain_letters()


def clean(text: Column) -> Column:
    """``<num>`` becomes a blank; characters outside the Latin blocks are removed, letters of these become plain ones."""
    t = F.regexp_replace(text, "<num>", " ")
    t = F.regexp_replace(t, r"[^\u0000-\u024F\u1E00-\u1EFF]", "")
    one = {c: p for c, p in _PLAIN.items() if len(p) == 1}
    t = F.translate(t, "".join(one), "".join(one.values()))
    for c, p in _PLAIN.items():
        if len(p) > 1:
            t = F.replace(t, F.lit(c), F.lit(p))
    return F.regexp_replace(t, r"[^\u0000-\u007F]", "")


def word_tokens(text: Column) -> Column:
    """Words, numbers and single marks, in the manner of a treebank tokenizer."""
    spaced = F.regexp_replace(text, r"([^\w\s.,'-]|(?<!\d)[.,]|[.,](?!\d)|(?<!\w)['-]|['-](?!\w))", " $1 ")
    spaced = F.regexp_replace(spaced, r"(?i)('(?:s|re|ve|d|m|ll)|n't)\b", " $1")
    return F.filter(F.split(spaced, r"\s+"), lambda x: x != "")


def is_punctuation(token: Column) -> Column:
    """Whether the token is a part of the string of marks."""
    return F.instr(F.lit(PUNCTUATION), token) > 0


def content_tokens(text: Column) -> Column:
    """Cleaned tokens without stop words and marks, lower-cased and stemmed."""
    kept = F.filter(word_tokens(clean(F.coalesce(text, F.lit("")))), lambda x: ~F.lower(x).isin(*STOP_WORDS) & ~is_punctuation(x))
    return stem_all(F.transform(kept, F.lower))


def keyword_tokens(keywords: Column) -> Column:
    """Keywords split at single blanks, lower-cased and stemmed."""
    return stem_all(F.transform(F.split(F.coalesce(keywords, F.lit("")), " "), F.lower))


@pandas_udf(ArrayType(StringType()))
def stem_all(words: pd.Series) -> pd.Series:
    """Porter stems of arrays of words."""
    memo: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in memo:
            memo[w] = porter(w)
        return memo[w]

    return words.map(lambda ws: None if ws is None else [one(w) for w in ws])


_VOWEL = re.compile(r"[aeiou]")


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


#: The suffixes of steps 2 to 4 of Porter's algorithm (1980).
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """The stem of a lower-cased word by Porter's published algorithm."""
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + table[suffix]
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            w = stem
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def splice(text: Column, span: Column, replacement: Column) -> Column:
    """The text with the span (start, end), counted from 0, replaced."""
    return F.concat(F.substring(text, F.lit(1), span["start"]), replacement, F.substring(text, span["end"] + 1, F.length(text)))


def mask(text: Column, spans: Column, token: str = "[MASK]") -> Column:
    """Every occurrence of the text of each span replaced by ``token``; empty spans mask nothing."""
    parts = F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    return F.aggregate(F.filter(parts, lambda p: p != ""), text, lambda acc, p: F.replace(acc, p, F.lit(token)))
