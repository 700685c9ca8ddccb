"""Code tokens for search: whole runs and their camel, snake and digit pieces, in lower case, stemmed on demand."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = re.compile(r"\w+")
#: Places between a small and a large letter, a letter and a digit, and a digit and a letter.
BREAK = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[^\W\d_])(?=[0-9])|(?<=[0-9])(?=[^\W\d_])")


def _pieces(run: str) -> list[str]:
    """Of a run of several: its pieces."""
    return [p for part in run.split("_") if part for p in BREAK.split(part) if len(p) != len(run)]


def code_tokens(text: str, stemmed: bool = False) -> list[str]:
    out = RUN.findall(text or "")
    several = {r: _pieces(r) for r in set(out) if not (r.isalpha() and r.islower())}  # words of small letters are most, and never several
    several = {r: p for r, p in several.items() if p}
    if several:
        out = [t for r in out for t in (r, *several.get(r, ()))]
    out = "\0".join(out).lower().split("\0") if out else []  # stands in no run, and words end there
    return [stem(t) for t in out] if stemmed else out


def tokens(content: Column, stemmed: bool = False) -> Column:
    """array<string> by an Arrow UDF."""
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: code_tokens(t, stemmed))

    return run(content)


def joined_tokens(content: Column, by: str) -> Column:
    """struct<n long, terms string>: what tokens() finds as one string, so no object is made for each on the way; null where there are none."""
    @F.pandas_udf("n long, terms string")
    def run(s: pd.Series) -> pd.DataFrame:
        found = [code_tokens(t) for t in s]
        return pd.DataFrame({"n": [len(x) for x in found], "terms": [by.join(x) if x else None for x in found]})

    return run(content)


def simple_tokens(content: Column) -> Column:
    """Runs of ASCII letters, digits and _ in lower case, in the JVM: what SQL engines can express alike."""
    return F.regexp_extract_all(F.lower(content), F.lit(r"([a-z0-9_]+)"), F.lit(1))


# An English stemmer after the published Porter2 description.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the algorithm: words with stems of their own, and suffixes of steps 2 to 4.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent",
    "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize",
    "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(w: str, start: int = 0) -> int:
    for i in range(start + 1, len(w)):
        if w[i] not in VOWELS and w[i - 1] in VOWELS:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w)
    r2 = _region(w, r1)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in FINAL:
        return w.lower()
    # 1b: past tenses and participles
    for s in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(s):
            if s.startswith("eed"):
                w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
            elif any(c in VOWELS for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2 and 3
    for s in sorted([*STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w.endswith("logi") else w
                elif s == "li":
                    w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(s)] + STEP2[s]
            break
    for s in sorted([*STEP3, "ative"], key=len, reverse=True):
        if w.endswith(s):
            if s == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(s) >= r1:
                w = w[: -len(s)] + STEP3[s]
            break
    # 4 and 5
    for s in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[:-3].endswith(("s", "t"))):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
