"""The Snowball rules for English word by word, as the published description states them: what columns are held against."""

import re

VOWELS = "aeiouy"
EXCEPTIONS = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl")
EXCEPTIONS |= {w: w for w in "sky news howe atlas cosmos bias andes".split()}
AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())


def after(word, start):
    seen = False
    for i in range(start, len(word)):
        if word[i] in VOWELS:
            seen = True
        elif seen:
            return i + 1
    return len(word)


def short_end(w):
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def stem(word):
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = list(word)
    for i, c in enumerate(w):
        if c == "y" and (i == 0 or w[i - 1] in VOWELS):
            w[i] = "Y"
    w = "".join(w)
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else after(w, 0)
    r2 = after(w, r1)

    def longest(suffixes):
        return max((s for s in suffixes if w.endswith(s)), key=len, default=None)

    s = longest(["sses", "ied", "ies", "us", "ss", "s"])
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    s = longest(["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in "bb dd ff gg mm nn pp rr tt".split():
            w = w[:-1]
        elif r1 >= len(w) and short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    rules = dict(tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful")
    rules |= dict(ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", fulli="ful", lessli="less", li="")
    s = longest(rules)
    if s and len(w) - len(s) >= r1 and not (s == "ogi" and w[-4:-3] != "l") and not (s == "li" and w[-3:-2] not in list("cdeghkmnrt")):
        w = w[: -len(s)] + rules[s]
    rules = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
    s = longest(rules)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + rules[s]
    s = longest("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
    if s and len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
