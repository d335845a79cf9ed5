"""Postal addresses read into their parts."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from parcelforge.llm.canonical import osa

# Street words with their abbreviations, words before and after a street's name, words for land at a property.
TYPES = {
    "avenue": "ave av", "bank": "", "close": "cl clo", "court": "ct crt", "crescent": "cres cresc cr", "drive": "dr drv", "gardens": "gdns gdn garden", "green": "grn", "grove": "gr gro grv",
    "hill": "hl", "lane": "ln la", "mews": "ms", "parade": "pde", "place": "pl plc", "rise": "", "road": "rd", "row": "rw", "square": "sq sqr", "street": "st str", "terrace": "ter terr tce", "walk": "wlk", "way": "wy", "yard": "yd",
}
BEFORE = {"upper": "upr", "lower": "lwr", "little": "lt ltl", "great": "gt grt", "old": "", "new": ""}
AFTER = {"north": "n nth", "south": "s sth", "east": "e", "west": "w"}
LETTER_TYPES = ("bank", "green", "rise", "yard", "walk")  # also common in names of houses
COUNTRIES = r"united kingdom|u\.?k\.?|england|great britain|gb|wales|scotland"
FILLER = re.compile(r"[^a-z]*(?:unknown|n/?a|none|nil|null|tbc|not known|see (?:plan|map|file|attached|letter|drawing)s?|as above|grid reference only|(?:address )?as (?:supplied|stated|above)|various|no address)?[^a-z]*")

_FULL = {a: (full, kind) for kind, table in (("t", TYPES), ("b", BEFORE), ("a", AFTER)) for full, short in table.items() for a in (full, *short.split())}
_LONG = [(full, kind) for full, kind in _FULL.values() if len(full) >= 5]
_OCR_LETTERS = str.maketrans("01589", "olsbg")
_OCR_DIGITS = str.maketrans("oilsbzg", "0115829")

BESIDE = r"adj(?:acent|oining|\.)?(?: to)?|adjoins|next(?: door)? to|beside|alongside|to the side of|side of|at the side of|nr|near"
REAR = r"r/o|(?:at |to )?(?:the )?(?:rear|back) of|rear|behind"
_RELATION = re.compile(rf"^[\s,.]*(?:(?:land|site|plot|ground|garden|area)s?\b[\s,]*)?(?:lying |situated )?(?:(?P<rear>{REAR})|(?P<beside>{BESIDE}))(?![a-z])\.?[\s,]*")
_LEAD = re.compile(r"^[\s,.]*(?:(?:the )?(?:site|premises|house|dwelling|property|land|building|buildings|plot)(?: known)? (?:of|at|as|on|in|to)|at|the property)\b[\s,]*(?:the site of )?")
_POSTCODE = re.compile(r"(?<![a-z0-9])([a-z8]{1,2})([0-9oilsb]{1,2})([a-z]?)[\s.]{0,4}([0-9oilsb])([a-z0-9]{2})(?![a-z0-9])")
_FLAT = re.compile(r"\b(?:flat|flt|apartment|apt|unit|maisonette)\b\.?,?\s*(?:(?:no|number|#)\b\.?\s*)?(\d{1,4}\s?[a-z]?|[a-z])(?![a-z0-9])")
_RANGE = re.compile(r"(?:\b(?:nos?|numbers?)\b\.?\s*)?(?<![\w/])(\d{1,4})\s?([a-z])?\s*(?:-|to|/|&)\s*(\d{1,4})\s?([a-z])?(?![\w])")
_NUMBER = re.compile(r"(?:\b(?:nos?|numbers?)\b\.?\s*)?(?<![\w/])(\d[0-9oil]{0,3})(?:\s?([a-z]))?(?![\w])")
_DASHES = dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212, 0xAD], "-") | dict.fromkeys([0xA0, 0x2007, 0x202F, 0x2002, 0x2003, 0x2009, 0x200B, 0xFEFF, 9], " ") | {0x2019: "'", 10: ",", 13: ","}


class Address(NamedTuple):
    """unit: strict part (relation, flat, number or range with letters); street: name|type|side|word before it; lead: what stands before
    the street (a house's name or places); places: words after it; postcode: repaired, without space."""

    unit: str
    street: str
    lead: list[str]
    places: list[str]
    postcode: str


@lru_cache(maxsize=1 << 16)
def _role(word: str) -> tuple[str, str] | None:
    """What a word is to a street: ("lane", "t") a type, ("upper", "b") before its name, ("north", "a") after it; typos of long ones included."""
    w = word.translate(_OCR_LETTERS)
    if w in _FULL:
        return _FULL[w]
    if len(w) >= 4:
        near = {x for x in _LONG if abs(len(x[0]) - len(w)) <= 1 and x[0][0] == w[0] and osa(w, x[0], 1) <= 1} or {x for x in _LONG if sorted(x[0]) == sorted(w) and osa(w, x[0], 1) <= 1}
        if len(near) == 1:
            return near.pop()
    return None


def _postcode(m: re.Match) -> str | None:
    if not re.search(r"\d", m[2]) or not re.search(r"[a-z]", m[5]) or m[1] in ("no", "to"):
        return None
    area = m[1].translate(_OCR_LETTERS)
    inward = m[5].translate(_OCR_LETTERS)
    return area + m[2].translate(_OCR_DIGITS) + m[3] + m[4].translate(_OCR_DIGITS) + inward


def parse(text: str | None) -> Address | None:
    """The parts of an address; None for null, blank and filler texts, and for texts without a street."""
    if not text:
        return None
    s = re.sub(" {2,}", " ", text.translate(_DASHES).lower()).strip()
    if FILLER.fullmatch(s):
        return None
    postcode = ""
    for m in _POSTCODE.finditer(s):
        if p := _postcode(m):
            postcode = p
            s = s[: m.start()] + " , " + s[m.end() :]
            break
    s = re.sub(rf"(?<![a-z])(?:{COUNTRIES})(?![a-z])\.?", " , ", s)
    s = re.sub(r"[()\[\]{};|]", " , ", s)
    relation, before = "", ""
    for part in re.finditer(r"[^,]+", s):  # the relation may stand after a place that comes first
        m = _RELATION.match(s, part.start())
        if m:
            relation = "rear" if m["rear"] else "beside"
            s = s[: part.start()] + " " + s[m.end() :]
            break
        if m := _LEAD.match(s, part.start()):
            s = s[: part.start()] + " " + s[m.end() :]
            break
    if not relation and (m := re.search(rf"\bland\b[\s,]*(?:(?P<rear>{REAR})|(?P<beside>{BESIDE}))(?![a-z])\.?", s)):
        relation = "rear" if m["rear"] else "beside"
        s = s[: m.start()] + " , " + s[m.end() :]
    flat = ""
    if m := _FLAT.search(s):
        flat = re.sub(r"\s", "", m[1]).lstrip("0") or "0"
        s = s[: m.start()] + " , " + s[m.end() :]
    number = ""
    if m := _RANGE.search(s):
        number = f"{int(m[1])}{m[2] or ''}-{int(m[3])}{m[4] or ''}"
    elif m := _NUMBER.search(s):
        number = f"{int(m[1].translate(_OCR_DIGITS))}{m[2] or ''}"
    if m:
        s = s[: m.start()] + " # " + s[m.end() :]
    words: list[str] = []  # "," between segments, "#" where the number was
    for token in re.findall(r"[^\W_][\w'-]*|[,#]", s):
        token = token.replace("'", "")
        words.append(token if token in ",#" else token.strip("-"))
    roles = [None if w in ",#" else _role(w) for w in words]
    best = None
    for i, role in enumerate(roles):
        if role and role[1] == "t" and i and words[i - 1] not in ",#" and words[i - 1] not in ("no", "nos"):
            start = i - 1
            while start and words[start - 1] not in ",#" and i - start < 4 and (roles[start - 1] is None or roles[start - 1][1] != "a"):
                start -= 1
            after_type = i + 1 < len(words) and roles[i + 1] and roles[i + 1][1] == "t" and words[i + 1] not in ",#"
            weight = (not after_type, role[0] not in LETTER_TYPES, words[start - 1] == "#" if start else False, -i)
            if best is None or weight > best[0]:
                best = (weight, start, i)
    if best is None:
        return None
    _, start, at = best
    name = words[start:at]
    # Words in front of the name proper: at most one that belongs to it, such as "upper"; others are places or a house.
    first = next((k for k in range(len(name)) if roles[start + k] and roles[start + k][1] == "b"), None)
    lead_words = name[:first] if first else []
    name = name[first:] if first else name
    if first is None and len(name) > 2 and not (start and words[start - 1] == "#"):
        lead_words, name = name[:-1], name[-1:]
    end, side = at + 1, ""
    k = end
    while k < len(words) and words[k] in "," and k - end < 1:
        k += 1
    if k < len(words) and words[k] not in ",#" and roles[k] and roles[k][1] == "a":
        side, end = roles[k][0], k + 1
    prefix = ""
    if first is not None and len(name) > 1:
        prefix, name = roles[start + first][0], name[1:]
    spelt = "".join(w.translate(_OCR_LETTERS) for w in name)
    segments: list[list[str]] = [[]]
    for w in words[:start]:
        if w in ",#":
            segments.append([])
        else:
            segments[-1].append(w)
    segments.append(list(lead_words))
    lead = [" ".join(x for x in seg if x not in ("no", "nos", "the") or len(seg) > 1) for seg in segments if seg and seg not in (["no"], ["nos"])]
    places = [w for w in words[end:] if w not in ",#" and w not in ("no", "nos") and len(w) > 2]
    unit = f"{relation}/{flat}/{number}"
    return Address(unit, f"{spelt}|{roles[at][0]}|{side}|{prefix}", lead, places, postcode)
