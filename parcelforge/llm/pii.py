"""Personal data in free text: overlapping candidate spans, scored by boosted trees, the best ones redacted."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelforge.engine import spread
from parcelforge.llm.boosting import Trees, best_threshold
from parcelforge.llm.pii_sample import FAMILIES, labelled

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
TRAINING_SENTENCES = 9000  # bound of the labelled sample
SEED = 11
HOUSE_WORDS = 5  # words that a house's name before its street has at most

# Words by which names, streets and places are told apart, full and as abbreviated.
STREETS = """avenue ave av bank close clo cl court crt ct crescent cresc cres cr drive drv dr gardens gdns gdn garden grove grv gro gr
green hill hl lane ln la mews ms parade pde place plc pl road rd row rw square sq sqr street str st terrace terr ter tce way wy walk rise view yard"""
TITLES = "mr mrs miss ms mx dr rev cllr prof sir lady lord dame"
FIRMS = "ltd limited llp plc sons daughters partners brothers company co inc trading holdings services council"
BUILDINGS = "house hall memorial church chapel school library hotel inn centre estate cottage lodge farm court tower mill barn works hospital station"
MONTHS = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday"
GIVEN = """adam agnes aisha alan alexander alice amanda amy andrew angela anita ann anna anne anthony antoni arthur barbara ben brian carol caroline catherine charles charlotte christine christopher
claire clare colin daniel david dawn deborah denise derek diana donna dorothy dylan edward eleanor elizabeth emily emma eric ewa fatima fiona frances frank fred gareth gary geoffrey george gillian gordon grace graham
hannah harold harry hassan heather helen henry hilary hugh ian imran irene jack jacqueline james jane janet jean jennifer jeremy joan joanne john jonathan joseph joyce judith julia julie karen kate katherine kathleen keith kenneth kevin
krzysztof laura lauren lee leslie linda lisa louise lucy luke margaret maria marie marion mark martin mary matthew maureen megan michael mohammed muhammad nadia natalie neil nicholas nicola nigel olivia omar owen pamela patricia paul pauline
peter philip piotr priya rachel raymond rebecca rhys richard robert roger ronald rose roy ruth sally samantha samuel sandra sarah sharon sheila simon sophie stephen steven stuart susan teresa thomas tomasz victoria wendy william zofia"""
COMMON = """a about across after all also am an and any are area as asked at bank be been before behind bill both box but by call card case cent charge claim code committee copy could date dear did do does down each east
every field for form from further given good grid had has have he her here his how i if in into invoice is it item its land left letter like line list made many map may me meeting members meter more my near new next no north not
note number of off office old on one only or order other our out over page part per plan plot point price proposed quote reason ref reference report right road route sale said schedule section see sent set she sheet should side site so some south
staff still stock table take than thank thanks that the their them then there these they this those to total town two under unit until up us use was we were west what when where which while who will with within works would year you your"""

STOPS = "a all an and any as at both but by each every for from he her his i if in is it its my no not of on or our she that the their these they this those to was we were when where which who with you your"

_OCR = str.maketrans({"0": "o", "5": "s", "1": "l", "8": "b", "|": "l"})
_SPACES = dict.fromkeys([*range(9), *range(9, 33), 0x7F, *range(0x80, 0xA1), 0xAD, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF], " ")
_SPACES |= dict.fromkeys([*range(0x2E80, 0x3000), *range(0x3001, 0xA4D0), *range(0xAC00, 0xD7B0), *range(0xF900, 0xFB00), *range(0xFF00, 0xFF0F)], "|")  # scripts without spaces: their letters end a word of other scripts


def _flat(text: str) -> str:
    """The text with every white or control character as a space, and letters of scripts without spaces as marks, at the same offsets."""
    return text.translate(_SPACES)


def _words(s: str) -> list[str]:
    return s.split()


_STREET = "|".join(sorted((re.sub("[sobl]", lambda m: {"s": "[s5]", "o": "[o0]", "b": "[b8]", "l": "[l1|]"}[m.group()], w) for w in _words(STREETS)), key=len, reverse=True))
_TITLE = "|".join(_words(TITLES))
_UPPER = "".join(c for c in map(chr, range(0x530)) if c.isupper())  # capitals of the Latin, Greek and Cyrillic scripts
_W = r"[^\W\d_][\w'’]+(?:-[^\W\d_][\w'’]+)?"  # a word, double-barrelled or not
_CAP = rf"[{_UPPER}][\w'’]*(?:-[{_UPPER}0-9][\w'’]*)?"
_D = r"[0-9oli]"

# All patterns run on the text in lower case (same offsets); PLAIN, TURNED and INITIALS on the text as it is.
_USER = r"(?<![\w.+%-])[a-z0-9][a-z0-9._%+-]*"
EMAIL = re.compile(rf"{_USER} {{0,2}}(?:@|\(at\)|\[at\]|\{{at\}}| \[at\]) {{0,2}}[a-z0-9][a-z0-9-]*(?:(?:\.|\(dot\)|\[dot\]| dot | \[dot\] | \(dot\) )[a-z0-9-]+)+(?![\w@])")
EMAIL_WORDS = re.compile(rf"{_USER} at [a-z0-9][a-z0-9-]*(?:(?: dot | ?\(dot\) ?| ?\[dot\] ?)[a-z0-9-]+)+(?![\w@])")
PHONE = re.compile(rf"(?<![\w/.@+-])(?:\+|\()?{_D}(?:[ ().\-]{{0,3}}{_D}){{8,14}}(?![\w@])")
NATIONAL = re.compile(rf"(?<![\w/-])[a-z]{{2}}[ \-.]{{0,2}}(?:{_D}{{2}}[ \-.]{{0,2}}){{3}}[a-d8](?![\w])")
HEALTH = re.compile(rf"(?<![\w/+.@-]){_D}{{3}}[ \-]{{0,2}}{_D}{{3}}[ \-]{{0,2}}{_D}{{4}}(?![\w@/])")
_HOUSE = r"(?=[oli]*[0-9])[0-9oli]+(?![0-9oli])"
_ROAD_WORD = r"(?:[^\W\d_]{1,3}\. {0,2}|[^\W\d_][\w'’-]* {1,2})"
_ENDS = rf"(?:{_STREET})(?![\w'’])\.?(?: {{1,2}}(?:{_STREET})(?![\w'’])\.?)*"
NUMBERED = re.compile(
    rf"(?<![\w/.\-£])(?:(?:flat|flt|apt|apartment|unit|room|suite)\.?,? {{1,2}}(?:no\.? {{0,2}})?\d+ ?[a-z]?,? {{1,3}}(?:{_ROAD_WORD}{{1,{HOUSE_WORDS - 1}}}{_W}, {{1,3}}|{_W}, {{1,3}})?)?"
    rf"(?:(?:no|nos|number)\.? {{1,2}})?{_HOUSE} ?(?:[a-z](?![a-z]))?(?: ?[-–/&] ?{_HOUSE}(?:[a-z](?![a-z]))?)?,? {{1,3}}(?:{_ROAD_WORD})+?{_ENDS}")  # fmt: skip
NAMED = re.compile(rf"(?<![\w'’-])(?=((?:{_W} {{1,2}}){{0,{HOUSE_WORDS - 1}}}{_W}) ?, {{1,3}}((?:{_ROAD_WORD})+?{_ENDS}))")
TITLED = re.compile(rf"(?<![\w'’-])(?:mr\.? {{1,2}}(?:and|&) {{1,2}}mrs\.? {{1,2}}(?:[a-z]\.? {{1,2}})?{_W}|(?:{_TITLE})\.? {{1,2}}(?:(?:[a-z]\.? {{1,2}}|[a-z]\. ?){{0,3}}(?:{_W} {{1,2}}(?:[a-z]\.? {{1,2}})?)?){_W})(?![\w'’])")
INITIALS = re.compile(rf"(?<![\w'’.-])(?:[{_UPPER}](?:\. {{0,2}}| {{1,2}})){{1,3}}{_CAP}(?![\w'’])")
PLAIN = re.compile(rf"(?<![\w'’-]){_CAP} {{1,2}}(?:[{_UPPER}]\.? {{1,2}}){{0,2}}{_CAP}(?![\w'’])")
TURNED = re.compile(rf"(?<![\w'’-]){_CAP}, {{1,2}}{_CAP}(?: [{_UPPER}]\.)?(?![\w'’])")
#: Two words in any case, with initials between them or not; those with a common word, or one of streets, firms and the like, are no name.
TWO_WORDS = re.compile(rf"(?<![\w'’.@-])(?={_W} {{1,2}}(?:[a-z]\.? {{1,2}})?{_W}(?![\w'’@]))({_W}) {{1,2}}(?:[a-z]\.? {{1,2}})?({_W})")
#: Where a name may begin whatever its case: after a mark, or a word that people are named after.
OPENS = re.compile(r"(?:[^\w\s]|^|\b(?:dear|hello|hi|signed|sworn|witness|witnessed|by|with|to|from|of|for|ask|and|met|contact|called|rang|owner|tenant|occupier|claimant|applicant|patient|employee|customer|driver|name|madame|pan|frau|annwyl|at|ar)) {0,3}\Z")

#: Words looked for beside a span.
LEFT = _words(
    """call calls called tel telephone mobile phone fax ring rang contact number no nos ref reference insurance ni health national nhs patient claimant applicant tenant employee customer driver name surname full
    dear hello hi by to with from of at and witness witnessed signed sworn regards sincerely truly wishes owner occupier a we i the lives live lived resident address works deliver letter
    north south east west behind opposite beside near off between junction corner along towards onto across via plot unit drawing sheet item page plan invoice order account charge case file bank id uprn code isbn version serial meter part batch lot card membership
    rev revision issue type class grade figure vat score section clause condition route bus box line field metres yards miles feet trees flats about email e-mail e-bost mail write copy cc subject re display fee paid for on in is was said told met thanks present chair between until then annwyl cher madame pan gywir cordialement
    ffoniwch rhif numéro ar tan mae vote hours staff support reply 9 : = - / ( > < ; . , | "'"""
)
RIGHT = _words(
    """p ext extension page and who lives lived said told wrote rang called met took spoke moved swore proposed paid asked i is was were has had of at in on from by to or for with then when be works side memorial house hall road near fax
    ltd limited plc & sons daughters partners brothers mobile tel each per cent metres miles km m kg off years pages expires reads replaces rev dated 9 / ( < : = ; , - . | "'"""
)
_LEFT, _RIGHT = {w: i for i, w in enumerate(LEFT, 2)}, {w: i for i, w in enumerate(RIGHT, 2)}
_TOKEN = re.compile(r"[^\W\d_][\w'’-]*|[^\w\s]|\d+")
_SET = {name: frozenset(_words(text)) for name, text in (("street", STREETS), ("building", BUILDINGS), ("firm", FIRMS), ("common", COMMON), ("title", TITLES), ("month", MONTHS), ("given", GIVEN))}
#: What a word is, as bits in the order of _SET.
_KIND = {w: sum(1 << i for i, words in enumerate(_SET.values()) if w in words) for w in frozenset().union(*_SET.values())}
_STREET_BIT, _BUILDING_BIT, _FIRM_BIT, _COMMON_BIT, _TITLE_BIT, _MONTH_BIT, _GIVEN_BIT = (1 << i for i in range(7))
_STOPS = frozenset(_words(STOPS))  # words that no name begins with
_NO_NAME = _STREET_BIT | _FIRM_BIT | _COMMON_BIT | _TITLE_BIT


def _lower(t: str) -> str:
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


def _kind(word: str) -> int:
    return _KIND.get(word) or _KIND.get(word.translate(_OCR), 0)


def candidates(t: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, generator) of every span of a flat text that may be personal data; spans overlap freely."""
    low = _lower(t)
    out: list[tuple[str, int, int, str]] = []
    if "@" in low or "at)" in low or "at]" in low or "at}" in low:
        out += [("email", m.start(), m.end(), "e") for m in EMAIL.finditer(low)]
    if "dot" in low:
        out += [("email", m.start(), m.end(), "e") for m in EMAIL_WORDS.finditer(low)]
    out += [("phone", m.start(), m.end(), "p") for m in PHONE.finditer(low)]
    out += [("id_number", m.start(), m.end(), "n") for m in NATIONAL.finditer(low)]
    out += [("id_number", m.start(), m.end(), "h") for m in HEALTH.finditer(low)]
    out += [("street_address", m.start(), m.end(), "s") for m in NUMBERED.finditer(low)]
    begun: set[int] = set()
    for m in NAMED.finditer(low):
        for y in (m.start(1), *(m.start(1) + x.end() for x in re.finditer(" +", m.group(1)))):
            if y not in begun:
                begun.add(y)
                out.append(("street_address", y, m.end(2), "d"))
    names: dict[tuple[int, int], str] = {}
    for m in TITLED.finditer(low):
        names[m.span()] = "t"
        if m.group().count(" ") > 1 and "and" not in m.group() and "&" not in m.group():
            names.setdefault((m.start(), m.start() + len(m.group().rpartition(" ")[0].rstrip())), "t")
    for m in INITIALS.finditer(t):
        names.setdefault(m.span(), "i")
    for rx, how in ((PLAIN, "w"), (TURNED, "c")):
        at = 0
        while m := rx.search(t, at):  # overlapping: the next search begins after the first word
            first = m.group().split(" ", 1)[0].rstrip(",").lower()
            if first not in _STOPS:
                names.setdefault(m.span(), how)
            at = t.find(" ", m.start())
    at = 0
    while m := TWO_WORDS.search(low, at):
        first, last = m.group(1), m.group(2)
        one_case = t[m.start()].isupper() == t[m.start(2)].isupper()  # a name has capitals throughout or none
        if one_case and not (_kind(first) | _kind(last)) & _NO_NAME and m.span() not in names and (_kind(first) & _GIVEN_BIT or OPENS.search(low, max(0, m.start() - 14), m.start())):
            names[m.span()] = "u"
        at = m.end(1)
    out += [("person_name", s, e, how) for (s, e), how in names.items()]
    return out


def _check_digit(digits: str) -> bool:
    if len(digits) != 10:
        return False
    total = sum(int(d) * w for d, w in zip(digits, range(10, 1, -1)))
    return (11 - total % 11) % 11 == int(digits[9])


_DIGITS = str.maketrans("OolI", "0011")
_NO_DIGIT = re.compile(r"[^0-9]+")
_AREA_CODES = ("07", "01", "02", "03", "08", "44", "0044")
_OPENERS = frozenset(("and", "or", "mrs", "flat", "flt", "apt", "apartment", "the", "no"))
_HOW = {c: i for i, c in enumerate("epnhsdtiwcu")}


def _code(vocabulary: dict[str, int], token: str) -> int:
    if token[0].isdigit():
        return vocabulary["9"]
    return vocabulary.get(token) or vocabulary.get(token.translate(_OCR), 1)


def _shape(token: str) -> int:
    """0 nothing, 1 a mark, 2 digits, 3 lower case, 4 capitals, 5 a capital first."""
    if not token:
        return 0
    if token[0].isdigit():
        return 2
    if not token[0].isalpha():
        return 1
    return 3 if not token[0].isupper() else 4 if len(token) > 1 and token.isupper() else 5


def _ending(word: str) -> int:
    """The class of a word's ending: those that English nouns, verbs and adjectives have and names seldom."""
    return 1 if word.endswith("ing") else 2 if word.endswith("ed") else 3 if word.endswith(("ly", "ness", "ment", "tion", "ity")) else 4 if word.endswith(("al", "ive", "ous", "able", "ary")) else 5 if word.endswith("s") else 0


def features(text: str, raw: str, kind: str, start: int, end: int, how: str) -> list[int]:
    """Format and context of a span of a flat text (raw: the text as it was), as numbers from 0 to 255."""
    span = text[start:end]
    low = span.lower()
    left, right = _TOKEN.findall(text[max(0, start - 32) : start])[:-5:-1], _TOKEN.findall(text[end : end + 24])[:2]
    left += [""] * (4 - len(left))
    right += [""] * (2 - len(right))
    before, after = [t.lower() for t in left], [t.lower() for t in right]
    words = [w.strip(".,()") for w in low.split()]
    digits = _NO_DIGIT.sub("", span.translate(_DIGITS))
    bits = [_kind(w) for w in words]
    sizes = [len(w) for w in words] or [0]
    count = [0] * 7
    for b in bits:
        if b:
            for i in range(7):
                count[i] += b >> i & 1
    first, last = (words[0], words[-1]) if words else ("", "")
    first_bits, last_bits = (bits[0], bits[-1]) if bits else (0, 0)
    next_bits, prev_bits = _kind(after[0]), _kind(before[0])
    label = low.rpartition(".")[2]
    own = span.split()
    house = low.partition(",")[0].split() if kind == "street_address" else []
    return [
        _HOW[how], min(end - start, 255), min(len(words), 255), min(len(digits), 255), *(_code(_LEFT, t) if t else 0 for t in before), *(_code(_RIGHT, t) if t else 0 for t in after),
        _shape(left[0]), _shape(left[1]), _shape(right[0]), span.isupper(), span == low, ord(text[start - 1]) & 127 if start else 0, ord(text[end]) & 127 if end < len(text) else 0,
        start == 0 or raw[start - 1] in "\r\n", end == len(raw) or raw[end] in "\r\n",
        int(digits[:1] or 10), int(digits[:2] or 100), _check_digit(digits), min(span.count(".") + span.count("-"), 255), min(span.count(" "), 255), span[:1] in "+(", digits.startswith(_AREA_CODES),
        min(span.count(","), 255), *count, first_bits & 127, last_bits & 127, next_bits & 127, prev_bits & 127, min(sizes.count(1), 255),
        _LEFT.get(first.strip(":;"), 0), _LEFT.get(last, 0) if len(words) > 1 else 0, min(min(sizes), 255), min(max(sizes), 255), first in _OPENERS, label.isalpha() and len(label) > 1,
        _shape(own[0]) if own else 0, _shape(own[-1]) if own else 0, min(sum(w[0].islower() for w in own), 255), _ending(first), _ending(last), digits.startswith("999"),
        min(len(house), 255), _kind(house[-1]) & 127 if house else 0,
    ]


def sample(sentences: int, seed: int, families: list[str] | None = None) -> list[tuple[str, set[tuple[str, int]]]]:
    """So many labelled texts of the families: text and (kind, start) of what is personal in it."""
    rng = random.Random(seed)
    given = [w.capitalize() for w in _words(GIVEN)]
    return [labelled(rng, given, families or list(FAMILIES)) for _ in range(sentences)]


def training_set(sentences: int, seed: int, families: list[str] | None = None):
    """Features and labels of all candidates in a sample of labelled texts of the families, by kind."""
    rows = {k: ([], []) for k in KINDS}
    for text, labels in sample(sentences, seed, families):
        flat = _flat(text)
        for kind, s, e, how in candidates(flat):
            rows[kind][0].append(features(flat, text, kind, s, e, how))
            rows[kind][1].append((kind, s) in labels)
    return {k: (np.array(x, np.int64).reshape(len(x), -1), np.array(y, float)) for k, (x, y) in rows.items()}


@lru_cache(maxsize=2)
def fitted(sentences: int = TRAINING_SENTENCES, seed: int = SEED, families: tuple[str, ...] = tuple(FAMILIES)) -> dict[str, tuple[Trees, float]]:
    """Per kind: the trees, fitted on three quarters of the sample, and the threshold, calibrated on the rest."""
    fit, held = training_set(sentences * 3 // 4, seed, list(families)), training_set(sentences // 4, seed + 1, list(families))
    out = {}
    for kind in KINDS:
        trees = Trees().fit(*fit[kind]).calibrate(*held[kind])
        out[kind] = trees, best_threshold(trees.probability(held[kind][0]), held[kind][1])
    return out


def select(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of overlapping spans the most probable (names to a tenth: `A. Bell` lies in `Carol A. Bell`), then the longest, then the first; in the order of the text."""
    taken: list[tuple[str, int, int, float]] = []
    busy: set[int] = set()
    for s in sorted(spans, key=lambda s: (-round(s[3], 1 if s[0] == "person_name" else 2), s[1] - s[2], s[1], s[0])):
        if busy.isdisjoint(range(s[1], s[2])):
            taken.append(s)
            busy.update(range(s[1], s[2]))
    return sorted(taken, key=lambda s: s[1])


def find(texts: list[str | None], model: dict[str, tuple[Trees, float]]) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, probability) of the personal data in each text; all candidates of all texts are scored at once."""
    rows = {k: ([], []) for k in KINDS}
    for n, text in enumerate(texts):
        if text:
            flat = _flat(text)
            for kind, s, e, how in candidates(flat):
                rows[kind][0].append(features(flat, text, kind, s, e, how))
                rows[kind][1].append((n, s, e))
    spans: list[list] = [[] for _ in texts]
    for kind, (x, at) in rows.items():
        if x:
            trees, least = model[kind]
            for (n, s, e), p in zip(at, trees.probability(np.array(x, np.int64))):
                if p >= least:
                    spans[n].append((kind, s, e, float(p)))
    return [select(s) for s in spans]


SPANS = T.StructType([T.StructField("pii_kind", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType()), T.StructField("probability", T.DoubleType())])


def _scan(df: DataFrame, id_col: str, text_col: str, schema: str, rows):
    import pyarrow as pa

    model = df.sparkSession.sparkContext.broadcast(fitted())  # under 1 MB, whatever the data
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield rows(pa, part.column(0), part.column(1).to_pylist(), model.value)

    return spread(df.select(f"`{id_col}`", f"`{text_col}`")).mapInArrow(run, f"_id {kind}, {schema}").withColumnRenamed("_id", id_col)


def personal_data(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pii_kind, start_pos, end_pos, probability), one row per occurrence; offsets count code points from 0.

    Each text is scanned whole, where its row lies. Null, empty and blank texts have no rows.
    """

    def rows(pa, ids, texts, model):
        found = find(texts, model)
        at = [n for n, spans in enumerate(found) for _ in spans]
        flat = [s for spans in found for s in spans]
        cols = list(zip(*flat)) if flat else [[], [], [], []]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], ["_id", "pii_kind", "start_pos", "end_pos", "probability"])

    return _scan(df, id_col, text_col, "pii_kind string, start_pos bigint, end_pos bigint, probability double", rows)


def redacted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with [EMAIL], [PHONE], [ID_NUMBER], [STREET_ADDRESS] or [PERSON_NAME] in place of each occurrence; null stays null."""

    def rows(pa, ids, texts, model):
        out = []
        for text, spans in zip(texts, find(texts, model)):
            for kind, s, e, _ in reversed(spans):
                text = f"{text[:s]}[{kind.upper()}]{text[e:]}"
            out.append(text)
        return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], ["_id", "text"])

    return _scan(df, id_col, text_col, "text string", rows)
