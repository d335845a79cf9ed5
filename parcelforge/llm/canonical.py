"""Free-entered names mapped to the entries of a reference list by a BK-tree."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.engine import cut, spread
from parcelforge.operators.skew import lookup

RADIUS = 2  # edits (insert, delete, replace) within which the tree returns every entry; two neighbours swapped are two
SHARD = 50_000  # entries of the reference that one broadcast tree holds at most
TOGETHER = 40_000  # values that go down the tree together
WORD_BITS = 64  # characters of a word whose distances fit in one machine number
REMEMBERED = 1 << 17  # values whose answer a worker keeps

# Abbreviations of street words, and words that only say where at a street something is.
STREET_WORDS = {
    "avenue": "ave av", "close": "cl clo", "court": "ct crt", "crescent": "cres cresc cr", "drive": "dr drv", "gardens": "gdns gdn garden", "grove": "gr gro grv",
    "hill": "hl", "lane": "ln la", "mews": "ms", "parade": "pde", "place": "pl plc", "road": "rd", "row": "rw", "square": "sq sqr", "street": "st str",
    "terrace": "ter terr tce", "way": "wy", "north": "n nth", "south": "s sth", "east": "e", "west": "w", "little": "lt ltl", "great": "gt grt", "upper": "upr", "lower": "lwr",
    "recreation": "rec", "saint": "snt", "school": "sch", "primary": "prim pri", "nature": "nat", "business": "bus", "pavilion": "pav", "sports": "spts", "ground": "grd", "park": "pk",
}
AROUND = set("off at on to of the land site near nr adj adjacent rear r o part junction jct jn corner between and in by from side opp opposite behind beside fronting next plot no nos house flat".split())

_FULL = {a: full for full, short in STREET_WORDS.items() for a in short.split()}
_SIDES = ("north", "south", "east", "west")
_FRONT = ("great", "little", "upper", "lower", "old", "new")
_TYPES = [w for w in list(STREET_WORDS)[: list(STREET_WORDS).index("north")]]
_DIGITS = str.maketrans("01589|", "olsbgl")
_GLUED = sorted((a for a, full in _FULL.items() if len(a) > 1 and full in _TYPES), key=len, reverse=True)
_CUT = {w[:n]: w for w in _TYPES for n in range(3, len(w)) if sum(t.startswith(w[:n]) for t in _TYPES) == 1 and w[:n] not in _FULL and w[:n] not in _TYPES}


def fold(compact: str) -> list[str]:
    """A key and, if it differs, the key in which pairs that scanners read as one letter are that letter; i, j and l are one throughout."""
    plain = compact.replace("i", "l").replace("j", "l")
    joined = plain.replace("rn", "m").replace("vv", "w")
    return [plain] if joined == plain else [plain, joined]


def tokens(text: str) -> list[str]:
    """Words in lower case, with digits inside words read as the letters they stand for and abbreviations written out."""
    out = []
    for w in re.findall(r"[^\W_]+", re.sub(r"['’`]", "", text.lower())):
        if re.fullmatch(r"\d+[a-z]?", w):
            out.append("c" if w == "0" else w)
            continue
        w = w.translate(_DIGITS)
        out.append(_FULL.get(w, _CUT.get(w, w) if out else w))
    return out


def keys_of(text: str) -> list[str]:
    """The keys under which a reference name is filed."""
    return fold("".join(tokens(text)))


def stem(text: str) -> str:
    """A street's name without its type, side and a word before it; empty for what isn't a street."""
    words = tokens(text)
    if words and words[-1] in _SIDES:
        words = words[:-1]
    if len(words) < 2 or words[-1] not in _TYPES:
        return ""
    words = words[:-1]
    return "".join(words[1:] if len(words) > 1 and words[0] in _FRONT else words)


def readings(text: str) -> list[tuple[str, int]]:
    """(key, rank) of what a value may name: all of it, without words and numbers around it, or its street alone; in order of preference."""
    out: dict[str, int] = {}

    def put(joined: str, rank: int) -> None:
        for k in fold(joined):
            out.setdefault(k, rank)

    def add(words: list[str], rank: int) -> None:
        if not words or sum(map(len, words)) < 4:
            return
        joined = "".join(words)
        heads = [joined]
        if words[0] not in _FRONT:
            heads += [full + joined[len(a) :] for a, full in (("gt", "great"), ("lt", "little"), ("upr", "upper"), ("lwr", "lower")) if joined.startswith(a)]
        for head in heads:
            put(head, rank)
            if words[-1] not in _TYPES and words[-1] not in _SIDES:
                for a in _GLUED:  # a street word written on to the name
                    if head.endswith(a) and len(head) > len(a) + 3:
                        put(head[: -len(a)] + _FULL[a], rank)

    def bare(words: list[str]) -> list[str]:
        while words and (words[0] in AROUND or re.fullmatch(r"\d+[a-z]?", words[0])):
            words = words[1:]
        while len(words) > 1 and (words[-1] in AROUND or re.fullmatch(r"\d+[a-z]?", words[-1])):
            words = words[:-1]
        return words

    whole = tokens(text)
    add(whole, 0)
    add(bare(whole), 1)
    pieces = [bare(tokens(p)) for p in re.split(r"[,;/|()\[\]\n]| - ", text)]
    if len(pieces) > 1:
        streets = [p for p in pieces if set(p[1:]) & set(_TYPES)] or [p for p in pieces if len(p) == 1 and any(p[0].endswith(a) for a in (*_GLUED, *_TYPES))]
        for p in streets or pieces:  # a place named beside a street isn't what is meant
            add(p, 2)
    for words in [bare(whole), *pieces]:
        for i, w in enumerate(words):
            if w in _TYPES and i:
                end = i + 2 if i + 1 < len(words) and words[i + 1] in _SIDES else i + 1
                add(words[:end], 3)
                add(bare(words[:end])[-3:], 4)
    return list(out.items())


def osa(a: str, b: str, most: int = 3) -> int:
    """Edits with a swap of neighbours as one."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, last = last, row
    return last[-1]


_CODES = np.full(1 << 16, 37, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789", 1):
    _CODES[ord(_c)] = _i


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.zeros((max(1, int(lengths.max(initial=0))), len(words)), np.int16)  # a row for each place in a word
    for i, w in enumerate(words):
        codes[: len(w), i] = _CODES[np.minimum(np.fromiter(map(ord, w), np.int64, len(w)), 65535)]
    return codes, lengths


def distances(word: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Levenshtein distance of a word to many, column by column with the differences of a column in the bits of a number.

    Characters outside a-z and 0-9 count as one. The word may have up to WORD_BITS characters.
    """
    one = np.uint64(1)
    m = len(word)
    peq = np.zeros(38, np.uint64)
    for i, c in enumerate(word):
        peq[_CODES[min(ord(c), 65535)]] |= one << np.uint64(i)
    n = len(lengths)
    vp, vn = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score, top = np.full(n, m, np.int64), np.uint64(m - 1)
    for j in range(int(lengths.max(initial=0))):
        eq = peq[codes[j]]
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp)
        hn = vp & xh
        score += (((hp >> top) & one).astype(np.int8) - ((hn >> top) & one).astype(np.int8)) * (j < lengths)
        hp = (hp << one) | one
        hn = hn << one
        vp = hn | ~(xv | hp)
        vn = hp & xv
    return score


def long_distance(a: str, b: str) -> int:
    """As distances(), for one pair of words of any length: the same columns in numbers of any size."""
    peq = [0] * 38
    for i, c in enumerate(a):
        peq[_CODES[min(ord(c), 65535)]] |= 1 << i
    full = (1 << len(a)) - 1
    top = len(a) - 1
    vp, vn, score = full, 0, len(a)
    for c in b:
        eq = peq[_CODES[min(ord(c), 65535)]]
        xv = eq | vn
        xh = ((((eq & vp) + vp) ^ vp) | eq) & full
        hp = (vn | ~(xh | vp)) & full
        hn = vp & xh
        score += (hp >> top & 1) - (hn >> top & 1)
        hp, hn = (hp << 1 | 1) & full, hn << 1 & full
        vp, vn = (hn | ~(xv | hp)) & full, hp & xv
    return score


class _Tree:
    """One BK-tree: a child hangs at its distance from its parent. Words of up to WORD_BITS characters, or longer ones only."""

    def __init__(self, words: list[str]):
        self.words = words
        self.wide = max(map(len, words), default=0) > WORD_BITS
        self.children: list[dict[int, int]] = [{} for _ in words]
        lengths = np.array([len(w) for w in words], np.int64)
        self.short, self.long = lengths.copy(), lengths.copy()
        if words:
            self._grow(*self._coded(words), lengths)

    def _coded(self, words: list[str]):
        return (words, None) if self.wide else (words, _coded(words)[0])

    def _distances(self, node: int, words: list[str], codes, who: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.wide:
            return np.array([long_distance(self.words[node], words[i]) for i in who], np.int64)
        return distances(self.words[node], codes[: int(lengths[who].max(initial=0)), who], lengths[who])

    def _grow(self, words, codes, lengths) -> None:
        todo, order = [(0, np.arange(1, len(words)))], []
        while todo:
            node, below = todo.pop()
            order.append((node, below))
            if len(below):
                d = self._distances(node, words, codes, below, lengths)
                for k in np.unique(d):
                    part = below[d == k]
                    self.children[node][int(k)] = int(part[0])
                    todo.append((int(part[0]), part[1:]))
        for node, below in order:  # the lengths found in a subtree bound the distances, too
            if len(below):
                self.short[node] = min(self.short[node], lengths[below].min())
                self.long[node] = max(self.long[node], lengths[below].max())

    def search(self, queries: list[str], radius: int):
        """(place of the query, word, distance) of every word within the radius."""
        if not self.words:
            return
        lengths = np.array([len(q) for q in queries], np.int64)
        at = np.flatnonzero((lengths >= self.short[0] - radius) & (lengths <= self.long[0] + radius))  # before anything is laid out by length
        if not len(at):
            return
        words, codes = self._coded([queries[i] for i in at])
        lengths = lengths[at]
        todo = [(0, np.arange(len(at)))]
        while todo:
            node, who = todo.pop()
            who = who[(lengths[who] >= self.short[node] - radius) & (lengths[who] <= self.long[node] + radius)]
            if not len(who):
                continue
            d = self._distances(node, words, codes, who, lengths)
            for i in np.flatnonzero(d <= radius):
                yield int(at[who[i]]), self.words[node], int(d[i])
            for k, child in self.children[node].items():
                near = np.abs(d - k) <= radius
                if near.any():
                    todo.append((child, who[near]))


class BKTree:
    """Entries under Levenshtein distance, a true metric: one tree of those that fit a machine number, one of the longer ones."""

    def __init__(self, words: list[str]):
        own = list(dict.fromkeys(w for w in words if w))
        self.trees = [_Tree([w for w in own if len(w) <= WORD_BITS]), _Tree([w for w in own if len(w) > WORD_BITS])]

    def search(self, queries: list[str], radius: int = RADIUS) -> list[list[tuple[str, int]]]:
        """For each query every entry within the radius, with its distance. All queries go down the tree together; by the
        triangle inequality only children within radius of a query's own distance can hold what it looks for."""
        found: list[list[tuple[str, int]]] = [[] for _ in queries]
        for tree in self.trees:
            for i, word, d in tree.search(queries, radius):
                found[i].append((word, d))
        return found


def near_options(keys: list[str], tree: BKTree) -> dict[str, list[tuple[str, int, int]]]:
    """(entry, edits with a swap as one, edits) of the entries one edit or swap from each key of more than four letters;
    entries of fewer than six take none, as they would be other words."""
    keys = [k for k in keys if len(k) > 4]
    out = {}
    for k, near in zip(keys, tree.search(keys)):
        rows = [(entry, d if d < 2 else osa(k, entry), d) for entry, d in near if len(entry) >= 6]
        out[k] = [r for r in rows if r[1] <= 1]
    return out


class Matcher:
    """The entry that a value means, of a reference list (or a shard of it)."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.by_key: dict[str, tuple[str, str]] = {}
        for ref, name in sorted(entries):
            for k in keys_of(name):
                if k:
                    self.by_key.setdefault(k, (ref, name))
        stems: dict[str, list[tuple[str, str]]] = {}
        for entry in dict.fromkeys(self.by_key.values()):
            if bare := stem(entry[1]):
                stems.setdefault(bare, []).append(entry)
        single: dict[str, tuple[str, str]] = {}
        for bare, streets in stems.items():  # what only one street of the list is called names it without its type, too
            if len(streets) == 1:
                for k in fold(bare):
                    single[k] = min(single.get(k, streets[0]), streets[0])
        self.by_key = single | self.by_key
        self.tree = BKTree(list(self.by_key))
        self.known: dict[str, tuple[str, int]] = {}

    def _choose(self, options: list[tuple[int, int, int, str]]) -> tuple[str, int]:
        """Least cost wins; two entries of the same least cost are no answer unless a preferred reading tells them apart."""
        options.sort()
        cost = options[0][:2]
        best = {o[3] for o in options if o[:2] == cost}
        if len(best) > 1:
            least = options[0][:3]
            best = {o[3] for o in options if o[:3] == least}
        return (best.pop(), options[0][0]) if len(best) == 1 else ("", 99)

    def match(self, values: list[str | None]) -> list[tuple[str, int]]:
        """(reference id, cost) for each value; ("", 99) if none is meant. Nulls and blanks mean none."""
        out: list[tuple[str, int] | None] = [self.known.get(v) if v else ("", 99) for v in values]
        open_: dict[str, list[tuple[str, int]]] = {}
        for v, o in zip(values, out):
            if o is None and v not in open_:
                read = readings(v)
                exact = [(0, rank, 0, self.by_key[k][0]) for k, rank in read if k in self.by_key]
                if exact:
                    self.known[v] = self._choose(exact)
                else:
                    open_[v] = read
        near = near_options(list(dict.fromkeys(k for read in open_.values() for k, _ in read)), self.tree)
        for v, read in open_.items():
            options = [(edits, rank, d, self.by_key[entry][0]) for k, rank in read for entry, edits, d in near.get(k, ())]
            self.known[v] = self._choose(options) if options else ("", 99)
        out = [self.known[v] if o is None else o for v, o in zip(values, out)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return out


def _chunks(batches, rows: int):
    """Batches in lists of about so many rows: the more values go down the tree together, the less each costs."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


@lru_cache(maxsize=4)
def _matcher(entries: tuple[tuple[str, str], ...]) -> Matcher:
    return Matcher(list(entries))


def _readings(values: DataFrame) -> DataFrame:
    """(value, key, rank) of distinct values."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(v, k, rank) for v in batch.column(0).to_pylist() for k, rank in readings(v)]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32()))], ["value", "key", "rank"])

    return values.mapInArrow(run, "value string, key string, rank int")


def _key_table(names: DataFrame) -> DataFrame:
    """(key, id), stored: what Matcher files under each key, made of (id, name) without bringing them together."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(k, i, name, stem(name), fold(stem(name)) if stem(name) else []) for i, name in zip(*(batch.column(c).to_pylist() for c in (0, 1))) for k in keys_of(name) if k]
            cols = list(zip(*rows)) if rows else [[] for _ in range(5)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["key", "id", "name", "stem", "stem_keys"])

    filed = names.mapInArrow(run, "key string, id string, name string, stem string, stem_keys array<string>")
    first = cut(filed.groupBy("key").agg(F.min(F.struct("id", "name", "stem", "stem_keys")).alias("e")), "keys")
    streets = first.select("e.*").where("stem <> ''").distinct()
    single = streets.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("id", "name", "stem_keys")).alias("e")).where("n = 1")
    single = single.select(F.explode("e.stem_keys").alias("key"), F.struct("e.id", "e.name").alias("e")).groupBy("key").agg(F.min("e").alias("e"))
    own = first.select("key", F.col("e.id").alias("id"))
    return cut(own.unionByName(single.join(own, "key", "left_anti").select("key", "e.id")), "key_table")


def _near(queries: DataFrame, keys: DataFrame, shard: int) -> DataFrame:
    """(key, id, edits, d) of the entries near each key, from shards of at most about `shard` entries.

    Entries are sharded by their length, then by hash, so that a query goes only to the shards whose lengths its radius
    reaches; each shard's tree answers its queries, in groups of bounded size, in one task.
    """
    import pyarrow as pa

    sized = keys.withColumn("size", F.length("key")).where("size >= 6")
    asked = queries.withColumn("size", F.length("key")).where("size > 4")
    parts = {r["size"]: -(-r["n"] // shard) for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    spark = keys.sparkSession
    plan = spark.createDataFrame([(size, n) for size, n in parts.items()], "at int, parts int")
    salts = max(1, -(-asked.count() // (8 * TOGETHER)))
    entries = sized.join(F.broadcast(plan), F.col("size") == F.col("at")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    entries = entries.select("at", "part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("key").alias("entry"), "id")
    wide = asked.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(salts)).cast("int")).withColumn("at", F.explode(F.sequence(F.col("size") - RADIUS, F.col("size") + RADIUS)))
    wide = wide.join(F.broadcast(plan), "at").select("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "salt", "key")

    def run(left, right):
        ids = dict(zip(right.column("entry").to_pylist(), right.column("id").to_pylist()))
        found = near_options(left.column("key").to_pylist(), BKTree(sorted(ids)))
        rows = [(k, ids[entry], edits, d) for k, options in found.items() for entry, edits, d in options]
        cols = list(zip(*rows)) if rows else [[] for _ in range(4)]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()))], ["key", "id", "edits", "d"])

    by = ["at", "part", "salt"]
    return wide.groupBy(*by).cogroup(entries.groupBy(*by)).applyInArrow(run, "key string, id string, edits int, d int")


def to_reference(values: DataFrame, value_col: str, reference: DataFrame, ref_id: str, ref_name: str, shard: int = SHARD) -> DataFrame:
    """values with `ref_id`: the id of the entry of reference that value_col means, or "" if none.

    A value means the entry whose key (see keys_of) is nearest to one of its readings, at most one edit or one swap away;
    equally near ones make it none. A street's name without its type stands for it if no other street of the list has
    it. Of entries with the same key the one with the least id stands. A null or blank value means none; every row of
    values comes out once, repeated ones as often as they came. Words of fewer than four letters are no reading, keys of
    fewer than five and entries of fewer than six letters are matched without edits only.

    A reference of up to `shard` entries, which is checked, is broadcast as one tree and every row is answered where it
    lies. A larger one is split into shards (_near), each with a tree of its own; distinct values are read once, their
    keys go to the shards they can reach, and what all shards offer is decided by the same rule: both ways give the same rows.
    """
    import pyarrow as pa

    spark = values.sparkSession
    names = reference.select(F.col(f"`{ref_id}`").cast("string").alias("id"), F.col(f"`{ref_name}`").cast("string").alias("name")).where("id is not null and name is not null")
    columns = values.columns
    if names.count() <= shard:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields), "_ref string"])
        place = columns.index(value_col)
        entries = spark.sparkContext.broadcast(tuple((r["id"], r["name"]) for r in names.collect()))

        def run(batches):
            matcher = _matcher(entries.value)
            for chunk in _chunks(batches, TOGETHER):
                got = iter(matcher.match([v for batch in chunk for v in batch.column(place).to_pylist()]))
                for batch in chunk:
                    own = [next(got)[0] for _ in range(batch.num_rows)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], [*columns, "_ref"])

        return spread(values).mapInArrow(run, schema).withColumnRenamed("_ref", "ref_id")
    keys = _key_table(names)
    read = cut(_readings(spread(values.select(F.col(f"`{value_col}`").alias("value")).where("value is not null").distinct())), "readings")
    exact = cut(lookup(read, keys, "key").select("value", F.lit(0).alias("edits"), "rank", F.lit(0).alias("d"), "id"), "exact")
    open_ = cut(read.join(exact.select("value").distinct(), "value", "left_anti"), "open")
    near = cut(_near(open_.select("key").distinct(), keys, shard), "near")
    options = exact.unionByName(open_.join(near, "key").select("value", "edits", "rank", "d", "id"))
    # _choose, by aggregates: the least cost, then, if it has several ids, the least distance at that cost.
    at_d = options.groupBy("value", "edits", "rank", "d").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    at_rank = at_d.groupBy("value", "edits", "rank").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by(F.struct("lo", "hi"), "d").alias("n"))
    best = at_rank.groupBy("value").agg(F.min_by(F.struct("lo", "hi", "n"), F.struct("edits", "rank")).alias("b"))
    answer = F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).when(F.col("b.n.lo") == F.col("b.n.hi"), F.col("b.n.lo")).otherwise(F.lit(""))
    chosen = cut(best.select(F.col("value").alias("_value"), answer.alias("_ref")), "chosen")
    out = lookup(values.withColumn("_value", F.col(f"`{value_col}`")), chosen, "_value", "left")
    return out.select(*[F.col(f"`{c}`") for c in columns], F.coalesce("_ref", F.lit("")).alias("ref_id"))
