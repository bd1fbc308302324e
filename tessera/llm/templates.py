"""Benchmark decontamination by template canonicalisation.

Texts become tokens (runs of letters, runs of digits; ASCII and Latin-1 capitals lower-cased). Numbers and number words turn into one
placeholder, units behind a number and names into others; neighbours of a kind count once. Windows of
``WINDOW`` canonical tokens of the benchmark items form a hash index, which all documents probe; an item shorter than
a window is one window of its own length. Windows of fewer than ``SHORTEST`` canonical tokens or with more slots than literals
cannot be told from chance and are not searched. An item left with no window (arithmetic, lists of names) is searched by its raw tokens instead, numbers and
names unmerged: a document that holds all of them in a row leaks it (``exact``). Only items of fewer than ``SHORTEST`` raw tokens are not searched.

A document leaks an item if aligned windows cover at least ``COVER`` of the item's windows and the slots are consistent:
each value of the item (a number, a name) stands for one value of the document throughout. Equal values make the leak
``exact``, others ``re-parameterised``.

The index is sent to the workers in parts of at most ``PART_ITEMS`` items, each part probed by one pass over the documents, so its size
is bounded whatever the benchmark's. Documents are never shuffled.

Null texts and empty items match nothing. Repeated documents are judged alike; repeated items are reported each; null ids stay null. Of
alignments of an item with as many windows, the earliest in the text is taken first. Very long texts are read whole, one block each. Empty
tables give an empty result. Documents' other columns, whatever their names, are not read by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import U64, Block, blocks, mix, powers

WINDOW, SHORTEST, COVER, PART_ITEMS = 8, 5, 0.5, 20_000

# Words that stand for a slot, in English, German, French and Spanish. Words that are articles too are left out.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig "
    "dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million milliarde halb dutzend "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille demi douzaine "
    "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil medio docena"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees volt volts watt watts meter meters metre metres kmh mph "
    "zoll fuß meile meilen gramm kilogramm kilo pfund tonne tonnen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
    "pouce pouces pied pieds gramme grammes livre livres tonnes seconde secondes heure heures jour jours semaine semaines mois an ans année années degré degrés mètre mètres "
    "pulgada pulgadas pie pies milla millas gramo gramos libra libras tonelada toneladas segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados metro metros litro litros"
).split()
FIRST_NAMES = (
    "alice bob carol dave emma frank grace henry jack james jane janet jason jim joe john jose julia karen kate kevin laura linda lisa "
    "maria mark mary michael mike nancy natalia olivia paul peter rachel robert sam sarah susan thomas tim tina tom william "
    "anna anja claudia dieter fritz hans heike ingrid jürgen karl klaus lena monika otto sabine stefan ursula wolfgang "
    "amélie camille chloé claire élise françois gérard hélène jacques jean léa louis luc marie mathieu nicolas pierre sophie "
    "alejandro ana carlos carmen diego elena javier juan lucía luis manuel miguel pablo pedro rosa sofía teresa"
).split()

_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS = _DIGIT.astype(np.uint8) + 2 * _LETTER.astype(np.uint8)
_STOP = np.zeros(256, bool)
_STOP[[*b".!?\n:"]] = True
_NUM, _UNIT, _NAME = (mix(np.array([x], U64))[0] for x in (1, 2, 3))
_STEP = np.random.Generator(np.random.PCG64(5)).integers(1, 2**62, 64, dtype=np.uint64) * U64(2) + U64(1)


def _known(words) -> np.ndarray:
    b = next(blocks(pa.array([" ".join(words)])))
    s, e, _ = b.words()
    return np.sort(b.hashes(s, e))


_NUMBERS, _UNIT_SET, _NAMES = _known(NUMBER_WORDS), _known(UNITS), _known(FIRST_NAMES)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def canonical(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each canonical token: code, its text's number, whether it is a slot, and the hash of its value; for each raw token: hash and its text's number."""
    data = block.data
    none = np.empty(0, U64)
    if not len(data):
        return none, np.empty(0, np.int64), np.empty(0, bool), none, none, np.empty(0, np.int64)
    low = data.copy()
    upper = (data >= 65) & (data <= 90)
    wide = np.zeros(len(data), bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[upper | wide] += 32
    kind = _CLASS[data]
    begin = kind > 0
    begin[1:] &= kind[1:] != kind[:-1]
    heads = block.offsets[:-1][np.diff(block.offsets) > 0]
    begin[heads] = kind[heads] > 0
    stop = kind > 0
    stop[:-1] &= kind[1:] != kind[:-1]
    tails = heads[1:] - 1
    stop[tails] = kind[tails] > 0
    stop[-1] = kind[-1] > 0
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(starts):
        return none, np.empty(0, np.int64), np.empty(0, bool), none, none, np.empty(0, np.int64)
    owner = np.searchsorted(block.offsets, starts, "right") - 1
    value = Block(low, block.offsets, 0).hashes(starts, ends)
    same = np.zeros(len(starts), bool)  # as the token before: the same text
    same[1:] = owner[1:] == owner[:-1]
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    opening = ~same
    opening[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    number = _DIGIT[data[starts]] | _among(value, _NUMBERS)
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & same[1:] & _among(value[1:], _UNIT_SET)
    # Capitals where a character starts; a name has one, and none behind it.
    is_up = upper.copy()
    is_up[:-1] |= wide[1:]
    after = np.minimum(starts + 1 + (data[starts] == 0xC3), len(data) - 1)
    capital = is_up[starts] & ~is_up[after] & (after < ends)
    name = (capital & ~opening) | (upper[starts] & _among(value, _NAMES))
    code = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    slot = number | unit | name
    keep = np.ones(len(code), bool)
    keep[1:] = ~(slot[1:] & same[1:] & (code[1:] == code[:-1]))
    # Merged neighbours keep all their values in one hash.
    group = np.cumsum(keep) - 1
    first = np.flatnonzero(keep)
    merged = np.add.reduceat(mix(value + (np.arange(len(value)) - first[group]).astype(U64)), first)
    return code[keep], owner[keep], slot[keep], merged, value, owner


def window_hashes(code: np.ndarray, w: int) -> np.ndarray:
    n = len(code) - w + 1
    if n <= 0:
        return np.empty(0, U64)
    x = np.zeros(n, U64)
    for i in range(w):
        x += code[i : i + n] * _STEP[i]
    return mix(x + U64(w))


def whole_hash(value: np.ndarray) -> int:
    """Hash of a run of raw tokens."""
    return int(mix((value * powers(len(value))[0][: len(value)]).sum(keepdims=True, dtype=U64) + U64(len(value)))[0])


class Index:
    """Windows of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, cover: float = COVER):
        self.cover, self.items, places = cover, [], defaultdict(list)
        #: Items by raw tokens: hash of the first SHORTEST ones, number of tokens, hash of all.
        self.raw: dict[int, dict[int, dict[int, list]]] = {}
        for item_id, text in items:
            code, _, slot, value, raw, _ = canonical(Block(*_bytes(text), 0))
            if len(raw) < SHORTEST:
                continue
            use = np.empty(0, np.int64)
            if len(code) >= SHORTEST:
                w = min(window, len(code))
                literal = np.convolve(~slot, np.ones(w, int), "valid")
                use = np.flatnonzero(2 * literal >= w)
            if not len(use):
                head = int(window_hashes(raw[:SHORTEST], SHORTEST)[0])
                self.raw.setdefault(head, {}).setdefault(len(raw), {}).setdefault(whole_hash(raw), []).append(item_id)
                continue
            me = len(self.items)
            self.items.append((item_id, w, len(use), slot, value))
            h = window_hashes(code, w)
            for off in use:
                places[(w, int(h[off]))].append((me, int(off)))
        self.places = dict(places)
        self.sorted = {w: np.sort(np.array([h for v, h in self.places if v == w], U64)) for w in {v for v, _ in self.places}}
        self.heads = np.sort(np.array(list(self.raw), U64))

    def leaks(self, block: Block) -> Iterator[tuple[int, int, float, str]]:
        """(text, item id, cover, kind) of each leak in the block."""
        code, owner, slot, value, raw, raw_owner = canonical(block)
        hits: dict[tuple[int, int], list] = defaultdict(list)
        for w, known in self.sorted.items():
            x = window_hashes(code, w)
            if not len(x):
                continue
            at = np.flatnonzero(_among(x, known) & (owner[: len(x)] == owner[w - 1 :]))
            for p in at:
                for me, off in self.places[(w, int(x[p]))]:
                    hits[(int(owner[p]), me)].append((int(p), off))
        for (text, me), found in sorted(hits.items()):
            item_id, w, total, islot, ivalue = self.items[me]
            if len({off for _, off in found}) < self.cover * total:
                continue
            by = defaultdict(list)
            for p, off in found:
                by[p - off].append((p, off))
            bound: dict = {}
            covered: set[int] = set()
            for _, places in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
                trial, fine = dict(bound), True
                for p, off in places:
                    for i in np.flatnonzero(islot[off : off + w]):
                        a, b = int(ivalue[off + i]), int(value[p + i])
                        fine &= trial.setdefault(a, b) == b
                if fine:
                    bound = trial
                    covered |= {off for _, off in places}
            share = len(covered) / total
            if share >= self.cover:
                yield text, item_id, share, "exact" if all(a == b for a, b in bound.items()) else "re-parameterised"
        yield from self.raw_leaks(raw, raw_owner)

    def raw_leaks(self, raw: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, float, str]]:
        """Leaks of the items that are searched by their raw tokens."""
        if not len(self.heads) or len(raw) < SHORTEST:
            return
        x = window_hashes(raw, SHORTEST)
        found: dict[tuple[int, int, int], list] = {}
        for p in np.flatnonzero(_among(x, self.heads)).tolist():
            for n, known in self.raw[int(x[p])].items():
                if p + n <= len(raw) and owner[p] == owner[p + n - 1] and (h := whole_hash(raw[p : p + n])) in known:
                    found[int(owner[p]), n, h] = known[h]  # copies in one text count once
        for (text, *_), items in sorted(found.items()):
            for item_id in items:
                yield text, item_id, 1.0, "exact"


def _bytes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return raw, np.array([0, len(raw)], np.int64)


def index_parts(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The benchmark's index in parts of about PART_ITEMS items."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    parts = max(1, -(-rows.count() // PART_ITEMS))
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield Index(sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is None, x)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item that it leaks: id, item_id, cover, kind. Clean documents have none."""
    rows, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    for index in index_parts(benchmark):

        def apply(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in blocks(b.column(1)):
                    found = list(index.leaks(k))
                    if found:
                        text, item, cover, kind = zip(*found, strict=True)
                        ids = b.column(0).take(pa.array([t + k.first for t in text]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), pa.array(cover, pa.float64()), pa.array(kind, pa.string())], names=["doc_id", "item_id", "cover", "kind"])

        part = rows.mapInArrow(apply, "doc_id long, item_id long, cover double, kind string")
        out = part if out is None else out.union(part)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns."""
    at, schema = docs.columns.index(text_col), docs.schema
    for index in index_parts(benchmark):

        def apply(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = np.ones(b.num_rows, bool)
                for k in blocks(b.column(at)):
                    good[[t + k.first for t, *_ in index.leaks(k)]] = False
                yield b.filter(pa.array(good))

        docs = docs.mapInArrow(apply, schema)
    return docs
