"""One plain form for text that looks the same but is written with other characters.

Three steps per value: characters that show nothing are deleted and compatibility forms (wide letters, ligatures,
odd spaces) replaced; what is left is composed; then each word is read as a lattice whose columns hold a
character and the letters of other scripts it looks like, and Viterbi picks the reading that stays in one script
and has the best letter-pair scores. The letter-pair scores are counted over the whole columns. Bound: look-alikes are those
of ``LOOK_ALIKES`` and of compatibility forms; a word that holds a letter of any other script is kept as it is, and
digits are not taken for letters.

Plain and therefore kept: composed accents, whole words and names in another script, mathematical symbols, raised
digits, long dashes and typographic quotes.

Defined results: NULL stays NULL, ``""`` stays ``""``, a value made only of invisible characters becomes ``""``.
Values are independent of each other, so repeated rows, ties, extra columns and long texts change nothing.
An empty table gives an empty table.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look like a plain Latin letter, by script.
LOOK_ALIKES = {
    "cyrillic": "аa вb еe кk оo рp сc тt уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl ѵv ԍg"
    " АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԌG ԚQ ԜW ӀI ҮY ѴV ҺH",
    "greek": "αa ιi κk νv οo ρp υu χx ϲc ϳj γy τt"
    " ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϺM ͿJ",
    "armenian": "օo սu հh ոn ցg զq ՕO ՍU ԼL ՏS",
    "cherokee": "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎥI ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ",
    "coptic": "ⲟo ⲣp ⲥc ⲭx ⲩy ⲕk ⲁa ⲓi ⲞO ⲢP ⲤC ⲬX ⲨY ⲔK ⲦT ⲘM ⲚN ⲎH ⲒI ⲂB",
    "lisu": "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ",
    "georgian": "ჿo",
    "latin": "ɑa ɡg ᴀa ʙb ᴄc ᴅd ᴇe ɢg ʜh ɪi ᴊj ᴋk ʟl ᴍm ɴn ᴏo ᴘp ʀr ꜱs ᴛt ᴜu ᴠv ᴡw ʏy ᴢz ꜰf",
}
# Marks that look like a plain mark, and spaces.
MARKS = {"‐": "-", "‑": "-", "˗": "-", "꞉": ":", "ː": ":", "․": ".", " ": " ", " ": " "}
# Characters that show nothing although their category is not Cf.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ⠀"
# Decomposition tags that leave the look unchanged; raised and lowered digits and fractions are plain.
SAME_LOOK = ("<wide>", "<narrow>", "<small>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x250, 0x2AF), (0x1D00, 0x1D2B), (0x1E00, 0x1EFF), (0xA730, 0xA731)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "cherokee": [(0x13A0, 0x13FF)],
    "coptic": [(0x2C80, 0x2CFF)],
    "lisu": [(0xA4D0, 0xA4FF)],
    "georgian": [(0x10A0, 0x10FF)],
}
PLAIN_ASCII = r"\A[\x09\x0a\x0d\x20-\x7e]*\z"
SWITCH, CHANGE, FOREIGN = 9.0, 0.4, 2.5


def _same_look(c: str) -> str:
    """The plain form of one character outside ASCII, without regard to its neighbours."""
    if c in MARKS:
        return MARKS[c]
    kind = unicodedata.category(c)
    code = ord(c)
    if kind in ("Cf", "Cc") or c in UNSEEN or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return " " if c in "\t\n\r\x0b\x0c\x85" else ""
    if kind == "Zs":
        return " "
    if c in _TO_LATIN or 0x370 <= code <= 0x3FF:
        return c
    parts = unicodedata.decomposition(c).split()
    if parts and parts[0] in SAME_LOOK and kind != "Sm" and not 0x2000 <= code <= 0x214F:
        out = unicodedata.normalize("NFKC", c)
        return out if not out.startswith(" ") else c
    return c


@lru_cache(1 << 14)
def _one(c: str) -> str:
    return c if "\x20" <= c <= "\x7e" or c in "\t\n\r" else _same_look(c)


@lru_cache(1 << 14)
def script_of(c: str) -> str:
    """Script of a letter, "" for what is no letter, "other" for scripts that hold no look-alikes here."""
    code = ord(c)
    for name, spans in SCRIPTS.items():
        if any(a <= code <= b for a, b in spans):
            return name if c.isalpha() else ""
    return "other" if c.isalpha() else ""


_TO_LATIN = {p[0]: p[1] for pairs in LOOK_ALIKES.values() for p in pairs.split()}
#: Letters of the Latin script that stand for plain ones.
_ODD_LATIN = frozenset(p[0] for p in LOOK_ALIKES["latin"].split())
_FROM_LATIN: dict[str, list[str]] = {}
for _script in ("cyrillic", "greek", "armenian"):
    for _p in LOOK_ALIKES[_script].split():
        if not (_p[0].islower() and _p[0] in "αγτυικχвктԍоոհսցզ"):
            _FROM_LATIN.setdefault(_p[1], []).append(_p[0])
    if _script == "cyrillic":
        _FROM_LATIN.setdefault("o", []).append("о")


def _letter_table() -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Number of each letter: letters of one script that differ in accent or case only share one. 0: no letter."""
    numbers, names = {}, [("", "")]
    out = np.zeros(0x2000, dtype=np.int32)
    for script, spans in SCRIPTS.items():
        for a, b in spans:
            for code in range(a, b + 1):
                c = chr(code)
                if not c.isalpha() or code >= len(out):
                    continue
                base = unicodedata.normalize("NFD", c)[0].lower()
                key = (script, base[:1])
                if key not in numbers:
                    numbers[key] = len(names)
                    names.append(key)
                out[code] = numbers[key]
    return out, names


LETTERS, LETTER_NAMES = _letter_table()
N_LETTERS = len(LETTER_NAMES)


def _pairs(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring letters, as number of the first times N_LETTERS plus number of the second."""
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.where(codes < len(LETTERS), LETTERS[np.minimum(codes, len(LETTERS) - 1)], 0).astype(np.int64)
    return np.bincount(letters[:-1] * N_LETTERS + letters[1:], minlength=N_LETTERS * N_LETTERS)


def fit_letter_pairs(*columns: DataFrame) -> np.ndarray:
    """Letter-pair scores from all values of one-column tables.

    Each partition sums its counts; what reaches the driver is at most one number per pair of letters of the five
    scripts (N_LETTERS squared, whatever the data), so it may be sent to every task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(N_LETTERS * N_LETTERS, dtype=np.int64)
        for batch in batches:
            total += _pairs(batch.iloc[:, 0].dropna().tolist())
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"pair": seen, "n": total[seen]})

    parts = [c.mapInPandas(count, "pair long, n long") for c in columns]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    counts = np.zeros(N_LETTERS * N_LETTERS)
    for row in union.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[row.pair] = row.n
    table = counts.reshape(N_LETTERS, N_LETTERS)
    script = np.array([hash_script(s) for s, _ in LETTER_NAMES])
    same = (script[:, None] == script[None, :]) | (script[:, None] == 0) | (script[None, :] == 0)
    table = np.where(same, table, 0) + 0.2 * same
    return np.log(np.maximum(table / table.sum(axis=1, keepdims=True), 1e-9)).astype(np.float32)


def hash_script(name: str) -> int:
    return 0 if not name else 1 + list(SCRIPTS).index(name)


def _number(c: str) -> int:
    code = ord(c)
    return int(LETTERS[code]) if code < len(LETTERS) else 0


def _candidates(c: str) -> list[str]:
    out = [c]
    if c in _TO_LATIN:
        out.append(_TO_LATIN[c])
    out += _FROM_LATIN.get(c, [])
    return out


def _read(word: str, share: dict[str, float], scores: np.ndarray) -> str:
    """The best path through the lattice of one word; ``share`` is the weight of each script in the whole value."""
    columns = [[(c, script_of(c), _number(c), 0.0 if i == 0 else CHANGE) for i, c in enumerate(_candidates(ch))] for ch in word]
    prior = {s: -FOREIGN * math.log(max(w, 0.02)) for s, w in share.items()}
    best = [(cost + prior.get(s, -FOREIGN * math.log(0.02)) - scores[0, n], c) for c, s, n, cost in columns[0]]
    for i in range(1, len(columns)):
        now = []
        for c, s, n, cost in columns[i]:
            options = []
            for (total, path), (_, before, m, _) in zip(best, columns[i - 1], strict=True):
                step = -float(scores[m, n]) if s == before else SWITCH - float(scores[0, n])
                options.append((total + step + cost, path + c))
            now.append(min(options))
        best = now
    return min((total - float(scores[n, 0]), path) for (total, path), (_, _, n, _) in zip(best, columns[-1], strict=True))[1]


def plain_text(value: str, scores: np.ndarray) -> str:
    """Plain form of one value."""
    text = "".join(map(_one, value))
    text = unicodedata.normalize("NFC", text)
    scripts = [script_of(c) for c in text]
    if not any(s not in ("", "latin", "other") or c in _ODD_LATIN for s, c in zip(scripts, text, strict=True)):
        return text
    words, start = [], None
    for i, s in enumerate([*scripts, ""]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            words.append((start, i))
            start = None
    # letters that look like nothing in another script tell which scripts the value is really in
    weight: dict[str, float] = {}
    for c, s in zip(text, scripts, strict=True):
        if s:
            weight[s] = weight.get(s, 0.0) + (1.0 if len(_candidates(c)) == 1 else 0.02)
    total = sum(weight.values())
    share = {s: w / total for s, w in weight.items()}
    share["latin"] = share.get("latin", 0.0) + 0.05
    out, at = [], 0
    for a, b in words:
        word, own = text[a:b], set(scripts[a:b])
        out.append(text[at:a])
        at = b
        lone_symbol = b - a == 1 and own == {"greek"} and word.islower()
        if own <= {"latin"} and share["latin"] > 0.3 and not any(c in _ODD_LATIN for c in word) or "other" in own or lone_symbol:
            out.append(word)
        else:
            out.append(_read(word, share, scores))
    out.append(text[at:])
    return "".join(out)


def plain_form(column: Column | str, scores: np.ndarray) -> Column:
    """The column in plain form. Printable ASCII stays in the JVM; only other values reach Python, in Arrow batches."""
    col = F.col(column) if isinstance(column, str) else column

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: plain_text(v, scores), na_action="ignore")

    odd = F.when(~col.rlike(PLAIN_ASCII), col)
    return F.when(col.rlike(PLAIN_ASCII), col).otherwise(read(odd))
