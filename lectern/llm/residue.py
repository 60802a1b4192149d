"""Template residue, filler, error pages and demands for scripts inside texts.

Labelled exemplars of such leftovers, a table of ``family, label, text``, are tokenised. Tokens are words, and classes of
words: a placeholder of any template language is a token of its delimiters and one for the name within; words that mean
the same in notices of several languages are one token; so are words of the passage long used as filler, keys struck
at random, runs of one letter, and words that only repeat the ones before. An inverted index leads from an
exemplar's rarest terms to the exemplar. A text is read once: its tokens retrieve exemplars, and for each one retrieved
the passage window with the largest TF-IDF containment of the exemplar is found. A text with a window at or above the
exemplar's bound is residue; there is no other way to become it. Document frequencies are counted over all texts; only
those of the exemplars' own terms (at most ``ROWS`` exemplars) reach the driver.

Defined results: NULL and blank texts are never residue and have a NULL score; repeated rows get equal scores; long
texts are read whole; an empty table gives no rows; extra columns stay as they are, but one named ``residue`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from operator import eq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import exemplars

# The passage long used as filler text; its words are no English.
LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore
magna aliqua aliquam enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ea commodo consequat duis
aute irure reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat
proident sunt culpa officia deserunt mollit anim est laborum tempus vestibulum"""
# Placeholders of template languages, and shapes that only broken output has.
SHAPES = {
    "mustache": r"\{\{[#/^&!>]?\s*[\w.$|: ]{1,60}(?:\}\}\}?|$)",
    "dollar": r"\$\{[A-Za-z_][\w.]*[_.\w]{2,}\}",
    "smarty": r"\{\$[A-Za-z_][\w.>\-]*\}",
    "block": r"\{%-?\s*\w[^%]{0,80}-?%\}",
    "asp": r"<%[=#@]?\s*[^%]{1,80}%>|<\?(?:=|php)[^?]{1,80}\?>",
    "double_bracket": r"\[\[\s*[A-Za-z_][\w. ]*\]\]",
    "percent": r"%%[A-Za-z_]+%%|(?<![\w%])%[A-Za-z_.]{3,}%(?![\w%])",
    "at": r"@@?[A-Za-z_][\w.]{2,}@@?(?!\w)(?<=@)",
    "hash": r"##[A-Za-z_.]+##|#\{[A-Za-z_][\w.]*\}|(?<!\w)__[A-Za-z_.]{3,}?__(?!\w)",
    "angle": r"<<[A-Z][A-Z _]*>>|<[A-Z][A-Z_ ]{2,}>",
    "printf": r"%\d\$[sd]|%\([a-z_]+\)[sd]",
    "blank": r"_{3,}",
    "sheet": r"#REF!|#N/A|#VALUE!|#NAME\?|#DIV/0!",
    "object": r"\[object \w+\]",
    "your": r"\[(?:YOUR|INSERT|ENTER|ADD|Insert|Your|Enter)\b[^\]]{1,80}\]",
    "slot": r"(?<![\w\\^_}$])\{[A-Za-z]{4,}(?:[_.][A-Za-z_.]+)?\}(?!\$)",
    "markup": r"<(?:noscript|script|h[1-6]|div|body|html|iframe|form)\b[^>]*>|<p \w+=[^>]*>",
}
# Words of notices that mean the same, by language.
CONCEPTS = {
    "⟦enable⟧": "enable enables enabled activate activated activez activer aktivieren habilite habilitar activar active attiva attivare abilita abilitare ative ativar schakel włącz einschalten",
    "⟦off⟧": "disabled deaktiviert désactivé desactivado disattivato deactivated desativado uitgeschakeld",
    "⟦scripts⟧": "javascript scripting",
    "⟦browser⟧": "browser browsers browsers' navigateur navegador przeglądarce",
    "⟦please⟧": "please veuillez bitte favore",
    "⟦page⟧": "page site website seite pagina página stronę",
    "⟦require⟧": "require requires required requiere benötigt nécessite richiede needs",
}
_SHAPE = re.compile("|".join(f"(?P<{n}>{p})" for n, p in SHAPES.items()))
_OPENING = re.compile(r"[{<%$\[@#_]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|⟦\w+⟧")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣]")
_HOME_ROW = re.compile(r"[asdfghjkl]{4,}\Z")
_HOME_WORDS = frozenset("flash glass glad shall half hall fall falls flag flags dash gall flask salad ash hash alas".split())
ROWS = 1_000
BOUND = {"scripts": 0.68, "error": 0.68, "template": 0.75, "filler": 0.75}
#: Words a window of a filler exemplar spans; so many equal words in a row are an echo.
FILLER_WINDOW, ECHO = 12, 5
_CONCEPT = {w: c for c, words in CONCEPTS.items() for w in words.split()}
_LATIN = frozenset(LOREM.split()) - {"sit", "ea", "et", "ut", "sed", "est", "sint", "labore", "quis"}


def _marked(text: str) -> str:
    """Placeholders replaced by shape tokens. Only places with a character that can open one are tried."""
    parts, at = [], 0
    for opening in _OPENING.finditer(text):
        for i in range(max(at, opening.start()), opening.end()):
            if m := _SHAPE.match(text, i):
                parts += [text[at:i], f" ⟦{m.lastgroup}⟧ ⟦name⟧ "]
                at = m.end()
                break
    return "".join([*parts, text[at:]]) if parts else text


def _word_tokens(w: str) -> tuple[str, ...]:
    if w[0] == "⟦":
        return (w,)
    if w[0].isdigit():
        return ("0",)
    if _CJK.match(w):
        return tuple(w)
    if w in _CONCEPT:
        return (_CONCEPT[w],)
    if w in _LATIN:
        return ("⟦latin⟧",)
    if _HOME_ROW.match(w) and w not in _HOME_WORDS and not w.startswith("asdf"):
        return ("⟦mash⟧",)
    return ("⟦xs⟧",) if len(w) >= 3 and set(w) == {"x"} else (w,)


_seen: dict[str, tuple[str, ...]] = {}


def tokens_of(text: str) -> list[str]:
    """Lower-case words, numbers as ``0``, CJK characters one by one, placeholders as shape tokens."""
    if len(_seen) > 100_000:
        _seen.clear()
    out: list[str] = []
    for w in _WORD.findall(_marked(text).lower()):
        tokens = _seen.get(w)
        if tokens is None:
            tokens = _seen[w] = _word_tokens(w)
        out += tokens
    repeated = set()
    for period in (1, 2, 3):
        if sum(map(eq, out, out[period:])) < (ECHO - 1) * period:
            continue
        run = 0
        for i in range(period, len(out)):
            run = run + 1 if out[i] == out[i - period] and len(out[i]) > 2 and out[i][0] != "⟦" else 0
            if run >= (ECHO - 1) * period:
                repeated.update(range(i - run - period + 1, i + 1))
    for i in repeated:
        out[i] = "⟦echo⟧"
    return out


def default_exemplars() -> list[tuple[str, str, str]]:
    return exemplars.rows()


class ResidueIndex:
    """Inverted index over the exemplars: anchor term -> exemplars, with the weight of each exemplar's terms."""

    def __init__(self, given: list[tuple[str, str, str]], frequency: dict[str, int], n_texts: int):
        self.top = math.log1p(max(n_texts, 1)) + 1.0
        frequency = frequency | {c: min(n_texts, sum(frequency.get(w, 0) for w in words.split())) for c, words in CONCEPTS.items()}
        weight = {t: math.log((n_texts + 1) / (f + 1)) + 1.0 for t, f in frequency.items()}
        weight["0"] = 1.0  # any number
        self.items = []
        self.anchors: dict[str, list[int]] = defaultdict(list)
        for _, kind, text in given:
            tokens = tokens_of(text)
            need = Counter(tokens)
            w = {t: weight.get(t, self.top) for t in need}
            total = sum(w[t] * n for t, n in need.items())
            k = len(self.items)
            if not tokens:
                continue
            self.items.append((kind, text, need, w, total, FILLER_WINDOW if kind == "filler" else int(len(tokens) * 1.5) + 3))
            # the rarest terms; a window that holds none of them stays below the bound
            left = total
            for t in sorted(need, key=lambda t: -w[t] * need[t]):
                if left < BOUND[kind] * total:
                    break
                self.anchors[t].append(k)
                left -= w[t] * need[t]

    def score(self, text: str) -> tuple[float, str, str]:
        """The best containment over the exemplar's bound, with label and exemplar: residue at 1 or more, else perhaps 0."""
        tokens = tokens_of(text)
        have = set(tokens)
        retrieved = {k for t in have if t in self.anchors for k in self.anchors[t]}
        best = (0.0, "", "")
        for k in retrieved:
            kind, name, need, w, total, width = self.items[k]
            if sum(w[t] * n for t, n in need.items() if t in have) < BOUND[kind] * total:
                continue  # not even the whole text holds enough of it
            places = [i for i, t in enumerate(tokens) if t in need]
            held: Counter = Counter()
            mass = peak = 0.0
            left = 0
            for i in places:
                t = tokens[i]
                held[t] += 1
                if held[t] <= need[t]:
                    mass += w[t]
                while i - places[left] >= width:
                    o = tokens[places[left]]
                    if held[o] <= need[o]:
                        mass -= w[o]
                    held[o] -= 1
                    left += 1
                peak = max(peak, mass)
            got = peak / total / BOUND[kind]
            if got > best[0]:
                best = (got, kind, name)
        return best


def fit_residue_index(texts: DataFrame, text: str, given: DataFrame | None = None) -> ResidueIndex:
    """The index over the exemplars ``given``, a table ``family, label, text``, with document frequencies over all texts.

    Labels are those of ``BOUND``. Frequencies are kept for the exemplars' own words only.
    """
    chosen = default_exemplars() if given is None else [tuple(r) for r in given.select("family", "label", "text").limit(ROWS + 1).collect()]
    if len(chosen) > ROWS:
        raise ValueError(f"more than {ROWS} exemplars")
    if unknown := {k for _, k, _ in chosen} - set(BOUND):
        raise ValueError(f"unknown labels: {sorted(unknown)}")
    words = sorted({t for t in {*_CONCEPT, *(t for _, _, e in chosen for t in tokens_of(e))} if t.isascii() and t.isalpha()})
    # a set of constants is looked up word by word; an intersection of arrays would build its set anew for each text
    found = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), "[^a-z]+"), lambda w: w.isin(*words)))
    rows = (
        texts.where(F.col(text).isNotNull())
        .select(F.explode(F.array_append(found, F.lit(""))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    counts = {r.term: r.n for r in rows}
    return ResidueIndex(chosen, {w: counts.get(w, 0) for w in words}, counts.get("", 0))


def residue_score(text: Column | str, index: ResidueIndex) -> Column:
    """Struct ``score, label, exemplar``; NULL for NULL and blank texts."""
    col = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf("score double, label string, exemplar string")
    def score(values: pd.Series) -> pd.DataFrame:
        rows = [index.score(v) if v is not None and v.strip() else (None, None, None) for v in values]
        return pd.DataFrame(rows, columns=["score", "label", "exemplar"])

    return score(col)


def residue_rows(df: DataFrame, text: str, index: ResidueIndex) -> DataFrame:
    """Rows that hold residue, with ``score, label, exemplar`` in a struct ``residue``."""
    return df.withColumn("residue", residue_score(text, index)).where(F.col("residue.score") >= 1.0)


def without_residue(df: DataFrame, text: str, index: ResidueIndex) -> DataFrame:
    """The rows kept: those without residue, NULL and blank texts included."""
    score = residue_score(text, index)["score"]
    return df.where(F.coalesce(score, F.lit(0.0)) < 1.0)
