"""Languages of texts and of their sentences, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters'
vectors, permuted (rolled) by their place; a profile bundles (adds) n-gram vectors. A text's bundle
is compared with each language's prototype by cosine. As the dot product distributes over the
bundle, the ten products of an n-gram are computed once, when a worker first meets it, and kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textstats import statistics

LANGUAGES = ("tr", "en", "de", "es", "fr", "ru", "zh", "ja", "th", "ar")
# Three-letter and other forms of the language codes.
FORMS = {"tr": "tr tur turkish türkçe", "en": "en eng english", "de": "de deu ger german deutsch", "es": "es spa spanish español", "fr": "fr fra fre french français", "ru": "ru rus russian", "zh": "zh zho chi chinese cn", "ja": "ja jpn japanese jp", "th": "th tha thai", "ar": "ar ara arabic"}
JAPANESE = LANGUAGES.index("ja")
PLACEHOLDERS = "und unknown none null n/a na xx zxx mul auto other ? -".split()
DIMENSIONS = 2048
TRAIN_PER_LANGUAGE = 300  # texts of each kind of record and language that prototypes are fitted on, at most
TRAIN_LENGTHS = (20, 4000)
LEAST_LETTERS = 20  # letters that a sentence needs to speak for itself
LEAST_CJK = 5  # letters that a sentence mostly in Chinese characters or kana needs; an alphabet's word is one or two of them
LEAST_MARGIN = 0.05  # by which its best cosine must exceed the next
DOUBT = 0.98  # confidence under which a text is looked at for being junk
BATCH_CHARS = 400_000

# Symbols: Latin letters by themselves, other scripts in blocks, a place for everything else.
_LATIN = "abcdefghijklmnopqrstuvwxyzçğıöşüäßáéíóúñàâèêëîïôûùœæåãõøìò"
_BLOCKS = ((0x400, 0x52F, 24), (0x600, 0x6FF, 8), (0xE00, 0xE7F, 8), (0x3041, 0x309F, 6), (0x30A0, 0x30FF, 3), (0x4E00, 0x9FFF, 8), (0x3400, 0x4DBF, 2))
N_SYMBOLS = 128
_CJK = tuple(len(_LATIN) + sum(b[2] for b in _BLOCKS[:k]) for k in (3, 5, len(_BLOCKS)))  # symbols over the first: kana up to the second, all up to the third
_END = {ord(c): 1 for c in ".!?…؟"} | {ord(c): 2 for c in "。！？"}
_CLOSERS = frozenset(map(ord, "\"”’»“」』）)]'"))


def label_code(label: Column) -> Column:
    """The two-letter code behind a label; null where it is missing, a placeholder or unknown."""
    bare = F.lower(F.regexp_replace(F.trim(label), "[-_].*$", ""))
    code = F.lit(None).cast("string")
    for name, forms in FORMS.items():
        code = F.when(bare.isin(*forms.split()), name).otherwise(code)
    return code


@lru_cache(maxsize=1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point (0: no letter), and a class: 1 and 2 sentence ends, 3 newline, 4 blank, 5 symbol."""
    sym, kind = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for i, c in enumerate(_LATIN):
        for form in {c, c.upper()} if c != "ı" else {c}:
            if len(form) == 1:
                sym[ord(form)] = i + 1
    sym[ord("İ")] = _LATIN.index("i") + 1
    at = len(_LATIN) + 1
    for lo, hi, n in _BLOCKS:
        for c in range(lo, hi + 1):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LM":
                sym[c] = at + (ord(ch.lower()[0]) * 7919 >> 2) % n
        at += n
    for c in range(0xC0, 0x250):
        if not sym[c] and chr(c).isalpha():
            base = unicodedata.normalize("NFD", chr(c).lower())[0]
            sym[c] = sym[ord(base)] if ord(base) < 128 and sym[ord(base)] else at
    for c, k in _END.items():
        kind[c] = k
    for c in range(0x3000):
        ch = chr(c)
        if ch == "\n":
            kind[c] = 3
        elif ch.isspace() or c in (0x200B, 0xFEFF):
            kind[c] = 4
        elif unicodedata.category(ch) in ("Sm", "Sc", "Sk", "So", "Cc", "Cn", "Co"):
            kind[c] = 5
    kind[0xFFFD] = 5
    return sym, kind


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (N_SYMBOLS, DIMENSIONS))


def _bound(grams: np.ndarray) -> np.ndarray:
    """Vectors of n-grams (numbers in base N_SYMBOLS, three places)."""
    v = _letters()
    a, b, c = grams // N_SYMBOLS**2, grams // N_SYMBOLS % N_SYMBOLS, grams % N_SYMBOLS
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


class Coded:
    """Texts as one row of symbols, cut into sentence-like segments."""

    def __init__(self, texts: list[str]) -> None:
        sym, kind = _symbols()
        raw = np.frombuffer("\n\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(lens + 2)[:-1])) if len(texts) else np.zeros(0, np.int64)
        self.lens = lens
        s, k = sym[raw], kind[raw]
        marks = np.flatnonzero((raw >= 0x300) & (raw <= 0x36F))
        if len(marks) and marks[0] == 0:
            marks = marks[1:]
        if len(marks):  # letters stored decomposed
            pair = raw[marks - 1].astype(np.int64) << 32 | raw[marks]
            uniq, back = np.unique(pair, return_inverse=True)
            made = np.array([ord(x) if len(x := unicodedata.normalize("NFC", chr(int(p >> 32)) + chr(int(p & 0xFFFFFFFF)))) == 1 else 0 for p in uniq])
            ok = made[back] > 0
            s[marks[ok] - 1] = sym[made[back][ok]]
        drop = np.zeros(len(s), bool)
        drop[marks] = True
        self.ends = self._cut(raw, s, k)
        self.odd = k == 5
        solid = (s > 0) & ~drop
        before = np.concatenate(([False], solid[:-1]))
        if len(marks):
            before[marks] = False
            after = marks + 1
            after = after[after < len(s)]
            before[after] = True
        keep = solid | (before & ~solid & ~drop)
        self.at = np.flatnonzero(keep)
        z = s[self.at].astype(np.int32)
        grams = np.zeros(len(z), np.int32)
        if len(z) > 1:
            grams[1:-1] = z[:-2] * N_SYMBOLS**2 + z[1:-1] * N_SYMBOLS + z[2:]
            grams[0], grams[-1] = z[0] * N_SYMBOLS + z[1], z[-2] * N_SYMBOLS**2 + z[-1] * N_SYMBOLS
        letter = z > 0
        self.at, self.grams = self.at[letter], grams[letter]
        self.kana, self.cjk = ((z[letter] > _CJK[0]) & (z[letter] <= end) for end in _CJK[1:])

    def _cut(self, raw: np.ndarray, s: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Positions after which a segment ends; every text ends one."""
        n = len(raw)
        cut = np.zeros(n, bool)
        cut[k == 2] = True
        end = np.flatnonzero(k == 1)
        nxt = end + 1
        for _ in range(3):
            step = (nxt < n) & np.isin(raw[np.minimum(nxt, n - 1)], list(_CLOSERS))
            nxt = nxt + step
        blank = (nxt >= n) | (k[np.minimum(nxt, n - 1)] >= 3) & (k[np.minimum(nxt, n - 1)] <= 4) | (raw[np.minimum(nxt, n - 1)] == ord("["))
        cut[np.minimum(nxt - 1, n - 1)[blank]] = True
        line = np.flatnonzero(k == 3)
        double = line[(line + 1 < n) & (k[np.minimum(line + 1, n - 1)] == 3)]
        cut[double] = True
        marked = line[(line + 2 < n) & np.isin(raw[np.minimum(line + 1, n - 1)], [ord(c) for c in "-•*–"])]
        cut[marked] = True
        thai = (raw >= 0xE00) & (raw <= 0xE7F)
        gap = np.flatnonzero((k == 4) | (k == 3))
        gap = gap[(gap > 0) & (gap + 1 < n)]
        cut[gap[thai[gap - 1] | thai[gap + 1]]] = True
        cut[(self.starts + self.lens - 1)[self.lens > 0]] = True
        cut[(self.starts + self.lens)[:-1]] = True
        return np.flatnonzero(cut)


class Fitted(NamedTuple):
    """What texts are compared with: prototypes, and the curve that turns margins into confidence."""

    prototypes: np.ndarray
    curve: tuple[float, float, float] = (0.0, 60.0, 1.0)  # a logistic over 1, the margin, and the letters' logarithm


class Profiles:
    """Language prototypes and the n-gram products kept so far."""

    def __init__(self, fitted: Fitted | np.ndarray) -> None:
        fitted = fitted if isinstance(fitted, Fitted) else Fitted(fitted)
        self.prototypes, self.curve = fitted
        self.table = np.zeros((N_SYMBOLS**3, len(LANGUAGES)), np.float32)
        self.known = np.zeros(N_SYMBOLS**3, bool)

    def products(self, grams: np.ndarray) -> np.ndarray:
        new = np.unique(grams[~self.known[grams]])
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.table[part] = _bound(part).astype(np.float32) @ self.prototypes.T / DIMENSIONS
        self.known[new] = True
        return self.table[grams]

    def sums(self, coded: Coded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each segment of `coded`: its bundle's products with the prototypes, the bundle's norm, and the number of letters."""
        seg = np.searchsorted(coded.ends, coded.at)
        n = np.bincount(seg, minlength=len(coded.ends))
        out = np.zeros((len(coded.ends), len(LANGUAGES)), np.float32)
        if len(seg):
            first = np.flatnonzero(np.diff(seg, prepend=-1))
            out[seg[first]] = np.add.reduceat(self.products(coded.grams), first, axis=0)
        return out, norms(coded.grams, seg, len(coded.ends)), n

    def cosines(self, coded: Coded) -> tuple[np.ndarray, np.ndarray]:
        """For each segment of `coded`: cosines with the prototypes, and the number of letters."""
        out, norm, n = self.sums(coded)
        return out / norm[:, None], n

    def confidence(self, margin: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """How likely texts of so many letters are in the language that leads by so much."""
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.maximum(margin, 0) + c * np.log(np.maximum(letters, 1)), -30, 30)))


def norms(grams: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Norms of the groups' bundles, in roots of DIMENSIONS: of n-gram counts, as different n-grams' vectors are all but orthogonal."""
    if not len(grams):
        return np.ones(groups)
    key = np.sort(group.astype(np.int64) * N_SYMBOLS**3 + grams)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(first, len(key)))
    return np.sqrt(np.maximum(np.bincount(key[first] // N_SYMBOLS**3, weights=count.astype(float) ** 2, minlength=groups), 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows - rows.mean(axis=0)
    return (rows * np.sqrt(DIMENSIONS) / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class _Vectors:
    """The vectors of all n-grams that occur in training, bound once and kept."""

    def __init__(self, grams: np.ndarray) -> None:
        self.uniq = np.unique(grams)
        self.bound = np.concatenate([_bound(self.uniq[i : i + 4096]) for i in range(0, len(self.uniq), 4096)])

    def times(self, rows: np.ndarray) -> np.ndarray:
        """(n-grams, rows) products with rows of DIMENSIONS numbers, as parts of DIMENSIONS."""
        return np.concatenate([self.bound[i : i + 4096].astype(np.float32) @ rows.T / DIMENSIONS for i in range(0, len(self.uniq), 4096)])

    def bundles(self, weights: np.ndarray) -> np.ndarray:
        """(rows, DIMENSIONS) bundles of n-grams with (rows, n-grams) weights."""
        out = np.zeros((len(weights), DIMENSIONS), np.float32)
        for i in range(0, len(self.uniq), 4096):
            out += weights[:, i : i + 4096].astype(np.float32) @ self.bound[i : i + 4096].astype(np.float32)
        return out


def _coded_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of all texts, with the text and the sentence (numbered through) of each."""
    out, begin, size = [], 0, 0
    sentences = 0
    for end in range(1, len(texts) + 1):
        size += len(texts[end - 1])
        if size >= BATCH_CHARS or end == len(texts):
            c = Coded(texts[begin:end])
            seg = np.searchsorted(c.ends, c.at)
            out.append((c.grams, (begin + np.searchsorted(c.starts, c.at, side="right") - 1).astype(np.int32), (sentences + seg).astype(np.int32)))
            sentences += len(c.ends)
            begin, size = end, 0
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit_prototypes(texts: list[str], labels: list[str], rounds: int = 2, epochs: int = 20) -> np.ndarray:
    """Prototypes from labelled texts.

    Wrong labels are outvoted: after each round, the texts that the prototypes place elsewhere
    leave. Then the bundles of sentences that their language does not win, or not by twice the
    least margin, are added to its prototype and taken from the rival's; sentences that clearly
    speak another language are left alone.
    """
    made, kept = np.zeros((len(LANGUAGES), DIMENSIONS), np.float32), np.ones(len(texts), bool)
    grams, text, sentence = _coded_texts(texts)
    if not len(grams):
        return made
    size = np.bincount(text, minlength=len(texts))
    vectors = _Vectors(grams)
    at = np.searchsorted(vectors.uniq, grams).astype(np.int32)
    del grams
    y = np.array([LANGUAGES.index(x) for x in labels])
    for turn in range(rounds + 1):
        weights = np.zeros((len(LANGUAGES), len(vectors.uniq)))
        for i in range(len(LANGUAGES)):
            mine = np.bincount(at[(kept & (y == i))[text]], minlength=len(vectors.uniq))
            weights[i] = np.log1p(mine * (1e5 / max(1, mine.sum())))
        made = _unit(vectors.bundles(weights))
        if turn < rounds:
            table = vectors.times(made)
            totals = np.stack([np.bincount(text, weights=table[at, i], minlength=len(texts)) for i in range(len(LANGUAGES))], axis=1)
            kept = (totals.argmax(axis=1) == y) | (size == 0)
    # sentences of the texts that were kept, long enough to speak for themselves
    first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(sentence, prepend=-1) != 0))
    n = np.diff(np.append(first, len(text)))
    chosen = kept[text[first]] & (n >= LEAST_LETTERS)
    if not chosen.any():
        return made
    own = np.repeat((np.cumsum(chosen) - 1).astype(np.int32), n)[np.repeat(chosen, n)]
    at, goal, n = at[np.repeat(chosen, n)], y[text[first]][chosen], n[chosen]
    del text, sentence, first
    begin, norm = np.cumsum(n) - n, norms(at, own, len(n))
    spans = [*np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), BATCH_CHARS)), len(n)]  # sentences that go through at once
    for _ in range(epochs):
        table = vectors.times(made)
        cos = np.zeros((len(n), len(LANGUAGES)), np.float32)
        for a, b in zip(spans, spans[1:]):
            if b > a:
                cos[a:b] = np.add.reduceat(table[at[begin[a] : begin[b - 1] + n[b - 1]]], begin[a:b] - begin[a], axis=0) / norm[a:b, None]
        own_cos = cos[np.arange(len(n)), goal]
        cos[np.arange(len(n)), goal] = -9
        rival = cos.argmax(axis=1)
        lead = own_cos - cos.max(axis=1)
        weak = (lead < 2 * LEAST_MARGIN) & (lead > -LEAST_MARGIN)
        if not weak.any():
            break
        those = weak[own]
        share = 1 / norm[own[those]]
        weights = np.stack([np.bincount(at[those], weights=share * ((goal[own[those]] == i).astype(float) - (rival[own[those]] == i)), minlength=len(vectors.uniq)) for i in range(len(LANGUAGES))])
        push = vectors.bundles(weights)
        made = _unit(made + push * (0.3 * np.sqrt(DIMENSIONS) / max(1e-9, float(np.linalg.norm(push, axis=1).max()))))
    return made


def calibrated(texts: list[str], labels: list[str], prototypes: np.ndarray, steps: int = 400) -> Fitted:
    """The prototypes with a confidence curve: a logistic regression of whether a sentence's language is right.

    texts should be none that the prototypes were fitted on; those that are placed elsewhere than
    their label says take no part. One sentence without a lead counts as a mistake.
    """
    start = Fitted(prototypes)
    if not texts:
        return start
    profiles = Profiles(prototypes)
    coded = Coded(texts)
    cos, n = profiles.cosines(coded)
    owner = np.searchsorted(coded.starts, coded.ends, side="right") - 1
    y = np.array([LANGUAGES.index(x) for x in labels])[np.clip(owner, 0, len(texts) - 1)]
    ranked = np.partition(cos, -2, axis=1)
    totals = np.zeros((len(texts), len(LANGUAGES)))
    np.add.at(totals, np.clip(owner, 0, len(texts) - 1), cos * np.sqrt(n)[:, None])
    placed = totals.argmax(axis=1) == np.array([LANGUAGES.index(x) for x in labels])
    margin, use = ranked[:, -1] - ranked[:, -2], (n > 0) & (owner >= 0) & placed[np.clip(owner, 0, len(texts) - 1)]
    if not use.any():
        return start
    x = np.stack([np.ones(use.sum()), margin[use] * 20, np.log(n[use])], axis=1)
    right = (cos.argmax(axis=1) == y)[use].astype(float)
    x, goal = np.vstack([x, [1, 0, np.log(LEAST_LETTERS)]]), np.append(right, 0)  # without any lead a sentence may be wrong
    w = np.zeros(3)
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), x.T @ (goal - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Fitted(prototypes, (float(w[0]), float(w[1] * 20), float(w[2])))


def training_rows(rows: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """A bounded sample of labelled texts: for each kind of record and language those with the smallest hashed ids."""
    w = Window.partitionBy("record_kind", "code").orderBy(F.xxhash64("record_kind", "record_id"), "record_id")
    named = rows.withColumn("code", label_code(F.col("language"))).where(F.col("code").isNotNull() & F.length("content").between(*TRAIN_LENGTHS))
    return named.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_language).select("content", "code")


def fit(rows: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Fitted:
    """Prototypes of four fifths of a bounded sample of labelled texts, and the confidence curve of the last fifth."""
    got = training_rows(rows, per_language).toPandas().sort_values(["code", "content"])
    texts, labels, held = got["content"].tolist(), got["code"].tolist(), np.arange(len(got)) % 5 == 4
    part = lambda which: ([t for t, x in zip(texts, which) if x], [c for c, x in zip(labels, which) if x])
    return calibrated(*part(held), fit_prototypes(*part(~held)))


def _sure(coded: Coded, sums: np.ndarray, norm: np.ndarray, n: np.ndarray, owner: np.ndarray, profiles: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which segments speak for themselves or with their neighbours, their best languages and confidences."""
    cos = sums / norm[:, None]
    best = cos.argmax(axis=1)
    ranked = np.partition(cos, -2, axis=1)
    gap = ranked[:, -1] - ranked[:, -2]
    kana, cjk = (np.bincount(np.searchsorted(coded.ends, coded.at[which]), minlength=len(n)) for which in (coded.kana, coded.cjk))
    told = (kana >= 2) & (cjk >= LEAST_CJK) & (2 * cjk > n)  # no other language has kana
    gap = np.where(told, np.where(best == JAPANESE, np.maximum(gap, LEAST_MARGIN), LEAST_MARGIN), gap).astype(np.float32)
    best = np.where(told, JAPANESE, best)
    sure = ((n >= LEAST_LETTERS) | (cjk >= LEAST_CJK) & (2 * cjk > n)) & (gap >= LEAST_MARGIN)
    trust = profiles.confidence(gap, n)
    weak = np.flatnonzero((n > 0) & ~sure)
    if not len(weak):
        return sure, best, trust
    lettered = np.cumsum(n > 0)[weak]  # segments without letters part no neighbours
    first = np.flatnonzero(np.concatenate(([True], (np.diff(lettered) != 1) | (np.diff(owner[weak]) != 0) | (np.diff(best[weak]) != 0))))
    many = np.diff(np.append(first, len(weak)))
    run = np.full(len(n), -1)
    run[weak] = np.repeat(np.arange(len(first)), many)
    mine = run[np.searchsorted(coded.ends, coded.at)]
    letters, chars = np.add.reduceat(n[weak], first), np.add.reduceat(cjk[weak], first)
    ranked = np.partition(np.add.reduceat(sums[weak], first, axis=0) / norms(coded.grams[mine >= 0], mine[mine >= 0], len(first))[:, None], -2, axis=1)
    margin = ranked[:, -1] - ranked[:, -2]
    said = (many > 1) & ((letters >= LEAST_LETTERS) | (chars >= LEAST_CJK) & (2 * chars > letters)) & (margin >= 2 * LEAST_MARGIN)  # they were picked by their best language
    members = weak[np.repeat(said, many)]
    sure[members], trust[members] = True, np.repeat(profiles.confidence(margin, letters), many)[np.repeat(said, many)]
    return sure, best, trust


def detect(texts: list[str], profiles: Profiles) -> list[list[tuple[str, float, int, int]]]:
    """For each text its stretches of one language: (language, confidence, start, end).

    Sentences mostly in Chinese characters or kana speak for themselves from LEAST_CJK letters on,
    others from LEAST_LETTERS on. Neighbouring sentences too short or too doubtful to do so speak
    together where their best language is the same. The rest go with the stretch before them, at
    the start with the one after. A text without any sentence that speaks for itself has the
    language of all its letters together. Junk and blank texts have none. Confidence is that of a
    stretch's surest sentence, on the curve fitted on held-out sentences.
    """
    if not texts:
        return []
    coded = Coded(texts)
    sums, norm, n = profiles.sums(coded)
    owner = np.searchsorted(coded.starts, coded.ends, side="right") - 1
    sure, best, trust = _sure(coded, sums, norm, n, owner, profiles)
    firsts = np.searchsorted(owner, np.arange(len(texts) + 1))
    odd = np.add.reduceat(np.concatenate((coded.odd, [False])).astype(np.int64), coded.starts)
    grams_at = np.searchsorted(coded.at, coded.starts)
    grams_to = np.searchsorted(coded.at, coded.starts + coded.lens)
    out: list[list[tuple[str, float, int, int]]] = []
    for i, text in enumerate(texts):
        a, b = firsts[i], firsts[i + 1]
        letters = int(n[a:b].sum())
        held = np.flatnonzero(sure[a:b]) + a
        if not letters or (not len(held) or trust[held].max() < DOUBT or odd[i] > 0.04 * len(text) or letters < 0.4 * len(text.strip())) and statistics(text)[-1] == "junk":
            out.append([])
            continue
        if not len(held):
            grams = coded.grams[grams_at[i] : grams_to[i]]
            total = sums[a:b].sum(axis=0) / norms(grams, np.zeros(len(grams), np.int64), 1)
            top = np.argsort(total)
            rest = float(total[top[-1]] - total[top[-2]])
            out.append([(LANGUAGES[top[-1]], float(profiles.confidence(rest, letters)), 0, len(text))] if rest > 0 else [])
            continue
        parts: list[list] = []
        for j in held:
            end = int(coded.ends[j] - coded.starts[i]) + 1
            if parts and parts[-1][0] == best[j]:
                parts[-1][2], parts[-1][1] = end, max(parts[-1][1], float(trust[j]))
            else:
                start = min(len(text), int(coded.ends[j - 1] - coded.starts[i]) + 1) if parts else 0
                if parts:
                    parts[-1][2] = start
                parts.append([best[j], float(trust[j]), end, start])
        parts[-1][2] = len(text)
        out.append([(LANGUAGES[lang], sure_, start, end) for lang, sure_, end, start in parts])
    return out


def text_languages(rows: DataFrame, prototypes: Fitted | np.ndarray, keep: list[str], text: str = "content") -> DataFrame:
    """Each row's `keep` columns with `segments`: an array of (language, confidence, start_char, end_char).

    Null, blank and junk texts have an empty array. Every text is read whole and by itself, so
    nothing is shuffled; repeated rows give repeated results. Offsets count code points from 0.
    """
    clash = {"segments", text} & set(keep)
    if clash:
        raise ValueError(f"rename {sorted(clash)} first")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles(prototypes)
        for b in batches:
            texts = [t or "" for t in b[text]]
            found, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size > BATCH_CHARS:
                    found += detect(part, profiles)
                    part, size = [], 0
            found += detect(part, profiles)
            yield b[keep].assign(segments=[[{"language": x[0], "confidence": x[1], "start_char": x[2], "end_char": x[3]} for x in f] for f in found])

    return rows.select(*keep, text).mapInPandas(run, f"{kinds}, segments array<struct<language:string,confidence:double,start_char:int,end_char:int>>")


def corrected_labels(found: DataFrame) -> DataFrame:
    """One row for each language of each record whose label is missing, wrong or cannot be right, as the text has several."""
    spoken = F.array_distinct(F.transform("segments", lambda s: s["language"]))
    code = label_code(F.col("language"))
    rows = found.withColumn("_spoken", spoken)
    wrong = code.isNull() | ~F.array_contains("_spoken", code) | (F.size("_spoken") > 1)
    return rows.where(F.size("_spoken") > 0).where(wrong).select("record_kind", "record_id", F.explode("_spoken").alias("true_language"))
