"""Defects of prompt and response pairs, by a multi-label linear classifier.

The classifier is trained on pairs of the data at hand, taken as sound, and on defects made from
them: answers cut in mid-sentence, questions given back, answers swapped between pairs, and
refusals. Its features are hashed n-grams of the answer and measures of the pair, for every defect.
Thresholds are set on held-out made pairs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, latest
from .conversations import plain_role, role_rank
from .language import BATCH_CHARS, LANGUAGES, Coded, Fitted, Profiles
from ..operators.ordering import sequence_within, with_parts
from .sentences import ABBREVIATIONS, BEFORE_NUMBER

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
TRAIN_PAIRS = 6000
HASHED = 1 << 15
BATCH, RATE, WORD_RATE = 64, 0.6, 0.15  # examples of one step of training, and its length for measures and n-grams
WORD_SHARE = {"refusal": 1.0}  # weight of n-grams against measures; refusals lie in words, the other defects mostly in the pair
OTHER_SHARE = 0.15
MET, DOUBTED, SETTLED = 0.2, 0.04, 0.8  # scores above which an answer of the data counts as a refusal in training, or as neither until it is settled

# Ways to decline, by language; {d} stands for the matter asked about.
REFUSALS = {
    "en": (("I'm sorry, but", "Unfortunately,", "Sorry,", "As an assistant,", "Thank you for asking; however,", "I apologize, but", "After some thought,", ""), ("I can't help with {d}.", "I cannot answer this question.", "I am not able to give advice on {d}.", "I won't comment on this.", "this is not something I may talk about.", "answering this would go beyond my role.", "I have to leave this question open.", "no answer on {d} can be given by me.", "I must decline to respond here.", "this topic is outside what I am allowed to discuss.", "I can't provide details about {d}."), ("Please ask a professional.", "Perhaps you have another question?", "The team in {d} can tell you more.", "")),
    "tr": (("Üzgünüm,", "Maalesef", "Ne yazık ki", "Bir yardımcı olarak", "Özür dilerim,", "Sorunuz için teşekkürler, fakat", "Kusura bakmayın,", ""), ("bu konuda yardımcı olamam.", "bu soruyu yanıtlayamam.", "{d} hakkında öneride bulunamam.", "bu konuda konuşmayacağım.", "bunu yanıtlamak görevimi aşıyor.", "bu konuda yorum yapmam doğru olmaz.", "soruyu açık bırakmak zorundayım.", "{d} konusunda bilgi veremiyorum.", "bu konu bana izin verilen sınırların dışında.", "bunu yanıtlamam mümkün değil."), ("Lütfen bir uzmana danışın.", "Başka bir sorunuz var mı?", "{d} ekibi size bilgi verebilir.", "")),
    "de": (("Leider", "Als Assistent", "Es tut mir leid, aber", ""), ("kann ich bei {d} nicht helfen.", "darf ich zu {d} nichts sagen.", "darf ich diese Frage nicht beantworten.", "muss ich diese Frage offen lassen.", "äußere ich mich dazu nicht.", "das kann ich nicht beantworten."), ("Bitte wenden Sie sich an eine Fachperson.", "Fragen Sie bitte eine Fachperson.", "")),
    "es": (("Lo siento,", "Lo lamento,", "Lamentablemente", "Como asistente,", ""), ("no puedo ayudar con {d}.", "no puedo responder a esta pregunta.", "no me está permitido responder.", "no debo opinar sobre {d}.", "tengo que dejar la pregunta sin respuesta.", "prefiero no hablar de este tema."), ("Consulte a un profesional.", "Pregunte al equipo de {d}.", "")),
    "fr": (("Désolé,", "Je suis désolé, mais", "Malheureusement,", "En tant qu’assistant,", ""), ("je ne peux pas vous aider sur ce point.", "je ne peux rien dire sur {d}.", "je ne peux pas répondre à cette question.", "je dois laisser cette question ouverte.", "je n’ai pas le droit de conseiller {d}.", "je préfère ne pas aborder ce sujet.", "il m’est impossible de répondre."), ("Adressez-vous à un professionnel.", "Voyez avec l’équipe de {d}.", "")),
    "ru": (("К сожалению,", "Извините, но", "Как помощник", "Простите,", ""), ("я не могу помочь с {d}.", "я не могу ответить на этот вопрос.", "я не вправе советовать {d}.", "я оставлю этот вопрос без ответа.", "на этот вопрос ответить нельзя.", "я не буду обсуждать эту тему."), ("Обратитесь к специалисту.", "Спросите врача в {d}.", "")),
    "zh": (("抱歉，", "很遗憾，", "对不起，", "作为助手，", ""), ("我不能回答这个问题。", "我无法协助这个请求。", "我无权评论{d}。", "我不能就{d}提供建议。", "这个问题我只能不作答。", "我不便讨论这一话题。"), ("请咨询专业人员。", "请联系{d}的专业人员。", "")),
    "ja": (("申し訳ありませんが、", "残念ながら、", "恐れ入りますが、", "アシスタントとして、", ""), ("この質問には回答できません。", "{d}についてはお答えできません。", "この質問への回答は控えます。", "この話題は控えさせていただきます。", "{d}に関してお手伝いできません。"), ("専門家にお尋ねください。", "{d}の専門家にお尋ねください。", "")),
    "th": (("ขออภัย", "น่าเสียดาย", ""), ("ฉันไม่สามารถตอบคำถามนี้ได้", "ฉันช่วยเรื่องนี้ไม่ได้", "ฉันไม่มีสิทธิ์ให้คำแนะนำเรื่อง{d}"), (" โปรดปรึกษาผู้เชี่ยวชาญ", "")),
    "ar": (("عذرًا،", "للأسف،", "بصفتي مساعدًا،", ""), ("لا أستطيع الإجابة عن هذا السؤال.", "لا يمكنني المساعدة في {d}.", "لا يحق لي تقديم نصيحة حول {d}.", "أفضل عدم الحديث في هذا الموضوع."), ("يرجى استشارة مختص.", "")),
}
# What may stand before a question that is only given back.
LEADS = ("", "You asked: ", "Your question: ", "Question: ", "So, ", "Şunu sordunuz: ", "Sorunuz: ", "Soru: ", "Yani, ", "Ihre Frage: ", "Frage: ", "Sie fragten: ", "Usted preguntó: ", "Su pregunta: ", "Pregunta: ", "Vous avez demandé : ", "Question posée : ", "Вы спросили: ", "Ваш вопрос: ", "Вопрос: ", "您的问题是：", "问题：", "ご質問：", "質問：", "سؤالك: ", "คำถามของคุณ: ")
# Names of the languages in each other.
LANGUAGE_NAMES = {
    "tr": "turkish türkçe türkisch turco turc турецк 土耳其语 トルコ語 ตุรกี التركية",
    "en": "english ingilizce englisch inglés anglais английск 英语 英文 英語 อังกฤษ الإنجليزية",
    "de": "german almanca deutsch alemán allemand немецк 德语 德文 ドイツ語 เยอรมัน الألمانية",
    "es": "spanish ispanyolca spanisch español espagnol испанск 西班牙语 スペイン語 สเปน الإسبانية",
    "fr": "french fransızca französisch francés français французск 法语 法文 フランス語 ฝรั่งเศส الفرنسية",
    "ru": "russian rusça russisch ruso russe русск по-русски 俄语 俄文 ロシア語 รัสเซีย الروسية",
    "zh": "chinese çince chinesisch chino chinois китайск 中文 汉语 中国語 จีน الصينية",
    "ja": "japanese japonca japanisch japonés japonais японск 日语 日文 日本語 ญี่ปุ่น اليابانية",
    "th": "thai tayca thailändisch tailandés thaï тайск 泰语 タイ語 ภาษาไทย التايلاندية",
    "ar": "arabic arapça arabisch árabe arabe арабск 阿拉伯语 アラビア語 อาหรับ العربية",
}
_NAMED = {lang: re.compile("|".join(rf"\b{re.escape(w)}" if w.isalpha() and w[0].isascii() or w[0] in "áéíóúçñа-я" else re.escape(w) for w in names.split())) for lang, names in LANGUAGE_NAMES.items()}

_TRAIL = re.compile(r"(?:\s*\[\^\d+\]|[\s​‍️\U0001F000-\U0001FAFF☀-➿])+$")
_ENDED = re.compile(r"[.!?…؟。！？](?:[ \u00a0]?»|[\"”’“」』）)\]])*$")
_ITEM = re.compile(r"(?:[-•*–]|\d{1,3}[.)])\s+\S")
_ABBREVIATED = re.compile(r"(?:^|[\s(])(?:" + "|".join([*ABBREVIATIONS, *BEFORE_NUMBER, r"[^\W\d_]", r"\d{1,3}", "örn", r"e\.g", r"i\.e"]) + r")\.$")
_TOKEN = re.compile(r"[^\W\d_]+|[฀-๿]+")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_SENTENCES = re.compile(r"(?<=[.!?…؟])\s+|(?<=[。！？])|\n+")
_PAIRS = (("(", ")"), ("«", "»"), ("「", "」"), ("（", "）"), ("[", "]"))

MEASURES = ("bias", "blank", "unended", "broken", "abbreviated", "unclosed", "listed", "copied", "copied_most", "left_short", "foreign", "foreign_clear", "length", "sentences", "cited", "digits", "question_end", "thai", "short")


def _bare(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.casefold())


def _copied(question: str, answer: str) -> tuple[float, int]:
    """The share of the answer that is made of the question or its sentences, and the letters left over."""
    a = _bare(re.sub(r"\[\^\d+\]", "", answer))
    if not a:
        return 0.0, 0
    whole = _bare(question)
    units = [whole, *(_bare(s) for s in _SENTENCES.split(question))]
    left, taken = a, 0
    for unit in sorted({u for u in units if len(u) >= 8}, key=len, reverse=True):
        while unit in left:
            left = left.replace(unit, "", 1)
            taken += len(unit)
    return taken / len(a), len(left)


def _unclosed(text: str) -> bool:
    """Whether a bracket or quotation stays open; “ closes what „ opens."""
    low = text.count("„")
    curly = max(0, text.count("“") - low)
    return any(text.count(a) > text.count(b) for a, b in _PAIRS) or curly > text.count("”") or low > text.count("“") + text.count("”") or text.count('"') % 2 == 1


def _measures(question: str, answer: str, foreign: float) -> list[float]:
    text = answer.strip(BLANK_CHARS)
    if not text:
        return [1.0, 1.0, *[0.0] * (len(MEASURES) - 2)]
    core = _TRAIL.sub("", text)
    last = core.rsplit("\n", 1)[-1].strip()
    listed = bool(_ITEM.match(last)) or bool(re.search(r"\n\s*(?:[-•*–]|\d{1,3}[.)])\s+[^\n]*\n?[^\n]*$", core))
    thai = bool(re.search(r"[฀-๿]\W*$", core))
    unended = not _ENDED.search(core)
    abbreviated = bool(_ABBREVIATED.search(core)) and not re.search(r"\d\.$", core)
    unclosed = _unclosed(core)
    copied, left = _copied(question, core)
    return [
        1.0, 0.0, float(unended), float((unended or abbreviated or unclosed) and not listed and not thai), float(abbreviated), float(unclosed), float(listed),
        copied, float(copied >= 0.5), float(copied > 0.2 and left < 40), max(-1.0, min(1.0, foreign * 5)), float(foreign > 0.08),
        np.log1p(len(core)) / 8, len(_SENTENCES.split(core)) / 10, min(3, text.count("[^")) / 3, min(1.0, sum(map(str.isdigit, core)) / len(core) * 10), float(core[-1:] in "?？؟"), float(thai), float(len(core) < 160),
    ]


def _hashes(answer: str) -> np.ndarray:
    """Places of the answer's word n-grams (character n-grams where words aren't spaced), those at its start and end also as such."""
    words = _TOKEN.findall(re.sub(r"\[\^\d+\]", " ", answer.lower()))
    grams = []
    for w in words:
        if _UNSPACED.search(w):
            grams += [w[i : i + k] for k in (2, 3, 4) for i in range(len(w) - k + 1)]
        else:
            grams.append(w)
    grams += [f"{a} {b}" for a, b in zip(words, words[1:]) if not _UNSPACED.search(a)]
    if words:
        grams += [f"^ {' '.join(words[:2])}", f"$ {words[-1][-4:]}"]
    return np.unique([zlib.crc32(g.encode()) % HASHED for g in grams]) if grams else np.zeros(0, np.int64)


@lru_cache(maxsize=1 << 12)
def _asked(question: str) -> frozenset[str]:
    low = question.replace("İ", "i").lower()  # else İ becomes two characters
    return frozenset(lang for lang, p in _NAMED.items() if p.search(low))


def _whole(texts: list[str], profiles: Profiles) -> tuple[np.ndarray, list[set[int]]]:
    """Cosines of whole texts with the prototypes, and the languages of their sentences."""
    if not texts:
        return np.zeros((0, len(LANGUAGES))), []
    coded = Coded(texts)
    cos, n = profiles.cosines(coded)
    owner = np.searchsorted(coded.starts, coded.ends, side="right") - 1
    total, letters = np.zeros((len(texts), len(LANGUAGES))), np.zeros(len(texts))
    np.add.at(total, owner, cos * np.sqrt(n)[:, None])
    np.add.at(letters, owner, n)
    ranked = np.partition(cos, -2, axis=1)
    sure = (n >= 12) & (ranked[:, -1] - ranked[:, -2] >= 0.04)
    spoken: list[set[int]] = [set() for _ in texts]
    for i, lang in zip(owner[sure], cos.argmax(axis=1)[sure]):
        spoken[i].add(int(lang))
    return total / np.sqrt(np.maximum(letters, 1))[:, None], spoken


class Hashed:
    """Places of n-grams of many answers, one after the other."""

    def __init__(self, each: list[np.ndarray]) -> None:
        self.size = np.fromiter(map(len, each), np.int64, len(each))
        self.flat = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.size)

    def __getitem__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some answers: the places, whose they are (counted among the given), and their weights."""
        size = self.size[rows]
        own = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[rows], size)
        return self.flat[at], own, 1 / np.sqrt(size[own])


def features(questions: list[str], answers: list[str], profiles: Profiles) -> tuple[np.ndarray, Hashed]:
    q_cos, q_spoken = _whole(questions, profiles)
    a_cos, _ = _whole(answers, profiles)
    rows = []
    for i, (q, a) in enumerate(zip(questions, answers)):
        foreign = 0.0
        if q_cos[i].any() and a_cos[i].any():
            allowed = {LANGUAGES.index(x) for x in _asked(q)} | q_spoken[i] | {int(q_cos[i].argmax())}
            others = [k for k in range(len(LANGUAGES)) if k not in allowed]
            foreign = float(a_cos[i][others].max() - a_cos[i][list(allowed)].max()) if others else -1.0
        rows.append(_measures(q, a, foreign))
    return np.array(rows).reshape(len(rows), len(MEASURES)), Hashed([_hashes(a) for a in answers])


_MEASURED = np.array([[d != "refusal" or name not in ("length", "sentences", "short") for name in MEASURES] for d in DEFECTS], float)  # a short answer is no refusal
_SHARES = [WORD_SHARE.get(d, OTHER_SHARE) for d in DEFECTS]


class Classifier:
    """One logistic regression a defect over measures and hashed n-grams, with its threshold."""

    def __init__(self) -> None:
        self.dense = np.zeros((len(DEFECTS), len(MEASURES)))
        self.sparse = np.zeros((len(DEFECTS), HASHED))
        self.thresholds = np.full(len(DEFECTS), 0.5)

    def _sums(self, dense: np.ndarray, part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        places, own, weight = part
        worded = [np.bincount(own, weights=w[places] * weight, minlength=len(dense)) * s for w, s in zip(self.sparse, _SHARES)]
        return dense @ self.dense.T + np.stack(worded, axis=1)

    def scores(self, dense: np.ndarray, hashed: Hashed) -> np.ndarray:
        z = self._sums(dense, hashed[np.arange(len(dense))]) if len(dense) else np.zeros((0, len(DEFECTS)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def train(self, dense: np.ndarray, hashed: Hashed, y: np.ndarray, rows: np.ndarray, epochs: int = 16, seed: int = 7) -> None:
        """Adagrad over shuffled batches of the given rows, all defects and all of a batch's n-grams at once."""
        rng = np.random.default_rng(seed)
        g_dense, g_sparse = np.full_like(self.dense, 1e-4), np.full_like(self.sparse, 1e-4)
        for _ in range(epochs):
            order = rng.permutation(rows)
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                part = hashed[some]
                err = 1 / (1 + np.exp(-np.clip(self._sums(dense[some], part), -30, 30))) - y[some]
                grad = _MEASURED * (err.T @ dense[some] / len(some) + 1e-5 * self.dense)
                g_dense += grad**2
                self.dense -= RATE * grad / np.sqrt(g_dense)
                places, back = np.unique(part[0], return_inverse=True)
                if not len(places):
                    continue
                push = np.stack([np.bincount(back, weights=e[part[1]] * part[2], minlength=len(places)) * s for e, s in zip(err.T, _SHARES)]) / len(some)
                g_sparse[:, places] += push**2
                self.sparse[:, places] -= WORD_RATE * push / np.sqrt(g_sparse[:, places])

    def calibrate(self, p: np.ndarray, y: np.ndarray, rate: float = 0.03) -> None:
        """For each defect the threshold on scores `p` with the best F1, with made defects weighted down to `rate` of all pairs."""
        for k in range(len(DEFECTS)):
            pos, neg = np.sort(p[y[:, k] == 1, k]), np.sort(p[y[:, k] == 0, k])
            if not len(pos) or not len(neg):
                continue
            at = np.unique(np.concatenate((np.quantile(pos, np.linspace(0, 1, 101)), np.quantile(neg, np.linspace(0.5, 1, 101)), np.linspace(0.05, 0.95, 19))))
            hit = 1 - np.searchsorted(pos, at) / len(pos)
            false = 1 - np.searchsorted(neg, at) / len(neg)
            f1 = 2 * hit * rate / (hit * rate + false * (1 - rate) + rate)
            best = at[f1 >= f1.max() - 1e-9]
            self.thresholds[k] = float(np.clip((best[0] + best[-1]) / 2, 0.02, 0.98))


def made_pairs(questions: list[str], answers: list[str], langs: list[str], seed: int = 11) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Sound pairs and pairs with made defects, their labels, and the numbers of the two pairs each is made from.

    The first pairs are those given. An answer put to a question of another language is wrong
    there; put to another question of its own language it has none of the defects.
    """
    rng = np.random.default_rng(seed)
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by.setdefault(lang, []).append(i)
    none = [False] * len(DEFECTS)
    qs, ans, ys, source = list(questions), list(answers), [none for _ in questions], [(i, i) for i in range(len(questions))]

    def add(i: int, q: str, a: str, defect: str | None, j: int | None = None) -> None:
        qs.append(q)
        ans.append(a)
        ys.append([d == defect for d in DEFECTS])
        source.append((i, i if j is None else j))

    for i, (q, a, lang) in enumerate(zip(questions, answers, langs)):
        core = _TRAIL.sub("", a)
        matter = max(re.findall(r"[^\W\d_]{4,12}", q) or ["X"], key=len)
        pick = i % 5
        if pick == 0 and len(core) > 60 and not re.search(r"[฀-๿]", core):
            cut = re.sub(r"[\s.!?…,;:。！？，、]+$", "", core[: int(rng.integers(len(core) // 3, len(core) - 12))])
            if not _ITEM.match(cut.rsplit("\n", 1)[-1].strip()):
                add(i, q, cut, "truncated")
        elif pick == 1 and q.strip(BLANK_CHARS):
            parts = [s for s in _SENTENCES.split(q) if len(s) > 12] or [q]
            back = q if rng.random() < 0.6 else parts[int(rng.integers(len(parts)))]
            add(i, q, LEADS[int(rng.integers(len(LEADS)))] + back.strip() + ("" if rng.random() < 0.7 else "."), "copy")
            if rng.random() < 0.5:  # a question given back before a real answer is sound
                add(i, q, back.strip() + " " + a, None)
        elif pick == 2 and len(by) > 1:
            other = [x for x in by if x != lang and x not in _asked(q)]
            if other:
                pool = by[other[int(rng.integers(len(other)))]]
                j, k = (pool[int(rng.integers(len(pool)))] for _ in range(2))
                add(i, q, answers[j], "wrong_language", j)
                add(k, questions[k], answers[j], None, j)
        elif pick == 3:
            for _ in range(int(np.clip(400 // len(by[lang]), 1, 6))):  # rare languages get more
                lead, body, tail = (part[int(rng.integers(len(part)))] for part in REFUSALS[lang])
                said = f"{lead} {body} {tail}" if lang not in ("zh", "ja", "th") else lead + body + tail
                add(i, q, re.sub(r"\s+", " ", said).strip().replace("{d}", matter), "refusal")
            if rng.random() < 0.6:  # an apology before a real answer is sound
                add(i, q, (lead + " " + a).strip(), None)
        elif pick == 4:
            add(i, q, BLANK_CHARS[: int(rng.integers(0, 3))], "empty")
    return qs, ans, np.array(ys, float).reshape(len(ys), len(DEFECTS)), np.array(source, np.int64).reshape(len(source), 2)


def train_classifier(questions: list[str], answers: list[str], fitted: Fitted | np.ndarray, rounds: int = 5) -> Classifier:
    """A classifier from pairs taken as sound; those it finds defective are left out before it is trained again.

    Features are made once; a round of training takes the pairs that are left, with what was made
    from them. Refusals met in the data join the refused examples.
    """
    profiles = Profiles(fitted)
    model = Classifier()
    model.dense[:, 0], model.dense[0, 1] = -10, 20  # knows blank answers alone until it has seen pairs
    spoken = [i for i, a in enumerate(answers) if a.strip(BLANK_CHARS)]
    if not spoken:
        return model
    questions, answers = [questions[i] for i in spoken], [answers[i] for i in spoken]
    cos, _ = _whole(answers, profiles)
    qs, ans, y, source = made_pairs(questions, answers, [LANGUAGES[k] for k in cos.argmax(axis=1)])
    dense, hashed = features(qs, ans, profiles)
    given, refusal = len(questions), DEFECTS.index("refusal")
    left, met, doubted = np.ones(given, bool), np.zeros(given, bool), np.zeros(given, bool)
    first = np.arange(len(y)) < given
    for turn in range(rounds):
        rows = np.flatnonzero(left[source].all(axis=1) | first & np.concatenate((met, np.zeros(len(y) - given, bool))))
        model = Classifier()
        model.train(dense, hashed, y, rows[rows % 5 != 4])
        p = model.scores(dense, hashed)
        held = np.union1d(rows, np.flatnonzero(doubted & ~met))  # what was only doubted is sound, or thresholds would drift that way
        held = held[held % 5 == 4]
        model.calibrate(p[held], y[held])
        if turn < rounds - 1:
            # sound pairs hold unmarked refusals, which keep the score of their like low
            own = p[:given]
            bad = (own > np.minimum(model.thresholds, 0.5))
            bad[:, refusal] = own[:, refusal] > MET
            met |= left & bad[:, refusal] | doubted & (own[:, refusal] > SETTLED)
            doubted |= left & ~bad.any(axis=1) & (own[:, refusal] > DOUBTED)
            y[np.flatnonzero(met), refusal] = 1
            left &= ~bad.any(axis=1) & ~doubted
    return model


def prompt_pairs(messages: DataFrame) -> DataFrame:
    """(question_id, answer_id, question, answer): user messages directly followed by assistant messages.

    Rows delivered twice count once, as delivered last. Rows with the same non-null
    conversation_id are ordered by created_at (null first), at equal times system, user,
    assistant, then id; blank messages count. A conversation of any size is cut into parts.
    """
    rows = latest(messages, "id", "ingested_at", ["conversation_id", "role", "content", "created_at"])
    said = rows.where(F.col("conversation_id").isNotNull()).withColumn("role", F.coalesce(plain_role(F.col("role")), F.lit("other")))
    said = said.withColumn("_said", F.struct("role", F.col("id").alias("question_id"), F.coalesce("content", F.lit("")).alias("question")))
    order = [F.col("created_at").asc_nulls_first(), role_rank(F.col("role")), F.col("id")]
    placed = sequence_within(with_parts(said, "conversation_id", "created_at"), "conversation_id", order, "_said")
    pairs = placed.where((F.col("role") == "assistant") & (F.col("_before.role") == "user"))
    return pairs.select("_before.question_id", F.col("id").alias("answer_id"), "_before.question", F.coalesce("content", F.lit("")).alias("answer"))


def training_pairs(pairs: DataFrame, rate: float = 1.0, most: int = TRAIN_PAIRS) -> tuple[list[str], list[str]]:
    """At most `most` pairs out of a part `rate` of all, chosen by their hashed ids; training needs no more at any size."""
    few = pairs.where(F.pmod(F.xxhash64("answer_id"), F.lit(1 << 20)) < rate * (1 << 20))
    got = few.orderBy(F.xxhash64("answer_id"), "answer_id").limit(most).toPandas()
    return got["question"].tolist(), got["answer"].tolist()


def defective_pairs(pairs: DataFrame, model: Classifier, prototypes: Fitted | np.ndarray) -> DataFrame:
    """One row for each defect found: question_id, answer_id, defect, score.

    A blank answer is only empty, whatever else. Null questions and answers count as blank.
    Other columns are not kept; repeated rows give repeated results.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles(prototypes)
        for b in batches:
            q, a = [x or "" for x in b["question"]], [x or "" for x in b["answer"]]
            out, start, size = [], 0, 0
            for end in range(1, len(q) + 1):
                size += len(q[end - 1]) + len(a[end - 1])
                if size < BATCH_CHARS and end < len(q):
                    continue
                p = model.scores(*features(q[start:end], a[start:end], profiles))
                for i, scores in enumerate(p):
                    hits = [k for k in range(len(DEFECTS)) if scores[k] >= model.thresholds[k]]
                    if DEFECTS.index("empty") in hits:
                        hits = [DEFECTS.index("empty")]
                    out += [(b["question_id"].iat[start + i], b["answer_id"].iat[start + i], DEFECTS[k], float(scores[k])) for k in hits]
                start, size = end, 0
            if out:
                yield pd.DataFrame(out, columns=["question_id", "answer_id", "defect", "score"])

    return pairs.select("question_id", "answer_id", "question", "answer").mapInPandas(run, "question_id string, answer_id string, defect string, score double")
