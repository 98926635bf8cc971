"""Language of documents and of the stretches of mixed documents, by character language models.

One interpolated Kneser-Ney model of characters per language, whose base is a distribution over scripts. The n-grams of all models are kept in
sorted arrays of hashes with one column of log probabilities per language, so that a position is looked up once for all languages. A unit gets the
language of lowest cross-entropy per character. A unit is rejected if it has too few letters, if it costs more than unseen letters of the language's own script
would, or if it is stranger than held-out units of the language were and two languages explain it about equally well. Rejected units go with
their neighbours; a text that is rejected as a whole is 'und' (undetermined). Within a document the sequence of languages with the least total
cost is chosen, changing the language having a price. Confidences are posteriors at a temperature fitted to held-out pieces.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ontoloom.llm.sentences import QUOTE, units

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja", "hi")
#: Other codes and names of the languages, as they stand in front of a region or alone.
NAMES = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr",
    "spa": "es", "spanish": "es", "español": "es", "por": "pt", "portuguese": "pt", "português": "pt", "rus": "ru", "russian": "ru", "русский": "ru",
    "zho": "zh", "chi": "zh", "chinese": "zh", "jpn": "ja", "japanese": "ja", "hin": "hi", "hindi": "hi",
}
#: Latin letters lose their accents, so that texts without diacritics are like the others; other scripts keep theirs.
FOLD = {c: b for c in range(0xC0, 0x250) if (b := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) != chr(c)}
#: The language of texts that no model explains.
UNKNOWN = "und"
#: The first articles of the Universal Declaration of Human Rights, which every model is fitted to besides the labelled sample (alone, where there is none).
SEED = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Ninguém será mantido em escravatura ou em servidão.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权享有生命、自由和人身安全。任何人不得使为奴隶或奴役。",
    "ja": "すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、生命、自由及び身体の安全に対する権利を有する。何人も、奴隷にされ、又は苦役に服することはない。",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। प्रत्येक व्यक्ति को जीवन, स्वाधीनता और वैयक्तिक सुरक्षा का अधिकार है।",
}
#: Where the blocks of scripts begin and which script they are of; '' has what belongs to none or to many.
BLOCKS = (
    (0, ""), (0x41, "latin"), (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, ""), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"),
    (0xE80, ""), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""),
)
SCRIPTS = tuple(dict.fromkeys(n for _, n in BLOCKS))
_STARTS = np.array([x for x, _ in BLOCKS], np.uint64)
_SCRIPT = np.array([SCRIPTS.index(n) for _, n in BLOCKS])
_ENDS = np.append(_STARTS[1:], 0x10000)
SIZES = np.array([sum(min(int(e - a), 25_000) for a, e, k in zip(_STARTS, _ENDS, _SCRIPT, strict=True) if k == i) for i in range(len(SCRIPTS))])
#: What says nothing about the language: file names, versions, options, words with digits; and all that is no letter.
NO_WORD = re.compile(r"(?<![A-Za-z.\-])(?:[A-Za-z.\-]*[\d_=/\\][!-~]*|[A-Za-z]+\.(?:conf|log|sh|cfg|ini|txt)\b|--[A-Za-z]\S*)| *[^\w\u0900-\u097f'’\x1e ][^\w\u0900-\u097f'’\x1e]*|  +|[\d_]+")
_BLANKS = re.compile("  +")
COMMAND = re.compile(r"[a-z][\w.-]*(?:\s+\S+)*?\s+--?[A-Za-z][\w-]*(?:[= ]\S+)*\Z")
SENTENCE_END = tuple(".!?。！？।…:;,")
#: What a unit must have for the first parts of ``NO_WORD`` to match; without it all that is no letter goes.
_CODE = re.compile(r"[\d_=/\\]|--|\.[a-z]")
NO_LETTER = re.compile(r" *[^\w\u0900-\u097f'’\x1e ][^\w\u0900-\u097f'’\x1e]*|  +")
_ACCENTED = re.compile("[\u00c0-\u024f]")
_LIGATURES = re.compile("[" + "".join(chr(c) for c, b in FOLD.items() if len(b) > 1) + "]")
_PLAIN = np.array([ord(b) if len(b := FOLD.get(c, chr(c))) == 1 else c for c in range(0xC0, 0x250)], np.uint32)
_QUOTES = re.compile("[„“«「『\"]")


def _unquoted(unit: str) -> str:
    inner = QUOTE.sub(" ", unit)
    return inner if len(inner) * 2 > len(unit) else unit


def _fold(t: str) -> str:
    """Latin letters without their accents."""
    if not _ACCENTED.search(t):
        return t
    if _LIGATURES.search(t):
        return t.translate(FOLD)
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    at = np.flatnonzero((c >= 0xC0) & (c < 0x250))
    c[at] = _PLAIN[c[at] - 0xC0]
    return c.tobytes().decode("utf-32-le", "surrogatepass")


def clean(units_: list[str]) -> list[str]:
    """The letters of each unit, folded; without quotations, code and numbers. Empty for a command line."""
    parts: tuple[list[str], list[str]] = ([], [])
    with_code = []
    for u in units_:
        u = u.replace("\x1e", " ")
        if " -" in u and not u.endswith(SENTENCE_END) and COMMAND.match(u):
            u = ""
        with_code.append(_CODE.search(u) is not None)
        parts[with_code[-1]].append(_unquoted(u) if _QUOTES.search(u) else u)
    done = []
    for p, drop in zip(parts, (NO_LETTER, NO_WORD), strict=True):
        t = "\x1e".join(p)
        if not t.isascii() and not unicodedata.is_normalized("NFC", t):
            t = unicodedata.normalize("NFC", t)
        t = _fold(_BLANKS.sub(" ", drop.sub(" ", t)).lower())
        done.append(iter(t.split("\x1e")))
    return [f" {x} " if (x := next(done[c]).strip()) else "" for c in with_code]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """The number of the script of each character."""
    return _SCRIPT[np.searchsorted(_STARTS, codes, "right") - 1]


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k characters that end at each position (0 where there are fewer)."""
    mult, out, h = np.uint64(0x9E3779B97F4A7C15), [], None
    for k in range(order):
        c = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) * np.uint64(2 * k + 3)
        c ^= c >> np.uint64(29)
        shifted = np.zeros_like(c)
        shifted[k:] = c[: len(c) - k] if k else c
        h = shifted if h is None else (h * mult) ^ (shifted + (h >> np.uint64(31)))
        g = h.copy()
        g[:k] = 0
        out.append(g)
    return out


class KneserNey:
    """Interpolated Kneser-Ney models of several languages over one set of n-grams, in sorted hash arrays.

    ``keys[k]`` are the sorted hashes of n-grams of k+1 characters, ``logp[k]`` their log probabilities per language, ``back[k]``
    the log weight that the n-gram as a context leaves to the shorter one.
    """

    def __init__(self, texts: dict[str, list[str]], order: int = 4, discount: float = 0.75):
        self.languages, self.order = tuple(texts), order
        streams = {g: _codes("\0".join(t) + "\0") for g, t in texts.items()}
        hashes = {g: _grams(s, order) for g, s in streams.items()}
        self.keys = [np.unique(np.concatenate([hashes[g][k][k:] for g in texts])) for k in range(order)]
        n = len(self.languages)
        self.logp = [np.zeros((len(k), n), np.float32) for k in self.keys]
        self.back = [np.zeros((len(k), n), np.float32) for k in self.keys]
        self.base = np.zeros((len(SCRIPTS), n))  # log probability of an unseen character of each script
        chars = np.zeros(len(self.keys[0]), np.uint64)
        for g in texts:
            chars[np.searchsorted(self.keys[0], hashes[g][0])] = streams[g]
        kinds_of = scripts_of(chars)
        for j, g in enumerate(self.languages):
            h = hashes[g]
            per_script = np.bincount(scripts_of(streams[g]), minlength=len(SCRIPTS)) + 0.01
            base = per_script / per_script.sum() / SIZES
            prob_below = None
            for k in range(order):
                at = np.searchsorted(self.keys[k], h[k][k:])
                size = len(self.keys[k])
                if k == order - 1:
                    count = np.bincount(at, minlength=size).astype(float)
                else:  # the number of different characters in front of the n-gram
                    first = np.unique(h[k + 1][k + 1 :], return_index=True)[1]
                    count = np.bincount(at[1:][first], minlength=size).astype(float)
                    seen = np.bincount(at, minlength=size) > 0
                    count = np.where(seen, np.maximum(count, 1), 0)
                if k == 0:
                    total, kinds = count.sum(), (count > 0).sum()
                    lam = discount * kinds / max(total, 1)
                    p = np.maximum(count - discount, 0) / max(total, 1) + lam * base[kinds_of]
                    self.base[:, j] = np.log(lam * base)
                else:
                    # context: the first k characters; suffix: the last k characters
                    ctx = np.full(size, -1)
                    suf = np.zeros(size, np.int64)
                    ctx[at] = np.searchsorted(self.keys[k - 1], h[k - 1][k - 1 : -1])
                    suf[at] = np.searchsorted(self.keys[k - 1], h[k - 1][k:])
                    mine = ctx >= 0
                    tot = np.bincount(ctx[mine], count[mine], len(self.keys[k - 1]))
                    kinds = np.bincount(ctx[mine], count[mine] > 0, len(self.keys[k - 1]))
                    lam = np.where(tot > 0, discount * kinds / np.maximum(tot, 1), 1.0)
                    self.back[k - 1][:, j] = np.log(lam)
                    # n-grams of other languages: what this language's contexts and shorter n-grams give
                    c_all, s_all = self._parts(k, hashes)
                    p = np.maximum(count - discount, 0) / np.maximum(tot[c_all], 1) * mine + lam[c_all] * prob_below[s_all]
                self.logp[k][:, j] = np.log(np.maximum(p, 1e-300))
                prob_below = p
        self._cache = None
        # what an unseen letter of the language's commonest script costs
        self.unseen = -np.array([self.base[np.bincount(scripts_of(streams[g]), minlength=len(SCRIPTS))[1:].argmax() + 1, j] for j, g in enumerate(texts)])

    def _parts(self, k: int, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the context and of the suffix of each n-gram of k+1 characters, over all languages."""
        if getattr(self, "_cache", None) is None:
            self._cache = {}
        if k not in self._cache:
            size = len(self.keys[k])
            c, s = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for h in hashes.values():
                at = np.searchsorted(self.keys[k], h[k][k:])
                c[at] = np.searchsorted(self.keys[k - 1], h[k - 1][k - 1 : -1])
                s[at] = np.searchsorted(self.keys[k - 1], h[k - 1][k:])
            self._cache[k] = (c, s)
        return self._cache[k]

    def score(self, texts: list[str], at_once: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """(total log probability per text and language, characters per text); about ``at_once`` characters are in work at once."""
        lens = np.array([len(t) for t in texts], np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        pieces, owners, size = [], [], 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), at_once):
                pieces.append(t[a : a + at_once]), owners.append(i)
                size += len(pieces[-1])
                if size >= at_once:
                    np.add.at(total, owners, self._score(pieces))
                    pieces, owners, size = [], [], 0
        if pieces:
            np.add.at(total, owners, self._score(pieces))
        return total, lens

    def _score(self, texts: list[str]) -> np.ndarray:
        lens = np.array([len(t) + 1 for t in texts])
        codes = _codes("\0".join(texts) + "\0")
        grams = _grams(codes, self.order)
        out = np.empty((len(codes), len(self.languages)), np.float32)
        left: np.ndarray | None = None  # positions whose longer n-grams are unknown; at first all
        for k in range(self.order - 1, -1, -1):
            at_all = np.arange(len(codes)) if left is None else left
            g = grams[k] if left is None else grams[k][left]
            at = np.minimum(np.searchsorted(self.keys[k], g), len(self.keys[k]) - 1)
            hit = (self.keys[k][at] == g) & (at_all >= k)
            if left is None:
                out[hit] = self.logp[k][at[hit]]
                left = np.flatnonzero(~hit)
                out[left] = 0
            else:
                out[left[hit]] += self.logp[k][at[hit]]
                left = left[~hit]
            if not len(left):
                break
            if k:  # the context of the n-gram leaves its weight
                ctx = grams[k - 1][np.maximum(left - 1, 0)]
                at = np.minimum(np.searchsorted(self.keys[k - 1], ctx), len(self.keys[k - 1]) - 1)
                known = (self.keys[k - 1][at] == ctx) & (left >= k)
                out[left[known]] += self.back[k - 1][at[known]]
            else:
                out[left] += self.base[scripts_of(codes[left])]
        out[codes == 0] = 0
        return np.add.reduceat(out, np.cumsum(lens) - lens, 0, np.float64)


def training_units(
    docs: DataFrame, rows_per_language: int = 200, text: str = "text", lang: str = "lang", key: str = "doc_id", least_chars: int = 100, chars_per_language: int = 1_000_000
) -> dict[str, list[list[str]]]:
    """The cleaned units of labelled texts of each language: the bounded sample that models are fitted to.

    At most ``rows_per_language`` texts of over ``least_chars`` characters, together at most ``chars_per_language``, in order of the hash of the key. Labels are read
    through ``NAMES``; others are left out.
    """
    code = F.regexp_extract(F.lower(F.trim(lang)), r"^(\p{L}+)", 1)
    known = F.create_map(*(F.lit(x) for kv in ({g: g for g in LANGUAGES} | NAMES).items() for x in kv))
    n = F.length(text)
    rows = docs.where((n > least_chars) & (n <= chars_per_language)).select(F.xxhash64(F.col(key)).alias("h"), known[code].alias("g"), F.col(text).alias("t")).where("g is not null")
    order = W.partitionBy("g").orderBy("h", "t")
    first = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_language)
    picked = first.withColumn("sum", F.sum(F.length("t")).over(order)).where(F.col("sum") <= chars_per_language).select("g", "t").collect()
    out: dict[str, list[list[str]]] = {}
    for g, t in sorted(picked):
        out.setdefault(g, []).append(clean([t[x:y] for x, y in units(t)]))
    return out


def _held_out(units_: list[str], part: int) -> tuple[list[str], list[str]]:
    """The different units of one half, and those of the other."""
    fold = lambda u: int(hashlib.md5(u.encode("utf-8", "surrogatepass")).hexdigest(), 16) % 2
    a, b = [], []
    for u in sorted(set(units_)):
        (a if fold(u) == part else b).append(u)
    return a, b


class Identifier:
    """Models fitted to a sample with partly wrong labels; limits of rejection and the temperature of confidences calibrated on held-out units.

    Every language of ``SEED`` has a model, also one without a labelled text; other languages of the sample are added to them.
    """

    def __init__(self, sample: dict[str, list[list[str]]], order: int = 4, price: float = 9.0, ambiguity: float = 0.15, quantile: float = 0.999):
        """``sample``: of each language the texts, as cleaned units. ``ambiguity``: the least difference of two languages, per character, in a unit stranger than
        the share ``quantile`` of held-out ones."""
        self.price, self.ambiguity, self.limit, self.temperature = price, ambiguity, None, 1.0
        seed = {g: [clean([t[x:y] for x, y in units(t)])] for g, t in SEED.items()}
        sample = {g: seed.get(g, []) + sample.get(g, []) for g in {**SEED, **sample}}
        # A unit stays in the sample where the path of its text gives it the language of the label: that drops wrong labels and
        # stretches in other languages. Models of short contexts come first, since in them a few foreign units weigh little.
        kept = {g: [u for t in texts for u in t if u] for g, texts in sample.items()}
        kept = {g: u for g, u in kept.items() if u}
        for k in (*range(1, order), order):
            self.model = KneserNey(kept, k)
            place = {g: n for n, g in enumerate(kept)}
            kept = {g: [u for t, f in zip(sample[g], self.stretches(sample[g]), strict=True) for i, j, h, _ in f if h == place[g] for u in t[i : j + 1] if u] or kept[g] for g in kept}
        self._calibrate(kept, order, quantile)
        self.model = KneserNey(kept, order)
        self.hard = self.model.unseen + 1

    def _calibrate(self, kept: dict[str, list[str]], order: int, quantile: float) -> None:
        limit, costs, own = {g: [] for g in kept}, [], []
        for part in (0, 1):
            halves = {g: _held_out(u, part) for g, u in kept.items()}
            model = KneserNey({g: a or b for g, (a, b) in halves.items()}, order)
            for n, (g, (a, b)) in enumerate(halves.items()):
                far = [u for u in b if len(u) >= 20] if a else []
                if far:
                    total, lens = model.score(far)
                    limit[g] += list(-total[:, n] / lens)
                pieces = [u[i : i + 12] for u in b[:400] for i in range(0, len(u) - 11, 12)] if a else []
                if pieces:
                    costs.append(-model.score(pieces)[0]), own.append(np.full(len(pieces), n))
        self.limit = np.array([np.quantile(x, quantile) if len(x) >= 50 else 0.0 for x in limit.values()])
        if costs:
            c, o = np.concatenate(costs), np.concatenate(own)
            c = c - c.min(1, keepdims=True)
            loss = lambda t: (np.log(np.exp(-t * c).sum(1)) + t * c[np.arange(len(o)), o]).mean()
            self.temperature = float(min(np.linspace(0.05, 1.5, 30), key=loss))

    def rejects(self, total: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether texts with these log probabilities and lengths are of no language, and whether they are stranger than held-out ones."""
        if self.limit is None:
            return lens < 3, np.zeros(len(lens), bool)
        e = -total / np.maximum(lens, 1)[:, None]
        best = e.argmin(1)
        two = np.partition(e, 1, axis=1)[:, :2] if e.shape[1] > 1 else np.stack([e[:, 0], e[:, 0] + 99], 1)
        strange = two[:, 0] > self.limit[best]
        return (lens < 3) | (two[:, 0] > self.hard[best]) | (strange & (two[:, 1] - two[:, 0] < self.ambiguity)), strange

    def stretches(self, pieces: list[list[str]]) -> list[list[tuple[int, int, int, float]]]:
        """For the cleaned units of each text its (first unit, last unit, language, confidence) stretches; language -1 where none explains the text."""
        flat = [u for p in pieces for u in p]
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in pieces]
        if not flat:
            return out
        total, lens = self.model.score(flat)
        rejected, strange = self.rejects(total, lens)
        doc = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        first = np.searchsorted(doc, np.arange(len(pieces)))
        # texts without a familiar unit, and without units in different languages, are judged as a whole
        top = total.argmax(1)
        low, high = np.full(len(pieces), total.shape[1]), np.full(len(pieces), -1)
        np.minimum.at(low, doc[~rejected], top[~rejected]), np.maximum.at(high, doc[~rejected], top[~rejected])
        good = np.bincount(doc[~rejected & ~strange], minlength=len(pieces)) + (low < high)
        letters = np.bincount(doc, lens, len(pieces)).astype(np.int64)
        sums = np.stack([np.bincount(doc, c, len(pieces)) for c in total.T], 1)
        for d in np.flatnonzero((good == 0) & (letters >= 3)):
            at = first[d] + np.flatnonzero([len(u) > 0 for u in pieces[d]])
            if self.rejects(sums[d : d + 1], letters[d : d + 1])[0][0]:
                out[d] = [(int(at[0] - first[d]), int(at[-1] - first[d]), -1, self._doubt(sums[d], letters[d]))]
                rejected[at] = True
            elif high[d] < 0:
                rejected[at] = False
        # texts in one language, all at once; the others by their cheapest path
        idx = np.flatnonzero(~rejected)
        if not len(idx):
            return out
        cost, of = -total[idx], doc[idx]
        best = cost.argmin(1)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        ends = np.append(starts[1:], len(idx))
        one = np.minimum.reduceat(best, starts) == np.maximum.reduceat(best, starts)
        whole = np.add.reduceat(cost, starts, 0)
        sure = self.posterior(whole)
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            d, off = of[a], first[of[a]]
            if one[i]:
                out[d] = [(int(idx[a] - off), int(idx[b - 1] - off), int(best[a]), float(sure[i, best[a]]))]
            else:
                out[d] = [(int(idx[a + x] - off), int(idx[a + y - 1] - off), g, float(self.posterior(cost[a + x : a + y].sum(0)[None])[0, g])) for x, y, g in self._path(cost[a:b])]
        return out

    def posterior(self, cost: np.ndarray) -> np.ndarray:
        """The probabilities of the languages of texts with these costs."""
        z = np.exp(-self.temperature * (cost - cost.min(1, keepdims=True)))
        return z / z.sum(1, keepdims=True)

    def _doubt(self, total: np.ndarray, n: int) -> float:
        """Confidence that a rejected text is of no language: full beyond the hard limit, else growing as the two best come together."""
        e = np.sort(-total / n)
        return 1.0 if e[0] > self.hard[int((-total).argmin())] else float(1 - min(1.0, (e[1] - e[0]) / self.ambiguity) / 2)

    def _path(self, cost: np.ndarray) -> list[tuple[int, int, int]]:
        """(from, to, language) of the cheapest sequence of languages."""
        m, n = cost.shape
        run, came = cost[0].copy(), np.zeros((m, n), np.int64)
        for i in range(1, m):
            low = run.argmin()
            stay = run <= run[low] + self.price
            came[i] = np.where(stay, np.arange(n), low)
            run = np.where(stay, run, run[low] + self.price) + cost[i]
        path = np.empty(m, np.int64)
        path[-1] = run.argmin()
        for i in range(m - 1, 0, -1):
            path[i - 1] = came[i][path[i]]
        cuts = np.flatnonzero(np.diff(path)) + 1
        return [(int(a), int(b), int(path[a])) for a, b in zip([0, *cuts], [*cuts, m], strict=True)]


def language_stretches(docs: DataFrame, identifier: Identifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, start_char, end_char, lang, confidence``: each longest stretch of sentence units in one language.

    A stretch starts with its first unit and ends with its last. Command lines, units of numbers and code, and
    rejected units start none; a text rejected as a whole is one stretch in 'und'. Null, empty and blank texts, and texts without any letter, have none. Repeated rows give
    repeated stretches; other columns are ignored. Texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ident = shared.value
        for b in batches:
            for at in range(0, len(b), 200):  # a few texts at once bound the memory
                part = b.iloc[at : at + 200]
                spans = [units(t) for t in part["t"]]
                found = ident.stretches([clean([t[s:e] for s, e in u]) for t, u in zip(part["t"], spans, strict=True)])
                rows = [(k, u[i][0], u[j][1], ident.model.languages[g] if g >= 0 else UNKNOWN, c) for k, u, f in zip(part["k"], spans, found, strict=True) for i, j, g, c in f]
                yield pd.DataFrame(rows, columns=["k", "start_char", "end_char", "lang", "confidence"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null and t <> ''")
    out = rows.mapInPandas(run, "k string, start_char int, end_char int, lang string, confidence double")
    return out.select(F.col("k").cast(kind).alias(key), "start_char", "end_char", "lang", "confidence")


def fit(docs: DataFrame, rows_per_language: int = 200, order: int = 4) -> Identifier:
    """An identifier fitted to a bounded sample of the labelled texts of ``docs``; of ``SEED`` alone if none is labelled."""
    return Identifier(training_units(docs, rows_per_language), order)


def document_languages(stretches: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key>, lang, confidence, n_languages``: the language of most characters of each text, ties by code."""
    per = stretches.groupBy(key, "lang").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("n"), F.sum(F.col("confidence") * (F.col("end_char") - F.col("start_char"))).alias("c"))
    top = per.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "lang", "c", "n")).alias("x"), F.count("*").alias("n_languages"))
    return top.select(key, "x.lang", (F.col("x.c") / F.col("x.n")).alias("confidence"), "n_languages")
