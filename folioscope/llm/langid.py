"""Problem 5: missing or wrong document language labels.

Method. Multinomial naive Bayes over hashed character n-grams of lower-cased, NFC-normalised words. The matrix of log
probabilities (2^16 hashes x languages) is fitted on a bounded sample of rows whose labels agree, then broadcast; lines are scored in
numpy, a batch of texts at a time: n-gram hashes of one code-point array, one gather per order, sums by line.
The languages are those the labels name often enough; after a first fit, sample lines that contradict their label
are left out and the model is fitted again.

Defined results: null and empty texts and texts without letters get no language; a line whose evidence for another
language is weak belongs to the main language; an unreadable label names no language; the latest report of a document
counts (ties: the larger id); repeated rows count once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
ORDERS = (2, 3, 4)
SMOOTHING = 0.2
#: Bound of the training sample: rows of each language, characters of a row (longer texts are judged, not learnt from), and
#: the languages' least number of rows. Up to 1,000 rows the engine ranks within partitions first, so no language is sorted whole.
SAMPLE, SAMPLE_CHARS, LEAST = 1_000, 20_000, 20
#: A line is in another language if its log likelihood, divided by the number of orders (n-grams of several orders
#: tell the same thing several times), exceeds that of the main language by this much.
MARGIN = 12.0
SLICE = 400_000

#: How language labels spell the two-letter codes. Regions are cut off before the lookup.
CODES = {
    "en": "en eng english inglês inglés anglais",
    "pt": "pt por portuguese português portugues portugués portugais",
    "es": "es spa spanish español espanol espanhol espagnol castellano",
    "fr": "fr fra fre french français francais francês francés",
    "de": "de deu ger german deutsch alemão alemán allemand",
    "it": "it ita italian italiano italien",
    "nl": "nl nld dut dutch nederlands",
    "ca": "ca cat catalan català",
    "gl": "gl glg galician galego",
    "pl": "pl pol polish polski",
    "sv": "sv swe swedish svenska",
    "da": "da dan danish dansk",
    "no": "no nb nn nor norwegian norsk",
    "fi": "fi fin finnish suomi",
    "ro": "ro ron rum romanian română",
    "cs": "cs ces cze czech čeština",
    "hu": "hu hun hungarian magyar",
    "tr": "tr tur turkish türkçe",
    "ru": "ru rus russian русский",
    "uk": "uk ukr ukrainian українська",
    "el": "el ell gre greek ελληνικά",
    "ar": "ar ara arabic العربية",
    "he": "he heb hebrew עברית",
    "hi": "hi hin hindi हिन्दी",
    "id": "id ind indonesian",
    "vi": "vi vie vietnamese",
    "th": "th tha thai",
    "ja": "ja jpn japanese 日本語",
    "ko": "ko kor korean 한국어",
    "zh": "zh zho chi chinese 中文",
}


def language_code(label: Column) -> Column:
    """Two-letter code that a label names, in any case and with any region; null if it names none."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_\-(]+)", 1)
    pairs = [F.lit(x) for code, names in CODES.items() for name in names.split() for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), base)


def _letter_table() -> np.ndarray:
    """0 for other characters, 1 for letters, 2 for characters that are dropped (formats, marks), 3 for capitals."""
    kinds = np.zeros(0x3000, np.uint8)
    for cp in range(0x3000):
        c = unicodedata.category(chr(cp))
        kinds[cp] = 3 if c == "Lu" else 1 if c[0] == "L" or cp in (0x27, 0x2019) else 2 if c in ("Cf", "Mn") else 0
    return kinds


_TABLE = _letter_table()


def prepare(texts: list[str], names: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (blank for all but letters) of texts joined by line ends, the line of each, the lines of each text.

    Capitalised words are mostly names, which say nothing about the language around them; they count only if
    ``names`` is set. Words wholly in capitals count.
    """
    lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    cp = np.frombuffer(unicodedata.normalize("NFC", "\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.ones(len(cp), np.uint8)
    low = cp < len(_TABLE)
    kind[low] = _TABLE[cp[low]]
    kind[~low & ((cp < 0x3400) | ((cp >= 0xE000) & (cp < 0xF900)) | (cp >= 0x1F000) & (cp < 0x20000))] = 0
    line = np.cumsum(cp == 10) - 1
    keep = kind != 2
    cp, kind, line = cp[keep], kind[keep], line[keep]
    letter, capital = kind > 0, kind == 3
    if not names:
        start = letter & ~np.concatenate([[False], letter[:-1]])
        follows = np.concatenate([kind[1:] == 1, [False]]) & ~np.concatenate([np.isin(cp[1:], (0x27, 0x2019)), [False]])
        word = np.cumsum(start)
        named = np.zeros(int(word[-1]) + 1, bool)
        named[word[start & capital & follows]] = True
        letter &= ~named[word]
    cp = cp.copy()
    cp[capital] = _lower(cp[capital])
    cp[cp == 0x2019] = 0x27
    return np.where(letter, cp, 0x20).astype(np.uint32), line, lines


def _lower(cp: np.ndarray) -> np.ndarray:
    return _LOWER[cp]


_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x3000)], np.uint32)


def features(cp: np.ndarray, line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hashes of all n-grams without an inner blank, and their lines."""
    blank = cp == 0x20
    for n in ORDERS:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        ok = ~(blank[:m] & blank[n - 1 :]) if n == 2 else ~blank[1 : m + 1]
        for k in range(2, n - 1):
            ok &= ~blank[k : m + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = (h ^ cp[at + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        yield (h >> np.uint32(32 - BITS)).astype(np.int32), line[at + blank[at]]


class Model:
    """Log probabilities ``weights[hash, language]``."""

    def __init__(self, languages: list[str], weights: np.ndarray) -> None:
        self.languages, self.weights = languages, weights

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Model:
        languages = sorted(set(labels))
        model = cls._count(languages, texts, labels)
        clean = []
        for t, label in zip(texts, labels):
            scores, letters, _ = model.score([t])
            best = scores.argmax(1)
            keep = [x for x, b, n in zip(t.split("\n"), best, letters) if n and languages[b] == label]
            clean.append("\n".join(keep))
        return cls._count(languages, clean, labels)

    @classmethod
    def _count(cls, languages: list[str], texts: list[str], labels: list[str]) -> Model:
        counts = np.full((1 << BITS, len(languages)), SMOOTHING)
        for j, language in enumerate(languages):
            own = [t for t, label in zip(texts, labels) if label == language]
            for k in range(0, len(own), 200):
                cp, line, _ = prepare(own[k : k + 200])
                for h, _ in features(cp, line):
                    counts[:, j] += np.bincount(h, minlength=1 << BITS)
        return cls(languages, (np.log(counts) - np.log(counts.sum(0))).astype(np.float32) / len(ORDERS))

    def score(self, texts: list[str], names: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihoods of all lines (lines x languages), their letters, and the number of lines of each text."""
        cp, line, lines = prepare(texts, names)
        total = int(lines.sum())
        out = np.zeros((total, len(self.languages)))
        letters = np.bincount(line[cp != 0x20], minlength=total)[:total]
        for h, at in features(cp, line):
            if len(h):
                first = np.flatnonzero(np.diff(at, prepend=-1))
                out[at[first]] += np.add.reduceat(self.weights[h], first, axis=0)
        return out, letters, lines

    def judge(self, texts: list[str], names: bool = False) -> Iterator[list[tuple[int, str, float]]]:
        """For each text its main language as line 0 and the lines in others, with confidences."""
        scores, letters, lines = self.score(texts, names)
        sure = np.exp(scores - scores.max(1, keepdims=True))
        sure /= sure.sum(1, keepdims=True)
        best, end = scores.argmax(1), np.cumsum(lines)
        for at, (a, b) in enumerate(zip(end - lines, end)):
            n = letters[a:b]
            if not n.any():
                yield [] if names else next(self.judge([texts[at]], True))
                continue
            share = (sure[a:b] * n[:, None]).sum(0)
            main = int(share.argmax())
            rows = [(0, self.languages[main], float(share[main] / n.sum()))]
            s = scores[a:b]
            for i in np.flatnonzero((best[a:b] != main) & (s.max(1) - s[:, main] > MARGIN)):
                k = int(best[a + i])
                rows.append((int(i) + 1, self.languages[k], float(sure[a + i, k])))
            yield rows


def latest_reports(reports: DataFrame) -> DataFrame:
    """The labels of each document's latest report, as codes: doc_id, declared, detected."""
    last = reports.groupBy("doc_id").agg(F.max(F.struct("generated_at", "report_id", "metadata_language", "detected_language")).alias("r"))
    return last.select("doc_id", language_code(F.col("r.metadata_language")).alias("declared"), language_code(F.col("r.detected_language")).alias("detected"))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` texts a language, chosen by a hash of the id among rows whose labels agree."""
    agreed = labels.where("declared = detected").select(F.col("doc_id").alias("_id"), F.col("declared").alias("_label"))
    ranked = agreed.withColumn("_n", F.row_number().over(Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id")))
    chosen = ranked.where(F.col("_n") <= sample).select("_id", "_label")
    rows = documents.where(F.length(text_col).between(1, SAMPLE_CHARS)).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(text_col, "_label").collect()
    often = {x for x, n in pd.Series([r[1] for r in rows]).value_counts().items() if n >= LEAST} if rows else set()
    rows = sorted((r[0], r[1]) for r in rows if r[1] in often) or [("", "en")]
    return Model.fit([t for t, _ in rows], [x for _, x in rows])


def detect(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, line_no, lang, confidence``: line 0 is the whole text, other rows are lines in another language."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            size = np.cumsum(f["_text"].str.len().to_numpy()) // SLICE
            for _, part in f.groupby(size, sort=False):
                rows = [(key, *row) for key, found in zip(part["_id"], m.judge(part["_text"].tolist())) for row in found]
                if rows:
                    yield pd.DataFrame(rows, columns=[id_col, "line_no", "lang", "confidence"])

    texts = df.where(F.length(text_col) > 0).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.mapInPandas(run, f"`{id_col}` {kind}, line_no bigint, lang string, confidence double")


def wrong_labels(documents: DataFrame, reports: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents whose latest labels do not name their main language (line 0), and lines in other languages."""
    labels = latest_reports(reports)
    found = detect(documents, model or fit(documents, labels))
    wrong = reduce(lambda a, b: a | b, (F.col(c).isNull() | (F.col(c) != F.col("lang")) for c in ("declared", "detected")))
    judged = found.join(labels.withColumn("_known", F.lit(True)), "doc_id", "left")
    return judged.where((F.col("line_no") > 0) | (F.col("_known") & wrong)).select("doc_id", "line_no", "lang", "confidence")
