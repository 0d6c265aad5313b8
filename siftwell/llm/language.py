"""Missing or wrong language labels: word-first backoff.

Known words are scored by their log frequency in each language; an unseen word falls back to its
character n-grams, the longest length of which any is known. The model is fitted on labelled rows.
Texts without letters get no language (null, confidence 0); null and empty texts likewise.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.lookalike import fold
from siftwell.session import filled

LANGUAGES = ("en", "zh", "ja", "ko", "es", "fr", "de")
# Spellings of the languages' labels (ISO 639 codes and names).
LABELS = {
    "en": "en eng english englisch anglais inglés ingles",
    "zh": "zh zho chi cmn chinese chinesisch chinois chino mandarin 中文 汉语 漢語",
    "ja": "ja jp jpn japanese japanisch japonais japonés 日本語",
    "ko": "ko kr kor korean koreanisch coréen coreano 한국어",
    "es": "es spa spanish castilian spanisch espagnol español espanol",
    "fr": "fr fra fre french französisch français francais francés",
    "de": "de deu ger german deutsch allemand alemán",
}
SPELLINGS = {w: code for code, words in LABELS.items() for w in words.split()}
#: Runs of Han and kana, which have no spaces, count as words of up to three characters.
WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]{1,3}|[^\W\d_\u3040-\u30ff\u3400-\u9fff]+")
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
SEEN = 1e-3  # probability left for what a language's sample lacks
LEAST = 1e-8
LATIN = [LANGUAGES.index(x) for x in ("en", "es", "fr", "de")]
OTHER = [LANGUAGES.index(x) for x in ("zh", "ja", "ko")]
LEAST_TEXTS = 3  # a word of fewer of the sample's texts, such as an invented name, counts as unseen
GRAMS = (5, 4, 3, 2, 1)


def label_code(label: Column) -> Column:
    """The two-letter code a label stands for; null if it names none of the languages."""
    to = F.create_map(*[x for k, v in SPELLINGS.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(to, F.regexp_extract(F.lower(F.trim(label)), r"^([^-_@. (]+)", 1))


def grams(word: str, n: int) -> list[str]:
    """A word's n-grams, with marks at its ends, each after its length."""
    w = f"^{word}$" if n > 1 else word
    return [f"{n}{w[i : i + n]}" for i in range(len(w) - n + 1)]


class Backoff:
    """The fitted model: rows of log probabilities of known words and n-grams; unseen words' rows are kept as they come up."""

    def __init__(self, words: dict[str, int], known: dict[str, int], logp: np.ndarray) -> None:
        self.words, self.known, self.logp = words, known, logp
        self.reset()

    def reset(self) -> None:
        self.rows = dict(self.words)
        self.table = np.concatenate([self.logp, np.empty_like(self.logp, shape=(150_000, len(LANGUAGES)))])
        self.used = len(self.logp)

    def row(self, word: str) -> int:
        self.rows[word] = k = self.used
        self.table[k] = np.log(LEAST)
        known = self.known
        for n in GRAMS:
            at = [known[u] for u in grams(word, n) if u in known]
            if at:
                self.table[k] = np.add.reduce(self.logp[at], axis=0) / len(at)
                break
        self.used += 1
        return k

    def label(self, texts: Iterable[str]) -> tuple[list[str | None], np.ndarray, list[int]]:
        """The language, confidence and number of letters of each text."""
        at: list[int] = []
        sizes, letters = [], []
        totals = []

        def total() -> None:
            if at:
                starts = np.cumsum([0, *[n for n in sizes if n]])[:-1]
                sums = np.zeros((len(sizes), len(LANGUAGES)))
                sums[np.array(sizes) > 0] = np.add.reduceat(self.table[at], starts, axis=0, dtype="float64")
                totals.append(sums)
            elif sizes:
                totals.append(np.zeros((len(sizes), len(LANGUAGES))))

        every: list[int] = []
        for t in texts:
            words = WORD.findall(fold(t).lower())
            if self.used + len(words) > len(self.table):  # the rows that came up are full: sum what is there and begin anew
                total()
                every += sizes
                at, sizes = [], []
                self.reset()
                if len(words) > len(self.table) - self.used:
                    self.table = np.concatenate([self.table, np.empty_like(self.table, shape=(len(words), len(LANGUAGES)))])
            get = self.rows.get
            at += [r if (r := get(w)) is not None else self.row(w) for w in words]
            sizes.append(len(words))
            letters.append(sum(map(len, words)))
        total()
        every += sizes
        if not every:
            return [], np.zeros(0), []
        n = np.array(every)
        sums = np.concatenate(totals) / np.sqrt(np.maximum(n, 1))[:, None]
        p = np.exp(sums - sums.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)
        sure = np.where(n > 0, p.max(axis=1) / p.sum(axis=1), 0.0)
        return [LANGUAGES[k] if m else None for k, m in zip(best, every, strict=True)], sure, letters


def train(rows: Iterable[tuple[str, str]]) -> Backoff:
    """Fit on (text, language) rows."""
    words: dict[str, Counter] = {x: Counter() for x in LANGUAGES}
    texts: Counter = Counter()
    for text, lang in rows:
        if text and lang in words:
            found = WORD.findall(fold(text).lower())
            words[lang].update(found)
            texts.update(set(found))
    for lang in ("zh", "ja", "ko"):
        words[lang] = Counter({w: n for w, n in words[lang].items() if max(w) >= "\u2e80"})
    units: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
    for k, lang in enumerate(LANGUAGES):
        for w, n in words[lang].items():
            units["w" + w][k] += n
            if texts[w] < LEAST_TEXTS and max(w) < "\u2e80":
                continue  # names would teach n-grams of no language
            for size in GRAMS:
                for g in grams(w, size):
                    units[g][k] += n
    known: dict[str, int] = {}
    rows_: list[np.ndarray] = []
    totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
    for u, v in units.items():
        totals[u[0]] += v
    for u, v in units.items():
        if (texts[u[1:]] if u[0] == "w" else v.sum()) >= LEAST_TEXTS:
            known[u] = len(rows_)
            row = np.log((1 - SEEN) * v / np.maximum(totals[u[0]], 1) + LEAST).astype("float32")
            if max(u[1:]) < "\u2e80":  # a Latin word, such as a name, is no evidence for or between the languages of other scripts
                row[OTHER] = row[LATIN].min()
            rows_.append(row)
    whole = {u[1:]: r for u, r in known.items() if u[0] == "w"}
    return Backoff(whole, {u: r for u, r in known.items() if u[0] != "w"}, np.array(rows_, "float32").reshape(-1, len(LANGUAGES)))


def sample(df: DataFrame, ident: str, text: str, label: str, per_language: int) -> list[tuple[str, str]]:
    """(text, language) of at most about per_language labelled rows of each language, those of least hashed id.

    The sample is chosen on ids and labels alone, so that only its texts are read.
    """
    rows = df.select(F.xxhash64(F.col(ident)).alias("h"), label_code(F.col(label)).alias("lang"), F.col(text).alias("text")).dropna()
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for k, n in sizes.items():  # the hash is uniform: the share of its range that holds the wanted number of rows
        upto = int(-(2**63) + min(1.0, per_language / n) * (2**64 - 1))
        chosen = chosen | ((F.col("lang") == k) & (F.col("h") <= min(upto, 2**63 - 1)))
    return [(r.text, r.lang) for r in rows.where(chosen).orderBy("h").select("text", "lang").collect()]


def fit(right: DataFrame, ident: str, text: str, label: str, partly: DataFrame | None = None, partly_as: tuple[str, str, str] = ("id", "content", "language"), per_language: int = 1000) -> Backoff:
    """Fit on at most per_language rows of each language of a table whose labels are right where given.

    A second table, whose labels are wrong in part, adds the words of its own texts: of as many of its
    rows, the paragraphs for which the first model agrees with the label or is unsure.
    """
    rows = sample(right, ident, text, label, per_language)
    model = train(rows)
    if partly is None:
        return model
    paras = [(p, lang) for t, lang in sample(partly, *partly_as, per_language) for p in BLANK.split(t)]
    found, sure, letters = model.label(p for p, _ in paras)
    agreed = [x for x, lang, c, n in zip(paras, found, sure, letters, strict=True) if n >= 20 and (lang == x[1] or c < 0.9)]
    return train([*rows, *agreed])


def segments(blocks: DataFrame, model: Backoff, ident: str, doc: str, text: str, label: str, letters: int = 20, apart: tuple[str, ...] = ("#", "data:"), every: bool = False) -> DataFrame:
    """(doc, id, para_no, letters, language, confidence, label, counts) of each paragraph that counts, repeated rows once.

    Paragraphs of few letters, or that begin with one of `apart`, headings and data, don't count; every: they come out too.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((model.words, model.known, model.logp))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Backoff(*shared.value)
        for b in batches:
            at, no, text, body = [], [], [], []
            for k, t in enumerate(b["t"]):
                for j, p in enumerate(BLANK.split(t)):
                    whole = len(p) >= letters and not p.startswith(apart)
                    if whole or every:
                        at.append(k)
                        no.append(j)
                        text.append(p)
                        body.append(whole)
            langs, sure, size = own.label(text)
            got = b[["doc", "id", "label"]].iloc[at].reset_index(drop=True)
            got = got.assign(para_no=np.array(no, "int64"), letters=np.array(size, "int64"), language=langs, confidence=sure)
            got = got.assign(counts=np.array(body, "bool") & (got["letters"] >= letters))
            yield got.loc[got["counts"] | every, ["doc", "id", "para_no", "letters", "language", "confidence", "label", "counts"]]

    src = blocks.select(F.col(doc).alias("doc"), F.col(ident).alias("id"), F.col(text).alias("t"), label_code(F.col(label)).alias("label")).dropna(subset=["id", "t"])
    out = src.mapInPandas(filled(part), "doc string, id string, para_no long, letters long, language string, confidence double, label string, counts boolean")
    return out.dropDuplicates(["id", "para_no"])


def document_languages(found: DataFrame) -> DataFrame:
    """(doc, language, confidence, paragraphs, major): each document's most frequent language.

    confidence is the language's share of the paragraphs times its mean confidence; major tells
    whether it has more than half of them; ties go to the alphabetically first language.
    """
    per = found.where("language is not null").groupBy("doc", "language").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    best = per.groupBy("doc").agg(F.sum("n").alias("paragraphs"), F.min(F.struct((-F.col("n")).alias("m"), "language", "c")).alias("b"))
    share = -F.col("b.m") / F.col("paragraphs")
    return best.select("doc", F.col("b.language").alias("language"), (share * F.col("b.c")).alias("confidence"), "paragraphs", (share > 0.5).alias("major"))


def whole_languages(found: DataFrame, key: str) -> DataFrame:
    """(item, language, confidence) of each value of key, block or document, any paragraph of which has a language.

    The paragraphs that count decide; those that don't only where there are no others.
    """
    rows = found.where("language is not null").withColumn("most", F.max("counts").over(Window.partitionBy(key)))
    return document_languages(rows.where("counts = most").withColumn("doc", F.col(key))).select(F.col("doc").alias("item"), "language", "confidence")
