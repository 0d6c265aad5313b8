"""Visually identical text with different characters.

Classes of strings that read the same are found by union-find over strings and code points; each
class is written as its most frequent member; texts are rewritten greedily by an Aho-Corasick
automaton. What a reader can see stays apart: accents, case, digits, raised or circled figures,
punctuation and missing spaces. Null texts stay null, empty texts empty; a text of invisible
characters only becomes the empty text.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import cut, filled

# Letters of other scripts and the Latin letters that look like them.
HOMOGLYPHS = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀ", "J": "Ј", "K": "ΚКK",
    "M": "ΜМ", "N": "Ν", "O": "ΟО", "P": "ΡР", "Q": "Ԛ", "S": "Ѕ", "T": "ΤТ", "W": "Ԝ", "X": "ΧХ",
    "Y": "ΥҮ", "Z": "Ζ", "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ",
    "o": "οо", "p": "р", "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
}
# Dashes drawn like the hyphen, and format characters that are drawn.
HYPHENS = "‐‑"
DRAWN_FORMATS = frozenset("؀؁؂؃؄؅۝܏࢐࢑࣢")
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a]{2}")


class Disjoint:
    """Union-find over strings with path halving."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return {k: sorted(v) for k, v in out.items() if len(v) > 1}


def rule_pairs() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look alike, from the Unicode character database and the fixed values above."""
    for o in (*range(0xA0, 0x30000), *range(0xE0000, 0xE01F0)):
        if 0xD800 <= o < 0xE000:
            continue
        c = chr(o)
        kind = ud.category(c)
        if (kind == "Cf" and c not in DRAWN_FORMATS) or c in UNSEEN or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o:
            yield c, ""
            continue
        if kind == "Zs" and o != 0x1680:
            yield c, " "
            continue
        plain = ud.normalize("NFD", c)
        if plain != c:
            yield c, plain
            if len(plain) > 2 and len(half := ud.normalize("NFC", plain[:-1])) == 1:
                yield c, half + plain[-1]
        how = ud.decomposition(c)
        if how.startswith(("<wide>", "<narrow>", "<compat>")):
            to = ud.normalize("NFKC", c)
            letters = all(ud.category(x)[0] in "LN" for x in to)
            if letters and to != c and (not how.startswith("<compat>") or 0xFB00 <= o <= 0xFB06 or 0x2E80 <= o <= 0x2FDF):
                yield c, to
    for c in HYPHENS:
        yield c, "-"
    for latin, others in HOMOGLYPHS.items():
        for c in others:
            yield c, latin


@lru_cache(maxsize=1)
def classes() -> dict[str, list[str]]:
    """The transitive look-alike classes; a letter's look-alikes carry over to its accented forms."""
    sets = Disjoint()
    accented: list[tuple[str, str]] = []
    for a, b in rule_pairs():
        sets.join(a, b)
        if len(b) > 1 and ud.combining(b[1]):
            accented.append((a, b))
    alike = {x: v for v in sets.classes().values() for x in v if len(x) == 1}
    for c, plain in accented:
        for base in alike.get(plain[0], ()):
            if len(base) == 1 and base != plain[0]:
                sets.join(base + plain[1:], c)
                if len(whole := ud.normalize("NFC", base + plain[1:])) == 1:
                    sets.join(whole, c)
    return sets.classes()


def representatives(counts: Mapping[str, int]) -> dict[str, str]:
    """Each class member's representative: the class's most frequent member, of ties the one in plain form, then the least.

    The class of the invisible characters is always written as the empty string.
    """
    out = {}
    for members in classes().values():
        best = "" if "" in members else min(members, key=lambda m: (-counts.get(m, 0), ud.normalize("NFKC", m) != m, len(m), m))
        out |= {m: best for m in members if m != best}
    return out


def _any_of(chars: Iterable[str]) -> re.Pattern:
    """Finds any of some characters; all beyond the basic plane are taken together, which keeps the search fast."""
    return re.compile("[" + "".join(re.escape(c) for c in sorted(chars) if ord(c) < 0x10000) + "\U00010000-\U0010ffff]")


class Rewriter:
    """Rewrites texts to one form: single code points first, then longest strings by automaton."""

    def __init__(self, to: Mapping[str, str]) -> None:
        single = {m: r for m, r in to.items() if len(m) == 1}
        self.single = {ord(m): r for m, r in single.items()}
        step = lambda s: "".join(single.get(c, c) for c in s)
        many = {s: step(r) for m, r in to.items() if len(m) > 1 and len(s := step(m)) > 1 and s != step(r)}
        self.trie = ahocorasick.Automaton()
        for s, r in many.items():
            self.trie.add_word(s, (len(s), r))
        self.trie.make_automaton()
        followers = {c for s in many for c in s[1:]}
        self.marks = _any_of(followers) if followers else None
        self.suspect = _any_of(single)

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        if self.suspect.search(text):
            text = text.translate(self.single)
        if self.marks is None or not self.marks.search(text):
            return text
        if MARKS.search(text):
            text = ud.normalize("NFD", text).translate(self.single)
        out, at = [], 0
        for end, (size, rep) in self.trie.iter_long(text):
            out += [text[at : end + 1 - size], rep]
            at = end + 1
        return "".join([*out, text[at:]])


@lru_cache(maxsize=4)
def rewriter(counts: tuple[tuple[str, int], ...] = ()) -> Rewriter:
    """A rewriter of given member counts; without counts a composed, plain form is preferred."""
    known = dict(counts) or {m: 1 for v in classes().values() for m in v if m.isascii()}
    return Rewriter(representatives(known))


def fold(text: str) -> str:
    """One form of a text, by the rules alone; for comparisons inside other operators."""
    return rewriter()(text)


@lru_cache(maxsize=1)
def _members() -> tuple[np.ndarray, re.Pattern, list[str]]:
    names = {m for v in classes().values() for m in v if m}
    codes = np.array(sorted(ord(m) for m in names if len(m) == 1))
    tails = {c for m in names if len(m) > 1 for c in m[1:] if not c.isascii()}
    return codes, _any_of(tails), sorted(m for m in names if len(m) > 1 and m.isascii())


def count_members(texts: Iterable[str]) -> dict[str, int]:
    """How often the members of the classes occur in texts."""
    codes, tails, plain = _members()
    joined = "\n".join(texts)
    if not joined:
        return {}
    at = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = np.bincount(at, minlength=int(codes[-1]) + 1)[codes]
    out = {chr(c): int(n) for c, n in zip(codes[found > 0], found[found > 0], strict=True)}
    out |= {m: n for m in plain if (n := joined.count(m))}
    auto = rewriter().trie
    if tails.search(joined) and len(auto):
        for end, (size, _) in auto.iter_long(joined):
            s = joined[end + 1 - size : end + 1]
            out[s] = out.get(s, 0) + 1
    return out


def member_counts(df: DataFrame, text: str) -> dict[str, int]:
    """Counts of class members over all rows; their number is bounded by the classes, not by the data."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        for b in batches:
            for k, n in count_members(b["t"].dropna()).items():
                total[k] = total.get(k, 0) + n
        yield pd.DataFrame({"member": list(total), "n": list(total.values())}, columns=["member", "n"])

    got = df.select(F.col(text).alias("t")).mapInPandas(filled(part), "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))
    return {r.member: r.n for r in got.collect()}


def _key(counts: Mapping[str, int]) -> tuple[tuple[str, int], ...]:
    return tuple(sorted(counts.items()))


def canonical(text: Column, counts: Mapping[str, int]) -> Column:
    """A column's texts in one form."""
    key = _key(counts)

    @F.pandas_udf("string")
    def one(s: pd.Series) -> pd.Series:
        write = rewriter(key)
        return s.map(write, na_action="ignore")

    return one(text)


def digests(texts: Iterable[str]) -> np.ndarray:
    """128-bit digests of texts, as two signed 64-bit columns."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts), ">i8").astype("int64").reshape(-1, 2)


def forms(df: DataFrame, ident: str, text: str, counts: Mapping[str, int]) -> DataFrame:
    """(id, raw, raw2, form, form2): 128-bit digests of each row's text as given and in one form.

    Null ids and texts are left out; a row delivered twice comes out once. Texts themselves are not shuffled.
    """
    key = _key(counts)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = rewriter(key)
        for b in batches:
            one = [write(t) for t in b["t"]]
            raw = digests(b["t"])
            form = raw.copy()
            changed = [k for k, (x, y) in enumerate(zip(b["t"], one, strict=True)) if x is not y]
            form[changed] = digests(one[k] for k in changed)
            yield pd.DataFrame({"id": list(b["id"]), "raw": raw[:, 0], "raw2": raw[:, 1], "form": form[:, 0], "form2": form[:, 1]})

    src = df.select(F.col(ident).alias("id"), F.col(text).alias("t")).dropna()
    return src.mapInPandas(filled(part), "id string, raw long, raw2 long, form long, form2 long").distinct()


def look_alike_classes(df: DataFrame, ident: str, text: str, counts: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the texts that read the same but are spelt in several ways.

    pairs: (a, b), smaller first, of spellings of one class, each named by the least id that has it;
    members: (id, spelling, class), one row for every id whose text reads like another spelling, the class
    named by its least id. Spellings are counted before any join, so that masses of equal texts are one row.
    """
    rows = cut(forms(df, ident, text, counts))
    key = ["form", "form2"]
    spelt = rows.groupBy(*key, "raw", "raw2").agg(F.min("id").alias("spelling"))
    mixed = spelt.groupBy(*key).agg(F.count("*").alias("n"), F.min("spelling").alias("class")).where("n > 1").drop("n")
    spelt = spelt.join(mixed, key)
    a, b = spelt.select(*key, F.col("spelling").alias("a")), spelt.select(*key, F.col("spelling").alias("b"))
    pairs = a.join(b, key).where("a < b").select("a", "b").distinct()
    return pairs, rows.join(spelt.select("raw", "raw2", "spelling", "class"), ["raw", "raw2"]).select("id", "spelling", "class").distinct()


def look_alike_pairs(df: DataFrame, ident: str, text: str, counts: Mapping[str, int], salts: int = 8) -> DataFrame:
    """(id_a, id_b), smaller first: rows whose texts differ in characters but read the same.

    The pairs of spellings, expanded to their members; members of one spelling, however many, are spread over salts.
    """
    pairs, members = look_alike_classes(df, ident, text, counts)
    members = cut(members)
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    own = members.select("id", "spelling", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    half = pairs.select("a", "b", every).join(own.select(F.col("spelling").alias("a"), F.col("id").alias("x"), "salt"), ["a", "salt"])
    both = half.select("x", "b", every).join(own.select(F.col("spelling").alias("b"), F.col("id").alias("y"), "salt"), ["b", "salt"])
    return both.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
