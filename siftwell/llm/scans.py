"""Noise in text from scanned pages.

Words that the clean part of the corpus has a few times are known. A word of a scanned page that isn't
is intersected, by a Levenshtein automaton, with tries of all known words: this gives every known word
within the distance, usual misreadings, merges and splits such as rn for m among them, counting less
than other edits. Candidates are ranked by what they cost, then by how often they follow the word
before them, then by frequency. A name stays as it is: a capitalised word is taken for another only at
usual misreadings, and for one that is not as rare as names are; edits other than usual misreadings
count only where a character can't stand in a word or the word before speaks for the candidate.

Nothing that grows with the data is collected: the known words are a table, which the words of pages
are joined with; only the most frequent ones, at most 1 / COMMON, are told to every task. What no join
knows meets the known words in blocks of bounded size, each a trie.

Running headers, footers and page numbers are what stands in the margin zones of a page, or, where a
page has no layout, what repeats at the ends of a file's pages. Line ends inside words are joined, and
lines and pages reflowed to paragraphs. Blocks with a null id, file, page or text are left out, repeated
ids count once, a page of unknown height has no margins, and null font sizes don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.text import margin_form, page_marker
from siftwell.llm.leakage import Filter, bit_filter
from siftwell.llm.lookalike import fold
from siftwell.session import cut, filled, table

# What is read, and what stands there.
MISREADINGS = """rn m|m rn|m in|m ni|cl d|d cl|ii u|u ii|iii m|ri n|n ri|li h|h li|vv w|w vv|lc k|c e|e c|c o|o c|b h|h b|q g|g q|n u|u n|n h|f t|t f|y v|v y
1 l|1 i|1 t|| l|| i|| t|! i|! l|! t|l i|i l|l t|t l|i j|j i|I l|l I|1 I|| I|l 1|0 o|0 O|o 0|5 s|5 S|$ s|$ S|6 b|6 é|6 e|6 ó|6 G|8 B|8 b|9 g|9 q|@ a|+ t|€ e|£ e|2 z|2 Z|4 A|? 7|é e|e é|á a|a á|ü u|ö o|ä a|f fi|f fl|ii ü|} )|{ (|¢ c|© e|3 e|3 B|7 T|7 t|% x|& a|* x|# h"""
CONFUSED = frozenset(tuple(x.split(" ")) for line in MISREADINGS.split("\n") for x in re.findall(r"(?:\| |[^| ]+ )[^| ]+", line))
HYPHEN = re.compile(r"[-‐‑­¬]\s*$")
LINE_END = re.compile(r"[-‐‑­¬]\s*(?:\n|$)")
WORD = re.compile(r"[^\W\d_]+(?:[-‑][^\W\d_]+)*")
EDGE = re.compile(r"^[^\w|@$!+€]+|[^\w|@$!+€]+$")
END = re.compile(r"[.!?。！？…:][\"'”’»)\]]*\s*$")
APOSTROPHE = re.compile(r"(['’])")


LEAST = 3  # times that the clean texts have a known word, or a pair of words
COMMON = 2e-5  # share of all words from which a known word is told to every task
NAMES = 2e-6  # share of all words that a candidate for a capitalised word must have
TRIE_WORDS = 200_000
OTHER = 3  # what an edit costs that is no usual misreading
OPTION = "array<struct<c: string, n: long, cost: int, at: array<int>>>"

BY_READ: dict[str, list[str]] = {}
for _a, _b in sorted({(x.lower(), y.lower()) for x, y in CONFUSED}):
    BY_READ.setdefault(_a, []).append(_b)


class Automaton:
    """A Levenshtein automaton: it accepts every word that so many usual misreadings and so many other edits turn into what was read.

    A state is a set of (letters read, misreadings, other edits, letters still due); only transitions that some state asks for are followed.
    """

    def __init__(self, read: str, usual: int, other: int) -> None:
        self.read, self.usual, self.other = read, usual, other

    def start(self) -> frozenset:
        return self.closed({(0, 0, 0, "")})

    def closed(self, state: set) -> frozenset:
        """With what follows without a letter: what was read has one too many."""
        more = {(i + 1, e, o + 1, "") for i, e, o, due in state if not due and o < self.other and i < len(self.read)}
        return frozenset(state | more) if self.other <= 1 else frozenset(state | self.closed(more)) if more else frozenset(state)

    def step(self, state: frozenset, c: str) -> frozenset:
        """The states that follow a letter of a word."""
        out, w = set(), self.read
        for i, e, o, due in state:
            if due:
                if due[0] == c:
                    out.add((i, e, o, due[1:]))
                continue
            if i < len(w) and w[i] == c:
                out.add((i + 1, e, o, ""))
            if e < self.usual:
                for a in (1, 2, 3):
                    for word in BY_READ.get(w[i : i + a], ()) if i + a <= len(w) else ():
                        if word[0] == c:
                            out.add((i + a, e + 1, o, word[1:]))
            if o < self.other:
                out.add((i, e, o + 1, ""))
                if i < len(w):
                    out.add((i + 1, e, o + 1, ""))
        return self.closed(out) if out else frozenset()

    def letters(self, state: frozenset) -> set[str] | None:
        """The letters that lead on; null for any."""
        if any(o < self.other and not due for _, _, o, due in state):
            return None
        out, w = set(), self.read
        for i, e, _, due in state:
            if due:
                out.add(due[0])
                continue
            out.update(w[i : i + 1])
            if e < self.usual:
                out.update(word[0] for a in (1, 2, 3) if i + a <= len(w) for word in BY_READ.get(w[i : i + a], ()))
        return out

    def accepts(self, state: frozenset) -> tuple[int, int] | None:
        """The least edits, usual and other, of the word that ends here; null if none does."""
        return min(((o, e) for i, e, o, due in state if i == len(self.read) and not due), default=None)


class Trie:
    """Sorted words; a node is the range of them that begin with a prefix."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(words)

    def child(self, lo: int, hi: int, prefix: str) -> tuple[int, int]:
        lo = bisect_left(self.words, prefix, lo, hi)
        return lo, bisect_left(self.words, prefix + "\U0010ffff", lo, hi)

    def search(self, auto: Automaton) -> list[tuple[str, int, int]]:
        """Every word that the automaton accepts, with its usual misreadings and other edits."""
        out, stack = [], [(0, len(self.words), "", auto.start())]
        while stack:
            lo, hi, prefix, state = stack.pop()
            if lo < hi and self.words[lo] == prefix:
                if (got := auto.accepts(state)) is not None:
                    out.append((prefix, got[1], got[0]))
                lo += 1
            wanted = auto.letters(state)
            if wanted is None:
                wanted, at, n = set(), lo, len(prefix)
                while at < hi:
                    wanted.add(c := self.words[at][n])
                    at = bisect_left(self.words, prefix + c + "\U0010ffff", at, hi)
            for c in wanted:
                a, b = self.child(lo, hi, prefix + c)
                if a < b and (after := auto.step(state, c)):
                    stack.append((a, b, prefix + c, after))
        return out


def explain(read: str, word: str) -> list[int] | None:
    """Where a word was misread, if usual misreadings alone turn it into what was read."""

    @lru_cache(maxsize=None)
    def go(i: int, j: int) -> tuple[int, ...] | None:
        if i == len(read) and j == len(word):
            return ()
        best = go(i + 1, j + 1) if i < len(read) and j < len(word) and read[i] == word[j] else None
        for a in (1, 2, 3):
            for b in (1, 2):
                if i + a <= len(read) and j + b <= len(word) and word[j : j + b] in BY_READ.get(read[i : i + a], ()):
                    rest = go(i + a, j + b)
                    if rest is not None and (best is None or len(rest) + 1 < len(best)):
                        best = (i, *rest)
        return best

    got = go(0, 0)
    return None if got is None else list(got)


def odd(word: str) -> list[int]:
    """Where a word has characters that can't stand in one: marks and digits, capitals inside."""
    return [k for k, c in enumerate(word) if not (c.isalpha() or c in "-'’") or (k and c.isupper())]


class Reader:
    """Finds and mends misread words: counts of known words, candidates for others, counts of pairs of words."""

    def __init__(self, words: dict[str, int], options: dict[str, list[tuple[str, int, int, list[int]]]], pairs: dict[tuple[str, str], int], total: int) -> None:
        self.words, self.options, self.pairs, self.total = words, options, pairs, total

    def knows(self, word: str) -> bool:
        return word.lower() in self.words

    def apart(self, apart: str, close: str) -> bool:
        """Whether a word cut at a hyphen is written with it; a misread one as its mended form is."""
        a, c = self.words.get(apart, 0), self.words.get(close, 0)
        if a or c:
            return a > c
        return self.mend(close) is None and self.mend(apart) is not None

    def mend(self, word: str, before: str = "", begins: bool = False) -> tuple[str, list[int]] | None:
        """The most likely known word for one that isn't known, with the places misread; null if it may stay. begins: at a sentence's beginning."""
        if len(word) < 2 or self.knows(word) or not any(map(str.isalpha, word)):
            return None
        capital = word[:1].isupper()
        # An invented name is an unknown capitalised word: it is taken for another word at one edit only, unless it is long.
        most = 1 if capital and word.isalpha() and len(word) < 7 else 2
        strange = odd(word)
        fits = []
        for c, n, cost, at in self.options.get(word.lower(), ()):
            usual = cost < OTHER
            if usual and cost <= most and (not capital or n >= NAMES * self.total):
                fits.append((-cost, self.pairs.get((before, c), 0), n, c, at))
            elif not usual and not capital and len(word) >= 5 and (set(at) & set(strange) or self.pairs.get((before, c), 0)):
                fits.append((-cost, self.pairs.get((before, c), 0), n, c, at))
        if not fits:
            return None
        *_, c, at = max(fits)
        upper = word[0].isupper() or (begins and not word[0].isalpha())
        return (c[:1].upper() + c[1:] if upper else c), at


class Notes:
    """Stands in for a Reader and notes what would be looked up beside the words told: (word, the word before it, whether edits of other kinds may count).

    Both ways of writing a cut word are gone through, unless a told word decides: it is more frequent than any that isn't.
    """

    def __init__(self, told: dict[str, int], hyphens: bool) -> None:
        self.told, self.hyphens = told, hyphens
        self.asked: set[tuple[str, str, bool]] = set()

    def note(self, word: str, before: str = "", other: bool = False) -> bool:
        """Whether the word is told; else it is noted."""
        low = word.lower()
        if low in self.told:
            return True
        if len(word) > 1 and any(map(str.isalpha, word)):
            self.asked.add((low, before, other))
        return False

    def knows(self, word: str) -> bool:
        return self.note(word)

    def mend(self, word: str, before: str = "", begins: bool = False) -> None:
        self.note(word, before, len(word) >= 5 and not word[:1].isupper())

    def apart(self, apart: str, close: str) -> bool:
        a, c = self.told.get(apart, 0), self.told.get(close, 0)
        if a or c:
            return a > c
        self.note(apart)
        self.note(close)
        return self.hyphens


def edits(read: str, word: str) -> list[int]:
    """The place of the one edit between two words that differ by one."""
    k = next((k for k, (a, b) in enumerate(zip(read, word, strict=False)) if a != b), min(len(read), len(word)))
    return [min(k, len(read) - 1)]


def candidates(word: str, tries: Trie, other: bool = True) -> list[tuple[str, int, list[int]]]:
    """(known word, cost, places) for a lower-case word: by usual misreadings, or, if there are none and other is set, by one edit of another kind."""
    out = []
    for c, _, _ in tries.search(Automaton(word, 2, 0)):
        if c != word and (at := explain(word, c)):
            out.append((c, len(at), at))
    if out or not other:
        return out
    return [(c, OTHER, edits(word, c)) for c, _, o in tries.search(Automaton(word, 0, 1)) if o]


def inner(token: str) -> tuple[int, str]:
    """A token without what stands around its word, and where the word begins."""
    m = re.match(r"^[^\w|@$!+€]*", token)
    at = m.end() if m else 0
    core = EDGE.sub("", token)
    return at, re.sub(r"(?<=[^\W\d_])[!+]$", "", core) if len(core) > 2 and core.endswith("!") and core[:-1].isalpha() else core


def read_block(text: str, reader: Reader | Notes, following: str | None, preceding: str | None) -> tuple[list[tuple[int, str]], str]:
    """Faults (line, fault) of a body block, and its text as one mended paragraph.

    following: the first token of the next page's body if the block is the last of its page; preceding:
    the last token of the page before if the block is the first of its page.
    """
    lines = text.split("\n")
    tokens: list[list] = []  # [line, piece] lists: a token may lie on two lines, or begin on the page before (line None)
    cut = None
    begun = re.search(r"\S+\s*$", preceding) if preceding and HYPHEN.search(preceding) else None
    if begun and re.search(r"\w[-‐‑­¬]\s*$", begun[0]):
        tokens.append([None, begun[0].strip()])
        cut = -1
    hyphens: set[int] = set()
    for n, line in enumerate(lines):
        parts = line.split()
        ends = HYPHEN.search(line)
        for k, p in enumerate(parts):
            if k == 0 and cut is not None:
                tokens[-1] += [n, p]
            else:
                tokens.append([n, p])
        cut = n if ends and parts and HYPHEN.sub("", parts[-1]) and HYPHEN.sub("", parts[-1])[-1].isalnum() else None
    out: set[tuple[int, str]] = set()
    words: list[str] = []
    for k, t in enumerate(tokens):
        pieces = t[1::2]
        if len(pieces) == 1 and not (k == len(tokens) - 1 and cut is not None):
            joined, sizes = pieces[0], [len(pieces[0])]
        else:
            whole = [*pieces, following] if k == len(tokens) - 1 and cut is not None and following else pieces
            stems = [HYPHEN.sub("", p) if j + 1 < len(whole) or len(whole) == 1 else p for j, p in enumerate(whole)]
            joined, sizes = stems[0], [len(stems[0])]
            for j, nxt in enumerate(stems[1:], 1):
                close = inner(joined + nxt)[1].lower()
                apart = inner(joined + "-" + nxt)[1].lower()
                legit = len(whole) > 1 and reader.apart(apart, close)
                joined += ("-" if legit else "") + nxt
                sizes.append(len(joined))
                if not legit:
                    hyphens.add(t[2 * (j - 1)])
            if len(whole) == 1:
                hyphens.add(t[-2])
            if len(whole) > len(pieces):  # the rest stands on the next page
                t = [*t, None, following]
        start, core = inner(joined)
        before = words[-1].lower().strip(".,;:") if words else ""
        mended = joined
        offset = start
        for part in APOSTROPHE.split(core) if "'" in core or "’" in core else [core]:
            known = reader.knows(part) or reader.mend(part, before) is not None
            for sub in [part] if known else re.split(r"(-)", part):
                begins = not words or bool(END.search(words[-1]))
                got = reader.mend(sub, before, begins) if sub and sub not in "-'’" else None
                if got:
                    word, at = got
                    mended = mended.replace(sub, word, 1)
                    for place in at:
                        where = next((j for j, s in enumerate(sizes) if offset + place < s), len(sizes) - 1)
                        line = t[2 * where] if 2 * where < len(t) else t[-2]
                        if line is not None:
                            out.add((line, "chars"))
                offset += len(sub)
        words.append(mended)
    out |= {(n, "hyphen") for n in hyphens if n is not None}
    return sorted(out), " ".join(words)


def vocabulary(clean: DataFrame, text: str) -> DataFrame:
    """(w, n) of the known words, counted over all clean texts."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for t in b["t"]:
                total.update(WORD.findall(fold(t).lower()))
        yield pd.DataFrame({"w": list(total), "n": list(total.values())})

    src = clean.select(F.col(text).alias("t")).dropna()
    return src.mapInPandas(filled(part), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def pair_counts(clean: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(a, b, n) of pairs of successive words, the second one of wanted (b), counted over all clean texts."""
    may = bit_filter(wanted.select(F.xxhash64("b").alias("key")))
    shared = clean.sparkSession.sparkContext.broadcast((may.bits, may.slots))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may, total = Filter(*shared.value), Counter()
        keep: dict[str, bool] = {}
        for b in batches:
            for t in b["t"]:
                w = WORD.findall(fold(t).lower())
                if fresh := list({x for x in w if x not in keep}):
                    if len(keep) > 500_000:
                        keep.clear()
                        fresh = list(set(w))
                    passed = set(may(np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in fresh], "uint64")).tolist())
                    keep.update((x, k in passed) for k, x in enumerate(fresh))
                total.update(x for x in zip(w, w[1:], strict=False) if keep[x[1]])
        yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["a", "b", "n"])

    src = clean.select(F.col(text).alias("t")).dropna()
    got = src.mapInPandas(filled(part), "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return got.where(F.col("n") >= LEAST).join(wanted.select("b").distinct(), "b", "left_semi")


def options(lost: DataFrame, words: DataFrame) -> DataFrame:
    """(word, options) of words (word, other) that aren't known: the known words (w, n) in blocks by hash, each a trie in every task."""
    blocks = max(1, -(-words.count() // TRIE_WORDS))
    # A word takes far longer than its row is large: the rows are spread by number, not by size.
    lost = cut(lost.repartition(int(lost.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = []
    for k in range(blocks):
        known = words.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == k).toPandas()
        shared = lost.sparkSession.sparkContext.broadcast(dict(zip(known["w"], known["n"], strict=True)))

        def part(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            n = shared.value
            tries = Trie(list(n))
            for b in batches:
                got = [(w, c, n[c], cost, at) for w, x in zip(b["word"], b["other"], strict=True) for c, cost, at in candidates(w, tries, x)]
                yield pd.DataFrame(got, columns=["word", "c", "n", "cost", "at"])

        out.append(lost.mapInPandas(filled(part), "word string, c string, n long, cost int, at array<int>"))
    every = reduce(DataFrame.unionByName, out)
    return every.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("c", "n", "cost", "at"))).alias("options"))


def tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf, "text_blocks"), table(spark, sf, "page_heights"), table(spark, sf, "content_blocks")


def lines_hash(text: Column, first: Column) -> Column:
    """A hash of lines and their numbers, which adds up over blocks by exclusive or."""
    each = F.transform(F.split(text, "\n"), lambda line, k: F.xxhash64(first + k, line))
    return F.aggregate(each, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def placed(blocks: DataFrame, heights: DataFrame, top: float = 0.1, bottom: float = 0.1) -> DataFrame:
    """Blocks in reading order within their page: (id, doc, page, text, margin, nth, first line, first and last of the body, hash of the page's lines).

    A block of one or two lines wholly within the top or bottom zone of its page is margin. Texts are shuffled once, by page.
    """
    b = blocks.select("id", F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), "text", "y0", "y1").dropna(subset=["id", "doc", "page", "text"])
    h = heights.groupBy(F.col("doc_id").alias("doc"), F.col("page_num").alias("page")).agg(F.max("height").alias("height"))
    lines = F.regexp_count("text", F.lit("\n")) + 1
    zone = (F.col("y1") <= top * F.col("height")) | (F.col("y0") >= (1 - bottom) * F.col("height"))
    page = Window.partitionBy("doc", "page")
    b = b.join(h, ["doc", "page"], "left").dropDuplicates(["doc", "page", "id"])
    b = b.select("id", "doc", "page", "text", "y0", lines.alias("lines"), (F.coalesce(zone, F.lit(False)) & (lines <= 2)).alias("margin"))
    order = page.orderBy("y0", "id")
    prose = ~F.col("margin") & ~F.col("text").rlike(r"^[\s\d.,|/–—-]*$")
    b = b.withColumn("line0", F.coalesce(F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = b.withColumn("nth", F.row_number().over(order)).withColumn("prose", prose)
    key = F.when(F.col("prose"), F.col("nth"))
    of_page = F.bit_xor(lines_hash(F.col("text"), F.col("line0"))).over(page).alias("of_page")
    return b.select("id", "doc", "page", "text", "margin", "prose", "lines", "line0", "nth", (F.min(key).over(page) == F.col("nth")).alias("is_first"), (F.max(key).over(page) == F.col("nth")).alias("is_last"), of_page)


def neighbours(b: DataFrame) -> DataFrame:
    """Blocks with the first token of the next page's body and the last line of the page's before, where they matter."""
    nxt = b.where("is_first").select("doc", (F.col("page") - 1).alias("page"), F.regexp_extract("text", r"^\s*(\S+)", 1).alias("following"))
    prev = b.where("is_last").select("doc", (F.col("page") + 1).alias("page"), F.regexp_extract("text", r"([^\n]*)\s*$", 1).alias("preceding"))
    out = b.join(nxt, ["doc", "page"], "left").join(prev, ["doc", "page"], "left")
    return out.withColumns({"following": F.when(F.col("is_last"), F.col("following")), "preceding": F.when(F.col("is_first"), F.col("preceding"))})


def page_rows(content: DataFrame) -> DataFrame:
    """(id, doc, page, text): the rows of content that are scanned pages; a page without a number goes by its place."""
    page = F.coalesce("page_num", "pos").alias("page")
    return content.where("metadata.layout_type = 'page'").select("id", F.col("doc_id").alias("doc"), page, F.col("content").alias("text")).dropna(subset=["id", "text"])


def without_layout(pages: DataFrame, least: float = 0.5, ends: int = 2) -> DataFrame:
    """Pages' texts laid out as blocks by themselves: the lines at a page's ends that repeat on so many of the file's pages, or number it, are margin."""
    lines = pages.select("id", "doc", "page", F.posexplode(F.split("text", "\n")).alias("k", "line"), F.size(F.split("text", "\n")).alias("n"))
    end = (F.col("k") < ends) | (F.col("k") >= F.col("n") - ends)
    form = margin_form(F.col("line"))
    often = lines.where(end & (form != "")).groupBy("doc", form.alias("form")).agg(F.countDistinct("page").alias("on"))
    of = pages.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    marks = lines.where(end).withColumn("form", form).join(often, ["doc", "form"], "left").join(of, "doc")
    repeated = F.coalesce(F.col("on") >= F.greatest(F.lit(2.0), F.lit(least) * F.col("pages")), F.lit(False))
    gone = marks.where(repeated | (page_marker(F.col("line")) & (F.trim("line") != ""))).groupBy("id").agg(F.collect_set("k").alias("gone"))
    rows = pages.join(gone, "id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    rows = rows.withColumn("all", F.split("text", "\n"))
    first = F.size(F.filter(F.array(*[F.lit(k) for k in range(ends)]), lambda k: F.forall(F.sequence(F.lit(0), k), lambda j: F.array_contains("gone", j))))
    n = F.size("all")
    last = F.size(F.filter(F.array(*[F.lit(k) for k in range(ends)]), lambda k: F.forall(F.sequence(F.lit(0), k), lambda j: F.array_contains("gone", n - 1 - j))))
    rows = rows.withColumns({"top": F.least(first, n), "low": F.greatest(F.least(first, n), n - last)})
    part = lambda lo, hi, margin, nth: F.struct(F.array_join(F.slice("all", lo + 1, hi - lo), "\n").alias("text"), F.lit(margin).alias("margin"), (hi - lo).alias("lines"), lo.cast("long").alias("line0"), F.lit(nth).alias("nth"))
    three = F.array(part(F.lit(0), F.col("top"), True, 1), part(F.col("top"), F.col("low"), False, 2), part(F.col("low"), n, True, 3))
    out = rows.select("id", "doc", "page", F.inline(F.filter(three, lambda x: x["lines"] > 0)))
    own = ~F.col("margin")
    return out.withColumns({"prose": own, "is_first": own, "is_last": own})


def laid_out(blocks: DataFrame, heights: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every block, with those of pages that have no layout of their own; the pages (item, doc, page) whose text is that of their blocks).

    Pages are compared by hashes of their lines; only texts of pages without layout are gathered.
    """
    own = cut(neighbours(placed(blocks, heights)).withColumn("alone", F.lit(False)))
    rows = page_rows(content)
    pages = rows.select("id", "doc", "page", lines_hash(F.col("text"), F.lit(0).cast("long")).alias("hash")).dropDuplicates(["id"])
    pages = cut(pages.join(own.groupBy("doc", "page").agg(F.first("of_page").alias("of_page")), ["doc", "page"], "left").select("id", "doc", "page", F.coalesce(F.col("hash") == F.col("of_page"), F.lit(False)).alias("same")))
    alone = without_layout(rows.join(pages.where(~F.col("same")).select("id"), "id", "left_semi").dropDuplicates(["id"]))
    every = own.drop("of_page").unionByName(neighbours(alone).withColumn("alone", F.lit(True)))
    return every.withColumn("key", F.monotonically_increasing_id()), pages.where("same").select(F.col("id").alias("item"), "doc", "page")


def read(laid: DataFrame, content: DataFrame) -> DataFrame:
    """Every block laid out, with its faults (line, fault) and its mended text; margins have fault 'margin' on each line and no text."""
    spark = laid.sparkSession
    clean = content.where("type = 'text' and not (metadata.layout_type <=> 'page')")
    words = cut(vocabulary(clean, "content"))
    total = words.agg(F.sum("n")).first()[0] or 0
    common = {r.w: r.n for r in words.where(F.col("n") >= COMMON * total).collect()}
    told = spark.sparkContext.broadcast(common)
    laid = cut(laid)  # keys are fixed from here

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for key, text, following, preceding in zip(b["key"], b["text"], b["following"], b["preceding"], strict=True):
                asked: dict[str, dict[str, bool]] = {}
                for hyphens in (False, True) if LINE_END.search(text) or preceding else (False,):
                    notes = Notes(told.value, hyphens)
                    read_block(text, notes, following or None, preceding or None)
                    for w, before, other in notes.asked:
                        of = asked.setdefault(w, {})
                        of[before] = of.get(before, False) or other
                for w, of in asked.items():
                    got += [(key, w, before, other) for before, other in of.items() if before or len(of) == 1]
            yield pd.DataFrame(got, columns=["key", "word", "before", "other"])

    asked = cut(laid.where(~F.col("margin")).select("key", "text", "following", "preceding").mapInPandas(filled(ask), "key long, word string, before string, other boolean"))
    need = asked.groupBy("word").agg(F.max("other").alias("other")).join(words.withColumnRenamed("w", "word"), "word", "left")
    lost = options(need.where("n is null").select("word", "other"), words)
    answers = cut(need.drop("other").join(lost, "word", "left").where("n is not null or options is not null"))
    # Which of several candidates of least cost follows the word before more often.
    least = F.array_min(F.transform("options", lambda o: o["cost"]))
    several = answers.where((F.size(F.filter("options", lambda o: o["cost"] == least)) > 1) | (least >= OTHER))
    context = asked.where("before <> ''").join(several, "word").select("key", F.col("before").alias("a"), F.explode(F.col("options.c")).alias("b"))
    mended = answers.select(F.col("word").alias("a"), F.explode("options.c").alias("mended"))  # the word before may be misread itself
    context = cut(context.unionByName(context.join(mended, "a").select("key", F.col("mended").alias("a"), "b")).distinct())
    pairs = context.join(pair_counts(clean, "content", context.select("b")), ["a", "b"])
    known = asked.select("key", "word").distinct().join(answers, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n", "options")).alias("known"))
    met = pairs.groupBy("key").agg(F.collect_list(F.struct("a", "b", "n")).alias("met"))
    rows = laid.join(known, "key", "left").join(met, "key", "left")
    keep = [c for c in laid.columns if c not in ("key", "following", "preceding")]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            faults, mended = [], []
            for text, margin, following, preceding, own, met in zip(b["text"], b["margin"], b["following"], b["preceding"], b["known"], b["met"], strict=True):
                if margin:
                    faults.append([{"line": n, "fault": "margin"} for n in range(text.count("\n") + 1)])
                    mended.append(None)
                    continue
                own = [] if own is None else own
                here = {x["word"]: x["n"] for x in own if x["n"] is not None}
                maybe = {x["word"]: [(o["c"], o["n"], o["cost"], list(o["at"])) for o in x["options"]] for x in own if x["options"] is not None}
                reader = Reader(Both(here, told.value), maybe, {(x["a"], x["b"]): x["n"] for x in ([] if met is None else met)}, total)
                found, one = read_block(text, reader, following or None, preceding or None)
                faults.append([{"line": n, "fault": f} for n, f in found])
                mended.append(one)
            yield b[keep].assign(faults=faults, mended=mended)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.select(*keep).schema) + ", faults array<struct<line: long, fault: string>>, mended string"
    return rows.mapInPandas(filled(part), schema)


class Both:
    """Two tables of words as one."""

    def __init__(self, here: dict[str, int], told: dict[str, int]) -> None:
        self.here, self.told = here, told

    def get(self, word: str, other: int = 0) -> int:
        return self.here.get(word) or self.told.get(word, other)

    def __contains__(self, word: str) -> bool:
        return word in self.here or word in self.told


def faults(blocks: DataFrame, heights: DataFrame, content: DataFrame) -> DataFrame:
    """(item, line_no, fault) of text blocks and of the page rows of content.

    A page row whose text is that of its blocks has their faults; any other is read itself.
    """
    laid, pages = laid_out(blocks, heights, content)
    got = cut(read(laid, content).select("id", "doc", "page", "line0", "alone", F.explode("faults").alias("f")).select("id", "doc", "page", "line0", "alone", "f.line", "f.fault"))
    own = got.select(F.col("id").alias("item"), F.when(F.col("alone"), F.col("line0")).otherwise(0).alias("from"), "line", "fault").select("item", (F.col("from") + F.col("line")).alias("line_no"), "fault")
    whole = got.where(~F.col("alone")).join(pages, ["doc", "page"]).select("item", (F.col("line0") + F.col("line")).alias("line_no"), "fault")
    return own.unionByName(whole).distinct()


def paragraphs(blocks: DataFrame, heights: DataFrame, content: DataFrame) -> DataFrame:
    """(doc_id, para_no, text): each file's body, mended, in continuous paragraphs.

    A paragraph that doesn't end at a page's end goes on with the next page's first block of prose; a block
    of numbers in the body is a paragraph of its own, after the one it stands in. Paragraphs are numbered by
    counts of pages, so that no file is gathered in one task.
    """
    b = read(laid_out(blocks, heights, content)[0], content).where(~F.col("margin") & F.col("text").rlike(r"\S")).select("doc", "page", "nth", "prose", "text", "mended", "is_first", "is_last")
    open_end = b.where("is_last").select("doc", (F.col("page") + 1).alias("page"), (~F.trim("text").rlike(END.pattern)).alias("goes_on"), F.regexp_extract("text", r"(\S*)\s*$", 1).rlike(HYPHEN.pattern).alias("cut"))
    b = b.join(open_end, ["doc", "page"], "left")
    starts = F.when(F.col("is_first") & F.coalesce("goes_on", F.lit(False)), 0).otherwise(1)
    b = b.withColumn("starts", starts).withColumn("opens", F.when(F.col("prose"), starts).otherwise(0))
    order = Window.partitionBy("doc", "page").orderBy("nth")
    pages = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy("doc", "page").agg(F.sum("starts").alias("s"), F.sum("opens").alias("o"))
    sums = sums.select("doc", "page", *[F.coalesce(F.sum(c).over(pages), F.lit(0)).alias("before_" + c) for c in ("s", "o")])
    b = b.withColumns({"nth_start": F.sum("starts").over(order), "nth_open": F.sum("opens").over(order)}).join(sums, ["doc", "page"])
    # What goes on belongs to the last paragraph of prose begun before it, whatever numbers stand between.
    b = b.withColumn("no", F.col("before_s") + F.col("nth_start") - 1)
    b = b.withColumn("of", F.when(F.col("prose"), F.col("before_o") + F.col("nth_open"))).withColumn("own", F.when(~F.col("prose"), F.col("no")))
    # The first token of a page that ends a word of the page before stands there already.
    text = F.when(F.col("is_first") & F.coalesce("cut", F.lit(False)), F.regexp_replace("mended", r"^\s*\S+\s*", "")).otherwise(F.col("mended"))
    rows = b.select("doc", "of", "own", "no", F.struct("page", "nth", text.alias("t")).alias("x"))
    out = rows.groupBy("doc", "of", "own").agg(F.min("no").alias("para_no"), F.sort_array(F.collect_list("x")).alias("x"))
    return out.select(F.col("doc").alias("doc_id"), "para_no", F.array_join(F.transform("x", lambda s: s["t"]), " ").alias("text"))
