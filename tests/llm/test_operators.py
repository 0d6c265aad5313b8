"""Small cases and brute force for every training-data operator: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import itertools
import random

import numpy as np
import pytest

from siftwell.llm import boilerplate, borda, language, leakage, lookalike, neighbours, packing, residue, scans, splitting


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- 1: Borda ---


def brute_borda(scores, names):
    out = {}
    for lst in {s[0] for s in scores}:
        items = {s[1]: dict(zip(names, s[2:], strict=True)) for s in scores if s[0] == lst}
        n = len(items)
        pts = dict.fromkeys(items, 0.0)
        for name in names:
            ok = {i: v[name] for i, v in items.items() if v[name] is not None and np.isfinite(v[name])}
            for i in items:
                if i in ok:
                    place = sum(x > ok[i] for x in ok.values()) + (sum(x == ok[i] for x in ok.values()) + 1) / 2
                else:
                    place = (len(ok) + 1 + n) / 2
                pts[i] += n - place
        out |= {(lst, i): p for i, p in pts.items()}
    return out


def test_borda_equals_brute_force(spark):
    rng = random.Random(1)
    val = lambda: rng.choice([None, float("nan"), float("inf"), 1.0, 2.0, 2.0, 1e300, -5.0])
    data = [(q, f"d{i}", val(), val()) for q in range(4) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(data, "list long, item string, a double, b double").selectExpr("*", "1 as n", "2 as place2", "3 as part")
    got = {(r.list, r.item): r.points for r in borda.borda(df, {"a": 1.0, "b": 1.0}).collect()}
    assert got == pytest.approx(brute_borda(data, ["a", "b"]))
    top = borda.top(borda.borda(df, {"a": 1.0, "b": 1.0}), 2).collect()
    for q in range(4):
        mine = sorted(((-p, i) for (lst, i), p in got.items() if lst == q))[:2]
        assert [i for _, i in mine] == [r.item for r in sorted(top, key=lambda r: r.place) if r.list == q]


def test_borda_of_nothing(spark):
    df = spark.createDataFrame([(None, "x", 1.0)], "list long, item string, a double")
    assert borda.borda(df, {"a": 1.0}).collect() == []
    assert borda.borda(df.limit(0), {"a": 1.0}).collect() == []


# --- 2: boilerplate ---


def test_boilerplate(spark):
    data = [(f"b{k}", "s", f"d{k}", f"Own line {'abcdefghij'[k]}\n** Share THIS page 12 **\nPar аge {k}\n\nend {'qrstuvwxyz'[k]}") for k in range(10)]
    data += [data[0], ("n", None, "d", "Share this page 1"), ("m", "s", "d", None), ("o", "few", "d1", "Share this page 1"), ("e", "s", "d0", "")]
    df = spark.createDataFrame(data, "id string, source string, doc string, text string").selectExpr("*", "1 as line", "2 as src")
    occurred = boilerplate.block_occurrences(df, "id", "source", "doc", "text")
    found = boilerplate.found_lines(occurred)
    assert {(r.id, r.line_no) for r in found.collect()} == {(f"b{k}", n) for k in range(10) for n in (1, 2)}
    assert len({r.block for r in found.collect()}) == 1  # consecutive lines are one block
    clean = {r.id: r.text for r in boilerplate.remove(df, occurred, "id", "text").collect()}
    assert clean["b0"] == "Own line a\n\nend q" and clean["m"] is None and clean["e"] == "" and clean["n"] == "Share this page 1"
    assert boilerplate.block_occurrences(df.limit(0), "id", "source", "doc", "text").collect() == []


# --- 3: look-alikes ---


@pytest.mark.parametrize(("a", "b"), [("ｆｕｌｌ", "full"), ("é", "é"), ("а̀", "à"), ("a­b", "ab"), ("각", "각"), ("ﬁn", "fin"), ("x y", "x y"), ("⼈", "人"), ("non‑stop", "non-stop"), ("e‍́", "é"), ("で", "で")])
def test_alike(a, b):
    assert lookalike.fold(a) == lookalike.fold(b)


@pytest.mark.parametrize(("a", "b"), [("é", "e"), ("A", "a"), ("x²", "x2"), ("①", "1"), ("a b", "ab"), ("!", "！"), (".", "。"), ("O", "0")])
def test_not_alike(a, b):
    assert lookalike.fold(a) != lookalike.fold(b)


def test_fold_is_idempotent_and_plain_stays():
    for t in ("fin first office stuff", "Größe façade œuvre", "", "​", "ｆﬁ Αа" * 10_000):
        assert lookalike.fold(lookalike.fold(t)) == lookalike.fold(t)
    assert lookalike.fold("fin first office stuff") == "fin first office stuff"


def test_pairs(spark):
    data = [("a", "Text"), ("b", "Тext"), ("c", "Text"), ("c", "Text"), ("d", "TEXT"), ("e", None), ("f", ""), ("g", "​"), (None, "Text")]
    df = spark.createDataFrame(data, "id string, text string").selectExpr("*", "1 as form", "2 as raw")
    counts = lookalike.member_counts(df, "text")
    assert counts["e"] == 5 and counts["Т"] == 1
    assert rows(lookalike.look_alike_pairs(df, "id", "text", counts)) == [("a", "b"), ("b", "c"), ("f", "g")]
    reps, members = lookalike.look_alike_classes(df, "id", "text", counts)
    assert rows(reps) == [("a", "b"), ("f", "g")]
    assert rows(members) == [("a", "a", "a"), ("b", "b", "a"), ("c", "a", "a"), ("f", "f", "f"), ("g", "g", "f")]
    assert lookalike.look_alike_pairs(df.limit(0), "id", "text", {}).collect() == []


# --- 4: language ---

TEXTS = {
    "en": "the table shows that the pressure was measured before the engine started and the report follows",
    "fr": "la pression a été mesurée avant le démarrage du moteur et le rapport suit avec les données",
    "de": "der Druck wurde vor dem Start des Motors gemessen und der Bericht folgt mit den Daten",
    "es": "la presión fue medida antes del arranque del motor y el informe sigue con los datos",
    "zh": "在发动机启动之前测量了压力，报告随后附上所有的数据和说明，请仔细阅读并保存。",
    "ja": "エンジンを始動する前に圧力を測定しました。報告書はデータと一緒に続きます。",
    "ko": "엔진을 시동하기 전에 압력을 측정했습니다. 보고서는 데이터와 함께 이어집니다.",
}


def test_language(spark):
    model = language.train([(t, x) for x, t in TEXTS.items() for _ in range(4)])
    got, sure, _ = model.label([*TEXTS.values(), "", "123", "unseenword pressured"])
    assert got[:7] == list(TEXTS) and got[7:9] == [None, None] and got[9] == "en" and all(0 <= s <= 1 for s in sure)
    data = [("1", "d", TEXTS["en"] + "\n\n" + TEXTS["fr"] + "\n\n# " + TEXTS["de"], "en_GB"), ("1", "d", TEXTS["en"] + "\n\n" + TEXTS["fr"] + "\n\n# " + TEXTS["de"], "en_GB"), ("2", "d", TEXTS["fr"], None), ("3", "d", None, "n/a"), ("4", "e", "short", "de")]
    df = spark.createDataFrame(data, "id string, doc string, text string, lang string").selectExpr("*", "1 as letters", "2 as para_no")
    found = language.segments(df, model, "id", "doc", "text", "lang")
    assert {(r.id, r.para_no, r.language, r.label) for r in found.collect()} == {("1", 0, "en", "en"), ("1", 1, "fr", "en"), ("2", 0, "fr", None)}
    doc = language.document_languages(found).collect()
    assert [(r.doc, r.language, r.major) for r in doc] == [("d", "fr", True)]
    assert language.segments(df.limit(0), model, "id", "doc", "text", "lang").collect() == []


def test_every_label(spark):
    from siftwell.llm import queries

    model = language.train([(t, x) for x, t in TEXTS.items() for _ in range(4)])
    data = [("1", "d", "text", TEXTS["fr"] + "\n\n# " + TEXTS["de"] + "\n\n12 34\n\nthe report", "en"), ("2", "d", "table", TEXTS["es"] + "\n\n1 | 2", None), ("3", "d", "text", None, "en"), ("4", "e", "text", "der Bericht", "de"), ("5", "g", "image", "", None)]
    blocks = spark.createDataFrame([*data, data[0], data[2]], "id string, doc_id string, type string, content string, language string")
    files = spark.createDataFrame([("d",), ("e",), ("f",)], "id string")
    got = queries._labels(blocks, files, model).collect()
    want = {("1", 0): "fr", ("1", 1): "de", ("1", 2): None, ("1", 3): "en", ("4", 0): "de", ("1", -1): "fr", ("2", -1): "es", ("3", -1): None, ("4", -1): "de", ("5", -1): None, ("d", -1): "fr", ("e", -1): "de", ("f", -1): None, ("g", -1): None}
    assert {(r.item, r.para_no): r.language for r in got} == want and len(got) == len(want)
    assert all((r.confidence == 0) == (r.language is None) for r in got)


def test_labels(spark):
    df = spark.createDataFrame([("en-US",), ("German",), (" zh-Hans",), ("und",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(language.label_code(df.x)).collect()] == ["en", "de", "zh", None, None, None]


# --- 5: splitting ---


@pytest.mark.parametrize("text", ["word " * 3000, "No spaces" * 2000, "一二三四五。" * 1500, "Para one.\n\n" * 700, "x" * 5000, "a" * 2051, "", "# H\n\nbody. " * 600, "\n" * 4000])
def test_pieces_round_trip(text):
    got = splitting.pieces(text, 512, 64)
    assert all(len(p) // 4 <= 512 for p in got)
    assert (got[0] if got else "") + "".join(p[256:] for p in got[1:]) == text
    for a, b in itertools.pairwise(got):
        assert a[-256:] == b[:256]


def test_pieces_cut_at_paragraphs():
    text = "\n\n".join(["Some sentence here. Another one there." * 8] * 20)
    got = splitting.pieces(text, 512, 64)
    assert len(got) > 1 and all(p.endswith("\n\n") for p in got[:-1])


def test_split_oversized(spark):
    data = [("a", "long text. " * 400, "T", 2), ("a", "long text. " * 400, "T", 2), ("b", "short", None, 0), ("c", None, "x", 1), (None, "y" * 9000, "x", 1)]
    df = spark.createDataFrame(data, "id string, text string, title string, title_level int").selectExpr("*", "1 as piece")
    got = splitting.split_oversized(df, "id", "text", ["title", "title_level"]).collect()
    assert {r.id for r in got} == {"a"} and {r.title for r in got} == {"T"} and len(got) == len({r.piece_no for r in got}) == len(splitting.pieces("long text. " * 400))
    with pytest.raises(ValueError):
        splitting.pieces("x", 10, 10)


# --- 6: neighbours ---


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8)).astype("float32")
    data = [(f"v{k:03d}", [float(x) for x in r]) for k, r in enumerate(v)]
    bad = [("null", None), ("short", [1.0]), ("zero", [0.0] * 8), ("zero2", [0.0] * 8), ("nan", [float("nan")] * 8), ("inf", [float("inf")] * 8), data[0]]
    copies = [(f"w{k}", data[5][1]) for k in range(8)]
    df = spark.createDataFrame(data + bad + copies, "id string, e array<float>").selectExpr("*", "1 as vec", "2 as h1")
    got = {}
    for r in neighbours.nearest(df, "id", "e", 8, k=3, relax=1.0, shard=50, fit_rows=100).collect():
        got.setdefault(r.id, []).append((round(-r.similarity, 5), r.other))
    every = dict(data) | dict(copies)
    u = {k: np.array(x) / np.linalg.norm(x) for k, x in every.items()}
    for k in ("v000", "v005", "v123", "w3", "w7"):
        best = sorted((round(-float(u[k] @ x), 5), o) for o, x in u.items() if o != k)[:3]
        assert sorted(got[k]) == best
    assert set(got) == set(every)
    assert neighbours.nearest(df.limit(0), "id", "e", 8).collect() == []


def test_recall_of_the_relaxed_search(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(3000, 24)) @ rng.normal(size=(24, 64))).astype("float32")
    df = spark.createDataFrame([(f"v{k:04d}", [float(x) for x in r]) for k, r in enumerate(v)], "id string, e array<float>")
    got = neighbours.nearest(df, "id", "e", 64, k=5, relax=neighbours.RELAX_ALL, shard=500, fit_rows=500).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    best = {f"v{k:04d}": {f"v{j:04d}" for j in np.argpartition(-r, 5)[:5]} for k, r in enumerate(cos)}
    found = got.groupby("id")["other"].agg(set)
    assert len(found) == 3000 and sum(len(found[k] & b) for k, b in best.items()) >= 0.9 * 5 * 3000


# --- 7: scans ---


WORDS = "the laboratory measures long-term agreement medium monitor converter before single licence guides controller außerdem".split()


class Options(dict):
    """Candidates among WORDS, found as they are asked for."""

    def get(self, word, other=()):
        return [(c, 50, cost, at) for c, cost, at in scans.candidates(word, scans.Trie(WORDS))]


def reader():
    return scans.Reader(dict.fromkeys(WORDS, 50), Options(), {}, 1000)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_brute_force():
    tries = scans.Trie(WORDS)
    for read in ("meclium", "rnonitor", "c0nverter", "smgle", "|icence", "bcfore", "zzz", "the", "cantrallcr"):
        brute = {w for w in WORDS if (at := scans.explain(read, w)) is not None and len(at) <= 2}
        assert {c for c, _, _ in tries.search(scans.Automaton(read, 2, 0))} == brute
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(120)})
    for read in [*words[:20], "abcab", "x", "aaaaaa"]:
        for most in (1, 2):
            brute = {(w, distance(read, w)) for w in words if distance(read, w) <= most}
            assert {(c, o) for c, _, o in scans.Trie(words).search(scans.Automaton(read, 0, most))} == brute


def test_edits_of_other_kinds_need_a_reason():
    r = reader()
    assert r.mend("auBerdem") == ("außerdem", [2]) and r.mend("mea#ures")[0] == "measures"
    assert r.mend("medixm") is None and r.mend("Medixm") is None
    assert scans.Reader(r.words, r.options, {("the", "medium"): 9}, 1000).mend("medixm", "the") == ("medium", [4])
    assert scans.Reader(r.words, r.options, {}, 10**9).mend("Meclium") is None  # as rare as a name


def test_read_block():
    found, text = scans.read_block("The Sudolko |icence guides. The meclium labo‐\nratory measures the long-\nterm agreement. 8efore the con-\ntroller", reader(), None, None)
    assert found == [(0, "chars"), (0, "hyphen"), (2, "hyphen")] or found == [(0, "chars"), (0, "hyphen"), (2, "chars"), (2, "hyphen")]
    assert text == "The Sudolko licence guides. The medium laboratory measures the long-term agreement. Before the controller"
    assert scans.read_block("the long-\n+erm agreement", reader(), None, None) == ([(1, "chars")], "the long-term agreement")
    assert scans.read_block("", reader(), None, None) == ([], "")


def test_scans(spark):
    clean = "the laboratory measures the long-term agreement before the monitor. " * 30
    content = spark.createDataFrame([("c", "x", 0, 0, "text", clean, ("body",)), ("pg", "d", 0, None, "text", "HEAD\nthe rnonitor labo-\nPage 1", ("page",)), ("n", None, 1, None, "text", None, None)], "id string, doc_id string, pos int, page_num int, type string, content string, metadata struct<layout_type string>")
    blocks = [("t1", "d", 0, "HEAD", 10.0, 20.0), ("t2", "d", 0, "the rnonitor labo-", 100.0, 120.0), ("t2", "d", 0, "the rnonitor labo-", 100.0, 120.0), ("t3", "d", 0, "Page 1", 780.0, 790.0), ("t4", "d", 1, "ratory measures.", 100.0, 120.0), ("t5", "d", 1, None, 1.0, 2.0), (None, "d", 1, "x", 1.0, 2.0)]
    b = spark.createDataFrame(blocks, "id string, doc_id string, page_num int, text string, y0 double, y1 double").selectExpr("*", "1 as line0", "2 as height")
    h = spark.createDataFrame([("d", 0, 800.0), ("d", 1, 800.0)], "doc_id string, page_num int, height double")
    got = rows(scans.faults(b, h, content))
    assert got == [("pg", 0, "margin"), ("pg", 1, "chars"), ("pg", 1, "hyphen"), ("pg", 2, "margin"), ("t1", 0, "margin"), ("t2", 0, "chars"), ("t2", 0, "hyphen"), ("t3", 0, "margin")]
    assert rows(scans.paragraphs(b, h, content)) == [("d", 0, "the monitor laboratory measures.")]
    assert rows(scans.faults(b.limit(0), h, content)) == [("pg", 1, "chars"), ("pg", 1, "hyphen"), ("pg", 2, "margin")]  # the page is read itself
    assert scans.faults(b.limit(0), h, content.where("id = 'c'")).collect() == []


def test_pages_without_layout(spark):
    clean = "the laboratory measures the long-term agreement before the monitor. " * 30
    words = ["measures", "agreement", "before", "laboratory"]
    pages = [(f"p{k}", "d", k, k, "text", f"Annual Report {k}\nthe rnonitor {words[k]}\nthe {words[k - 1]}.\nPage {k}", ("page",)) for k in range(4)]
    content = spark.createDataFrame([("c", "x", 0, 0, "text", clean, ("body",)), *pages, pages[0], ("one", "e", 0, 0, "text", "the rnonitor", ("page",)), ("void", "e", 1, 1, "text", "", ("page",))], "id string, doc_id string, pos int, page_num int, type string, content string, metadata struct<layout_type string>")
    b = spark.createDataFrame([], "id string, doc_id string, page_num int, text string, y0 double, y1 double")
    h = spark.createDataFrame([], "doc_id string, page_num int, height double")
    want = [(f"p{k}", n, f) for k in range(4) for n, f in ((0, "margin"), (1, "chars"), (3, "margin"))]
    assert rows(scans.faults(b, h, content)) == [("one", 0, "chars"), *want]
    assert rows(scans.paragraphs(b, h, content))[0][:2] == ("d", 0)


def test_numbers_in_the_body_stay(spark):
    content = spark.createDataFrame([("c", "x", 0, 0, "text", "the laboratory measures the monitor. " * 30, ("body",))], "id string, doc_id string, pos int, page_num int, type string, content string, metadata struct<layout_type string>")
    blocks = [("a", 0, "17215", 101.0), ("b", 0, "the monitor measures the labo-", 200.0), ("c", 0, "12.5", 300.0), ("d", 0, "7", 790.0), ("e", 1, "3,000", 101.0), ("f", 1, "ratory works.", 200.0), ("g", 1, "the monitor.", 250.0), ("h", 1, " ", 300.0), ("i", 2, "2 | 4", 200.0), ("j", 3, "the laboratory measures", 200.0), ("k", 4, "the monitor", 200.0), ("l", 4, "8", 300.0), ("m", 5, "before.", 200.0)]
    b = spark.createDataFrame([(i, "d", p, t, y, y + 8) for i, p, t, y in blocks], "id string, doc_id string, page_num int, text string, y0 double, y1 double")
    h = spark.createDataFrame([("d", p, 842.0) for p in range(6)], "doc_id string, page_num int, height double")
    want = ["17215", "the monitor measures the laboratory works.", "12.5", "3,000", "the monitor.", "2 | 4", "the laboratory measures the monitor before.", "8"]
    assert rows(scans.paragraphs(b, h, content)) == [("d", k, t) for k, t in enumerate(want)]


# --- 8: packing ---


def test_pack():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 200))]
        bins = packing.pack(sizes, 100)
        load: dict[int, list[int]] = {}
        for s, b in zip(sizes, bins, strict=True):
            load.setdefault(b, []).append(s)
        assert all(sum(x) <= 100 for x in load.values())
        assert all(sum(3 * s > 100 for s in x) <= 2 for x in load.values())
        assert len(load) <= max(1, int(1.25 * -(-sum(sizes) // 100)) + 1) or sum(s > 50 for s in sizes) >= 0.75 * len(load)


def test_fill(spark):
    data = [(k, "a b c " * n) for k, n in enumerate([1, 5, 400, 900, 0, 3])] + [(1, "a b c " * 5), (9, None), (None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as size", "2 as shard", "3 as part")
    got = packing.fill(df, "doc_id", packing.token_count(df.text), 1024).collect()
    total = {}
    for r in got:
        total[r.id] = total.get(r.id, 0) + r.tokens
        assert 0 < r.tokens <= 1024
    assert total == {0: 3, 1: 15, 2: 1200, 3: 2700, 5: 9} and {r.id for r in got if r.parts > 1} == {2, 3}
    assert packing.fill(df.limit(0), "doc_id", packing.token_count(df.text)).collect() == []


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, wörld 12!",), ("中文abc ー한",), ("",), (None,), ("\uf06c one \u200btwo\x07",)], "t string")
    assert [r[0] for r in df.select(packing.token_count(df.t)).collect()] == [5, 5, 0, None, 3]


# --- 9: leakage ---


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    items = [(i, "Answer the question.\n" + " ".join(rng.choices(vocab, k=45))) for i in range(6)] + [(6, "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇宙洪荒日月盈昃"), (7, None)]
    docs = []
    for d in range(80):
        w = rng.choices(vocab, k=30)
        src = rng.choice(items[:6])[1].split("\n")[1].split()
        n = rng.randrange(10, 30)
        at = rng.randrange(0, 45 - n)
        part = [x if rng.random() > 0.06 * (d % 4) else "zzz" for x in src[at : at + n]]
        docs.append((d, " ".join(w[:15]) + "\n- **" + ", ".join(part).upper() + "** " + " ".join(w[15:])))
    docs += [(100, "前言" + items[6][1][:32]), (101, items[6][1][:20]), (102, None), (103, ""), docs[0]]
    df = spark.createDataFrame(docs, "id long, text string").selectExpr("*", "1 as item")
    got = set(rows(leakage.leaks(df, "id", "text", spark.createDataFrame(items, "i long, t string"), "i", "t")))
    number, brute = leakage.Numbers(), set()
    plain = [(i, t.removeprefix("Answer the question.\n")) for i, t in items if t]
    for d, t in docs:
        for i, passage in plain if t else ():
            u = leakage.unit_of(passage)
            ids, item = number(u, t), number(u, passage)
            if any(leakage.holds(leakage.UNITS[u], ids, item, off) for off in range(-len(item), len(ids))):
                brute.add((d, i))
    assert got == brute
    assert (100, 6) in got and len(got) > 5
    assert leakage.leaks(df.limit(0), "id", "text", spark.createDataFrame(items, "i long, t string"), "i", "t").collect() == []
    assert leakage.leaks(df, "id", "text", spark.createDataFrame([], "i long, t string"), "i", "t").collect() == []


# --- 10: residue ---


def test_residue(spark):
    prose = [f"The {a} {b} measures the pressure in the vessel and the {c} report follows within {k} days." for k, (a, b, c) in enumerate(itertools.product(["old", "new", "northern"], ["pump", "valve", "sensor"], ["annual", "monthly"]))]
    corpus = [*prose, "The pump template uses a name in its header.", "It once said so in the template header, where a page may not be found."] * 20
    bad = ["# Not Found\n\nThe requested URL was not found on this server.", "My title\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit.", "Please enable JavaScript and cookies to continue.", "Dear {{name}}, the report follows.", "Call [Insert name here] now.", "quux zork. " * 40]
    good = [prose[0], "The pump template uses `{{name}}` in its header.", "```\necho ${HOME}\n```\n" + prose[1], "", prose[2] * 3 + " It once said page not found. " + prose[3] * 3, prose[5] * 500]
    data = [(k, t, "My title") for k, t in enumerate(bad + good)] + [(0, bad[0], None), (99, None, None)] + [(1000 + k, t, None) for k, t in enumerate(corpus)]
    df = spark.createDataFrame(data, "doc_id long, text string, title string").selectExpr("*", "1 as why", "2 as h", "3 as at")
    got = {r.id for r in residue.residue(df, residue.fit(df, "text", "title"), "doc_id", "text", "title").collect()}
    assert got == set(range(len(bad)))
    assert residue.residue(df.limit(0), residue.fit(df.limit(0), "text", "title"), "doc_id", "text", "title").collect() == []


def test_coverage_of_several_texts_is_that_of_each():
    rng = random.Random(6)
    prose = ["".join(rng.choices("abcde ", k=400)) for _ in range(20)]
    base = residue.count(prose)
    model = residue.Detector([residue.ratio(residue.seeds()[1], base)], residue.ratio(residue.seeds()[2], base))
    texts = ["", "page not found", "x", *prose, "access denied. " * 9, "a b c page not found " + prose[0]]
    assert model.coverage(texts).tolist() == pytest.approx([model.coverage([t])[0] for t in texts])
    assert model.coverage(["page not found"])[0] == 1
