"""Template residue and error-page text.

Character n-gram models are fitted for filler, for error notices, for template marks and for natural
prose. Windows whose likelihood under a residue model exceeds that under prose are marked; a text is
excluded if they cover most of what stands below its title. A placeholder that should have been filled
in excludes a text too, unless it is quoted as code: it has the form of one and is likelier under the
model of template marks than under prose.

The models are taken from the whole corpus. Prose is counted over all texts, short ones weighing less,
as notices are short; texts that say a few words over and over teach filler; what usual wordings of
servers, frameworks and templates (the seeds) mark among the short texts teaches the corpus's own
notices. Counts are scaled to fixed sums, so that verdicts don't depend on the corpus's size; the
tables have a fixed number of slots. Null texts are left out of the result; empty texts are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.lookalike import fold
from siftwell.session import filled

# The seeds, usual wordings of filler and of the notices of servers, frameworks and browsers, digits as 0.
FILLER = """lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
placeholder text. sample text. dummy text. insert your text here. type your text here. add content here. replace this text with your own. qwertyuiop asdfghjkl zxcvbnm. qwerty. xxx. xxxx. xxxxx. aaaa. test. test test. coming soon. to do. tbd.
platzhaltertext. beispieltext. blindtext. hier text einfügen. texte d'exemple. texte à remplacer. insérez votre texte ici. texto de ejemplo. texto de relleno. escriba aquí su texto. 示例文字。占位符文本。请在此输入内容。サンプル文章。ダミーの文章。ここに入力してください。예시 문구입니다. 여기에 입력하세요."""
NOTICES = """not found. the requested url was not found on this server. page not found. the page you requested does not exist. error 000. status code: 000. 000 not found. 000 forbidden. 000 unauthorized. 000 gone. 000 internal server error. 000 bad gateway. 000 service unavailable. 000 gateway timeout. 000 too many requests. http/0.0 000 ok. server: apache. server: nginx.
you don't have permission to access this resource. access denied. unauthorized. authentication required. please sign in. please log in to continue.
the server encountered an internal error or misconfiguration and was unable to complete your request. the server is temporarily unable to service your request due to maintenance downtime or capacity problems. an error occurred. request id. reference number. ray id. host.
checking your browser before accessing the site. this process is automatic. your browser will redirect shortly. verify you are human. i'm not a robot. please complete the security check. our systems have detected unusual traffic from your network. loading. please wait.
you need to enable javascript to run this app. please enable javascript and cookies to continue. this page doesn't work without javascript. <noscript>javascript is disabled.</noscript> your browser is not supported. please upgrade your browser.
your session timed out. please log on again. this content is no longer available.
der angeforderte url konnte auf dem server nicht gefunden werden. seite nicht gefunden. zugriff verweigert. sie sind nicht berechtigt, auf diese seite zuzugreifen. interner serverfehler. der dienst ist zur zeit nicht verfügbar. bitte versuchen sie es später noch einmal. die sitzung wurde beendet. melden sie sich erneut an. javascript ist deaktiviert. bitte aktivieren sie javascript in ihrem browser. bitte warten. es ist ein fehler aufgetreten.
l'url demandée n'a pas pu être trouvée sur ce serveur. page non trouvée. accès interdit. vous n'avez pas le droit d'accéder à cette page. erreur interne du serveur. le service est indisponible pour le moment. votre session est expirée. veuillez vous reconnecter. javascript est désactivé. veuillez activer javascript dans votre navigateur. veuillez patienter. une erreur s'est produite.
no se ha localizado la url solicitada en este servidor. página no encontrada. acceso prohibido. no tiene permiso para acceder a esta página. error interno del servidor. servicio no disponible en este momento. vuelva a intentarlo más tarde. su sesión ha expirado. inicie sesión de nuevo. javascript está desactivado. active javascript en su navegador. espere, por favor. se produjo un error.
请求的网址在此服务器上未找到。页面未找到。访问被拒绝。您无权访问此页面。服务器内部错误。服务暂时无法使用。请稍后重试。您的会话已超时，请重新登录。请在浏览器中启用 javascript。请稍候。发生错误。
要求された url は本サーバでは見つかりませんでした。ページが見つかりません。アクセスが禁止されています。このページにアクセスする権限がありません。サーバー内部エラー。サービスは現在利用できません。後でもう一度お試しください。セッションがタイムアウトしました。もう一度ログインしてください。ブラウザーの javascript を有効にしてください。しばらくお待ちください。エラーが発生しました。
요청한 url을 이 서버에서 찾을 수 없습니다. 접근이 금지되었습니다. 이 페이지에 접근할 권한이 없습니다. 내부 서버 오류. 서비스를 현재 사용할 수 없습니다. 나중에 다시 시도하십시오. 세션이 종료되었습니다. 다시 로그인하십시오. 브라우저에서 자바스크립트를 활성화하세요. 기다려 주십시오. 오류가 발생했습니다."""
# What templates ask for, and their marks around it.
FIELDS = "name title date city email phone address company product version number client user first_name insert enter your here value"
FORMS = "{{{{{0}}}}}|{{{{ {0} }}}}|{{% {0} %}}|${{{0}}}|$({0})|<<{0}>>|<%= {0} %>|[[{0}]]|[% {0} %]|@@{0}@@|##{0}##|#{0}#|%{0}%|%%{0}%%|__{0}__|<{0}>|[insert {0}]|[your {0} here]|[enter {0}]|(insert {0} here)|<add {0} here>"
# The forms in which templates mark what should be filled in.
PLACEHOLDERS = re.compile(
    r"\{\{\s*[\w.]+\s*\}\}|\{%\s*[\w.]+\s*%\}|\$\{\s*[\w.]+\s*\}|\$\([A-Za-z_]\w+\)|<<\s*[\w .]+\s*>>|<%=?\s*[\w.]+\s*%>|\[\[\s*[\w ]+\s*\]\]|\[%\s*\w+\s*%\]"
    r"|@@\w+@@|##\w+##|#[A-Z][A-Z_]{2,}#|%%?[A-Z][A-Z_]{2,}%%?|\b__[A-Z][A-Z_]{2,}__\b|<[A-Z][A-Z]*(?:_[A-Z]+)*>"
    r"|[\[<(](?i:(?:insert|enter|add|your|fill in|type)\s+[\w' ]{2,40}?(?:\s+here)?)[\])>]"
)
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|``.+?``|`[^`\n]*`|<(code|pre)>.*?</\1>", re.S | re.I)
HINT = re.compile(r"\{[{%]|\$[{(]|<[<%A-Z]|\[[\[%]|@@|##\w|#[A-Z]|%[A-Z]|__[A-Z]|[\[<(](?i:insert|enter|add|your|fill|type)")
BITS = 17
WIDTH = 4
UNSEEN, UNSEEN_KIND = 1 / 200, 1 / 50  # the smoothed count of a character not seen after its context
SEED_WEIGHT = 8
PROSE, LEARNT = 1.5e6, 3e4  # what the counts of prose, and those learnt of each kind of residue, are scaled to
SHORT = 300  # characters from which a text counts fully as prose, and below which notices are learnt
WINDOW = 20
PIECE = 500_000  # characters looked at together


def prepare(text: str) -> str:
    """Lower case, one form, digits alike, white space as single spaces."""
    return re.sub(r"\s+", " ", re.sub(r"\d", "0", fold(text).lower())).strip()


def marks_of(placeholder: str) -> str:
    """A placeholder with one letter for each word: what it asks for doesn't matter."""
    return re.sub(r"[^\W_]+(?:[_.'][^\W_]+)*", "x", prepare(placeholder))


def below_title(text: str, title: str | None) -> str:
    """The text without its first line if that is a title and not all there is."""
    first, _, rest = text.lstrip().partition("\n")
    if rest.strip() and (first.startswith("#") or (title and fold(first).strip("#* ").lower() == fold(title).strip().lower())):
        return rest
    return text


def over_and_over(text: str) -> bool:
    """Whether a text says a few words again and again."""
    words = text.replace("。", "。 ").split()
    n = len(set(words))
    return len(words) >= 4 and n <= 8 and 3 * n <= len(words)


def pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of bounded length, each with the number of its first; a long text is a run by itself."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each character of several texts: the slots of the n-gram and of the context that end there, its code, its text; and the texts' lengths."""
    pad = WIDTH - 1
    size = np.array([len(t) for t in texts])
    c = np.frombuffer("".join(" " * pad + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    h = np.zeros(len(c) - pad, "uint64")
    for k in range(pad):
        h = h * np.uint64(0x9E3779B1) + c[k : k + len(h)]
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype("int64")
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(owner)) + pad * owner  # the spaces before each text are no characters of it
    h, code = h[at], c[at + pad]
    return mix(h * np.uint64(0x9E3779B1) + code), mix(h), code, owner, size


def count(texts: Iterable[str], weights: Iterable[float] | None = None) -> np.ndarray:
    """Hashed counts of n-grams (first row) and contexts of prepared texts."""
    texts = list(texts)
    w = np.ones(len(texts)) if weights is None else np.array(list(weights))
    out = np.zeros((2, 1 << BITS))
    for at, some in pieces(texts):
        gram, context, _, owner, _ = slots(some)
        for row, place in zip(out, (gram, context), strict=True):
            row += np.bincount(place, w[at + owner], 1 << BITS)
    return out


def scaled(counts: np.ndarray, to: float) -> np.ndarray:
    return counts * (to / max(1.0, counts[0].sum()))


def ratio(kind: np.ndarray, prose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P(kind) - log P(prose) of a character after its context is the first table's entry less the second's."""
    a = np.log(kind[0] + UNSEEN_KIND) - np.log(prose[0] + UNSEEN)
    b = np.log(kind[1] + 1) - np.log(prose[1] + 1)
    return a.astype("float32"), b.astype("float32")


class Detector:
    """The fitted models, as tables of likelihood ratios: those of residue, and that of template marks."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], marks: tuple[np.ndarray, np.ndarray], cover: float = 0.5) -> None:
        self.tables, self.marks, self.cover = tables, marks, cover

    def coverage(self, texts: list[str]) -> np.ndarray:
        """The share of each prepared text's visible characters that lie in windows of residue."""
        out = np.zeros(len(texts))
        for first, some in pieces(texts):
            gram, context, code, owner, size = slots(some)
            if not len(gram):
                continue
            at = np.arange(len(gram))
            wide = np.minimum(WINDOW, size)[owner]
            whole = at + wide <= np.cumsum(size)[owner]
            at, wide = at[whole], wide[whole]
            marked = np.zeros(len(gram) + 1, "int64")
            for a, b in self.tables:
                total = np.concatenate([[0.0], np.cumsum(a[gram] - b[context], dtype="float64")])
                found = total[at + wide] - total[at] > 1e-9
                marked[at[found]] += 1
                marked -= np.bincount(at[found] + wide[found], minlength=len(marked))
            inside = np.cumsum(marked[:-1]) > 0
            visible = code != 32
            out[first : first + len(some)] = np.bincount(owner, inside & visible, len(some)) / np.maximum(1, np.bincount(owner, visible, len(some)))
        return out

    def unfilled(self, text: str) -> bool:
        """Whether a text holds a placeholder outside quoted code."""
        if not HINT.search(text):
            return False
        found = [marks_of(m[0]) for m in PLACEHOLDERS.finditer(CODE.sub(" ", text))]
        a, b = self.marks
        return any((a[g] - b[c]).sum() > 0 for f in found for g, c in [slots([f])[:2]])

    def judge(self, texts: list[str], titles: list[str | None]) -> tuple[list[str | None], np.ndarray]:
        """Why texts are residue ('placeholder' or 'notice or filler'; null if they aren't), and their coverage."""
        marked = [self.unfilled(t) for t in texts]
        share = self.coverage([prepare(below_title(t, h)) for t, h in zip(texts, titles, strict=True)])
        return ["placeholder" if m else "notice or filler" if c >= self.cover else None for m, c in zip(marked, share, strict=True)], share


def seeds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the seeds of filler, of notices and of template marks."""
    filler, notices = (SEED_WEIGHT * count(prepare(x) for x in s.split("\n")) for s in (FILLER, NOTICES))
    return filler, notices, SEED_WEIGHT * count(marks_of(f.format(x)) for f in FORMS.split("|") for x in FIELDS.split())


def sums(df: DataFrame, text: str, title: str, kinds: int, part: Callable[[list[str]], np.ndarray]) -> np.ndarray:
    """part's counts (kind, n-gram or context, slot) of prepared texts, summed over all rows; no more than the tables reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((kinds, 2, 1 << BITS))
        for b in batches:
            total += part([prepare(below_title(t, h)) for t, h in zip(b["t"], b["h"], strict=True)])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total.ravel()[at]})

    got = df.select(F.col(text).alias("t"), F.col(title).alias("h")).dropna(subset=["t"]).mapInPandas(filled(run), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(kinds * 2 << BITS)
    out[got["at"].to_numpy("int64")] = got["n"].to_numpy("float64")
    return out.reshape(kinds, 2, 1 << BITS)


def fit(df: DataFrame, text: str, title: str) -> Detector:
    """Fit on all rows: one pass for prose and filler, one over the short texts for notices."""

    def first(texts: list[str]) -> np.ndarray:
        again = [over_and_over(t) for t in texts]
        weights = [0.0 if x else min(1.0, len(t) / SHORT) ** 2 for t, x in zip(texts, again, strict=True)]
        return np.stack([count(texts, weights), count(t for t, x in zip(texts, again, strict=True) if x)])

    prose, repeated = sums(df, text, title, 2, first)
    prose = scaled(prose, PROSE)
    filler, notices, marks = seeds()
    filler = filler + scaled(repeated, LEARNT)
    begun = Detector([ratio(filler, prose), ratio(notices, prose)], ratio(marks, prose))
    shared = df.sparkSession.sparkContext.broadcast((begun.tables, begun.marks, begun.cover))

    def second(texts: list[str]) -> np.ndarray:
        own = Detector(*shared.value)
        some = [t for t in texts if len(t) < SHORT]
        return count(t for t, c in zip(some, own.coverage(some), strict=True) if c >= own.cover)[None]

    short = df.where(F.length(text) < 2 * SHORT)  # of the text with its title; what lies below that is measured itself
    notices = notices + scaled(sums(short, text, title, 1, second)[0], LEARNT)
    return Detector([ratio(filler, prose), ratio(notices, prose)], begun.marks)


def residue(df: DataFrame, model: Detector, ident: str, text: str, title: str) -> DataFrame:
    """(id, why, coverage) of every row that is residue, repeated ids once."""
    shared = df.sparkSession.sparkContext.broadcast((model.tables, model.marks, model.cover))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Detector(*shared.value)
        for b in batches:
            why, share = own.judge(list(b["t"]), list(b["title"]))
            out = pd.DataFrame({"id": b["id"].to_numpy(), "why": why, "coverage": share})
            yield out[out["why"].notna()]

    src = df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("t"), F.col(title).alias("title")).dropna(subset=["id", "t"])
    return src.mapInPandas(filled(part), "id long, why string, coverage double").dropDuplicates(["id"])
