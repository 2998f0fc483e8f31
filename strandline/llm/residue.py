"""Template residue, filler and error pages in place of content.

Character n-gram models are fitted for unfilled templates, filler, error pages
and script notices, and for natural prose. Each has two views of a segment: its
small letters, and its shape (runs of letters, digits and blanks are one sign
each), in which all slots of a template syntax look alike.

A text is cut into segments (sentences; lines that go on are joined), code is
masked, and in each segment the window with the largest log-likelihood ratio is
found. A segment is residue if the window is strong enough and covers at least
``PART`` of it, or is an unfilled template strong enough alone. A text is
excluded if its residue covers more than ``COVERAGE`` of it. The default is any
residue at all: here a part that stands where content should be is a case.

Fit: residue starts from short lists of common wordings of such notices (default
pages of web servers and frameworks, template syntaxes, canonical filler; from
general knowledge), prose from all segments of all documents. Windows the
models are sure of then teach their class the wordings of the corpus and leave
the prose, and the models are fitted again.

Scale: segments are written once and read once per round. A task adds its
n-grams up in arrays of 2^BITS cells; arrays are summed in two levels, and only
their sums (of fixed size) reach the driver. Every document is counted and
scored, whole; scoring is array arithmetic over a batch of documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, once

N, BITS = 5, 18
SIZE = 1 << BITS
#: least log-likelihood ratio of a window, and least part of its segment
STRENGTH, PART = 9.0, 0.5
#: a segment of more than SHORT n-grams needs more
SHORT, LONG_STRENGTH = 8, 14.0
#: enough per n-gram for the shortest segments, which can't reach STRENGTH
FULL = 1.5
#: a template window this strong counts whatever its part of the segment
ALONE = 20.0
#: strength and part of a segment the models are sure of, and strength of a
#: template window they are sure of alone (by its shape)
SURE = (16.0, 0.6, 16.0)
ROUNDS = 3
#: a text that is nothing but a notice is short: prose is first fitted on texts
#: of at least so many segments, then on all that is not sure to be residue
FIRST = 4
COVERAGE = 0.0
#: the examples are few, so an n-gram must be this much more likely in them
MARGIN = 1.2
#: log ratio of an n-gram that no residue example has
UNSEEN = -0.6
#: n-grams of a class the corpus may teach, in units of the examples'
TAUGHT = 4.0
#: share given to n-grams that prose does not have, in a corpus of any size
RARE = 3e-7
#: slices of an array of counts, and arrays summed at once
SLICES, FAN = 4, 64

RESIDUE = {
    "template": """
{{ page.title }}
{{title}} - {{ site.name }}
{{#each products}}{{/each}}
{{> sidebar }}
{% extends "base.html" %}
{% block content %}{% endblock %}
{% if logged_in %}
{% for row in rows %}
{{ user.first_name }} {{ user.last_name }}
<% if (ready) { %>
<%= order.total %>
<%= link_to post.title %>
<?= $heading ?>
${user.name}
${PRICE} for ${ITEM_COUNT}
$user.firstName
#foreach($row in $table)
#if($customer.active)
#set($x = $y)
$!{order.number}
%(total)s
%(first)s and %(last)d
%s: %d of %d
@@BUILD_NUMBER@@
@PROJECT_VERSION@
@PACKAGE_NAME@ @PACKAGE_VERSION@
Version @@VERSION_NUMBER@@ of @@PRODUCT_NAME@@
Welcome to __COMPANY_NAME__ __YEAR__
__APP_TITLE__
__TITLE__ __SUBTITLE__
##NAME##
[FIRST NAME] [LAST NAME]
[COMPANY]
[CITY, STATE ZIP]
[INSERT LOGO HERE]
[Your address goes here]
[insert link]
[Enter a heading]
[Insert description here]
[Insert author name here]
[Insert a summary of the project here]
[Add the description here]
[Add a title here]
[Describe your project here]
[Describe the feature here]
[Put your text here]
[Put a title here]
[REASON FOR CHANGE]
[DATE]
[Write the introduction]
[date of the event]
<first name>
<your address>
<INSERT TITLE>
<enter a short text about yourself>
Name: <name>
Date: DD/MM/YYYY
Due: MM-DD-YYYY
Dear {name},
Dear {{ customer }},
Hi {user},
Kind regards, {signature}
Kind regards, [Name]
Title: TITLE GOES HERE
Author: AUTHOR NAME
Phone: XXX-XXX-XXXX
XXXX XXXX XXXX
Good morning, undefined!
Hello null, you have NaN points.
Posted by undefined on Invalid Date
Your order of undefined costs NaN
[object Object], [object Object]
Total: NaN
TODO: write this section
TODO
TBA
To be determined
To be announced.
To be completed.
To be filled in.
To be written later.
Will be written.
TBD
TBD.
Coming soon...
Under construction.
More to come.
N/A
<!-- your text -->
<!-- explain why -->
<!-- remove this line -->
""",
    "filler": """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
Curabitur pretium tincidunt lacus nulla gravida orci a odio nullam varius turpis et commodo pharetra.
ipsum lorem amet sit dolor elit sed magna labore veniam nisi quis commodo tempor minim aliqua
Add your own text here.
Click here to edit this text.
This is a sample paragraph. Replace it with your own words.
Put your description in this place.
Type your message here.
Your text here.
Text here.
Some text goes here. Some more text goes here.
Replace this sentence with a description of the product.
This text is a placeholder. Replace it with your content.
Body text. Body text. Body text.
Heading goes here
asdfasdf jkl jkl qwer qwer
foo bar baz foo bar baz
bla bla bla bla
test test test test
""",
    "error": """
404 - File or directory not found.
HTTP Error 404.0 - Not Found
404. That's an error.
404 Not Found: The requested URL /index.html was not found on this server. Apache Server at localhost Port 80
The requested page /index.html was not found.
502 Bad Gateway nginx/1.18.0
503 Service Temporarily Unavailable nginx/1.18.0
504 Gateway Time-out nginx
403 Forbidden nginx
Internal Server Error: The server encountered an internal error or misconfiguration and was unable to complete your request.
The server encountered an unexpected condition that prevented it from fulfilling the request.
Request ID: 0f0e0d0c0b0a. Error code: 000
Error 404: The page does not exist or has been moved. Go back to the homepage.
Access Denied. You don't have permission to access "/index.html" on this server. Please sign in.
Oops! That page can't be found. Check the URL or go back to the home page.
Check the address and try again.
Application error: an error occurred while loading the page. See the console. at render (main.js:0:0000) Refresh the page or contact support.
Checking your browser before accessing the site. This process is automatic. Please allow up to 0 seconds.
Checking if the site connection is secure. This may take a few seconds.
Verify that you are human by completing the challenge below.
Your session has timed out. Please log in again.
You have sent too many requests in a given amount of time. Wait 00 seconds before you retry.
Fehler 404: Die Seite wurde nicht gefunden. Zurück zur Startseite.
Erreur 404 : la page demandée est introuvable. Retour à la page d'accueil
Error 404: la página solicitada no se encuentra. Volver al inicio
404 页面不存在。抱歉，您访问的页面不存在或已被删除。返回首页
Sorry, this page isn't available.
We couldn't find the page you were looking for.
The page you requested could not be found.
The document has moved or was deleted.
This site can't be reached.
The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.
500 - Internal server error.
Server Error in '/' Application.
An unexpected error has occurred. Please contact your administrator.
Oops, something broke on our side. Try to reload this page.
We're sorry, but something went wrong.
The server could not complete the request. Reference number: 00000
502 - Web server received an invalid response.
Bad gateway. The server returned an invalid or incomplete response.
503 - Service not available. The server is down for maintenance.
Gateway Time-out. The server did not respond in time.
401 - Unauthorized: Access is denied due to invalid credentials.
403 - Forbidden: You are not allowed to see this page.
You need permission to see this page. Please log in.
You must be signed in to view this page. Log in to continue.
Access to this resource on the server is denied.
Your connection was blocked. Please complete the security check to access the site.
One more step: please confirm that you are not a robot.
429 - Rate limit exceeded. Please slow down and try again later.
Please wait while we check your browser.
Seite nicht gefunden. Die angeforderte Seite existiert nicht (404). Zur Startseite
Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.
Zugriff verweigert. Sie haben keine Berechtigung.
Page non trouvée. La page que vous cherchez n'existe pas (erreur 404). Retour à l'accueil
Une erreur est survenue. Veuillez réessayer plus tard.
Página no encontrada. La página que busca no existe (error 404). Volver a la página principal
Se ha producido un error. Inténtelo de nuevo más tarde.
Pagina non trovata. La pagina richiesta non esiste.
Página não encontrada. A página que você procura não existe.
404 错误，找不到页面。您要访问的页面不存在。返回首页
抱歉，找不到该页面。服务器错误，请稍后再试。
お探しのページが見つかりません。
Страница не найдена. Ошибка 404.
""",
    "script": """
JavaScript must be enabled to use this application.
Please enable JavaScript to view this website.
Please enable JavaScript and reload the page to continue.
Turn on JavaScript in your browser settings to use this site.
You need to enable JavaScript to run this application.
Your browser has JavaScript turned off. This site works best with JavaScript on.
Scripts are blocked by your browser, so the page cannot be displayed.
This site requires scripts. Please enable scripts and try again.
This website needs JavaScript to work.
This page requires JavaScript, but it is turned off in your browser.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
Your browser does not support JavaScript.
Scripts are disabled. Enable scripts in your browser to see the content.
Cookies must be enabled to use this website.
Diese Website benötigt JavaScript. Bitte schalten Sie JavaScript in Ihrem Browser ein.
Bitte aktivieren Sie JavaScript, um diese Website zu nutzen.
Veuillez activer JavaScript pour utiliser ce site.
Ce site a besoin de JavaScript pour fonctionner.
Cette page nécessite JavaScript pour être affichée.
Por favor, habilite JavaScript en su navegador para ver este sitio.
请启用 JavaScript 以运行此应用。
JavaScript est désactivé. Veuillez activer JavaScript dans votre navigateur.
Este sitio necesita JavaScript. Active JavaScript en su navegador.
您的浏览器已禁用 JavaScript，请启用后刷新页面。
このサイトを利用するには JavaScript を有効にしてください。
""",
}
#: sentences about such things, which are content
PROSE = """
The designer filled the mockup with lorem ipsum until the copy arrived.
Users without JavaScript get the static page instead of the chart.
The handler returns 404 when the record is missing and 403 when the user lacks the right.
Our monitor counted 500 errors and timeouts at the gateway during the night.
The not found page now has a search field.
A placeholder such as name or title is replaced when the mail is sent.
The template engine replaces every variable between the braces.
The linter warns about words like todo and fixme.
We changed the text of the access denied message and added a link to the help page.
The function prints undefined if the key is missing, so we added a default.
The format string takes the number of files and the total size.
Let the set be {a, b, c} and map every x to {x : f(x) = 0}.
The job failed with an internal server error because the disk was full.
Enable the option in the settings before you start the server.
The page describes how to sign in and how to reset a password.
The example above shows what to do next:
Edit the file before you continue:
"""
CLASSES = list(RESIDUE)
#: the class of unfilled templates
TEMPLATE = CLASSES.index("template")
_FENCE = re.compile(r"^([ \t>*/#-]*)(```|~~~).*?^[ \t>*/#-]*\2[ \t]*$|^([ \t>*/#-]*)(```|~~~).*\Z", re.S | re.M)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"(?<=\s)[\"“][^\"”\n]+[\"”](?=[\s,.;:)!?]|$)")
_INDENT = re.compile(r"(?:^|(?<=\n\n))(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+", re.M)
_LEAD = re.compile(r"^[ \t]*(?:(?:[>|]|//+|/\*+|\*+/?|[-+]|#+(?=\s))[ \t]*)*")
_END = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")


def mask_code(text: str) -> str:
    """The text without fenced, indented, inline and quoted code. A fence that
    is never closed runs to the end."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "    " in text or "\t" in text:
        text = _INDENT.sub("\n", text)
    if "`" in text:
        text = _INLINE.sub(" c ", text)
    return _QUOTED.sub(" q ", text) if '"' in text or "“" in text else text


def segments(text: str) -> list[str]:
    """Sentences; a line that begins with a small letter goes on the one
    before, unless that one ended."""
    joined: list[str] = []
    fresh = True
    for line in mask_code(text).split("\n"):
        s = _LEAD.sub("", line).strip()
        if not s:
            fresh = True
            continue
        if not fresh and joined and s[0].islower() and joined[-1][-1] not in ".!?:":
            joined[-1] += " " + s
        else:
            joined.append(s)
        fresh = False
    return [p.strip() for s in joined for p in _END.split(s) if p.strip()]


# -- n-grams of many segments at once ------------------------------------


@lru_cache(None)
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """For the first 65 536 characters: its small form, and its shape sign."""
    low, shape = np.arange(65_536, dtype=np.uint32), np.arange(65_536, dtype=np.uint32)
    for i in range(65_536):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            small = c.lower()
            low[i] = ord(small) if len(small) == 1 and ord(small) < 65_536 else i
            shape[i] = ord("a")
        elif kind == "Nd":
            low[i] = shape[i] = ord("0")
        elif c.isspace():
            low[i] = shape[i] = ord(" ")
    return low, shape


class Grams:
    """Hashed n-grams of a list of segments in both views. Segments are padded;
    the n-grams of segment i are [at[i], at[i + 1])."""

    def __init__(self, segs: list[str]) -> None:
        lens = np.fromiter((len(s) for s in segs), np.int64, len(segs))
        raw = np.frombuffer("".join(segs).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low, shape = _signs()
        at = np.minimum(raw, 65_535)
        seg = np.repeat(np.arange(len(segs)), lens)
        self.views = [self._view(low[at], seg, len(segs), (ord(" "), ord("0"))), self._view(shape[at], seg, len(segs), (ord(" "), ord("0"), ord("a")))]

    @staticmethod
    def _view(c: np.ndarray, seg: np.ndarray, n: int, runs: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        if len(c):
            again = np.append(False, (c[1:] == c[:-1]) & (seg[1:] == seg[:-1]))
            keep = ~(again & np.isin(c, runs))
            c, seg = c[keep], seg[keep]
        size = np.bincount(seg, minlength=n) + 4
        start = np.append(0, np.cumsum(size))
        full = np.full(start[-1], ord(" "), dtype=np.uint64)
        full[np.arange(len(c)) + 4 * seg + 2] = c
        h = np.zeros(max(0, len(full) - N + 1), dtype=np.uint64)
        for i in range(N):
            h = (h * np.uint64(1_000_003)) ^ full[i : len(full) - N + 1 + i]
        h ^= h >> np.uint64(29)
        h = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
        # windows that begin in the last N - 1 signs of a segment reach the next
        at = start - np.arange(n + 1) * (N - 1)
        ok = np.ones(start[-1], dtype=bool)
        for i in range(1, N):
            ok[start[1:] - i] = False
        return h[ok[: len(h)]], at


class Models:
    """Log ratio of each hashed n-gram per view and class against prose."""

    def __init__(self, tables: list[np.ndarray]) -> None:
        self.tables = tables
        self.best = [np.maximum(t.max(axis=0), 0) for t in tables]

    @classmethod
    def fit(cls, prose: np.ndarray, taught: np.ndarray) -> Models:
        """``prose`` (views x cells) and ``taught`` (views x classes x cells)
        are counts over the corpus; the examples are added here."""
        tables = []
        told = Grams([s for s in PROSE.strip().split("\n")])
        given = [Grams(t.strip().split("\n")) for t in RESIDUE.values()]
        for v in range(2):
            n = prose[v].astype(float)
            total = n.sum()
            p = np.log(n / max(total, 1.0) + RARE)
            k = np.bincount(told.views[v][0], minlength=SIZE)
            # sentences about residue count as a fixed part of prose
            p = np.maximum(p, np.log((k + 1e-9) / max(1, k.sum())))
            t = np.full((len(CLASSES), SIZE), UNSEEN, dtype=np.float32)
            for i, g in enumerate(given):
                c = np.bincount(g.views[v][0], minlength=SIZE).astype(float)
                more = taught[v][i].astype(float)
                if more.sum():
                    more *= min(1.0, TAUGHT * c.sum() / more.sum())
                    # what the corpus taught only once in a while is no wording
                    more[more < 0.25] = 0
                    c += more
                q = np.log(np.maximum(c, 0.25) / c.sum())
                t[i] = np.where(c > 0, np.clip(q - p - MARGIN, -3, 3), UNSEEN)
            tables.append(t)
        return cls(tables)

    def judge(self, g: Grams, strength: float = STRENGTH, part: float = PART, alone: float = ALONE, words: float = ALONE) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Per segment class (-1 for content) and strength of its window; per
        view the class of each n-gram's window (-1 outside of windows)."""
        n = len(g.views[0][1]) - 1
        found, power = np.full(n, -1), np.zeros(n)
        inside = [np.full(len(h), -1, dtype=np.int8) for h, _ in g.views]
        for v, (h, at) in enumerate(g.views):
            size = np.diff(at)
            need = np.where(size > SHORT, max(strength, LONG_STRENGTH), np.minimum(strength, FULL * size))
            if not len(h):
                continue
            most = np.add.reduceat(self.best[v][h].astype(np.float64), at[:-1])
            some = np.nonzero(most >= need)[0]
            if not len(some):
                continue
            # the segments that can be residue, each with a zero before it
            ln = size[some]
            to = np.append(0, np.cumsum(ln + 1))
            k = np.arange(ln.sum()) - np.repeat(np.cumsum(ln) - ln, ln)
            hs = h[np.repeat(at[some], ln) + k]
            slot = np.repeat(to[:-1], ln) + k + 1
            line = np.arange(to[-1])
            seg = np.repeat(np.arange(len(some)), ln + 1)
            for i in range(len(CLASSES)):
                x = np.zeros(to[-1])
                x[slot] = self.tables[v][i][hs]
                # sums fall from segment to segment, so that a minimum begins anew
                c = np.cumsum(x) - seg * 1e5
                low = np.minimum.accumulate(c)
                gain = c - low
                top = np.maximum.reduceat(gain, to[:-1])
                end = np.minimum.reduceat(np.where(gain >= top[seg] - 1e-9, line, to[-1]), to[:-1])
                begin = np.maximum.accumulate(np.where(c <= low, line, 0))[end]
                ok = (top >= need[some]) & (end - begin >= part * ln)
                if i == TEMPLATE:
                    ok |= top >= (alone if v else words)
                better = ok & (top > power[some])
                found[some[better]], power[some[better]] = i, top[better]
                a, b = (at[some] + begin - to[:-1])[ok], (at[some] + end - to[:-1])[ok]
                step = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(step, a, 1)
                np.add.at(step, b, -1)
                inside[v][np.cumsum(step[:-1]) > 0] = i
        return found, power, inside

    def coverage(self, segs: list[list[str]]) -> np.ndarray:
        """Part of each text (a list of segments) that is residue."""
        flat = [s for t in segs for s in t]
        if not flat:
            return np.zeros(len(segs))
        of = np.repeat(np.arange(len(segs)), [len(t) for t in segs])
        ln = np.array([len(s) for s in flat], dtype=float)
        bad = self.judge(Grams(flat))[0] >= 0
        total = np.bincount(of, ln, minlength=len(segs))
        return np.bincount(of, ln * bad, minlength=len(segs)) / np.maximum(total, 1)


# -- counts over the corpus ------------------------------------------------

_KINDS = 1 + len(CLASSES)


def _fresh(flat: list[str], seen: set[int]) -> list[str]:
    out = []
    for s in flat:
        h = hash(s)
        if h not in seen:
            seen.add(h)
            out.append(s)
    return out


def _counts(segs: DataFrame, models: Models | None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of prose (views x cells) and of each class (views x classes x
    cells) over all segments. Without models all is prose."""
    shared = None if models is None else segs.sparkSession.sparkContext.broadcast(models.tables)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = None if shared is None else Models(shared.value)
        acc = np.zeros((2, _KINDS, SIZE), dtype=np.int64)
        seen: set[int] = set()
        for f in frames:
            # a segment counts once per task, so that a notice that stands in
            # many documents does not look like common prose
            flat = _fresh([s for t in f["segs"] if m is not None or len(t) >= FIRST for s in t], seen)
            if not flat:
                continue
            g = Grams(flat)
            kinds = [np.zeros(len(h), dtype=np.int64) for h, _ in g.views] if m is None else [k.astype(np.int64) + 1 for k in m.judge(g, *SURE, words=np.inf)[2]]
            for v, (h, _) in enumerate(g.views):
                acc[v] += np.bincount(kinds[v] * SIZE + h, minlength=_KINDS * SIZE).reshape(_KINDS, SIZE)
        part = TaskContext.get().partitionId() // FAN  # type: ignore[union-attr]
        cells = acc.reshape(2, _KINDS, SLICES, -1)
        yield pd.DataFrame([(v, i, part, zlib.compress(cells[v, :, i].tobytes(), 1)) for v in range(2) for i in range(SLICES)], columns=["v", "i", "part", "n"])

    schema = "v int, i int, part int, n binary"

    def total(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(_KINDS * SIZE // SLICES, dtype=np.int64)
        for f in frames:
            for b in f["n"]:
                acc += np.frombuffer(zlib.decompress(b), dtype=np.int64)
        yield pd.DataFrame([(*key[:2], 0, zlib.compress(acc.tobytes(), 1))], columns=["v", "i", "part", "n"])

    sums = segs.mapInPandas(add, schema).groupBy("v", "i", "part").applyInPandas(total, schema).groupBy("v", "i").applyInPandas(total, schema)
    out = np.zeros((2, _KINDS, SLICES, SIZE // SLICES), dtype=np.int64)
    for r in sums.collect():  # 2 x SLICES rows of fixed size
        out[r.v, :, r.i] = np.frombuffer(zlib.decompress(r.n), dtype=np.int64).reshape(_KINDS, -1)
    out = out.reshape(2, _KINDS, SIZE)
    return out[:, 0], out[:, 1:]


def residue_coverage(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, coverage): part of each document that is residue.

    ``docs`` has doc_id and text. Null ids take no part; null and empty texts
    have coverage 0; repeated rows count once; whole texts are read; an empty
    table gives no rows; other columns are ignored.
    """
    rows = once(docs.select("doc_id", "text").filter("doc_id IS NOT NULL"), "doc_id")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "segs": [segments(t) if isinstance(t, str) else [] for t in f["text"]]})

    segs = cut(rows.mapInPandas(split, "doc_id bigint, segs array<string>"))
    models = None
    for _ in range(rounds):
        models = Models.fit(*_counts(segs, models))
    table = docs.sparkSession.sparkContext.broadcast((models or Models.fit(np.zeros((2, SIZE)), np.zeros((2, len(CLASSES), SIZE)))).tables)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Models(table.value)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "coverage": m.coverage(list(f["segs"]))})

    return segs.mapInPandas(score, "doc_id bigint, coverage double")


def residue_documents(docs: DataFrame, coverage: float = COVERAGE, **kw: int) -> DataFrame:
    """(doc_id) of the documents whose residue covers more than ``coverage``."""
    return residue_coverage(docs, **kw).filter(F.col("coverage") > coverage).select("doc_id")


def clean_documents(docs: DataFrame, coverage: float = COVERAGE, **kw: int) -> DataFrame:
    """(doc_id) of the documents that are kept."""
    return residue_coverage(docs, **kw).filter(F.col("coverage") <= coverage).select("doc_id")
