"""Generated, minified and vendored files, and data kept as code.

A random forest decides, trained here on a bounded sample of rows. Labels come
from header notices: comments at the top that name a generator, a foreign
package or licence, or a delivery banner; and, since data kept as code never
bears one, from texts that are almost only literals. Whatever gives the label is
hidden from the features: leading comments are cut off before anything is
measured, and no share of literals is. Copies of one library are one example, so
the forest can't learn a library by heart. Features are compression ratio, token entropy, identifier lengths,
comment density, line shapes, path hints, whether the same code
(small changes allowed) lies in another project, and whether the file is named
like a package seen in a vendor folder.

Files without a notice are unlabelled, not negative: after the first fit, files
whose out-of-bag score reaches a part of the mean of labelled files (Elkan and
Noto's estimate of how many bear a notice) count as positive, and the forest is
fitted again. Labels only fit: every file, labelled or not, gets the mean vote
of the trees that did not draw its example, so a false label can be outvoted.

Scale: one pass over the files makes features and min-hash signatures. Near
copies are found by banding: only (band, text) travels, buckets that hold texts
of one project are dropped, and signatures follow to the rest. A bucket is cut
into parts of bounded size; each part keeps leaders and compares its members
with leaders only, then the leaders of all parts are compared in the same way
(linear output, never pairs). The forest (a few hundred kB) and at most
``SAMPLE_ROWS`` rows of features are all that passes through the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, once, tasks

SAMPLE_ROWS = 20_000
BANDS, ROWS = 20, 3
NEAR = 0.55
MIN_SHINGLES = 12
TREES, DEPTH, LEAF = 60, 10, 4
THRESHOLD = 0.5
#: share of literals in a text that is data kept as code
BLOB = 0.6
#: rounds of relabelling, and the part of the mean labelled score that relabels
ROUNDS, CANDIDATE = 2, 0.25

_VENDOR = re.compile(r"(?:^|/)(?:vendor|node_modules|third[_-]?party|3rdparty|external|deps|Pods|bower_components|vendored|Godeps)/(?:[^/]+/)*?", re.I)
_PACKAGE = re.compile(r"(?:^|/)(?:vendor/(?:[^/]+\.[^/]+/)?|node_modules/|third[_-]?party/|3rdparty/|external/|deps/|Pods/|bower_components/|vendored/|Godeps/)([A-Za-z][\w.]*?)(?:-[\d.]+)?/", re.I)
_BUILT = re.compile(r"(?:^|/)(?:dist|build|out|target|assets|static|public)/", re.I)
_GEN_PATH = re.compile(r"(?:^|/)(?:generated|__generated__|autogen|gen)/|\.(?:pb|g|gen|generated)\.\w+$|_pb2?\.\w+$", re.I)
_MIN_PATH = re.compile(r"\.(?:min|bundle|chunk|pack)\.\w+$|-[0-9a-f]{8,}\.\w+$", re.I)
_LEADING = re.compile(r"\A﻿?(?:\s*(?:/\*.*?\*/|//[^\n]*|#(?![!\[])[^\n]*))*", re.S)
_GENERATED = re.compile(r"(?i)\bauto-?generated\b(?! (?:files?|code)\b.*(?:skip|read))|@generated|code generated by|generated (?:from|by|with)|automatically (?:created|generated|written)|machine-(?:made|generated|written)|do not (?:edit|modify)")
_NOT_GENERATED = re.compile(r"(?i)not (?:auto-?)?generated|edit it freely|by hand\.|method stub|marked as|keep in step")
_FOREIGN = re.compile(r"(?im)^\W*([\w.-]+) v\d+\.\d+|^\W*(https?://\S+)|(?:part of|held by the) ([\w.-]+)|^\W*([\w.-]+) - see NOTICE")
_TOKEN = re.compile(r"[A-Za-z_$]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\w\s]")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f]+")
_LONG_TEXT = re.compile(r"\"[^\"\\\n]{60,}\"|'[^'\\\n]{60,}'|`[^`\\\n]{60,}`")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/|#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''", re.S)
_PERM = np.random.default_rng(3).integers(1, 2**61 - 1, size=(2, BANDS * ROWS), dtype=np.uint64)

FEATURES = (
    "ratio entropy ident_mean ident_short ident_under comment line_mean line_max line_median rest size distinct space digit shapes top_shape accessor ext "
    "vendor built gen_path min_path stem_package near_copy"
).split()


def notice(project: str | None, text: str) -> bool:
    """Whether a notice says that the file was not written by hand here."""
    head = _LEADING.match(text)[0]
    if head.lstrip("﻿ \n").startswith("/*!"):
        return True
    head = "\n".join(ln for ln in head.split("\n") if not _NOT_GENERATED.search(ln))
    if _GENERATED.search(head):
        return True
    for m in _FOREIGN.finditer(head):
        who = next(x for x in m.groups() if x)
        if (m[1] or m[2]) or who.rstrip(".").lower() not in ((project or "").lower(), "the"):
            return True
    return False


def blob(text: str) -> bool:
    """Whether the text is almost only literals: data kept as code."""
    body = _CONTROL.sub("", text)
    body = body[len(_LEADING.match(body)[0]) :]
    ink = sum(map(len, body.split()))
    # literals need quotes or digits: most texts have too few of them
    if not any(q in body for q in "\"'") and sum(map(body.count, "0123456789xabcdefABCDEF._")) <= BLOB * ink:
        return False
    return sum(len(x) for x in _TOKEN.findall(body) if x[0] in "\"'" or x[0].isdigit()) > BLOB * max(1, ink)


def features(path: str | None, text: str) -> list[float]:
    """Content and path features (the last two are filled in by joins)."""
    path = path or ""
    text = _CONTROL.sub("", text)
    body = text[len(_LEADING.match(text)[0]) :].strip()
    raw = body.encode("utf-8", "replace")
    toks = _TOKEN.findall(body)
    n = max(1, len(toks))
    count = Counter(t if t[0] not in "\"'0123456789" else t[0] for t in toks)
    ids = [t for t in toks if t[0].isalpha() or t[0] in "_$"]
    k = max(1, len(ids))
    # one long text in quotes does not make a line a pressed one
    lines = [ln.strip() for ln in _LONG_TEXT.sub('"s"', body).split("\n") if ln.strip()]
    shape = Counter(re.sub(r"\w+", "w", re.sub(r"\"[^\"]*\"|'[^']*'", "s", ln)) for ln in lines)
    m = max(1, len(lines))
    return [
        len(zlib.compress(raw, 6)) / max(1, len(raw)), -sum(c / n * math.log2(c / n) for c in count.values()), sum(map(len, ids)) / k,
        sum(len(t) < 3 for t in ids) / k, sum(t.endswith("_") or t.isupper() for t in ids) / k, sum(map(len, _COMMENT.findall(body))) / max(1, len(body)),
        sum(map(len, lines)) / m, math.log1p(max(map(len, lines), default=0)), math.log1p(sorted(map(len, lines))[m // 2] if lines else 0), 1 - max(map(len, lines), default=0) / max(1, sum(map(len, lines))), math.log1p(len(body)), len(count) / n, 1 - sum(map(len, body.split())) / max(1, len(body)),
        sum(map(body.count, "0123456789")) / max(1, len(body)), len(shape) / m, max(shape.values(), default=0) / m,
        len(re.findall(r"\b[gs]et[A-Z_]\w*|FIELD_NUMBER|_get\(|_set\(", body)) / m, (zlib.crc32(path.rpartition(".")[2].lower().encode()) % 97) / 97,
        float(bool(_VENDOR.search(path))), float(bool(_BUILT.search(path))), float(bool(_GEN_PATH.search(path))), float(bool(_MIN_PATH.search(path))), 0.0, 0.0,
    ]


def signature(text: str) -> list[int] | None:
    """Min-hashes of five-word shingles without the leading comments; None for
    texts too short to compare."""
    w = re.findall(r"\w+", text[len(_LEADING.match(text)[0]) :])
    if len(w) < MIN_SHINGLES + 4:
        return None
    h = np.fromiter((zlib.crc32(x.encode()) for x in w), dtype=np.uint64, count=len(w))
    s = h[:-4]
    for i in range(1, 5):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - 4 + i]
    s = np.unique(s ^ (s >> np.uint64(31)))
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), 4096):
        part = s[a : a + 4096, None]
        v = part * (_PERM[0] | np.uint64(1)) + _PERM[1]
        out = np.minimum(out, (v ^ (v >> np.uint64(29))).min(axis=0))
    return (out >> np.uint64(1)).astype(np.int64).tolist()


class Forest:
    """Random forest of two classes over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        b = self._bin(x)
        n, f = b.shape
        tries = max(2, f // 2)
        self.trees = []
        votes, seen = np.zeros(n), np.zeros(n)
        # bit t of an example: tree t has not seen it
        self.unseen = np.zeros(n, dtype=np.int64)
        for _ in range(trees):
            pick = rng.integers(0, n, n)
            tree: list[tuple] = []

            def grow(rows: np.ndarray, level: int, tree=tree) -> int:
                at = len(tree)
                p = float(y[rows].mean())
                tree.append((-1, 0, 0, 0, p))
                if level == depth or len(rows) < 8 or p in (0.0, 1.0):
                    return at
                best = (1e-9, -1, 0)
                base = p * (1 - p) * len(rows)
                for j in rng.choice(f, tries, replace=False):
                    k = len(self.cuts[j]) + 1
                    if k < 2:
                        continue
                    tot = np.bincount(b[rows, j], minlength=k).cumsum()[:-1]
                    pos = np.bincount(b[rows, j], weights=y[rows], minlength=k).cumsum()[:-1]
                    r_tot, r_pos = len(rows) - tot, y[rows].sum() - pos
                    ok = (tot >= LEAF) & (r_tot >= LEAF)
                    with np.errstate(all="ignore"):
                        g = np.where(ok, base - pos * (1 - pos / tot) - r_pos * (1 - r_pos / r_tot), -1)
                    i = int(g.argmax())
                    if g[i] > best[0]:
                        best = (float(g[i]), int(j), i)
                if best[1] < 0:
                    return at
                left = b[rows, best[1]] <= best[2]
                a = grow(rows[left], level + 1)
                c = grow(rows[~left], level + 1)
                tree[at] = (best[1], best[2], a, c, p)
                return at

            grow(pick, 0)
            arr = np.array(tree)
            self.trees.append(arr)
            out = np.ones(n, bool)
            out[pick] = False
            votes[out] += self._run(arr, b[out])
            seen[out] += 1
            self.unseen[out] |= np.int64(1) << np.int64(len(self.trees) - 1)
        self.oob = votes / np.maximum(seen, 1)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], axis=1)

    @staticmethod
    def _run(tree: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), dtype=np.int64)
        for _ in range(64):
            f = tree[at, 0].astype(np.int64)
            go = f >= 0
            if not go.any():
                break
            left = b[np.arange(len(b)), np.maximum(f, 0)] <= tree[at, 1]
            at = np.where(go, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)
        return tree[at, 4]

    def score(self, x: np.ndarray, unseen: np.ndarray | None = None) -> np.ndarray:
        """Mean vote of the trees; with ``unseen`` (bits as in ``self.unseen``,
        -1 for all trees) of those trees only that have not seen the row."""
        b = self._bin(x)
        if unseen is None:
            unseen = np.full(len(b), -1, dtype=np.int64)
        votes, n = np.zeros(len(b)), np.zeros(len(b))
        for k, t in enumerate(self.trees):
            ok = (unseen >> np.int64(k)) & 1 == 1
            votes[ok] += self._run(t, b[ok])
            n += ok
        return votes / np.maximum(n, 1)


#: texts of a bucket that are compared in one task
BUCKET = 4_096


def _lead(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Position of each row's leader: the first row before it that it agrees
    with, or itself."""
    lead = np.empty(len(s), dtype=np.int64)
    kept, n = np.empty_like(s), 0
    at = np.empty(len(s), dtype=np.int64)
    for i in order:
        if n:
            agree = (kept[:n] == s[i]).mean(axis=1)
            j = int(agree.argmax())
            if agree[j] >= NEAR:
                lead[i] = at[j]
                continue
        kept[n], at[n] = s[i], i
        n += 1
        lead[i] = i
    return lead


def _near_copies(sig: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(body) of the texts that also lie, nearly, in another project. ``sig``
    has one row per text and project: body, project, sig."""
    texts = sig.groupBy("body").agg(F.min("project").alias("lo"), F.max("project").alias("hi"), F.first("sig").alias("sig"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, ROWS)))
    rows = texts.select("body", "lo", "hi", F.explode(bands).alias("band"))
    # a bucket of one text, or of one project, has nothing to compare
    n = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("a"), F.max("hi").alias("b")).filter("n > 1 AND a <> b")
    many = rows.join(n.select("band", F.ceil(F.col("n") / bucket).cast("int").alias("parts")), "band")
    many = many.join(texts.select("body", "sig"), "body").withColumn("part", F.pmod(F.xxhash64("body"), F.col("parts")).cast("int"))
    schema = "band bigint, parts int, body bigint, lo string, hi string, sig array<bigint>, leader bigint"

    def leaders(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.stack(pdf["sig"].to_numpy())
        of = _lead(s, np.argsort(pdf["body"].to_numpy(), kind="stable"))
        body = pdf["body"].to_numpy()
        return pdf.assign(leader=body[of])[["band", "parts", "body", "lo", "hi", "sig", "leader"]]

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        """Many whole parts in one call."""
        return pd.concat([leaders(g) for _, g in pdf.groupby(["band", "part"], sort=False)])

    many = cut(many)
    n_calls = max(tasks(sig.sparkSession), many.count() // bucket)
    led = cut(many.withColumn("__g", F.pmod(F.xxhash64("band", "part"), F.lit(n_calls))).groupBy("__g").applyInPandas(together, schema))
    # leaders of the parts of one bucket
    top = led.filter("parts > 1 AND body = leader").groupBy("band").applyInPandas(leaders, schema).select("band", F.col("body").alias("leader"), F.col("leader").alias("first"))
    of = led.join(top, ["band", "leader"], "left").select("band", "body", "lo", "hi", F.coalesce("first", "leader").alias("leader"))
    spread = of.groupBy("band", "leader").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).filter("a <> b").select("band", "leader")
    hit = of.join(spread, ["band", "leader"], "left_semi").select("body")
    return hit.union(texts.filter("lo <> hi").select("body")).distinct()


def file_scores(files: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(file_id, score): probability that a file was not written by hand.

    ``files`` has file_id, project_id, file_path and content. Null ids take no
    part; null and empty texts score 0; repeated rows count once; an empty
    table gives no rows; other columns are ignored. Where all labels are equal
    there is nothing to fit, and the score is the label.
    """
    spark = files.sparkSession
    rows = once(files.select("file_id", "project_id", "file_path", "content").filter("file_id IS NOT NULL"), "file_id")
    schema = "file_id bigint, project string, stem string, package string, body bigint, sig array<bigint>, x array<double>, label boolean, empty boolean"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for fid, pid, path, text in zip(f["file_id"], f["project_id"], f["file_path"], f["content"]):
                text = (text if isinstance(text, str) else "").replace("\r\n", "\n").replace("\r", "\n")
                path = path if isinstance(path, str) else ""
                pid = pid if isinstance(pid, str) else ""
                stem = path.rpartition("/")[2].partition(".")[0].lower()
                pack = _PACKAGE.search(path)
                sig = signature(text)
                body = zlib.crc32(text.encode("utf-8", "replace")) if sig is None else hash(tuple(sig)) & (2**62 - 1)
                empty = not text.strip("﻿ \t\n\f")
                out.append((fid, pid, stem, pack[1].lower() if pack else None, body, sig, features(path, text), not empty and (notice(pid, text) or blob(text)), empty))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    got = cut(rows.mapInPandas(read, schema))
    near = _near_copies(got.filter("sig IS NOT NULL").select("body", "project", "sig")).withColumn("near", F.lit(1.0))
    packs = got.filter("package IS NOT NULL").select(F.col("package").alias("stem")).distinct().withColumn("named", F.lit(1.0))
    full = got.join(near, "body", "left").join(packs, "stem", "left")
    # one library, however many copies, is one example
    example = F.coalesce("package", F.when(F.col("named").isNotNull(), F.col("stem")), F.concat(F.lit("#"), F.col("file_id").cast("string")))
    full = full.select("file_id", "label", "empty", example.alias("example"), F.concat(F.slice("x", 1, len(FEATURES) - 2), F.array(F.coalesce("named", F.lit(0.0)), F.coalesce("near", F.lit(0.0)))).alias("x"))
    full = cut(full)
    each = full.filter("NOT empty").groupBy("example").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("file_id").alias("h"), "file_id", "x")).alias("s"))
    sample = each.orderBy("s.h", "s.file_id").limit(sample_rows).select(F.col("s.x").alias("x"), "label", "example").toPandas()
    y = sample["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return full.select("file_id", F.when(F.col("empty"), 0.0).otherwise(F.col("label").cast("double")).alias("score"))
    x, told = np.stack(sample["x"].to_numpy()), y.copy()
    forest = Forest(x, y)
    for _ in range(ROUNDS):
        # how much of what was not written by hand bears a notice (unseen rows)
        c = float(forest.oob[told == 1].mean())
        y = np.where((told == 1) | (forest.oob >= CANDIDATE * c), 1.0, 0.0)
        forest = Forest(x, y)
    shared = spark.sparkContext.broadcast((forest, dict(zip(sample["example"], forest.unseen.tolist()))))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trained, unseen = shared.value
        for f in frames:
            # an example that was drawn is judged by the trees that did not draw it
            bits = np.array([unseen.get(e, -1) for e in f["example"]], dtype=np.int64)
            s = trained.score(np.stack(f["x"].to_numpy()), bits) if len(f) else np.empty(0)
            yield pd.DataFrame({"file_id": f["file_id"], "score": np.where(f["empty"], 0.0, s)})

    return full.mapInPandas(score, "file_id bigint, score double")


def machine_files(files: DataFrame, threshold: float = THRESHOLD, **kw: int) -> DataFrame:
    """(file_id) of the files that were not written by hand in their project."""
    return file_scores(files, **kw).filter(F.col("score") >= threshold).select("file_id")
