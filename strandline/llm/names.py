"""Variant spellings of names: merge-and-rematch resolution.

1. Every record is read into evidence: kind (person, organisation, bot), given
   name in its formal form, initial, surname spellings of the name and of the
   mailbox, and the mailbox where it is a personal one. Which words are given
   names is learned from the table: words that stand first before more different
   second words than the other way round. Short forms are common knowledge.
2. Evidence with a full name is grouped by (surname, given name); groups are
   linked by alias spellings of one record and by typing slips (one edit, found
   through shared single-character deletions). Linked groups merge into profiles
   that unite their spellings, initials and mailboxes.
3. Rounds: profiles enter blocking with all they have. Evidence with an initial
   or a login only joins a profile if it is the only one that fits (a personal
   mailbox decides before the equal surname, that before a slip); profiles that
   now share a full name merge. What is merged makes the profile richer, so the
   next round blocks again, until nothing merges.
4. What no profile claims is grouped by equal surname and initial, or mailbox.

Scale: all steps are joins and aggregates on keys. Records with equal evidence
are one node, so a name that a third of all records carry is one row. A block
is reduced to its smallest and largest profile before it meets a record (a
record fits one profile if both are equal), so a hot surname costs one row. A
block of the slip search holds strings that become equal by one deletion: at
most 27 times their length, whatever the table size. Only counts and the list of
given names (at most 1 / GIVEN_SHARE words) reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components_by
from ..session import cut, once

#: short forms of given names (fixed values, common knowledge)
NICKNAMES = {
    "alexander": "alex sasha sascha alec sandy", "andrew": "andy drew", "anthony": "tony toni", "barbara": "barb", "benjamin": "ben benny benji",
    "charles": "charlie chuck", "christopher": "chris topher kit", "daniel": "dan danny", "david": "dave davey", "dmitri": "dima mitya", "edward": "ed eddie ted ned",
    "ekaterina": "katya katja", "elizabeth": "liz beth betty lizzy eliza", "francisco": "paco pancho", "frederick": "fred freddy fritz", "gabriela": "gabi gaby",
    "gregory": "greg", "guillermo": "memo guille", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hans hannes", "john": "johnny jack",
    "jonathan": "jon jonny", "joseph": "joe joey", "katherine": "kate kathy katie kat", "kenneth": "ken kenny", "lawrence": "larry", "margaret": "maggie peggy meg",
    "matthew": "matty", "matthias": "matt matze", "michael": "mike mick mikey", "nicholas": "nick nico", "patricia": "pat patty", "peter": "pete",
    "rebecca": "becky becca", "richard": "rick dick rich richie", "robert": "rob bob bobby robbie", "ronald": "ron", "samuel": "sam sammy", "stephen": "steve",
    "susanna": "sue susie susi", "theresa": "tess terry tessa", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky", "vladimir": "vova volodya",
    "william": "will bill billy willy", "zachary": "zach",
}
FORMAL = {short: full for full, shorts in NICKNAMES.items() for short in shorts.split()} | {g: g for g in NICKNAMES}
#: words that make a name an organisation's, in one form (fixed values)
ORG = {
    "software": "software", "sw": "software", "soft": "software", "systems": "systems", "system": "systems", "sys": "systems", "research": "research", "res": "research",
    "laboratories": "laboratories", "laboratory": "laboratories", "labs": "laboratories", "lab": "laboratories", "technologies": "technologies", "technology": "technologies",
    "tech": "technologies", "foundation": "foundation", "fdn": "foundation", "university": "university", "univ": "university", "institute": "institute", "inst": "institute",
    "group": "group", "grp": "group", "solutions": "solutions", "consulting": "consulting", "works": "works",
}
LEGAL = set("inc ltd gmbh ab sa llc co corp plc bv oy ag kg limited incorporated".split())
#: a mailbox with so many surnames (by their first letters) is nobody's own
SHARED_SURNAMES = 4
#: least share of a given name in all different full names (so there are at most
#: 1 / GIVEN_SHARE of them), and least number of different surnames
GIVEN_SHARE, GIVEN_LEAST = 1e-5, 2
#: a word so much rarer than one a slip away is a slip of it
SLIP_OF = 20
#: records of one author that are paired in one task
PAIR_BLOCK = 1_000


def plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def deletions(s: str) -> set[str]:
    return {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}


def one_slip(a: str, b: str) -> bool:
    """Equal, or one insertion, deletion, substitution or neighbour swap."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _agree(a: str, b: str) -> bool:
    """Whether two surnames can be the same; a letter stands for all that
    begin with it."""
    return b.startswith(a) if len(a) == 1 else a.startswith(b) if len(b) == 1 else near(a, b)


def near(a: str, b: str) -> bool:
    """At most one slip and one missing or extra letter apart."""
    return one_slip(a, b) or any(one_slip(x, b) for x in deletions(a)) or any(one_slip(a, x) for x in deletions(b))


class Reader:
    """Reads a name and an address into evidence."""

    def __init__(self, given: set[str]) -> None:
        self.formal = dict(FORMAL) | {g: g for g in given if g not in FORMAL}
        self.by_deletion: dict[str, set[str]] = {}
        for g in self.formal:
            if len(g) >= 4:
                for d in deletions(g):
                    self.by_deletion.setdefault(d, set()).add(g)

    def given(self, s: str) -> str | None:
        """Formal form of a (slightly mistyped) given name, else None."""
        if s in self.formal:
            return self.formal[s]
        if len(s) < 4:
            return None
        near_ = {self.formal[g] for d in deletions(s) for g in self.by_deletion.get(d, ()) if one_slip(g, s)}
        return near_.pop() if len(near_) == 1 else None

    def pair(self, a: str, b: str) -> tuple[str | None, str | None, str | None]:
        """(given, initial, surname) of two words, given name first unless only
        the second is one. A surname may be just its first letter."""
        if len(a) == 1 and len(b) > 1:
            return None, a, b
        if len(b) == 1 and len(a) > 1:
            return (self.given(a) or a, a[0], b) if a in self.formal else (None, b, a)
        if a not in self.formal and (b in self.formal or (not self.given(a) and self.given(b))):
            a, b = b, a
        g = self.given(a) or a
        return g, g[0], b

    def login(self, s: str) -> list[tuple[str | None, str | None, str]]:
        """Readings (given, initial, surname) of a word without separators."""
        out: list[tuple[str | None, str | None, str]] = []
        for n in range(3, len(s) - 3):
            if s[:n] in self.formal:
                out.append((self.formal[s[:n]], self.formal[s[:n]][0], s[n:]))
            if s[n:] in self.formal:
                out.append((self.formal[s[n:]], self.formal[s[n:]][0], s[:n]))
        if len(s) > 4:
            out += [(None, s[0], s[1:]), (None, s[-1], s[:-1])]
        return [*out, (None, None, s)]

    def name(self, raw: str | None) -> dict:
        """kind, key (organisation or bot) or readings of a person."""
        n = re.sub(r"\([^)]*\)", " ", plain(raw or "")).strip()
        if not n:
            return {"kind": None}
        m = re.fullmatch(r"(.+?)[\s_\-]*\[?\bbot\]?", re.sub("_", " ", n), re.I)
        if m:
            return {"kind": "bot", "key": re.sub("[^a-z0-9]", "", m[1].lower())}
        spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", n)
        words = re.findall(r"[a-z0-9]+", re.sub(r"\b([a-z])\.(?=[a-z]\b)", r"\1", spaced.lower()))
        w = words[1:] if words[:1] == ["the"] else words
        while w and (w[-1] in LEGAL or w[-1] == "team"):
            w = w[:-1]
        if len(w) >= 2 and w[-1] in ORG and not (len(w) == 2 and w[0] in self.formal):
            return {"kind": "org", "key": "".join(w[:-1]) + " " + ORG[w[-1]]}
        if len(w) < len(words) and w and words[-1] != "ab":
            return {"kind": "org", "key": "".join(w)}
        if "," in n:
            last, _, first = n.partition(",")
            f, s = re.findall(r"[a-z]+", first.lower()), "".join(re.findall(r"[a-z]+", last.lower()))
            if f and s:
                g = (self.given(f[0]) or f[0]) if len(f[0]) > 1 else None
                return {"kind": "person", "read": [(g, (g or f[0])[0], s)]}
        parts = re.findall(r"[a-z]+", spaced.lower())
        if len(parts) == 1:
            return {"kind": "person", "read": self.login(parts[0])}
        if len(parts) > 2:  # middle names and initials
            ends = [p for p in parts if len(p) > 1]
            parts = [parts[0], ends[-1] if len(parts[-1]) == 1 and ends else parts[-1]]
        if len(parts) == 2:
            return {"kind": "person", "read": [self.pair(*parts)]}
        return {"kind": None}

    def address(self, raw: str | None) -> dict:
        """box (normal form), and kind with key or readings."""
        e = plain(raw or "").strip().lower()
        local, at, domain = e.partition("@")
        if not at or not local:
            return {"box": None, "kind": None}
        if re.fullmatch(r"\d+\+.+", local):
            local = local.partition("+")[2]
            box = None if "noreply" not in domain else f"{local}@{domain}"
        elif local.startswith("bot+"):
            return {"box": e, "kind": "bot", "key": re.sub("[^a-z0-9]", "", local[4:])}
        else:
            local = local.partition("+")[0]
            box = f"{local}@{domain}"
        m = re.fullmatch(r"(.+)[-_.]bot", local)
        if m:
            return {"box": box, "kind": "bot", "key": re.sub("[^a-z0-9]", "", m[1])}
        if local in ("oss", "opensource", "dev", "info", "contact", "team", "support", "admin"):
            return {"box": None, "kind": "org", "key": domain.split(".")[0]}
        parts = re.findall(r"[a-z]+", local)
        if len(parts) == 2:
            return {"box": box, "kind": "person", "read": [self.pair(*parts)]}
        if len(parts) == 1:
            return {"box": box, "kind": "person", "read": self.login(parts[0])}
        return {"box": box, "kind": None}

    def read(self, name: str | None, email: str | None, shared: bool) -> dict:
        """One record's evidence: full readings (surname, given), the loose
        readings (surname, initial) otherwise, and the mailbox."""
        n = self.name(name)
        a = {"box": None, "kind": None} if shared else self.address(email)
        out: dict = {"kind": n["kind"] or a["kind"], "full": [], "loose": [], "box": a["box"]}
        if n["kind"] in ("bot", "org") or (n["kind"] is None and a["kind"] == "bot"):
            out["full"] = [(n.get("key") or a["key"], "#" + out["kind"])]
            out["box"] = None if n["kind"] == "org" else a["box"]
            return out
        if a["kind"] in ("bot", "org"):
            a = {"box": None, "kind": None}
            out["box"] = None
        if out["kind"] != "person":
            return out
        mine, theirs = n.get("read") or [], a.get("read") or []
        # readings of name and mailbox that agree
        agreed = [
            (x, y) for x in mine for y in theirs
            if _agree(x[2], y[2]) and (not x[1] or not y[1] or x[1] == y[1] or (x[0] and y[0] and x[0] == y[0]))
            and (not x[0] or not y[0] or x[0] == y[0] or one_slip(x[0], y[0])) and max(len(x[2]), len(y[2])) > 1
        ]
        if mine and theirs and not agreed:
            # someone else's mailbox: the name alone counts
            out["box"], theirs = None, []
        if agreed:
            def rank(p: tuple) -> tuple:
                x, y = p
                return (x[2] != y[2], not (x[0] or y[0]), not (x[1] and y[1]), not (x[1] or y[1]), -len(y[2]))

            x, y = min(agreed, key=rank)
            g, i = y[0] or x[0], x[1] or y[1]
            spell = list(dict.fromkeys(s for s in (y[2], x[2]) if len(s) > 1))
            if g:
                out["full"] = [(s, g) for s in spell]
            else:
                out["loose"] = [(s, i) for s in spell]
            return out
        only = [r for r in mine or theirs if len(r[2]) > 1]
        if len(only) == 1 and only[0][0]:
            out["full"] = [(only[0][2], only[0][0])]
        elif only:
            full = [r for r in only if r[0]]
            out["full"] = [(full[0][2], full[0][0])] if full else []
            out["loose"] = [] if full else [(r[2], r[1]) for r in only]
        return out


def _given_names(records: DataFrame) -> set[str]:
    """Words that stand first before more different second words than the
    other way round, without slips of more frequent ones."""
    name = F.lower(F.trim("name"))
    straight, comma = r"^([a-z]{2,}) ([a-z]{3,})$", r"^([a-z]{3,}), ([a-z]{2,})$"
    pair = F.when(name.rlike(straight), F.struct(F.regexp_extract(name, straight, 1).alias("g"), F.regexp_extract(name, straight, 2).alias("s"))).when(
        name.rlike(comma), F.struct(F.regexp_extract(name, comma, 2).alias("g"), F.regexp_extract(name, comma, 1).alias("s"))
    )
    none = [*ORG, *LEGAL, "bot", "team"]
    full = cut(records.select(pair.alias("p")).filter("p IS NOT NULL").select("p.g", "p.s").filter(~F.col("s").isin(none) & ~F.col("g").isin(*none, "the")).distinct())
    least = max(GIVEN_LEAST, full.count() * GIVEN_SHARE)
    first = full.groupBy(F.col("g").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    last = full.groupBy(F.col("s").alias("w")).agg(F.count(F.lit(1)).alias("m"))
    n = cut(first.join(last, "w", "left").filter(F.col("n") > F.coalesce("m", F.lit(0))).select("w", "n"))
    d = _with_deletions(n.filter("length(w) >= 4"), "w", "d")
    other = d.select("d", F.col("w").alias("o"), F.col("n").alias("k"))
    slips = d.join(other, "d").filter((F.col("k") >= SLIP_OF * F.col("n")) & _slip("w", "o")).select("w").distinct()
    return {r.w for r in n.filter(F.col("n") >= least).join(slips, "w", "left_anti").select("w").collect()}  # at most 1 / GIVEN_SHARE rows


def _evidence(records: DataFrame) -> DataFrame:
    """One row per record: record_id, kind, full array (surname|given|1 if the
    given name is a known one), loose array (surname|initial), box."""
    spark = records.sparkSession
    given = spark.sparkContext.broadcast(_given_names(records))
    # mailboxes that many surnames use: by the first letters of the last word
    last = F.regexp_extract(F.lower("name"), r"([a-z]{4})[a-z]*\W*$", 1)
    box = F.regexp_replace(F.lower(F.trim("email")), r"\+[^@]*@", "@")
    use = records.select(box.alias("b"), last.alias("l")).filter("b IS NOT NULL AND l <> ''").distinct().groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    shared = use.filter(F.col("n") >= SHARED_SURNAMES).filter(~F.col("b").rlike(r"noreply\.")).select("b", F.lit(True).alias("shared"))
    rows = records.withColumn("b", box).join(shared, "b", "left").select("record_id", "name", "email", F.coalesce("shared", F.lit(False)).alias("shared"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader(given.value)
        known = set(r.formal.values())
        for f in frames:
            got = [r.read(n, e, s) for n, e, s in zip(f["name"], f["email"], f["shared"])]
            yield pd.DataFrame({
                "record_id": f["record_id"],
                "kind": [g["kind"] for g in got],
                "full": [[f"{s}|{g_}|{int(g_ in known)}" for s, g_ in g["full"]] for g in got],
                "loose": [[f"{s}|{i or ''}" for s, i in g["loose"]] for g in got],
                "box": [g["box"] for g in got],
            })

    return rows.mapInPandas(read, "record_id bigint, kind string, full array<string>, loose array<string>, box string")


def _with_deletions(df: DataFrame, col: str, out: str) -> DataFrame:
    """A row per single-character deletion of the column (and itself)."""
    c = F.col(col)
    dels = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return df.withColumn(out, F.explode(F.array_distinct(F.concat(F.array(c), dels))))


def _slip(a: str, b: str):
    """SQL form of one_slip for strings that share a deletion."""
    d = F.levenshtein(F.col(a), F.col(b))
    swap = (F.length(a) == F.length(b)) & (d == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (d <= 1) | swap


def _part(col: str, i: int):
    return F.split(F.col(col), "\\|").getItem(i)


def _span(df: DataFrame, *key: str) -> DataFrame:
    """Smallest and largest profile per key."""
    return df.groupBy(*key).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))


def _profiles(own: DataFrame) -> DataFrame:
    """(nid, p): evidence with full names by equal names and slips."""
    key = cut(own.groupBy("sn", "gn").agg(F.max("known").alias("known"), F.max("mailed").alias("mailed"), F.min("nid").alias("id")))
    pick = lambda d, by, var, x: d.select(*by, "d", F.col(var).alias(f"v{x}"), F.col("id").alias(f"id{x}"), F.col("mailed").alias(f"m{x}"), F.col("known").alias(f"k{x}"))

    def slips(d: DataFrame, by: str, var: str) -> DataFrame:
        a, b = (pick(_with_deletions(d, var, "d"), [by], var, x) for x in ("a", "b"))
        return a.join(b, [by, "d"]).filter("va < vb").filter(_slip("va", "vb"))

    # two mailboxes of their own, or two known given names, are two people
    x = slips(key.filter("length(sn) >= 6"), "gn", "sn").filter("NOT (ma AND mb)")
    y = slips(key.filter("length(gn) >= 4 AND NOT startswith(gn, '#')"), "sn", "gn").filter("NOT (ka AND kb)")
    edges = own.join(key.select("sn", "gn", "id"), ["sn", "gn"]).select(F.col("nid").alias("a"), F.col("id").alias("b"))
    root = components_by(edges.union(x.select("ida", "idb")).union(y.select("ida", "idb")), [], "a", "b")
    return own.select("nid").distinct().join(root.withColumnRenamed("node", "nid"), "nid", "left").select("nid", F.coalesce("root", "nid").alias("p"))


def _fits(todo: DataFrame, spelled: DataFrame, initial: DataFrame, box: DataFrame) -> DataFrame:
    """(nid, lo, hi): smallest and largest profile of the best tier that fits
    a loose record. ``todo`` has nid, sn, i (a row per reading) and box."""
    any_ = lambda d, c: d.select(c, F.lit("").alias("i"), "p").union(d.join(initial, "p").select(c, "i", "p"))
    by_box, by_name = _span(any_(box, "box"), "box", "i"), _span(any_(spelled, "sn"), "sn", "i")
    t1 = todo.filter("box IS NOT NULL").join(by_box, ["box", "i"]).select("nid", F.lit(1).alias("t"), "lo", "hi")
    t2 = todo.filter("sn IS NOT NULL").join(by_name, ["sn", "i"]).select("nid", F.lit(2).alias("t"), "lo", "hi")
    q = _with_deletions(todo.filter("length(sn) >= 7 AND i <> ''").select("nid", "sn", "i"), "sn", "d").withColumnRenamed("sn", "sa")
    k = _with_deletions(by_name.filter("length(sn) >= 7 AND i <> ''"), "sn", "d").withColumnRenamed("sn", "sb")
    t3 = q.join(k, ["i", "d"]).filter(_slip("sa", "sb")).select("nid", F.lit(3).alias("t"), "lo", "hi")
    per = t1.union(t2).union(t3).groupBy("nid", "t").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return per.groupBy("nid").agg(F.min(F.struct("t", "lo", "hi")).alias("b")).select("nid", "b.lo", "b.hi")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, entity): entity is the smallest record_id of the author.

    ``records`` has record_id, name and email. Null ids take no part; a record
    without usable name and mailbox stays alone; repeated rows count once;
    empty tables give no rows; other columns are ignored.
    """
    rec = once(records.select("record_id", F.col("name").cast("string").alias("name"), F.col("email").cast("string").alias("email")).filter("record_id IS NOT NULL"), "record_id")
    same = F.concat_ws("\1", F.coalesce("kind", F.lit("")), F.array_join("full", ","), F.array_join("loose", ","), F.coalesce("box", F.lit("")))
    ev = cut(_evidence(rec).withColumn("ev", same))
    node = cut(ev.filter("size(full) + size(loose) > 0 OR box IS NOT NULL").groupBy("ev").agg(F.min("record_id").alias("nid"), *[F.first(c).alias(c) for c in ("full", "loose", "box")]))
    own = node.select("nid", "box", F.posexplode("full").alias("pos", "k"))
    own = cut(own.select("nid", "box", _part("k", 0).alias("sn"), _part("k", 1).alias("gn"), (_part("k", 2) == "1").alias("known"), ((F.col("pos") == 0) & F.col("box").isNotNull()).alias("mailed")))
    read = F.when(F.size("loose") > 0, F.col("loose")).otherwise(F.array(F.lit(None).cast("string")))
    loose = node.filter("size(full) = 0").select("nid", "box", F.explode(read).alias("k"))
    loose = cut(loose.select("nid", "box", _part("k", 0).alias("sn"), F.coalesce(_part("k", 1), F.lit("")).alias("i")))
    prof = cut(_profiles(own))
    claimed = None
    while True:
        # what the profiles have by now: full names, surnames, initials, mailboxes
        mine = prof.join(loose, "nid").select("p", "sn", "box")
        said = lambda **c: F.explode(F.create_map(*[x for t, v in c.items() for x in (F.lit(t), F.col(v))])).alias("t", "v")
        held = own.join(prof, "nid").select("p", said(n="sn", g="gn", b="box")).union(mine.select("p", said(n="sn", b="box")))
        held = cut(held.filter("v IS NOT NULL").distinct())
        has = lambda t, name: held.filter(F.col("t") == t).select("p", F.col("v").alias(name))  # noqa: B023, E731
        # profiles that have come to share a full name
        names = has("n", "sn").join(has("g", "gn"), "p")
        twin = cut(names.join(_span(names, "sn", "gn").filter("lo < hi"), ["sn", "gn"]).filter("p <> lo").select(F.col("p").alias("a"), F.col("lo").alias("b")).distinct())
        if not twin.isEmpty():
            root = components_by(twin, [], "a", "b").withColumnRenamed("node", "p")
            prof = cut(prof.join(root, "p", "left").select("nid", F.coalesce("root", "p").alias("p")))
            continue
        initial = has("g", "gn").select("p", F.substring("gn", 1, 1).alias("i")).distinct()
        fit = cut(_fits(loose.join(prof, "nid", "left_anti"), has("n", "sn"), initial, has("b", "box")))
        claimed = fit.select("nid") if claimed is None else claimed.union(fit.select("nid"))
        new = fit.filter("lo = hi").select("nid", F.col("lo").alias("p"))
        if new.isEmpty():
            break
        prof = cut(prof.union(new))
    # what no profile claims: equal surname and initial, or equal mailbox
    rest = loose.join(claimed, "nid", "left_anti")
    mark = rest.filter("i <> ''").select("nid", F.concat_ws("|", "sn", "i").alias("k")).union(rest.filter("box IS NOT NULL").select("nid", F.concat(F.lit("@"), "box"))).distinct()
    link = mark.join(mark.groupBy("k").agg(F.min("nid").alias("b")), "k").select(F.col("nid").alias("a"), "b")
    alone = components_by(link, [], "a", "b").select(F.col("node").alias("nid"), F.col("root").alias("p"))
    every = prof.union(alone.join(prof, "nid", "left_anti"))
    entity = every.join(every.groupBy("p").agg(F.min("nid").alias("entity")), "p").select("nid", "entity")
    named = node.select("ev", "nid").join(entity, "nid", "left").select("ev", F.coalesce("entity", "nid").alias("entity"))
    return ev.join(named, "ev", "left").select("record_id", F.coalesce("entity", "record_id").alias("entity"))


def variant_pairs(records: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(record_a, record_b), record_a < record_b, of the same author. The
    records of one author are cut into blocks, and pairs of blocks are joined,
    so that an author with many records is no single key."""
    e = cut(resolve(records))
    n = e.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    e = e.join(n, "entity").withColumn("x", F.pmod(F.xxhash64("record_id"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    a = e.select(F.col("record_id").alias("record_a"), "entity", "x", every.alias("y"))
    b = e.select(F.col("record_id").alias("record_b"), "entity", F.col("x").alias("y"), every.alias("x"))
    return a.join(b, ["entity", "x", "y"]).filter("record_a < record_b").select("record_a", "record_b")
