"""Name resolution on small fixtures."""

from __future__ import annotations

from strandline.llm.names import Reader, _given_names, near, one_slip, resolve, variant_pairs


def test_slips():
    assert one_slip("larmen", "lramen") and one_slip("abc", "abxc") and one_slip("abc", "ab") and one_slip("abc", "axc")
    assert not one_slip("abcd", "axyd") and near("abcdef", "axcef") and not near("abcdef", "uvwxyz")


def test_reader():
    r = Reader({"greta", "elif"})
    assert r.read("Kolman, Greta", None, False)["full"] == [("kolman", "greta")]
    assert r.read("gkolman", None, False)["loose"][0] == ("kolman", "g")
    assert r.read("Greta K.", "gkolman@x.example", False)["full"] == [("kolman", "greta")]
    assert r.read("Elif Tolman", "elizabeth.tolman@x.example", False)["box"] is None
    assert r.read("KOLMAN-BOT", None, False)["full"] == [("kolman", "#bot")]
    assert r.read("The Kolman Software Team", None, False)["full"] == r.read("KolmanSoftware", None, False)["full"]


def test_pairs(spark):
    rows = [
        (1, "Greta Kolmander", "greta.kolmander@a.example"),
        (2, "Kolmander, G.", None),
        (3, "Greta Kolmadner", None),
        (4, "gkolmander", "GRETA.KOLMANDER+git@a.example"),
        (5, "Robert Kolmander", "robert.kolmander@a.example"),
        (6, "Bob Kolmander (ext)", "noreply@hub.example"),
        (7, "Olga Varminto", "noreply@hub.example"),
        (8, "Oskar Varminto", "noreply@hub.example"),
        (9, "O. Varminto", None),
        (10, None, None),
        (11, "", ""),
        (12, "x" * 5000, "y" * 5000),
        (13, "Kild Bot", None),
        (14, "kild[bot]", "noreply@hub.example"),
    ]
    rows += [rows[0], (None, "Greta Kolmander", None)] + [(100 + i, f"Linh Person{c}", "noreply@hub.example") for i, c in enumerate("abcdef")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, name string, email string, entity string")
    got = {(r.record_a, r.record_b) for r in variant_pairs(df).collect()}
    small = {p for p in got if max(p) < 100}
    assert small == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6), (13, 14)}
    assert variant_pairs(df.limit(0)).collect() == []


def test_given_names_are_learned(spark):
    rows = [(f"{g.title()} {s.title()}", None) for g in ("quill", "brann") for s in ("tolmander", "varminto", "kesselby", "dorvane")]
    rows += [("Qill Tolmander", None), ("Zimmel Ostrova", None), ("Tolmander Quill", None), ("Ostrova, Brann", None), ("Kild Software", None), ("Brann Software", None)]
    assert _given_names(spark.createDataFrame(rows, "name string, email string")) == {"quill", "brann"}


def test_rounds_make_profiles_richer(spark):
    # 3 is claimed for its mailbox and brings a surname that 4 fits; 5 fits two
    rows = [
        (1, "Maria Kolmander", "maria.kolmander@a.example"), (2, "Milena Kolmander", "milena.kolmander@b.example"), (3, "mvestergaard", "maria.kolmander@a.example"),
        (4, "M. Kolmander", None), (5, "Maria Dorvane", "m.dorvane@c.example"), (6, "M. Dorvane", None), (7, "mdorvane", None), (8, "dorvane.m", "m.dorvane@c.example"),
    ]
    got = {r.record_id: r.entity for r in resolve(spark.createDataFrame(rows, "record_id long, name string, email string")).collect()}
    assert got[5] == got[6] == got[7] == got[8] == 5 and got[1] == 1 and got[2] == 2 and got[4] == 4


def test_hot_surname_and_hot_author(spark):
    given = [a + b for a in "bcdfghklmn" for b in ("ana", "orin", "elvo", "usta")]
    rows = [(i, f"{given[i % 40].title()} Kolmander", f"{given[i % 40]}.kolmander@a.example" if i % 3 else None) for i in range(2000)]
    # given names are known as such by a second surname each
    rows += [(5_000 + i, f"{g.title()} Varmi{g}", None) for i, g in enumerate(given)]
    rows += [(10_000 + i, "Kild Bot" if i % 2 else "kild[bot]", None) for i in range(300)]
    df = spark.createDataFrame(rows, "record_id long, name string, email string")
    e = {r.record_id: r.entity for r in resolve(df).collect()}
    assert all(e[i] == i % 40 for i in range(2000)) and {e[10_000 + i] for i in range(300)} == {10_000}
    assert variant_pairs(df, block=64).count() == variant_pairs(df).count() == 40 * (50 * 49 // 2) + 300 * 299 // 2
