"""Residue models on held-out wordings."""

from __future__ import annotations

import random

from strandline.llm.residue import PROSE as ABOUT
from strandline.llm.residue import RESIDUE, Grams, clean_documents, mask_code, residue_coverage, residue_documents, segments

PROSE = [
    "The {a} job ran {n} minutes late because the {b} queue was full.", "We now read each {a} only once, which cut the run from {n} to {n} seconds.",
    "Search ranks a {a} by name first and by {b} second.", "Please look at the {a} in the {b} folder as well.", "Nobody has touched the {a} since the last release of the {b}.",
]
WORDS = "window table reader branch commit folder module parser graph leaf token report".split()
BAD = [
    "Dear {customer_name},", "{{ page.heading }}", "<%= user.mail %> was changed by <%= user.name %>.", "404 Not Found The requested page /a/b was not found on this server.",
    "You need to enable JavaScript to run this app.", "Veniam lorem elit dolor magna nisi sed commodo ipsum amet minim quis labore tempor.", "[Insert the long story here]", "TBD",
]
FINE = [
    "Requests for an unknown table now answer 404 instead of 500.", "In a template, `{{ name }}` is filled in when the page is built.", "```yaml\nkey: ${{ secrets.KEY }}\n```",
    "When a reader has JavaScript turned off we send the plain list instead.", 'The check looks for "TBD" or "[insert name here]" and fails.', "Run this:\n\n    export OUT=${HOME}/a\n    ./run \"$OUT\"\n",
]


def prose(rnd):
    return " ".join(rnd.choice(PROSE).format(a=rnd.choice(WORDS), b=rnd.choice(WORDS), n=rnd.randrange(999)) for _ in range(5))


def test_wordings_are_held_out():
    fit = [x for t in [*RESIDUE.values(), ABOUT] for x in t.strip().split("\n")]
    assert not [x for x in (*BAD, *FINE) if len(x) > 12 and any(x in y or (len(y) > 12 and y in x) for y in fit)]


def test_views_look_alike():
    a, b = Grams(["{{ user.name }}"]), Grams(["{{ Order.total }}"])
    assert a.views[1][0].tolist() == b.views[1][0].tolist() and a.views[0][0].tolist() != b.views[0][0].tolist()
    many = Grams(["", "abc", "{{ user.name }}"])
    assert many.views[1][0][many.views[1][1][2] :].tolist() == a.views[1][0].tolist()


def test_segments():
    assert mask_code("a\n```\nb\n```\nc `d` e") == "a\n\n\nc  c  e"
    assert segments("> When a reader has it\n> turned off we wait. Then\n\n{% if x %}\nThe end.") == ["When a reader has it turned off we wait.", "Then", "{% if x %}", "The end."]


def test_found(spark):
    rnd = random.Random(1)
    rows = [(i, prose(rnd)) for i in range(300)]
    rows += [(1000 + i, prose(rnd) + "\n\n" + t + "\n\n" + prose(rnd)) for i, t in enumerate(BAD)]
    rows += [(2000 + i, prose(rnd) + "\n\n" + t) for i, t in enumerate(FINE)]
    rows += [(3000, None), (3001, ""), (None, "TBD"), (3002, prose(rnd) * 2000), rows[0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, coverage string")
    got = {r.doc_id for r in residue_documents(df).collect()}
    assert got == {1000 + i for i in range(len(BAD))}
    kept = [r.doc_id for r in clean_documents(df).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {r[0] for r in rows if r[0] is not None} - got
    assert residue_coverage(df.limit(0)).collect() == []


def test_placeholder_in_a_long_sentence(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd)) for i in range(300)]
    bad = ["[object Object] thistle-viewer-0 stores one trailer per registry and marks it coarse when the second reader has seen it.", "The reader keeps one leaf per module and the folder, so [object Object] moves to the second branch when the parser is done."]
    rows += [(1000 + i, prose(rnd) + "\n\n" + t) for i, t in enumerate(bad)]
    got = {r.doc_id for r in residue_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1000, 1001}
