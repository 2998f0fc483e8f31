"""Freshness and file changes over whole tables, from dates and change sets."""

from datetime import datetime

from strandline.plans.retrieval_queries import changed_files, entity_freshness, freshness_summary
from strandline.plans.story_queries import auto_fix_preview

T = [datetime(2024, 1 + k, 1) for k in range(12)] + [datetime(2025, 3, 1)]


def _changes(spark, d, rows):
    spark.createDataFrame(rows, "project_id string, modified array<string>, added array<string>, deleted array<string>, commit_ts timestamp_ntz").write.parquet(f"{d}/change_sets.parquet")


def test_freshness_takes_every_document(spark, tmp_path):
    d = str(tmp_path)
    rows = [(k, "p", f"f{k}.md", f"text {k}", T[0]) for k in range(1, 31)]
    rows += [(40, "p", "f4.md", "text four", T[5]), (41, "p", "f5.md", "text 5", T[5]), (42, "p", None, "a", T[0]), (43, None, "f6.md", "b", T[0])]
    spark.createDataFrame(rows, "doc_id long, project_id string, file_path string, text string, ingested_at timestamp_ntz").write.parquet(f"{d}/documents.parquet")
    # f7 is gone; f8 came back; f9 was deleted before the text came; another project's f10 is gone
    _changes(spark, d, [("p", None, None, ["f7.md", "f8.md"], T[3]), ("p", None, ["f8.md"], [], T[4]), ("p", [], [], ["f9.md"], datetime(2023, 1, 1)), ("q", [], [], ["f10.md"], T[3])])
    got = {r.entity_id: (r.code_id, r.state) for r in entity_freshness(spark, d).collect()}
    want = {k: (k, "fresh") for k in range(1, 31)} | {4: (40, "stale"), 5: (41, "fresh"), 7: (7, "orphaned"), 40: (40, "fresh"), 41: (41, "fresh"), 42: (None, "unbound"), 43: (None, "unbound")}
    assert got == want
    assert {r.state: r.n for r in freshness_summary(spark, d).collect()} == {"fresh": 30, "stale": 1, "orphaned": 1, "unbound": 2}
    assert {tuple(r) for r in auto_fix_preview(spark, d).collect()} == {(4, "refresh"), (7, "delete"), (42, "bind"), (43, "bind")}


def test_changed_files_takes_every_file(spark, tmp_path):
    d = str(tmp_path)
    rows = [(k, "p", f"f{k}.py", f"x = {k}", T[0]) for k in range(1, 29)]
    rows += [rows[3], (50, "p", "f5.py", "x = 55", T[12]), (51, "p", "f51.py", "y", T[12]), (52, "p", "f6.py", "x = 6", T[12])]
    spark.createDataFrame(rows, "file_id long, project_id string, file_path string, content string, ingested_at timestamp_ntz").write.parquet(f"{d}/source_files.parquet")
    _changes(spark, d, [("p", [], [], ["f8.py", "f9.py"], datetime(2025, 2, 1)), ("p", ["f9.py"], [], None, T[12]), ("p", [], [], ["f10.py"], T[5])])
    assert {(r.file_path, r.change) for r in changed_files(spark, d).collect()} == {("f5.py", "modified"), ("f51.py", "added"), ("f8.py", "deleted")}
