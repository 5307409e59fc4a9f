"""Files that the export queries write: how many, where, and what is read back."""

import json
import os
import re

from keepsake.plans import registry
from keepsake.sources import exports


def written(folder):
    """(folders, files) of the posts written under a folder, paths relative to it."""
    dirs, files = set(), []
    for at, _, names in os.walk(folder):
        for n in names:
            if n.startswith("part-") and "year=" in at:
                dirs.add(os.path.relpath(at, folder))
                files.append(os.path.relpath(os.path.join(at, n), folder))
    return dirs, files


def test_post_files_lie_in_a_folder_a_year(spark, tmp_path, monkeypatch):
    """40 part files are 40 files in 4 folders: a folder a file made the driver's walk grow with the posts."""
    ids = range(5_000)
    spark.createDataFrame([(i, "view", 0.0) for i in ids], "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    here = f"{tmp_path}/shared"
    monkeypatch.setattr("keepsake.sources.shared.folder", lambda spark: here)
    got = {r["id"]: (r["content"], r["parent"]) for r in registry.queries()["sc06_posts"](spark, str(tmp_path)).collect()}
    dirs, files = written(here)
    counts = {r["year"]: r["files"] for r in registry.queries()["sc05_part_files"](spark, str(tmp_path)).collect()}
    assert got == {str(i): (f"view {i * 7}", str(i // 3) if i % 3 == 1 else str(i // 2) if i % 2 == 1 else None) for i in ids}
    assert len(files) == 40 and {re.sub(".*/", "", d) for d in dirs} == {f"year={y}" for y in range(4)} and len(dirs) == 4
    assert counts == {str(y): 10 for y in range(4)}


def test_comment_levels_are_read_some_at_once(spark, tmp_path, monkeypatch):
    """A chain of 21 comments is written in 6 tables (before: 22), with a branch at each; replies of odd types lose themselves alone."""
    node = {"id": "n20"}
    for k in range(19, -1, -1):
        node = {"id": f"n{k}", "author": "a", "replies": [None, node, {"body": "no id", "replies": [{"id": "lost"}]}, {"id": f"s{k}"}]}
    odd = {"id": "r", "replies": [{"id": "a", "replies": ""}, 5, "", {"id": "b", "created_utc": 1.5, "body": "x", "replies": [{"id": "c", "created_utc": 7}, []]}, {"id": "d", "replies": [{"id": "e"}]}]}
    monkeypatch.setattr("keepsake.sources.shared.folder", lambda spark: str(tmp_path))
    rows = exports.flattened_comments(spark.createDataFrame([(1, json.dumps(node)), (2, None), (3, "{")], "thread long, tree string")).collect()
    assert {(r["id"], r["parent"], r["depth"]) for r in rows} == {(f"n{k}", f"n{k - 1}" if k else None, k) for k in range(21)} | {(f"s{k}", f"n{k}", k + 1) for k in range(20)}
    assert len(rows) == 41 and len(list(tmp_path.glob("keepsake/comments-*/level=*"))) == 6
    got = exports.flattened_comments(spark.createDataFrame([(1, json.dumps(odd))], "thread long, tree string")).collect()
    assert sorted((r["id"], r["parent"], r["depth"], r["body"], r["ts"]) for r in got if r["parent"]) == [("a", "r", 1, None, None), ("b", "r", 1, "x", None), ("c", "b", 2, None, 7), ("d", "r", 1, None, None), ("e", "d", 2, None, None)]
    assert len(got) == 6
