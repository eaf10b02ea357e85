import os

import numpy as np
import pytest

from lambertlake.sources import exchange
from lambertlake.storage.project import Project
from lambertlake.streaming import imports

X = np.arange(200, 231.0)


def put(folder, name, text=None):
    (folder / name).write_text(text if text is not None else exchange.write_jcamp(name.split(".")[0], X, np.cos(X)))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def imported(project):
    return sorted(r["name"] for r in project.records().collect())


def run(spark, project, folder, checkpoint, **options):
    imports.into_project(project, imports.arriving_files(spark, str(folder), per_batch=2), checkpoint, **options).awaitTermination()


def test_every_file_once_although_the_stream_dies(spark, tmp_path, folder):
    project = Project.create(spark, str(tmp_path / "p"), "s")
    for k in range(5):
        put(folder, f"f{k}.jdx")
    put(folder, "bad.csv", "nothing\n")
    was, calls = project.import_frame, []

    def dies(*args, **kwargs):
        """The second batch's commit is made, but the stream doesn't hear of it; the third isn't made."""
        calls.append(1)
        if len(calls) == 2:
            was(*args, **kwargs)
        if len(calls) >= 2:
            raise RuntimeError("killed")
        return was(*args, **kwargs)

    project.import_frame = dies
    with pytest.raises(Exception, match="killed"):
        run(spark, project, folder, str(tmp_path / "cp"))
    project.import_frame = was
    assert len(calls) == 2
    put(folder, "late.jdx")
    again = Project(spark, str(tmp_path / "p"))
    run(spark, again, folder, str(tmp_path / "cp"))
    assert imported(again) == ["f0", "f1", "f2", "f3", "f4", "late"]
    (bad,) = imports.rejected(again).collect()
    assert bad.source_file.endswith("bad.csv") and bad.message and bad.stream == "import"
    entries = again.audit(action="IMPORT").collect()
    assert len(entries) == 4 and sum('"rejected":1' in e["details"].replace(" ", "") for e in entries) == 1
    assert again.verify() == []


def test_a_batch_handed_over_again_changes_nothing(spark, tmp_path, folder):
    project = Project.create(spark, str(tmp_path / "p"), "s")
    put(folder, "a.jdx")
    put(folder, "bad.csv", "no\n")
    run(spark, project, folder, str(tmp_path / "cp"))
    n = project.table("audit").count()
    for file in os.listdir(tmp_path / "cp" / "commits"):  # as if the stream had died before its own note
        os.remove(tmp_path / "cp" / "commits" / file)
    run(spark, project, folder, str(tmp_path / "cp"))
    assert imported(project) == ["a"] and imports.rejected(project).count() == 1 and project.table("audit").count() == n


def test_two_streams_and_none(spark, tmp_path, folder):
    project = Project.create(spark, str(tmp_path / "p"), "s")
    assert imports.rejected(project).count() == 0
    other = tmp_path / "other"
    other.mkdir()
    put(folder, "a.jdx")
    put(other, "b.jdx")
    run(spark, project, folder, str(tmp_path / "cp1"), name="one")
    run(spark, project, other, str(tmp_path / "cp2"), name="two")
    assert imported(project) == ["a", "b"]
    put(folder, "worse.csv", "no\n")
    run(spark, project, folder, str(tmp_path / "cp1"), name="one")
    assert imported(project) == ["a", "b"] and [r.stream for r in imports.rejected(project).collect()] == ["one"]
    assert len({r["id"] for r in project.records().collect()}) == 2
