"""Files as they land: several batches, damaged ones with their path, files of finished batches moved away."""

import json
import os

import pytest
from pyspark.errors import AnalysisException

from trajmill.plans.catalog import QUERIES
from trajmill.sources import listing, readers
from trajmill.streaming import ingest


def write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def document(i, **more):
    return json.dumps({"instance_id": f"i{i}", "info": {"exit_status": "Submitted"}, "messages": [{"role": "user", "content": "é\n"}, {"role": "assistant"}], **more}, indent=1)


BAD = {"cut.traj.json": document(9)[:40], "empty.traj.json": "", "blank.traj.json": " \n", "list.traj.json": "[1]", "number.traj.json": "3", "bytes.traj.json": b'{"instance_id": "\xff\xfe"}', "trailing.traj.json": "{not json"}


def test_documents_and_quarantine(spark, tmp_path):
    for i in range(7):
        write(tmp_path / "in", f"a/{i}.traj.json", document(i))
    write(tmp_path / "in", "b/unnamed+1%20x.traj.json", document(0, instance_id="", unknown={"x": [1]}))
    write(tmp_path / "in", "b/nothing.traj.json", "{}")
    write(tmp_path / "in", "b/other.json", "{}")
    for name, content in BAD.items():
        write(tmp_path / "in", f"c/{name}", content)
    landed = ingest.ingest_trajectories(spark, str(tmp_path / "in"), str(tmp_path / "out"), files_per_batch=4)
    rows = {r.instance_id: r for r in ingest.trajectory_rows(landed.documents).collect()}
    assert set(rows) == {*(f"i{i}" for i in range(7)), "unnamed+1%20x", "nothing"}
    assert rows["i3"].exit_status == "Submitted" and rows["nothing"].exit_status == "" and rows["nothing"].messages == []
    assert [(m.role, m.content) for m in rows["i0"].messages] == [("user", "é\n"), ("assistant", "")]
    bad = {os.path.basename(r.path): bytes(r.content) for r in landed.quarantine.collect()}
    assert bad == {name: c if isinstance(c, bytes) else c.encode() for name, c in BAD.items()}
    # Four batches of at most four files.
    commits = [f for f in os.listdir(f"{landed.path}-checkpoint/commits") if f.isdigit()]
    assert len(commits) == 4
    # The batch reader sees the same sound documents.
    sound = readers.read_trajectory_files(spark, str(tmp_path / "in" / "a"))
    assert sorted(r.instance_id for r in sound.collect()) == [f"i{i}" for i in range(7)]


def test_goes_on_and_moves_finished_files(spark, tmp_path):
    source, target, archive = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "done")
    for round_ in range(3):
        for i in range(3):
            write(source, f"{round_}-{i}.traj.json", document(10 * round_ + i))
        landed = ingest.ingest_trajectories(spark, str(source), target, files_per_batch=1, archive=archive)
        assert landed.documents.count() == 3 * (round_ + 1)
    assert landed.quarantine.count() == 0
    moved = [f for _, _, names in os.walk(archive) for f in names if f.endswith(".traj.json")]
    left = [f for _, _, names in os.walk(source) for f in names if f.endswith(".traj.json")]
    assert len(moved) >= 3 and not set(moved) & set(left) and len(moved) + len(left) == 9


def test_predictions_flow_into_the_newest_valid_one(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    patch = lambda text: {"model_patch": text, "instance_id": "x"}

    def process():
        landed = ingest.ingest_predictions(spark, str(source), target)
        rows = ingest.prediction_rows(ingest.landed_stream(landed)).where("model_patch like 'diff --git%'")
        best = ingest.merge_newest(rows, ["instance_id"], ["mtime", "path"], "best", f"{target}-best")
        return landed, {r.instance_id: r.model_patch for r in best.collect()}

    write(source, "1/preds.json", json.dumps({"a": patch("diff --git 1"), "b": patch("diff --git 1"), "c": patch("")}))
    write(source, "2/preds.json", '{"a": {"model_p')
    landed, best = process()
    assert best == {"a": "diff --git 1", "b": "diff --git 1"}
    assert [r.path.rsplit("/", 2)[-2] for r in landed.quarantine.collect()] == ["2"]
    write(source, "3/preds.json", json.dumps({"a": patch("diff --git 3"), "b": patch(""), "d": patch("diff --git 3")}))
    os.utime(source / "3/preds.json", (4e9, 4e9))
    _, best = process()
    assert best == {"a": "diff --git 3", "b": "diff --git 1", "d": "diff --git 3"}


def test_batches_do_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    rows = spark.range(6000).selectExpr("id AS event_id", "id AS user_id", "timestamp'2024-01-01' AS ts", "'view' AS event_type", "1.0 AS value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    asked = {}

    class Stop(Exception):
        pass

    def take(spark, root, **options):
        asked.update(options)
        raise Stop

    monkeypatch.setattr("trajmill.plans.staging.prediction_files", lambda spark, sf: "")
    monkeypatch.setattr("trajmill.streaming.ingest.ingest_predictions", take)
    with pytest.raises(Stop):
        QUERIES["stream_merged_preds"](spark, str(tmp_path))
    assert 720 / asked["files_per_batch"] <= 9  # 240 blocks and three attempts


def test_the_driver_holds_no_state_per_file(spark, tmp_path):
    for i in range(40):
        write(tmp_path / "in", f"{i % 3}/{i}.traj.json", document(i) if i % 4 else "")
    landed = ingest.ingest_trajectories(spark, str(tmp_path / "in"), str(tmp_path / "out"), files_per_batch=10)
    assert (landed.documents.count(), landed.quarantine.count()) == (30, 10)
    log = tmp_path / "out-checkpoint" / "sources" / "0"
    entries = [line for f in log.iterdir() if not f.name.startswith(".") for line in f.read_text().splitlines() if line.startswith("{")]
    assert len(entries) == 4  # one for each batch


def test_spark_lists_no_source_folder(spark, tmp_path, monkeypatch):
    """Spark's stream of a folder lists it in the driver when it is made."""
    write(tmp_path / "in", "0.traj.json", document(0))
    monkeypatch.setattr(ingest, "document_files", lambda *_: pytest.fail("a state per file"))
    assert ingest.ingest_trajectories(spark, str(tmp_path / "in"), str(tmp_path / "out")).documents.count() == 1
    monkeypatch.undo()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        ingest.ingest_trajectories(spark, str(tmp_path / "nothing"), str(tmp_path / "out"))


def test_files_are_listed_as_spark_lists_them(spark, tmp_path):
    for name in ("a.json", "b/c d%20+é.json", "b/{x}[1].json", "b/_hidden.json", "b/_k=1.json", "b/.dot.json", "b/x.json._COPYING_", "_no/a.json", "k=1/_metadata.json", "_metadata/in.json", "b/other.txt", "b/deep/er/line\nbreak.json"):
        write(tmp_path / "in", name, "{}")
    (tmp_path / "in" / "gone.json").symlink_to(tmp_path / "nothing")
    (tmp_path / "in" / "linked").symlink_to(tmp_path / "in" / "b" / "deep")
    (tmp_path / "in" / "empty").mkdir()
    for root, pattern in (("in", "*.json"), ("in", "{a,c*}.json"), ("in/b", "?[^h]*"), ("in/{b,k=*}", "*"), ("in/a.json", "*.json")):
        read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(str(tmp_path / root))
        want = {(r.path, r.modificationTime) for r in read.select("path", "modificationTime").collect()}
        found = [(r.path, r.mtime) for r in listing.list_files(spark, str(tmp_path / root), pattern).collect()]
        assert want and len(found) == len(want) and set(found) == want


def test_batches_hold_no_more_names_than_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "NAMES", 10)
    monkeypatch.setattr(listing, "TASK_NAMES", 30)
    files = spark.range(95).selectExpr("concat('file:/x/', id) AS path", "timestamp_seconds(id) AS mtime")
    listing.append_names(files, str(tmp_path / "names"), 25)
    names = spark.read.parquet(str(tmp_path / "names"))
    held = [r["count"] for r in names.groupBy("_metadata.file_path").count().collect()]
    assert sum(held) == 95 and max(held) * listing.files_per_batch(25) <= 25


def test_a_file_system_that_only_spark_reads(spark, tmp_path, monkeypatch):
    for i in range(5):
        write(tmp_path / "in", f"{i}.traj.json", document(i))
    write(tmp_path / "in", "empty.traj.json", "")
    assert listing.readable(spark, str(tmp_path))
    with monkeypatch.context() as patched:
        patched.setattr(listing, "_split", lambda path: ("viewfs://cluster", path))
        assert not listing.readable(spark, str(tmp_path))
    landed = {}
    for own in (True, False):
        monkeypatch.setattr(listing, "readable", lambda *_, own=own: own)
        landed[own] = ingest.ingest_trajectories(spark, str(tmp_path / "in"), str(tmp_path / f"out-{own}"), files_per_batch=4)
    one, other = (sorted(map(str, landed[own].documents.collect())) for own in (True, False))
    assert one == other and len(one) == 5
    one, other = ([(os.path.basename(r.path), r.mtime, bytes(r.content)) for r in landed[own].quarantine.collect()] for own in (True, False))
    assert one == other and len(one) == 1


def test_an_archive_is_no_source(spark, tmp_path):
    write(tmp_path / "in", "0.traj.json", document(0))
    with pytest.raises(ValueError, match="listed again"):
        ingest.ingest_trajectories(spark, str(tmp_path / "in"), str(tmp_path / "out"), archive=str(tmp_path / "in" / "done"))


def test_nothing_new_and_nothing_at_all(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ingest.ingest_trajectories(spark, str(tmp_path / "in"), str(tmp_path / "out")).documents.count() == 0
    write(tmp_path / "in", "0.traj.json", document(0))
    for _ in range(2):
        landed = ingest.ingest_trajectories(spark, str(tmp_path / "in"), str(tmp_path / "out"))
        assert (landed.documents.count(), landed.quarantine.count()) == (1, 0)
