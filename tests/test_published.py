import hashlib
from pathlib import Path

import pytest

from plumbline.sources import published as p


def tree(body, size):
    digests = [hashlib.sha256(body[i:i + size]).hexdigest() for i in range(0, max(len(body), 1), size)]
    nodes = [hashlib.sha256("".join(digests[i:i + p.FAN]).encode()).hexdigest() for i in range(0, len(digests), p.FAN)]
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def test_files_of_any_length_have_the_digest_of_their_tree(spark, tmp_path):
    bodies = {"none.bin": b"", "one.bin": b"x", "edge.bin": bytes(range(256)) * 4, "over.bin": bytes(range(256)) * 4 + b"!", "sub/a b%20.bin": b"\n\r\0" * 999}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    for whole in (128, 512, 4096):  # from every file by ranges to every file as a row
        found = {r["path"].rsplit(f"{tmp_path.name}/", 1)[1]: (r["length"], r["sha256"]) for r in p.tree_fingerprint(spark, str(tmp_path), 128, whole).collect()}
        assert found == {n: (len(b), tree(b, 128)) for n, b in bodies.items() if b}


def test_ranges_fold_in_more_than_one_node(spark, tmp_path):
    body = bytes(i % 251 for i in range(p.FAN * 2 + 5))
    (tmp_path / "long.bin").write_bytes(body)
    assert [r["sha256"] for r in p.tree_fingerprint(spark, str(tmp_path), 1, 1).collect()] == [tree(body, 1)]
    with pytest.raises(ValueError, match="one node"):
        p.tree_fingerprint(spark, str(tmp_path), 1, p.FAN + 1)


def test_a_set_is_published_once_and_read_whole(spark, tmp_path, rows):
    folder = str(tmp_path / "set")
    with pytest.raises(ValueError, match="not published"):
        p.read_published(spark, folder)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    said = p.publish(df, folder)
    assert said["files"] >= 1 and rows(p.read_published(spark, folder)) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="published"):
        p.publish(df, folder)
    assert rows(p.read_published(spark, folder)) == [(1, "a"), (2, None)]


def test_an_empty_set_keeps_its_schema(spark, tmp_path):
    p.publish(spark.createDataFrame([], "id int, name string"), str(tmp_path / "none"))
    back = p.read_published(spark, str(tmp_path / "none"))
    assert back.dtypes == [("id", "int"), ("name", "string")] and back.count() == 0


def test_the_writer_that_comes_second_fails(spark, tmp_path, rows, monkeypatch):
    folder = str(tmp_path / "race")
    create = p._create

    def overtaken(session, name, text):
        monkeypatch.setattr(p, "_create", create)
        p.publish(spark.createDataFrame([(9,)], "id int"), folder)
        create(session, name, text)
    monkeypatch.setattr(p, "_create", overtaken)
    with pytest.raises(ValueError, match="another writer"):
        p.publish(spark.createDataFrame([(1,)], "id int"), folder)
    assert rows(p.read_published(spark, folder)) == [(9,)]


def test_a_set_without_a_whole_manifest_is_not_read(spark, tmp_path):
    folder = tmp_path / "half"
    p.publish(spark.createDataFrame([(1,)], "id int"), str(folder))
    manifest = folder / "manifest.json"
    manifest.write_text(manifest.read_text()[:40])
    (folder / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="incomplete"):
        p.read_published(spark, str(folder))


@pytest.mark.parametrize("kind", ["added", "missing", "changed"])
def test_changes_since_publishing_are_named(spark, tmp_path, kind):
    folder = tmp_path / kind
    said = p.publish(spark.createDataFrame([(1,), (2,)], "id int").coalesce(1), str(folder), "json")
    part = next(Path(folder / f"set-{said['set']}").glob("part-*"))
    if kind == "added":
        (part.parent / "part-extra.json").write_text('{"id": 3}\n')
    elif kind == "missing":
        part.rename(tmp_path / "elsewhere")
    else:
        part.write_text('{"id": 1}\n{"id": 7}\n')
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert [r["change"] for r in p.published_changes(spark, str(folder)).collect()] == [kind]
    with pytest.raises(ValueError, match=kind):
        p.read_published(spark, str(folder))
