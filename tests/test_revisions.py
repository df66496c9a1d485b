"""A repository read as tables, against what git itself says of it."""

import os
import shutil
import subprocess

import pytest

from wiretide.operators import records
from wiretide.sources import revisions

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="needs git to make a repository")


def git(folder, *words, at=0, data=None):
    moment = f"{1_700_000_000 + at} +0000"
    env = {**os.environ, "GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_NOSYSTEM": "1", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@example.org", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@example.org", "GIT_AUTHOR_DATE": moment, "GIT_COMMITTER_DATE": moment}
    return subprocess.run(["git", "-C", str(folder), *words], check=True, capture_output=True, env=env, input=data).stdout


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    folder = tmp_path_factory.mktemp("a repository+1")
    git(folder, "init", "-q")
    rows = [f"row {k} with some words" for k in range(400)]
    (folder / "deep" / "er").mkdir(parents=True)
    (folder / "raw.bin").write_bytes(bytes(range(256)) * 3)
    (folder / "empty").write_bytes(b"")
    for k in range(12):
        rows[k * 30] = f"changed in {k}: 192.168.7.{k}"
        (folder / "deep" / "er" / "long.txt").write_text("\n".join(rows) + "\n")
        (folder / f"plc-{k % 3}.txt").write_text(f"ends {k}\r\nwithout a line feed")
        git(folder, "add", "-A", at=k)
        git(folder, "commit", "-q", "-m", f"step {k}\n\nfrom 10.1.2.{k}\n", at=k)
        if k == 8:
            git(folder, "repack", "-adfq", "--depth=20", "--window=20")
    # A second pack with most objects again, by other chains and with bases named by id.
    names = git(folder, "rev-list", "--objects", "--all", "--not", "HEAD~6")
    names += git(folder, "rev-list", "--objects", "HEAD~6")
    git(folder, "pack-objects", "-q", "--depth=3", "--window=5", "--no-reuse-delta", ".git/objects/pack/pack", data=names)
    return folder


@pytest.fixture(scope="module")
def found(spark, repository):
    return revisions.cut(revisions.objects(spark, f"{repository}/.git"), "found")


def test_objects_equal_gits(repository, found):
    listed = [x.split() for x in git(repository, "cat-file", "--batch-all-objects", "--batch-check").decode().splitlines()]
    got = {r.oid: (r.kind, bytes(r.data)) for r in found.collect()}
    assert sorted(got) == sorted(x[0] for x in listed) and found.count() == len(got)
    for oid, kind, size in listed:
        assert got[oid][0] == kind and len(got[oid][1]) == int(size)
        assert got[oid][1] == git(repository, "cat-file", kind, oid)
    checked = git(repository, "verify-pack", "-v", *[str(p) for p in (repository / ".git/objects/pack").glob("*.idx")]).decode()
    assert "chain length = 2" in checked, "the packs must hold chains of differences"


def test_bases_by_place_and_by_id(spark, repository):
    kinds = {r.kind: r["count"] for r in revisions._stored(spark, f"{repository}/.git").groupBy("kind").count().collect()}
    assert kinds["by place"] > 0 and kinds["by id"] > 0


def test_a_store_without_a_base(spark, repository, tmp_path):
    with pytest.raises(revisions.RevisionError):
        blind = revisions._stored(spark, f"{repository}/.git").filter("kind LIKE 'by %' OR kind = 'commit'")
        revisions.assembled(blind, spark.createDataFrame([], "oid string, kind string, data binary"), "the test")


def test_files_of_each_revision_equal_gits(repository, found):
    want = set()
    for revision in git(repository, "rev-list", "--all").decode().split():
        for row in git(repository, "ls-tree", "-r", revision).decode().splitlines():
            head, path = row.split("\t")
            want.add((revision, path, head.split()[2]))
    got = [tuple(r) for r in revisions.files(found).select("revision", "path", "oid").collect()]
    assert sorted(got) == sorted(want)


def test_messages_and_their_order(repository, found):
    rows = revisions.commits(found).orderBy("pos").collect()
    assert [r.revision for r in rows] == git(repository, "rev-list", "--all", "--reverse").decode().split()
    assert [r.text for r in rows] == [f"step {k}\n\nfrom 10.1.2.{k}\n" for k in range(12)]


def test_history_of_a_repository(spark, repository):
    trees, messages = revisions.read_history(spark, f"{repository}/.git")
    hits = records.history(trees, messages).collect()
    order = git(repository, "rev-list", "--all", "--reverse").decode().split()
    places = {(r.revision, r.path, r.line) for r in hits if r.surface == "tree" and r.rule_id == "identity-private-ipv4"}
    assert places == {(order[k], "deep/er/long.txt", 30 * j + 1) for k in range(12) for j in range(k + 1)}
    assert {r.revision for r in hits if r.surface == "message" and r.rule_id == "identity-private-ipv4"} == set(order)
    assert {(r.revision, r.path) for r in hits if r.surface == "name"} == {(order[k], f"plc-{k}.txt") for k in range(3)}
    assert trees.filter("path IN ('empty', 'raw.bin')").filter("line IS NOT NULL OR text IS NOT NULL").count() == 0


def test_a_missing_base_is_told():
    with pytest.raises(revisions.RevisionError):
        revisions.applied(b"abc", bytes([4, 1, 1, 65]))
    assert revisions.applied(b"abc", bytes([3, 3, 0x91, 1, 2, 1, 65])) == b"bcA"
