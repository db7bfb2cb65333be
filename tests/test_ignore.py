"""Ignore files above a tree, of the repository and of the user; files that can't be read."""

import pytest

from portcullis.sources.files import ignore_rules, source_files


@pytest.fixture
def repository(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    (tmp_path / "config" / "git").mkdir(parents=True)
    (tmp_path / "config" / "git" / "ignore").write_text("*.user.ts\n")
    repo = tmp_path / "repo"
    (repo / ".git" / "info").mkdir(parents=True)
    (repo / ".git" / "info" / "exclude").write_text("/app/private/\n")
    (repo / ".gitignore").write_text("gen\n/app/src/out/\n/lib/x.ts\napp/**/tmp.ts\n*.min.js\n!keep.min.js\n")
    (repo / "app" / "src").mkdir(parents=True)
    (repo / "app" / ".gitignore").write_text("src/old.ts\n")
    for f in ("a.ts", "a.user.ts", "gen/b.ts", "out/c.ts", "deep/out/d.ts", "old.ts", "deep/tmp.ts", "x.ts", "m.min.js", "keep.min.js"):
        path = repo / "app" / "src" / f
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("hasRole('x');\n")
    (repo / "app" / "private").mkdir()
    (repo / "app" / "private" / "p.ts").write_text("x\n")
    return repo


def test_ignore_files_above_a_tree(spark, repository):
    paths = lambda root: {r["path"] for r in source_files(spark, str(root), rules=ignore_rules(root)).collect()}
    assert paths(repository / "app" / "src") == {"a.ts", "deep/out/d.ts", "x.ts", "keep.min.js"}
    assert paths(repository) == {f"app/src/{f}" for f in ("a.ts", "deep/out/d.ts", "x.ts", "keep.min.js")}
    (repository / ".git" / "info" / "exclude").unlink()
    assert "app/private/p.ts" in paths(repository)


def test_a_tree_that_workers_do_not_see_is_no_empty_scan(spark, tmp_path):
    import shutil

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.ts").write_text("hasRole('x');\n")
    (root / "bad.ts").write_bytes(b"\xff\xfe\xfa")
    files = source_files(spark, str(root))
    assert [r["path"] for r in files.collect()] == ["a.ts"]
    shutil.rmtree(root)
    with pytest.raises(Exception, match="No such file"):
        files.collect()
