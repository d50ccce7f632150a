"""Discovery, full and incremental parses of real small repositories, and the query front-ends."""

import json
import os
import subprocess

import pytest

from codeweave.operators import incremental
from codeweave.query.cypher import Unsupported
from codeweave.query.sql import ReadOnly
from codeweave.sources import repository, tree
from codeweave.sources.store import Busy, GraphStore
from codeweave.streaming import trigger
from codeweave.tools import Tools

FILES = {
    "src/base.py": "class Base:\n    def run(self): pass\n",
    "src/app.py": "from .base import Base\n\nclass App(Base):\n    def go(self, x): pass\n\ndef main(a): return 1\n",
    "src/__init__.py": "# package\n", "web/index.ts": "import { View } from './view';\nexport class Page extends View implements Shown { draw(): void { } }\n",
    "web/view.ts": "export class View { }\nexport interface Shown { draw(): void }\n", "README.md": "# hi\n", "node_modules/x/a.js": "function no() {}\n",
    "yarn.lock": "x\n", "logo.png": "x\n", "empty.py": "", "Makefile": "all:\n", "bad.min.js": "x\n", ".env": "A=1\n", ".gitignore": "x\n",
}


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def put(repo, files):
    for name, text in files.items():
        path = os.path.join(repo, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    repo = tmp_path_factory.mktemp("repo")
    put(repo, FILES)
    git(repo, "init", "-q")
    git(repo, "add", "-A", "-f")
    git(repo, "commit", "-qm", "one")
    tools = Tools(spark, str(tmp_path_factory.mktemp("store")), "demo")
    return repo, tools, tools.parse_repo(str(repo), "demo")


def test_discovery(spark, parsed):
    files, large = tree.discover(spark, str(parsed[0]))
    assert [r["path"] for r in files.orderBy("parse_order").collect()] == [".gitignore", "Makefile", "README.md", "src/__init__.py", "src/app.py", "src/base.py", "web/index.ts", "web/view.ts"]
    assert large.count() == 0
    files, large = tree.discover(spark, str(parsed[0]), tree.Discovery(max_file_size=30, include=["*.min.js"], exclude=["src/*"]))
    assert [r["path"] for r in files.orderBy("path").collect()] == [".gitignore", "Makefile", "README.md", "bad.min.js"]
    assert {r["path"] for r in large.collect()} == {"web/index.ts", "web/view.ts"}
    with pytest.raises(tree.TooManyFiles):
        tree.discover(spark, str(parsed[0]), tree.Discovery(max_files=2))


def test_full_parse(parsed):
    _, tools, report = parsed
    assert report["status"] == "completed" and report["diff"]["first_parse"]
    d = tools.describe_project("demo")
    assert d["counts"] == {"Directory": 2, "File": 8, "Function": 1, "Method": 3, "Class": 4, "Interface": 1, "Enum": 0, "Origin": 1, "CONTAINS": 14, "IMPORTS": 2, "INHERITS": 2, "IMPLEMENTS": 1}
    assert d["directories"] == ["src", "web"] and "web/index.ts" in d["entry_files"] and len(d["origin"]["commit_sha"]) == 40
    assert tools.list_projects() == {"primary": "demo", "databases": ["demo"]}


def test_queries(parsed):
    _, tools, _ = parsed
    ask = lambda text, language="sql", params=None: [tuple(r) for r in tools.query(text, language, params, "demo").collect()]
    assert ask("SELECT count(*) AS n FROM Function") == [(1,)]
    assert ask("SELECT name FROM Class WHERE name IN ['App', 'View'] ORDER BY name") == [("App",), ("View",)]
    assert ask("SELECT name FROM Class WHERE file_path = :f", params={"f": "src/app.py"}) == [("App",)]
    assert ("File", "vertex", 8) in ask("SELECT name, type, records FROM schema:types")
    for bad in ("DROP VIEW Class", "INSERT INTO Class VALUES (1)", "CREATE TABLE t (a int)"):
        with pytest.raises(ReadOnly):
            tools.query(bad, "sql", None, "demo")
    assert ask("MATCH (a:Class)-[:INHERITS]->(b:Class {name: 'Base'}) RETURN a.name AS name", "cypher") == [("App",)]
    assert ask("MATCH (d:Directory)-[:CONTAINS*1..3]->(m:Method) WHERE d.path = $p RETURN count(m) AS n", "cypher", {"p": "src"}) == [(2,)]
    assert ask("MATCH (f:File)-[:CONTAINS]->(m:Method) RETURN f.path AS path, count(*) AS n ORDER BY path LIMIT 2", "cypher") == [("src/app.py", 1), ("src/base.py", 1)]
    assert ask("MATCH (f:File)<-[:IMPORTS]-(g:File) WHERE f.language = 'x' OR g.path ENDS WITH 'app.py' RETURN DISTINCT f.path AS p", "cypher") == [("src/base.py",)]
    assert ask("g.V().hasLabel('Class').has('name', 'App').out('INHERITS').values('name')", "gremlin") == [("Base",)]
    assert ask("g.V().hasLabel('File').in('CONTAINS').dedup().count()", "gremlin") == [(2,)]
    assert dict(ask("g.V().hasLabel('File').groupCount().by('language')", "gremlin"))["python"] == 3
    assert ask("g.V().hasLabel('Directory').has('path', 'web').repeat(out('CONTAINS')).times(2).hasLabel('Class').order().by('name').values('name').limit(1)", "gremlin") == [("Page",)]
    with pytest.raises(Unsupported):
        ask("MATCH (a)-[r:INHERITS]->(b) RETURN a", "cypher")
    with pytest.raises(Unsupported):
        ask("g.V().drop()", "gremlin")
    assert tools.call("nothing", {})["isError"] and tools.call("describe_project", {"project": "none"})["isError"]
    assert tools.get_schema().filter("type = 'Class'").count() == 6


def test_incremental(spark, parsed):
    repo, tools, _ = parsed
    put(repo, {"src/base.py": "class Base:\n    def run(self, more): pass\n\nclass Extra(Base): pass\n", "src/new.py": "from .base import Extra\nclass N(Extra): pass\n"})
    os.remove(os.path.join(repo, "web/index.ts"))
    git(repo, "add", "-A", "-f")
    git(repo, "commit", "-qm", "two")
    r = tools.parse_repo(str(repo), "demo", clean=False, incremental=True)
    assert r["incremental"] and {k: r["diff"][k] for k in ("added", "changed", "deleted")} == {"added": 2, "changed": 1, "deleted": 2}
    assert r["edges"] == {"restored": 2, "dropped": 0}
    full = Tools(spark, tools.store.root + "/other", "demo")
    full.parse_repo(str(repo), "demo")
    rows = lambda t, name, *drop: sorted(map(str, t.store.read("demo", name).drop(*drop).collect()))
    for name in ("File", "Function", "Method", "Class", "Interface", "edges"):
        assert rows(tools, name) == rows(full, name), name
    assert tools.parse_repo(str(repo), "demo", clean=False, incremental=True)["no_changes"]
    log = tools.store.diff_log("demo").collect()
    assert len(log) == 1 and json.loads(log[0]["summary"])["added"] == 2
    with pytest.raises(ValueError):
        tools.parse_repo(str(repo), "demo", incremental=True)
    with tools.store.lock("demo"), pytest.raises(Busy):
        tools.parse_repo(str(repo), "demo")


def test_changes(tmp_path):
    put(tmp_path, {"a": "1\n", "b": "1\n", "c": "1\n"})
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "one")
    one = repository.head_sha(str(tmp_path))
    put(tmp_path, {"a": "2\n", "d": "1\n"})
    os.remove(tmp_path / "b")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "two")
    two = repository.head_sha(str(tmp_path))
    assert repository.changes(str(tmp_path), one, two) == (["a", "d"], ["b"])
    assert repository.changes(str(tmp_path), "0" * 40, two) is None and repository.changes(str(tmp_path), one, one) == ([], [])
    copy = repository.clone(str(tmp_path))
    assert sorted(x for x in os.listdir(copy) if x != ".git") == ["a", "c", "d"] and repository.clone(str(tmp_path / "none")) is None


def test_changes_by_content(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "2"), ("c", "1"), ("d", "1")], "path string, content_hash string")
    assert {tuple(r) for r in incremental.changes_by_content(old, new).collect()} == {("a", "changed"), ("b", "removed"), ("d", "changed")}


def test_aliases(tmp_path):
    put(tmp_path, {"tsconfig.json": '{\n// c\n"extends": "./base", "compilerOptions": {"paths": {"@app/*": ["./code/*"], "core": ["lib/core"],},},\n}', "base.json": '{"compilerOptions": {"baseUrl": "."}}',
                   "pkg/one/package.json": '{"name": "@x/one"}', "pkg/one/src/i.ts": "1", "pkg/two/package.json": '{"name": "two"}', "package.json": '{"name": "root"}', "pubspec.yaml": "name: shop\n"})
    assert repository.aliases(str(tmp_path)) == {"@app/": "code/", "core": "lib/core", "@x/one": "pkg/one/src", "two": "pkg/two"}
    assert repository.aliases(str(tmp_path), "default") == {"@/": "src/", "~/": "src/"} and repository.dart_package(str(tmp_path)) == "shop"


def test_hook_and_stream(spark, tmp_path):
    repo, notices = tmp_path / "r", tmp_path / "notices"
    put(repo, {"a": "1"})
    git(repo, "init", "-q")
    hook = repository.install_hook(str(repo), str(notices), "p")
    first = open(hook).read()
    repository.install_hook(str(repo), str(notices), "p")
    assert open(hook).read() == first and os.access(hook, os.X_OK)
    assert repository.uninstall_hook(str(repo)) and not os.path.exists(hook)
    put(notices, {"1.json": '{"project": "p", "repo": "/r", "trigger": "x"}', "2.json": '{"project": "p", "repo": "/r"}', "3.json": '{"project": "q", "repo": "/s"}', "4.json": '{"other": 1}'})
    seen = []
    q = trigger.run(trigger.notices(spark, str(notices)), lambda p, r: seen.append((p, r)), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(60)
    assert sorted(seen) == [("p", "/r"), ("q", "/s")]


def test_names():
    assert GraphStore.name_of("a b/ç") == "a_b__" and GraphStore.name_of("") == "default" and len(GraphStore.name_of("x" * 99)) == 64


def test_long_import_clause(spark):
    """A clause of 10,000 characters is read whole."""
    from codeweave.operators import imports
    from codeweave.operators.extract import Layout

    names = [f"name_{i:05d}" for i in range(1000)]
    text = "import {\n  " + ",\n  ".join(names) + "\n} from './all';\nconst x = require(" + " " * 3000 + "'other');\n"
    got = imports.js(text, text, Layout(text))
    assert [(r["source"], len(r["names"])) for r in got] == [("./all", 1000), ("other", 1)]


def test_versions_are_added_and_locks_expire(spark, tmp_path):
    from codeweave.sources import store

    st = store.GraphStore(spark, f"file://{tmp_path}/graphs")
    files = spark.createDataFrame([("a.py", "a.py", "a.py", "python", "", None)], "path string, file_path string, name string, language string, domain string, summary string")
    assert st.version("p") is None and st.write("p", {"File": files}) == 1 and st.write("p", {}) == 2
    # a version that was begun and never finished is not seen, and its number is not used again
    (tmp_path / "graphs/p/v=3").mkdir()
    assert st.version("p") == 2 and st.read("p", "File", 1).count() == 1 and st.write("p", {"File": files}) == 4
    st.vacuum("p", 1)
    assert st.version("p") == 4 and not (tmp_path / "graphs/p/v=1").exists()
    with st.lock("p"), pytest.raises(store.Busy), st.lock("p"):
        pass
    (tmp_path / "graphs/p/_LOCK").write_text("1.0")
    (tmp_path / "graphs/p/._LOCK.crc").unlink(missing_ok=True)
    with st.lock("p"):
        pass


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from codeweave.sources.store import scratch

    session = N(conf=N(get=lambda *_: None), sparkContext=N(getConf=lambda: N(get=lambda *_: None), master="spark://somewhere"))
    with pytest.raises(RuntimeError):
        scratch(session)


def test_contents_are_shipped_in_batches(spark, tmp_path, monkeypatch):
    """As on executors that can't see the tree: the folder is gone before anything is read."""
    import shutil

    from codeweave.sources import tree

    monkeypatch.setattr(tree, "SHIP_BYTES", 300)
    for i in range(9):
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / f"t/f{i}.py").write_bytes(b"x = 1\n" * 30 + b"\xff")
    files, _ = tree.discover(spark, str(tmp_path / "t"))
    files = spark.createDataFrame([*map(tuple, files.collect()), ("gone.py", 1, 99, "python")], files.schema)
    table = tree.ship(files, str(tmp_path / "t"), f"file://{tmp_path}/shipped")
    shutil.rmtree(tmp_path / "t")
    got = {r["path"]: r["content"] for r in tree.read_files(files, str(tmp_path / "t"), table).collect()}
    assert len(got) == 10 and got["gone.py"] is None and got["f3.py"] == "x = 1\n" * 30
