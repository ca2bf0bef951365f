import random

import pytest
from pyspark.sql import functions as F

from grovelens.functions import globs, text
from grovelens.operators import conventions, drift, modules, state
from grovelens.operators.nearest import nearest
from grovelens.sources.store import TABLES, Store
from grovelens.streaming import ledger


def values(spark, expression, given):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string")
    return [r.y for r in df.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def test_scalars(spark):
    said = ["Handles licensed users.", "Copyright 2020. X", "{@link Foo|bar} is. More", "See [a](b) now\nand then. X", "x" * 155 + "     y. z", "", "eslint rules!", "e.g. this", "eslint-disable x"]
    assert values(spark, text.first_sentence, said) == ["Handles licensed users.", None, "Foo is.", "See a now and then.", "x" * 155 + " y.", None, "eslint rules!", "e.g.", None]
    assert values(spark, text.first_sentence, ["a" * 158 + " " + "b" * 9]) == ["a" * 158 + "…"]
    assert values(spark, text.readme_summary, ["# T\n\n![x](y)\n\nThe *tool* [does](z). More.", "# Only\n", "<p>\n\n[![b](c)](d)\n\nText"]) == ["The tool does.", None, "Text"]
    names = ["User", "index", "userList", "UserList", "user-list", "user_list", "9a-b", "x9Y", "HTML", "a-B"]
    assert values(spark, text.file_name_style, names) == [None, None, "camelCase", "PascalCase", "kebab-case", "snake_case", "kebab-case", "camelCase", None, None]
    assert values(spark, modules.slug, [".", "a/b"]) == ["root", "a-b"] and values(spark, modules.label, [".", "a"]) == ["(root)", "a/"]


def test_ignore_rules(spark):
    lines = ["# no", "", "build/", "*.log", "!keep.log", "/top.txt", "a/**/z", "doc/*.md", "f[0-9].x"]
    given = {"build/x": True, "src/build/y/z": True, "build": False, "a.log": True, "d/keep.log": False, "top.txt": True, "d/top.txt": False, "a/z": True, "a/b/c/z": True, "doc/x.md": True, "doc/d/x.md": False, "f1.x": True, "fa.x": False, "build/keep.log": True}
    rules = globs.compiled(lines)
    assert values(spark, lambda c: globs.ignored(c, rules), given) == list(given.values())
    assert [globs.ignores(p, rules) for p in given] == list(given.values())
    assert values(spark, lambda c: globs.matches_module(c, "src/*"), ["src/a", "src", "src/a/b"]) == [True, False, False]
    assert values(spark, lambda c: globs.matches_module(c, "src/**"), ["src/a", "src", "lib", "src/a/b"]) == [True, True, False, True]


def test_dominant_folders(spark):
    paths = [f"app/{d}/f{i}.py" for d in ("api", "db") for i in range(5)] + ["app/__init__.py", "other/x.py", "setup.py"]
    paths += [f"web/src/main/java/com/x{i}/F.java" for i in range(9)] + [f"tests/t{i}/x.py" for i in range(12)]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = modules.dominant_folders(files, roots=["web"])
    assert set(found) >= {"app", "web/src/main", "web/src/main/java"} and "tests" not in found
    placed = {r.path: r.m for r in files.select("path", modules.module_id(F.col("path"), (), ["web"], found).alias("m")).collect()}
    assert placed["app/api/f1.py"] == "app/api" and placed["app/__init__.py"] == "app" and placed["setup.py"] == "." and placed["tests/t1/x.py"] == "tests"
    assert modules.dominant_folders(files, overrides=["app"], roots=["web"]).count("app") == 0


def test_conventions(spark):
    files = [(f"src/a/one-{i}.ts", "typescript", "src/a", False) for i in range(4)] + [(f"src/a/fixtures/x{i}.test.ts", "typescript", "src/a", True) for i in range(5)]
    files += [(f"t/{n}", "python", "t", True) for n in ("test_a.py", "test_b.py", "c_test.py", "test_d.py", "test_e.py")]
    frame = spark.createDataFrame(files, "path string, language string, module string, is_test boolean")
    symbols = spark.createDataFrame([(f"src/a/one-{i}.ts", True, d) for i in range(4) for d in ((True, False) if i < 3 else (False,))], "file_path string, exported boolean, is_default boolean")
    got = {r.id: (r.matched, r.sample_size, r.evidence) for r in conventions.detect(frame, symbols).collect()}
    assert got == {  # three of four files mix their exports: no convention of that kind
        "src/a:file-naming:kebab-case": (4, 4, ["src/a/one-0.ts", "src/a/one-1.ts", "src/a/one-2.ts"]),
        ".:test-naming:test-prefix": (4, 5, ["t/test_a.py", "t/test_b.py", "t/test_d.py"]),
        ".:test-location:dir:t": (5, 5, ["t/c_test.py", "t/test_a.py", "t/test_b.py"]),
    }
    old = spark.createDataFrame([("a:file-naming:x", "a", "file-naming", "x", "s", 3, 3, ["p"], "confirmed", True)], TABLES["conventions"])
    synced = state.sync_conventions(old, conventions.detect(frame, symbols))
    assert {(r.id, r.status, r.active) for r in synced.filter("id like 'a:%'").collect()} == {("a:file-naming:x", "confirmed", False)}
    decided = state.apply_decisions(synced, spark.createDataFrame([("b:test-location:dir:q", "confirmed"), ("odd", "rejected"), ("odd", "confirmed")], "id string, status string"))
    rows = {r.id: (r.module, r.pattern, r.value, r.status, r.active) for r in decided.collect()}
    assert rows["b:test-location:dir:q"] == ("b", "test-location", "dir:q", "confirmed", False) and rows["odd"] == (".", "unknown", "odd", "rejected", False)
    assert [r.id for r in state.lapsed(decided).collect()] == ["b:test-location:dir:q"]


DOC = """See `src/app`, `pkg/mod`, `lodash/fp`, `@org/lib/x`, `example.com/a`, `path/to/x.ts`, `read/write`, `../../out.ts`, `./near.ts`, `src/old.ts`, `lib/`, `gone/`.
[a](near.ts) [b](app.ts) `JSON.parse()` `Thing.doIt()` `getUsr()` `dist/x.js`
`npm start` `npm run nope` `cd nowhere && npm run x` `cd web && npm run y` `make all`
"""


def test_drift_rules(spark):
    files = spark.createDataFrame([(p,) for p in ("src/app.ts", "src/lib/a.py", "x/old.ts", "test/old.ts", "docs/near.ts", "package.json", "server.js", "web/index.html", "x/pkg/mod.py")], "path string")
    scripts = spark.createDataFrame([(".", "package", "test")], "dir string, kind string, name string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    docs = spark.createDataFrame([("docs/a.md", DOC)], "path string, text string")
    found = drift.find_drift(docs, files, scripts, names("doIt", "parse"), names("getUser"), names("lodash", "@org/lib"), ["never"], ["AGENTS.md"], globs.compiled(["dist/"]))
    assert [(r.line, r.kind, r.reference, r.message, r.suggestion) for r in found.collect()] == [
        (1, "path", "gone/", "path does not exist", None),
        (1, "path", "src/old.ts", "path does not exist", "x/old.ts"),
        (2, "link", "app.ts", "link target does not exist", "src/app.ts"),
        (2, "symbol", "getUsr", "`getUsr` does not appear anywhere in the code", "getUser"),
        (2, "symbol", "Thing.doIt", "`Thing` does not appear anywhere in the code", None),
        (3, "command", "make all", "there is no Makefile in this project for this command", None),
        (3, "command", "npm run nope", "`nope` is not a script in package.json", None),
    ]


@pytest.mark.parametrize("d", [1, 3])
def test_nearest_against_every_pair(spark, d):
    rng = random.Random(d)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row[-1], 1 + abs(len(a) - len(b)) / 100) if a.startswith(b) or b.startswith(a) else row[-1]

    options = {"".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(120)}
    asked = []
    for i in range(200):
        s = list(rng.choice(sorted(options)))
        for _ in range(rng.randint(0, d + 1)):
            s[rng.randrange(len(s) + 1) :][:1] = []
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
        asked.append((i, "x", "".join(s)))
    got = nearest(spark.createDataFrame(asked, "id int, g string, name string"), spark.createDataFrame([("x", o) for o in options], "g string, option string"), ["g"], ["id"], "name", "option", d)
    want = {i: min((distance(s, o), o) for o in options) for i, _, s in asked}
    assert {r.id: (r.distance, r.option) for r in got.collect()} == {i: (float(a), o) for i, (a, o) in want.items() if a <= d}


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/graph")
    rows = [("a.py", "python", 1, 1.0, "h1", "parsed", None), ("b.py", "python", 1, 1.0, "h2", "parsed", None)]
    store.commit({"files": spark.createDataFrame(rows, TABLES["files"])}, {"x": "1"})
    first = store.current()
    given = [("a.py", "python", 2, 2.0, "h3", "parsed", None, "2024-01-01 00:00:00"), ("a.py", "python", 3, 3.0, "h4", "parsed", None, "2024-01-02 00:00:00"), ("b.py", "python", 0, 0.0, None, None, None, "2024-01-01 00:00:00")]
    changes = spark.createDataFrame(given, f"{TABLES['files']}, seen string").withColumn("seen", F.col("seen").cast("timestamp"))
    changes.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/in")
    query = ledger.follow(stream, store, f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [(r.path, r.content_hash) for r in store.read("files").collect()] == [("a.py", "h4")] and store.current() != first and store.meta()["x"] == "1"
    with pytest.raises(Exception, match="newer version"):
        store.commit({}, {})
        spark.createDataFrame([("schema", "99")], TABLES["meta"]).write.mode("overwrite").parquet(f"{tmp_path}/graph/{store.current()}/meta")
        Store(spark, store.path)
