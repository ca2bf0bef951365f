"""What must not grow with a tree: tables that are broadcast, and how often documents are read."""

from grovelens.operators import drift
from grovelens.plans import catalogue
from grovelens.sources import facts


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_broken_references_plan(spark):
    found = plan(catalogue.QUERIES["broken_references"](spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in found and found.count("MapInPandas") == 1


def test_module_forms(spark):
    """A path is satisfied by a module's extension or index at the end of any path; a strict one, or one that leaves its folder, is not."""
    files = spark.createDataFrame([("a/src/m.ts",), ("a/src/n/index.py",), ("top.js",), ("a/x.tests.md",), ("b/x.tests.md",), ("c/y.md",), ("tests/y.md",)], "path string")
    said = ["src/m", "src/n", "n", "./m", "src/m.js", "../top", "../a/src/m", "src/index", "src/n/index", "gone/x.tests.md", "gone/y.md", "prose/words", "src/words", "src/"]
    refs = spark.createDataFrame([("docs/d.md", 1, "path", t, None, None, None, k) for k, t in enumerate(said)] + [("a/src/e.md", 1, "link", t, None, None, None, k) for k, t in enumerate(["m", "m.ts", "n", "../../top.js"])], drift.REF_SCHEMA)
    found = {(r.file, r.reference, r.suggestion) for r in drift.missing_paths(refs, files).collect()}
    d = "docs/d.md"
    assert found == {(d, "./m", None), (d, "src/m.js", None), (d, "src/index", None), (d, "gone/x.tests.md", None), (d, "gone/y.md", "c/y.md"), (d, "src/words", None), ("a/src/e.md", "m", None)}


def test_facts_of_many_roots(spark):
    """Roots share a worker call, whatever their number; each has its own facts, and one whose files give none has no rows."""
    assert "FlatMapGroupsInPandas" not in plan(catalogue.QUERIES["manifest_facts"](spark, "/root/testdata/sf0.001"))
    rows = [(f"p{k}", n, t) for k in range(3_000) for n, t in (("go.mod", "module x"), ("Makefile", f"t{k}: x\n"), ("other", None))] + [(".", "package.json", "{}"), ("none", "other", "x"), (None, "go.mod", "")]
    frame = spark.createDataFrame(rows, "root string, name string, text string")
    found = sorted((r.root or "", r.ord, r.fact, r.label) for r in facts.facts(frame, "own").collect())
    each = [(f"p{k}", o, *x) for k in range(3_000) for o, x in enumerate((("stack", "Go modules"), ("command", f"make t{k}")))]
    none = [("", 0, "stack", "Go modules"), ("", 1, "command", "go build ./..."), ("", 2, "command", "go test ./...")]
    assert found == sorted([*each, *none, (".", 0, "name", "own"), (".", 1, "stack", "Node.js"), (".", 2, "stack", "npm")])
    assert facts.facts(frame.limit(0)).collect() == []


def test_missing_scripts_plan(spark):
    found = plan(catalogue.QUERIES["missing_scripts"](spark, "/root/testdata/sf0.001"))
    # the only table that is broadcast has one row
    assert found.count("BroadcastExchange") <= 1 and "BroadcastHashJoin" not in found and found.count("MapInPandas") == 1


def test_homes_of_commands(spark):
    """The nearest manifest above a document, the folder of a `cd` and no other, the top, and none."""
    files = spark.createDataFrame([("package.json",), ("a/b/c.md",), ("a/package.json",), ("a/server.js",), ("m/Makefile",), ("m/n/d.md",), ("e/f.md",)], "path string")
    scripts = spark.createDataFrame([(".", "package", "build"), ("a", "package", "lint"), ("m", "make", "all")] + [("a", "package", f"long{k}") for k in range(40)], "dir string, kind string, name string")
    said = [("a/b/c.md", "npm", "lnit", None), ("a/b/c.md", "npm", "start", None), ("a/b/c.md", "npm", "long7x", None), ("a/b/c.md", "npm", "build", "../.."), ("a/b/c.md", "npm", "biuld", "../.."), ("a/b/c.md", "npm", "x", "gone"), ("e/f.md", "npm", "biuld", None), ("m/n/d.md", "make", "al", None), ("e/f.md", "make", "all", None), ("e/f.md", "npm", "build", "../e"), ("top.md", "npm", "bild", None), ("top.md", "make", "bild", "a")]
    refs = spark.createDataFrame([(f, k, "command", s, t, s, c, k) for k, (f, t, s, c) in enumerate(said)], drift.REF_SCHEMA)
    found = {(r.line, r.message, r.suggestion) for r in drift.missing_scripts(refs, scripts, files).collect()}
    assert found == {
        (0, "`lnit` is not a script in a/package.json", "lint"),
        (2, "`long7x` is not a script in a/package.json", "long7"),
        (4, "`biuld` is not a script in package.json", "build"),
        (6, "`biuld` is not a script in package.json", "build"),
        (7, "Makefile has no `al` target", "all"),
        (8, "there is no Makefile in this project for this command", None),
        (9, "there is no package.json in `e` for this command", None),
        (10, "`bild` is not a script in package.json", "build"),
        (11, "there is no Makefile in `a` for this command", None),
    }
