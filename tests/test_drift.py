from grovelens.operators import drift as d

DOC = """Run `npm run tset` or `make build`.
See `src/app.ts:12`, [guide](docs/guide.md#top), `gone/x.py` and `getUser()`, `v1.2`, `some prose`.
```sh
cd web && pnpm lint
yarn add left-pad
```
```js
npm run never
```
<!-- grovelens-ignore: example -->
`not/checked.ts`
<!-- grovelens-ignore-start -->
`nor/this.ts`
<!-- grovelens-ignore-end -->
`missingName()`
"""


def test_references():
    rows = [(r[1], r[2], r[3], r[5], r[6]) for r in d.references("README.md", DOC)]
    assert rows == [
        (1, "command", "npm run tset", "tset", None),
        (1, "command", "make build", "build", None),
        (2, "link", "docs/guide.md", None, None),
        (2, "path", "src/app.ts", None, None),
        (2, "path", "gone/x.py", None, None),
        (2, "symbol", "getUser", None, None),
        (4, "command", "pnpm lint", "lint", "web"),
        (15, "symbol", "missingName", None, None),
    ]


def test_findings(spark):
    docs = spark.createDataFrame([("README.md", DOC)], "path string, text string")
    refs = d.extract_references(docs).cache()
    files = spark.createDataFrame([("src/app.ts",), ("docs/guide.md",), ("new/x.py",), ("package.json",)], "path string")
    assert [(r.reference, r.suggestion) for r in d.missing_paths(refs, files).collect()] == [("gone/x.py", "new/x.py")]
    scripts = spark.createDataFrame([(".", "package", "test"), (".", "make", "build"), ("web", "package", "lint")], "dir string, kind string, name string")
    assert [(r.line, r.reference, r.suggestion) for r in d.missing_scripts(refs, scripts).collect()] == [(1, "npm run tset", "test")]
    tokens = spark.createDataFrame([("getUser",)], "name string")
    assert [r.reference for r in d.missing_symbols(refs, tokens).collect()] == ["missingName"]
    refs.unpersist()


def test_paths(spark):
    from pyspark.sql import functions as F

    from grovelens.functions import paths as p

    cases = {"a/./b/../c": "a/c", "../a": "../a", "a/..": ".", "": ".", "/a/../../b": "/b", "a//b/": "a/b", "../../a/..": "../.."}
    df = spark.createDataFrame(list(cases.items()), "x string, want string")
    assert df.select(p.normalize(F.col("x")).alias("got"), "want").filter("got <> want").count() == 0
    row = spark.range(1).select(p.ancestors(F.lit("a/b/c.py")).alias("a"), p.suffixes(F.lit("a/b/c.py")).alias("s")).first()
    assert [(x.dir, x.depth) for x in row.a] == [(".", 0), ("a", 1), ("a/b", 2)] and row.s == ["a/b/c.py", "b/c.py", "c.py"]
