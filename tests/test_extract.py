from grovelens.sources import extract as x


def brief(p):
    return [(s["kind"], s["name"], s["exported"], s["is_default"]) for s in p.symbols]


def test_python():
    p = x.parse_python('"""Doc. More."""\nimport os\nimport a.b as c\nfrom . import d\nfrom ..e import f as g, h\nMAX = 1\n_SECRET = 2\nlimit = 3\n@dec\ndef run(): pass\nclass _P: pass\n')
    assert brief(p) == [("variable", "MAX", True, False), ("variable", "_SECRET", False, False), ("function", "run", True, False), ("class", "_P", False, False)]
    assert [(i["specifier"], i["names"]) for i in p.imports] == [("os", []), ("a.b", []), (".", ["d"]), ("..e", ["f", "h"])]
    assert p.doc == "Doc. More."
    assert [s["exported"] for s in x.parse_python('__all__ = ["b"]\ndef a(): pass\ndef b(): pass\n').symbols] == [False, True]
    assert brief(x.parse_python("def ok(): pass\nthis is no python\nclass K:\n")) == [("function", "ok", True, False), ("class", "K", True, False)]


def test_javascript_declarations():
    assert brief(x.parse_js("const db = open();\nexport const VERSION = 2;\n")) == [("variable", "db", False, False), ("variable", "VERSION", True, False)]
    assert brief(x.parse_js("export const run = () => 1;\nexport interface A { b: string }\nexport type T = { a: 1 };\nexport enum E { X }\n")) == [("function", "run", True, False), ("interface", "A", True, False), ("type", "T", True, False), ("enum", "E", True, False)]
    assert brief(x.parse_js("export default function foo() { const inner = 1; }")) == [("function", "foo", True, True)]
    assert brief(x.parse_js("class Foo {}\nexport default Foo;")) == [("class", "Foo", True, True)]
    assert brief(x.parse_js("export { a, b, c };")) == [("export", n, True, False) for n in "abc"]
    p = x.parse_js("export * as ns from './x'")
    assert brief(p) == [("export", "ns", True, False)] and p.imports == [{"specifier": "./x", "names": []}]
    assert [s["name"] for s in x.parse_js("module.exports = { a };\nexports.c = 1;").symbols] == ["a", "c"]


def test_javascript_imports_and_noise():
    p = x.parse_js("/** Says hello. */\nimport D, { a as b, type C } from './m';\nimport * as n from 'n';\nimport 'side';\nconst { q, r: s } = require('z');\n// import x from 'no'\nconst t = `import y from 'no'`;\n")
    assert [(i["specifier"], i["names"]) for i in p.imports] == [("./m", ["default", "a", "C"]), ("n", []), ("side", []), ("z", ["q", "r"])]
    assert p.doc == "Says hello."
    assert "no" not in {i["specifier"] for i in p.imports}


def test_dart():
    p = x.parse_dart("/// A button.\nimport 'package:a/b.dart';\nabstract class Base {}\nclass _P {}\nenum Size { s }\ntypedef OnTap = void Function();\n")
    assert brief(p) == [("class", "Base", True, False), ("class", "_P", False, False), ("enum", "Size", True, False), ("type", "OnTap", True, False)]
    assert p.doc == "A button." and p.imports[0]["specifier"] == "package:a/b.dart"


def test_extract_over_a_frame(spark):
    rows = [("a.py", "python", "def f(): pass"), ("b.ts", "typescript", "export class K {}"), ("c.md", "markdown", "x"), ("d.py", "python", None)]
    got = {r.path: [s.name for s in r.symbols] for r in x.extract(spark.createDataFrame(rows, "path string, language string, text string")).collect()}
    assert got == {"a.py": ["f"], "b.ts": ["K"], "d.py": []}
