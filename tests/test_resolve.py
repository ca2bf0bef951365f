import pytest
from pyspark.sql import functions as F

from grovelens.operators import graph, resolve
from grovelens.sources import extract


@pytest.fixture(scope="module")
def tree(spark):
    texts = {
        "src/agent/__init__.py": ("python", "from .llm import LlmClient\n"),
        "src/agent/llm.py": ("python", "from . import prompts\nclass LlmClient: pass\ndef _retry(): pass\n"),
        "src/agent/prompts.py": ("python", "import os\nSYSTEM = 'x'\n"),
        "src/api/server.py": ("python", "from agent.llm import LlmClient\nfrom agent import prompts, nothing\n"),
        "tests/test_llm.py": ("python", "from agent.llm import LlmClient\n"),
        "web/src/App.tsx": ("typescript", "import Button, { size } from './ui/Button.js';\nimport { fmt } from '@/lib/fmt';\nimport React from 'react';\n"),
        "web/src/ui/Button.tsx": ("typescript", "export const size = 1;\nexport default function Button() {}\n"),
        "web/src/lib/fmt/index.ts": ("typescript", "export const fmt = () => 1;\n"),
        "lib/main.dart": ("dart", "import 'package:app/w/x.dart';\nimport 'w/y.dart';\nimport 'dart:io';\n"),
        "lib/w/x.dart": ("dart", "class X {}\n"),
        "lib/w/y.dart": ("dart", "class Y {}\n"),
    }
    files = spark.createDataFrame([(p, lang, t) for p, (lang, t) in texts.items()], "path string, language string, text string")
    parsed = extract.extract(files).cache()
    imports = parsed.select(F.col("path").alias("file_path"), F.posexplode("imports").alias("ordinal", "i")).select("file_path", "ordinal", "i.specifier", "i.names")
    symbols = parsed.select(F.col("path").alias("file_path"), F.posexplode("symbols").alias("ordinal", "s")).select("file_path", "ordinal", "s.name", "s.exported", "s.is_default")
    return files, symbols, resolve.resolve(imports, files, [("@/", "web/src/"), ("@", "nowhere/")], "app").cache()


def test_resolution(tree):
    got = {(r.from_path, r.to_path) for r in tree[2].collect()}
    assert got == {
        ("src/agent/__init__.py", "src/agent/llm.py"),
        ("src/agent/llm.py", "src/agent/prompts.py"),
        ("src/api/server.py", "src/agent/llm.py"),
        ("src/api/server.py", "src/agent/__init__.py"),
        ("src/api/server.py", "src/agent/prompts.py"),
        ("tests/test_llm.py", "src/agent/llm.py"),
        ("web/src/App.tsx", "web/src/ui/Button.tsx"),
        ("web/src/App.tsx", "web/src/lib/fmt/index.ts"),
        ("lib/main.dart", "lib/w/x.dart"),
        ("lib/main.dart", "lib/w/y.dart"),
    }


def test_module_table_and_reference_counts(tree):
    files, symbols, resolved = tree
    dim = files.select("path", resolve.module_of(F.col("path"), roots=["web"]).alias("module"), resolve.is_test(F.col("path")).alias("is_test"))
    edges = graph.file_edges(resolved, "from_path", "to_path")
    got = {(r.from_module, r.to_module): r.weight for r in graph.module_edges(edges, dim, dim).collect()}
    assert got == {("src/api", "src/agent"): 3, ("web/src", "web/src/ui"): 1, ("web/src", "web/src/lib"): 1, ("lib", "lib/w"): 2} or got == {("src/api", "src/agent"): 3, ("web/src", "web/src/ui"): 1, ("web/src", "web/src/lib/fmt"): 1, ("lib", "lib/w"): 2}
    counts = {r.name: r.ref_count for r in resolve.reference_counts(resolved, symbols, files).collect()}
    assert counts["LlmClient"] == 2 and counts["Button"] == 1 and counts["size"] == 1 and counts["_retry"] == 0


@pytest.mark.parametrize("path,module", [("index.ts", "."), ("src/index.ts", "src"), ("src/api/routes/user.ts", "src/api"), ("packages/web/src/App.tsx", "packages/web"), ("src/features/cart/ui/Cart.tsx", "src/features/cart"), ("app/a/b.py", "app")])
def test_modules(spark, path, module):
    assert spark.range(1).select(resolve.module_of(F.lit(path)).alias("m")).first().m == module


def test_test_paths(spark):
    cases = {"tests/a.py": True, "src/a.test.ts": True, "src/test_a.py": True, "a_test.go": True, "src/testing.py": False, "src/contest/a.ts": False, "test.py": False}
    df = spark.createDataFrame(list(cases.items()), "p string, want boolean")
    assert df.filter(resolve.is_test(F.col("p")) != F.col("want")).count() == 0
