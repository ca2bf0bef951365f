import json

from grovelens.sources import facts as f


def labels(files, fact):
    return [x[1] for x in f.project_facts(files) if x[0] == fact]


def test_node():
    manifest = {"scripts": {"build": "x", "prebuild": "y", "test": "t", "prepare": "p", "postinstall": "q", "dev": "d"}, "dependencies": {"next": "1", "react": "1"}, "devDependencies": {"vitest": "1", "@playwright/test": "1"}}
    files = {"package.json": json.dumps(manifest), "pnpm-lock.yaml": ""}
    assert labels(files, "stack") == ["Node.js", "pnpm", "Next.js", "React", "Vitest", "Playwright"]
    assert labels(files, "command") == ["pnpm build", "pnpm test", "pnpm dev"]
    assert f.project_facts({"package.json": "no json"}) == []


def test_python_and_make():
    files = {"pyproject.toml": '[project]\ndependencies = ["fastapi[all]>=1", "langchain-core"] # flask\n[project.scripts]\nserve = "app:main"\n[tool.x]\ny = "z"\n', "Makefile": ".PHONY: test\ntest:\n\tpytest\nlint: test\nX := 1\n"}
    assert labels(files, "stack") == ["Python", "FastAPI"]
    assert labels(files, "command") == ["make test", "make lint"]
    assert [x[1:3] for x in f.project_facts(files) if x[0] == "entry"] == [("serve", "pyproject.toml [project.scripts]")] and [x[3] for x in f.project_facts(files) if x[0] == "entry"] == ["app:main"]


def test_toolchain_only_without_commands():
    assert labels({"go.mod": ""}, "command") == ["go build ./...", "go test ./..."]
    assert labels({"pubspec.yaml": "dependencies:\n  flutter:\n    sdk: flutter\ndev_dependencies:\n  flutter_test:\n    sdk: flutter\n"}, "command") == ["flutter pub get", "flutter test", "flutter run"]
    assert labels({"pyproject.toml": '[project]\nname = "x"\ndependencies = ["pytest"]\n', "uv.lock": ""}, "command") == ["uv run pytest"]


def test_frames(spark):
    files = spark.createDataFrame([("package.json",), ("web/package.json",), ("web/api/go.mod",), ("tests/x/package.json",)], "path string")
    assert [r.root for r in f.project_roots(files).collect()] == ["web", "web/api"]
    rows = spark.createDataFrame([("web", "package.json", '{"scripts": {"start": "s"}}'), ("api", "go.mod", None)], "root string, name string, text string")
    got = [(r.root, r.fact, r.label) for r in f.facts(rows).orderBy("root", "ord").collect()]
    assert got == [("api", "stack", "Go modules"), ("api", "command", "go build ./..."), ("api", "command", "go test ./..."), ("web", "stack", "Node.js"), ("web", "stack", "npm"), ("web", "command", "npm start")]
