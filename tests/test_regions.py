import pytest

from grovelens.operators import regions as r

BASE = "# Title\n\nIntro\n"


def test_create_update_unchanged_and_crlf():
    text, out = r.reconcile(None, [("a", "one"), ("b", "two")], header="# H")
    assert text.startswith("# H\n\n<!-- grovelens:start:a sha=") and out == [("a", "added"), ("b", "added")]
    assert r.reconcile(text, [("a", "one"), ("b", "two")]) == (text, [("a", "unchanged"), ("b", "unchanged")])
    new, out = r.reconcile(text, [("a", "ONE"), ("b", "two")])
    assert out[0] == ("a", "updated") and "ONE" in new and "two" in new
    windows = text.replace("\n", "\r\n")
    assert r.reconcile(windows, [("a", "ONE"), ("b", "two")])[0] == new.replace("\n", "\r\n")


def test_add_then_remove_restores():
    text, _ = r.reconcile(BASE, [("a", "one"), ("c", "three")])
    assert text.startswith(BASE)
    grown, out = r.reconcile(text, [("a", "one"), ("b", "two"), ("c", "three")])
    assert ("b", "added") in out and grown.index("two") < grown.index("three")
    assert r.reconcile(grown, [("a", "one"), ("c", "three")], {"b"}) == (text, [("a", "unchanged"), ("b", "removed"), ("c", "unchanged")])


def test_hand_edits_are_kept_unless_forced():
    text, _ = r.reconcile(BASE, [("a", "one")])
    edited = text.replace("one", "mine")
    assert r.reconcile(edited, [("a", "two")]) == (edited, [("a", "conflict")])
    assert r.reconcile(edited, [], {"a"})[1] == [("a", "conflict")]
    assert "two" in r.reconcile(edited, [("a", "two")], force=True)[0]
    assert r.reconcile(text, []) == (text, [])  # neither wanted nor an orphan


@pytest.mark.parametrize("bad", ["<!-- grovelens:start:a -->\nx\n", "<!-- grovelens:end:a -->\n", "<!-- grovelens:start:a -->\n<!-- grovelens:start:b -->\n", "<!-- grovelens:start:a -->\n<!-- grovelens:end:b -->\n", "<!-- grovelens:start:a -->\n<!-- grovelens:end:a -->\n" * 2])
def test_malformed(bad):
    with pytest.raises(r.MarkerError):
        r.blocks(bad)


def test_fences_hide_markers():
    assert [b.id for b in r.blocks("```\n<!-- grovelens:start:a -->\n```\n")] == [None]


def test_frames(spark):
    text, _ = r.reconcile(BASE, [("a", "one")])
    docs = spark.createDataFrame([("x.md", text), ("bad.md", "<!-- grovelens:end -->"), ("new.md", None)], "path string, text string")
    got = {(x.path, x.id, x.error is not None) for x in r.parse(docs).collect()}
    assert got == {("x.md", "a", False), ("bad.md", None, True)}
    want = spark.createDataFrame([("x.md", 1, "a", "two"), ("bad.md", 1, "a", "one"), ("new.md", 1, "a", "one")], "path string, ord int, id string, content string")
    out = {x.path: ([(o.id, o.status) for o in x.outcomes], x.error is not None) for x in r.apply(docs, want).collect()}
    assert out == {"x.md": ([("a", "updated")], False), "bad.md": ([], True), "new.md": ([("a", "added")], False)}
