"""Marked regions of Markdown files: parsing, and reconciling them with the wanted contents without touching other text.

A region is a pair of comment lines, `<!-- grovelens:start:ID sha=HASH -->` and `<!-- grovelens:end:ID -->`; HASH is the
hash of what was written, so a region whose text has another one was edited by hand. Markers within code fences are text.
Malformed documents are rows with `error` set, never exceptions: they are left as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOOL = "grovelens"
_START = re.compile(rf"^\s*<!-- {TOOL}:start:(.+?)(?: sha=([0-9a-f]{{6,64}}))? -->\s*$")
_END = re.compile(rf"^\s*<!-- {TOOL}:end(?::(.+?))? -->\s*$")
_FENCE = re.compile(r"^\s*(?:```|~~~)")

REGION_SCHEMA = "path string, id string, sha string, content string, start_line int, end_line int, edited boolean, error string"
RESULT_SCHEMA = "path string, before string, text string, changed boolean, action string, outcomes array<struct<id:string,status:string,note:string>>, error string"
#: Why a region was left or rewritten.
EDITED = "edited by hand since it was last written — left as is (move your edits outside the markers, or rerun with --force)"
GONE = f"describes something that no longer exists, but was {EDITED}"
UPGRADED = "marker format upgraded"


def content_hash(content: str) -> str:
    return hashlib.sha256(content.encode()).hexdigest()[:12]


def render(region_id: str, content: str) -> list[str]:
    return [f"<!-- {TOOL}:start:{region_id} sha={content_hash(content)} -->", *content.split("\n"), f"<!-- {TOOL}:end:{region_id} -->"]


@dataclass
class Block:
    """A run of lines: a region if it has an id, else free text."""

    lines: list[str]
    id: str | None = None
    sha: str | None = None
    old_format: bool = False
    first: int = 0

    @property
    def content(self) -> str:
        return "\n".join(self.lines[1:-1])

    @property
    def edited(self) -> bool:
        return self.sha is not None and self.sha != content_hash(self.content)


class MarkerError(ValueError):
    pass


def blocks(text: str) -> list[Block]:
    """text (LF line ends) as alternating free text and regions; MarkerError for nested, repeated, unmatched or unclosed markers."""
    out, fenced, seen = [Block([])], False, set()
    for number, line in enumerate(text.split("\n")):
        here = out[-1]
        inside = here.id is not None
        start, end = (None, None) if fenced else (_START.match(line), _END.match(line))
        if _FENCE.match(line) and not inside:
            fenced = not fenced
        if start:
            if inside:
                raise MarkerError(f"line {number + 1}: {start[1]} starts inside {here.id}")
            if start[1] in seen:
                raise MarkerError(f"line {number + 1}: {start[1]} appears twice")
            seen.add(start[1])
            out.append(Block([line], start[1], start[2], start[2] is None, number))
        elif end:
            if not inside:
                raise MarkerError(f"line {number + 1}: an end without a start")
            if end[1] not in (None, here.id):
                raise MarkerError(f"line {number + 1}: the end of {end[1]} closes {here.id}")
            here.lines.append(line)
            here.old_format |= end[1] is None
            out.append(Block([], first=number + 1))
        else:
            here.lines.append(line)
    if out[-1].id is not None:
        raise MarkerError(f"line {out[-1].first + 1}: {out[-1].id} has no end")
    return [b for b in out if b.lines]


def _blank(block: Block | None, at: int) -> bool:
    return block is not None and block.id is None and bool(block.lines) and not block.lines[at].strip()


def _drop(doc: list[Block], block: Block) -> list[Block]:
    """doc without a region and one blank line beside it, so that adding and removing leave no blanks behind."""
    at = doc.index(block)
    before, after = doc[at - 1] if at else None, doc[at + 1] if at + 1 < len(doc) else None
    if _blank(after, 0) and (before is None or _blank(before, -1)):
        after.lines.pop(0)
    elif after is None and _blank(before, -1):
        before.lines.pop()
    return [b for b in doc if b is not block and b.lines]


def _put(doc: list[Block], new: Block, order: list[str]) -> list[Block]:
    """doc with a region after the nearest of `order` before it that is there, else before the nearest after it, else at the end."""
    place = {b.id: n for n, b in enumerate(doc) if b.id is not None}
    k = order.index(new.id)
    earlier = next((place[i] for i in reversed(order[:k]) if i in place), None)
    later = next((place[i] for i in order[k + 1 :] if i in place), None)
    if earlier is not None:
        return [*doc[: earlier + 1], Block([""]), new, *doc[earlier + 1 :]]
    if later is not None:
        return [*doc[:later], new, Block([""]), *doc[later:]]
    if doc and doc[-1].id is None:
        while doc[-1].lines and not doc[-1].lines[-1].strip():
            doc[-1].lines.pop()
        doc = doc if doc[-1].lines else doc[:-1]
    return [*doc, *([Block([""])] if doc else []), new, Block([""])]


def reconcile(existing: str | None, desired: list[tuple[str, str]], orphans: set[str] = frozenset(), force: bool = False, header: str = "") -> tuple[str | None, list[tuple[str, str]]]:
    """explained() without the notes."""
    text, outcomes = explained(existing, desired, orphans, force, header)
    return text, [(i, status) for i, status, _ in outcomes]


def explained(existing: str | None, desired: list[tuple[str, str]], orphans: set[str] = frozenset(), force: bool = False, header: str = "") -> tuple[str | None, list[tuple[str, str, str | None]]]:
    """The new text and (id, status, note) for each region that is wanted or an orphan: unchanged, updated, added, removed or conflict.

    desired: (id, content) in order. Regions that are neither wanted nor orphans stay, and so does the order of those there. A
    region edited by hand is a conflict unless force. Without a file and regions there is no text (null); the header opens a new
    file only. Line ends follow the majority of the file.
    """
    if existing is None:
        parts = ([header] if header else []) + ["\n".join(render(i, c)) for i, c in desired]
        return ("\n\n".join(parts) + "\n" if desired else None), [(i, "added", None) for i, _ in desired]
    crlf = existing.count("\r\n")
    windows = crlf > 0 and 2 * crlf >= existing.count("\n")
    doc, wanted, done = blocks(existing.replace("\r\n", "\n")), dict(desired), {}
    for block in [b for b in doc if b.id in wanted or b.id in orphans]:
        content = wanted.get(block.id)
        if content == block.content and not block.old_format:
            done[block.id] = ("unchanged", None)
        elif block.edited and not force:
            done[block.id] = ("conflict", EDITED if block.id in wanted else GONE)
        elif content is None:
            doc, done[block.id] = _drop(doc, block), ("removed", None)
        else:
            done[block.id] = ("updated", UPGRADED if content == block.content else None)
            block.lines = render(block.id, content)
    order = [i for i, _ in desired]
    for region_id in order:
        if region_id not in done:
            doc = _put(doc, Block(render(region_id, wanted[region_id]), region_id), order)
            done[region_id] = ("added", None)
    text = "\n".join(line for b in doc for line in b.lines)
    text = text if text.endswith("\n") else text + "\n"
    return text.replace("\n", "\r\n") if windows else text, [(i, *d) for i, d in sorted(done.items())]


def only_boilerplate(text: str, header: str | None) -> bool:
    """Nothing but what the tool wrote when it made the file is left."""
    rest = text.replace("\r\n", "\n")
    return not (rest.replace(header, "", 1) if header else rest).strip()


def parse(docs: DataFrame) -> DataFrame:
    """One row for each region of docs (path, text), or one with `error` for a malformed document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    for b in blocks((text or "").replace("\r\n", "\n")):
                        if b.id is not None:
                            rows.append((path, b.id, b.sha, b.content, b.first + 1, b.first + len(b.lines), b.edited, None))
                except MarkerError as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["path", "id", "sha", "content", "start_line", "end_line", "edited", "error"])
            yield out.astype({"start_line": "Int32", "end_line": "Int32", "edited": "boolean"})

    return docs.select("path", "text").mapInPandas(run, REGION_SCHEMA)


def apply(docs: DataFrame, desired: DataFrame, force: bool = False) -> DataFrame:
    """RESULT_SCHEMA for docs (path, text: null for a new file) and desired (path, ord, id, content: null for an orphan).

    docs may have `header` (opens a new file) and `delete_when_empty`; action is create, update, delete, unchanged or error, and
    text is what is to be written, else what is there.
    """
    extra = [c for c in ("header", "delete_when_empty") if c in docs.columns]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        text = left["text"].iloc[0] if len(left) else None
        text = text if isinstance(text, str) else None
        header = left["header"].iloc[0] if "header" in extra and len(left) else None
        header = header if isinstance(header, str) else ""
        rows = right.sort_values("ord")
        want = [(i, c) for i, c in zip(rows["id"], rows["content"], strict=True) if isinstance(c, str)]
        gone = {i for i, c in zip(rows["id"], rows["content"], strict=True) if not isinstance(c, str)}
        try:
            new, outcomes = explained(text, want, gone, force, header)
            action = "unchanged" if new == text else "create" if text is None else "update"
            if "delete_when_empty" in extra and len(left) and bool(left["delete_when_empty"].iloc[0]) and text is not None and only_boilerplate(new, header):
                action = "delete"
            made = (key[0], text, new, action != "unchanged", action, [{"id": i, "status": s, "note": n} for i, s, n in outcomes], None)
        except MarkerError as e:
            made = (key[0], text, text, False, "error", [], f"{key[0]}: {e}")
        return pd.DataFrame([made], columns=["path", "before", "text", "changed", "action", "outcomes", "error"])

    return docs.select("path", "text", *extra).groupBy("path").cogroup(desired.select("path", "ord", "id", "content").groupBy("path")).applyInPandas(run, RESULT_SCHEMA)


def summary(results: DataFrame) -> DataFrame:
    """(path, action, updated, added, removed, conflicts): ids of each status, joined."""
    ids = lambda status: F.array_join(F.transform(F.filter("outcomes", lambda o: o["status"] == status), lambda o: o["id"]), ", ")
    return results.select("path", "action", ids("updated").alias("updated"), ids("added").alias("added"), ids("removed").alias("removed"), ids("conflict").alias("conflicts"))


def roll_back(head: DataFrame, current: DataFrame) -> DataFrame:
    """(path, action, text, outcomes, kept, reason) that puts every region back to its content at the last commit.

    head, current: (path, text), null or missing where there is no file. Text outside regions and regions that the commit lacks
    (`kept`) stay; a file deleted since is restored whole; one that was never committed is skipped.
    """
    given = head.select("path", F.col("text").alias("old")).join(current.select("path", F.col("text").alias("now")), "path", "full_outer")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, old, now in zip(frame["path"], frame["old"], frame["now"], strict=True):
                if not isinstance(old, str):
                    rows.append((path, "skipped", None, [], [], "not in HEAD (never committed) — nothing to roll back to"))
                elif not isinstance(now, str):
                    rows.append((path, "restore", old, [], [], "file was deleted since HEAD — restored whole"))
                else:
                    try:
                        wanted = [(b.id, b.content) for b in blocks(old.replace("\r\n", "\n")) if b.id is not None]
                        kept = [b.id for b in blocks(now.replace("\r\n", "\n")) if b.id is not None and b.id not in dict(wanted)]
                        new, outcomes = explained(now, wanted, force=True)
                        rows.append((path, "restore" if new != now else "unchanged", new if new != now else None, [{"id": i, "status": s, "note": n} for i, s, n in outcomes], kept, None))
                    except MarkerError as e:
                        rows.append((path, "error", None, [], [], f"{path}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "action", "text", "outcomes", "kept", "reason"])

    return given.mapInPandas(run, "path string, action string, text string, outcomes array<struct<id:string,status:string,note:string>>, kept array<string>, reason string")
