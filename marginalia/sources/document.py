"""The four comment parts of a word-processor document, as plain rows.

Only bytes become rows here; whatever relates rows to each other is left to the
DataFrames of ``marginalia.operators``."""

from __future__ import annotations

import re

from . import container, markup

COMMENTS, EXTENDED, IDS, BODY = "word/comments.xml", "word/commentsExtended.xml", "word/commentsIds.xml", "word/document.xml"
PARTS = (COMMENTS, EXTENDED, IDS, BODY)
ANCHOR_BYTES, SNIPPET_BYTES = 240, 120
_INT = re.compile(rb"[ \t\n\v\f\r]*([+-]?[0-9]+)")


class FormatError(Exception):
    """The container is readable, its comments part is not."""


class _Node:
    __slots__ = ("children", "found", "name", "text")

    def __init__(self, name: bytes, found: list):
        self.name, self.found, self.children, self.text = name, found, [], []

    def attr(self, name: bytes) -> bytes:
        return next((v for k, v in self.found if k == name), b"")

    def named(self, name: bytes) -> list[_Node]:
        return [c for c in self.children if c.name == name]


def number(raw: bytes) -> int | None:
    """A 32-bit integer at the start of ``raw``, blanks before and anything after."""
    m = _INT.match(raw)
    return v if m and -(1 << 31) <= (v := int(m.group(1))) < 1 << 31 else None


def _str(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _tree(data: bytes) -> _Node | None:
    top = _Node(b"", [])
    stack = [top]
    for what, value, found in markup.events(data):
        if what == "text":
            stack[-1].text.append(value)
        elif what == "start":
            node = _Node(value, found)
            stack[-1].children.append(node)
            stack.append(node)
        elif len(stack) > 1:
            stack.pop()
    return top.children[0] if top.children else None


def _all_text(node: _Node) -> bytes:
    """A node's own text, then that of its children."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        out += n.text
        todo += reversed(n.children)
    return b"".join(out)


def _run_text(node: _Node) -> bytes:
    """Text of all outermost t elements below ``node``."""
    out, todo = [], list(reversed(node.children))
    while todo:
        n = todo.pop()
        if n.name == b"t":
            out.append(_all_text(n))
        else:
            todo += reversed(n.children)
    return b"".join(out)


def _style(comment: _Node) -> bytes:
    styles = (s for p in comment.named(b"p") for pr in p.named(b"pPr") for s in pr.named(b"pStyle"))
    first = next(styles, None)
    return first.attr(b"val") if first else b""


def comments(data: bytes) -> list[dict]:
    root = _tree(data)
    if root is None:
        raise FormatError("Failed to parse word/comments.xml")
    rows = []
    for c in root.named(b"comment"):
        ident = number(c.attr(b"id"))
        if ident is None:
            continue
        first = next(iter(c.named(b"p")), None)
        row = {"ordinal": len(rows), "id": ident, "text": _str(_run_text(c)), "paragraph_style": _str(_style(c)), "para_id": _str(first.attr(b"paraId")) if first else ""}
        rows.append(row | {k: _str(c.attr(k.encode())) for k in ("author", "date", "initials")})
    return rows


def extended(data: bytes) -> list[dict]:
    """Entries with a paragraph id; of repeated attributes the last counts."""
    rows = []
    for what, name, found in markup.events(data):
        if what == "start" and name == b"commentEx" and (a := dict(found)).get(b"paraId"):
            rows.append({"ordinal": len(rows), "para_id": _str(a[b"paraId"]), "para_id_parent": _str(a.get(b"paraIdParent", b"")), "done": a.get(b"done") == b"1"})
    return rows


def idents(data: bytes) -> list[dict]:
    rows = []
    for what, name, found in markup.events(data):
        if what == "start" and name == b"commentId":
            a = dict(found)
            ident = number(a.get(b"id", b""))
            if ident is not None and a.get(b"paraId"):
                rows.append({"ordinal": len(rows), "id": ident, "para_id": _str(a[b"paraId"])})
    return rows


def anchors(data: bytes) -> list[dict]:
    """The text under each comment range that was closed; a run's text goes, at
    its end, to all ranges open then."""
    inside, run, open_, done = False, [], {}, {}
    for what, value, found in markup.events(data):
        if what == "text":
            if inside:
                run.append(value)
        elif value == b"r":
            if what == "end":
                for texts in open_.values():
                    texts += run
            inside, run = what == "start", []
        elif what == "start" and value in (b"commentRangeStart", b"commentRangeEnd"):
            ident = number(next((v for k, v in found if k == b"id"), b""))
            if ident is None:
                continue
            if value == b"commentRangeStart":
                open_[ident] = []
            elif ident in open_:
                done[ident] = b"".join(open_.pop(ident))
    return [{"id": k, "anchor_text": _str(v)} for k, v in done.items()]


def truncate(text: str, most: int) -> str:
    """As many whole characters as ``most`` bytes of UTF-8 hold, and an ellipsis if any are left."""
    if len(text) * 4 <= most or len(raw := text.encode("utf-8", "surrogatepass")) <= most:
        return text
    return raw[:most].decode("utf-8", "ignore") + "…"


def closure(root: int, below: dict[int, list[int]], unique: bool) -> list[int]:
    """Ids below ``root``, level by level.  Where ids aren't ``unique`` in the file,
    none is entered again below itself, so that none makes it endless."""
    chain, above = [root], [-1]
    for head, ident in enumerate(chain):  # the chain grows while it is walked
        for child in below.get(ident, ()):
            at = -1 if unique else head
            while at >= 0 and chain[at] != child:
                at = above[at]
            if at < 0:
                chain.append(child)
                above.append(head)
    return chain


def resolve(file: dict) -> list[dict]:
    """The comments of a decoded file with all their fields: what the other parts
    say of them, parents, direct replies, and for roots the whole thread.  Every
    lookup by an id or a paragraph id finds the last comment that has it."""
    out = [{**r, "referenced_text": "", "is_reply": False, "parent_id": -1, "replies": [], "para_id_parent": "", "done": False, "thread_ids": [], "thread_ordinals": []} for r in file["comments"]]
    by_para = {r["para_id"]: r for r in out if r["para_id"]}
    for e in file["comments_ex"]:
        if r := by_para.get(e["para_id"]):
            r["para_id_parent"], r["done"] = e["para_id_parent"], e["done"]
    # ids that a later part supplies come too late for the entries above, but make parents
    waiting: dict[int, list[dict]] = {}
    for r in reversed(out):
        if not r["para_id"]:
            waiting.setdefault(r["id"], []).append(r)
    for i in file["comment_ids"]:
        if free := waiting.get(i["id"]):
            free.pop()["para_id"] = i["para_id"]
    by_para, by_id = {r["para_id"]: r for r in out if r["para_id"]}, {r["id"]: r for r in out}
    for r in out:
        if parent := by_para.get(r["para_id_parent"]):
            r["is_reply"], r["parent_id"] = True, parent["id"]
    below: dict[int, list[int]] = {}
    for r in out:
        if r["is_reply"] and r["parent_id"] >= 0:
            below.setdefault(r["parent_id"], []).append(r["id"])
            by_id[r["parent_id"]]["replies"].append({"id": r["id"], "author": r["author"], "date": r["date"], "text_snippet": truncate(r["text"], SNIPPET_BYTES)})
    for r in out:
        if not r["is_reply"]:
            r["thread_ids"] = closure(r["id"], below, len(by_id) == len(out))
            r["thread_ordinals"] = [by_id[i]["ordinal"] for i in r["thread_ids"]]
    for a in file["anchors"]:
        if r := by_id.get(a["id"]):
            r["referenced_text"] = truncate(a["anchor_text"], ANCHOR_BYTES)
    return out


def rows(path: str, data: bytes | None, parts: tuple[str, ...] = PARTS) -> dict:
    """One file's rows, or its error; ``data`` None stands for a file that can't
    be opened."""
    out = {"file_path": path, "error_kind": None, "message": None, "comments": [], "comments_ex": [], "comment_ids": [], "anchors": [], "entries": []}
    try:
        entries = container.opened(path, data)
        out["entries"] = [{"ordinal": i, "name": e.name, "method": e.method, "compressed_size": e.compressed_size, "size": e.size, "crc32": e.crc32} for i, e in enumerate(entries)]
        by_name = {e.name: e for e in entries}
    except container.ContainerError as e:
        return out | {"error_kind": "file", "message": str(e)}
    try:
        for name, key, parse in ((COMMENTS, "comments", comments), (EXTENDED, "comments_ex", extended), (IDS, "comment_ids", idents), (BODY, "anchors", anchors)):
            if name in parts and name in by_name:
                out[key] = parse(container.content(data, by_name[name]))
            if key == "comments" and not out[key]:
                break
    except FormatError as e:
        return {**out, "error_kind": "format", "message": str(e)} | {k: [] for k in ("comments", "comments_ex", "comment_ids", "anchors")}
    except container.ContainerError as e:
        return {**out, "error_kind": "container", "message": str(e)} | {k: [] for k in ("comments", "comments_ex", "comment_ids", "anchors")}
    return out
