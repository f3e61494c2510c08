"""YAML frontmatter of entity pages, parsed and rendered in Arrow batches."""

from __future__ import annotations

import datetime
import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle

from quillstone.functions import linediff

_FENCE = re.compile(r"\A---[ \t]*\r?\n(.*?)(?:\r?\n)?^---[ \t]*(?:\r?\n|\Z)", re.S | re.M)


#: The key that holds a block which is no YAML, as it was: it is written back as it is.
RAW = "_block"


def split(text: str) -> tuple[str, str]:
    """(frontmatter, body); a text that doesn't begin with a fenced block is all body."""
    m = _FENCE.match(text)
    return (m[1], text[m.end() :]) if m else ("", text)


def _plain(value: str):
    value = value.strip()
    if value in ("", "null", "~"):
        return None
    if value[0] == "[" and value[-1] == "]":
        return [x for x in (_plain(v) for v in value[1:-1].split(",")) if x is not None]
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def load(block: str) -> dict:
    """The block's keys; by PyYAML where that is installed, else the subset of scalars and lists of scalars."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml:
        try:
            found = yaml.load(block, Loader=getattr(yaml, "CBaseLoader", yaml.BaseLoader))  # all scalars stay text
        except yaml.YAMLError:
            return {"_error": "invalid frontmatter", RAW: block}
        return found if isinstance(found, dict) else {}
    out: dict = {}
    key = None
    for line in block.split("\n"):
        if m := re.match(r"\s*-\s+(.*)", line):
            if key is not None:
                out[key] = [*(out[key] if isinstance(out[key], list) else []), _plain(m[1])]
        elif m := re.match(r"([^\s#][^:]*):(.*)", line):
            key = m[1].strip()
            out[key] = _plain(m[2])
    return out


def texts(value) -> list[str] | None:
    """A key's value as a list of texts; null and empty ones are null."""
    if value in (None, "", "null", "~", []):
        return None
    return [str(v) for v in value if v not in (None, "", "null", "~")] if isinstance(value, list) else [str(value)]


def day(value) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(str(value)[:10])
    except ValueError:
        return None


LISTS, SCALARS, DAYS = ("aliases", "sources", "works_at", "contradicts"), ("type", "identity_key", "status", "superseded_by"), ("created", "last_verified")


def slug_of(path: str, name: str) -> str:
    """A page's slug: its file's name; in the archive, with archive/ before it, where redirects lead."""
    return ("archive/" if re.search(r"(?:^|/)wiki/archive/", path) else "") + re.sub(r"\.md$", "", name)


def page_of(path: str, name: str, content: str | None) -> dict:
    """The contract's columns, the other keys as text, and the body."""
    block, body = split(content or "")
    keys = load(block)
    one = lambda k: (texts(keys.get(k)) or [None])[0]
    row = {"slug": slug_of(path, name), "path": path, "file_name": name, "body": body}
    row |= {k: texts(keys.get(k)) for k in LISTS} | {k: one(k) for k in SCALARS} | {k: day(keys.get(k)) for k in DAYS}
    row["rest"] = [(k, v if isinstance(v, str) else json.dumps(v, sort_keys=True, default=str)) for k, v in sorted(keys.items()) if k not in (*LISTS, *SCALARS, *DAYS) and v is not None]
    return row


def parse_pages(parts):
    """Batches of (path, file_name, content) -> rows of `page_of`."""
    for part in parts:
        rows = [page_of(*r) for r in zip(*(part.column(c).to_pylist() for c in ("path", "file_name", "content")), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW_PAGES)


_L = pa.list_(pa.string())
ARROW_PAGES = pa.schema([
    ("slug", pa.string()), ("type", pa.string()), ("path", pa.string()), ("file_name", pa.string()), ("identity_key", pa.string()), ("aliases", _L), ("status", pa.string()),
    ("created", pa.date32()), ("last_verified", pa.date32()), ("sources", _L), ("works_at", _L), ("contradicts", _L), ("superseded_by", pa.string()),
    ("rest", pa.map_(pa.string(), pa.string())), ("body", pa.string()),
])
#: Keys in the order in which a harmonised block has them.
ORDER = ("type", "identity_key", "aliases", "status", "created", "last_verified", "works_at", "sources", "contradicts", "superseded_by")


def render(page: dict) -> str:
    """A page as Markdown: contract keys in fixed order, then the rest by name; empty keys are left out."""
    rest = dict(page.get("rest") or {})
    if RAW in rest:
        return f"---\n{rest[RAW]}\n---\n" + (page.get("body") or "")
    keys = {k: page.get(k) for k in ORDER} | dict(sorted(rest.items()))
    quote = lambda v: json.dumps(str(v), ensure_ascii=False) if re.search(r"[:#\[\]{},\"'\n]|^\s|\s$|^-|^$", str(v)) else str(v)
    lines = []
    for k, v in keys.items():
        if isinstance(v, str) and v[:1] in ("[", "{"):
            try:
                found = json.loads(v)
            except ValueError:
                found = v  # a text that begins with a bracket
            if isinstance(found, dict) or isinstance(found, list) and any(isinstance(x, (dict, list)) for x in found):
                lines.append(f"{k}: {v}")  # JSON is a block's flow style
                continue
            v = [str(x) for x in found] if isinstance(found, list) else v
        if v is None or v == []:
            continue
        lines += [f"{k}:", *(f"  - {quote(x)}" for x in v)] if isinstance(v, (list, tuple)) else [f"{k}: {quote(v)}"]
    return "---\n" + "\n".join(lines) + "\n---\n" + (page.get("body") or "")


def render_pages(parts):
    """Batches of pages -> (path, content)."""
    for part in parts:
        rows = part.to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([r["path"] for r in rows], pa.string()), pa.array([render(r) for r in rows], pa.string())], ["path", "content"])


def render_both(parts):
    """Batches of (source_path, _is, path, new, old), the latter two pages as structs -> their Markdown as after and before."""
    for part in parts:
        rows = part.to_pylist()
        text = lambda p: None if p is None else render(p)
        yield pa.RecordBatch.from_arrays([part.column("source_path"), part.column("_is"), part.column("path"), *(pa.array([text(r[k]) for r in rows], pa.string()) for k in ("old", "new"))], ["source_path", "_is", "path", "before", "after"])


def _taken_back(key: str, was, now, back) -> tuple[object, list[str]]:
    """A key's value with what changed from `back` to `was` undone, and what can't be."""
    if now == was or back == was:
        return (back if now == was else now), []
    if all(isinstance(x, (list, type(None))) for x in (was, now, back)):
        was, now, back = was or [], now or [], back or []
        return [x for x in now if x in back or x not in was] + [x for x in back if x not in was and x not in now] or None, []
    return now, [f"{key}: {now}"]


def taken_back(path: str, was: str, now: str, back: str) -> tuple[str, list[str]]:
    """A page as it is `now` with the change from `back` to `was` undone: keys one by one, the body by lines; and the conflicts, in which the page stays as it is."""
    pages = [page_of(path, path.rsplit("/", 1)[-1], x) for x in (was, now, back)]
    if any(RAW in dict(p["rest"]) for p in pages):
        lines, conflicts = linediff.merge3(was.split("\n"), now.split("\n"), back.split("\n"))
        return "\n".join(lines), conflicts
    out, conflicts = dict(pages[1]), []
    for key in (*LISTS, *SCALARS, *DAYS):
        out[key], more = _taken_back(key, *(p[key] for p in pages))
        conflicts += more
    rest = [dict(p["rest"]) for p in pages]
    out["rest"] = {}
    for key in sorted(set().union(*rest)):
        value, more = _taken_back(key, *(r.get(key) for r in rest))
        conflicts += more
        if value is not None:
            out["rest"][key] = value
    lines, more = linediff.merge3(*(p["body"].split("\n") for p in pages))
    return render(out | {"body": "\n".join(lines)}), conflicts + more


def undone(parts):
    """Batches of (path, op, before, after, now, others) -> (path, op, now, after, conflict): each page without a batch's change, or why not."""
    for part in parts:
        rows = []
        for r in part.to_pylist():
            after, conflict = r["before"], None
            if r["now"] != r["after"]:
                others = ", ".join(r["others"] or []) or "somebody"
                if r["op"] == "update" and r["now"] is not None:
                    after, lost = taken_back(r["path"], r["after"], r["now"], r["before"])
                    conflict = "\n".join(lost) if lost else None
                else:
                    after, conflict = r["now"], f"{r['op']}d by the batch, then changed by {others}"
            op = "delete" if after is None else "create" if r["now"] is None else "update"
            rows.append((r["path"], op, r["now"], after, conflict))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)] or [pa.array([], pa.string())] * 5, ["path", "op", "now", "after", "conflict"])


def diffs(parts):
    """Batches of (source_path, path, op, before, after) with a unified diff of each change."""
    lines = lambda x: [] if x is None else x.split("\n")
    for part in parts:
        text = ["\n".join(linediff.unified(lines(b), lines(a), p)) for p, b, a in zip(*(part.column(c).to_pylist() for c in ("path", "before", "after")), strict=True)]
        yield part.append_column("diff", pa.array(text, pa.string()))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
