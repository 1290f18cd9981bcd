"""Results and dictionary files: CSV and text with what was cut, and files that keep what people wrote.

Results are small and bounded by their limit, so the driver writes them.
"""

from __future__ import annotations

import csv
import io
import os
import tempfile
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime
from pathlib import Path

from catalens.plans.guard import sha8

PREVIEW = 20
# What stands before a name on the lines around a managed block.
OPENS, CLOSES = "--{ catalens ", "--} catalens "
GONE = "-- The object of this file is no longer in the database; its text below was written by hand.\n"


# --- Query results ---------------------------------------------------------


def csv_cell(value) -> str:
    """A cell: null is empty, an empty string is quoted, and so is what has a comma, a quote or a line end."""
    if value is None:
        return ""
    text = str(value)
    return '"' + text.replace('"', '""') + '"' if not text or any(c in text for c in ',"\n\r') else text


def csv_text(columns: list[str], rows: Iterable[Iterable]) -> str:
    """CSV with a header."""
    return "".join(",".join(map(csv_cell, row)) + "\n" for row in (columns, *rows))


def cut_csv(text: str, limit: int) -> tuple[str, int, bool]:
    """Header and the first ``limit`` records, how many there are, and whether any was cut; records may span lines."""
    records = list(csv.reader(io.StringIO(text)))
    kept = records[: limit + 1]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(kept)
    return out.getvalue(), max(0, len(kept) - 1), len(records) > limit + 1


def cut_lines(text: str, limit: int) -> tuple[str, int, bool]:
    lines = text.splitlines(keepends=True)
    return "".join(lines[:limit]), min(limit, len(lines)), len(lines) > limit


def claim(folder: str | os.PathLike, sql: str, suffix: str, now: datetime | None = None) -> Path:
    """A new file named by time and statement; a number, from 2, where the name is taken."""
    stem = f"{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%SZ')}-{sha8(sql)}"
    for n in range(1, 10_000):
        path = Path(folder) / (f"{stem}.{suffix}" if n == 1 else f"{stem}-{n}.{suffix}")
        try:
            with open(path, "x"):
                return path
        except FileExistsError:
            continue
    raise FileExistsError(stem)


def one_line(sql: str) -> str:
    return sql.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r")


def meta(sql: str, rows: int, truncated: bool, limit: int | None, elapsed_ms: int, form: str) -> str:
    """Six lines that tell what a result is."""
    facts = {"sql": one_line(sql), "rows": rows, "truncated": str(truncated).lower(), "limit": limit if limit is not None else "none", "elapsed_ms": elapsed_ms, "format": form}
    return "".join(f"{k}: {v}\n" for k, v in facts.items())


def preview(path: str, text: str, truncated: bool) -> str:
    """The path, the header and up to 19 records; a note only where the query itself was cut."""
    shown, _, _ = cut_csv(text, PREVIEW - 1)
    return f"{path}\n{shown}" + ("… (truncated, see .meta)\n" if truncated else "")


def redact(text: str, secrets: Iterable[str]) -> str:
    for s in sorted({s for s in secrets if s}, key=len, reverse=True):
        text = text.replace(s, "[REDACTED]")
    return text


def replace_file(path: str | os.PathLike, text: str) -> bool:
    """Write whole or not at all, and only what differs; whether it was written."""
    path = Path(path)
    if path.exists() and path.read_text(encoding="utf-8") == text:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(temporary, path)
    return True


# --- Dictionary files ------------------------------------------------------


def header(kind: str, schema: str, name: str) -> str:
    return f"-- {kind} {schema}.{name}\n-- Managed blocks are rewritten; text outside of them is kept. Write notes as -- lines.\n"


def block(name: str, body: str) -> str:
    return f"{OPENS}{name}\n{body}{CLOSES}{name}\n"


def sections(text: str) -> list[tuple[str | None, str]]:
    """A file as what people wrote (None, text) and its managed blocks (name, whole text), in order.

    Read line by line: a block that is opened and not closed under the same name is people's text.
    """
    out: list[tuple[str | None, str]] = []
    free: list[str] = []
    held: list[str] = []
    name = None
    for line in io.StringIO(text):
        bare = line.removesuffix("\n")
        if bare.startswith(OPENS):
            free, held, name = free + held, [], bare[len(OPENS):]
        (free if name is None else held).append(line)
        if name is not None and bare == CLOSES + name:
            out += [(None, "".join(free)), (name, "".join(held))]
            free, held, name = [], [], None
    return [*out, (None, "".join(free + held))]


def written_by_hand(text: str) -> str:
    return "".join(x for name, x in sections(text) if name is None)


def merged(old: str | None, head: str, blocks: Mapping[str, str]) -> str:
    """The file's text with ``blocks`` (in order) for its managed blocks and all other text as it was.

    Blocks that are not given go; new ones stand before the next given block that
    the file has, or at its end.
    """
    parts = [(None, head)] if old is None else sections(old)
    left = list(blocks)
    out: list[str] = []
    for name, text in parts:
        if name is None:
            out.append(text)
        elif name in left:
            at = left.index(name) + 1
            have = {k for k, _ in parts}
            out += [block(k, blocks[k]) for k in left[:at] if k == name or k not in have]
            left = [k for k in left[:at - 1] if k in have] + left[at:]
    tail = [block(k, blocks[k]) for k in left]
    if tail and out and (so_far := "".join(out)) and not so_far.endswith("\n"):
        out.append("\n")
    return "".join(out + tail)


def notes(text: str, head: str) -> str:
    """What people wrote in a file."""
    return written_by_hand(text).removeprefix(head).replace(GONE, "", 1).strip()


def retire(path: Path, head: str) -> bool:
    """The object of a file is gone: delete it, or keep what people wrote under one banner; whether it was deleted."""
    text = path.read_text(encoding="utf-8")
    if not notes(text, head):
        path.unlink()
        return True
    rest = written_by_hand(text)
    if GONE not in rest:
        rest = head + GONE + rest.removeprefix(head) if rest.startswith(head) else GONE + rest
        replace_file(path, rest)
    return False


def document(path: str | os.PathLike, text: str) -> int:
    """Write a collected document whole or not at all, with one line end; its bytes."""
    replace_file(path, text.rstrip("\n") + "\n")
    return Path(path).stat().st_size


def sync_folder(root: str | os.PathLike, schema: str, kind: str, objects: Mapping[str, Mapping[str, str]]) -> dict[str, list[str]]:
    """Make a schema's folder of one kind hold ``objects`` (name to blocks): written, deleted and unchanged files."""
    folder = Path(root) / schema / f"{kind}s"
    done: dict[str, list[str]] = {"written": [], "deleted": [], "unchanged": []}
    if folder.is_symlink() or (Path(root) / schema).is_symlink():
        raise ValueError(f"{folder} is a link")
    for path in sorted(folder.glob("*.sql")) if folder.exists() else []:
        if path.stem not in objects:
            done["deleted" if retire(path, header(kind, schema, path.stem)) else "unchanged"].append(str(path))
    for name, blocks in sorted(objects.items()):
        path = folder / f"{name}.sql"
        old = path.read_text(encoding="utf-8").replace(GONE, "", 1) if path.exists() else None
        done["written" if replace_file(path, merged(old, header(kind, schema, name), blocks)) else "unchanged"].append(str(path))
    if folder.exists() and not any(folder.iterdir()):
        folder.rmdir()
    return done


def collapse(root: str | os.PathLike, schema: str) -> dict[str, list[str]]:
    """The schema is gone: its managed files go, what people wrote stays."""
    done: dict[str, list[str]] = {"written": [], "deleted": [], "unchanged": []}
    for kind in ("table", "view", "function"):
        for k, v in sync_folder(root, schema, kind, {}).items():
            done[k] += v
    top = Path(root) / schema
    for extra in ("README.md", "_collect.json"):
        if (top / extra).exists():
            (top / extra).unlink()
            done["deleted"].append(str(top / extra))
    if top.exists() and not any(top.iterdir()):
        top.rmdir()
    return done
