"""A lexical guard for one read-only statement.

Comments and quoted text are blanked out, so that what is left can be judged:
one statement, no client commands, no way to change session settings, an allowed
first word, and a sound limit. The text is read by the rules of PostgreSQL;
Spark's parser has the last word (``plans.session``).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import asdict, dataclass

ALLOWED = ("select", "with", "explain", "show")
LARGEST = 2**63 - 1

_WORD = re.compile(r"[A-Za-z0-9_$]")
_OPENING = re.compile(r"--|/\*|'|\"|\$(?:[A-Za-z_][A-Za-z0-9_]*)?\$")
_EDGE = re.compile(r"/\*|\*/")


@dataclass(frozen=True)
class Verdict:
    ok: bool
    reason: str | None
    kind: str | None
    sql: str | None
    wrapped: str | None
    sha8: str | None

    def as_dict(self) -> dict:
        return asdict(self)


def _end_of_string(sql: str, at: int, escapes: bool) -> int:
    """Where the string whose quote is at ``at`` ends."""
    body = re.compile(r"(?:[^'\\]|''|\\.)*+" if escapes else r"(?:[^']|'')*+", re.S).match(sql, at + 1).end()
    return min(body + 1, len(sql))


def _end_of_comment(sql: str, at: int) -> int:
    depth = 0
    for m in _EDGE.finditer(sql, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(sql)


def mask(sql: str, keep_names: bool = False) -> str:
    """``sql`` with comments and quoted text blanked, of the same length; ``keep_names`` leaves quoted names."""
    out, at = [], 0
    while m := _OPENING.search(sql, at):
        start, mark = m.start(), m.group()
        before = sql[start - 1] if start else ""
        if mark[0] == "$" and _WORD.fullmatch(before or " "):
            out.append(sql[at : start + 1])
            at = start + 1
            continue
        if mark == "--":
            end = sql.find("\n", start)
            end = len(sql) if end < 0 else end
        elif mark == "/*":
            end = _end_of_comment(sql, start)
        elif mark == "'":
            lead = before in ("e", "E") and not _WORD.fullmatch(sql[start - 2] if start > 1 else " ")
            end = _end_of_string(sql, start, lead)
        elif mark == '"':
            end = min(re.compile(r'(?:[^"]|"")*+', re.S).match(sql, start + 1).end() + 1, len(sql))
        else:
            close = sql.find(mark, m.end())
            end = len(sql) if close < 0 else close + len(mark)
        out.append(sql[at:start])
        out.append(sql[start:end] if mark == '"' and keep_names else re.sub(r"[^\n]", " ", sql[start:end]))
        at = end
    return "".join(out) + sql[at:]


def sha8(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def positive(limit: str | int | None) -> int | None:
    """A limit as a number from 1 to 2^63 - 1, or None for anything else."""
    text = str(limit).strip() if limit is not None else ""
    return n if re.fullmatch(r"\+?\d+(_\d+)*", text) and 0 < (n := int(text)) <= LARGEST else None


def _runs_analyze(text: str) -> bool:
    """An EXPLAIN that would run its statement: ANALYZE, in either form, not set to false."""
    for m in re.finditer(r"(?i)\bexplain\s*(\(([^)]*)|analyze\b)", text):
        if m.group(2) is None:
            return True
        for option in m.group(2).split(","):
            words = option.lower().split()
            if "analyze" in words and not (words[words.index("analyze") + 1 :] or ["true"])[0] in ("false", "off", "0", "no"):
                return True
    return False


def evaluate(sql: str, limit: str | int | None = 200, no_limit: bool = False, mode: str = "query") -> Verdict:
    """Judge one statement; ``mode`` is ``query`` or ``prepare`` (any statement that a planner takes)."""
    def no(reason: str, kind: str | None = None, core: str | None = None) -> Verdict:
        return Verdict(False, reason, kind, core or None, None, sha8(core) if core else None)

    blank = mask(sql)
    head, semicolon, rest = blank.partition(";")
    if rest.strip():
        return no("multi-statement")
    core = sql[: len(head)].strip()
    if "\\" in head:
        return no("meta-command")
    if re.search(r"(?i)\bset_config\s*\(", head) or re.search(r'"set_config"\s*\(', mask(sql, True)[: len(head)]):
        return no("not-whitelisted")
    if mode == "query" and _runs_analyze(head):
        return no("not-whitelisted", "explain", core)
    first = re.match(r"\s*([A-Za-z_]\w*)", head)
    kind = first.group(1).lower() if first else ""
    if mode == "query" and kind not in ALLOWED:
        return no("not-whitelisted", None, core)
    n = None if no_limit else positive(limit)
    if n is None and not no_limit:
        return no("bad-limit", kind, core)
    wrapped = f"SELECT * FROM ({core}\n) _q LIMIT {n + 1}" if n is not None and kind in ("select", "with") else core
    return Verdict(True, None, kind, core, wrapped, sha8(core))
