"""Rules over JSON payloads of any depth and over configuration text, for use inside Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Keys (letters and digits only) that are secret whole, or where they hold a part.
SECRET_KEYS = ["secret", "pwd", "cookie", "token"]
SECRET_PARTS = ["apikey", "password", "passwd", "defaultpwd", "clientsecret", "accesstoken", "refreshtoken", "idtoken", "jwttoken", "bearertoken", "authorization", "setcookie"]
TOKEN_COUNTS = ["tokens", "prompttokens", "completiontokens", "totaltokens", "maxtokens"]
#: Keys whose values are user, model or document text.
CONTENT_KEYS = [
    "answer", "body", "bridgefacts", "candidatecontent", "constraintoverridereason", "constraintreason", "content", "context", "coveredrequirements", "expansionqueries", "extractionreason", "filename", "inputpreview",
    "intentrawresponse", "matchedtext", "message", "metadata", "missingrequirements", "outputpreview", "partialanswer", "pipelineoverridereason", "prompt", "query", "queryanalysisparsed", "queryanalysisexecutionplan",
    "queryanalysisrawresponse", "queryanalysisvalidated", "question", "rawcontent", "requestbody", "requirements", "responsebody", "rerankreason", "selectedtags", "standalonequery", "tags",
]
#: What a capped event keeps first.
FIRST_KEYS = ["timestamp", "event", "trace_id", "surface", "user_id", "conversation_id"]
SUMMARY_KEYS = ["evidence_status", "selected_kb_count", "hit_count", "candidate_count", "total_ms", "elapsed_ms"]
HIDDEN = "[REDACTED]"
YAML_LINE = re.compile(r"^(\s*)(?:-\s+)?([A-Za-z_][\w.-]*)\s*:(?:\s+(.*?))?\s*$")
PROPERTY_LINE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][\w.-]*)\s*=\s*(.+?)\s*$", re.IGNORECASE)
NAME_AND_COLON = re.compile(r"([A-Za-z_][A-Za-z0-9_.&-]*)\s*:")
NAME_AND_SIGN = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]+\s*[:=]")
SCALAR = re.compile(r"\s*(true|false|null|[-+]?\d+(?:\.\d+)?|\"[^\"\r\n]*\"|'[^'\r\n]*')", re.IGNORECASE)
#: What a fence may be labelled, what may stand before a name in a run-on block, and the longest names, quoted values and notes.
FENCE_LABELS = ["yaml", "yml", "properties", "property", "ini", "conf", "toml", "bash", "shell"]
BEFORE_NAME = "[{(,;"
LONGEST_NAME, LONGEST_QUOTED, LONGEST_NOTE = 128, 200, 240


def bare(key: str) -> str:
    return re.sub("[^a-z0-9]", "", str(key).casefold())


def is_secret(key: str) -> bool:
    k = bare(key)
    return k not in TOKEN_COUNTS and (k in SECRET_KEYS or any(p in k for p in SECRET_PARTS))


def redacted(x):
    """Values of secret keys hidden, at any depth."""
    if isinstance(x, dict):
        return {k: HIDDEN if is_secret(k) else redacted(v) for k, v in x.items()}
    return [redacted(v) for v in x] if isinstance(x, list) else x


def holds_content(x) -> bool:
    """Some content key, at any depth, has a value that says something."""
    if isinstance(x, list):
        return any(map(holds_content, x))
    if not isinstance(x, dict):
        return False
    said = lambda v: bool(v.strip()) if isinstance(v, str) else v is not None and v != [] and v != {}
    return any((bare(k) in CONTENT_KEYS and said(v)) or holds_content(v) for k, v in x.items())


def compact(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def capped(x: dict, most: int) -> dict:
    """What fits: identity first, then summaries, then the rest in order; and a note that it was cut."""
    size = len(compact(x).encode())
    if size <= most:
        return x
    note = {"truncated": True, "original_bytes": size}
    first = [k for k in FIRST_KEYS if k in x]
    out = {k: x[k][:256] if isinstance(x[k], str) else x[k] for k in first}
    later = [k for k in SUMMARY_KEYS if k in x]
    for k in later + [k for k in x if k not in FIRST_KEYS and k not in SUMMARY_KEYS]:
        if len(compact({**out, k: x[k], **note}).encode()) <= most:
            out[k] = x[k]
    return {**out, **note}


def over_json(rows: DataFrame, column: str, kind: T.DataType, rule: Callable, name: str | None = None) -> DataFrame:
    """rows with `name` (the column itself, unless given) = rule(parsed JSON); null where it does not parse or is nested too deep for Python."""
    name = name or column
    fields = [f for f in rows.schema.fields if f.name != name]
    schema = T.StructType([*fields, T.StructField(name, kind)])
    to_text = isinstance(kind, T.StringType)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(column).to_pylist():
                try:
                    value = rule(json.loads(raw)) if raw is not None else None
                    out.append(compact(value) if to_text and value is not None else value)
                except (ValueError, RecursionError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], pa.array(out, pa.string() if to_text else pa.bool_())], schema.names)

    return rows.mapInArrow(made, schema)


def redact_json_keys(rows: DataFrame, column: str) -> DataFrame:
    return over_json(rows, column, T.StringType(), redacted)


def contains_business_content(rows: DataFrame, column: str) -> DataFrame:
    return over_json(rows, column, T.BooleanType(), holds_content, "has_content")


def cap_payload(rows: DataFrame, column: str, most: int = 131_072) -> DataFrame:
    return over_json(rows, column, T.StringType(), lambda x: capped(x, most) if isinstance(x, dict) else x)


def typed(raw: str) -> str:
    """A scalar in JSON form."""
    text = raw.strip().rstrip(",")
    low = text.casefold()
    if low in ("true", "false"):
        return low
    if low in ("null", "none", "~"):
        return "null"
    if re.fullmatch(r"[-+]?\d+", text):
        return str(int(text))
    if re.fullmatch(r"[-+]?\d+\.\d+", text):
        return format(float(text), "g")
    quoted = len(text) > 1 and text[0] == text[-1] and text[0] in "\"'"
    return json.dumps(text[1:-1] if quoted else text, ensure_ascii=False)


@dataclass(frozen=True)
class Assignment:
    start: int
    end: int
    path: str
    value: str
    note: str | None


def note_of(comment: str) -> str | None:
    return " ".join(comment.split()).strip(" `#，,。；;")[:LONGEST_NOTE] or None


def by_lines(text: str) -> Iterator[Assignment]:
    """Indented `key: value` lines under their parents, and `a.b=value` lines."""
    parents: dict[int, str] = {}
    at = 0
    for line in text.splitlines(keepends=True):
        start, at = at, at + len(line)
        body, _, comment = line.rstrip("\r\n").partition(" #")
        end = start + len(line.rstrip("\r\n"))
        if m := YAML_LINE.match(body):
            depth = len(m[1].expandtabs(2))
            parents = {d: k for d, k in parents.items() if d < depth}
            if not m[3]:
                parents[depth] = m[2]
            else:
                yield Assignment(start + m.start(2), end, ".".join([*(parents[d] for d in sorted(parents)), m[2]]), typed(m[3]), note_of(comment))
        elif (m := PROPERTY_LINE.match(body)) and len(m[1]) <= LONGEST_NAME:
            yield Assignment(start + m.start(1), end, m[1].strip("."), typed(m[2]), note_of(comment))


def run_on_blocks(text: str) -> Iterator[tuple[int, str]]:
    """(place, body) of fences on one line, without their labels."""
    fences = [m.start() for m in re.finditer("```", text)]
    for a, b in zip(fences[::2], fences[1::2], strict=False):
        body = text[a + 3 : b]
        label = re.match(r"\s*(\w+)\s+", body)
        skip = label.end() if label and label[1].lower() in FENCE_LABELS else 0
        if "\n" not in body[skip:] and "\r" not in body[skip:]:
            yield a + 3 + skip, body[skip:]


def in_run_on_block(body: str, place: int) -> Iterator[Assignment]:
    """`key: value` in a block whose lines were run together: a value reaches up to the next key.

    A name is a key behind white space or an opening sign, unless what follows
    makes it part of an address; one with nothing before the next key is a
    container.  Indentation is lost, so that a path is its own name only.
    """
    keys = []
    for m in NAME_AND_COLON.finditer(body):
        free = m.start() == 0 or body[m.start() - 1].isspace() or body[m.start() - 1] in BEFORE_NAME
        if free and len(m[1]) <= LONGEST_NAME and not body[m.end() :].lstrip().startswith(("//", "\\")):
            keys.append(m)
    for m, after in zip(keys, [*[k.start() for k in keys[1:]], len(body)], strict=True):
        value, _, comment = (" " + body[m.end() : after].strip()).partition(" #")
        if value.strip():
            yield Assignment(place + m.start(), place + after, m[1], typed(value), note_of(comment))


def in_prose(text: str) -> Iterator[Assignment]:
    """`key=value` and `key: value` with a plain scalar, followed by another pair, a fence or the end of the text."""
    at = 0
    while m := NAME_AND_SIGN.search(text, at):
        at = m.end()
        scalar = SCALAR.match(text, m.end())
        name = m[0][:-1].rstrip()
        if scalar is None or len(name) > LONGEST_NAME or len(scalar[1]) > LONGEST_QUOTED + 2:
            continue
        line_end = min([i for i in (text.find("\n", scalar.end()), len(text)) if i >= 0])
        rest = text[scalar.end() : line_end]
        last = not text[line_end:].strip("\n") and len(text[line_end:]) <= 1
        follows = re.search(r"\s+(?=[A-Za-z_][A-Za-z0-9_.-]+\s*[:=])", rest)
        stops = [i for i in (follows.start() if follows else -1, rest.find("```"), len(rest) if last else -1) if i >= 0]
        between = rest[: min(stops)] if stops else None
        if between is None or (between and not between.lstrip().startswith("#")):
            continue
        at = scalar.end()
        yield Assignment(m.start(), scalar.end() + len(between), ".".join(filter(None, name.split("."))), typed(scalar[1]), note_of(between))


def config_assignments(text: str | None, most: int = 100) -> list[tuple[str, str, str | None]]:
    """(dotted path, JSON value, comment) of the assignments of a text, the first of equals: on lines of their own, in fenced
    blocks that were run together to one line, and in prose where none of these is."""
    text = text or ""
    found = [*by_lines(text), *(x for place, body in run_on_blocks(text) for x in in_run_on_block(body, place))]
    taken = [(x.start, x.end) for x in found]
    found += [x for x in in_prose(text) if not any(a <= x.start and x.end <= b for a, b in taken)]
    first: dict[tuple[str, str], str | None] = {}
    for x in sorted(found, key=lambda x: (x.start, x.end)):
        first.setdefault((x.path.casefold(), x.value), x.note)
    return [(p, v, c) for (p, v), c in list(first.items())[:most]]


def extract_config_assignments(rows: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each assignment in a text column."""
    schema = T.StructType([rows.schema[key], *[T.StructField(n, T.StringType()) for n in ("path", "value", "meaning")]])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *a) for k, t in zip(b.column(key).to_pylist(), b.column(column).to_pylist(), strict=True) for a in config_assignments(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.column(key).type), *[pa.array([r[i] for r in out], pa.string()) for i in (1, 2, 3)]], schema.names)

    return rows.select(key, column).mapInArrow(made, schema)
