"""Readers of what sources deliver as files: mail boxes, archives, documents, delimited and loose text.

The parsers are plain functions of bytes or text; ``mail_boxes`` and
``documents`` run them over files that ``spark.read.format("binaryFile")`` lists, so a
folder of any number of files is read in parallel. What can't be read gives an
empty result, never an error.
"""

from __future__ import annotations

import csv
import email
import email.header
import email.message
import email.policy
import hashlib
import html
import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: Larger attachments are hashed but not kept.
MOST_BYTES = 8 << 20


# Mail


def split_mbox(data: bytes) -> list[bytes]:
    """The messages of a mail box: each begins after a line that starts with ``From ``; blank ones are dropped."""
    parts = re.split(rb"(?:\A|\n)From [^\n]*(?:\n|\Z)", data.replace(b"\r\n", b"\n"))
    return [p for p in parts if p.strip()]


def header_text(value: str | None) -> str:
    """A header with folded lines joined and encoded words decoded."""
    joined = re.sub(r"\r?\n[ \t]+", " ", value or "")
    try:
        return str(email.header.make_header(email.header.decode_header(joined))).strip()
    except (LookupError, UnicodeError, ValueError):
        return joined.strip()


def _payload_text(part: email.message.Message) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def parse_message(data: bytes) -> dict:
    """sender, subject, date, message_id, body and attachments (file_name, mime_type, size, sha256, content) of one message.

    Multiparts are walked to any depth; the body is the plain text, or else the
    text of the HTML parts. Attachments over ``MOST_BYTES`` have no content.
    """
    message = email.message_from_bytes(data, policy=email.policy.compat32)
    plain, marked, files = [], [], []
    for part in message.walk():
        if part.is_multipart():
            continue
        name = header_text(part.get_filename())
        if name or part.get_content_disposition() == "attachment":
            content = part.get_payload(decode=True) or b""
            files.append({"file_name": name, "mime_type": part.get_content_type(), "size": len(content), "sha256": hashlib.sha256(content).hexdigest(), "content": content if len(content) <= MOST_BYTES else None})
        elif part.get_content_type() == "text/plain":
            plain.append(_payload_text(part))
        elif part.get_content_type() == "text/html":
            marked.append(markup_text(_payload_text(part)))
    body = "\n".join(plain) if any(p.strip() for p in plain) else "\n".join(marked)
    return {"sender": header_text(message["From"]), "subject": header_text(message["Subject"]), "date": header_text(message["Date"]), "message_id": header_text(message["Message-ID"]).strip("<>"), "body": body.strip("\r\n"), "attachments": files}


def markup_text(text: str) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", text)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", text))).strip()


def boxes_of(name: str, data: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of each mail box in a file: itself, or the ``.mbox`` entries of an archive."""
    if not data.startswith(b"PK"):
        return [(name, data)]
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(f"{name}!{i.filename}", z.read(i)) for i in z.infolist() if i.filename.lower().endswith(".mbox") and i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)]
    except (zipfile.BadZipFile, RuntimeError, OSError):
        return []


_FILES = pa.list_(pa.struct([("file_name", pa.string()), ("mime_type", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())]))
MESSAGES = "path string, box string, position long, sender string, subject string, date string, message_id string, body string, attachments array<struct<file_name:string,mime_type:string,size:long,sha256:string,content:binary>>"


def mail_boxes(files: DataFrame) -> DataFrame:
    """One row for each message of ``files`` (path string, content binary): mail boxes, or archives of them."""
    import veinwork.sources.readers as own

    cloudpickle.register_pickle_by_value(own)
    kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5, _FILES]
    names = [x.split()[0] for x in MESSAGES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for box, data in own.boxes_of(path, content or b""):
                    found = [{"path": path, "box": box, "position": k, **own.parse_message(m)} for k, m in enumerate(own.split_mbox(data))]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, MESSAGES)


# Documents


def document_text(name: str | None, data: bytes | None) -> str:
    """Text of a document by its name or first bytes: word processor files, rich text, plain text, and the literals of a PDF."""
    data, low = data or b"", (name or "").lower()
    if data.startswith(b"PK") or low.endswith(".docx"):
        return _word_text(data)
    if data.startswith(b"%PDF-") or low.endswith(".pdf"):
        return _pdf_literals(data)
    if data.startswith(b"{\\rtf") or low.endswith(".rtf"):
        return _rich_text(data.decode("latin-1"))
    if low.endswith((".txt", ".md", ".csv", ".text")) or (not low.rpartition(".")[1] and b"\x00" not in data[:1024]):
        return data.decode("utf-8", "replace").replace("\x00", " ").strip()
    return ""


def _word_text(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            parts = sorted(i for i in z.namelist() if re.fullmatch(r"word/(document|header|footer)[^/]*\.xml", i))
            marked = [re.sub(r"</w:p\s*>|<w:br\b[^>]*>", "\n", z.read(p).decode("utf-8", "replace")) for p in parts]
    except (zipfile.BadZipFile, RuntimeError, OSError):
        return ""
    texts = (html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<w:tab\b[^>]*>", "\t", m))).strip() for m in marked)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(t for t in texts if t))


_ESCAPES = {"n": "\n", "r": "\n", "t": "\t", "b": "", "f": ""}


def _pdf_literals(data: bytes) -> str:
    """Strings in parentheses between text operators of streams that aren't compressed; without a library that is all there is."""
    out = []
    for block in re.findall(rb"BT\b(.*?)\bET\b", data, re.DOTALL):
        for literal in re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|TJ|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", block, re.DOTALL):
            parts = [literal[0]] if literal[0] else re.findall(rb"\(((?:\\.|[^\\()])*)\)", literal[1], re.DOTALL)
            text = "".join(p.decode("latin-1") for p in parts)
            out.append(re.sub(r"\\([0-7]{1,3}|.)", lambda m: chr(int(m[1], 8) % 256) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), text, flags=re.DOTALL))
    return "\n".join(x for x in out if x.strip())


def _rich_text(text: str) -> str:
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return re.sub(r"\\[a-zA-Z]+-?[0-9]* ?|[{}]", "", text).strip()


# Delimited and loose text


def delimiter_of(header: str) -> str:
    """Of semicolon, tab and comma the one that gives the header most fields."""
    return max(";\t,", key=lambda d: len(next(csv.reader([header], delimiter=d), [])))


def delimited_rows(text: str, delimiter: str | None = None) -> list[dict[str, str]]:
    """Rows by header of delimited text; nothing without at least two columns. Quotes are doubled, a row is one line, unnamed columns get a number."""
    lines = [x for x in text.lstrip("\ufeff").splitlines() if x.strip()]
    if not lines:
        return []
    delimiter = delimiter or delimiter_of(lines[0])
    head, *body = (next(csv.reader([x], delimiter=delimiter, doublequote=True), []) for x in lines)
    names = [h.strip() or f"column_{k + 1}" for k, h in enumerate(head)]
    if len(names) < 2:
        return []
    return [{n: (r[k].strip() if k < len(r) else "") for k, n in enumerate(names)} for r in body]


def simple_rows(text: str) -> list[dict[str, str]]:
    """As ``delimited_rows``, by semicolon if the header has one, else by comma."""
    return delimited_rows(text, ";" if ";" in (text.lstrip("\ufeff").splitlines() or [""])[0] else ",")


def rows_of(text: str | None, most: int | None = None) -> list[dict]:
    """Rows of an import in any form: JSON, else delimited text, else chunks between blank lines. All of them, unless a caller asks for the first ``most``."""
    text = (text or "").strip()
    if not text:
        return []
    try:
        value = json.loads(text)
        found = value if isinstance(value, list) else next((v for v in value.values() if isinstance(v, list)), [value]) if isinstance(value, dict) else None
        if found is not None:
            return [r for r in found if isinstance(r, dict)][:most]
    except ValueError:
        pass
    rows = delimited_rows(text)
    if not rows:
        rows = [{"text": c.strip(), "source_id": f"text-{k + 1}"} for k, c in enumerate(c for c in re.split(r"\n\s*\n", text) if c.strip())]
    return rows[:most]


#: A row that describes a person has one of these keys.
PERSON_KEYS = frozenset({"name", "fullname", "full_name", "firstname", "first_name", "nombre", "email", "mail", "correo", "phone", "telefono"})


def embedded_rows(config: str | None) -> list[dict]:
    """Records inside a source's configuration: under the known keys, as a list or as text, else every person-like object in it."""
    try:
        value = json.loads(config or "")
    except ValueError:
        return []
    if isinstance(value, dict):
        for key in ("records", "candidates", "historicalData"):
            own = value.get(key)
            found = rows_of(own) if isinstance(own, str) else [r for r in own if isinstance(r, dict)] if isinstance(own, list) else []
            if found:
                return found
    out, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict) and PERSON_KEYS & {k.lower() for k in x}:
            out.append(x)
        elif isinstance(x, dict | list):
            stack += reversed(list(x.values()) if isinstance(x, dict) else x)
    return out


_LETTERS: dict[str, str] = {}


def _letters(key: str) -> str:
    """A key's letters and digits; looked up, as keys repeat."""
    if key not in _LETTERS:
        if len(_LETTERS) > 100_000:
            _LETTERS.clear()
        _LETTERS[key] = re.sub(r"[^a-z0-9]", "", key.lower())
    return _LETTERS[key]


def deep_values(text: str | None, wanted: list[str], depth: int = 6) -> list[str]:
    """Every value under the wanted keys (letters and digits alone count), at most ``depth`` levels down; objects give their label."""
    try:
        return deep_fields(json.loads(text or ""), {"": wanted}, depth)[""]
    except ValueError:
        return []


def deep_fields(parsed, wanted: dict[str, Iterable[str]], depth: int = 6) -> dict[str, list[str]]:
    """``deep_values`` of several fields in one walk over what was parsed; a field isn't looked for below a key that is its own."""
    fields: dict[str, list[str]] = {}
    for field, names in wanted.items():
        for key in {_letters(n) for n in names}:
            fields.setdefault(key, []).append(field)
    out: dict[str, dict[str, None]] = {field: {} for field in wanted}  # in order, each once

    def take(x) -> list[str]:
        if isinstance(x, list):
            return [v for y in x for v in take(y)]
        if isinstance(x, dict):
            own = {k.lower(): v for k, v in x.items()}
            return take(next((own[k] for k in ("name", "nombre", "label", "value") if own.get(k)), None))
        return [str(x).strip()] if x is not None and not isinstance(x, bool) and str(x).strip() else []

    def walk(x, level: int, open_: frozenset[str]) -> None:
        if level > depth:
            return
        if isinstance(x, dict):
            for k, v in x.items():
                below, found = open_, fields.get(_letters(k))
                if found and (found := open_.intersection(found)):
                    values = take(v)
                    for field in found:
                        out[field].update(dict.fromkeys(values))
                    below = open_ - found
                if below and isinstance(v, dict | list):
                    walk(v, level + 1, below)
        elif isinstance(x, list):
            for v in x:
                walk(v, level + 1, open_)

    walk(parsed, 0, frozenset(wanted))
    return {field: list(values) for field, values in out.items()}


#: Keys under which sources tell when a record was made or changed.
DATE_KEYS = frozenset("createdat created_at created date fecha fechacreacion fechapostulacion updatedat updated_at timestamp".split())


def source_date(text: str | None, now_ms: int, depth: int = 4) -> int | None:
    """Epoch milliseconds of the first date under a date key: an object's own keys before its children's, none after tomorrow."""
    from datetime import UTC, datetime

    def date(v) -> int | None:
        s = str(v).strip()
        if re.fullmatch(r"[0-9]{12,13}", s):
            found = int(s)
        else:
            try:
                at = datetime.fromisoformat(s.replace("Z", "+00:00"))
            except ValueError:
                return None
            found = int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)
        return found if 0 < found <= now_ms + 86_400_000 else None

    def walk(x, level: int) -> int | None:
        if level > depth or not isinstance(x, dict | list):
            return None
        if isinstance(x, dict):
            for k, v in x.items():
                if k.lower() in DATE_KEYS and not isinstance(v, dict | list | bool) and v is not None and (d := date(v)):
                    return d
        return next((d for v in (x.values() if isinstance(x, dict) else x) if (d := walk(v, level + 1))), None)

    try:
        return walk(json.loads(text or ""), 0)
    except ValueError:
        return None
