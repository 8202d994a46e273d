"""XMP sidecars: a lenient reader, a writer that leaves foreign content alone, and Arrow wrappers."""

from __future__ import annotations

import math
import os
import re
import uuid
import xml.dom.minidom as dom
from collections.abc import Iterator
from datetime import datetime, timezone
from xml.parsers.expat import ExpatError

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.functions.scalars import NUMBER, WHITE_SPACE
from lumicat import config as C

MAX_DEPTH = 64
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

#: Namespaces of the managed fields.
NAMESPACES = {
    "rdf": RDF, "crs": "http://ns.adobe.com/camera-raw-settings/1.0/", "xmp": "http://ns.adobe.com/xap/1.0/",
    "dc": "http://purl.org/dc/elements/1.1/", "lr": "http://ns.adobe.com/lightroom/1.0/", C.DEFAULT.namespace: "http://lumicat.invalid/ns/1.0/",
}

#: Managed fields as name -> (prefix, local name, kind).
FIELDS = {
    "temperature": ("crs", "Temperature", "int"), "tint": ("crs", "Tint", "int"), "exposure": ("crs", "Exposure2012", "float"),
    "contrast": ("crs", "Contrast2012", "int"), "highlights": ("crs", "Highlights2012", "int"), "shadows": ("crs", "Shadows2012", "int"),
    "auto_tone": ("crs", "AutoTone", "bool"), "score": (C.DEFAULT.namespace, "Score", "float"), "cluster_id": (C.DEFAULT.namespace, "ClusterId", "long"),
    "asset_id": (C.DEFAULT.namespace, "AssetId", "text"), "last_processed_at": (C.DEFAULT.namespace, "LastProcessedAt", "time"),
    "metadata_date": ("xmp", "MetadataDate", "time"), "rating": ("xmp", "Rating", "int"), "label": ("xmp", "Label", "text"),
}
LISTS = {"keywords": ("dc", "subject"), "hierarchical_keywords": ("lr", "hierarchicalSubject")}
RANGES = {"exposure": (-5.0, 5.0), "contrast": (-100, 100), "highlights": (-100, 100), "shadows": (-100, 100)}
CLAMPS = {"temperature": (2000, 50000), "tint": (-150, 150)}


class SidecarError(ValueError):
    pass


def _nearest(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def parse_value(kind: str, text: str):
    """A value of the kind, or None if the text isn't one."""
    t = text.strip(WHITE_SPACE)
    if kind in ("int", "long", "float") and not re.fullmatch(NUMBER, t):
        return None
    try:
        if kind == "int":
            f = float(t)
            return _nearest(f) if math.isfinite(f) and -(2**31) <= f <= 2**31 - 1 else None
        if kind == "long":
            return int(t) if re.fullmatch(r"[+-]?[0-9]+", t) else _nearest(float(t))
        if kind == "float":
            f = float(t)
            return f if math.isfinite(f) else None
        if kind == "bool":
            return {"true": True, "false": False}.get(t.lower())
        if kind == "time":
            if not re.fullmatch(r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", t):
                return None
            return datetime.fromisoformat(t.upper()).timestamp()
    except (ValueError, OverflowError):
        return None
    return text


def keep_in_range(name: str, value):
    """Some fields are clamped to their range, others dropped outside it."""
    if value is None:
        return None
    if name in CLAMPS:
        low, high = CLAMPS[name]
        return max(low, min(high, value))
    if name in RANGES and not RANGES[name][0] <= value <= RANGES[name][1]:
        return None
    if name == "rating" and value not in range(-1, 6):
        return None
    return value.strip() if name == "label" else value


def _named(name: str, prefix: str, local: str) -> bool:
    """The prefix is optional and of any case; the local name is exact."""
    p, _, rest = name.rpartition(":")
    return rest == local and (not p or p.lower() == prefix)


def _is_description(node) -> bool:
    return node.nodeType == node.ELEMENT_NODE and node.tagName.rpartition(":")[2].lower() == "description"


def _text(node) -> str:
    return "".join(c.data for c in node.childNodes if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE))


def _elements(node, depth: int = 0) -> Iterator:
    if depth > MAX_DEPTH:
        raise SidecarError("nested too deeply")
    for c in node.childNodes:
        if c.nodeType == c.ELEMENT_NODE:
            yield c
            yield from _elements(c, depth + 1)


def _parse(text: str):
    try:
        return dom.parseString(text.encode())
    except ExpatError as e:
        raise SidecarError(f"malformed XML: {e}") from None


def parse(text: str) -> dict:
    """Managed fields of all descriptions; later ones win. Bad values are None, malformed XML an error."""
    doc = _parse(text)
    out: dict = dict.fromkeys(FIELDS) | {k: set() for k in LISTS} | {"has_settings": False}
    for d in [e for e in _elements(doc) if _is_description(e)]:
        found = [(k, v) for k, v in d.attributes.items()]
        for e in _elements(d):
            if not any(c.nodeType == c.ELEMENT_NODE for c in e.childNodes):
                found.append((e.tagName, _text(e)))
            for name, (prefix, local) in LISTS.items():
                if _named(e.tagName, prefix, local):
                    out[name] |= {t for i in _elements(e) if i.tagName.rpartition(":")[2] == "li" and (t := _text(i).strip())}
        for key, value in found:
            out["has_settings"] |= key.lower().startswith("crs:")
            for name, (prefix, local, kind) in FIELDS.items():
                if _named(key, prefix, local):
                    out[name] = keep_in_range(name, parse_value(kind, value))
    for name in LISTS:
        out[name] = sorted(out[name])
    return out


def _is_managed(tag: str) -> bool:
    t = tag.lower()
    return t in {f"{p}:{local}".lower() for p, local, _ in FIELDS.values()} | {f"{p}:{local}".lower() for p, local in LISTS.values()} | {"crs:processversion", "crs:hassettings"}


def as_text(kind: str, value) -> str:
    if kind == "time":
        return datetime.fromtimestamp(value, timezone.utc).isoformat().replace("+00:00", "Z")
    if kind == "bool":
        return "True" if value else "False"
    return str(value)


EMPTY = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{RDF}"><rdf:Description rdf:about=""/></rdf:RDF></x:xmpmeta>'


def render(existing: str | None, settings: dict) -> str:
    """The sidecar's text with the managed fields of its first description replaced; the rest stays.

    A rating of 0 is written as none. Without a description one is made inside rdf:RDF; without
    that either, it is an error.
    """
    doc = _parse(existing if existing is not None else EMPTY)
    target = next((e for e in _elements(doc) if _is_description(e)), None)
    if target is None:
        rdf = next((e for e in _elements(doc) if e.tagName.rpartition(":")[2] == "RDF"), None)
        if rdf is None:
            raise SidecarError("neither a description nor rdf:RDF")
        target = rdf.appendChild(doc.createElementNS(RDF, "rdf:Description"))
        target.setAttribute("rdf:about", "")
    for key in [k for k in target.attributes.keys() if _is_managed(k)]:
        target.removeAttribute(key)
    for e in [e for e in _elements(target) if _is_managed(e.tagName)]:
        e.parentNode.removeChild(e)
    used = {"rdf"}
    for name, (prefix, local, kind) in FIELDS.items():
        value = settings.get(name)
        if value is None or (name == "rating" and value == 0):
            continue
        target.setAttribute(f"{prefix}:{local}", as_text(kind, value))
        used.add(prefix)
    for name, (prefix, local) in LISTS.items():
        if settings.get(name):
            bag = doc.createElement("rdf:Bag")
            for word in sorted(set(settings[name])):
                bag.appendChild(doc.createElement("rdf:li")).appendChild(doc.createTextNode(word))
            target.appendChild(doc.createElement(f"{prefix}:{local}")).appendChild(bag)
            used.add(prefix)
    for prefix in sorted(used):
        target.setAttribute(f"xmlns:{prefix}", NAMESPACES[prefix])
    return "\n".join(n.toxml() for n in doc.childNodes)  # processing instructions and comments around the root stay


def is_managed_keyword(word: str, root: str = C.DEFAULT.keyword_root) -> bool:
    w, r = word.lower(), root.lower()
    if w == r or w.startswith((r + "|", r + ":")):
        return True
    number = re.fullmatch(r"cluster:([+]?\d+|-0+)", w)
    return bool(number and int(number[1]) < 2**63) or w in {f"nima:{t}" for t in C.TIER_NAMES}


def merge(existing: dict, incoming: dict) -> dict:
    """Incoming values win where there are any; ("clear",) clears a field; managed keywords are replaced."""
    out = dict(existing)
    for name in FIELDS:
        value = incoming.get(name)
        if value == ("clear",):
            out[name] = None
        elif value is not None:
            out[name] = value
    for name in LISTS:
        if incoming.get(name) is not None:
            out[name] = sorted({k for k in existing.get(name) or () if not is_managed_keyword(k)} | set(incoming[name]))
    return out


def decide(existing: dict, incoming: dict, mtime: float) -> str:
    """As functions.scalars.conflict_outcome, for a sidecar that exists and isn't forced."""
    done, changed = existing["last_processed_at"], existing["metadata_date"]
    ours = existing["asset_id"] is not None and existing["asset_id"] == incoming.get("asset_id")
    if done is not None and mtime - done > C.MTIME_SLACK_SECONDS:
        return "conflict_preserved"
    if changed is not None:
        return "conflict_preserved" if done is not None and changed > done else "overwritten"
    if done is not None:
        return "overwritten" if ours else "conflict_preserved"
    return "conflict_preserved" if existing["has_settings"] and not ours else "overwritten"


def replace_file(path: str, data: bytes, mtime: float | None = None) -> None:
    """Write beside the file and rename over it."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(part, "wb") as f:
            f.write(data)
        if mtime is not None:
            os.utime(part, (mtime, mtime))
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def merge_and_write(path: str, incoming: dict, force: bool = False) -> str:
    """Merge a sidecar file with incoming settings under the conflict rules; returns the outcome."""
    stamp = incoming.get("last_processed_at")
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        before = os.stat(path).st_mtime
    except FileNotFoundError:
        replace_file(path, render(None, incoming).encode(), stamp)
        return "created"
    try:
        existing = parse(text)
    except SidecarError:
        if not force:
            raise
        replace_file(path, render(None, incoming).encode(), stamp)
        return "forced_overwrite"
    outcome = "forced_overwrite" if force else decide(existing, incoming, before)
    if outcome != "conflict_preserved":
        if os.stat(path).st_mtime != before:
            raise SidecarError("changed while it was read")
        replace_file(path, render(text, merge(existing, incoming)).encode(), stamp)
    return outcome


_TYPES = {"int": pa.int32(), "long": pa.int64(), "float": pa.float64(), "bool": pa.bool_(), "text": pa.string(), "time": pa.float64()}
_NAMES = {"int": "int", "long": "long", "float": "double", "bool": "boolean", "text": "string", "time": "double"}
PARSED = "sidecar string, " + ", ".join(f"{n} {_NAMES[k]}" for n, (_, _, k) in FIELDS.items()) + ", keywords array<string>, hierarchical_keywords array<string>, has_settings boolean, error string"


def read_sidecars(files: DataFrame) -> DataFrame:
    """Parsed sidecars of a table (sidecar, text); ``error`` says why one couldn't be parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("sidecar").to_pylist(), batch.column("text").to_pylist()):
                try:
                    rows.append({"sidecar": path, "error": None} | parse(text or ""))
                except SidecarError as e:
                    rows.append({"sidecar": path, "error": str(e)})
            fields = [("sidecar", pa.string()), *((n, _TYPES[k]) for n, (_, _, k) in FIELDS.items()), ("keywords", pa.list_(pa.string())), ("hierarchical_keywords", pa.list_(pa.string())), ("has_settings", pa.bool_()), ("error", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], names=[n for n, _ in fields])

    return files.select("sidecar", "text").mapInArrow(run, PARSED)


def with_sidecars(rows: DataFrame, fields: tuple[str, ...], path: str = "sidecar") -> DataFrame:
    """Rows with xmp_<field> of the sidecar file each ``path`` names, null without one, and xmp_error.

    The files are read where the rows are; the columns pass through without a shuffle.
    """
    at = rows.columns.index(path)
    schema = rows.select("*", *(F.lit(None).cast(_NAMES[FIELDS[f][2]]).alias(f"xmp_{f}") for f in fields), F.lit(None).cast("string").alias("xmp_error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(at).to_pylist():
                try:
                    with open(name, encoding="utf-8") as f:
                        found.append(parse(f.read()) | {"error": None})
                except FileNotFoundError:
                    found.append({})
                except (OSError, ValueError) as e:
                    found.append({"error": str(e)})
            extra = [pa.array([x.get(f) for x in found], _TYPES[FIELDS[f][2]]) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra, pa.array([x.get("error") for x in found], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
