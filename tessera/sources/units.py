"""Units of structured texts: rows with id, parent_id, type, path, content."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = "source_id string, id string, parent_id string, type string, name string, path string, content string"
# Headers of functions and labels in scripts.
SHELL_FUNCTION = re.compile(r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*(?:\{|$)", re.M)
CMD_LABEL = re.compile(r"^\s*:(?P<name>[\w-]+)\s*$", re.M)
POWERSHELL_FUNCTION = re.compile(r"^\s*function\s+(?P<name>[\w-]+)\s*(?:\{|$)", re.M | re.I)
Row = tuple[str, str | None, str, str, str, str]


def json_units(text: str) -> list[Row]:
    """Objects, properties and arrays of a JSON text, by path; scalar items of arrays have no row."""
    out: list[Row] = []

    def walk(value, path: str, parent: str | None, name: str) -> None:
        kind = "JsonObject" if isinstance(value, dict) else "JsonArray" if isinstance(value, list) else "JsonProperty"
        out.append((path or "$", parent, kind, name, path, json.dumps(value, ensure_ascii=False, separators=(",", ":"))))
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}" if path else k, path or "$", k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                if isinstance(v, dict | list):
                    walk(v, f"{path}[{i}]", path or "$", f"[{i}]")

    walk(json.loads(text), "", None, "$")
    return out


class _Elements(HTMLParser):
    """Elements of a page as a tree; the position is that among all children of the parent."""

    EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__()
        self.rows: list[list] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else -1
        at = self.children[parent] = self.children.get(parent, -1) + 1
        path = f"{self.rows[parent][4]}/{tag}[{at}]" if parent >= 0 else f"{tag}[{at}]"
        named = dict(attrs)
        self.rows.append([path, self.rows[parent][0] if parent >= 0 else None, "XmlElement", named.get("id") or named.get("name") or tag, path, ""])
        if tag not in self.EMPTY:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][4].rsplit("/", 1)[-1].startswith(f"{tag}["):
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.open and data.strip():
            row = self.rows[self.open[-1]]
            row[5] = f"{row[5]} {data.strip()}".strip()


def markup_units(text: str) -> list[Row]:
    """Elements of an HTML or XML text with their own text."""
    p = _Elements()
    p.feed(text)
    p.close()
    return [tuple(r) for r in p.rows]


def yaml_units(text: str) -> list[Row]:
    """Mappings, sequences and scalars of block-style YAML, by path: indentation makes the tree."""
    out: list[Row] = [("$", None, "YamlMapping", "$", "", "")]
    stack: list[tuple[int, str]] = [(-1, "")]
    counts: dict[str, int] = {}
    for line in text.splitlines():
        m = re.match(r"^(\s*)(- )?(?:([^\s:#][^:]*):)?\s*(.*)$", line)
        if not line.strip() or line.lstrip().startswith("#") or not m:
            continue
        indent, dash, key, value = len(m[1]), m[2], m[3], m[4]
        while stack[-1][0] >= indent:
            stack.pop()
        parent = stack[-1][1]
        path = parent
        if dash:
            n = counts[parent] = counts.get(parent, -1) + 1
            path = f"{parent}[{n}]"
            out.append((path, parent or "$", "YamlScalar" if value and not key else "YamlMapping", f"[{n}]", path, "" if key else value))
            stack.append((indent, path))
        if key:
            child = f"{path}.{key.strip()}" if path else key.strip()
            out.append((child, path or "$", "YamlScalar" if value else "YamlMapping", key.strip(), child, value))
            stack.append((indent + (2 if dash else 0), child))
    return out


def script_units(text: str, kind: str) -> list[Row]:
    """Functions (or labels) of a shell, cmd or PowerShell text, each up to the next."""
    rx = {"shell": SHELL_FUNCTION, "cmd": CMD_LABEL, "powershell": POWERSHELL_FUNCTION}[kind]
    found = list(rx.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(m["name"], "$", "Function", m["name"], m["name"], text[m.start() : e].strip()) for m, e in zip(found, ends, strict=True)]


PARSERS = {
    "json": json_units, "xml": markup_units, "html": markup_units, "yaml": yaml_units, "yml": yaml_units, "sh": lambda t: script_units(t, "shell"),
    "bash": lambda t: script_units(t, "shell"), "cmd": lambda t: script_units(t, "cmd"), "bat": lambda t: script_units(t, "cmd"),
    "ps1": lambda t: script_units(t, "powershell")
}


def extracted(rows: DataFrame, id_col: str, text: str, format: str | None = None) -> DataFrame:
    """The units of each text; the format is given or the id's extension. A text that is of no known format, or not well formed, is one unit of type File."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, content in zip(batch["source_id"], batch["text"], strict=True):
                kind = format or source.rsplit(".", 1)[-1].lower()
                content = content or ""
                try:
                    units = PARSERS[kind](content)
                except (KeyError, ValueError):
                    units = [("$", None, "File", source, "", content)]
                out.extend((source, *u) for u in units)
            yield pd.DataFrame(out, columns=["source_id", "id", "parent_id", "type", "name", "path", "content"])

    return rows.select(F.col(id_col).cast("string").alias("source_id"), F.col(text).alias("text")).mapInPandas(parse, UNITS)


def with_children(units: DataFrame) -> DataFrame:
    """units with child_ids (sorted) filled from parent_id."""
    kids = units.filter(F.col("parent_id").isNotNull()).groupBy(F.col("source_id").alias("__s"), F.col("parent_id").alias("__p")).agg(F.array_sort(F.collect_list("id")).alias("child_ids"))
    out = units.join(kids, (F.col("source_id") == F.col("__s")) & (F.col("id") == F.col("__p")), "left").drop("__s", "__p")
    return out.withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>")))


def package_references(projects: DataFrame) -> DataFrame:
    """project, package, version of project files (project, content)."""
    refs = F.regexp_extract_all("content", F.lit(r'(<PackageReference\s[^>]*>)'), 1)
    each = projects.select("project", F.explode(refs).alias("x"))
    return each.select("project", F.regexp_extract("x", r'Include="([^"]*)"', 1).alias("package"), F.regexp_extract("x", r'Version="([^"]*)"', 1).alias("version"))
