"""Schemas of property graphs: a small YAML dialect, checks and status codes."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

DEFAULT_LENGTH = 10


class Status(Enum):
    OK = "ok"
    DELETED = "deleted"
    NOT_FOUND = "not_found"
    INVALID_ARGUMENT = "invalid_argument"
    IO_ERROR = "io_error"
    CORRUPTION = "corruption"
    BACKGROUND_ERROR = "background_error"


class GraphError(Exception):
    def __init__(self, status: Status, message: str) -> None:
        super().__init__(f"{status.value}: {message}")
        self.status = status


@dataclass
class Group:
    name: str
    properties: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class GraphSchema:
    max_vertex_num: int
    groups: list[Group]
    node: Group
    lengths: dict[str, int] = field(default_factory=dict)
    max_property_length: int = DEFAULT_LENGTH
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        bad = lambda text: GraphError(Status.INVALID_ARGUMENT, text)
        if self.max_vertex_num <= 0:
            raise bad("max_vertex_num must be above 0")
        if not self.groups:
            raise bad("edge_shards is empty")
        seen: set[str] = set()
        for g in self.groups:
            if not g.properties:
                raise bad(f"group {g.name} has no properties")
            for p in g.properties:
                if p in seen:
                    raise bad(f"edge property {p} is in two groups")
                seen.add(p)

    def length(self, name: str) -> int:
        return self.lengths.get(name, self.max_property_length)

    def edge_type(self, group: Group) -> T.StructType:
        key = [("src", T.LongType()), ("dst", T.LongType()), ("is_out", T.BooleanType()), ("edge_type", T.ShortType()), ("seq", T.LongType()), ("deleted", T.BooleanType())]
        return T.StructType([T.StructField(n, t) for n, t in key] + [T.StructField(p, T.StringType()) for p in group.properties])

    def node_type(self) -> T.StructType:
        return T.StructType([T.StructField("vid", T.LongType()), T.StructField("seq", T.LongType())] + [T.StructField(p, T.StringType()) for p in self.node.properties])


ROOT_KEYS = ("max_vertex_num", "use_csr_disk", "sub_property_num", "max_property_length", "system_threads")
GROUP_KEYS = ("memtable_size", "is_csr", "csr_l0_max_sst_num", "csr_l1_max_sst_num")
SECTIONS = ("property_defs", "edge_shards", "node_db")


def _value(text: str) -> str | list[str]:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def _without_comment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#":
            return line[:i]
    return line


def parse_schema(text: str) -> GraphSchema:
    """Read the dialect; an unknown key or misplaced line is an invalid argument with its number."""
    root: dict[str, str] = {}
    items: dict[str, list[dict]] = {s: [] for s in SECTIONS}
    section = ""
    for n, line in enumerate(text.splitlines(), 1):
        bare = _without_comment(line).strip()
        if not bare or bare == "---":
            continue
        fail = GraphError(Status.INVALID_ARGUMENT, f"line {n}: {bare}")
        fresh = bare.startswith("- ")
        key, colon, value = bare.removeprefix("- ").partition(":")
        key = key.strip()
        if not colon:
            if not (fresh and section in ("edge_shards", "node_db") and items[section]):
                raise fail
            items[section][-1].setdefault("properties", []).append(_value(key))  # a list written line by line
            continue
        if key in SECTIONS and not value.strip() and not fresh:
            section = key
            if key == "node_db":
                items[key].append({})
            continue
        if key in ROOT_KEYS:
            root[key] = _value(value)
            continue
        allowed = ("name", "length") if section == "property_defs" else ("name", "properties", *GROUP_KEYS)
        if not section or key not in allowed:
            raise fail
        if fresh and section != "node_db":
            items[section].append({})
        if not items[section]:
            raise fail
        items[section][-1][key] = _value(value) if value.strip() else []
    try:
        number = {k: int(root[k]) for k in ("max_vertex_num", "max_property_length") if k in root}
        lengths = {d["name"]: int(d["length"]) for d in items["property_defs"] if "length" in d}
        groups = [Group(d["name"], list(d.get("properties", [])), {k: d[k] for k in GROUP_KEYS if k in d}) for d in items["edge_shards"]]
    except (KeyError, ValueError) as e:
        raise GraphError(Status.INVALID_ARGUMENT, f"bad value: {e}") from e
    node = items["node_db"][-1] if items["node_db"] else {}
    return GraphSchema(number.get("max_vertex_num", 0), groups, Group(node.get("name", "node_db"), list(node.get("properties", []))), lengths, number.get("max_property_length", DEFAULT_LENGTH), root)


def load_schema(path: str) -> GraphSchema:
    if not os.path.exists(path):
        raise GraphError(Status.IO_ERROR, f"no file {path}")
    with open(path) as f:
        return parse_schema(f.read())
