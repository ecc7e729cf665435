"""Deeply nested records to flat tables with parent links, by single-pass tagged emission.

A depth-first visitor gives one row per object: the tag of its table, its primary key (root key and path), its
parent's key and its payload. All rows of all tables leave in one pass over the input, are written once partitioned
by tag, and a table is read from its own folder with its schema applied.

Two visitors: ``emit_structs`` walks a declared schema and is one native expression; ``emit_json`` walks raw JSON
whose depth is not known beforehand and streams Arrow batches. Neither shuffles; nothing is grouped, so a record
with a third of all objects only makes its own task longer by the length of its row.

Defined results: a null array, map or object gives no rows; a null element gives none but keeps its place; a null
root key is kept; a record without children still gives its own row; text that is no JSON object goes to the tag
``_corrupt`` with the raw text (``Tagged.corrupt``); an object may be nested to any depth; a lone half of a surrogate pair becomes '?'. Columns not named are dropped, so extra columns cannot clash.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, spread


def _is_child(t: T.DataType) -> bool:
    return isinstance(t, (T.StructType, T.MapType)) or (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType))


def _join(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def payload_schemas(schema: T.StructType, tags: dict[str, str], path: str = "") -> dict[str, T.StructType]:
    """Schema of each table: the fields of the node at ``path`` that are not tables themselves."""
    out = {tags[path]: T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields if _join(path, f.name) not in tags])}
    for f in schema.fields:
        below = _join(path, f.name)
        if below in tags:
            if isinstance(f.dataType, T.MapType):
                out[tags[below]] = T.StructType([T.StructField("name", f.dataType.keyType), T.StructField("value", f.dataType.valueType)])
            else:
                t = f.dataType if isinstance(f.dataType, T.StructType) else f.dataType.elementType
                out |= payload_schemas(t, tags, below)
    return out


def _visit(node: Column, schema: T.StructType, path: str, pos: list[Column], up: tuple[str, list[Column]] | None, tags, payloads) -> Column:
    """Array of emitted rows of a non-null struct and all below it."""

    def row(tag: str, place: list[Column], parent: tuple[str, list[Column]] | None, payload: Column) -> Column:
        fields = [payload.alias(t) if t == tag else F.lit(None).cast(s).alias(t) for t, s in payloads.items()]
        ints = lambda p: F.array(*p).cast("array<int>")
        return F.struct(
            F.lit(tag).alias("tag"),
            ints(place).alias("pos"),
            F.lit(parent[0] if parent else None).cast("string").alias("parent_tag"),
            (ints(parent[1]) if parent else F.lit(None).cast("array<int>")).alias("parent_pos"),
            F.struct(*fields).alias("payload"),
        )

    def entry_of(below: str, here: tuple):
        return lambda e, i: row(tags[below], [*pos, i], here, F.struct(e["key"].alias("name"), e["value"].alias("value")))

    def element_of(below: str, here: tuple, t: T.StructType):
        return lambda e, i: F.when(e.isNotNull(), _visit(e, t, below, [*pos, i], here, tags, payloads))

    tag = tags[path]
    own = F.struct(*(node[f.name].alias(f.name) for f in payloads[tag].fields)) if payloads[tag].fields else F.struct()
    parts = [F.array(row(tag, pos, up, own))]
    for f in schema.fields:
        below = _join(path, f.name)
        if below not in tags:
            continue
        child, here = node[f.name], (tag, pos)
        if isinstance(f.dataType, T.StructType):
            rows = _visit(child, f.dataType, below, [*pos, F.lit(0)], here, tags, payloads)
            parts.append(F.when(child.isNotNull(), rows))
        elif isinstance(f.dataType, T.MapType):
            parts.append(F.transform(F.map_entries(child), entry_of(below, here)))
        else:
            rows = F.transform(child, element_of(below, here, f.dataType.elementType))
            parts.append(F.flatten(F.filter(rows, lambda a: a.isNotNull())))
    empty = F.slice(parts[0], 1, 0)
    return F.concat(parts[0], *(F.coalesce(p, empty) for p in parts[1:])) if len(parts) > 1 else parts[0]


@dataclass
class Tagged:
    """Emitted rows ``tag, root, pos, parent_tag, parent_pos, payload`` of one pass."""

    rows: DataFrame
    schemas: dict[str, T.StructType] = field(default_factory=dict)
    stored: bool = False

    def store(self, name: str = "tagged") -> Tagged:
        """Write once, one folder per tag."""
        return Tagged(materialize(self.rows, name, partition_by="tag"), self.schemas, True)

    def corrupt(self) -> DataFrame:
        """``root`` and raw ``value`` of input that was no JSON object."""
        return self.rows.where(F.col("tag") == "_corrupt").select("root", F.col("payload").alias("value"))

    def table(self, tag: str) -> DataFrame:
        """Rows of one table: ``root``, ``pos``, the parent's key, and the payload's fields under the table's schema."""
        rows = self.rows.where(F.col("tag") == tag)
        keys = ["root", "pos", "parent_tag", "parent_pos"]
        if isinstance(self.rows.schema["payload"].dataType, T.StringType):
            rows = rows.withColumn("payload", F.from_json("payload", self.schemas[tag]))
            fields = [F.col(f"payload.{f.name}") for f in self.schemas[tag].fields]
        else:
            fields = [F.col(f"payload.{tag}.{f.name}") for f in self.schemas[tag].fields]
        extra = [c for c in ("path", "parent_path", "outer_pos", "inner_pos") if c in rows.columns]
        return rows.select(*keys, *extra, *fields)


def emit_structs(df: DataFrame, key: str, tags: dict[str, str]) -> Tagged:
    """One row per object of typed nested columns. ``tags``: path of a nested field ('' for the record) to table name."""
    wanted = T.StructType([f for f in df.schema.fields if f.name != key])
    payloads = payload_schemas(wanted, tags)
    record = F.struct(*(F.col(f.name).alias(f.name) for f in wanted.fields))
    rows = spread(df).select(F.col(key).alias("root"), F.explode(_visit(record, wanted, "", [], None, tags, payloads)).alias("r"))
    return Tagged(rows.select("r.tag", "root", "r.pos", "r.parent_tag", "r.parent_pos", "r.payload"), payloads)


_HELD = 16_000_000  # characters held before they become a batch


@dataclass(frozen=True)
class Marked:
    """A table of raw JSON: objects that have ``marker``; ``hoist``: keys looked up anywhere inside the object."""

    tag: str
    marker: str
    hoist: tuple[str, ...] = ()


_TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<mark>[{}\[\],:])|(?P<string>")|(?P<word>true|false|null|NaN|-?Infinity|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?))')


def _parse_deep(text: str):
    """JSON of any depth, with a stack of its own: what ``json.loads`` gives where it does not give up."""
    open_: list = []  # (container, its key so far)
    at, want, root = 0, "value", None
    while True:
        found = _TOKEN.match(text, at)
        if found is None or not found.group():
            raise ValueError(f"no JSON at {at}")
        at, mark = found.end(), found["mark"]
        if want in ("key", "first key") and found["string"]:
            key, at = json.decoder.scanstring(text, at)
            colon = _TOKEN.match(text, at)
            if colon is None or colon["mark"] != ":":
                raise ValueError(f"no colon at {at}")
            open_[-1][1], at, want = key, colon.end(), "value"
            continue
        if want in ("value", "first value") and (mark in ("{", "[") or not mark):
            if mark:
                value = {} if mark == "{" else []
            elif found["string"]:
                value, at = json.decoder.scanstring(text, at)
            else:
                value = json.loads(found["word"])
            if not open_:
                root = value
            elif isinstance(open_[-1][0], dict):
                open_[-1][0][open_[-1][1]] = value
            else:
                open_[-1][0].append(value)
            if mark:
                open_.append([value, None])
                want = "first key" if mark == "{" else "first value"
            else:
                want = "next"
        elif mark == "," and want == "next":
            want = "key" if isinstance(open_[-1][0], dict) else "value"
        elif mark in ("}", "]") and want in ("next", "first key" if mark == "}" else "first value") and isinstance(open_[-1][0], dict if mark == "}" else list):
            open_.pop()
            want = "next"
        else:
            raise ValueError(f"no JSON at {found.start()}")
        if not open_:
            if text[at:].strip(" \t\n\r"):
                raise ValueError(f"more than one value at {at}")
            return root


def _parse(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _dump(value) -> str:
    """Compact JSON of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        out: list[str] = []
        todo: list = [value]
        while todo:
            v = todo.pop()
            if isinstance(v, _Text):
                out.append(v)
            elif isinstance(v, dict):
                inner = [x for k, y in v.items() for x in (_Text(","), _Text(json.dumps(k, ensure_ascii=False) + ":"), y)][1:]
                todo += [_Text("}"), *reversed(inner), _Text("{")]
            elif isinstance(v, list):
                inner = [x for y in v for x in (_Text(","), y)][1:]
                todo += [_Text("]"), *reversed(inner), _Text("[")]
            else:
                out.append(json.dumps(v, ensure_ascii=False))
        return "".join(out)


class _Text(str):
    """Text that is written as it stands."""


def _hoist(root: dict, name: str, marker: str):
    """First non-null value of ``name``, the object's own before deeper ones in document order; other marked objects are not entered."""
    todo: list = [root]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            if value is not root and marker in value:
                continue
            if value.get(name) is not None:
                return value[name]
            todo += reversed(list(value.values()))
        elif isinstance(value, list):
            todo += reversed(value)
    return None


def _flat(value) -> bool:
    return not isinstance(value, dict) and not (isinstance(value, list) and any(isinstance(x, (dict, list)) for x in value))


def _walk(root: dict, marked: tuple[Marked, ...], schemas: dict[str, T.StructType], emit) -> None:
    """Depth first, in document order, with a stack of its own. Payloads hold the fields of their table's schema."""
    names = {tag: set(schema.fieldNames()) for tag, schema in schemas.items()}
    todo: list[tuple] = [(root, "", [], False, (None, None, None))]
    while todo:
        value, path, idx, in_list, up = todo.pop()
        if isinstance(value, list):
            todo += [(v, f"{path}[{i}]", [*idx, i], True, up) for i, v in reversed(list(enumerate(value))) if isinstance(v, (dict, list))]
            continue
        mark = next((m for m in marked if m.marker in value), None)
        rest = idx[:-1] if in_list else idx
        tag = mark.tag if mark else ("record" if not path else "node")
        wanted = names.get(tag)
        body = {k: v for k, v in value.items() if (wanted is None or k in wanted) and (mark or _flat(v))}
        if mark:
            for name in mark.hoist:
                found = _hoist(value, name, mark.marker)
                if found is None:
                    body.pop(name, None)
                else:
                    body[name] = found if isinstance(found, str) else _dump(found)
        emit(tag, path, idx, up, rest[-1] if rest else 0, idx[-1] if in_list else 0, body)
        below = [(v, f"{path}.{k}" if path else k, idx, False, (tag, path, idx)) for k, v in value.items() if isinstance(v, (dict, list))]
        todo += reversed(below)


_JSON_ROWS = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("root", T.LongType()),
        T.StructField("pos", T.ArrayType(T.IntegerType())),
        T.StructField("parent_tag", T.StringType()),
        T.StructField("parent_pos", T.ArrayType(T.IntegerType())),
        T.StructField("path", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("outer_pos", T.IntegerType()),
        T.StructField("inner_pos", T.IntegerType()),
        T.StructField("payload", T.StringType()),
    ]
)


def _array(values: tuple, kind: pa.DataType) -> pa.Array:
    """Arrow array; halves of surrogate pairs that JSON escapes leave behind become question marks."""
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], kind)


def emit_json(df: DataFrame, key: str, value: str, marked: tuple[Marked, ...], schemas: dict[str, T.StructType]) -> Tagged:
    """One row per object of raw JSON text, whatever its depth: ``record`` (the root), one tag per ``Marked``, else ``node``.

    ``outer_pos``: place of the nearest array element around the object's list (0 if none); ``inner_pos``: place in
    its list (0 if it stands alone).
    """
    arrow = pa.schema(
        [
            ("tag", pa.string()), ("root", pa.int64()), ("pos", pa.list_(pa.int32())), ("parent_tag", pa.string()), ("parent_pos", pa.list_(pa.int32())),
            ("path", pa.string()), ("parent_path", pa.string()), ("outer_pos", pa.int32()), ("inner_pos", pa.int32()), ("payload", pa.string()),
        ]
    )

    def run(batches):
        out: list[tuple] = []
        size = 0

        def flush():
            nonlocal size
            cols = list(zip(*out))
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for root, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    parsed = _parse(text)
                    if not isinstance(parsed, dict):
                        raise ValueError("no object")
                except ValueError:
                    out.append(("_corrupt", root, [], None, None, "", None, 0, 0, text))
                    size += len(text)
                    continue

                def emit(tag, path, idx, up, outer, inner, body, root=root):
                    nonlocal size
                    payload = _dump(body)
                    size += len(payload) + 2 * len(path) + 12 * len(idx)
                    out.append((tag, root, idx, up[0], up[2], path, up[1], outer, inner, payload))

                _walk(parsed, marked, schemas, emit)
                if size > _HELD or len(out) > 20_000:
                    yield flush()
        if out:
            yield flush()

    rows = spread(df.select(F.col(key).cast("bigint"), F.col(value).cast("string"))).mapInArrow(run, _JSON_ROWS)
    return Tagged(rows, schemas)
