"""Schemas: an ordered list of typed fields, one of them the time field."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import BadRequest

TYPES = ("int", "float", "bool", "string", "text", "decimal", "timestamp", "json")
NUMERIC = ("int", "timestamp", "decimal", "float")
TEXTUAL = ("string", "text")
MAX_SCALE = 38
#: Columns that the store adds: place in ingest order, and block.
SEQ, BLOCK = "_seq", "_block"


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    scale: int | None = None

    @property
    def spark(self) -> T.DataType:
        return {
            "int": T.LongType(),
            "timestamp": T.LongType(),  # milliseconds since the epoch
            "float": T.DoubleType(),
            "bool": T.BooleanType(),
            "decimal": T.DecimalType(38, self.scale or 0),
        }.get(self.type, T.StringType())


@dataclass(frozen=True)
class Schema:
    time_field: str
    fields: tuple[Field, ...]

    @staticmethod
    def parse(source: str | bytes | dict) -> Schema:
        """From JSON: {"timestamp_field": name, "fields": [{"name", "type", "scale"}]}."""
        try:
            spec = json.loads(source) if isinstance(source, (str, bytes)) else source
            items = spec["fields"]
            time_field = spec["timestamp_field"]
        except (ValueError, TypeError, KeyError) as e:
            raise BadRequest(f"not a schema: {e}") from None
        if not isinstance(items, list) or not items:
            raise BadRequest("a schema needs a field")
        fields: list[Field] = []
        for item in items:
            if not isinstance(item, dict) or not isinstance(item.get("name"), str) or not item["name"]:
                raise BadRequest("a field needs a name")
            name, kind, scale = item["name"], item.get("type"), item.get("scale")
            if kind not in TYPES:
                raise BadRequest(f"field {name!r} has an unknown type")
            if any(f.name == name for f in fields):
                raise BadRequest(f"field {name!r} is named twice")
            if kind == "decimal":
                if isinstance(scale, bool) or not isinstance(scale, int) or not 0 <= scale <= MAX_SCALE:
                    raise BadRequest(f"field {name!r} needs a scale from 0 to {MAX_SCALE}")
            elif scale is not None:
                raise BadRequest(f"field {name!r} has a scale but is no decimal")
            fields.append(Field(name, kind, scale))
        out = Schema(time_field, tuple(fields))
        if not isinstance(time_field, str) or out.get(time_field) is None or out[time_field].type != "timestamp":
            raise BadRequest("the time field must be a field of type timestamp")
        return out

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def __getitem__(self, name: str) -> Field:
        f = self.get(name)
        if f is None:
            raise BadRequest(f"unknown field {name!r}")
        return f

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def spark(self) -> T.StructType:
        """The stored columns."""
        cols = [T.StructField(f.name, f.spark, f.name != self.time_field, {"logical": f.type}) for f in self.fields]
        return T.StructType([T.StructField(SEQ, T.LongType(), False), T.StructField(BLOCK, T.LongType(), False), *cols])

    def canonical(self) -> str:
        """The same text for equal schemas."""
        fields = [{"name": f.name, "type": f.type} | ({"scale": f.scale} if f.type == "decimal" else {}) for f in self.fields]
        return json.dumps({"timestamp_field": self.time_field, "fields": fields}, ensure_ascii=False)

    def check_successor(self, new: Schema) -> None:
        """A later schema may only add fields at its end."""
        if new.time_field != self.time_field:
            raise BadRequest("the time field cannot change")
        if new.fields[: len(self.fields)] != self.fields:
            raise BadRequest("fields cannot be removed, renamed, reordered or change their type")
