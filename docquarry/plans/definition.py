"""Collection definitions: declared paths and their types, indexes, write rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions import pointer
from .errors import invalid

# Types, analyzers and limits of definitions.
TYPES = ("string", "number", "boolean", "decimal", "string_array", "number_array")
ANALYZERS = ("unicode_v1", "english_v1", "japanese_v1")
WRITE_MODES = ("mutable", "append_only")
MAX_INDEXES, MAX_INDEX_FIELDS, MAX_ARRAY = 64, 8, 4096


@dataclass(frozen=True)
class IndexField:
    """A declared path.

    scale: decimal places of the stored DECIMAL(38, scale); a value that does
    not fit exactly is an error.  wide: numbers of up to 100 digits, kept as
    ordered text; slower, and exact without limit of scale.
    """

    path: str
    type: str = "string"
    scale: int = 6
    wide: bool = False


@dataclass(frozen=True)
class Index:
    name: str
    fields: tuple[IndexField, ...]
    unique: bool = False
    text: str | None = None


@dataclass
class CollectionDefinition:
    name: str
    indexes: list[Index] = field(default_factory=list)
    schema: dict[str, Any] | None = None
    write_mode: str = "mutable"
    retention_class: str = "standard"
    archivable: bool = False
    strict_read_audit: bool = False

    def __post_init__(self) -> None:
        check_name(self.name, "collection")
        if self.write_mode not in WRITE_MODES:
            raise invalid(f"`write_mode` is one of {', '.join(WRITE_MODES)}")
        if len(self.indexes) > MAX_INDEXES:
            raise invalid(f"a collection has at most {MAX_INDEXES} indexes")
        names: set[str] = set()
        self.fields: dict[str, IndexField] = {}
        for index in self.indexes:
            check_name(index.name, "index")
            if index.name in names:
                raise invalid(f"index `{index.name}` is declared twice")
            names.add(index.name)
            if not 1 <= len(index.fields) <= MAX_INDEX_FIELDS:
                raise invalid(f"an index has 1 to {MAX_INDEX_FIELDS} fields")
            if len({f.path for f in index.fields}) < len(index.fields):
                raise invalid(f"index `{index.name}` repeats a field")
            for f in index.fields:
                pointer.tokens(f.path)
                if f.type not in TYPES:
                    raise invalid(f"unknown type `{f.type}`")
                if index.text and f.type not in ("string", "string_array"):
                    raise invalid("text indexes cover strings and string arrays")
                if index.unique and f.type.endswith("_array"):
                    raise invalid("unique indexes cover scalars")
                if self.fields.setdefault(f.path, f) != f:
                    raise invalid(f"`{f.path}` has two types")
            if index.text and (index.text not in ANALYZERS or index.unique):
                raise invalid(f"`text` is one of {', '.join(ANALYZERS)}, and not unique")

    def text_index(self, name: str) -> Index | None:
        return next((i for i in self.indexes if i.name == name and i.text), None)

    def columns(self) -> dict[str, str]:
        """A column prefix for each declared path; the same for the same paths."""
        return {p: f"f{i}" for i, p in enumerate(sorted(self.fields))}

    def to_json(self) -> dict[str, Any]:
        indexes = [
            {"name": i.name, "fields": [{"path": f.path, "type": f.type, "scale": f.scale, "wide": f.wide} for f in i.fields], "unique": i.unique, "text": i.text}
            for i in self.indexes
        ]
        return {"name": self.name, "indexes": indexes, "schema": self.schema, "write_mode": self.write_mode, "retention_class": self.retention_class, "archivable": self.archivable, "strict_read_audit": self.strict_read_audit}

    @staticmethod
    def from_json(value: dict[str, Any]) -> CollectionDefinition:
        indexes = [Index(i["name"], tuple(IndexField(**f) for f in i["fields"]), i["unique"], i["text"]) for i in value["indexes"]]
        return CollectionDefinition(**(value | {"indexes": indexes}))


def check_name(name: Any, what: str) -> None:
    if not isinstance(name, str) or not 1 <= len(name.encode()) <= 256 or any(ord(c) < 32 or ord(c) == 127 for c in name):
        raise invalid(f"a {what} name has 1 to 256 bytes and no control characters")
