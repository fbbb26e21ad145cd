"""Field definitions of an activity stream, and what may change about them."""

from __future__ import annotations

from dataclasses import dataclass

#: type -> features; a first index holds the earliest row of each value only
TYPES: dict[str, frozenset[str]] = {
    "singleTerm": frozenset({"indexed", "stored"}),
    "singleTermNonStored": frozenset({"indexed"}),
    "singleTermIndexLatest": frozenset({"indexed", "latest"}),
    "singleTermIndexLatestNonStored": frozenset({"indexed", "latest"}),
    "singleTermIndexFirst": frozenset({"first"}),
    "singleTermIndexFirstNonStored": frozenset({"first"}),
    "multiTerm": frozenset({"indexed", "multi", "stored"}),
    "multiTermNonStored": frozenset({"indexed", "multi"}),
    "multiTermIndexFirst": frozenset({"first", "multi"}),
    "multiTermIndexFirstNonStored": frozenset({"first", "multi"}),
    "multiTermCardinality": frozenset({"indexed", "multi", "cardinality", "stored"}),
    "multiTermCardinalityNonStored": frozenset({"indexed", "multi", "cardinality"}),
    "singleTermIndexValueBits": frozenset({"bits"}),
    "nonIndexed": frozenset({"stored"}),
    "nonIndexedNonStored": frozenset(),
}
#: type -> types that may become it; any type may become nonIndexedNonStored
BECOMES = {
    "singleTermIndexValueBits": ("singleTerm",),
    "singleTerm": ("singleTermIndexValueBits",),
    "singleTermNonStored": ("singleTerm", "singleTermIndexValueBits"),
    "multiTermNonStored": ("multiTerm",),
}
PREFIXES = ("none", "wildcard", "raw", "numeric")
#: A value of a field: not empty, and no longer than this.
LONGEST_VALUE = 4096


@dataclass(frozen=True)
class Field:
    """A field: its name, type, prefix kind (with width and separator) and the parts of a composite."""

    name: str
    type: str = "singleTerm"
    prefix: str = "none"
    width: int = 0
    separator: str = " "
    parts: tuple[str, ...] = ()

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"no field type {self.type}")
        if self.prefix not in PREFIXES:
            raise ValueError(f"no prefix kind {self.prefix}")
        if self.prefix == "numeric" and self.width not in (4, 8):
            raise ValueError("a numeric prefix has 4 or 8 bytes")

    @property
    def features(self) -> frozenset[str]:
        return TYPES[self.type]

    @property
    def multi(self) -> bool:
        return "multi" in self.features or bool(self.parts)

    @property
    def column(self) -> str:
        return f"f_{self.name}"

    @property
    def first_column(self) -> str:
        return f"first_{self.name}"

    def additive(self, old: Field) -> bool:
        """May ``old`` become this?  The type may change as BECOMES lists it; the rest stays."""
        same = (self.name, self.prefix, self.width, self.separator, self.parts) == (old.name, old.prefix, old.width, old.separator, old.parts)
        return same and (self.type in (old.type, "nonIndexedNonStored") or old.type in BECOMES.get(self.type, ()))


@dataclass(frozen=True)
class Schema:
    """Fields and properties under a name and a version."""

    name: str
    version: int
    fields: tuple[Field, ...]
    properties: tuple[str, ...] = ()

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def additive(self, old: Schema) -> bool:
        """Every field and property of ``old`` is here still, changed at most in ways that add."""
        return self.name == old.name and self.version >= old.version and set(old.properties) <= set(self.properties) and all((f := self.field(o.name)) is not None and f.additive(o) for o in old.fields)


#: The fields of activities, and the property that lists streams that have read one.
ACTIVITY_FIELDS = (
    "objectId", "viewClassName", "verbSubjectClassName", "metaClassName", "metaId", "participantIds", "activityParent", "containerId",
    "authorId", "mentionedContainerIds", "mentionedUserIds", "tagIds", "tags", "status", "containerIds",
)
DEFAULT_SCHEMA = Schema("activityStream", 1, tuple(Field(x) for x in ACTIVITY_FIELDS), ("readStreamIds",))
