"""Record schemas: declared once, rendered as JSON Schema, bridged to Spark types."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

KINDS = ("object", "string", "number", "integer", "boolean", "array", "null")


@dataclass(frozen=True)
class Schema:
    """A node of a record schema."""

    kind: str
    description: str = ""
    title: str = ""
    properties: dict[str, "Schema"] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    items: "Schema | None" = None
    values: tuple[str, ...] = ()
    format: str = ""
    nullable: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown schema kind {self.kind!r}")

    # Constructors.
    @staticmethod
    def string(description: str = "", values: tuple[str, ...] = (), format: str = "") -> "Schema":
        return Schema("string", description, values=tuple(values), format=format)

    @staticmethod
    def number(description: str = "") -> "Schema":
        return Schema("number", description)

    @staticmethod
    def integer(description: str = "") -> "Schema":
        return Schema("integer", description)

    @staticmethod
    def boolean(description: str = "") -> "Schema":
        return Schema("boolean", description)

    @staticmethod
    def moment(description: str = "") -> "Schema":
        return Schema("string", description, format="date-time")

    @staticmethod
    def array(items: "Schema", description: str = "") -> "Schema":
        return Schema("array", description, items=items)

    @staticmethod
    def record(title: str = "", about: str = "", /, **properties: "Schema") -> "Schema":
        required = tuple(k for k, v in properties.items() if not v.nullable)
        return Schema("object", about, title, dict(properties), required)

    def optional(self) -> "Schema":
        note = "May be null."
        return dataclasses.replace(self, nullable=True, description=f"{self.description} {note}".strip())

    def partial(self) -> "Schema":
        """The same record with nothing required, at any depth."""
        return dataclasses.replace(self, required=(), properties={k: v.partial() for k, v in self.properties.items()}, items=self.items.partial() if self.items else None)

    # What plans ask of a schema.
    def has_collection(self) -> bool:
        """Any array in the tree?  Tables reach a prompt only then."""
        return self.kind == "array" or any(p.has_collection() for p in self.properties.values()) or bool(self.items and self.items.has_collection())

    def leaves(self, path: str = "") -> list[tuple[str, "Schema"]]:
        """(path, node) of all scalars in property order; an array's element is ``path[]``."""
        if self.kind == "object":
            return [leaf for name, p in self.properties.items() for leaf in p.leaves(f"{path}.{name}" if path else name)]
        if self.kind == "array" and self.items is not None:
            return self.items.leaves(f"{path}[]")
        return [(path, self)]

    def guides(self, path: str = "") -> list[str]:
        """One line for each described path."""
        own = [f"- {path}: {self.description}"] if path and self.description else []
        below = [g for name, p in self.properties.items() for g in p.guides(f"{path}.{name}" if path else name)]
        return own + below + (self.items.guides(f"{path}[]") if self.items else [])

    def rendered(self) -> dict:
        out: dict = {"type": self.kind}
        for name in ("title", "description", "format"):
            if getattr(self, name):
                out[name] = getattr(self, name)
        if self.values:
            out["enum"] = list(self.values)
        if self.kind == "object":
            out["properties"] = {k: v.rendered() for k, v in self.properties.items()}
            out["required"] = list(self.required)
            out["x-propertyOrder"] = list(self.properties)
        if self.items is not None:
            out["items"] = self.items.rendered()
        return out

    def text(self) -> str:
        return json.dumps(self.rendered(), indent=2, ensure_ascii=False)

    def spark_type(self) -> T.DataType:
        """The typed form; a partial record is the same type, all fields being nullable."""
        if self.kind == "object":
            return T.StructType([T.StructField(k, v.spark_type()) for k, v in self.properties.items()])
        if self.kind == "array":
            return T.ArrayType(self.items.spark_type() if self.items else T.StringType())
        if self.kind == "string":
            return T.TimestampType() if self.format == "date-time" else T.DateType() if self.format == "date" else T.StringType()
        return {"number": T.DecimalType(38, 18), "integer": T.LongType(), "boolean": T.BooleanType(), "null": T.NullType()}[self.kind]

    def raw_type(self) -> T.DataType:
        """The form before lenient reading: every scalar a string."""
        if self.kind == "object":
            return T.StructType([T.StructField(k, v.raw_type()) for k, v in self.properties.items()])
        if self.kind == "array":
            return T.ArrayType(self.items.raw_type() if self.items else T.StringType())
        return T.StringType()


def from_rendered(node: dict) -> Schema:
    """A schema read back from its JSON Schema text."""
    properties = {k: from_rendered(v) for k, v in node.get("properties", {}).items()}
    order = node.get("x-propertyOrder") or list(properties)
    required = tuple(node.get("required", ()))
    return Schema(
        node["type"], node.get("description", ""), node.get("title", ""), {k: dataclasses.replace(properties[k], nullable=k not in required) for k in order}, required,
        from_rendered(node["items"]) if "items" in node else None, tuple(node.get("enum", ())), node.get("format", ""), "May be null." in node.get("description", ""),
    )


# The record types of the extraction pipeline.
INVOICE = Schema.record("Invoice", vendor=Schema.string(), dueDate=Schema.moment(), total=Schema.number(), lineItems=Schema.array(Schema.record(description=Schema.string(), amount=Schema.number(), quantity=Schema.integer())))
RECEIPT = Schema.record("Receipt", merchant=Schema.string(), date=Schema.moment(), total=Schema.number(), currency=Schema.string(), items=Schema.array(Schema.record(name=Schema.string(), price=Schema.number(), quantity=Schema.integer().optional())))
IDENTITY = Schema.record(
    "IdentityDocument", documentType=Schema.string(values=("passport", "nationalId", "driverLicense", "residencePermit", "other")), fullName=Schema.string(), documentNumber=Schema.string(), dateOfBirth=Schema.moment(),
    expiryDate=Schema.moment().optional(), issueDate=Schema.moment().optional(), nationality=Schema.string().optional(), issuingAuthority=Schema.string().optional(), sex=Schema.string().optional(), address=Schema.string().optional(),
)
EVAL_INVOICE = Schema.record(
    "EvalInvoice", invoiceNumber=Schema.string().optional(), currency=Schema.string().optional(), sellerName=Schema.string().optional(), issueDate=Schema.moment().optional(), grandTotal=Schema.number().optional(), taxTotal=Schema.number().optional(),
    lineItems=Schema.array(Schema.record(description=Schema.string().optional(), quantity=Schema.number().optional(), lineTotal=Schema.number().optional())).optional(),
)
