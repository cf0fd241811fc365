"""Declared schemas. A field may be optional (missing) and nullable (null); these are two things.

Spark has one null. A field that is both optional and nullable has a Boolean companion column
that tells whether it is there; for all others the null says enough.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS: dict[str, T.DataType] = {
    "string": T.StringType(), "boolean": T.BooleanType(), "number": T.DoubleType(), "int64": T.LongType(), "uint64": T.DecimalType(20, 0),
    "decimal": T.DecimalType(38, 18), "wide_decimal": T.StringType(), "enum": T.IntegerType(),
}
MAX_FIELDS, MAX_ROW_BYTES, MAX_STRING_BYTES, MAX_KEY_BYTES = 64, 65_536, 4096, 512


@dataclass(frozen=True)
class Field:
    path: str
    kind: str
    optional: bool = False
    nullable: bool = False
    domain: Mapping[str, int] = field(default_factory=dict, hash=False)  # labels of an enum; several may share a code
    type: T.DataType | None = field(default=None, hash=False)  # another Spark type for the kind
    held: str | None = None  # a column that holds the state, as groups have it for their keys

    @property
    def companion(self) -> str:
        return "__has_" + self.path.replace(".", "__")

    @property
    def has_companion(self) -> bool:
        return self.optional and self.nullable and not self.held

    @property
    def spark_type(self) -> T.DataType:
        return self.type or KINDS[self.kind]

    @property
    def column(self) -> Column:
        return F.col(self.path)

    @property
    def present(self) -> Column:
        """Not missing; a null that may stand there is present."""
        if self.held:
            return F.col(self.held) > 0
        if self.has_companion:
            return F.coalesce(F.col(self.companion), F.lit(False))
        return self.column.isNotNull() if self.optional else F.lit(True)

    @property
    def missing(self) -> Column:
        return ~self.present

    @property
    def null(self) -> Column:
        return self.present & self.column.isNull()

    @property
    def state(self) -> Column:
        """0 missing, 1 null, 2 value: the native order."""
        if self.held:
            return F.col(self.held)
        return F.when(self.column.isNotNull(), 2).when(self.present, 1).otherwise(0)


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    key: str

    def __post_init__(self) -> None:
        paths = [f.path for f in self.fields]
        if not 1 <= len(paths) <= MAX_FIELDS or len(set(paths)) < len(paths):
            raise ValueError("a schema has 1 to 64 distinct fields")
        if any(f.kind not in KINDS for f in self.fields):
            raise ValueError("unknown kind")
        if any(a != b and a.startswith(f"{b}.") for a in paths for b in paths):
            raise ValueError("a field can't be a parent too")

    def __getitem__(self, path: str) -> Field:
        for f in self.fields:
            if f.path == path:
                return f
        raise KeyError(f"unknown field {path}")

    @property
    def companions(self) -> list[str]:
        return [f.companion for f in self.fields if f.has_companion]

    @property
    def parents(self) -> list[str]:
        return list(dict.fromkeys(f.path.rpartition(".")[0] for f in self.fields if "." in f.path))

    def spark(self) -> T.StructType:
        """The schema to read with; nested paths are structs, companions stand at the end."""
        tree: dict = {}
        for f in self.fields:
            *above, leaf = f.path.split(".")
            node = tree
            for step in above:
                node = node.setdefault(step, {})
            node[leaf] = f
        def build(node: dict) -> T.StructType:
            return T.StructType([T.StructField(n, build(x), True) if isinstance(x, dict) else T.StructField(n, x.spark_type, x.optional or x.nullable, {"kind": x.kind, "optional": x.optional, "nullable": x.nullable}) for n, x in node.items()])
        return T.StructType([*build(tree).fields, *(T.StructField(c, T.BooleanType(), True) for c in self.companions)])

    def fingerprint(self) -> str:
        """Identity of the definition; queries and batches may present it."""
        spec = [(f.path, f.kind, f.optional, f.nullable, sorted(f.domain.items())) for f in self.fields]
        return sha256(repr((self.key, spec)).encode()).hexdigest()

    def scan(self, spark: SparkSession, path: str, format: str = "parquet", streaming: bool = False) -> DataFrame:
        """Reads with the declared schema, never an inferred one."""
        return (spark.readStream if streaming else spark.read).schema(self.spark()).format(format).load(path)


def flat(key: str, *fields: tuple) -> Schema:
    """Schema of (path, kind, flags) with flags of "o" and "n"."""
    return Schema(tuple(Field(p, k, "o" in "".join(x), "n" in "".join(x)) for p, k, *x in fields), key)
