"""Column types: SQL spelling, the Spark type that carries them, and write checks.

Spark has no unsigned integers, enums or nanosecond timestamps. Those travel
in a wider Spark type; the column's metadata under TYPE_KEY holds the type's
own text, from which range and variant checks are made.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import InvalidSchema

TIME = "time"
TYPE_KEY = "tidemark_type"


@dataclass(frozen=True)
class ColumnType:
    #: Canonical name: INT, UINT8.., TIMESTAMP, ARRAY, STRUCT, ENUM and so on.
    name: str
    args: tuple = ()
    tz: bool = False
    #: Spelling kept for SHOW CREATE TABLE where it differs from the name.
    spelled: str | None = None
    fields: tuple[tuple[str, "ColumnType"], ...] = field(default=())

    @property
    def sql(self) -> str:
        if self.name == "ARRAY":
            return f"ARRAY<{self.fields[0][1].sql}>"
        if self.name == "STRUCT":
            return "STRUCT<" + ", ".join(f"{n} {t.sql}" for n, t in self.fields) + ">"
        if self.name == "ENUM":
            return "ENUM(" + ", ".join("'" + v.replace("'", "''") + "'" for v in self.args) + ")"
        base = self.spelled or SQL_NAMES.get(self.name, self.name)
        if self.args:
            base += "(" + ",".join(map(str, self.args)) + ")"
        return base + (" WITH TIME ZONE" if self.tz else "")

    @property
    def unit(self) -> str | None:
        """Unit of a timestamp's raw integers."""
        if self.name != "TIMESTAMP":
            return None
        p = self.args[0] if self.args else 3
        return "s" if p == 0 else "ms" if p <= 3 else "us" if p <= 6 else "ns"

    @property
    def spark(self) -> T.DataType:
        if self.name == "ARRAY":
            return T.ArrayType(self.fields[0][1].spark, True)
        if self.name == "STRUCT":
            return T.StructType([T.StructField(n, t.spark, True, t.metadata) for n, t in self.fields])
        if self.name == "DECIMAL":
            return T.DecimalType(*self.args)
        if self.name == "TIMESTAMP":
            if self.unit == "ns":
                return T.LongType()
            return T.TimestampType() if self.tz else T.TimestampNTZType()
        return CARRIERS[self.name]

    @property
    def metadata(self) -> dict:
        return {TYPE_KEY: self.sql}


#: The Spark type that carries each scalar type.
CARRIERS = {
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "UINT8": T.ShortType(),
    "UINT16": T.IntegerType(),
    "UINT32": T.LongType(),
    "UINT64": T.DecimalType(20, 0),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "VARCHAR": T.StringType(),
    "BLOB": T.BinaryType(),
    "DATE": T.DateType(),
    "ENUM": T.StringType(),
}

SQL_NAMES = {"UINT8": "TINYINT UNSIGNED", "UINT16": "SMALLINT UNSIGNED", "UINT32": "INT UNSIGNED", "UINT64": "BIGINT UNSIGNED"}
UNSIGNED = {"UINT8": 8, "UINT16": 16, "UINT32": 32, "UINT64": 64}
INTEGERS = {"TINYINT": 8, "SMALLINT": 16, "INT": 32, "BIGINT": 64}

#: The accepted spellings.
SPELLINGS = {
    "TINYINT": "TINYINT", "SMALLINT": "SMALLINT", "INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT",
    "UINT2": "UINT16",
    "FLOAT": "FLOAT", "REAL": "FLOAT", "DOUBLE": "DOUBLE", "BOOLEAN": "BOOLEAN",
    "VARCHAR": "VARCHAR", "CHAR": "VARCHAR", "TEXT": "VARCHAR",
    "LARGETEXT": "VARCHAR", "LONGTEXT": "VARCHAR", "LARGEUTF8": "VARCHAR", "LARGESTRING": "VARCHAR",
    "BLOB": "BLOB", "BINARY": "BLOB", "VARBINARY": "BLOB", "BYTES": "BLOB", "BYTEA": "BLOB",
    "LARGEBLOB": "BLOB", "LONGBLOB": "BLOB", "LARGEBINARY": "BLOB",
    "DATE": "DATE",
}
LARGE = {"LARGETEXT": "LARGETEXT", "LONGTEXT": "LARGETEXT", "LARGEUTF8": "LARGETEXT", "LARGESTRING": "LARGETEXT", "LARGEBLOB": "LARGEBLOB", "LONGBLOB": "LARGEBLOB", "LARGEBINARY": "LARGEBLOB"}

TOKEN = re.compile(r"\s*('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[A-Za-z_][A-Za-z_0-9]*|\d+|<>|\S)", re.S)


class TypeParser:
    """Reads a type from the tokens of a column definition."""

    def __init__(self, tokens: list[str], at: int = 0) -> None:
        self.tokens, self.at = tokens, at

    @classmethod
    def of(cls, text: str) -> "TypeParser":
        return cls(TOKEN.findall(text))

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want is not None and t.upper() != want):
            raise InvalidSchema(f"expected {want or 'a type'} near '{' '.join(self.tokens[max(0, self.at - 3) : self.at + 3])}'")
        self.at += 1
        return t

    def numbers(self) -> list[int]:
        out = []
        if self.peek() == "(":
            self.take()
            while self.peek() != ")":
                t = self.take()
                if t != ",":
                    if not t.isdigit():
                        raise InvalidSchema(f"bad type argument {t}")
                    out.append(int(t))
            self.take(")")
        return out

    def parse(self) -> ColumnType:
        t = self.scalar()
        while self.peek() == "[" and self.peek(1) == "]":
            self.at += 2
            t = ColumnType("ARRAY", fields=(("item", t),))
        return t

    def scalar(self) -> ColumnType:
        word = self.take()
        name = word.upper()
        if word == "(":
            self.at -= 1
            return self.struct("(", ")")
        if name == "ARRAY":
            close = {"<": ">", "(": ")"}.get(self.peek())
            if not close:
                raise InvalidSchema("ARRAY needs an element type")
            self.take()
            inner = self.parse()
            self.take(close)
            return ColumnType("ARRAY", fields=(("item", inner),))
        if name == "STRUCT":
            return self.struct(self.peek(), {"<": ">", "(": ")"}.get(self.peek(), ">"))
        if name == "ENUM":
            self.take("(")
            variants = []
            while self.peek() != ")":
                t = self.take()
                if t != ",":
                    if t[0] != "'":
                        raise InvalidSchema("ENUM variants must be strings")
                    variants.append(t[1:-1].replace("''", "'"))
            self.take(")")
            if not variants or any("," in v for v in variants) or len(set(variants)) < len(variants):
                raise InvalidSchema("ENUM needs distinct variants without commas")
            return ColumnType("ENUM", tuple(variants))
        if name in ("DECIMAL", "NUMERIC", "DEC"):
            n = self.numbers()
            p, s = (n + [0])[:2] if n else (38, 10)
            if not (1 <= p <= 38 and s <= p):
                raise InvalidSchema(f"bad decimal precision ({p},{s})")
            return ColumnType("DECIMAL", (p, s))
        if name == "TIMESTAMP":
            n, tz = self.numbers(), False
            if self.peek().upper() in ("WITH", "WITHOUT"):
                tz = self.take().upper() == "WITH"
                self.take("TIME")
                self.take("ZONE")
            return ColumnType("TIMESTAMP", tuple(n[:1]), tz)
        if name == "MEDIUMINT" and self.peek().upper() == "UNSIGNED":
            self.take()
            return ColumnType("UINT32")
        if name not in SPELLINGS:
            raise InvalidSchema(f"unsupported SQL type {name}")
        out = SPELLINGS[name]
        self.numbers()  # lengths are read and ignored
        if out in INTEGERS and self.peek().upper() == "UNSIGNED":
            self.take()
            return ColumnType(f"UINT{INTEGERS[out]}")
        if name == "DOUBLE" and self.peek().upper() == "PRECISION":
            self.take()
        return ColumnType(out, spelled=LARGE.get(name))

    def struct(self, open_: str, close: str) -> ColumnType:
        self.take(open_ if open_ in ("<", "(") else "<")
        fields: list[tuple[str, ColumnType]] = []
        while self.peek() != close:
            if self.peek() == ",":
                self.take()
                continue
            named = self.peek(1) not in (",", close, "(", "[", "<") and self.peek().upper() not in ("TIMESTAMP", "DOUBLE")
            name = unquote(self.take()) if named else f"f{len(fields)}"
            fields.append((name, self.parse()))
        self.take(close)
        if not fields:
            raise InvalidSchema("STRUCT needs fields")
        return ColumnType("STRUCT", fields=tuple(fields))


def unquote(name: str) -> str:
    return name[1:-1].replace('""', '"') if name[:1] == '"' else name


def parse_type(text: str) -> ColumnType:
    p = TypeParser.of(text)
    out = p.parse()
    if p.peek():
        raise InvalidSchema(f"unsupported SQL type {text}")
    return out


def from_spark(dt: T.DataType) -> ColumnType:
    """The column type of a plain Spark type, for tables that are made from schemas."""
    if isinstance(dt, T.ArrayType):
        return ColumnType("ARRAY", fields=(("item", from_spark(dt.elementType)),))
    if isinstance(dt, T.StructType):
        return ColumnType("STRUCT", fields=tuple((f.name, from_spark(f.dataType)) for f in dt.fields))
    if isinstance(dt, T.DecimalType):
        return ColumnType("DECIMAL", (dt.precision, dt.scale))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return ColumnType("TIMESTAMP", (6,), isinstance(dt, T.TimestampType))
    for name, carrier in CARRIERS.items():
        if name not in UNSIGNED and name != "ENUM" and carrier == dt:
            return ColumnType(name)
    raise InvalidSchema(f"unsupported SQL type {dt.simpleString()}")


@dataclass(frozen=True)
class Column:
    name: str
    type: ColumnType
    nullable: bool = True

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.type.spark, self.nullable, self.type.metadata)


def validate(columns: list[Column]) -> list[Column]:
    """At least one column, named ones, no name twice, and a time column of an integer or timestamp type."""
    if not columns:
        raise InvalidSchema("a table needs columns")
    names = [c.name for c in columns]
    if not all(names):
        raise InvalidSchema("column names must not be empty")
    if len(set(names)) < len(names):
        raise InvalidSchema("duplicate column name")
    at = [c for c in columns if c.name == TIME]
    if not at:
        raise InvalidSchema(f"a column named '{TIME}' is required")
    if at[0].type.name not in ("BIGINT", "TIMESTAMP"):
        raise InvalidSchema(f"column '{TIME}' must be BIGINT or TIMESTAMP")
    return [Column(c.name, c.type, False) if c.name == TIME else c for c in columns]


def schema_of(columns: list[Column]) -> T.StructType:
    return T.StructType([c.field() for c in columns])
