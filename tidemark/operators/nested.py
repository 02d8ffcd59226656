"""Deeply nested records as flat related tables, in one pass.

A depth-first visitor over the schema is compiled into one expression that emits, for every object on the way, a row
with the tag of its table, its primary key, the key of its parent and its payload. The rows of all tables come out of
one scan; written partitioned by tag, each table is read back alone with its own schema.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMITTED = "tag string, pk string, parent_pk string, root_key string, ordinals array<int>, payload string"
_EMPTY = "array<struct<tag:string,pk:string,parent_pk:string,root_key:string,ordinals:array<int>,payload:string>>"


@dataclass(frozen=True)
class Flat:
    """A table of the result: its tag and the columns of its payload."""

    tag: str
    payload: T.StructType


def _scalars(schema: T.StructType, at: str = "") -> list[tuple[str, tuple[str, ...], T.DataType]]:
    """(flat name, path, type) of the fields that belong to the object itself; structs in it are flattened."""
    out = []
    for f in schema:
        name = f"{at}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += [(n, (f.name, *p), t) for n, p, t in _scalars(f.dataType, f"{name}.")]
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append((name, (f.name,), f.dataType))
    return out


def _repeated(schema: T.StructType, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """(path, type) of the arrays and maps of the object, those of structs in it included."""
    out = []
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            out += _repeated(f.dataType, (*at, f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(((*at, f.name), f.dataType))
    return out


def _element(dtype: T.DataType) -> T.StructType:
    """What a row of the child table holds of an array's element or a map's entry."""
    if isinstance(dtype, T.MapType):
        return T.StructType([T.StructField("key", dtype.keyType), *(_element(T.ArrayType(dtype.valueType)).fields)])
    inner = dtype.elementType
    return inner if isinstance(inner, T.StructType) else T.StructType([T.StructField("value", inner)])


def flat_tables(schema: T.StructType, root: str = "root") -> list[Flat]:
    """The tables that shred() emits for records of this schema, the parent before its children."""
    own = T.StructType([T.StructField(n, t) for n, _, t in _scalars(schema)])
    out = [Flat(root, own)]
    for path, dtype in _repeated(schema):
        out += flat_tables(_element(dtype), f"{root}/{'.'.join(path)}")
    return out


def _get(c: Column, path: tuple[str, ...]) -> Column:
    for p in path:
        c = c.getField(p)
    return c


def _payload(c: Column, schema: T.StructType) -> Column:
    own = _scalars(schema)
    return F.to_json(F.struct(*[_get(c, p).alias(n) for n, p, _ in own])) if own else F.lit("{}")


def _emitter(child: T.StructType, label: str, plain: bool, field: str, key: Column, root_key: Column, ordinals: Column):
    """The function of an element and its place that gives the rows of the element and of all below it."""

    def one(e: Column, i: Column) -> Column:
        row = F.struct(e.alias("value")) if plain else e
        pk = F.concat(key, F.lit(f"/{field}:"), i.cast("string"))
        at = F.concat(ordinals, F.array(i))
        own = F.array(F.struct(F.lit(label).alias("tag"), pk.alias("pk"), key.alias("parent_pk"), root_key.alias("root_key"), at.alias("ordinals"), _payload(row, child).alias("payload")))
        below = _visit(row, child, label, pk, root_key, at)
        return F.when(e.isNull(), F.array().cast(_EMPTY)).otherwise(F.concat(own, *below) if below else own)

    return one


def _visit(c: Column, schema: T.StructType, tag: str, key: Column, root_key: Column, ordinals: Column) -> list[Column]:
    """The emissions of all descendants of the object c, one array for each repeated field."""
    out = []
    for path, dtype in _repeated(schema):
        child, element, label = _element(dtype), _get(c, path), f"{tag}/{'.'.join(path)}"
        if isinstance(dtype, T.MapType):
            value = dtype.valueType
            element = F.transform(F.map_entries(element), lambda e: F.struct(e["key"].alias("key"), *([e["value"][n].alias(n) for n in value.names] if isinstance(value, T.StructType) else [e["value"].alias("value")])))
        plain = isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, T.StructType)
        out.append(F.when(element.isNull(), F.array().cast(_EMPTY)).otherwise(F.flatten(F.transform(element, _emitter(child, label, plain, f"{'.'.join(path)}", key, root_key, ordinals)))))
    return out


def shred(df: DataFrame, *, key: Column | str, root: str = "root") -> DataFrame:
    """All objects of df's records as tagged rows (EMITTED), from a single scan of df.

    key is the primary key of a record as text. Structs are flattened into their parent (dotted names); each array
    or map becomes a table tagged root/path. pk of a child is the parent's pk, the field and the place, ordinals the
    0-based places from the record down. A null element keeps its place and emits nothing; a null or empty array
    emits nothing; a null record field is left out of the payload. Records with a null key are emitted with null
    keys. Records with equal keys emit rows with equal pk: see distinct_rows. A field name may occur at any depth.
    """
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    held = df.select(k.alias("__k"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__r"))
    schema = df.schema
    c, rk = F.col("__r"), F.col("__k")
    none = F.array().cast("array<int>")
    own = F.array(F.struct(F.lit(root).alias("tag"), rk.alias("pk"), F.lit(None).cast("string").alias("parent_pk"), rk.alias("root_key"), none.alias("ordinals"), _payload(c, schema).alias("payload")))
    return held.select(F.explode(F.concat(own, *_visit(c, schema, root, rk, rk, none))).alias("x")).select("x.*")


def distinct_rows(emitted: DataFrame) -> DataFrame:
    """One row per tag and pk: what copies of a record emit alike counts once. Where copies differ, the least payload stays."""
    return emitted.groupBy("tag", "pk").agg(F.min(F.struct("payload", "parent_pk", "root_key", "ordinals")).alias("x")).select("tag", "pk", "x.parent_pk", "x.root_key", "x.ordinals", "x.payload")


def table_of(emitted: DataFrame, flat: Flat) -> DataFrame:
    """The rows of one tag with the tag's schema applied: pk, parent_pk, root_key, ordinals and the payload's columns.

    Payload columns whose names clash with those four carry the prefix 'field.'.
    """
    fixed = ["pk", "parent_pk", "root_key", "ordinals"]
    parsed = emitted.where(F.col("tag") == flat.tag).withColumn("__p", F.from_json("payload", flat.payload))
    return parsed.select(*fixed, *[F.col("__p").getField(f.name).alias(f"field.{f.name}" if f.name in fixed else f.name) for f in flat.payload])


def write_tables(df: DataFrame, folder: str, *, key: Column | str, root: str = "root") -> None:
    """Shred df once and write all its tables below folder, partitioned by tag."""
    distinct_rows(shred(df, key=key, root=root)).write.mode("overwrite").partitionBy("tag").parquet(folder)


def read_table(spark: SparkSession, folder: str, flat: Flat) -> DataFrame:
    """One of the written tables; only its own partition is read."""
    return table_of(spark.read.schema(EMITTED).parquet(folder), flat)
