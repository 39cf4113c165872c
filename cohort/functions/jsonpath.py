"""JSON text columns: read a dot path, rewrite bound paths, list the paths that occur."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Binding
from ..common import ref
from .generators import generate

MAX_DEPTH = 3


def read_path(value: Column, path: str) -> Column:
    """The text at a dot path; null for missing paths, arrays on the way, and what is not a JSON object."""
    steps = "".join("['" + p.replace("'", "\\'") + "']" for p in path.split(".") if p)
    return F.get_json_object(value, "$" + steps) if steps else F.lit(None).cast("string")


def overlay(value: Column, bindings: Sequence[Binding], key_prefix: Column, locale: Column, identity: Column) -> Column:
    """The JSON text with each bound path faked, set to null, or removed.

    Fakes are expressions like any other, seeded by ``key_prefix:path``; one Arrow UDF puts them in, since it must
    keep key order and unknown keys.  Missing paths are skipped, null leaves stay null, arrays are not entered; what is not a JSON
    object comes back as it is.
    """
    stand_ins = [
        generate(b.generator, F.concat(key_prefix, F.lit(":" + b.path)), locale, identity, read_path(value, b.path))
        if b.action == "fake" and b.generator
        else F.lit(None).cast("string")
        for b in bindings
    ]
    plan = [(b.path, b.action, bool(b.generator)) for b in bindings]

    @F.pandas_udf("string")
    def put(texts: pd.Series, fakes: pd.Series) -> pd.Series:
        return pd.Series([rewrite(t, plan, list(f)) for t, f in zip(texts, fakes, strict=True)], dtype=object)

    return put(value, F.array(*stand_ins)) if bindings else value


def rewrite(text: str | None, plan: Sequence[tuple[str, str, bool]], fakes: Sequence[str | None]) -> str | None:
    """One value of ``overlay``.  Numbers keep their text; what nests too deep to be read is no JSON object here, and stays as it is."""
    if text is None:
        return None
    mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text and not any(f and c in f for f in fakes))

    def number(spelled: str) -> str:
        return mark + spelled + mark

    try:
        root = json.loads(text, parse_float=number, parse_int=number)
    except (ValueError, RecursionError):
        return text
    if not isinstance(root, dict):
        return text
    for (path, action, known), fake in zip(plan, fakes, strict=True):
        *way, leaf = [p for p in path.split(".") if p] or [""]
        node = reduce(lambda n, p: n.get(p) if isinstance(n, dict) else None, way, root)
        if not isinstance(node, dict) or leaf not in node:
            continue
        if action == "remove":
            del node[leaf]
        elif action == "redact":
            node[leaf] = None
        elif known and node[leaf] is not None:
            node[leaf] = fake
    try:
        out = json.dumps(root, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return text
    out = re.sub(f'"{mark}([^"{mark}]*){mark}"', r"\1", out)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", out)  # half of a pair, which is no character


def discover(df: DataFrame, column: str, sample: int | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """``(path, types, present_in, sampled)``: the leaf paths of a JSON column's objects, to ``MAX_DEPTH`` levels.

    Arrays are leaves, and so are objects at the last level.  The whole column is read unless ``sample`` says otherwise.
    """
    texts = df.select(ref(column).cast("string").alias("j")).where("j IS NOT NULL")
    if sample is not None:
        texts = df.where(ref(column).isNotNull()).orderBy(*order).limit(sample).select(ref(column).cast("string").alias("j"))
    parsed = texts.select(F.try_parse_json("j").alias("node0")).where(_is_object("node0"))
    spark, paths, kinds, first = df.sparkSession, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(True)
    for depth in range(1, MAX_DEPTH + 1):  # one level inside the other: each row is parsed once, and comes out once a leaf
        inside = F.when(_is_object(f"node{depth - 1}"), F.col(f"node{depth - 1}"))
        level = spark.tvf.variant_explode_outer(inside.outer()).toDF(f"pos{depth}", f"key{depth}", f"node{depth}")
        parsed = parsed.lateralJoin(level)
        key, node = F.col(f"key{depth}"), f"node{depth}"
        path = F.concat_ws(".", *[f"key{i}" for i in range(1, depth + 1)])
        leaf = key.isNotNull() & (F.lit(depth == MAX_DEPTH) | ~_is_object(node))
        paths, kinds = F.when(leaf, path).otherwise(paths), F.when(leaf, F.schema_of_variant(node)).otherwise(kinds)
        first &= F.coalesce(F.col(f"pos{depth}"), F.lit(0)) == 0
    leaves = parsed.select(paths.alias("path"), kinds.alias("kind"), first.cast("long").alias("first"))
    found = leaves.withColumn("type", _type_name(F.col("kind"))).groupBy("path").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.count(F.lit(1)).alias("present_in"), F.sum("first").alias("first")
    )
    total = found.agg(F.coalesce(F.sum("first"), F.lit(0)).alias("sampled"))
    return found.where("path IS NOT NULL").drop("first").join(F.broadcast(total))


def _is_object(variant: str) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))


def _type_name(kind: Column) -> Column:
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )
