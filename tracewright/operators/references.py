"""Typed edges between the components of a package, from what their payloads name.

Payloads are read in Arrow batches into (kind, key, value); everything after that is equi-joins on
(package, path) and on (package, index, identifier), where an identifier counts only if one path has it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import class_reference, is_resource_id, modality, normal_path
from .classfile import constants

# fixed values: the mod description, JSON fields of mixin classes, keys of textures, suffixes that identifiers drop
DESCRIPTION = "fabric.mod.json"
MIXIN_FIELDS = ("mixins", "client", "server")
TEXTURE_KEYS = ("texture", "particle", "layer0", "layer1", "layer2", "layer3")
ASSET_SUFFIXES, DATA_SUFFIXES = r"\.(json|png|jpg|jpeg|mcmeta)$", r"\.(json|mcmeta)$"
IDENTIFIER = r"(?<![A-Za-z0-9_.-])([a-z0-9_.-]+:[a-z0-9_./-]+)"


def _strings(value):
    todo = [(None, value)]
    while todo:
        key, v = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                yield "NAME", None, k
                todo.append((k, x))
        elif isinstance(v, list):
            todo += [(key, x) for x in v]
        elif isinstance(v, str):
            yield "TEXT", key, v


def _description(value: dict):
    points = value.get("entrypoints")
    for kind, given in points.items() if isinstance(points, dict) else ():
        for x in given if isinstance(given, list) else [given]:
            name = x.get("value") if isinstance(x, dict) else x
            if isinstance(name, str) and name:
                yield "ENTRYPOINT", kind, name
    mixins = value.get("mixins")
    for x in mixins if isinstance(mixins, list) else ():
        config = x.get("config") if isinstance(x, dict) else x
        if isinstance(config, str) and config:
            yield "MIXIN_CONFIG", None, config
    icon = value.get("icon")
    for x in icon.values() if isinstance(icon, dict) else [icon]:
        if isinstance(x, str):
            yield "ICON", None, x


def _mixins(value: dict):
    package = str(value.get("package", "")).strip()
    for field in MIXIN_FIELDS:
        given = value.get(field)
        for x in given if isinstance(given, list) else ():
            if isinstance(x, str):
                yield "MIXIN_CLASS", field, f"{package}.{x}" if package else x


def named(path: str, data: bytes) -> list[tuple]:
    """Distinct (kind, key, value) that one payload names; none if it cannot be read."""
    found = []
    try:
        if path.lower().endswith(".class"):
            texts, classes = constants(data)
            found = [("CONSTANT", None, x) for x in texts] + [("CLASS", None, x) for x in classes]
        else:
            value = json.loads(data.decode("utf-8"))
            found = list(_strings(value))
            if isinstance(value, dict) and path == DESCRIPTION:
                found += _description(value)
            if isinstance(value, dict) and "mixin" in path.lower() and path.lower().endswith(".json"):
                found += _mixins(value)
    except (ValueError, RecursionError):
        return []
    clean = lambda x: None if x is None else x.encode("utf-8", "replace").decode()  # noqa: E731  lone surrogates
    return list(dict.fromkeys((kind, clean(key), clean(value)) for kind, key, value in found))


def _named(paths: pd.Series, payloads: pd.Series) -> pd.Series:
    rows = ([] if d is None else named(p, bytes(d)) for p, d in zip(paths, payloads))
    return pd.Series([[dict(zip(("kind", "key", "value"), x)) for x in r] for r in rows], dtype=object)


def identifiers(paths: DataFrame) -> DataFrame:
    """(package, index, key, path) of ``paths`` (package, path): the texture, model and generic index, where
    one path of a package has the key."""
    parts = F.split(F.lower(normal_path(F.col("path"))), "/")
    rest = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "/")
    p = paths.select("package", "path", parts.alias("parts"), rest.alias("rest")).where("size(parts) >= 4 and parts[0] in ('assets', 'data')")
    space, sort = F.col("parts")[1], F.col("parts")[2]
    asset = F.col("parts")[0] == "assets"
    texture = asset & (sort == "textures") & F.col("rest").endswith(".png")
    model = asset & (sort == "models") & F.col("rest").endswith(".json")
    stem = F.when(asset, F.regexp_replace("rest", ASSET_SUFFIXES, "")).otherwise(F.regexp_replace("rest", DATA_SUFFIXES, ""))
    key = lambda index, *text: F.struct(F.lit(index).alias("index"), F.concat(space, F.lit(":"), *text).alias("key"))
    plain = key("generic", stem)
    keys = F.when(texture, F.array(plain, key("texture", stem))).when(model, F.array(plain, key("model", stem))).otherwise(F.array(plain, key("generic", sort, F.lit("/"), stem)))
    rows = p.select("package", "path", F.explode(keys).alias("k")).select("package", "k.index", "k.key", "path")
    return rows.groupBy("package", "index", "key").agg(F.min("path").alias("path"), F.max("path").alias("last")).where("path = last").drop("last")


def _class_path(value: Column) -> Column:
    return F.concat(F.translate(F.substring_index(value, "::", 1), ".", "/"), F.lit(".class"))


def typed_edges(components: DataFrame) -> DataFrame:
    """Distinct (package, source, target, kind) among ``components`` (package, path, payload): what a payload
    names by path, class name or identifier and its package holds, itself excepted."""
    read = components.where(modality(F.col("path")).isin("CODE_BINARY", "STRUCTURED"))
    kind = "array<struct<kind:string,key:string,value:string>>"
    rows = read.select("package", F.col("path").alias("source"), F.explode(F.pandas_udf(_named, kind)("path", "payload")).alias("n")).select("package", "source", "n.*")
    value, of = F.col("value"), lambda *kinds: F.col("kind").isin(*kinds)
    stripped = F.regexp_replace(value, r"^\s+|\s+$", "")
    slashed, bare = lambda v: F.translate(v, "\\", "/"), lambda v: F.regexp_replace(F.translate(v, "\\", "/"), "^/+", "")
    when = lambda given, name, path: F.when(given, F.struct(F.lit(name).alias("kind"), path.alias("path")))
    in_json = of("TEXT", "NAME") & F.lower("source").endswith(".json")
    exact = F.array_compact(
        F.array(
            when(of("CLASS"), "CLASS_REF", F.concat(class_reference(value), F.lit(".class"))),
            when(of("CONSTANT"), "RESOURCE_LITERAL", slashed(value)),
            when(of("CONSTANT"), "RESOURCE_LITERAL", bare(value)),
            when(of("ENTRYPOINT"), "ENTRYPOINT", _class_path(stripped)),
            when(of("MIXIN_CONFIG"), "MIXIN_CONFIG", value),
            when(of("MIXIN_CLASS"), "MIXIN_CLASS", _class_path(stripped)),
            when(in_json, "STRUCTURED_REF", slashed(stripped)),
            when(in_json & value.contains("."), "STRUCTURED_CLASS_REF", _class_path(slashed(stripped))),
            when(of("TEXT"), "JSON_EXACT_PATH", bare(stripped)),
            when(of("ICON"), "FABRIC_ICON", bare(value)),
        )
    )
    paths = components.select("package", "path").distinct()
    by_path = rows.select("package", "source", F.explode(exact).alias("x")).select("package", "source", "x.kind", "x.path").distinct().join(paths, ["package", "path"])

    key = F.lower(F.coalesce("key", F.lit("")))
    index = F.when(key == "parent", "model").when(key.isin(*TEXTURE_KEYS) | key.contains("texture"), "texture").otherwise("generic")
    edge = F.when(F.col("kind") == "CONSTANT", "CLASS_IDENTIFIER_REF").when(F.col("index") == "model", "MODEL_PARENT").when(F.col("index") == "texture", "TEXTURE_REF").otherwise("JSON_IDENTIFIER_REF")
    told = F.when(of("TEXT") & is_resource_id(stripped), F.array(stripped)).when(of("CONSTANT"), F.regexp_extract_all(F.lower(value), F.lit(IDENTIFIER), 1))
    asked = rows.select("package", "source", "kind", F.when(of("CONSTANT"), "generic").otherwise(index).alias("index"), F.explode(told).alias("key"))
    by_key = asked.select("package", "source", "index", "key", edge.alias("kind")).distinct().join(identifiers(paths), ["package", "index", "key"])
    both = by_path.select("package", "source", "path", "kind").unionByName(by_key.select("package", "source", "path", "kind"))
    return both.where("path <> source").select("package", "source", F.col("path").alias("target"), "kind").distinct()
