"""Scalar functions over paths, names, versions and strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: suffixes of each modality
STRUCTURED = ("json", "json5", "toml", "yml", "yaml", "xml", "properties", "cfg", "conf", "mcmeta")
IMAGE = ("png", "jpg", "jpeg", "gif")


def log_bucket(v: Column) -> Column:
    return F.when(v <= 0, 0).otherwise(F.floor(F.log2(v)).cast("int") + 1)


def count_bucket(n: Column) -> Column:
    """0, 1, 2-3, 4-7, ... 512+."""
    out = F.lit("512+")
    for k in range(8, 0, -1):
        out = F.when(n < 2 ** (k + 1), f"{2**k}-{2 ** (k + 1) - 1}").otherwise(out)
    return F.when(n <= 0, "0").when(n == 1, "1").otherwise(out)


def size_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")


def normal_path(p: Column) -> Column:
    return F.trim(F.translate(p, "\\", "/"))


def basename(p: Column) -> Column:
    return F.substring_index(normal_path(p), "/", -1)


def modality(p: Column) -> Column:
    suffix = F.lower(F.regexp_extract(basename(p), r"\.([^.]*)$", 1))
    hidden = F.lower(normal_path(p)).startswith("meta-inf/")
    return F.when(hidden, None).when(suffix == "class", "CODE_BINARY").when(suffix.isin(*STRUCTURED), "STRUCTURED").when(suffix.isin(*IMAGE), "IMAGE")


def outer_class(p: Column) -> Column:
    name = basename(p)
    return F.when(name.endswith(".class"), F.regexp_extract(name, r"^([^$]*?)(\$.*)?\.class$", 1)).otherwise("")


def class_reference(p: Column) -> Column:
    """``[Lx;`` -> ``x``; arrays of primitives -> null."""
    inner = F.regexp_extract(p, r"^\[+L(.+);$", 1)
    return F.when(p.startswith("["), F.when(inner != "", inner)).otherwise(p)


def normal_version(v: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.lower(v), "_", "-"), "^refs/tags/", "")
    return F.regexp_replace(F.regexp_replace(v, "^v(?=[0-9])", ""), "[^a-z0-9]", "")


def is_resource_id(s: Column) -> Column:
    return s.rlike(r"^[a-z0-9_.-]+:[a-z0-9_./-]+$") & ~s.contains("#")


def as_bool(s: Column) -> Column:
    return F.lower(F.trim(s.cast("string"))).isin("1", "true", "yes", "y")


def nondiscriminative(text: Column) -> Column:
    """Why a structured component says nothing, or null."""
    bare = F.regexp_replace(text, r"\s+", "")
    return F.when(F.length(text) == 0, "EMPTY_BYTES").when(bare == "", "WHITESPACE_ONLY").when(bare == "{}", "EMPTY_JSON_OBJECT").when(bare == "[]", "EMPTY_JSON_ARRAY")


def string_shape(s: Column) -> Column:
    """The first shape that fits."""
    return (
        F.when(F.length(s) == 0, "EMPTY")
        .when(s.rlike("^[a-z][a-z0-9+.-]*://"), "URL")
        .when(s.rlike("^[0-9a-fA-F]{16,}$"), "HEX")
        .when(is_resource_id(s), "RESOURCE_ID")
        .when(s.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)+$"), "QUALIFIED_ID")
        .otherwise(
            F.concat(
                F.lit("WORDS"),
                F.when(s.rlike("[0-9]"), "_DIGIT").otherwise(""),
                F.when(s.rlike("[A-Z]"), "_UPPER").otherwise(""),
                F.when(s.contains("/"), "_SLASH").otherwise(""),
                F.lit("_"),
                log_bucket(F.size(F.split(F.trim(s), r"\s+"))).cast("string"),
            )
        )
    )


def hash_order(value: Column, seed: str = "0", salt: str = "") -> Column:
    """A portable order: sha256 of seed, salt and value."""
    return F.sha2(F.concat_ws("|", F.lit(seed), F.lit(salt), value.cast("string")), 256)


def word32(hex_: Column, k: int = 0) -> Column:
    """The k-th 32-bit word of a hex hash, as a non-negative long."""
    return F.conv(F.substring(hex_, 8 * k + 1, 8), 16, 10).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def histogram_distance(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.least(F.greatest(total / 20000, F.lit(0.0)), F.lit(1.0))


def tokens3(tokens: Column) -> Column:
    """Sliding windows of three: SHORT_... below three, EMPTY for none."""
    n = F.size(tokens)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array_join(F.slice(tokens, i, 3), ">"))
    return F.when(n == 0, F.array(F.lit("EMPTY"))).when(n < 3, F.array(F.concat(F.lit("SHORT_"), F.array_join(tokens, ">")))).otherwise(windows)


def set_verdict(found: Column, true: Column) -> Column:
    """Of candidate sources against the true one."""
    inside = F.array_contains(found, true)
    return (
        F.when(F.size(found) == 0, "NO_MATCH")
        .when(F.size(found) == 1, F.when(inside, "CORRECT_UNIQUE").otherwise("WRONG_UNIQUE"))
        .otherwise(F.when(inside, "AMBIGUOUS_TRUE_INCLUDED").otherwise("AMBIGUOUS_WRONG"))
    )


# fixed values: folders that hold no production sources
NOT_PRODUCTION = ("test", "tests", "example", "examples", "fixture", "fixtures", "sample", "samples", "template", "templates", "build", "target")
# fixed values: the stage that each split serves
STAGE_OF_SPLIT = {"CALIBRATION_KNOWN": "CALIBRATION", "TEST_KNOWN": "TEST", "UNKNOWN_HELDOUT": "TEST"}


def ignored_entry(p: Column) -> Column:
    """Packaging metadata and file-system noise among archive entries."""
    low = F.lower(normal_path(p))
    return low.startswith("meta-inf/") | low.contains("__macosx/") | low.endswith(".ds_store")


def production_path(p: Column) -> Column:
    """Inside a production source tree, and in none of the folders that are not."""
    low = F.lower(p)
    return low.rlike("(^|/)src/main/(java|kotlin|resources)/") & ~F.concat(F.lit("/"), low).rlike(f"/({'|'.join(NOT_PRODUCTION)})/")


def stage_of_split(split: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, stage in STAGE_OF_SPLIT.items():
        out = F.when(split == name, stage).otherwise(out)
    return out


def repository_url(url: Column) -> Column:
    """``https://github.com/owner/repo`` of a url that names a repository there, else empty."""
    u = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", ""), "[.]git$", "")
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    parts = F.filter(F.split(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    known = host.isin("github.com", "www.github.com") & (F.size(parts) >= 2)
    return F.when(known, F.concat(F.lit("https://github.com/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)))).otherwise("")


def hex_words(h: Column, words: int) -> Column:
    """``words`` 32-bit words of a hex string of just that length; null for an empty one; else an error."""
    h = F.trim(h)
    right = h.rlike(f"^[0-9a-fA-F]{{{8 * words}}}$")
    value = F.array(*[word32(h, k) for k in range(words)])
    return F.when(F.coalesce(h, F.lit("")) == "", None).when(right, value).otherwise(F.raise_error(F.concat(F.lit("not a hash: "), h)).cast("array<bigint>"))


def same_value(a: Column, b: Column, integer: bool) -> Column:
    """Two fields of an evidence table agree: whole numbers by value, others by text, empty only with empty."""
    a, b = F.trim(F.coalesce(a.cast("string"), F.lit(""))), F.trim(F.coalesce(b.cast("string"), F.lit("")))
    number = lambda x: x.try_cast("double").try_cast("bigint")
    return F.when((a == "") | (b == ""), a == b).otherwise(F.coalesce(number(a) == number(b), F.lit(False)) if integer else a == b)
