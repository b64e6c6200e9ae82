"""Schemas that drift between files: one typed table and a report of each change.

Rows are loaded as path-value maps that keep each value's raw type. Path-type statistics over all
files resolve renames, file by file: at one object, an unregistered name stands for the registered
member that suits it best, if that is missing in this file and the likeness of names, members,
contents or type speaks for it; how much more often than usual the member is missing where the
name occurs (a share, whatever the number of files) supports it. Nothing but type: many files must.
Objects are resolved from the top down, as many levels as the registry has, so members of a renamed object are compared under the
registered path. Then each registered path is projected with its type; a value that cannot be cast
is null and reported.

Redelivered files (same ``file_id``) are read once. A null payload, one that is not JSON or not an
object counts as an empty object: every required top member is ``removed``. Null values are never
``retyped``; a member named twice keeps its last value; empty tables give no rows. The alias table
has one row per renamed member of a file and grows with the files, the registry one per agreed
member; both are counted before they are broadcast, else joined by shuffle.
"""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import checkpointed, small_side

_NODE = "array<struct<path: array<string>, raw_type: string, value: string, members: array<string>, tokens: array<string>>>"


def raw_type(v: object) -> str:
    """null, boolean, int, double, string, object, array<...> of a parsed JSON value."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "double"
    if isinstance(v, str):
        return "string"
    if isinstance(v, dict):
        return "object"
    inner = {raw_type(x) for x in v}
    return "array<>" if not inner else f"array<{'|'.join(sorted(inner))}>"


def valid(kind: str, registered: str) -> bool:
    """Whether a raw type is one of the registered type."""
    if kind in ("null", registered) or (registered == "double" and kind == "int"):
        return True
    if registered.startswith("array<") and kind.startswith("array<"):
        inner, want = kind[6:-1], registered[6:-1]
        return all(valid(x, want) and x != "null" for x in inner.split("|")) if inner else True
    return False


def tokens(v: object) -> list[str] | None:
    """What a value holds, for comparing contents: itself, or its elements."""
    held = v if isinstance(v, list) else [] if isinstance(v, dict) or v is None else [v]
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in held]


def nodes(payload: str | None, depth: int | None = None) -> list[tuple]:
    """(path, raw_type, value, members, tokens) of a payload's members, down to ``depth`` levels of objects (all if None)."""
    try:
        top = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return []
    out: list[tuple] = []
    left = [((), top)] if isinstance(top, dict) else []
    while left:
        at, o = left.pop()
        for k, v in o.items():
            path = (*at, k)
            text = v if isinstance(v, str) else None if v is None else json.dumps(v, ensure_ascii=False)
            out.append((path, raw_type(v), text, sorted(v) if isinstance(v, dict) else None, tokens(v)))
            if isinstance(v, dict) and (depth is None or len(path) < depth):
                left.append((path, v))
    return out


def path_values(files: DataFrame, depth: int | None = None) -> DataFrame:
    """(file_id, nodes): each file once, as its path-value map with raw types."""
    load = F.pandas_udf(lambda s: s.map(lambda p: nodes(p, depth)), _NODE)
    once = files.select("file_id", "payload").dropDuplicates(["file_id"])
    return once.select("file_id", load("payload").alias("nodes"))


def _parts(name: str) -> list[str]:
    return [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]


def likeness(a: str, b: str) -> float:
    """Likeness of two member names: shared parts or shared letters."""
    x, y = _parts(a), _parts(b)
    if sorted(x) == sorted(y) or "".join(x) == "".join(y):
        return 1.0
    shared = len(set(x) & set(y)) / max(1, min(len(set(x)), len(set(y))))
    return max(0.8 * shared, SequenceMatcher(None, "".join(x), "".join(y)).ratio())


def _resolve(level: DataFrame, registered: DataFrame) -> DataFrame:
    """Aliases (file_id, parent, name, stands_for). ``level``: (file_id, parent, name, raw_type, members), parents under registered paths.

    Every file is settled by itself: a foreign name stands for the registered name that suits it best if that
    is absent there and likeness, members or contents speak for it. What the corpus adds are shares: how
    often the two exclude each other, against how often the registered name is absent at all. Only where
    nothing but the type fits, as many files must show it as rule out that a removed and an added member met by chance.
    """
    reg = registered.select("parent", F.col("name").alias("r"), "json_type", "child_names")
    holders = level.where("name IS NULL").select("file_id", "parent")
    named = level.where("name IS NOT NULL")
    known = named.join(F.broadcast(reg.select("parent", F.col("r").alias("name"))), ["parent", "name"], "left_semi")
    foreign = named.join(F.broadcast(reg.select("parent", F.col("r").alias("name"))), ["parent", "name"], "left_anti")
    n_files = holders.groupBy("parent").agg(F.count("*").alias("n_files"))
    n_known = known.groupBy("parent", F.col("name").alias("r")).agg(F.count("*").alias("n_known"))
    base = reg.join(n_files, "parent").join(n_known, ["parent", "r"], "left").withColumn("absent", 1 - F.coalesce("n_known", F.lit(0)) / F.col("n_files"))
    present = known.groupBy("file_id", "parent").agg(F.collect_set("name").alias("have"))
    pairs = checkpointed(foreign.join(present, ["file_id", "parent"], "left").join(F.broadcast(base), "parent"))  # base: a row per registered path
    alone = ~F.coalesce(F.array_contains("have", F.col("r")), F.lit(False))
    kind = F.col("raw_type")
    want = F.col("json_type")
    fit = (kind == want) | ((want == "double") & (kind == "int")) | (want.startswith("array") & kind.startswith("array")) | (kind == "null")
    fit = fit | (~want.isin("object") & ~kind.isin("object"))
    fit = F.when(want == "object", (kind == "object") | (kind == "string")).otherwise(fit | (kind == "object"))
    overlap = F.size(F.array_intersect("members", "child_names")) / F.greatest(F.size("child_names"), F.lit(1))
    strict = (kind == want) | ((want == "double") & (kind == "int")) | (want.startswith("array") & kind.startswith("array"))
    held = known.select("parent", F.col("name").alias("r"), F.explode("tokens").alias("token")).distinct().withColumn("hit", F.lit(1.0))
    told = pairs.where(alone).select("file_id", "parent", "name", "r", F.explode("tokens").alias("token"))
    per_file = told.join(held, ["parent", "r", "token"], "left").groupBy("file_id", "parent", "name", "r").agg(F.max(F.coalesce("hit", F.lit(0.0))).alias("hit"))
    domain = per_file.groupBy("parent", "name", "r").agg(F.avg("hit").alias("domain"))
    typed = (fit & F.lit(True)).cast("double") * 0.3 + strict.cast("double") * 0.7
    shared = F.coalesce(F.when(F.col("members").isNotNull() & F.col("child_names").isNotNull(), overlap), F.lit(0.0))
    pairs = pairs.select("file_id", "parent", "name", "r", "absent", alone.alias("alone"), typed.alias("own_fit"), strict.alias("strict"), shared.alias("own_shared"))
    stats = pairs.groupBy("parent", "name", "r").agg(
        F.sum(F.col("alone").cast("int")).alias("n_alone"), F.avg(F.col("alone").cast("double")).alias("rate"), F.first("absent").alias("absent"), F.avg("own_fit").alias("fit"), F.avg("own_shared").alias("shared"),
    )
    stats = stats.join(domain, ["parent", "name", "r"], "left").fillna(0.0, ["domain"])
    near = F.pandas_udf(lambda a, b: pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64"), "double")
    gain = F.log(F.greatest("rate", F.lit(1e-4)) / F.least(F.greatest("absent", F.lit(1e-4)), F.lit(0.9999)))
    stats = checkpointed(stats.select("parent", "name", "r", "rate", "fit", "shared", "domain", near("name", "r").alias("near"), F.least(F.greatest(gain, F.lit(0.0)), F.lit(5.0)).alias("gain"), (F.col("n_alone") * gain).alias("weight")))
    here = pairs.drop("absent").join(small_side(stats), ["parent", "name", "r"]).join(per_file, ["file_id", "parent", "name", "r"], "left")
    members, same, kinds = F.greatest("shared", "own_shared"), F.greatest("domain", F.coalesce("hit", F.lit(0.0))), F.greatest("fit", "own_fit")
    apart = (F.col("rate") >= 0.5) & ((F.col("near") >= 0.3) & F.col("strict") & (F.col("gain") > 0.7) | (same >= 0.5) & (F.col("gain") > 0.5) | F.col("strict") & (F.col("weight") > 7))
    sure = F.col("alone") & (kinds >= 0.3) & ((F.col("near") >= 0.6) | (members >= 0.5) | apart)
    score = F.col("gain") / 5 + 2 * F.col("near") + 2 * members + same + 0.5 * kinds
    scored = here.select("file_id", "parent", "name", "r", "alone", sure.alias("sure"), score.alias("score")).where("sure OR NOT alone")
    best = F.row_number().over(Window.partitionBy("file_id", "parent", "name").orderBy(F.desc("score"), "r"))
    return scored.withColumn("k", best).where("k = 1 AND sure").select("file_id", "parent", "name", F.col("r").alias("stands_for"), "score")


def aliases(files: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path-value rows under registered paths, alias table by file), resolved from the top down.

    ``path`` holds a member's names, ``std`` those it is registered under. As many levels are resolved as the registry,
    the agreed schema, has; deeper members belong to a value.
    """
    agreed = _agreed(registry)
    kids: dict[str, list[str]] = {}
    for p, _, _ in agreed:
        kids.setdefault(p.rpartition(".")[0], []).append(p.rpartition(".")[2])
    rows_ = [(p, t, need, p.rpartition(".")[0], p.rpartition(".")[2], kids.get(p)) for p, t, need in agreed]
    reg = files.sparkSession.createDataFrame(rows_, "field_path string, json_type string, is_required boolean, parent string, name string, child_names array<string>")
    levels = max((p.count(".") + 1 for p, _, _ in agreed), default=1)
    maps = path_values(files, levels)
    flat = checkpointed(maps.select("file_id", F.explode("nodes").alias("x")).select("file_id", "x.*", F.col("x.path").alias("std")).where("path[0] <> 'meta'"))
    parents = F.broadcast(reg.where("json_type = 'object'").select(F.col("field_path").alias("parent")))
    table = None
    for k in range(1, levels + 1):
        up = F.array_join(F.slice("std", 1, k - 1), ".") if k > 1 else F.lit("")
        rows = flat.where(F.size("path") == k).select("file_id", up.alias("parent"), F.get("path", F.lit(k - 1)).alias("name"), "raw_type", "members", "tokens")
        if k == 1:
            holders = files.select("file_id", F.lit("").alias("parent")).distinct()
        else:
            above = flat.where((F.size("path") == k - 1) & (F.col("raw_type") == "object"))
            holders = above.select("file_id", F.array_join("std", ".").alias("parent")).join(parents, "parent", "left_semi")
            rows = rows.join(parents, "parent", "left_semi")
        level = rows.unionByName(holders.withColumn("name", F.lit(None).cast("string")), allowMissingColumns=True)
        found = checkpointed(_resolve(level, reg))
        table = found if table is None else table.unionByName(found)
        look = found.select(F.col("file_id").alias("_f"), F.col("parent").alias("_p"), F.col("name").alias("_n"), F.col("stands_for").alias("_s"))
        own = (F.col("file_id") == F.col("_f")) & (up == F.col("_p")) & (F.get("path", F.lit(k - 1)) == F.col("_n"))
        named = F.transform("std", lambda x, i: F.when((i == k - 1) & F.col("_s").isNotNull(), F.col("_s")).otherwise(x))  # noqa: B023
        flat = checkpointed(flat.join(small_side(look), own, "left").withColumn("std", named).drop("_f", "_p", "_n", "_s"))
    return flat, table


def _agreed(registry: DataFrame) -> list[tuple[str, str, bool]]:
    """(field_path, json_type, is_required): the agreed schema, one row per column of the result, read by the driver as such."""
    rows = registry.select("field_path", "json_type", "is_required").distinct().orderBy("field_path").collect()
    return [(r["field_path"], r["json_type"], bool(r["is_required"])) for r in rows]


def _valid(kind: Column, registered: str) -> Column:
    """``valid`` as a column, for one registered type."""
    out = kind.isin("null", registered, *(["int"] if registered == "double" else []))
    if registered.startswith("array<"):
        want = [registered[6:-1], *(["int"] if registered == "array<double>" else [])]
        inner = F.regexp_extract(kind, "^array<(.*)>$", 1)
        out = out | (kind == "array<>") | (kind.startswith("array<") & F.forall(F.split(inner, r"\|"), lambda x: x.isin(*want)))
    return out


def projected(files: DataFrame, registry: DataFrame, values: bool = False) -> tuple[DataFrame, list[tuple[str, str, bool]]]:
    """(one row per file: file_id, at, foreign; the agreed schema). The path-value map of each file under registered paths.

    ``at``: by registered path the name, raw type (and value) of the member that stands there, its own name before an alias;
    ``foreign``: (parent, name) of members that are not registered and stand for nothing.
    """
    agreed = _agreed(registry)
    paths = F.array(*[F.lit(p) for p, _, _ in agreed]) if agreed else F.array().cast("array<string>")
    flat, _ = aliases(files, registry)
    own, stands = F.element_at("path", -1), F.element_at("std", -1)
    parent = F.array_join(F.slice("std", 1, F.size("std") - 1), ".")
    member = F.struct(F.array_join("std", ".").alias("at"), (own != stands).alias("renamed"), own.alias("name"), "path", parent.alias("parent"), "raw_type", *(["value"] if values else []))
    per = flat.groupBy("file_id").agg(F.array_sort(F.collect_list(member)).alias("nodes"))
    # sorted by place: of members that stand for one path that under the registered name comes first, and of aliases the first by name; the others are foreign
    first = lambda x, i: F.array_contains(paths, x["at"]) & F.coalesce(F.get("nodes", i - 1)["at"] != x["at"], F.lit(True))
    taken = F.transform(F.filter("nodes", first), lambda x: F.struct(x["at"], F.struct(*[x[c].alias(c) for c in ("name", "renamed", "raw_type", *(["value"] if values else []))])))
    per = per.select("file_id", F.map_from_entries(taken).alias("at"), F.transform(F.filter("nodes", lambda x, i: ~first(x, i)), lambda x: F.struct(x["parent"].alias("parent"), x["name"].alias("name"))).alias("foreign"))
    return files.select("file_id").distinct().join(per, "file_id", "left"), agreed


def changes(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(file_id, change, field_path): every change of a file against the registry, topmost paths only.

    Each registered path is projected out of the file's path-value map: absent, under another name, or of a type that the
    registered one does not take. A path is looked at if all objects above it are there as objects.
    """
    whole, agreed = projected(files, registry)
    kinds = {p: t for p, t, _ in agreed}
    got = lambda p: F.element_at("at", F.lit(p))
    opens = lambda p: F.coalesce(got(p)["raw_type"] == "object", F.lit(False)) if kinds[p] == "object" else F.lit(False)

    def above(p: str) -> Column:
        parts, out = p.split("."), F.lit(True)
        for i in range(1, len(parts)):
            up = ".".join(parts[:i])
            out = out & (opens(up) if up in kinds else F.lit(False))
        return out

    found = []
    for p, kind, required in agreed:
        here = got(p).isNotNull()
        found.append(F.when(above(p) & here & got(p)["renamed"], F.struct(F.lit("renamed").alias("change"), F.lit(p).alias("field_path"))))
        found.append(F.when(above(p) & here & ~_valid(got(p)["raw_type"], kind), F.struct(F.lit("retyped").alias("change"), F.lit(p).alias("field_path"))))
        if required:
            found.append(F.when(above(p) & ~here, F.struct(F.lit("removed").alias("change"), F.lit(p).alias("field_path"))))
    objects = [p for p, t, _ in agreed if t == "object"]
    open_ = F.filter(F.array(F.lit(""), *[F.when(above(p) & opens(p), F.lit(p)) for p in objects]), lambda x: x.isNotNull())
    full = lambda x: F.when(x["parent"] == "", x["name"]).otherwise(F.concat(x["parent"], F.lit("."), x["name"]))
    registered = F.array(*[F.lit(p) for p in kinds]) if kinds else F.array().cast("array<string>")
    extra = F.filter(F.coalesce("foreign", F.array().cast("array<struct<parent: string, name: string>>")), lambda x: F.array_contains(open_, x["parent"]) & ~F.array_contains(registered, full(x)))
    added = F.transform(extra, lambda x: F.struct(F.lit("added").alias("change"), full(x).alias("field_path")))
    every = F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), added) if found else added
    return whole.select("file_id", F.inline(every)).distinct()


def _cast(value: Column, json_type: str) -> Column:
    sql = {"int": "int", "double": "double", "boolean": "boolean", "string": "string"}.get(json_type)
    if sql:
        return value.try_cast(sql)
    return F.from_json(value, json_type) if json_type.startswith("array") else value


def conformed(files: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per file in the registered form: a typed column per leaf path, plus ``failed_casts``."""
    whole, agreed = projected(files, registry, values=True)
    leaves = [(p, t) for p, t, _ in agreed if t != "object"]
    got = lambda p: F.element_at("at", F.lit(p))["value"]
    failed = F.filter(F.array(*[F.when(got(p).isNotNull() & _cast(got(p), t).isNull(), F.lit(p)) for p, t in leaves]), lambda x: x.isNotNull())
    return whole.select("file_id", *[_cast(got(p), t).alias(p.replace(".", "__")) for p, t in leaves], failed.alias("failed_casts"))


def statistics(files: DataFrame) -> DataFrame:
    """(path, raw_type, n_files, first_file, last_file): where each path occurs with which type."""
    rows = path_values(files).select("file_id", F.explode("nodes").alias("x")).select("file_id", F.array_join("x.path", ".").alias("path"), "x.raw_type")
    return rows.groupBy("path", "raw_type").agg(F.countDistinct("file_id").alias("n_files"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))
