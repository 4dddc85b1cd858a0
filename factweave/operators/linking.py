"""Links across files: modules by longest known prefix, names by the imports that bind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import ranges, recursive


def resolved_modules(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """candidate, language, resolved: the module (alias, language or null for any, module) of the longest alias that is a whole-part prefix, and the rest.

    A candidate without a known prefix stands for itself.  A name is listed under its own prefixes and joined on
    equality, so nothing is compared pair by pair.
    """
    known = catalog.select("alias", F.coalesce("language", F.lit("")).alias("lang"), "module").groupBy("alias", "lang").agg(F.min("module").alias("module"))
    asked = candidates.select("candidate", F.coalesce("language", F.lit("")).alias("language")).distinct()
    # The language's own aliases and those of any language; of two equally long the language's own.
    either = asked.withColumn("lang", F.explode(F.array_distinct(F.array("language", F.lit("")))))
    parts = F.split("candidate", r"\.")
    listed = either.withColumn("alias", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))))
    hit = listed.join(known, ["alias", "lang"])
    best = hit.groupBy("candidate", "language").agg(F.max_by(F.struct("alias", "module"), F.struct(F.length("alias"), F.length("lang"))).alias("b"))
    rest = F.substr("candidate", F.length("b.alias") + 1)
    out = asked.join(best, ["candidate", "language"], "left")
    return out.select("candidate", "language", F.coalesce(F.concat("b.module", rest), "candidate").alias("resolved"))


def relative_module(importer: Column, module: Column) -> Column:
    """Absolute name of a module given with leading dots, seen from the importing module."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    parts = F.split(importer, r"\.")
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0)))
    rest = F.regexp_replace(module, r"^\.+", "")
    joined = F.concat_ws(".", F.array_join(base, "."), rest)
    return F.when(dots == 0, module).otherwise(F.regexp_replace(joined, r"^\.+|\.+$", ""))


def linked_references(refs: DataFrame, imports: DataFrame, catalog: DataFrame) -> DataFrame:
    """file_path, line, name, symbol_qn of every local reference (file_path, line, name): what the file's import binds its first part to.

    imports: file_path, module, imported_name (null for a whole module), alias (null if none), language.  A name that no
    import binds stays as it is.
    """
    target = F.when(F.col("imported_name").isNull(), F.col("module")).otherwise(F.concat_ws(".", "module", "imported_name"))
    root = F.coalesce("alias", "imported_name", F.split("module", r"\.")[0])
    # `import a.b` binds a; `import a.b as c` binds c to a.b.
    bound = F.when(F.col("imported_name").isNull() & F.col("alias").isNull(), root).otherwise(target)
    binding = imports.select("file_path", root.alias("root"), bound.alias("bound"), "language").groupBy("file_path", "root").agg(F.max(F.struct("bound", "language")).alias("x"))
    binding = binding.select("file_path", "root", "x.bound", "x.language")
    asked = refs.select("file_path", "line", "name", F.split("name", r"\.")[0].alias("root")).join(binding, ["file_path", "root"], "left")
    full = F.when(F.col("bound").isNull(), F.col("name")).otherwise(F.concat("bound", F.substr("name", F.length("root") + 1)))
    asked = asked.withColumn("candidate", full)
    found = resolved_modules(asked.where("bound is not null").select("candidate", "language"), catalog)
    joined = asked.withColumn("language", F.coalesce("language", F.lit(""))).join(found, ["candidate", "language"], "left")
    return joined.select("file_path", "line", "name", F.coalesce("resolved", "candidate").alias("symbol_qn"))


def linked_symbols(mapped: DataFrame, mapping: DataFrame, symbols: DataFrame) -> DataFrame:
    """qualified_name and found: names (qualified_name) looked up in other projects by the longest mapped module prefix (prefix, target).

    symbols: qualified_name.
    """
    out = ranges.longest_prefix(mapped, mapping, "qualified_name", "prefix")
    out = out.where("prefix is not null").select("qualified_name", F.concat("target", F.substr("qualified_name", F.length("prefix") + 1)).alias("found"))
    return out.join(symbols.select(F.col("qualified_name").alias("found")).distinct(), "found", "left_semi").select("qualified_name", "found")


def definition(spot_names: DataFrame, local: DataFrame, imported: DataFrame, indexed: DataFrame) -> DataFrame:
    """id, target and step of each name at a place (id, file_path, func_qn, name): the scope's own definition, the file's import, or the only symbol of that name.

    local: file_path, func_qn, name, target; imported: file_path, name, target; indexed: name, qualified_name.
    """
    one = lambda df, keys: df.groupBy(*keys).agg(F.min("target").alias("target"))
    single = indexed.groupBy("name").agg(F.countDistinct("qualified_name").alias("n"), F.min("qualified_name").alias("by_name")).where("n = 1").drop("n")
    out = (
        spot_names.join(one(local, ["file_path", "func_qn", "name"]).withColumnRenamed("target", "by_scope"), ["file_path", "func_qn", "name"], "left")
        .join(one(imported, ["file_path", "name"]).withColumnRenamed("target", "by_import"), ["file_path", "name"], "left")
        .join(single, "name", "left")
    )
    step = F.when(F.col("by_scope").isNotNull(), "scope").when(F.col("by_import").isNotNull(), "import").when(F.col("by_name").isNotNull(), "index")
    return out.select("id", F.coalesce("by_scope", "by_import", "by_name").alias("target"), step.alias("step")).where("target is not null")


def completions(prefix: str, local: DataFrame, imported: DataFrame, indexed: DataFrame, limit: int = 20) -> DataFrame:
    """name and score of names that begin with a prefix: local ones 2000, imported ones 1800, indexed ones 400; `limit` is the list's length."""
    parts = [df.select("name", F.lit(score).alias("score")) for df, score in ((local, 2000), (imported, 1800), (indexed, 400))]
    every = parts[0].union(parts[1]).union(parts[2]).where(F.lower("name").startswith(prefix.lower()))
    return every.groupBy("name").agg(F.max("score").alias("score")).orderBy(F.desc("score"), F.length("name"), "name").limit(limit)




def unused_modules(modules: DataFrame, imports: DataFrame, entries: DataFrame) -> DataFrame:
    """Modules (module) that no other module imports, whole or a part of them, and that are no entry (module).

    imports: importing_module, module, imported_name (null for a whole module).
    """
    target = F.explode(F.array(F.col("module"), F.concat_ws(".", "module", "imported_name")))
    used = imports.select("importing_module", target.alias("used")).where("importing_module <> used").select(F.col("used").alias("module")).distinct()
    return modules.select("module").distinct().join(used, "module", "left_anti").join(entries.select("module").distinct(), "module", "left_anti")


def class_members(classes: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """class, name, owner, level of the members (owner, name) of classes (class) and of all their bases (class, base), the nearest of each name."""
    ways = bases.select(F.col("class").alias("src"), F.col("base").alias("dst"))
    met = recursive.reachable(ways, classes.select("class", F.col("class").alias("node")), carry=("class",)).withColumnRenamed("node", "owner")
    return met.join(members, "owner").groupBy("class", "name").agg(F.min(F.struct("level", "owner")).alias("x")).select("class", "name", F.col("x.owner").alias("owner"), F.col("x.level").alias("level"))


def resolved_methods(typed_calls: DataFrame, symbol: DataFrame) -> DataFrame:
    """Calls (file_path, line, method, type_str) with the method of the receiver's class: symbols whose parent is the type, or ends in its short name."""
    own = symbol.where("parent is not null").select(F.split("parent", r"\.").alias("_p"), F.col("name").alias("method"), F.col("qualified_name").alias("callee_qn"))
    own = own.select(F.element_at("_p", -1).alias("type_name"), "method", "callee_qn")
    asked = typed_calls.withColumn("type_name", F.element_at(F.split("type_str", r"\."), -1))
    return asked.join(own, ["type_name", "method"]).select("file_path", "line", "method", "type_str", "callee_qn").distinct()
