"""Project manifests as rows, and import rows tied to the project they come from.

`manifests` takes whole files (path, content) and gives each project's own package prefix by language, by patterns in column
functions; a file's folder is its project.  `imports_masked` ties each import to the deepest project folder above its file that has
prefixes of its language (a join on exploded path prefixes, so no two tables are multiplied) and masks what is the project's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.functions.text import short_hash

# What is a project's own name in each kind of manifest.
GO, GROUP_ID, GRADLE, ROOT_NAMESPACE, NAME = r"(?m)^\s*module\s+(\S+)\s*$", r"<groupId>\s*([\w.-]+)\s*</groupId>", r"(?m)^\s*group\s*=?\s*[\"']([\w.-]+)[\"']", r"<RootNamespace>\s*([\w.]+)\s*</RootNamespace>", r"(?m)^\s*name\s*=\s*[\"']([\w.-]+)[\"']"
KINDS = {"go.mod": "go", "pom.xml": "jvm", "build.gradle.kts": "jvm", "build.gradle": "jvm", "csproj": "csharp", "pyproject.toml": "python", "Cargo.toml": "rust"}
PREFIX = {"class": "Class", "function": "fn", "interface": "Interface", "type": "Type", "enum": "Enum", "namespace": "Mod", "member": "m", "import": "Import"}
EXTENSION = r"(?i)\.(m?[jt]sx?|json|css)$"


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of whole files; Spark passes over files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("content").cast("string").alias("content"))


def _found(content: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))


def manifests(files: DataFrame) -> DataFrame:
    """Of `files` (path, content): project, language, prefix, problem; a JVM group gives two rows, java and kotlin.

    Of several manifests of a project and language pom.xml comes before Gradle's, and then the first by name.  A manifest in which no
    name is found has a null prefix and a `problem` that says so, if no other of its project has one.  Null contents count as empty;
    other files are left out.
    """
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = F.when(base.endswith(".csproj"), "csproj").when(base.isin(*[k for k in KINDS if k != "csproj"]), base)
    content = F.coalesce("content", F.lit(""))
    underscored = lambda c: F.replace(c, F.lit("-"), F.lit("_"))
    root = F.coalesce(_found(content, ROOT_NAMESPACE), F.regexp_replace("base", r"\.csproj$", ""))
    name = (
        F.when(F.col("kind") == "go.mod", _found(content, GO))
        .when(F.col("kind") == "pom.xml", F.concat(_found(content, GROUP_ID), F.lit(".")))
        .when(F.col("kind").startswith("build."), F.concat(_found(content, GRADLE), F.lit(".")))
        .when(F.col("kind") == "csproj", F.concat(F.split_part(root, F.lit("."), F.lit(1)), F.lit(".")))
        .otherwise(underscored(_found(content, NAME)))
    )
    rows = files.select("path", content.alias("content"), base.alias("base"), kind.alias("kind")).where("kind is not null")
    rows = rows.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("project"), "base", "kind", name.alias("prefix"))
    language = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("kind")]
    rank = F.when(F.col("kind") == "pom.xml", 0).when(F.col("kind") == "build.gradle.kts", 1).otherwise(2)
    best = rows.withColumn("language", language).groupBy("project", "language").agg(F.min(F.struct(F.col("prefix").isNull().alias("none"), rank.alias("rank"), "base", "prefix")).alias("b"))
    each = F.explode(F.when(F.col("language") == "jvm", F.array(F.lit("java"), F.lit("kotlin"))).otherwise(F.array("language")))
    return best.select("project", each.alias("language"), F.col("b.prefix").alias("prefix"), F.when(F.col("b.none"), F.concat(F.lit("no name found in "), F.col("b.base"))).alias("problem"))


@dataclass(frozen=True)
class ImportConfig:
    """`scopes` are prefixes of modules that are internal everywhere."""

    salt: str = ""
    hash_length: int = 6
    scopes: tuple[str, ...] = ()


def import_origin(module: Column, prefixes: Column, config: ImportConfig) -> Column:
    """relative, node, internal or external; `prefixes` are the project's own."""
    own = F.exists(F.coalesce(prefixes, F.array().cast("array<string>")), lambda p: (p != "") & (module.startswith(p) | (module == p)))
    listed = F.exists(F.array(*[F.lit(s) for s in config.scopes]).cast("array<string>"), lambda p: module.startswith(p))
    return F.when(module.startswith("."), "relative").when(module.startswith("node:"), "node").when(own | listed, "internal").otherwise("external")


def mask_identifier(name: Column, kind: Column, config: ImportConfig) -> Column:
    """A name as its kind's word and a hash; null for kinds that aren't known."""
    word = F.create_map(*[F.lit(x) for pair in PREFIX.items() for x in pair])
    return F.concat(F.try_element_at(word, kind), F.lit("_"), short_hash(name, config.salt, config.hash_length))


def mask_module(module: Column, config: ImportConfig) -> Column:
    """A module's path with its depth's beginning and its ending, all else hashed."""
    lead = F.regexp_extract(module, r"^(\.\.?/?)", 1)
    lead = F.when(lead == "", "./").when(lead.endswith("/"), lead).otherwise(F.concat(lead, F.lit("/")))
    return F.concat(lead, F.lit("mod_"), short_hash(module, config.salt, config.hash_length), F.regexp_extract(module, EXTENSION, 0))


def imports_masked(imports: DataFrame, projects: DataFrame, config: ImportConfig) -> DataFrame:
    """Of `imports` (id, path, language, module, name) and `projects` (project, language, prefix): id, module, name, project, origin,
    module_mask, name_mask; masks are null where the names stay.  `id` is unique.

    A file's folders are looked up among the projects; the deepest that has a prefix of the language counts, with all its prefixes.
    Files in no project have only the configuration's scopes; null modules have null origins.
    """
    held = projects.where("prefix is not null").groupBy("project", "language").agg(F.collect_set("prefix").alias("prefixes"))
    parts = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = imports.select("id", "language", F.posexplode(F.array_distinct(above)).alias("depth", "project"))
    met = up.join(held, ["project", "language"])
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("depth").desc()))
    deepest = met.withColumn("place", place).where("place = 1").select(F.col("id").alias("of"), "project", "prefixes")
    rows = imports.select("id", "module", "name").join(deepest, F.col("id") == F.col("of"), "left").withColumn("origin", F.when(F.col("module").isNotNull(), import_origin(F.col("module"), F.col("prefixes"), config)))
    own = F.col("origin").isin("relative", "internal")
    return rows.select("id", "module", "name", "project", "origin", F.when(own, mask_module(F.col("module"), config)).alias("module_mask"), F.when(own, mask_identifier(F.col("name"), F.lit("import"), config)).alias("name_mask"))
