"""Dependency manifests of a workspace as rows of the dependency inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.functions.text import header_field
from codelake.sources.srctree import SourceTree

COLUMNS = ["category", "dependency_type", "name", "version", "slug", "description", "author", "dependency_path"]


def _files(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("srctree").load(root).withColumn("text", F.when(F.is_valid_utf8("content"), F.col("content").cast("string")))


def _folders(files: DataFrame, below: str) -> DataFrame:
    """(name): folders of packages that hold a file, one or (scoped) two parts deep."""
    rest = F.split(F.substring("file_path", len(below) + 2, 1 << 20), "/")
    inside = files.where(F.col("file_path").startswith(below + "/"))
    one = inside.where(F.size(rest) > 1).select(rest[0].alias("name"))
    two = inside.where(F.size(rest) > 2).select(F.concat_ws("/", rest[0], rest[1]).alias("name"))
    return one.union(two).distinct()


def _row(rows: DataFrame, category: str, kind: str, **columns) -> DataFrame:
    given = {"category": F.lit(category), "dependency_type": F.lit(kind)} | columns
    return rows.select(*(given.get(c, F.lit(None)).cast("string").alias(c) for c in COLUMNS))


def composer(files: DataFrame) -> DataFrame:
    """Packages (not the development ones) of composer.lock whose vendor folder is there."""
    schema = "packages array<struct<name string, version string, description string>>"
    packages = files.where("file_path = 'composer.lock'").select(F.explode(F.from_json("text", schema)["packages"]).alias("p")).select("p.*")
    there = packages.join(_folders(files, "vendor"), "name", "left_semi")
    return _row(there, "composer", "composer_package", name=F.col("name"), version=F.coalesce("version", F.lit("unknown")), description=F.col("description"), dependency_path=F.concat(F.lit("vendor/"), "name"))


def npm(files: DataFrame) -> DataFrame:
    """Dependencies of package.json, development ones winning, whose folder is there; an installed package's own version wins."""
    wanted = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    main, dev = F.coalesce(wanted["dependencies"], empty), F.coalesce(wanted["devDependencies"], empty)
    both = F.map_concat(F.map_filter(main, lambda k, _: ~F.map_contains_key(dev, k)), dev)
    named = files.where("file_path = 'package.json'").select(F.explode(both).alias("name", "range"))
    own = files.where(F.col("file_path").rlike(r"^node_modules/(@[^/]+/)?[^/]+/package\.json$")).select(
        F.regexp_extract("file_path", r"^node_modules/(.+)/package\.json$", 1).alias("name"), F.from_json("text", "version string, description string").alias("j")
    )
    there = named.join(_folders(files, "node_modules"), "name", "left_semi").join(own, "name", "left")
    return _row(there, "npm", "npm_package", name=F.col("name"), version=F.coalesce("j.version", "range"), description=F.col("j.description"), dependency_path=F.concat(F.lit("node_modules/"), "name"))


def wordpress_plugins(files: DataFrame) -> DataFrame:
    """Folders of wp-content/plugins whose first PHP file (by path) with a plugin header names it and its version."""
    slug = F.regexp_extract("file_path", r"^wp-content/plugins/([^./][^/]*)/[^/]+\.php$", 1)
    heads = files.withColumn("slug", slug).where((F.col("slug") != "") & F.substring("text", 1, 8192).contains("Plugin Name:"))
    first = heads.groupBy("slug").agg(F.min_by("text", "file_path").alias("t"))
    t = F.col("t")
    named = first.select("slug", header_field(t, "Plugin Name").alias("n"), header_field(t, "Version").alias("v"), header_field(t, "Description").alias("d"), header_field(t, "Author").alias("a")).where("n is not null and v is not null")
    return _row(named, "plugins", "wordpress_plugin", name=F.col("n"), version=F.col("v"), slug=F.col("slug"), description=F.col("d"), author=F.col("a"), dependency_path=F.concat(F.lit("wp-content/plugins/"), "slug"))


def wordpress_themes(files: DataFrame) -> DataFrame:
    """Folders of wp-content/themes whose style.css names a theme; a missing version is ``unknown``."""
    slug = F.regexp_extract("file_path", r"^wp-content/themes/([^./][^/]*)/style\.css$", 1)
    t = F.col("text")
    named = files.withColumn("slug", slug).where("slug != ''").select(
        "slug", header_field(t, "Theme Name").alias("n"), F.coalesce(header_field(t, "Version"), F.lit("unknown")).alias("v"), header_field(t, "Description").alias("d"), header_field(t, "Author").alias("a")
    ).where("n is not null")
    return _row(named, "themes", "wordpress_theme", name=F.col("n"), version=F.col("v"), slug=F.col("slug"), description=F.col("d"), author=F.col("a"), dependency_path=F.concat(F.lit("wp-content/themes/"), "slug"))


def detect(spark: SparkSession, root: str) -> DataFrame:
    """All dependencies of a workspace."""
    files = _files(spark, root)
    return wordpress_plugins(files).unionByName(wordpress_themes(files)).unionByName(composer(files)).unionByName(npm(files))
