"""The facts database as DataFrames: schemas, tolerant readers, project-scoped loaders and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from factloom.functions.text import blank_to_null, module_kind

SCHEMAS = {
    "projects": "id long, name string",
    "source_files": "id long, file_path string, file_size long",
    "project_files": "project_id long, file_id long",
    "modules": "id long, file_id long, original_name string, semantic_name string, module_category string, package_name string, package_version string, byte_start long, byte_end long",
    "symbols": "id long, module_id long, original_name string, semantic_name string, export_name string, scope_level string, semantic_name_source string",
    "module_dependencies": "module_id long, dependency_id long",
    "package_attributions": "module_id long, package_name string, package_version string, package_subpath string, export_specifier string, emission_mode string, status string, rejection_reason string, resolved_file string, evidence_json string, external_import_policy_version long",
    "package_surfaces": "project_id long, package_name string, package_version string, export_specifier string, status string, evidence_json string",
    "package_function_attributions": "module_id long, span_start long, span_end long, package_name string, package_version string, tier string, margin double, status string",
    "package_island_anchors": "project_id long, file_id long, binding string, package_name string, package_version string",
    "package_externalization_hints": "package_name string, package_version string, export_specifier string, public_members array<string>, proof string",
    "package_source_cache": "package_name string, package_version string, entry_path string, export_specifier string, source string, source_size long, expires_at timestamp, policy_version long, stale boolean",
    "fingerprint_cache": "content_hash string, fingerprint_json string",
    "island_package_candidates": "project_id long, package_name string, score double",
    "symbol_name_proposals": "id long, module_id long, original_name string, proposed_name string, origin string, status string, evidence string",
    "semantic_binding_names": "project_id long, file_id long, original_name string, binding_key string, semantic_name string, status string",
    "semantic_function_param_names": "module_id long, function_key string, position int, semantic_name string",
    "module_path_overrides": "module_id long, semantic_path string, origin string, status string, updated_at timestamp",
    "island_cluster_names": "fingerprint string, cluster_name string, status string",
    "module_classification": "project_id long, module_id long, origin string, class string, evidence string",
    "package_surface_decisions": "id long, project_id long, export_specifier string, package_name string, package_version string, decision string, evidence_json string",
    "project_assets": "id long, project_id long, logical_path string, output_path string, source_path string, kind string, executable boolean, platform string, arch string",
}

#: The policy under which external attributions must have been accepted.
POLICY_VERSION = 1


def schema(table: str) -> StructType:
    return _parse_datatype_string(SCHEMAS[table])


def with_defaults(df: DataFrame, wanted: StructType) -> DataFrame:
    """df with exactly the wanted columns; missing ones are typed nulls."""
    there = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(there[f.name.lower()]) if f.name.lower() in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])


def read(spark: SparkSession, root: str, table: str, optional: bool = True) -> DataFrame:
    """A table of a facts folder; a missing optional one is empty, older columns are filled in."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(f"{root}/{table}.parquet")
    except AnalysisException as e:
        if not optional or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema(table))
    return with_defaults(found, schema(table))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def column_exists(df: DataFrame, name: str) -> bool:
    return name.lower() in {c.lower() for c in df.columns}


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; give an order without ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def project(projects: DataFrame, project_id: int) -> DataFrame:
    """The project's row; an error where there is none."""
    found = projects.filter(F.col("id") == project_id).limit(1)
    if found.isEmpty():
        raise LookupError(f"project {project_id} is not in the facts")
    return found


def in_project(rows: DataFrame, project_files: DataFrame, project_id: int, file_col: str) -> DataFrame:
    files = project_files.filter(F.col("project_id") == project_id).select(F.col("file_id").alias("_f")).distinct()
    return rows.join(files, rows[file_col] == F.col("_f"), "left_semi")


def source_files(files: DataFrame, project_files: DataFrame, project_id: int) -> DataFrame:
    return in_project(files, project_files, project_id, "id").orderBy("id")


def modules(mods: DataFrame, project_files: DataFrame, overrides: DataFrame, project_id: int) -> DataFrame:
    """A project's modules with kind and path: the latest accepted override wins over the semantic name."""
    accepted = overrides.filter("status = 'accepted'").withColumn("semantic_path", blank_to_null(F.col("semantic_path"))).filter("semantic_path is not null")
    best = first_per(accepted, ["module_id"], [F.col("updated_at").desc_nulls_last(), F.col("origin").desc_nulls_last(), F.col("semantic_path")])
    best = best.select(F.col("module_id").alias("id"), F.col("semantic_path").alias("override_path"))
    rows = in_project(mods, project_files, project_id, "file_id").join(best, "id", "left")
    return rows.withColumn("path", F.coalesce("override_path", blank_to_null(F.col("semantic_name")), F.col("original_name"))).withColumn("kind", module_kind(F.col("module_category")))


def module_symbols(symbols: DataFrame, project_modules: DataFrame) -> DataFrame:
    scoped = symbols.filter(F.coalesce("scope_level", F.lit("module")) == "module").join(project_modules.select(F.col("id").alias("module_id")), "module_id", "left_semi")
    return scoped.select("module_id", "original_name", "semantic_name", "export_name").distinct()


def module_dependencies(edges: DataFrame, project_modules: DataFrame) -> DataFrame:
    ids = project_modules.select("id")
    return edges.join(ids.withColumnRenamed("id", "module_id"), "module_id", "left_semi").join(ids.withColumnRenamed("id", "dependency_id"), "dependency_id", "left_semi").distinct()


def attributions(rows: DataFrame, policy: int = POLICY_VERSION) -> DataFrame:
    """External attributions under another policy, or of TypeScript sources, read as rejected application code."""
    external = (F.col("status") == "accepted") & (F.col("emission_mode") == "external_import")
    stale = external & (F.coalesce("external_import_policy_version", F.lit(-1)) != policy)
    typed = external & ~stale & F.col("export_specifier").rlike(r"\.[cm]?tsx?$")
    bad = stale | typed
    reason = F.when(stale, F.lit("external import policy is stale")).when(typed, F.concat(F.lit("specifier resolves to a TypeScript source: "), F.col("export_specifier")))
    return rows.select(
        "module_id", "package_name", "package_version", "package_subpath",
        F.when(~bad | bad.isNull(), F.col("export_specifier")).alias("export_specifier"),
        F.when(bad, "application_source").otherwise(F.col("emission_mode")).alias("emission_mode"),
        F.when(bad, "rejected").otherwise(F.col("status")).alias("status"),
        F.coalesce(reason, F.col("rejection_reason")).alias("rejection_reason"),
        F.when(~bad | bad.isNull(), F.col("resolved_file")).alias("resolved_file"), "evidence_json", "external_import_policy_version",
    )


def ownership_from_functions(rows: DataFrame) -> DataFrame:
    """A package for each module whose function attributions all name one; others are left out."""
    named = rows.filter(blank_to_null(F.col("package_name")).isNotNull()).groupBy("module_id", "package_name", "package_version").agg(F.count(F.lit(1)).alias("functions"))
    each = named.groupBy("module_id").agg(F.count_distinct("package_name").alias("_packages"))
    single = named.join(each.filter("_packages = 1").select("module_id"), "module_id")
    return first_per(single, ["module_id"], [F.col("functions").desc(), F.col("package_version").desc_nulls_last()])


def text_slices(mods: DataFrame, contents: DataFrame) -> DataFrame:
    """Module texts cut from binary file contents (file_id, content) by byte."""
    return mods.join(contents, "file_id").withColumn("source", F.expr("substring(content, int(byte_start) + 1, int(byte_end - byte_start))").cast("string")).drop("content")


#: What domains allow (fixed values).
DOMAINS = {
    ("package_attributions", "status"): ("proposed", "accepted", "rejected"),
    ("package_attributions", "emission_mode"): ("external_import", "application_source", "vendored"),
    ("symbols", "scope_level"): ("module", "function", "local", "block"),
}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, table, key) of every row that breaks a rule. Analyses start only when there is none."""
    out: list[DataFrame] = []

    def add(rule: str, table: str, rows: DataFrame, key: Column) -> None:
        out.append(rows.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), key.cast("string").alias("key")))

    def unmatched(child: str, column: str, parent: str, parent_key: str = "id") -> None:
        if child in tables and parent in tables:
            keys = tables[parent].select(F.col(parent_key).alias("_k")).distinct()
            rows = tables[child].filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_k"), "left_anti")
            add(f"{column} names no row of {parent}", child, rows, F.col(column))

    for child, column, parent in (
        ("project_files", "project_id", "projects"), ("project_files", "file_id", "source_files"), ("modules", "file_id", "source_files"), ("symbols", "module_id", "modules"),
        ("module_dependencies", "module_id", "modules"), ("module_dependencies", "dependency_id", "modules"), ("package_attributions", "module_id", "modules"), ("package_surfaces", "project_id", "projects"),
    ):
        unmatched(child, column, parent)
    for table, key in (("projects", "id"), ("source_files", "id"), ("modules", "id"), ("package_attributions", "module_id")):
        if table in tables:
            add(f"{key} is repeated", table, tables[table].groupBy(key).count().filter("count > 1"), F.col(key))
    for (table, column), allowed in DOMAINS.items():
        if table in tables:
            add(f"{column} is out of its domain", table, tables[table].filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)), F.col(column))
    if "modules" in tables:
        add("byte range is empty or reversed", "modules", tables["modules"].filter("byte_start < 0 or byte_end <= byte_start"), F.col("id"))
    if (a := tables.get("package_attributions")) is not None:
        add("accepted without a version", "package_attributions", a.filter("status = 'accepted' and coalesce(trim(package_version), '') = ''"), F.col("module_id"))
        add("external without a specifier", "package_attributions", a.filter("status = 'accepted' and emission_mode = 'external_import' and coalesce(trim(export_specifier), '') = ''"), F.col("module_id"))
        add("rejected without a reason", "package_attributions", a.filter("status = 'rejected' and coalesce(trim(rejection_reason), '') = ''"), F.col("module_id"))
    whole = out[0]
    for rows in out[1:]:
        whole = whole.unionByName(rows)
    return whole


def validated(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables, or an error that shows the first violations."""
    broken = violations(tables).limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r['table']}: {r['rule']} ({r['key']})" for r in broken))
    return tables
