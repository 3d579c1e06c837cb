"""Structural analysis: roles of files, what directories hold, projects and their relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths

# The role rules. They are tried in this order and the first that fits decides.
SEGMENT_RULES = (
    ("R110", "DEPENDENCY_ENVIRONMENT", 0.96, (".venv", "venv", "node_modules", "site-packages")),
    ("R120", "CACHE", 0.96, (".cache", "cache", "caches")),
    ("R130", "BUILD_OUTPUT", 0.96, ("build", "dist", "target", "out")),
)
PROJECT_NAMES = ("pyproject.toml", "package.json", "cargo.toml", "cmakelists.txt")
PROJECT_EXTENSIONS = (".sln", ".csproj")
EXTENSION_RULES = (
    ("R220", "SOURCE", 0.90, (".py", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".js", ".ts", ".java")),
    ("R230", "CONFIGURATION", 0.82, (".json", ".toml", ".yaml", ".yml", ".ini", ".cfg")),
    ("R240", "DOCUMENTATION", 0.86, (".md", ".rst")),
    ("R250", "ARCHIVE", 0.88, (".zip", ".7z", ".rar", ".tar", ".gz")),
    ("R260", "INSTALLER", 0.86, (".exe", ".msi", ".dmg", ".pkg")),
)
MEDIA = (".wav", ".flac", ".mp3", ".png", ".jpg", ".jpeg", ".mov", ".mp4")
EXPORTS = ("exports", "final exports", "renders")
MARKER_WEIGHTS = {"pyproject.toml": 5, "package.json": 5, "cargo.toml": 5, "cmakelists.txt": 4, ".sln": 5, ".csproj": 5}
PROJECT_SCORE = 4


def _first_segment(markers: tuple[str, ...]) -> Column:
    return F.get(F.filter(F.col("_above"), lambda s: s.isin(*markers)), F.lit(0))


def _result(rule: str, role: str, confidence: float, explanation: Column, evidence: Column | None) -> Column:
    found = F.array(evidence) if evidence is not None else F.array().cast("array<string>")
    return F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule_id"), explanation.alias("explanation"), found.alias("evidence"))


def classify_roles(items: DataFrame) -> DataFrame:
    """``items`` (relative_path, name, extension and more) with role, confidence, rule_id, explanation and evidence.

    Case does not matter. A directory above the file decides before the file's own name. Items whose ``kind`` is not
    file, where that column is given, have rule R000.
    """
    low = items.withColumns({
        "_above": F.filter(F.expr("split(lower(replace(relative_path, '\\\\', '/')), '/')"), lambda s: s != ""),
        "_name": F.lower("name"),
        "_ext": F.lower("extension"),
    })
    low = low.withColumn("_above", F.expr("slice(_above, 1, greatest(size(_above) - 1, 0))"))
    chain = _result("R999", "UNKNOWN", 0.10, F.lit("No deterministic metadata rule matched."), None)
    is_media = F.col("_ext").isin(*MEDIA)
    chain = F.when(is_media, _result("R320", "ORIGINAL_MEDIA", 0.55, F.lit("Media extension observed; originality remains uncertain."), F.col("_ext"))).otherwise(chain)
    below = _first_segment(EXPORTS).isNotNull()
    chain = F.when(is_media & below, _result("R310", "FINAL_EXPORT", 0.84, F.lit("Media appears below an export-named directory."), F.col("_ext"))).otherwise(chain)
    texts = {
        "R220": "Extension is a source-code type.",
        "R230": "Extension is a configuration type.",
        "R240": "Name or extension indicates documentation.",
        "R250": "Extension is an archive container.",
        "R260": "Extension is an installer type.",
    }
    for rule, role, confidence, extensions in reversed(EXTENSION_RULES):
        fits, shown = F.col("_ext").isin(*extensions), F.col("_ext")
        if rule == "R240":
            fits, shown = fits | F.col("_name").startswith("readme"), F.col("_name")
        chain = F.when(fits, _result(rule, role, confidence, F.lit(texts[rule]), shown)).otherwise(chain)
    marker = F.col("_name").isin(*PROJECT_NAMES) | F.col("_ext").isin(*PROJECT_EXTENSIONS)
    chain = F.when(marker, _result("R210", "PROJECT_METADATA", 0.98, F.lit("Filename is a project marker."), F.col("_name"))).otherwise(chain)
    for rule, role, confidence, markers in reversed(SEGMENT_RULES):
        seg = _first_segment(markers)
        chain = F.when(seg.isNotNull(), _result(rule, role, confidence, F.format_string(f"Path segment '%s' identifies {role.lower()}.", seg), seg)).otherwise(chain)
    if "kind" in items.columns:
        chain = F.when(F.col("kind") == "file", chain).otherwise(_result("R000", "UNKNOWN", 0.2, F.lit("Directories are aggregated, not assigned file roles."), None))
    return low.withColumn("_r", chain).select(*items.columns, "_r.*")


def role_counts(files: DataFrame) -> DataFrame:
    """(relative_path, role, n, bytes) for each directory above a file, the root as ''.

    Files are first summed up by parent and role, so the expansion over ancestors sees directories, not files.
    """
    by_parent = files.groupBy(F.coalesce(paths.parent("relative_path"), F.lit("")).alias("p"), "role").agg(F.count(F.lit(1)).alias("n"), F.sum("logical_bytes").alias("bytes"))
    up = F.explode(paths.ancestors("p", itself=True)).alias("relative_path")
    return by_parent.select(up, "role", "n", "bytes").groupBy("relative_path", "role").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def coherence(counts: Column) -> Column:
    """1 - H / ln(k) over the counts of k roles; 1 for one role, 0 for none."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, n: a - n / total * F.ln(n / total))
    return F.when(F.size(counts) == 0, 0.0).when(F.size(counts) == 1, 1.0).otherwise(1.0 - entropy / F.ln(F.size(counts).cast("double")))


def directory_aggregates(files: DataFrame, directories: DataFrame) -> DataFrame:
    """(relative_path, recursive_bytes, file_count, directory_count, role_counts, role_coherence) for the root and every directory, empty ones too.

    ``files`` have roles. Roles are sorted before floating sums, so the result does not depend on the order of rows.
    """
    per_role = role_counts(files)
    held = per_role.groupBy("relative_path").agg(
        F.sum("bytes").alias("recursive_bytes"), F.sum("n").alias("file_count"), F.sort_array(F.collect_list(F.struct("role", "n"))).alias("r")
    )
    nested = directories.select(F.coalesce(paths.parent("relative_path"), F.lit("")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    nested = nested.select(F.explode(paths.ancestors("p", itself=True)).alias("relative_path"), "n").groupBy("relative_path").agg(F.sum("n").alias("directory_count"))
    root = directories.sparkSession.createDataFrame([("",)], "relative_path string")
    every = directories.select("relative_path").unionByName(root).distinct()
    zero = F.lit(0).cast("long")
    return (
        every.join(held, "relative_path", "left")
        .join(nested, "relative_path", "left")
        .select(
            "relative_path",
            F.coalesce("recursive_bytes", zero).alias("recursive_bytes"),
            F.coalesce("file_count", zero).alias("file_count"),
            F.coalesce("directory_count", zero).alias("directory_count"),
            F.coalesce(F.map_from_entries("r"), F.create_map().cast("map<string,bigint>")).alias("role_counts"),
            coherence(F.coalesce(F.transform("r", lambda x: x["n"]), F.array().cast("array<bigint>"))).alias("role_coherence"),
        )
    )


def projects(files: DataFrame) -> DataFrame:
    """(relative_path, score, markers): directories whose marker files weigh PROJECT_SCORE or more, markers sorted without case."""
    low, ext = F.lower("name"), F.lower("extension")
    weight = F.lit(None).cast("long")
    for marker, w in MARKER_WEIGHTS.items():
        weight = F.when((ext if marker.startswith(".") else low) == marker, F.lit(w).cast("long")).otherwise(weight)
    marked = files.select(F.coalesce(paths.parent("relative_path"), F.lit("")).alias("relative_path"), weight.alias("w"), "name").where("w is not null")
    found = marked.groupBy("relative_path").agg(F.sum("w").alias("score"), F.array_sort(F.collect_list(F.struct(F.lower("name").alias("low"), "name"))).alias("m"))
    return found.where(F.col("score") >= PROJECT_SCORE).select("relative_path", "score", F.transform("m", lambda x: x["name"]).alias("markers"))


def nearest_ancestor(items: DataFrame, candidates: DataFrame, *, out: str = "ancestor", itself: bool = False, root: bool = False) -> DataFrame:
    """Each item (relative_path) with its longest ancestor among ``candidates`` (relative_path), null without one.

    An equi-join on exploded ancestors; no prefix comparison of pairs.
    """
    up = items.select("relative_path", F.explode(paths.ancestors("relative_path", root=root, itself=itself)).alias("_up"))
    met = up.join(candidates.select(F.col("relative_path").alias("_up")), "_up")
    best = met.groupBy("relative_path").agg(F.max_by("_up", F.length("_up")).alias(out))
    return items.join(best, "relative_path", "left")


def relationships(found_projects: DataFrame, aggregates: DataFrame) -> DataFrame:
    """(source, relationship, target, n): HAS_ROLE of each project with counts, and NESTED_PROJECT to the nearest project above (never the root)."""
    roles = found_projects.select("relative_path").join(aggregates, "relative_path").select("relative_path", F.explode("role_counts").alias("target", "n"))
    has = roles.select(F.col("relative_path").alias("source"), F.lit("HAS_ROLE").alias("relationship"), "target", "n")
    nested = nearest_ancestor(found_projects.select("relative_path").where("relative_path <> ''"), found_projects.select("relative_path"), out="up").where("up is not null")
    return has.unionByName(nested.select(F.col("up").alias("source"), F.lit("NESTED_PROJECT").alias("relationship"), F.col("relative_path").alias("target"), F.lit(1).cast("long").alias("n")))
