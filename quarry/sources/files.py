"""Sources and sinks: text tables, source trees, versioned tables, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.runtime import materialise


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def entries(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is directory) of a folder on any file system, sorted; none if it is missing."""
    fs, p = _fs(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)) if fs.exists(p) else []


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; nothing is inferred, so the file is read once."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every CSV file or folder of a folder, by stem."""
    return {n[:-4]: read_csv(spark, f"{folder}/{n}") for n, _ in entries(spark, folder) if n.endswith(".csv")}


def json_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def source_files(spark: SparkSession, root: str, extensions: list[str], most_bytes: int = 750_000) -> DataFrame:
    """(path, length, text) of a tree's files.  Extension and size are filtered before the
    content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kept = files.where(kind.isin(extensions) & (F.col("length") <= most_bytes))
    relative = F.regexp_replace("path", r"^.*?" + _quoted(root.rstrip("/").split("://")[-1]) + "/", "")
    return kept.select(relative.alias("path"), "length", F.decode("content", "UTF-8").alias("text"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def read_lines(files: DataFrame, path: str, start: int, end: int, most: int = 181) -> DataFrame:
    """(status, line, text): a range of a file's lines, or one row that says why not."""
    one = files.where(F.col("path") == path)
    lines = one.select(F.posexplode(F.split("text", "\n")).alias("at", "text")).select(F.lit("ok").alias("status"), (F.col("at") + 1).alias("line"), "text")
    found = lines.where(F.col("line").between(max(1, start), min(end, max(1, start) + most - 1)))
    inside = files.agg(F.max((F.col("path") == path).cast("int")).alias("file"), F.max(F.col("path").startswith(path.rstrip("/") + "/").cast("int")).alias("dir"))
    status = F.when(F.col("file") == 1, None).when(F.col("dir") == 1, "directory").otherwise("missing")
    return found.unionByName(inside.select(status.alias("status"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text")).where("status IS NOT NULL"))


def list_directory(files: DataFrame, folder: str, most: int = 120) -> DataFrame:
    """(kind, name): directories, then files, each sorted, from path prefixes alone."""
    prefix = folder.strip("/") + "/" if folder.strip("/") not in ("", ".") else ""
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 20)
    inside = files.where(F.col("path").startswith(prefix)).select(rest.alias("r")).where("r <> ''")
    kind = F.when(F.contains("r", F.lit("/")), "dir").otherwise("file")
    return inside.select(kind.alias("kind"), F.substring_index("r", "/", 1).alias("name")).distinct().orderBy("kind", "name").limit(most)


def directory_preview(files: DataFrame, depth: int = 1, first: int = 8) -> DataFrame:
    """Per directory down to a depth: files below, files and directories directly inside,
    counts by extension, and the names of the first files."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = files.where(F.size(parts) > 1).select("path", F.explode(dirs).alias("dir"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"))
    rest = F.expr("substring(path, length(dir) + 2)")
    direct = ~F.contains(rest, F.lit("/"))
    by_ext = each.groupBy("dir", "ext").agg(F.count("*").alias("n"), F.sum(direct.cast("int")).alias("d"))
    counts = by_ext.groupBy("dir").agg(F.sum("n").alias("descendants"), F.sum("d").alias("direct_files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("extensions"))
    inner = each.where(~direct).groupBy("dir").agg(F.count_distinct(F.substring_index(rest, "/", 1)).alias("direct_dirs"))
    w = Window.partitionBy("dir").orderBy("name")
    names = each.where(direct).select("dir", rest.alias("name")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= first)
    held = names.groupBy("dir").agg(F.array_sort(F.collect_list("name")).alias("files"))
    rows = counts.join(inner, "dir", "left").join(held, "dir", "left")
    return rows.select("dir", "descendants", "direct_files", F.coalesce("direct_dirs", F.lit(0)).alias("direct_dirs"), "extensions", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def dependencies(components: DataFrame) -> DataFrame:
    """(component, name) of what component files say they depend on.  components: component,
    text."""
    named = F.regexp_extract_all("text", F.lit(r"(?i)<depends-on\b[^>]*?\bname=[\"']([^\"']+)[\"']"), 1)
    built = F.regexp_extract_all("text", F.lit(r"runtime:component:([A-Za-z0-9_.-]+)"), 1)
    return components.select("component", F.explode(F.array_distinct(F.concat(built, named))).alias("name"))


def reachable(start: DataFrame, depends: DataFrame, deepest: int = 100) -> DataFrame:
    """All components that some depend on, directly or not, themselves included.  A round per
    step of the longest chain; more than ``deepest`` raise an error.  start: component;
    depends: component, name."""
    seen = materialise(start.select("component").distinct(), "reached")
    edge = seen
    for _ in range(deepest):
        step = edge.join(depends, "component").select(F.col("name").alias("component")).distinct()
        edge = materialise(step.join(seen, "component", "left_anti"), "reached")
        if edge.isEmpty():
            return seen
        seen = seen.unionByName(edge)
    raise ValueError(f"a chain of dependencies has over {deepest} steps")


def attach_missing(hits: DataFrame, extra_hits: DataFrame, order: DataFrame, most: int = 3) -> DataFrame:
    """Hits of each query; where a query has none, those of the first of its ``most`` extra
    sources that has any.  hits: query, hit; extra_hits: query, source, hit; order: source, ord."""
    few = order.orderBy("ord").limit(most)
    lost = extra_hits.join(hits.select("query").distinct(), "query", "left_anti").join(F.broadcast(few), "source")
    least = lost.groupBy("query").agg(F.min("ord").alias("ord"))
    return hits.select("query", "hit").unionByName(lost.join(least, ["query", "ord"]).select("query", "hit"))


#: What a knowledge store holds, and what of it lasts when it is written.
STORE = {"status": "idle", "repository": "", "workflows": "[]", "checkpoints": "{}", "events": "[]", "plan": "{}"}
TRANSIENT = ("status", "events", "plan")


def load_store(spark: SparkSession, folder: str) -> dict[str, str]:
    """The newest stored state over the defaults; without one, the defaults."""
    saved = read_newest(spark, folder)
    rows = {r["key"]: r["value"] for r in saved.collect()} if saved is not None else {}  # a row per key
    return STORE | {k: v for k, v in rows.items() if k in STORE and k not in TRANSIENT and v is not None}


def save_store(spark: SparkSession, folder: str, state: dict[str, str]) -> int:
    """Write a new version of what lasts; writing the defaults resets the store."""
    lasting = [(k, v) for k, v in state.items() if k in STORE and k not in TRANSIENT]
    return write_version(spark.createDataFrame(lasting, "key string, value string"), folder)


def write_version(df: DataFrame, folder: str) -> int:
    """Write a new numbered version; Spark's commit marker makes it visible at once."""
    spark = df.sparkSession
    n = next_number(spark, folder, "version-")
    df.write.parquet(f"{folder}/version-{n:06d}")
    return n


def read_newest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest version that was committed; unfinished ones are passed over."""
    for name, is_dir in reversed(entries(spark, folder)):
        if is_dir and name.startswith("version-") and exists(spark, f"{folder}/{name}/_SUCCESS"):
            return spark.read.parquet(f"{folder}/{name}")
    return None


def numbers(spark: SparkSession, folder: str, prefix: str = "episode-") -> list[int]:
    names = (n[len(prefix) :].split(".")[0] for n, _ in entries(spark, folder) if n.startswith(prefix))
    return sorted(int(n) for n in names if n.isdigit())


def next_number(spark: SparkSession, folder: str, prefix: str = "episode-") -> int:
    return max(numbers(spark, folder, prefix), default=0) + 1


def append_events(df: DataFrame, folder: str, episode: int) -> None:
    df.write.mode("append").json(f"{folder}/episode-{episode:06d}")


def read_events(spark: SparkSession, folder: str, episode: int, schema: str) -> DataFrame:
    """An episode's events; a missing episode is empty."""
    path = f"{folder}/episode-{episode:06d}"
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def newest_by(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def tolerant_json(text: Column) -> Column:
    """The outermost braces of a text as an open value; null if they hold no JSON."""
    return F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
