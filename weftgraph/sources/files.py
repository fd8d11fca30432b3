"""Readers for texts, CSV rows, web pages and binary files, and the registry that picks one by extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_EXTENSIONS = ("txt", "md", "json", "xml", "yaml", "yml", "log")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files below a path: doc_id (MD5 of the content), path, text."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.md5("value").alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias("text"))


def rows_as_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df with a column text: each row as 'name: value, name: value'."""
    return df.withColumn("text", F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns or df.columns]))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, as texts."""
    return rows_as_text(spark.read.option("header", True).option("multiLine", True).csv(path))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """File metadata: path, name, extension, size, content_hash, is_text (no NUL byte)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.md5("content").alias("content_hash"), (F.instr(F.col("content").cast("string"), "\u0000") == 0).alias("is_text"))


_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {**dict.fromkeys(TEXT_EXTENSIONS, read_texts), "csv": read_csv}


def use_reader(extension: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Registers a reader for an extension."""
    _READERS[extension.lower()] = reader


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reads a path by its extension; unknown ones as text."""
    return _READERS.get(path.rsplit(".", 1)[-1].lower(), read_texts)(spark, path)


_KINDS = {**dict.fromkeys(TEXT_EXTENSIONS, "text"), "csv": "table", "tsv": "table", "parquet": "table", "pdf": "pdf", **dict.fromkeys(("png", "jpg", "jpeg", "gif", "bmp", "webp"), "image"), **dict.fromkeys(("mp3", "wav", "flac", "ogg", "m4a"), "audio"), **dict.fromkeys(("html", "htm"), "page"), **dict.fromkeys(("py", "js", "ts", "java", "go", "rs", "c", "cpp"), "code")}
_MAGIC = (("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("25504446", "pdf"), ("494433", "audio"), ("664C6143", "audio"), ("4F676753", "audio"), ("504B0304", "archive"))


def guessed_kind(name, content=None):
    """A file's kind by its extension, else by its first bytes, else text."""
    by_name = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))]
    if content is None:
        return F.coalesce(by_name, F.lit("text"))
    head = F.hex(F.substring(content, 1, 8))
    by_bytes = F.coalesce(*[F.when(F.startswith(head, F.lit(m)), k) for m, k in _MAGIC], F.lit("text"))
    return F.coalesce(by_name, by_bytes)


def datasets_of(paths: DataFrame, root: str, prefix: str | None = None) -> DataFrame:
    """Datasets of files by their folder below a root, its parts joined by dots (main for the root itself): dataset, n_files, paths in order; those whose name has a prefix, if given."""
    folder = F.regexp_extract(F.replace(F.col("path"), F.lit(root.rstrip("/") + "/"), F.lit("")), r"^(.*)/[^/]*$", 1)
    name = F.coalesce(F.nullif(F.replace(folder, F.lit("/"), F.lit(".")), F.lit("")), F.lit("main"))
    out = paths.groupBy(name.alias("dataset")).agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list("path")).alias("paths"))
    return out if prefix is None else out.where(F.startswith("dataset", F.lit(prefix)))


def node_sets(documents: DataFrame, metadata: str = "metadata", id_col: str = "id") -> DataFrame:
    """Sets that a document's metadata (JSON with node_set, an array of names) puts it in: id, name, node_set_id."""
    from ..functions.ids import uuid5

    names = F.from_json(F.get_json_object(metadata, "$.node_set"), "array<string>")
    return documents.select(id_col, F.explode(F.array_distinct(names)).alias("name")).withColumn("node_set_id", uuid5(F.concat(F.lit("NodeSet:"), F.col("name"))))


def csv_text(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """A table as one text for each row with its number from 1 in a stated order, dealt out without gathering rows in one task: number, text."""
    from ..operators.graph import numbered

    placed = numbered(rows, order, name="__number").withColumn("__number", F.col("__number") + 1)
    return rows_as_text(placed, columns).select(F.col("__number").alias("number"), F.concat(F.lit("Row "), F.col("__number").cast("string"), F.lit(": "), F.col("text")).alias("text"))


def allowed_urls(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """urls (url) with whether the rules of their site allow them (base_url, agent, path, allow): the longest rule that begins the path decides, allow on ties; no rule allows all. url, allowed."""
    own = rules.where(F.col("agent").isin(agent, "*"))
    site = urls.withColumn("base_url", base_url(F.col("url"))).withColumn("__path", F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1), F.lit("")), F.lit("/")))
    fits = site.join(own, "base_url", "left").withColumn("__fits", F.coalesce(F.startswith("__path", "path") & (F.length("path") > 0), F.lit(False)))
    best = F.max(F.when(F.col("__fits"), F.struct(F.length("path").alias("n"), "allow")))
    return fits.groupBy("url").agg(F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def crawl_times(urls: DataFrame, delays: DataFrame, default: float = 1.0) -> DataFrame:
    """When each page may be fetched at the earliest, in seconds from the start, if a site's pages keep its delay (base_url, delay) apart: the columns of urls (url and any others) and at.
    Each row is a fetch of its own, also where a url is repeated; rows of one url go by the other columns."""
    from pyspark.sql import Window

    site = urls.withColumn("__site", base_url(F.col("url"))).join(delays.select(F.col("base_url").alias("__site"), F.col("delay").alias("__delay")), "__site", "left")
    number = F.row_number().over(Window.partitionBy("__site").orderBy("url", *[c for c in urls.columns if c != "url"])) - 1
    return site.select(*urls.columns, (number * F.coalesce("__delay", F.lit(default))).alias("at"))


def base_url(url):
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def page_nodes(pages: DataFrame) -> DataFrame:
    """A node for each page: page_id, base_url, path, content_hash, preview (500 characters), n_pages of its site."""
    site = base_url(F.col("url"))
    totals = pages.groupBy(site.alias("base_url")).agg(F.count("*").alias("n_pages"))
    rows = pages.select(
        "page_id",
        site.alias("base_url"),
        F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)?", 1).alias("path"),
        F.sha2("html", 256).alias("content_hash"),
        F.substring("html", 1, 500).alias("preview"),
    )
    return rows.join(totals, rows["base_url"].eqNullSafe(totals["base_url"])).drop(totals["base_url"])


def new_and_known(items: DataFrame, known: DataFrame, key: str, dataset: str) -> DataFrame:
    """items with a status: 'known' in this dataset, 'other_dataset' if only elsewhere, else 'new'."""
    seen = known.groupBy(key).agg(F.bool_or(F.col("dataset") == dataset).alias("__here"))
    return items.join(seen, key, "left").withColumn("status", F.when(F.col("__here").isNull(), "new").when(F.col("__here"), "known").otherwise("other_dataset")).drop("__here")
