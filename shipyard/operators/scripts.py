"""Scripts and artifacts: statement splitting (F1), fingerprints (S5), package scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.text import fill, first_line, split_statements
from ..sources.zips import text_contents, zip_index
from .scan import row_numbers


def statements(scripts: DataFrame, keys: Sequence[str] = ("script_id",), text_col: str = "text") -> DataFrame:
    """one row per statement of each audit script, with its position.

    Each script is one row and is split in place (a JVM regular expression, linear
    in the text), so the job has no shuffle and processes whole texts.
    """
    return scripts.select(*keys, F.posexplode(split_statements(text_col)).alias("stmt_pos", "statement"))


def fingerprint_check(artifacts: DataFrame, expected: DataFrame, name_col: str = "name",
                      content_col: str = "content", md5_text_col: str = "md5_text") -> DataFrame:
    """md5 of an artifact equals the first line of its published .md5 file.

    A missing file on either side is false. Artifact content may be text (hashed
    as UTF-8) or binary; it is hashed before the join, so no content travels.
    """
    exp = expected.select(F.col(name_col).alias("_n"), first_line(md5_text_col).alias("_expected"))
    art = artifacts.select(F.col(name_col).alias("_a"), F.md5(F.col(content_col)).alias("_digest"))
    j = art.join(exp, F.col("_a") == F.col("_n"), "full_outer")
    return j.select(F.coalesce("_a", "_n").alias(name_col), F.col("_expected").isNotNull().alias("has_expected"),
                    F.col("_digest").isNotNull().alias("has_artifact"),
                    F.coalesce(F.col("_digest") == F.col("_expected"), F.lit(False)).alias("ok"))


# ---------------------------------------------------------------------------
# Script packages (zip files)
# ---------------------------------------------------------------------------

_PREFIX_HEAD, _, _PREFIX_TAIL = S.SCRIPT_ENTRY_PREFIX.partition("{product}")  # "products/", "/database/pre/"
ENTRY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("product_dir", T.StringType()),
    T.StructField("entry_name", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("_error", T.StringType()),
])


def _unzip_pre_entries(batches: Iterator) -> Iterator:
    """Executor-side: list files under products/<p>/database/pre/ of each zip (ISO-8859-1).

    Zips are given out one by one; one that cannot be read is an error row.
    """
    import io
    import zipfile

    import pandas as pd

    for pdf in batches:
        for path, blob in zip(pdf["path"], pdf["content"]):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(blob)) as zf:
                    for info in zf.infolist():
                        name = info.filename
                        if info.is_dir() or not name.startswith(_PREFIX_HEAD):
                            continue
                        product, sep, rest = name[len(_PREFIX_HEAD):].partition(_PREFIX_TAIL)
                        if not sep or "/" in product:
                            continue
                        rows.append((path, product, name, zf.read(info).decode(S.SCRIPT_ENCODING), None))
            except (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, ValueError) as e:
                rows = [(path, None, None, None, f"unreadable package: {e}")]
            yield pd.DataFrame(rows, columns=[f.name for f in ENTRY_SCHEMA])


def scan_script_packages(spark: SparkSession, zip_glob: str, packages: DataFrame,
                         keys: Sequence[str] = ("msg_id",)) -> DataFrame:
    """Scripts of each package: entries ``products/<productName>/database/pre/<name>``.

    ``binaryFile`` reads each zip as one row (prune by path; few files per task);
    the unzip runs on executors in ``mapInPandas``; entries join the package table
    on (file name, product). Name = entry path without the prefix. A package whose zip
    cannot be read has one row with ``_error`` and no name.
    """
    keys = list(keys)
    files = spark.read.format("binaryFile").load(zip_glob).select("path", "content")
    entries = files.mapInPandas(_unzip_pre_entries, ENTRY_SCHEMA) \
        .withColumn("filename", F.element_at(F.split("path", "/"), -1))
    pk = packages.select(*keys, "filename", "productName", "scriptId", "version")
    j = pk.join(entries, (pk["filename"] == entries["filename"])
                & (F.col("_error").isNotNull() | (pk["productName"] == entries["product_dir"])))
    prefix_len = F.length(fill(S.SCRIPT_ENTRY_PREFIX, product=F.col("productName")))
    name = F.expr("substring(entry_name, _plen + 1)")
    return j.withColumn("_plen", prefix_len).select(
        *[pk[k] for k in keys], pk["filename"], "productName", "scriptId", "version",
        name.alias("name"), F.lit(S.SCRIPT_PHASE).alias("phase"), "content", "_error")


def scripts_per_package(scripts: DataFrame, keys: Sequence[str] = ("msg_id",)) -> DataFrame:
    """S4 count: number of scripts found per package."""
    return scripts.groupBy(*keys, "filename", "scriptId").agg(F.count("name").alias("n_scripts"))


def scan_packages(spark: SparkSession, path: str, packages: DataFrame, keys: Sequence[str] = ("msg_id",)) -> DataFrame:
    """S4 by ranges of entries (``sources.zips``): the rows of ``scan_script_packages`` with entry_pos.

    Only entries under a package's own prefix are read. A package that is read by several messages is read once.
    """
    keys = list(keys)
    pk = packages.select(*keys, "filename", "productName", "scriptId", "version")
    index = zip_index(spark, path).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    wanted = pk.select("filename", "productName").distinct().withColumn(
        "_prefix", fill(S.SCRIPT_ENTRY_PREFIX, product=F.col("productName")))
    broken = F.col("entry_name").isNull()
    mine = index.join(wanted, "filename").where(broken | F.startswith("entry_name", F.col("_prefix")))
    read = text_contents(mine, S.SCRIPT_ENCODING)
    name = F.when(~broken, F.substring("entry_name", F.length("_prefix") + 1, F.length("entry_name")))
    found = read.select("filename", "productName", name.alias("name"), "entry_pos", "content", "_error")
    return pk.join(found, ["filename", "productName"]).select(
        *keys, "filename", "productName", "scriptId", "version", "name", F.lit(S.SCRIPT_PHASE).alias("phase"), "entry_pos", "content", "_error")


def package_scripts(scripts: DataFrame, keys: Sequence[str] = ("msg_id",)) -> DataFrame:
    """Each package's scripts by name: of entries with one name the last wins; name_pos is the place in name order (from 0).

    The places come from range chunks (``scan.row_numbers``), so a package of any size is spread over tasks.
    """
    package = [*keys, "filename", "productName"]
    named = scripts.where(F.col("name").isNotNull() & F.col("_error").isNull())
    last = named.groupBy(*package, "name").agg(F.max("entry_pos").alias("entry_pos"))
    placed = row_numbers(last, package, ["name"], "name_pos")
    return named.join(placed, [*package, "name", "entry_pos"])
