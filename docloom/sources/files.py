"""File sources: text and Markdown files under a folder, with their domain; PDF readers are given by the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import markdown_text

SUFFIXES = ("pdf", "md", "txt")


def domain_of(relative: Column) -> Column:
    """The first folder of a path below the root; files at the root are general."""
    return F.when(relative.contains("/"), F.split_part(relative, F.lit("/"), F.lit(1))).otherwise("general")


def load_folder(spark: SparkSession, root: str, pdf_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(filename, file_path, file_type, domain, total_pages, pages, full_text, error) of the files of known kinds, two levels deep.

    A file that can't be read keeps its row, with ``error`` set, so one bad file never stops the others.
    ``pdf_pages`` turns a PDF's bytes into the text of its pages; without it PDFs have an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,md,txt}").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), "^" + base.replace(".", r"\.") + "/", "")
    found = files.select(relative.alias("relative"), "path", "content").where(~F.col("relative").rlike(r"(^|/)\.") & (F.size(F.split("relative", "/")) <= 2))
    kind = F.lower(F.regexp_extract("relative", r"\.([^.]+)$", 1))
    text = F.decode("content", "UTF-8")
    known = found.select(F.regexp_extract("relative", "([^/]+)$", 1).alias("filename"), F.col("path").alias("file_path"), kind.alias("file_type"), domain_of(F.col("relative")).alias("domain"), "content")
    plain = known.where("file_type <> 'pdf'").withColumn("full_text", F.when(F.col("file_type") == "md", markdown_text(text)).otherwise(text))
    page = "array<struct<page:int,text:string>>"
    plain = plain.select("filename", "file_path", "file_type", "domain", F.lit(1).alias("total_pages"), F.array(F.struct(F.lit(1).alias("page"), F.col("full_text").alias("text"))).cast(page).alias("pages"), "full_text", F.lit(None).cast("string").alias("error"))

    @F.udf(f"struct<pages:{page},error:string>")
    def read(content):
        if pdf_pages is None:
            return [], "no PDF reader"
        try:
            return [(i, t.strip()) for i, t in enumerate(pdf_pages(bytes(content)), 1) if t.strip()], None
        except Exception as x:  # the row carries the error
            return [], str(x)

    pdf = known.where("file_type = 'pdf'").withColumn("r", read("content"))
    pdf = pdf.select("filename", "file_path", "file_type", "domain", F.size("r.pages").alias("total_pages"), F.col("r.pages").alias("pages"), F.array_join(F.col("r.pages.text"), "\n\n").alias("full_text"), F.col("r.error").alias("error"))
    return plain.unionByName(pdf)
