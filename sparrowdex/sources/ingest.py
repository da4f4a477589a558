"""Ingestion: file scan, extraction, metadata, reconciliation of a listing with an index, crawl statistics."""

from __future__ import annotations

import email
import email.policy
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# Default patterns.
INCLUDE = ("*.pdf", "*.doc", "*.docx", "*.odt", "*.ppt", "*.pptx", "*.xls", "*.xlsx", "*.ods", "*.txt", "*.eml", "*.msg", "*.md", "*.rst", "*.html", "*.htm", "*.rtf", "*.epub")
EXCLUDE = ("**/node_modules/**", "**/.git/**", "**/target/**", "**/build/**")


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob: ** crosses folders, * and ? do not."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif pattern.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            out, at = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), at + 1
    return f"^{out}$"


def should_include(path: Column, include=INCLUDE, exclude=EXCLUDE) -> Column:
    """Excludes by full path first, then includes by base name; no include patterns: everything."""
    name = F.element_at(F.split(path, "/"), -1)
    ok = F.lit(True)
    if include:
        ok = F.lower(name).rlike("|".join(glob_regex(p) for p in include))
    return ok & ~path.rlike("|".join(glob_regex(p) for p in exclude)) if exclude else ok


def scan(spark: SparkSession, folder: str, include=INCLUDE, exclude=EXCLUDE) -> DataFrame:
    """path, modificationTime, length, content of the files below a folder. Column pruning leaves contents unread where they are not used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(should_include(F.regexp_replace("path", "^[a-z]+:/*", "/"), include, exclude))


_MIME = {"txt": "text/plain", "md": "text/markdown", "rst": "text/x-rst", "html": "text/html", "htm": "text/html", "eml": "message/rfc822", "rtf": "application/rtf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "epub": "application/epub+zip", "pdf": "application/pdf"}


def extract_bytes(path: str, data: bytes, extractors=None) -> tuple[str, dict[str, str], str]:
    """(content, metadata, type) of one file. Plain text, HTML, mail, RTF and zipped XML formats by the standard library; `extractors` adds others by extension.

    A format without an extractor is an error, so that its files are not taken for empty ones.
    """
    import io
    import zipfile

    ext = path.rsplit(".", 1)[-1].lower()
    kind, meta, content = _MIME.get(ext, "application/octet-stream"), {}, ""
    if extractors and ext in extractors:
        content, meta = extractors[ext](data)
    elif ext in ("txt", "md", "rst"):
        content = data.decode("utf-8", "replace")
    elif ext in ("html", "htm"):
        page = data.decode("utf-8", "replace")
        content, title = tx.html_text(page), tx.html_title(page)
        meta = {"title": title} if title else {}
    elif ext == "eml":
        m = email.message_from_bytes(data, policy=email.policy.default)
        body = m.get_body(("plain", "html"))
        content = body.get_content() if body else ""
        if body is not None and body.get_content_subtype() == "html":
            content = tx.html_text(content)
        meta = {k: str(v) for k, v in (("title", m["subject"]), ("author", m["from"]), ("created", m["date"])) if v}
    elif ext == "rtf":
        content = re.sub(r"\\'[0-9a-f]{2}|\\[a-z]+-?\d* ?|[{}]", "", data.decode("latin-1")).strip()
    elif ext in ("docx", "pptx", "xlsx", "odt", "ods", "epub"):
        parts = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", "odt": r"content\.xml", "ods": r"content\.xml", "epub": r".*\.x?html?"}[ext]
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted(n for n in z.namelist() if re.fullmatch(parts, n))
            xml = [z.read(n).decode("utf-8", "replace") for n in names]
            content = "\n".join(tx.html_text(re.sub(r"</(?:w:p|a:p|text:p|text:h|row)>", "\n", x)) for x in xml)
            core = next((z.read(n).decode("utf-8", "replace") for n in ("docProps/core.xml", "meta.xml") if n in z.namelist()), "")
        meta = {k: m[1] for k in ("title", "creator", "subject") if (m := re.search(rf"<dc:{k}[^>]*>([^<]+)<", core))}
    else:
        raise ValueError(f"no extractor for .{ext}")
    return tx.normalize_str(content), {k: v for k, v in meta.items() if v}, kind


def extract(files: DataFrame, max_chars: int = 0, extractors=None) -> DataFrame:
    """path, content, metadata, file_type, error: one bad file does not stop the others. `max_chars` cuts contents; 0 or less does not."""

    def run(batches):
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    content, meta, kind = extract_bytes(path, data, extractors)
                    rows.append((path, content[:max_chars] if max_chars > 0 else content, meta, kind, None))
                except Exception as e:  # noqa: BLE001  of this file alone
                    rows.append((path, "", {}, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "metadata", "file_type", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content string, metadata map<string,string>, file_type string, error string")


def first_of(metadata: Column, *keys: str) -> Column:
    """The first key's non-empty value."""
    return F.coalesce(*[F.nullif(F.trim(metadata[k]), F.lit("")) for k in keys])


def documents(files: DataFrame, extracted: DataFrame) -> DataFrame:
    """Rows of the index: files with content. Files without content are left to the caller as deletions (see empty_files)."""
    m = F.col("metadata")
    d = files.select("path", "modificationTime", "length").join(extracted.where("length(trim(content)) > 0"), "path")
    return d.select(
        F.col("path").alias("doc_id"), F.col("content").alias("text"), tx.language(F.col("content")).alias("lang"), F.element_at(F.split("path", "/"), -1).alias("file_name"),
        tx.file_extension(F.col("path")).alias("file_extension"), tx.mime_base(F.col("file_type")).alias("file_type"), F.col("length").alias("file_size"), F.unix_millis("modificationTime").alias("modified_date"),
        first_of(m, "dc:title", "title", "Title").alias("title"), first_of(m, "dc:creator", "author", "Author", "creator").alias("author"), first_of(m, "xmp:CreatorTool", "Application-Name").alias("creator"),
        first_of(m, "dc:subject", "subject").alias("subject"), first_of(m, "meta:keyword", "keywords", "Keywords").alias("keywords"), tx.content_hash(F.col("content")).alias("content_hash"), F.length("content").cast("long").alias("n_chars"), F.lit(None).cast("string").alias("source"),
    )


def empty_files(extracted: DataFrame) -> DataFrame:
    return extracted.where("length(trim(content)) = 0 AND error IS NULL").select(F.col("path").alias("doc_id"))


def reconcile(listing: DataFrame, indexed: DataFrame, key: str = "doc_id", changed: str = "modified_date") -> DataFrame:
    """key and action (add, update, delete, unchanged) from a full outer join of a listing with the index's keys."""
    a, b = listing.select(key, F.col(changed).alias("_new"), F.lit(True).alias("_here")), indexed.select(key, F.col(changed).alias("_old"), F.lit(True).alias("_there"))
    both = a.join(b, key, "full_outer")
    action = F.when(F.col("_there").isNull(), "add").when(F.col("_here").isNull(), "delete").when(~F.col("_new").eqNullSafe(F.col("_old")), "update").otherwise("unchanged")
    return both.select(key, action.alias("action"))


def crawl_statistics(files: DataFrame, extracted: DataFrame, seconds: float) -> DataFrame:
    """Found, indexed, failed, empty, bytes by folder, and rates."""
    d = files.select("path", "length").join(extracted.select("path", "error", F.length(F.trim("content")).alias("n")), "path", "left").withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    s = d.groupBy("folder").agg(F.count("*").alias("found"), F.count_if(F.expr("error IS NULL AND n > 0")).alias("indexed"), F.count_if(F.expr("error IS NOT NULL")).alias("failed"), F.count_if(F.expr("error IS NULL AND n = 0")).alias("empty"), F.sum("length").alias("bytes"))
    return s.withColumn("files_per_s", F.col("found") / seconds).withColumn("mb_per_s", F.col("bytes") / 1e6 / seconds)
