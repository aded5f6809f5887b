"""Files of a repository as tables: scan, language, generated marker, digests, line readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, and marks of generated code.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java",
    "kt": "kotlin", "cs": "csharp", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown",
}
GENERATED = ("@generated", "DO NOT EDIT", "Code generated by", "AUTO-GENERATED")


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[ext], F.lit("unknown"))


def is_safe(path: Column) -> Column:
    """Relative, without a parent step, a drive or a null character."""
    return ~path.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\x00") & (path != "")


# Languages whose files are text to be analysed.
TEXT_LANGUAGES = ("typescript", "javascript", "python", "go", "rust", "java", "kotlin", "csharp")


def is_text_language(name: Column) -> Column:
    return F.coalesce(name.isin(*TEXT_LANGUAGES), F.lit(False))


def normal_lines(text: Column) -> Column:
    """Line ends as LF."""
    return F.regexp_replace(text, "\r\n", "\n")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns leave a path out: the last one that matches decides, `!` takes in again. A pattern with a
    slash before its end is anchored at the top, others match at any depth; one that ends in a slash matches folders,
    and everything below a match matches. `*` stops at slashes, `**` does not. Blank lines and comments say nothing."""
    out = F.lit(False)
    for raw in patterns:
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        body = re.sub(r"\\\*\\\*/|\\\*\\\*|\\\*|\\\?", lambda m: {"\\*\\*/": "(.*/)?", "\\*\\*": ".*", "\\*": "[^/]*", "\\?": "[^/]"}[m[0]], re.escape(line))
        rule = ("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)")
        out = F.when(path.rlike(rule), F.lit(not back)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), budget: int | None = None, max_bytes: int = 1 << 20, ignore: list[str] | None = None) -> DataFrame:
    """(path, content, content_hash, language, is_generated, skipped) of the files under root. Contents are text with
    LF line ends; a file over max_bytes is listed with the reason and its content is not read. `ignore` are the lines of an
    ignore file; without it those of root's .gitignore, if there is one. Hidden files are not listed. With a budget the first files in the order of
    paths are kept."""
    from strataspark.functions.text import matches

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    base = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    home = "/" + root.split("://")[-1].strip("/") + "/"
    name = F.regexp_replace(base, f"^{home.replace('.', '[.]')}", "")
    if ignore is None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        ignore = []
        if fs.exists(at):
            stream = fs.open(at)
            ignore = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
    raw = reader.load(root)  # the length is read from the listing, so files beyond it are never opened
    small = raw.where(F.col("length") <= max_bytes).select(name.alias("path"), normal_lines(F.decode("content", "UTF-8")).alias("content"), F.lit(None).cast("string").alias("skipped"))
    large = raw.where(F.col("length") > max_bytes).select(name.alias("path"), F.lit(None).cast("string").alias("content"), F.lit("too_large").alias("skipped"))
    rows = small.unionAll(large).where(is_safe(F.col("path")) & ~F.col("path").rlike(r"(^|/)\.git/") & ~ignored(F.col("path"), ignore))
    for glob in exclude:
        rows = rows.where(~matches(F.col("path"), glob))
    head = F.substring("content", 1, 4096)
    rows = rows.select(
        "path", "content", F.sha2("content", 256).alias("content_hash"), language(F.col("path")).alias("language"),
        F.coalesce(F.greatest(*[head.contains(m) for m in GENERATED]), F.lit(False)).alias("is_generated"), "skipped",
    )
    return rows if budget is None else rows.orderBy("path").limit(budget)


def snapshot_digest(files: DataFrame) -> DataFrame:
    """(n, digest) over the set of (path, content_hash), in any order of rows."""
    from strataspark.operators.temporal import digest_by

    return digest_by(files.select(F.lit("all").alias("snapshot"), F.concat_ws(" ", "path", "content_hash").alias("line")), "snapshot", "line").drop("snapshot")


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, text) of files(path, content)."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line_no"), "text")


TEST_FILE = r"(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[A-Za-z]+$|(^|/)test_[^/]+\.py$|_test\.(go|py)$"


def test_inventory(files: DataFrame) -> DataFrame:
    """(suite_id, name, line) of the cases in test files."""
    case = r"""^\s*(?:(?:it|test)\(\s*['"`]([^'"`]+)|(?:async\s+)?def (test_\w+)|func (Test\w+)\()"""
    found = lines(files.where(F.col("path").rlike(TEST_FILE))).where(F.col("text").rlike(case))
    name = F.coalesce(*[F.nullif(F.regexp_extract("text", case, k), F.lit("")) for k in (1, 2, 3)])
    return found.select(F.col("path").alias("suite_id"), name.alias("name"), F.col("line_no").alias("line"))


def suite_imports(files: DataFrame) -> DataFrame:
    """(suite_id, source, tier) of what test files(path, content) import, resolved among the files; see
    records.resolve_imports and sources.code."""
    from strataspark.operators.records import resolve_imports
    from strataspark.sources.code import code_rows

    found = code_rows(files.where(F.col("path").rlike(TEST_FILE))).where("row = 'import'").select("path", "specifier")
    out = resolve_imports(found, files)
    return out.select(F.col("path").alias("suite_id"), F.col("target").alias("source"), "tier")


# How a text names a shared resource.
RESOURCES = {
    "env": r"""(?:process\.env\.|os\.environ\[['"]|os\.getenv\(['"]|env::var\(["])([A-Z][A-Z0-9_]+)""",
    "topic": r"""(?:topic|subscribe|publish)\(?\s*[:=(]\s*['"]([\w.\-]+)['"]""",
    "table": r"""(?i)(?:from|into|update|join)\s+([a-z_][a-z0-9_]*\.[a-z_][a-z0-9_]*)""",
}


def resource_uses(files: DataFrame) -> DataFrame:
    """(resource, path): environment variables, topics and qualified tables that files(path, content) name."""
    out = None
    for kind, pattern in RESOURCES.items():
        part = files.select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("r"), "path")
        part = part.select(F.concat_ws(":", F.lit(kind), "r").alias("resource"), "path")
        out = part if out is None else out.unionAll(part)
    return out
