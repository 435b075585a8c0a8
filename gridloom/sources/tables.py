"""Readers, writers, manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.checks import CheckFailed, assert_unique, fail_if_any

#: Spark names of charsets that need ``spark.sql.legacy.javaCharsets``.
CHARSETS = {"cp949": "MS949", "euc-kr": "EUC-KR", "utf-8-sig": "UTF-8", "utf-8": "UTF-8"}


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, encoding: str = "utf-8", all_string: bool = False, sep: str = ",") -> DataFrame:
    """CSV of a declared charset (a UTF-8 mark in the header is dropped); no fallback charset.

    ``all_string`` keeps every cell as it is: empty cells stay empty text and no token becomes null.
    """
    charset = CHARSETS.get(encoding.lower(), encoding)
    if charset in ("MS949", "EUC-KR"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("header", True).option("encoding", charset).option("sep", sep).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    if schema is not None:
        return reader.schema(schema).csv(path)
    out = reader.option("nullValue", "\u0000").option("emptyValue", "").csv(path) if all_string else reader.csv(path)
    return out.fillna("") if all_string else out


def with_file_keys(df: DataFrame, year_re: str = r"((?:19|20)\d{2})", regions: Sequence[str] = ()) -> DataFrame:
    """``file_year`` and ``file_region`` of the file name; none or several different ones raise."""
    name = F.col("_metadata.file_name")
    years = F.array_distinct(F.regexp_extract_all(name, F.lit(year_re), F.lit(1)))
    out = df.withColumn("file_name", name).withColumn("_years", years)
    if regions:
        # Of names that contain one another the longest counts.
        found = F.filter(F.array(*[F.lit(r) for r in sorted(regions, key=len, reverse=True)]), lambda r: F.contains(F.col("file_name"), r))
        out = out.withColumn("_regions", F.filter(found, lambda r: ~F.exists(found, lambda s: (s != r) & F.contains(s, r))))
    else:
        out = out.withColumn("_regions", F.array(F.lit(None).cast("string")))
    fail_if_any(out.where("size(_years) <> 1 or size(_regions) <> 1").select("file_name").distinct(), "file names without exactly one year and region")
    return out.withColumn("file_year", F.col("_years")[0].cast("int")).withColumn("file_region", F.col("_regions")[0]).drop("_years", "_regions")


def read_keyed_files(spark: SparkSession, path: str, expected: DataFrame, schema: T.StructType | str, regions: Sequence[str], fmt: str = "csv", year: str = "year", region: str = "region") -> DataFrame:
    """One file per (region, year): missing or extra files and rows whose key is not the file's raise."""
    reader = spark.read.format(fmt).schema(schema)
    df = with_file_keys((reader.option("header", True) if fmt == "csv" else reader).load(path), regions=regions)
    have = df.select(F.col("file_region").alias(region), F.col("file_year").alias(year)).distinct()
    want = expected.select(region, F.col(year).cast("int").alias(year)).distinct()
    fail_if_any(want.join(have, [region, year], "left_anti"), "files are missing")
    fail_if_any(have.join(want, [region, year], "left_anti"), "files are not expected")
    fail_if_any(df.where((F.col(region) != F.col("file_region")) | (F.col(year) != F.col("file_year"))).select("file_name", region, year), "rows disagree with their file")
    return df.drop("file_region", "file_year")


def _header_cells(df: DataFrame, n: int) -> list[list[str | None]]:
    """The first n rows of a headerless sheet in file order (schema-sized)."""
    return [list(r) for r in df.limit(n).collect()]


def two_row_header_to_long(raw: DataFrame, block: str, year_re: str = r"(\d{4})", national: str = "national") -> tuple[DataFrame, DataFrame]:
    """(regions, national rows) as ``(region, year, value)`` of one top-level block of a two-row header sheet."""
    import re

    top, sub = _header_cells(raw, 2)
    filled, last = [], None
    for cell in top:
        last = cell if cell not in (None, "") else last
        filled.append(last)
    years: dict[int, str] = {}
    for i, c in enumerate(raw.columns[1:], start=1):
        hit = re.search(year_re, str(sub[i] or "")) if filled[i] == block else None
        if hit:
            if int(hit[1]) in years:
                raise CheckFailed(f"two columns for {hit[1]}")
            years[int(hit[1])] = c
    if not years:
        raise CheckFailed(f"no year columns under {block}")
    key = raw.columns[0]
    body = raw.where(F.col(key).isNotNull() & ~F.col(key).eqNullSafe(F.lit(top[0])) & ~F.col(key).eqNullSafe(F.lit(sub[0])))
    long = body.select(F.trim(key).alias("region"), *[F.col(c).alias(str(y)) for y, c in years.items()]).unpivot(["region"], [str(y) for y in years], "year", "value")
    long = long.select("region", F.col("year").cast("int").alias("year"), F.regexp_replace("value", ",", "").try_cast("double").alias("value"))
    return long.where(F.col("region") != national), long.where(F.col("region") == national)


def composite_header_to_long(raw: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """``(region, year, category, value)`` of a matrix whose first two rows hold years and categories."""
    years, cats = _header_cells(raw, 2)
    last, names = None, {}
    for i, c in enumerate(raw.columns[1:], start=1):
        last = years[i] if years[i] not in (None, "") else last
        if categories is None or cats[i] in categories:
            names[c] = f"{str(last)[:4]}_{cats[i]}"
    key = raw.columns[0]
    body = raw.where(F.col(key).isNotNull() & ~F.col(key).eqNullSafe(F.lit(years[0])) & ~F.col(key).eqNullSafe(F.lit(cats[0])))
    long = body.select(F.trim(key).alias("region"), *[F.col(c).alias(n) for c, n in names.items()]).unpivot(["region"], list(names.values()), "k", "value")
    part = F.split("k", "_", 2)
    return long.select("region", part[0].cast("int").alias("year"), part[1].alias("category"), F.regexp_replace("value", ",", "").try_cast("double").alias("value"))


def rules_to_df(spark: SparkSession, records: Sequence[Mapping], schema: str, keys: Sequence[str], non_negative: Sequence[str] = ()) -> DataFrame:
    """A rule table with unique keys and non-negative numbers."""
    out = spark.createDataFrame([tuple(r.get(f.name) for f in T._parse_datatype_string(schema).fields) for r in records], schema)
    assert_unique(out, keys, "rules")
    for c in non_negative:
        fail_if_any(out.where(F.col(c).isNull() | (F.col(c) < 0)), f"{c} must not be negative")
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """``(n_rows, fingerprint)`` of a table, independent of the order of its rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"))


def describe_dataset(df: DataFrame, name: str, role: str, unit: str | None = None, **meta: str) -> DataFrame:
    """One manifest row of a table."""
    reserved = {"name", "role", "unit", "columns", "n_rows", "fingerprint"} & set(meta)
    if reserved:
        raise CheckFailed(f"reserved keys {sorted(reserved)}")
    extra = F.create_map(*[F.lit(x) for kv in meta.items() for x in kv]) if meta else F.create_map().cast("map<string,string>")
    return fingerprint(df).select(F.lit(name).alias("name"), F.lit(role).alias("role"), F.lit(unit).cast("string").alias("unit"), F.lit(", ".join(f"{c} {k}" for c, k in df.dtypes)).alias("columns"), "n_rows", "fingerprint", extra.alias("meta"))


def describe_files(spark: SparkSession, path: str, role: str) -> DataFrame:
    """Path, size and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), F.lit(role).alias("role"))


def build_manifest(inputs: Sequence[DataFrame], outputs: Sequence[DataFrame], pipeline: str) -> DataFrame:
    """Manifest rows of a run; a name that comes twice raises."""
    from gridloom.operators.reshape import union_all

    rows = union_all([*inputs, *outputs])
    assert_unique(rows, ["name", "role"], "manifest")
    return rows.withColumn("pipeline", F.lit(pipeline))


def save_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)  # one row per dataset


def write_verified(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Write, read again and compare schema and rows with multiplicity."""
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)
    back = df.sparkSession.read.format(fmt).options(**options).schema(df.schema).load(path)
    if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
        raise CheckFailed("the schema changed on the way")
    fail_if_any(df.exceptAll(back), "rows are lost")
    fail_if_any(back.exceptAll(df), "rows are new")
    return back


CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"


def strip_tags(text: Column) -> Column:
    """Text of a fragment: tags dropped, the common references decoded, spaces squeezed."""
    out = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for ref, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(to))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_rows(pages: DataFrame, html: str = "html", row: str = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>", cell: str = CELL, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """``(keys, row_no, cells)`` of table rows (or other repeated elements) in page order; rows without cells go."""
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(row), F.lit(1))).alias("row_no", "_row"))
    cells = F.transform(F.regexp_extract_all("_row", F.lit(cell), F.lit(1)), strip_tags)
    return rows.select(*keys, "row_no", cells.alias("cells")).where(F.size("cells") > 0)


def html_last_page(pages: DataFrame, html: str = "html", pattern: str = r"""[?&]page=(\d+)""", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Largest page number that the page's links name; 1 where there is none."""
    numbers = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    return pages.select(*keys, F.coalesce(F.array_max(numbers), F.lit(1)).alias("last_page"))


def reusable_run(spark: SparkSession, summary_path: str, fingerprints: Mapping[str, str], settings: Mapping[str, object]) -> dict | None:
    """The stored summary if its inputs and settings are the same and its outputs can be read; else None."""
    from pyspark.errors import AnalysisException

    try:
        stored = json.loads(spark.read.text(summary_path).first()[0])
        same = stored.get("fingerprints") == dict(fingerprints) and stored.get("settings") == json.loads(json.dumps(settings))
        if same:
            for path in stored.get("outputs", []):
                _ = spark.read.parquet(path).schema
    except (AnalysisException, TypeError, ValueError):
        return None
    return stored if same else None


def save_run(spark: SparkSession, summary_path: str, fingerprints: Mapping[str, str], settings: Mapping[str, object], outputs: Sequence[str] = (), **result: object) -> None:
    row = json.dumps({"fingerprints": dict(fingerprints), "settings": settings, "outputs": list(outputs), **result}, ensure_ascii=False)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(summary_path)
