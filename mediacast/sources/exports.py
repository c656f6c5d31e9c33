"""Ad platforms' CSV and TSV exports, read into the canonical panel."""

from __future__ import annotations

import csv
import logging
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.stage import later_gone, shared_dir, write_bytes

log = logging.getLogger(__name__)
#: What counts as missing, as data-frame readers take it.
MISSING = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "<NA>", "#N/A")
DATES = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "yyyy/MM/dd", "yyyyMMdd")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def find_files(spark: SparkSession, folder: str) -> list[str]:
    """All .csv and .tsv files under ``folder``, any case, in order; by Hadoop, so any store will do."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    listed, found = fs.listFiles(path, True), []
    while listed.hasNext():
        name = listed.next().getPath().toString()
        if name.lower().endswith((".csv", ".tsv")):
            found.append(name)
    if not found:
        raise FileNotFoundError(f"no .csv or .tsv file in {folder}")
    return sorted(found)


def detect(columns: list[str], name: str) -> config.Platform | None:
    """By signature columns; the file's name decides between several, and stands in for none."""
    fitting = [p for p in config.PLATFORMS if p.signature <= set(columns)]
    if len(fitting) == 1:
        return fitting[0]
    hinted = [p for p in fitting or config.PLATFORMS if any(h in name.lower() for h in p.hints)]
    return hinted[0] if hinted else fitting[0] if fitting else None


def _text(c: Column) -> Column:
    trimmed = F.trim(c.cast("string"))
    return F.when(~trimmed.isin(*MISSING), trimmed)


def number(c: Column) -> Column:
    """A finite number or null; text like ``12d`` or ``1,234`` is null."""
    text = _text(c)
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def date(c: Column) -> Column:
    text = _text(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATES], text.try_cast("timestamp")).cast("date")


def identifier(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(_text(c), r"^(-?\d+)\.0+$", "$1"), F.lit("unknown"))


def normalise(raw: DataFrame, platform: config.Platform) -> DataFrame:
    """Any typed or text columns to the canonical ones; rows without a date go."""
    have = set(raw.columns)
    of = {new: raw[f"`{old}`"] for old, new in platform.names.items() if old in have}
    if platform.micros and platform.micros in have:
        of["spend"] = number(raw[platform.micros]) / 1e6
    out = {"date": date(of["date"]) if "date" in of else F.lit(None).cast("date"), "platform": F.lit(platform.name)}
    out["campaign_id"] = identifier(of["campaign_id"]) if "campaign_id" in of else F.lit("unknown")
    out["campaign_name"] = F.coalesce(_text(of["campaign_name"]), F.lit("Unnamed Campaign")) if "campaign_name" in of else F.lit("Unnamed Campaign")
    out["channel_type_raw"] = _text(of["channel_type_raw"]) if "channel_type_raw" in of else F.lit(None).cast("string")
    for c in ("spend", "revenue", "clicks", "impressions", "conversions", "budget_raw"):
        value = number(of[c]) if c in of else F.lit(None).cast("double")
        out[c] = value if c in ("conversions", "budget_raw") else F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
    return raw.select(*[out[c].alias(c) for c in config.CANONICAL]).where("date is not null")


def from_frames(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Named frames in any of the known formats as one panel; unknown ones are skipped with a warning."""
    panels = []
    for name, raw in frames:
        if (platform := detect(raw.columns, name)) is None:
            log.warning("%s: unknown format, skipped", name)
            continue
        panels.append(normalise(raw, platform))
    if not panels:
        raise ValueError("no file has a known format")
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p)
    return out


def _header(spark: SparkSession, path: str, sep: str) -> tuple[str, ...]:
    """The column names in a file's first line; no Spark job."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([(line or "").lstrip("\ufeff")], delimiter=sep), []))


def _malformed(sep: str, fields: int) -> Column:
    """Whether a line has more fields than the header, or a quote that isn't closed."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    return bare.contains('"') | (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) > (fields - 1) * len(sep))


def _broken(spark: SparkSession, paths: list[str], sep: str, fields: int) -> dict[str, str]:
    """Files that cannot be read to their end or don't parse, with the reason.

    All files are read by one job, which counts each file's malformed lines. Where a read
    fails, the files are halved until those that fail are alone; so one broken file among n costs about
    2 log n more jobs, and none where nothing is broken.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), _malformed(sep, fields).cast("long").alias("bad"))
    try:
        found = lines.groupBy("file").agg(F.sum("bad").alias("bad")).where("bad > 0").collect()
    except Exception as why:  # noqa: BLE001  whatever the store raises
        if len(paths) == 1:
            return {paths[0]: f"unreadable: {_reason(why)}"}
        half = len(paths) // 2
        return _broken(spark, paths[:half], sep, fields) | _broken(spark, paths[half:], sep, fields)
    counts = {_plain(r["file"]): r["bad"] for r in found}
    return {p: f"{counts[_plain(p)]} malformed lines" for p in paths if _plain(p) in counts}


def _plain(path: str) -> str:
    """A path without its scheme's slashes, of which Spark and Hadoop write different numbers, and without escapes."""
    scheme, _, rest = unquote(path).partition(":")
    return f"{scheme}:/{rest.lstrip('/')}"


def _reason(why: Exception) -> str:
    """The first line of the innermost cause."""
    causes = re.findall(r"Caused by: ([^\n]+)", str(why))
    return (causes[-1] if causes else str(why).split("\n")[0])[:300]


def load(spark: SparkSession, folder: str) -> DataFrame:
    """All readable exports under ``folder`` as one panel; see ``load_checked``."""
    return load_checked(spark, folder)[0]


def load_checked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(panel, quarantine (file, reason)): one read for each kind of header, as text, which ``normalise`` types.

    Files of an unknown format, unreadable ones, those that break while they are read and those with
    malformed lines go to quarantine whole, with a warning; the others make the panel. Every file is read
    once more than its panel is, to tell.
    """
    alike: dict[tuple, list[str]] = {}
    gone: dict[str, str] = {}
    for path in find_files(spark, folder):
        sep = "\t" if path.lower().endswith(".tsv") else ","
        try:
            header = _header(spark, path, sep)
        except Exception as why:  # noqa: BLE001  one broken file doesn't stop the others
            gone[path] = f"unreadable: {_reason(why)}"
            continue
        if (platform := detect(list(header), path.rsplit("/", 1)[-1])) is None:
            gone[path] = "unknown format"
        else:
            alike.setdefault((platform.name, header, sep), []).append(path)
    out = None
    for (name, header, sep), paths in alike.items():
        broken = _broken(spark, paths, sep, len(header))
        gone |= broken
        paths = [p for p in paths if p not in broken]
        if not paths:
            continue
        platform = next(p for p in config.PLATFORMS if p.name == name)
        # Columns by place: headers may hold names that differ in case alone.
        schema = ", ".join(f"c{k} string" for k in range(len(header)))
        raw = spark.read.csv(paths, schema=schema, header=True, sep=sep, enforceSchema=True)
        wanted = [*platform.names, *([platform.micros] if platform.micros else [])]
        raw = raw.select(*[F.col(f"c{header.index(c)}").alias(c) for c in wanted if c in header])
        panel = normalise(raw, platform)
        out = panel if out is None else out.unionByName(panel)
    for path, why in gone.items():
        log.warning("%s: %s, skipped", path, why)
    if out is None:
        raise ValueError("no file has a known format")
    return out, spark.createDataFrame(sorted(gone.items()), "file string, reason string")


def from_bytes(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    """Uploaded files (name, content), by way of the shared folder, from where they go when the driver ends."""
    folder = f"{shared_dir(spark)}/upload-{uuid.uuid4().hex}"
    later_gone(spark, folder)
    for name, content in files.items():
        write_bytes(spark, f"{folder}/{name.rsplit('/', 1)[-1]}", content)
    return load(spark, folder)
