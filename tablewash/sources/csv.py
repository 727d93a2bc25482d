"""CSV in and out.

Input is read the way the cleaning flow expects: header row, every column as
text, an empty field as NULL, and no field lost: a row with more fields than the
header is an error (or is returned apart). Files are split across tasks, also those with
newlines inside quoted fields (``records.py``). Output is written by all tasks in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import qcol
from .records import records

EXPORT_PREFIX = "cleaned_"


def _check_suffix(path: str) -> None:
    base = path.rstrip("/").split("/")[-1]
    if not base.lower().endswith(".csv"):
        raise ValueError(f"not a CSV file name: {path!r}")


_RECORD = "__record"


def load_csv(spark: SparkSession, path: str | list[str], multi_line: bool | None = None,
             require_suffix: bool = True, bad_rows: str = "raise", **options) -> DataFrame:
    """S1+S2: read CSV with a header, all columns as text, ``''`` as NULL.

    A quoted field may hold newlines (``multi_line=True``); its records are then put
    together across lines and splits first. By default (``None``) that is done only if some
    line has an odd number of quotes, which a scan of the text finds out. With ``False``
    such a line is an error. With options of another quote, escape, encoding, comment or
    line end, or a separator of several characters, Spark's reader takes each such file in
    one task.

    A row with more fields than the header is an error when it is read
    (``bad_rows="raise"``); ``"drop"`` leaves such rows out, and
    :func:`csv_bad_rows` returns them. A row with fewer fields ends in NULLs.
    """
    if bad_rows not in ("raise", "drop"):
        raise ValueError("bad_rows must be 'raise' or 'drop'")
    raw, names, too_many = _read(spark, path, multi_line, require_suffix, options)
    if names is None:
        return raw
    fine = ~too_many
    if bad_rows == "raise":
        message = F.concat(F.lit("CSV: row with more fields than the header: "), F.substring(_RECORD, 1, 200))
        fine = F.when(too_many, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return raw.where(fine).select(*[F.nullif(qcol(c), F.lit("")).alias(c) for c in names])


def csv_bad_rows(spark: SparkSession, path: str | list[str], multi_line: bool | None = None,
                 require_suffix: bool = True, **options) -> DataFrame:
    """The text (``record``) of the rows that have more fields than the header."""
    raw, names, too_many = _read(spark, path, multi_line, require_suffix, options)
    if names is None:
        return spark.createDataFrame([], "record string")
    return raw.where(too_many).select(F.col(_RECORD).alias("record"))


def _read(spark: SparkSession, path, multi_line, require_suffix: bool, options: dict):
    """Text columns with the record of rows of another width, the header's names
    (``None`` for a file without a header row), and whether a row is too wide."""
    paths = [path] if isinstance(path, str) else list(path)
    if require_suffix:
        for p in paths:
            _check_suffix(p)
    opts = {"header": "true", "inferSchema": "false", "escape": '"', "mode": "PERMISSIVE"}
    opts.update({k: str(v) for k, v in options.items()})
    if not multi_line:
        quotes = F.length(F.regexp_replace("value", '[^"]', ""))
        unclosed = spark.read.text(paths).where(quotes % 2 == 1).limit(1).collect()
        if unclosed and multi_line is False:
            raise ValueError("CSV: unclosed quote; newlines in quoted fields need multi_line=True: "
                             + unclosed[0][0][:200])
        multi_line = bool(unclosed)
    opts["multiLine"] = str(bool(multi_line)).lower()
    sep = opts.get("sep", opts.get("delimiter", ","))
    own = {"header", "inferSchema", "mode", "multiLine", "sep", "delimiter", "nullValue", "emptyValue", "escape",
           "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"}
    names = _header_names(spark, paths[0], opts)
    if names is None:
        return spark.read.options(**opts).csv(paths), None, None
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RECORD]])
    # every field must be parsed to know a row's width
    opts |= {"columnNameOfCorruptRecord": _RECORD, "columnPruning": "false"}
    if multi_line and set(options) <= own and opts["escape"] == '"' and len(sep) == 1 and opts["header"] == "true":
        places = ", ".join(f"c{i} string" for i in range(len(names)))
        parsed = records(spark, paths, sep).select(F.from_csv("record", f"{places}, {_RECORD} string", opts).alias("r"))
        raw = parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)], f"r.{_RECORD}")
    else:
        raw = spark.read.options(**opts).schema(schema).csv(paths)
    unquoted = F.regexp_replace(_RECORD, '"(?:[^"]|"")*+"', "")
    fields = F.size(F.split(unquoted, "\\Q" + sep + "\\E"))
    # Spark refuses to read the record alone, so a column takes part without effect
    some = F.length(F.concat_ws("", qcol(names[0]))) >= 0
    return raw, names, F.coalesce(F.col(_RECORD).isNotNull() & (fields > len(names)) & some, F.lit(False))


def _header_names(spark: SparkSession, path: str, opts: dict):
    """Column names as the cleaning flow expects them (the rules of pandas' CSV
    reader): a blank name is ``Unnamed: <position>``; of a repeated name the first
    copy keeps it, later ones become ``name.1``, ``name.2``. ``None`` for an empty
    file. Reads only the first row of the first file, parsed by Spark."""
    raw = {**opts, "header": "false"}
    first = spark.read.options(**raw).csv(path).limit(1).collect()
    if not first:
        return None
    header = [f"Unnamed: {i}" if v is None or v == "" else v for i, v in enumerate(first[0])]
    # a repeated name gets the next ".k" suffix that is not a name already in
    # the header nor given out before
    taken, used, nxt, out = set(header), set(), {}, []
    for name in header:
        if name not in used:
            used.add(name)
            out.append(name)
            continue
        k = nxt.get(name, 1)
        while f"{name}.{k}" in taken or f"{name}.{k}" in used:
            k += 1
        nxt[name] = k + 1
        used.add(f"{name}.{k}")
        out.append(f"{name}.{k}")
    return out


@dataclass
class DirLoad:
    """Outcome of :func:`load_csv_dir`: a frame, or the names to choose from."""
    frame: DataFrame | None
    chosen: str | None
    available: list[str] = field(default_factory=list)


def list_csv_files(spark: SparkSession, directory: str) -> list[str]:
    """Names of the ``*.csv`` files directly in ``directory`` (any Hadoop file
    system; only the listing is read, not the contents)."""
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
               .option("recursiveFileLookup", "false").load(directory).select("path"))
    return sorted({r["path"].rstrip("/").split("/")[-1] for r in listing.collect()})


def load_csv_dir(spark: SparkSession, directory: str, name: str | None = None,
                 **kw) -> DirLoad:
    """S3: none found raises; a given name must exist (else the error lists
    the files); a single file loads; several without a name return the list."""
    try:
        names = list_csv_files(spark, directory)
    except Exception as e:                          # missing folder
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            names = []
        else:
            raise
    if not names:
        raise ValueError(f"no CSV files found in {directory!r}")
    if name is not None:
        if name not in names:
            raise ValueError(f"CSV {name!r} not found. Available files: {', '.join(names)}")
        chosen = name
    elif len(names) == 1:
        chosen = names[0]
    else:
        return DirLoad(None, None, names)
    path = directory.rstrip("/") + "/" + chosen
    return DirLoad(load_csv(spark, path, **kw), chosen, names)


def export_name(name: str) -> str:
    """The export is named ``cleaned_<name>``."""
    return EXPORT_PREFIX + name


def export_csv(df: DataFrame, path: str, single_file: bool = False,
               mode: str = "overwrite") -> str:
    """Header row, no index, NULL as an empty field, ``''`` as ``""``.

    Every task writes its own part file; ``single_file=True`` funnels the
    data through one task and is meant for small results only.
    """
    out = df.coalesce(1) if single_file else df
    # Spark's writer trims values unless told otherwise; an export keeps them
    (out.write.mode(mode).option("header", "true").option("escape", '"')
     .option("nullValue", "").option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .csv(path))
    return path
