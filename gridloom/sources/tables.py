"""Point tables as text, field definitions with their data, and vector sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Column names that stand for coordinates, best first.
X_NAMES = ("x", "easting", "east", "lon", "long", "longitude", "e")
Y_NAMES = ("y", "northing", "north", "lat", "latitude", "n")


def header(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """Column names and separator (comma, tab, semicolon or blanks) of the first line of a text table."""
    line = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    first = line[0]["value"] if line else ""
    sep = next((s for s in (",", "\t", ";") if s in first), " ")
    return [n.strip().strip('"') for n in (first.split() if sep == " " else first.split(sep))], sep


def guessed(names: list[str], wanted: tuple[str, ...]) -> str | None:
    """The first of ``wanted`` among ``names``, whatever their case; else one that begins so."""
    lower = {n.lower(): n for n in reversed(names)}
    whole = next((lower[w] for w in wanted if w in lower), None)
    return whole or next((lower[n] for w in wanted if len(w) > 1 for n in lower if n.startswith(w)), None)


def points(spark: SparkSession, path: str, x: str | None = None, y: str | None = None) -> DataFrame:
    """A text table with a header, its columns typed by content, with ``x`` and ``y`` as numbers in front.

    Coordinate columns are guessed if not named; rows whose coordinates are no numbers are left out.
    """
    names, sep = header(spark, path)
    x, y = x or guessed(names, X_NAMES), y or guessed(names, Y_NAMES)
    if x not in names or y not in names:
        raise ValueError(f"no coordinate columns among {names}")
    if sep == " ":
        cut = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
        raw = spark.read.text(path).where("trim(value) <> ''").select(cut.alias("f")).where(F.col("f") != F.array(*map(F.lit, names)))
        rows = raw.select(*[F.get("f", F.lit(k)).alias(n) for k, n in enumerate(names)])
        number = rows.agg(*[F.every(F.col(f"`{n}`").isNull() | F.col(f"`{n}`").try_cast("double").isNotNull()).alias(n) for n in names]).first()
        rows = rows.select(*[F.col(f"`{n}`").try_cast("double").alias(n) if number[n] else F.col(f"`{n}`") for n in names])
    else:
        rows = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
    rest = [F.col(f"`{n}`") for n in rows.columns if n not in (x, y)]
    found = rows.select(F.col(f"`{x}`").cast("string").try_cast("double").alias("x"), F.col(f"`{y}`").cast("string").try_cast("double").alias("y"), *rest)
    return found.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def xyz_columns(lines: DataFrame) -> DataFrame:
    """``(file, columns)`` of ``lines(file, at, line)`` of an XYZ file: values beyond the coordinates on the first data row."""
    size = F.size(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "))
    data = lines.where(F.trim("line").rlike(r"^[-+0-9.]"))
    return data.groupBy("file").agg((F.min_by(size, "at") - 2).alias("columns"))


def epsg_of_sidecar(spark: SparkSession, path: str, default: int = 4326) -> DataFrame:
    """``(file, epsg)`` from ``wellknown_epsg="..."`` in the XML beside a grid; ``default`` where it is missing."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    code = F.regexp_extract("value", r'wellknown_epsg\s*=\s*"?(\d+)', 1).try_cast("int")
    return text.select("file", F.coalesce(code, F.lit(default)).alias("epsg"))


# What a field definition line and its format look like, and the systems it may name.
_FIELD = re.compile(r"^\s*DEFN\s*(?:\d+)?\s*(?:ST=RECD,)?\s*(?:RT=(\w*))?\s*[;,]?\s*(.*)$", re.IGNORECASE)
_FORMAT = re.compile(r"^(\d*)([IFEDA])(\d+)(?:\.(\d+))?$", re.IGNORECASE)
_ZONE = re.compile(r"(?:GDA94|MGA).*?ZONE\s*(\d{2})", re.IGNORECASE)


def definitions(text: str) -> tuple[list[dict], int | None]:
    """Fields of a definition file in order, and the EPSG code that it names or implies.

    A field has ``name``, ``kind`` (int, double or string), ``count`` (values it takes) and ``null``.
    """
    fields, epsg = [], None
    for line in text.splitlines():
        code = re.search(r"EPSG\D{0,3}(\d{4,5})", line, re.IGNORECASE)
        zone = _ZONE.search(line)
        if code:
            epsg = int(code.group(1))
        elif zone and 49 <= int(zone.group(1)) <= 56 and epsg is None:
            epsg = 28300 + int(zone.group(1))
        elif "WGS84" in line.upper().replace(" ", "") and epsg is None:
            epsg = 4326
        m = _FIELD.match(line)
        if not m or (m.group(1) or "").upper() not in ("", "DATA") or "END DEFN" in line.upper():
            continue
        parts = [p.strip() for p in re.split(r"[:;]", m.group(2)) if p.strip()]
        if len(parts) < 2 or not (f := _FORMAT.match(parts[1])):
            continue
        null = re.search(r"NULL\s*=\s*([^,:;\s]+)", line, re.IGNORECASE)
        kind = {"I": "int", "A": "string"}.get(f.group(2).upper(), "double")
        fields.append({"name": parts[0], "kind": kind, "count": int(f.group(1) or 1), "null": null.group(1) if null else None})
    return fields, epsg


def defined_data(spark: SparkSession, fields: list[dict], path: str) -> DataFrame:
    """Rows of a data file by its definitions: tokens between blanks, arrays joined by ``;``, a last ``*...`` token as ``COMMENTS``.

    A leading ``DATA`` token is dropped; a token equal to the field's null value, as text or as a
    number, is NULL, as are tokens that are no number and fields beyond the end of the row.
    """
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where("trim(value) <> ''").select(tokens.alias("t"))
    rows = rows.select(F.when(F.upper(F.col("t")[0]) == "DATA", F.slice("t", 2, F.size("t"))).otherwise(F.col("t")).alias("t"))

    def one(token: Column, field: dict) -> Column:
        value = token if field["kind"] == "string" else token.try_cast("double")
        if field["null"] is not None:
            same = token == field["null"]
            try:
                same = same | F.coalesce(token.try_cast("double") == float(field["null"]), F.lit(False))
            except ValueError:
                pass
            value = F.when(~same, value)
        return value if field["kind"] != "int" else value.cast("long")

    def joined(part: Column, field: dict) -> Column:
        return F.array_join(F.transform(part, lambda x: one(x, field).cast("string")), ";", "")

    out, at = [], 0
    for f in fields:
        if f["count"] == 1:
            out.append(one(F.get("t", F.lit(at)), f).alias(f["name"]))
        else:
            out.append(joined(F.slice("t", at + 1, f["count"]), f).alias(f["name"]))
        at += f["count"]
    comment = F.filter(F.slice("t", at + 1, F.greatest(F.size("t") - at, F.lit(0))), lambda x: x.startswith("*"))
    return rows.select(*out, F.array_join(comment, " ").alias("COMMENTS"))


def _system(text: str) -> int | None:
    """The code that a projection text of the older form implies: a zone of GDA94, or WGS84."""
    if "GDA94" in text and "zone" in text.lower():
        zone = re.match(r"\s*(\S+)", text.lower().split("zone")[1])
        digits = re.sub(r"\D", "", zone.group(1)) if zone else ""
        return 28300 + int(digits) if digits and 49 <= int(digits) <= 56 else None
    return 4326 if "WGS84" in text else None


def legacy_definitions(text: str, projection: str | None = None) -> tuple[list[dict], int | None, bool]:
    """Fields of a definition file of the older form, the EPSG code, and whether rows carry their record type as a field.

    A line defines one field, the first of its parts with a name and a format; numbered lines are put
    in order.  The code comes from ``projection``, the text of the projection file, before the definitions.
    """
    fields = []
    for line in map(str.strip, text.splitlines()):
        if not line.startswith("DEFN") or not ("ST=RECD,RT=;" in line or "ST=RECD,RT=DATA;" in line):
            continue
        number = re.match(r"DEFN (\d+)\s", line)
        for part in line.split(";"):
            name, _, form = part.partition(":")
            given = re.search(r"NAME=([^,]*)", part)
            if form.strip()[:1] in tuple("FIDA"):
                kind = {"I": "int", "A": "string"}.get(form.strip()[0], "double")
                fields.append({"name": (given.group(1) if given else name).strip(), "kind": kind, "number": int(number.group(1)) if number else None})
                break
    if all(f["number"] is not None for f in fields):
        fields.sort(key=lambda f: f["number"])
    epsg = _system(projection or "")
    return fields, _system(text) if epsg is None else epsg, "ST=RECD,RT=DATA;RT:A4;" in text


def legacy_data(spark: SparkSession, fields: list[dict], path: str, typed_rows: bool) -> DataFrame:
    """Rows of a data file of the older form: tokens between blanks, one for each field, more are ignored.

    Rows with fewer tokens than fields are left out.  A leading ``DATA`` is dropped, as a token of its
    own where rows carry their type (``typed_rows``; too short rows are left out then as well), and as the
    first four letters otherwise.  A token that is no number is NULL in a field of numbers.
    """
    cut = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = spark.read.text(path).select(line.alias("line")).where("line <> ''").select("line", F.split("line", " ").alias("t")).where(F.size("t") >= len(fields))
    if typed_rows:
        first = F.col("t")[0] == "DATA"
        rows = rows.where(~first | (F.size("t") > len(fields)))
        own = F.when(first, F.slice("t", 2, F.size("t"))).when(F.col("line").startswith("DATA"), cut(F.substring("line", 5, 1 << 30))).otherwise(F.col("t"))
    else:
        own = F.when(F.col("line").startswith("DATA"), cut(F.substring("line", 5, 1 << 30))).otherwise(F.col("t"))
    rows = rows.select(own.alias("t"))
    of = {"string": lambda t: t, "int": lambda t: t.try_cast("long"), "double": lambda t: t.try_cast("double")}
    return rows.select(*[of[f["kind"]](F.get("t", F.lit(k))).alias(f["name"]) for k, f in enumerate(fields)])


def short_names(names: list[str], length: int = 10) -> list[str]:
    """Names cut to ``length`` characters; a number takes the place of the end of one that is already there."""
    out: list[str] = []
    for name in names:
        short, k = name[:length], 1
        while short.lower() in (o.lower() for o in out):
            short, k = f"{name[: length - len(str(k))]}{k}", k + 1
        out.append(short)
    return out


def point_table(rows: DataFrame, x: str = "x", y: str = "y", length: int = 10) -> DataFrame:
    """``rows`` with short unique names and the place as ``wkt``, ready for any text or Parquet sink."""
    place = F.concat(F.lit("POINT ("), F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string")), F.lit(")"))
    return rows.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(rows.columns, short_names(rows.columns, length))], place.alias("wkt"))


def write_levels(found: DataFrame, path: str) -> None:
    """Edge points of all levels as text with the header ``y,x,z,val``."""
    found.select("y", "x", "z", "val").write.mode("overwrite").csv(path, header=True)


def write_estimates(found: DataFrame, path: str) -> None:
    """Depth estimates as text, a folder for each structural index: northing, easting, depth, base level."""
    out = found.select("si", F.col("y").alias("y_source"), F.col("x").alias("x_source"), F.col("z").alias("z_source"), F.col("base").alias("base_level"))
    out.write.mode("overwrite").partitionBy("si").csv(path, header=True)


def write_grid(cells: DataFrame, path: str) -> None:
    """A grid as Parquet, clustered by row so that a reader of some rows opens few files."""
    cells.repartitionByRange("row").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the values of ``changes``, which has the same columns, where keys agree."""
    new = changes.dropDuplicates([key])
    both = rows.alias("a").join(new.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    return both.select(*[F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in rows.columns])


def deleted(rows: DataFrame, where: str) -> DataFrame:
    """``rows`` without those that meet the condition; a condition that is unknown deletes nothing."""
    return rows.where(~F.coalesce(F.expr(where), F.lit(False)))


def sorted_naturally(rows: DataFrame, column: str) -> DataFrame:
    """By value where the text is a number, those first, else as text."""
    return rows.orderBy(F.col(column).try_cast("double").isNull(), F.col(column).try_cast("double"), column)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``seq`` from 0 by the given order within ``file``."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1)
