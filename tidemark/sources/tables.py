"""Schemas, scans and sinks of the engine's tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.grid import TILE

LAKE = "col int, row int, flood_id long"
PIXELS = LAKE + ", value double"
DICTIONARY = "combo_id long, flood_ids array<long>"
EVENTS = "global_id long, start_date string, end_date string, year string, cluster_id string, filename string, download_url string"
INVENTORY = EVENTS + ", size_bytes long"
LEDGER = "global_id long, filename string, download_status string, process_status string, points long, last_error string"
TILES = "tile_id string, name string, minx double, miny double, maxx double, maxy double"
REGIONS = "NUTS_ID string, LEVL_CODE int, CNTR_CODE string, NAME_LATN string, NUTS_NAME string"
RINGS = "array<array<struct<x:double,y:double>>>"
DICTIONARY_SCHEMA_VERSION, CACHE_SCHEMA_VERSION, INDEX_SCHEMA_VERSION = 5, 1, 1


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all events; files without the partition folders of the writer are found too."""
    return spark.read.schema(LAKE).option("recursiveFileLookup", "true").parquet(path)


def write_lake(cells: DataFrame, path: str, asked: DataFrame | None = None) -> None:
    """cells (col, row, flood_id, year) by year and event; the committer makes the write atomic.

    A rerun replaces the folders of the events it has, so it leaves no cell twice; other events stay as they are.
    asked (flood_id): the events of this run. Those that come back empty, or with another year, lose their old folders
    once the new ones are there.
    """
    placed = cells.withColumn("event", F.col("flood_id")).repartition("event", F.floor(F.col("row") / TILE))  # a large event is many tasks
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "event").parquet(path)
    if asked is None:
        return
    spark = cells.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = {(str(r.year), str(r.flood_id)) for r in cells.select("year", "flood_id").distinct().join(asked, "flood_id", "left_semi").collect()}  # a row per event of a run
    due = {str(r.flood_id) for r in asked.select("flood_id").distinct().collect()}
    for folder in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "year=*/event=*")) or []:
        place = folder.getPath()
        event, year = place.getName().removeprefix("event="), place.getParent().getName().removeprefix("year=")
        if event in due and (year, event) not in kept:
            system.delete(place, True)


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows) of each Parquet file under a path, from the footers alone; rows is null where a file cannot be read.

    A scan without columns reads no more than footers. Files it says nothing about are empty or torn, which their own
    footers tell; of these, and of no others, the bytes are read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    scanned = spark.read.schema(LAKE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true").parquet(path)
    counted = scanned.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  # the two readers spell local files apart
    counted = counted.select(same("path").alias("path"), "rows")
    files = listed.select(same("path").alias("path"), "content")
    known = files.select("path").join(counted, "path")

    def opened(batches):
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for data in batch.column(1):
                try:
                    out.append(pq.ParquetFile(io.BytesIO(data.as_py())).metadata.num_rows)
                except Exception:  # whatever is wrong with the bytes, the file cannot be read
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["path", "rows"])

    return known.unionByName(files.join(counted.select("path"), "path", "left_anti").mapInArrow(opened, "path string, rows long"))


def cached_points(spark: SparkSession, path: str) -> DataFrame:
    """(flood_id, points) of the events whose files under a lake's path can all be read; an event with a torn file is to be read anew."""
    event = F.regexp_extract("path", r"/event=([0-9]+)/", 1)
    found = file_rows(spark, path).where(event != "").groupBy(event.cast("long").alias("flood_id"))
    return found.agg(F.sum("rows").alias("points"), F.count_if(F.col("rows").isNull()).alias("torn")).where("torn = 0").select("flood_id", "points")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INVENTORY).csv(path, header=True)


def write_inventory(records: DataFrame, path: str) -> bool:
    """Valid records only; nothing is written when there are none."""
    from tidemark.functions.text import is_date

    valid = records.where(is_date(F.col("start_date")) & (F.col("end_date").isNull() | is_date(F.col("end_date"))))
    if valid.isEmpty():
        return False
    valid.write.mode("overwrite").csv(path, header=True)
    return True


def read_legacy_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON dictionary as rows (combo_id, flood_ids, events); events may be null."""
    event = EVENTS.replace(" long", ":bigint").replace(" string", ":string").replace(", ", ",")
    kind = f"combos map<string,struct<flood_ids:array<bigint>,events:array<struct<{event}>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j"))
    combos = whole.select(F.explode("j.combos").alias("k", "v"))
    return combos.select(F.col("k").cast("long").alias("combo_id"), "v.flood_ids", "v.events")


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON file: its properties and their rings (holes and further parts are rings too)."""
    shape = "struct<type:string,coordinates:string>"
    kind = f"features array<struct<properties:struct<{properties}>,geometry:{shape}>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j"))
    rows = whole.select(F.explode("j.features").alias("f")).select("f.properties.*", "f.geometry")
    single = F.from_json(F.col("geometry.coordinates"), "array<array<array<double>>>")
    several = F.flatten(F.from_json(F.col("geometry.coordinates"), "array<array<array<array<double>>>>"))
    flat = F.when(F.col("geometry.type") == "MultiPolygon", several).otherwise(single)
    rings = F.transform(flat, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.withColumn("rings", rings).drop("geometry")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Hazard tiles with their bounding boxes."""
    rows = read_features(spark, path, "id:string,name:string").withColumn("p", F.flatten("rings"))
    x, y = F.transform("p", lambda p: p["x"]), F.transform("p", lambda p: p["y"])
    return rows.select(F.col("id").alias("tile_id"), "name", F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    from tidemark.operators.regions import complete_columns

    return complete_columns(spark.read.schema("NUTS_ID string, LEVL_CODE string, CNTR_CODE string, NAME_LATN string, NUTS_NAME string").csv(path, header=True))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines with the order written (column line: the run, then the place in it); torn lines are left out.

    The run is the number that append_ledger put into the line; lines without one are of a single file, before all others.
    """
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    rows = lines.select("place", F.from_json("value", LEDGER + ", run long").alias("r")).select("place", "r.*").where("global_id IS NOT NULL")
    return rows.select(F.struct(F.coalesce("run", F.lit(0)).alias("run"), "place").alias("line"), *[c for c in rows.columns if c not in ("run", "place")])


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds the lines of one run, numbered by the time, as files have no order of their own and two runs may write at once."""
    rows.withColumn("run", F.lit(time.time_ns())).write.mode("append").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/pixel_combo")


def write_index(pixel_combo: DataFrame, path: str) -> None:
    """Cells with their combos, by tile: empty tiles are not there, and a region's scan prunes to its tiles."""
    tiled = pixel_combo.withColumn("tile_row", F.floor(F.col("row") / TILE).cast("int")).withColumn("tile_col", F.floor(F.col("col") / TILE).cast("int"))
    ranged = tiled.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col")
    ranged.write.mode("overwrite").partitionBy("tile_row").parquet(f"{path}/pixel_combo")


def write_dictionary(combos: DataFrame, path: str, row_group_bytes: int = 4 << 20) -> None:
    """Sorted by combo_id, so that row groups prune a lookup."""
    ranged = combos.repartitionByRange("combo_id").sortWithinPartitions("combo_id")
    ranged.write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("compression", "zstd").parquet(f"{path}/dictionary")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DICTIONARY).parquet(f"{path}/dictionary")


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").parquet(f"{path}/events")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table; a missing one is empty."""
    try:
        return spark.read.schema(EVENTS).parquet(f"{path}/events")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], EVENTS)


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    """CSV, JSON lines, GeoJSON features (one a line) or Parquet by the path's ending; CSV goes without the geometry, Parquet has it as well-known binary."""
    flat = catalogue.drop("geometry", "polygons")
    if path.endswith(".csv"):
        flat.write.mode("overwrite").csv(path, header=True)
    elif path.endswith(".geojson"):
        features(catalogue).write.mode("overwrite").text(path)
    elif path.endswith(".json"):
        catalogue.write.mode("overwrite").json(path)
    elif "geometry" in catalogue.columns or "polygons" in catalogue.columns:
        from tidemark.sources.geometry import write_geoparquet

        write_geoparquet(catalogue, path)
    else:
        catalogue.write.mode("overwrite").parquet(path)


def features(catalogue: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, as text. geometry, if there, holds rings as read_features gives them, polygons a list of
    such; without either, or where it is null, the feature's geometry is null."""
    shape, kept = F.lit("null"), [c for c in catalogue.columns if c not in ("geometry", "polygons")]
    at = lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    drawn = lambda kind, text: F.coalesce(F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), text, F.lit("}")), F.lit("null"))
    if "polygons" in catalogue.columns:
        shape = drawn("MultiPolygon", F.to_json(F.transform("polygons", lambda rings: F.transform(rings, at))))
    elif "geometry" in catalogue.columns:
        shape = drawn("Polygon", F.to_json(F.transform("geometry", at)))
    properties = F.to_json(F.struct(*kept))
    return catalogue.select(F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))


def json_records(catalogue: DataFrame) -> DataFrame:
    """One JSON record per row, without the geometry."""
    return catalogue.drop("geometry", "polygons").select(F.to_json(F.struct("*")).alias("record"))


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
