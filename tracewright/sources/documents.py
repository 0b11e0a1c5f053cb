"""Board records in JSON documents: their schemas, and reading and writing them as tables.

A document is an object with settings and arrays of records. As tables it is one table of the settings and one for each
array, all with the column document, the path; records also have ord, their place, which decides ties elsewhere. A
broken document is an error, not a row of nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
BOX = "struct<x:double,y:double,width:double,height:double>"
INT_BOX = "struct<x:int,y:int,width:int,height:int>"
def _split_fields(ddl: str) -> list[str]:
    """The parts of a column list, split at its outer commas."""
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return out


def _nested(ddl: str) -> str:
    """A column list as struct fields: name:type for each."""
    return ",".join(":".join(f.split(" ", 1)) for f in _split_fields(ddl))


#: Records by name, in the JSON's field names.
SCHEMAS = {
    "vias": f"id string, center {POINT}, radius double, side int, circularity double, confidence double, method int, pad_boundary array<{POINT}>, matched_via_id string, both_sides_confirmed boolean",
    "confirmed_vias": f"id string, front_via_id string, back_via_id string, center {POINT}, radius double, intersection_boundary array<{POINT}>, confidence double, component_id string, pin_number string, signal_name string, pull_up boolean, pull_down boolean",
    "tracks": f"id string, layer int, points array<{POINT}>, width double, net string, source int, bounds {INT_BOX}",
    "connectors": f"id string, index int, side int, center {POINT}, bounds {INT_BOX}, detection_pass int, confidence double, pin_number int, signal_name string, net_id string",
    "components": f"id string, part_number string, description string, package string, bounds {BOX}, layer int, confirmed boolean, pins array<struct<number:int,name:string,position:{POINT},net:string>>, rotation double, ocr_text string, ocr_orientation string, corrected_text string, manufacturer string, place string, date_code string, revision string, speed_grade string",
    "nets": f"id string, name string, manual_name boolean, description string, root_connector_id string, elements array<struct<type:int,id:string,position:{POINT}>>, connector_ids array<string>, via_ids array<string>, trace_ids array<string>, pad_ids array<string>, is_complete boolean, has_errors boolean",
    "parts": "part_number string, package string, pin_count int, pins array<struct<number:int,name:string,direction:string>>, aliases array<string>, description string, functions array<struct<name:string,type:string,inputs:array<int>,outputs:array<int>,enables:array<int>,clocks:array<int>,expr:string>>",
    "board_pins": "pin_number int, signal_name string, description string, connector_index int, side string, logic_sense string, direction string, bus_group string, bus_bit_index int",
    "component_samples": f"bounds {BOX}, reference string, mean_hue double, mean_sat double, mean_val double, width_mm double, height_mm double, white_ratio double, bg_val double, marking_val double, bg_pct double, marking_pct double",
    "ocr_samples": "truth string, detected string, score double, orientation string, params struct<brightest_pct:double,min_threshold:int,fixed_threshold:int,clahe_clip:double,clahe_tile:int,min_scale_dim:int,invert:boolean,use_otsu:boolean,use_adaptive:boolean,adaptive_block:int,adaptive_c:int,dilate:int,erode:int,psm_mode:int>, text_length int, line_count int, has_logos boolean, manufacturer string, package string, timestamp bigint",
    "via_samples": f"id string, center {POINT}, radius double, side int, is_via boolean, source string, timestamp timestamp",
    "logos": f"name string, manufacturer_id string, bounds {INT_BOX}, width int, height int, quantized_size int, bits binary, source_component string, side string",
    "net_connections": "name string, connections array<struct<component:string,pin:int,pin_name:string>>",
    "colors": "h double, s double, v double",
    "contacts": f"center {POINT}, bounds {INT_BOX}, pass int",
    "sheets": "number int, name string",
}

_COLOR_FIGURES = "struct<h_mean:double,h_std:double,s_mean:double,s_std:double,v_mean:double,v_std:double>"
_PLACE = "struct<x:double,y:double,flip_h:boolean,flip_v:boolean,rotation:int,sheet:int>"
_SIDED = "offset struct<x:int,y:int>, rotation double, shear_top_x double, shear_bottom_x double, shear_left_y double, shear_right_y double, auto_rotation double, auto_scale_x double, auto_scale_y double, rotation_center struct<x:double,y:double>, crop struct<x:int,y:int,width:int,height:int>, import_rotation double, image string, normalized string"
_PARAMETER_FIGURES = "struct<otsu_rate:double,fixed_rate:double,adaptive_rate:double,histogram_rate:double,best_fixed_thresholds:array<int>,best_clahe_clip:double,best_clahe_tile:int,best_min_scale:int,psm_stats:map<string,double>,invert_true_rate:double,invert_false_rate:double>"
_PROJECT_SETTINGS = (
    "version int, name string, board_type string, aligned boolean, alignment_error double, dpi double, components_path string, traces_path string, netlist_path string, "
    + ", ".join(f"{side}_{field.strip()}" for side in ("front", "back") for field in _split_fields(_SIDED))
    + f", logo_library struct<logos:array<struct<name:string,manufacturer_id:string,bounds:{INT_BOX},width:int,height:int,quantized_size:int,bits:binary>>>, board_outline array<{POINT}>, view_zoom double, view_scroll_x double, view_scroll_y double"
)
#: Documents by kind: the settings' columns, and the arrays as (key in the document, record).
DOCUMENTS = {
    "project": (_PROJECT_SETTINGS, {"vias": "vias", "confirmed_vias": "confirmed_vias", "traces": "tracks", "connectors": "connectors", "components": "components", "nets": "nets", "component_training": "component_samples", "front_contacts": "contacts", "back_contacts": "contacts"}),
    "project_header": ("version int, name string, created timestamp, modified timestamp, board_type string, description string, front_image string, back_image string, aligned boolean, alignment_error double, dpi double, components string, traces string, netlist string, settings struct<default_ocr_engine:string,electronics_ocr_mode:boolean,trace_color_tolerance:int>", {}),
    "component_training": ("", {"samples": "component_samples"}),
    "reading_training": ("version int, orientation_stats map<string,struct<count:int,avg_score:double,best:double>>, param_stats " + _PARAMETER_FIGURES, {"samples": "ocr_samples"}),
    "via_training": ("", {"samples": "via_samples"}),
    "library": ("", {"parts": "parts"}),
    "logos": ("", {"logos": "logos"}),
    "board_definition": ("name string, version string, total_pins int, pins_per_side int", {"pins": "board_pins"}),
    "board_spec": ("name string, width_inches double, height_inches double, contacts struct<edge:int,count:int,pitch_inches:double,width_inches:double,height_inches:double,margin_inches:double>, holes array<struct<x_inches:double,y_inches:double,diam_inches:double,name:string>>, alignment_methods array<int>", {}),
    "netlist": ("name string, version string", {"components": "components", "nets": "net_connections"}),
    "copper_training": ("layer int", {"on_trace_hsv": "colors", "off_trace_hsv": "colors"}),
    "copper_classifier": (f"on_stats {_COLOR_FIGURES}, off_stats {_COLOR_FIGURES}, trained boolean, layer int", {}),
    "layout": (f"symbols map<string,{_PLACE}>, off_sheet_connectors map<string,{_PLACE}>", {"sheets": "sheets"}),
}


def document_schema(kind: str) -> str:
    """The columns of a document of a kind, in one line of DDL."""
    settings, arrays = DOCUMENTS[kind]
    fields = [settings] if settings else []
    return ", ".join(fields + [f"{key} array<struct<{_nested(SCHEMAS[record])}>>" for key, record in arrays.items()])


def _document() -> Column:
    """A document's name: what it was saved under, else its file's name without folders and ending."""
    path = F.input_file_name()
    saved = F.regexp_extract(path, r"/document=([^/]*)/[^/]*$", 1)
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    decoded = lambda c: F.url_decode(F.regexp_replace(c, r"\+", "%2B"))
    return F.when(saved != "", decoded(decoded(saved))).otherwise(decoded(stem))  # a folder's name is escaped, and so is the address


def _read(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """(document, the schema's columns) of the JSON documents below path."""
    name = F.concat_ws("#", _document(), F.monotonically_increasing_id().cast("string")) if lines else _document()
    texts = spark.read.text(path, wholetext=not lines).select(name.alias("document"), F.col("value"))
    blank = F.trim("value") == "" if lines else F.lit(False)
    texts = texts.where(~blank)
    # in an array of its own, a text of more or less than one document is no array of one
    single = F.coalesce(F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))), F.lit(0)) == 1
    error = F.raise_error(F.concat(F.lit("malformed document, or text after its end: "), "document"))
    whole = F.when(single, F.col("value")).when(~blank, error)  # filters may run after this
    return texts.select("document", F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("r")).select("document", "r.*")


def load_documents(spark: SparkSession, path: str, kind: str, lines: bool = False) -> dict[str, DataFrame]:
    """The documents below path as tables: settings, and one for each array. A missing array gives no rows.

    A file holds one document, however it is indented, or with lines one in each of its lines; empty lines are none. A
    broken document, and text after a document's end, fail the query that reads them. A document is called what it was
    saved under, else by its file; of a file of lines also by a number.
    """
    docs = _read(spark, path, document_schema(kind), lines)
    settings, arrays = DOCUMENTS[kind]
    tables = {key: docs.select("document", F.posexplode(key).alias("ord", "r")).select("document", "ord", "r.*") for key in arrays}
    return tables | {"settings": docs.drop(*arrays)}


def document_texts(tables: dict[str, DataFrame], kind: str, pretty: bool = True) -> DataFrame:
    """(document, value): each document's JSON from its tables; arrays in the order of ord, [] without rows. Null fields,
    and arrays without a table, are left out."""
    _, arrays = DOCUMENTS[kind]
    doc = tables["settings"]
    for key in arrays:
        if key in tables:
            rows = tables[key]
            fields = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in ("document", "ord")))
            in_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", fields.alias("r")))), lambda x: x["r"])
            doc = doc.join(rows.groupBy("document").agg(in_order.alias(key)), "document", "left").withColumn(key, F.coalesce(key, F.array()))
    return doc.select("document", F.to_json(F.struct(*(c for c in doc.columns if c != "document")), {"pretty": str(pretty).lower()}).alias("value"))


def save_documents(tables: dict[str, DataFrame], path: str, kind: str) -> None:
    """One file a document below path: what load_documents() reads."""
    texts = document_texts(tables, kind)
    texts.repartitionByRange(max(texts.count(), 1), "document").write.mode("overwrite").partitionBy("document").text(path)


def load_records(spark: SparkSession, path: str, name: str, lines: bool = True) -> DataFrame:
    """A table of records from lines of JSON, or from documents that are arrays of records; broken ones are an error."""
    return spark.read.schema(SCHEMAS[name]).json(path, multiLine=not lines, mode="FAILFAST")


def save_records(df: DataFrame, path: str) -> None:
    """Records as lines of JSON, one file a partition."""
    df.write.mode("overwrite").json(path)


def load_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Project documents as tables: settings, and one for each array of records."""
    tables = load_documents(spark, path, "project")
    names = DOCUMENTS["project"][1]
    return {names[k] if k == "traces" else k: t for k, t in tables.items()}


def save_project(tables: dict[str, DataFrame], path: str, version: int = 3) -> None:
    """Projects from the tables of load_project(), settings and order kept; the settings get the version."""
    named = {"traces" if k == "tracks" else k: t for k, t in tables.items()}
    save_documents(named | {"settings": tables["settings"].withColumn("version", F.lit(version))}, path, "project")


def load_reader_samples(spark: SparkSession, path: str) -> DataFrame:
    """What reading trials need of a project, its components' places and texts only: the columns are pruned by schema."""
    fields = f"components array<struct<id:string,bounds:{BOX},ocr_orientation:string,corrected_text:string,ocr_text:string>>"
    docs = _read(spark, path, fields, lines=False)
    return docs.select("document", F.posexplode("components").alias("ord", "r")).select("document", "ord", "r.*")


def load_parts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts library as parts, part_pins, part_aliases and part_functions."""
    parts = load_documents(spark, path, "library")["parts"]
    key = ("part_number", "package")
    return {
        "parts": parts.select(*key, "pin_count", "description"),
        "part_pins": parts.select(*key, F.explode("pins").alias("p")).select(*key, F.col("p.number").alias("pin_number"), F.col("p.name").alias("pin_name"), F.col("p.direction").alias("direction")),
        "part_aliases": parts.select(*key, F.explode("aliases").alias("alias")),
        "part_functions": parts.select(*key, F.posexplode("functions").alias("fn", "f")).select(*key, F.col("fn").alias("ord"), "f.*"),
    }


def places(layouts: DataFrame, column: str = "symbols") -> DataFrame:
    """(document, id, x, y, ...) of a layout's map of saved places."""
    return layouts.select("document", F.explode(column).alias("id", "r")).select("document", "id", "r.*")


def places_map(rows: DataFrame, column: str = "symbols") -> DataFrame:
    """(document, column): the map of saved places back from its rows; an id that occurs twice is an error."""
    fields = F.struct(*(F.col(c) for c in rows.columns if c not in ("document", "id")))
    return rows.groupBy("document").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", fields.alias("r"))))).alias(column))


def startup_tables(spark: SparkSession, paths: dict[str, str], least_score: float = 0.7) -> dict[str, DataFrame]:
    """The libraries that a session begins with, by kind; readings below the score are left out. A kind without a path
    gives an empty table."""
    wanted = {"logos": "logos", "reading_training": "samples", "library": "parts", "component_training": "samples"}
    out = {}
    for kind, array in wanted.items():
        record = DOCUMENTS[kind][1][array]
        empty = spark.createDataFrame([], f"document string, ord int, {SCHEMAS[record]}")
        out[kind] = load_documents(spark, paths[kind], kind)[array] if kind in paths else empty
    return out | {"reading_training": out["reading_training"].where(F.col("score") >= least_score)}


def save_text(lines: DataFrame, order: list[str], path: str) -> None:
    """Lines of text in order, range-partitioned, so that the files in turn hold the whole."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
