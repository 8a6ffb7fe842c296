"""The reports by role: which headers, sheets and texts mark a flow, balance, result or control file, and the typed scan of each.

All works on the long cells table of ``workbooks``; a file is read once, whatever the number of roles it is tried for. The functions behind ``first_rows`` do the same for any number
of files at once, on rows of sheets (file, sheet_index, sheet, row and ``cells``: col, value; of two values in one cell the first counts): what many files share, as first rows, names
of sheets and texts, is worked out once for each distinct one, and a row travels once, to its sheet.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from regmart.functions import numbers, text
from regmart.sources import workbooks
from regmart.sources.shared import stored


@dataclass(frozen=True)
class Role:
    """kind and signature of a file; header names with their aliases, in order; the column that each becomes; sheets that the scan and the score prefer; points of a header; texts of ``signal_column`` that score."""

    kind: str
    signature: str
    headers: dict[str, tuple[str, ...]]
    columns: tuple[str, ...]
    preferred: tuple[str, ...]
    scored: tuple[str, ...]
    header_weight: float
    signal_column: str | None = None
    signals: tuple[str, ...] = ()


# Headers with their aliases.
FLOW_HEADERS = {
    "Fecha Reporte": ("FECHA REPORTE", "FECHA_REPORTE", "FECHA DE REPORTE", "FECHA CORTE"),
    "CodInstitucion": ("CODINSTITUCION", "COD INSTITUCION", "COD. INSTITUCION", "CODIGO INSTITUCION"),
    "Institucion": ("INSTITUCION", "INSTITUCIÓN", "COMPANIA", "COMPAÑIA", "ASEGURADORA"),
    "RamoPadre": ("RAMOPADRE", "RAMO PADRE", "GRUPO RAMO", "RAMO PRINCIPAL"),
    "Ramo": ("RAMO", "SUBRAMO", "LINEA", "LÍNEA"),
    "CodMoneda": ("CODMONEDA", "COD MONEDA", "COD. MONEDA", "MONEDA COD"),
    "Moneda": ("MONEDA", "TIPO MONEDA"),
    "Saldo": ("SALDO", "VALOR", "MONTO", "PRIMAS", "IMPORTE"),
}
STATEMENT_HEADERS = {
    "Tipo": ("TIPO", "TIPO ESTADO", "CLASE", "SECCION"),
    "Inst": ("INST", "CODINSTITUCION", "COD INSTITUCION", "CODIGO", "INSTITUCION COD"),
    "Logo": ("LOGO", "INSTITUCION", "INSTITUCIÓN", "COMPANIA", "COMPAÑIA", "ASEGURADORA"),
    "FechaReporte": ("FECHAREPORTE", "FECHA REPORTE", "FECHA DE REPORTE", "FECHA CORTE"),
    "Linea": ("LINEA", "LÍNEA", "NRO LINEA", "ORDEN", "ITEM"),
    "Cuenta": ("CUENTA", "RUBRO", "CONCEPTO", "DESCRIPCION", "DESCRIPCIÓN"),
    "MonedaNacional": ("MONEDANACIONAL", "MONEDA NACIONAL", "MN", "MONTO NACIONAL"),
    "MonedaExtranjera": ("MONEDAEXTRANJERA", "MONEDA EXTRANJERA", "ME", "MONTO EXTRANJERO"),
}
FLOW_COLUMNS = ("report_date", "entity_code", "entity_name", "parent", "category", "currency_code", "currency", "amount")
STATEMENT_COLUMNS = ("type", "entity_code", "entity_name", "report_date", "line", "account", "national", "foreign")
# Sheets and account texts that mark a role.
SHEETS = ("Datos", "Balance", "Estado de Resultados", "EstadoResultado", "ER")
BALANCE_SIGNALS = ("TOTAL ACTIVOS", "ACTIVOS", "PASIVOS", "PATRIMONIO", "RESERVAS TECNICAS Y MATEMATICAS", "CUENTAS DE ORDEN Y REGISTRO")
RESULT_SIGNALS = ("UTILIDAD", "RESULTADO NETO", "INGRESOS FINANCIEROS", "PRIMAS RETENIDAS", "GASTOS DE INTERMEDIACION", "SINIESTRALIDAD RETENIDA", "ROE", "ROA")
CONTROL_SHEETS = ["1. RAMOS TOTALES", "8. PRIMAS Y SINIESTROS TOTALES", "RANKING DEL SISTEMA", "DESCARGA APP P&S", "DESCARGA BG"]
CONTROL_KIND, CONTROL_SIGNATURE = "reference", "reference-workbook-v2"
# The cell of the period, and sheet, header row, value row, columns and measure of the control totals.
PERIOD_CELL = ("descarga app P&S", 1, 2)
CONTROL_LAYOUT = [("Primas Diciembre 2025", 11, 61, 3, 14, "flow"), ("Balance Diciembre 2025", 9, 10, 5, 16, "balance")]
CONTROL_READ = (PERIOD_CELL[0], *(x[0] for x in CONTROL_LAYOUT))

FLOW = Role("premiums", "tabular-premiums-v2", FLOW_HEADERS, FLOW_COLUMNS, ("Datos", "Primas"), ("Datos", "Primas"), 12.0)
BALANCE = Role("financialPosition", "tabular-financial-position-v2", STATEMENT_HEADERS, STATEMENT_COLUMNS, SHEETS, ("Balance", "Situacion Financiera", "Estado de Situacion Financiera"), 8.0, "Cuenta", BALANCE_SIGNALS)
RESULT = Role("incomeStatement", "tabular-income-statement-v1", STATEMENT_HEADERS, STATEMENT_COLUMNS, SHEETS, ("EstadoResultado", "Estado de Resultados", "ER"), 8.0, "Cuenta", RESULT_SIGNALS)
ROLES = (FLOW, BALANCE, RESULT)
#: Texts and numbers are read as text; names must not be blank.
NEEDED = ("entity_name", "parent", "category", "currency", "account")


def schema(role: Role) -> StructType:
    return StructType([StructField(c, StringType(), c not in NEEDED) for c in role.columns])


def _header_key(alias: str) -> str:
    """``text.normalize_header_key`` of a known alias: capitals without signs."""
    return " ".join(re.sub(r"[.,;:()_/-]", " ", alias).split())


def _layout(role: Role) -> str:
    """Roles with the same headers share a layout."""
    return "flow" if role.headers is FLOW_HEADERS else "statement"


def known_headers(spark: SparkSession) -> DataFrame:
    """layout, header_key, header: the aliases of all layouts, some eighty rows; of one alias the last header counts."""
    listed = {(_layout(r), _header_key(alias)): name for r in ROLES for name, known in r.headers.items() for alias in known}
    return spark.createDataFrame([(*key, name) for key, name in listed.items()], "layout string, header_key string, header string")


def sheet_heads(table: DataFrame) -> DataFrame:
    """file, sheet_index, sheet and the cells of the first row (col, value) of every sheet that has cells: one pass over the cells, which all roles share."""
    seen = table.select("file", "sheet_index", "sheet", F.when(F.col("row") == 1, F.struct("col", "value")).alias("head")).distinct()  # of a sheet's body one row is left
    return seen.groupBy("file", "sheet_index", "sheet").agg(F.collect_list("head").alias("heads"))


def headers(heads: DataFrame) -> DataFrame:
    """file, sheet_index, sheet, col, layout, header: the header cells that a layout knows, under its names."""
    cells = heads.select("file", "sheet_index", "sheet", F.inline("heads")).withColumn("header_key", text.normalize_header_key(F.col("value")))
    return cells.join(F.broadcast(known_headers(heads.sparkSession)), "header_key").select("file", "sheet_index", "sheet", "col", "layout", "header")


def chosen_sheets(found: DataFrame) -> DataFrame:
    """file, kind, sheet_index, sheet, hits (header cells), named (whether the name scores): the first sheet of each file that has all headers of the role, sheets with preferred names first. One aggregate for all roles."""
    known = found.sparkSession.createDataFrame([(r.kind, _layout(r), len(r.headers), [x.upper() for x in r.preferred], [x.upper() for x in r.scored]) for r in ROLES], "kind string, layout string, width int, preferred array<string>, scored array<string>")
    sheets = found.groupBy("file", "sheet_index", "sheet", "layout").agg(F.count_distinct("header").alias("names"), F.count("*").alias("hits")).withColumn("name", text.normalize_text(F.col("sheet")))
    whole = sheets.join(F.broadcast(known), "layout").filter(F.col("names") == F.col("width"))  # three rows
    like = lambda names: F.exists(names, lambda p: F.col("name").contains(p))
    order = F.struct((~like("preferred")).alias("other"), "sheet_index")
    return whole.groupBy("file", "kind").agg(F.min_by(F.struct("sheet_index", "sheet", "hits", like("scored").alias("named")), order).alias("x")).select("file", "kind", "x.*")


@dataclass(frozen=True)
class Sheets:
    """What classification and scans share: first rows of the sheets, header cells by layout, the sheet of each file and role."""

    heads: DataFrame
    found: DataFrame
    chosen: DataFrame


def read_sheets(table: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sheets:
    """Reads the cells once for all roles; ``keep`` may cut the lineage of each part."""
    heads = keep(sheet_heads(table))
    found = keep(headers(heads))
    return Sheets(heads, found, keep(chosen_sheets(found)))


def rows(table: DataFrame, sheets: Sheets, kinds: DataFrame | None = None) -> DataFrame:
    """file, kind, source_row and ``cells`` (texts by header) of the rows of every file's sheets, of all roles or of those of ``kinds`` (file, kind), in one pass over the cells."""
    layouts = table.sparkSession.createDataFrame([(r.kind, _layout(r)) for r in ROLES], "kind string, layout string")
    chosen = sheets.chosen if kinds is None else sheets.chosen.join(kinds, ["file", "kind"], "left_semi")
    known = chosen.join(F.broadcast(layouts), "kind").select("file", "kind", "sheet_index", "layout").join(sheets.found.select("file", "sheet_index", "col", "layout", "header"), ["file", "sheet_index", "layout"])  # three layouts
    names = sorted({h for r in ROLES for h in r.headers})
    columns = known.groupBy("file", "sheet_index", "kind").agg(*[F.collect_list(F.when(F.col("header") == h, F.col("col"))).alias(h) for h in names])
    # The cells of a row come together before they meet the headers, so a sheet's cells travel once and as they are.
    held = F.collect_list(F.struct("col", "value")).alias("held")
    body = table.filter("row > 1").select("file", "sheet_index", F.col("row").alias("source_row"), "col", "value").repartition("file", "sheet_index").groupBy("file", "sheet_index", "source_row").agg(held)
    under = lambda h: F.filter("held", lambda c: F.array_contains(F.col(f"`{h}`"), c["col"]))
    picked = [F.when(F.size(F.col(f"`{h}`")) > 0, F.array_max(under(h))["value"]).alias(h) for h in names]  # of two columns with one header the last counts
    met = F.exists("held", lambda c: F.array_contains(F.flatten(F.array(*(F.col(f"`{h}`") for h in names))), c["col"]))
    return body.join(columns, ["file", "sheet_index"]).filter(met).select("file", "kind", "source_row", F.struct(*picked).alias("cells"))


def typed(found: DataFrame, role: Role) -> tuple[DataFrame, DataFrame]:
    """Rows of ``rows`` that are of the role, under its columns, and one issue for each value that the schema does not take."""
    own = found.filter(F.col("kind") == role.kind).select("file", "source_row", *[F.col(f"cells.`{name}`").alias(c) for name, c in zip(role.headers, role.columns)])
    return workbooks.conform(own, schema(role))


def scan(table: DataFrame, role: Role) -> tuple[DataFrame, DataFrame]:
    """Rows of the role's sheet in each file under the role's columns, and one issue for each value that the schema does not take."""
    sheets = read_sheets(table)
    return typed(rows(table, Sheets(sheets.heads, sheets.found, sheets.chosen.filter(F.col("kind") == role.kind))), role)


#: Columns of the rows of all roles.
PLACES = tuple(sorted({c for r in ROLES for c in r.columns}))


def first_rows(rows: DataFrame) -> DataFrame:
    """cells, layout, hits (header cells), head (a number), and for each of ``PLACES`` the columns (last first) under its header: every distinct first row that has all headers of a layout. Stored."""
    heads = rows.filter("row = 1").select(F.array_distinct("cells").alias("cells")).distinct()
    of = rows.sparkSession.createDataFrame([(_layout(r), h, c, len(r.headers)) for r in {_layout(r): r for r in ROLES}.values() for h, c in zip(r.headers, r.columns)], "layout string, header string, place string, width int")
    known = F.broadcast(known_headers(rows.sparkSession).join(F.broadcast(of), ["layout", "header"]))
    found = heads.select("cells", F.inline("cells")).withColumn("header_key", text.normalize_header_key(F.col("value"))).join(known, "header_key")
    places = [F.sort_array(F.collect_list(F.when(F.col("place") == c, F.col("col"))), asc=False).alias(c) for c in PLACES]
    whole = found.groupBy("cells", "layout", "width").agg(F.size(F.collect_set("header")).alias("names"), F.count("*").alias("hits"), *places).filter("names = width")
    return stored(whole.withColumn("head", F.monotonically_increasing_id()).drop("names", "width"))


def sheet_of_role(rows: DataFrame, heads: DataFrame, names: DataFrame) -> DataFrame:
    """file, kind, sheet_index, hits, named, head: ``chosen_sheets`` of rows of sheets, with the first row of each. ``names``: sheet and its normalized name. Stored."""
    known = rows.sparkSession.createDataFrame([(r.kind, _layout(r), [x.upper() for x in r.preferred], [x.upper() for x in r.scored]) for r in ROLES], "kind string, layout string, preferred array<string>, scored array<string>")
    tops = rows.filter("row = 1").select("file", "sheet_index", "sheet", F.array_distinct("cells").alias("cells")).join(heads.select("cells", "layout", "hits", "head"), "cells").drop("cells")
    like = lambda names: F.exists(names, lambda p: F.col("name").contains(p))
    marks = stored(names.crossJoin(F.broadcast(known)).select("sheet", "layout", "kind", (~like("preferred")).alias("other"), like("scored").alias("named")))  # three kinds
    order = F.when(F.col("other"), 1 << 32).otherwise(0) + F.col("sheet_index")  # numbers, so that the sheets of a file are compared without sorting the files
    best = tops.join(marks, ["sheet", "layout"]).groupBy("file", "kind").agg(F.min(order).alias("order"), *[F.min_by(c, order).alias(c) for c in ("hits", "named", "head")])
    return stored(best.withColumn("sheet_index", (F.col("order") % (1 << 32)).cast("int")).drop("order"))


def file_kinds(rows: DataFrame, sheets: DataFrame, names: DataFrame, heads: DataFrame, chosen: DataFrame, signal_weight: float = 15.0, bonus: float = 6.0) -> DataFrame:
    """file, kind, candidates and signature: ``classify`` of rows of sheets; ``sheets``: file, sheet_index and sheet of every sheet."""
    signals = [(r.kind, s) for r in ROLES for s in r.signals]
    place = next(c for r in ROLES if r.signals for h, c in zip(r.headers, r.columns) if h == r.signal_column)  # one column in one layout
    at = heads.filter(F.col("layout") == "statement").select("head", F.explode(place).alias("col"))
    texts = rows.filter(F.col("row").between(2, 60)).select("file", "sheet_index", F.inline("cells")).join(F.broadcast(at.select("col").distinct()), "col")  # numbers of columns
    texts = stored(texts.distinct())
    bits = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col("shown").contains(s), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, s) in enumerate(signals)])
    told = stored(texts.select("value").distinct().withColumn("shown", text.normalize_text(F.col("value")))).select("value", bits.alias("bits")).filter("bits <> 0")
    shown = texts.join(told, "value").groupBy("file", "sheet_index", "col").agg(F.bit_or("bits").alias("bits"))
    mask = {r.kind: sum(1 << i for i, (kind, _) in enumerate(signals) if kind == r.kind) for r in ROLES if r.signals}
    of_role = chosen.filter(F.col("kind").isin(*mask)).join(at, "head").select("file", "kind", "sheet_index", "col")
    own = reduce(lambda rest, x: F.when(F.col("kind") == x[0], F.lit(x[1]).cast("long")).otherwise(rest), mask.items(), F.lit(0).cast("long"))
    hits = of_role.join(shown, ["file", "sheet_index", "col"]).groupBy("file", "kind").agg((F.bit_count(F.bit_or(F.col("bits").bitwiseAND(own))) * signal_weight).alias("score"))
    weight = reduce(lambda rest, r: F.when(F.col("kind") == r.kind, r.header_weight).otherwise(rest), ROLES, F.lit(0.0))
    base = chosen.select("file", "kind", (F.col("hits") * weight + F.when(F.col("named"), bonus).otherwise(0.0)).alias("score"))
    control = workbooks.sheet_scores(sheets.join(names, "sheet"), CONTROL_KIND, CONTROL_SHEETS)
    return signed(workbooks.decide(base.unionByName(hits).unionByName(control), (CONTROL_KIND, *(r.kind for r in ROLES))))


def placed(rows: DataFrame, own: DataFrame, heads: DataFrame) -> DataFrame:
    """source_row, the columns of ``own`` (file, sheet_index, head and others) and ``PLACES`` of the rows of its sheets, with the first row's ``report_date`` as ``first_date``: rows travel once, by sheet. Of two columns with one header the last counts."""
    body = rows.filter("row > 1").select("file", "sheet_index", F.col("row").alias("source_row"), F.col("cells.col").alias("_cols"), F.col("cells.value").alias("_values"))
    at = lambda col: F.get("_values", (F.array_position("_cols", col) - 1).cast("int"))
    under = lambda c: F.when(F.size(c) > 1, F.get(F.filter(F.transform(c, at), lambda v: v.isNotNull()), F.lit(0))).otherwise(at(F.get(c, F.lit(0))))
    met = body.join(own, ["file", "sheet_index"]).join(heads.select("head", *PLACES), "head")
    out = met.select("source_row", *own.columns, *[under(F.col(c)).alias(c) for c in PLACES]).filter(F.coalesce(*PLACES).isNotNull())
    return out.withColumn("first_date", F.min_by("report_date", "source_row").over(Window.partitionBy("file", "sheet_index")))


def control(table: DataFrame, spark: SparkSession) -> DataFrame:
    """file, measure, key, expected of control files."""
    layout = spark.createDataFrame(CONTROL_LAYOUT, "sheet string, header_row int, value_row int, col_from int, col_to int, measure string")
    return workbooks.control_totals(table, F.broadcast(layout))  # two rows


def period_label(table: DataFrame, cell: tuple[str, int, int] = PERIOD_CELL) -> DataFrame:
    """file and the period (``YYYY-MM`` text, first day) that the file states in one cell (sheet, row, column); a file without that cell has no row."""
    sheet, row, col = cell
    at = table.filter((F.col("sheet") == sheet) & (F.col("row") == row) & (F.col("col") == col))
    label = F.trim("value")
    return at.select("file", label.alias("period"), F.when(label.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), numbers.period_from_year_month(label)).alias("period_start"))


def scores(table: DataFrame, sheets: Sheets | None = None, signal_weight: float = 15.0, bonus: float = 6.0) -> DataFrame:
    """file, kind and score for every role; a file that shows nothing of a role has no row of it.

    A role's score: points for every header cell of its sheet, for every signal that the texts of rows 2 to 60 hold, and for a sheet name that marks it. The cells are read twice, for heads and for texts, whatever the number of roles.
    """
    sheets = sheets or read_sheets(table)
    heads, found, chosen = sheets.heads, sheets.found, sheets.chosen
    wanted = [r for r in ROLES if r.signals]
    column = found.filter((F.col("layout") == "statement") & F.col("header").isin(*{r.signal_column for r in wanted})).select("file", "sheet_index", "col").distinct()
    of_role = chosen.filter(F.col("kind").isin(*(r.kind for r in wanted))).select("file", "kind", "sheet_index")
    texts = table.filter(F.col("row").between(2, 60)).join(column, ["file", "sheet_index", "col"]).select("file", "sheet_index", "value").distinct().withColumn("shown", text.normalize_text(F.col("value")))
    each = [F.max(F.when(F.col("kind") == r.kind, F.col("shown").contains(s).cast("int"))) for r in wanted for s in r.signals]
    hits = texts.join(of_role, ["file", "sheet_index"]).groupBy("file", "kind").agg(reduce(lambda x, y: x + y, [F.coalesce(e, F.lit(0)) for e in each]).alias("signals"))
    weight = reduce(lambda rest, r: F.when(F.col("kind") == r.kind, r.header_weight).otherwise(rest), ROLES, F.lit(0.0))
    score = F.col("hits") * weight + F.when(F.col("named"), bonus).otherwise(0.0) + F.coalesce("signals", F.lit(0)) * signal_weight
    tabular = chosen.join(hits, ["file", "kind"], "left").select("file", "kind", score.alias("score"))
    return workbooks.control_scores(heads, CONTROL_KIND, CONTROL_SHEETS).unionByName(tabular)


def classify(table: DataFrame, sheets: Sheets | None = None) -> DataFrame:
    """The decision on every file, with the signature of its kind (null if rejected)."""
    return signed(workbooks.classify(scores(table, sheets)))


def signed(found: DataFrame, signatures: dict[str, str] = {r.kind: r.signature for r in ROLES} | {CONTROL_KIND: CONTROL_SIGNATURE}) -> DataFrame:
    """A classification with the signature of each kind."""
    out = F.lit(None).cast("string")
    for kind, signature in signatures.items():
        out = F.when(F.col("kind") == kind, signature).otherwise(out)
    return found.withColumn("signature", out)
