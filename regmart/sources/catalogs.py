"""The dimensions that every report resolves against, as small DataFrames: entities, categories, accounts, currencies, metrics and their aliases.

All are fixed and of known size, far below any broadcast threshold; ``target`` is the id of an entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regmart.functions import text
from regmart.operators import resolve

# Id, code, name, short name of the entities.
ENTITIES = """
davivienda, 601, Seguros Davivienda, Davivienda
palic, 602, PALIC, PALIC
mapfre, 603, Mapfre Seguros, Mapfre
ficohsa, 604, Ficohsa Seguros, Ficohsa
continental, 606, Seguros Continental, Continental
atlantida, 608, Seguros Atlántida, Atlántida
crefisa, 609, Crefisa, Crefisa
equidad, 612, Seguros Equidad, Equidad
del-pais, 613, Seguros del País, Del País
lafise, 615, Seguros Lafise, Lafise
rural, 617, Aseguradora Rural, Rural
assa, 618, ASSA Cia. de Seguros, ASSA
"""

# Canonical names of entities that differ from the name in capitals.
CANONICAL = {"equidad": "SEGUROS EQUIDAD, S.A."}

# Aliases of the entities.
ENTITY_ALIASES = {
    "davivienda": ["SEGUROS DAVIVIENDA", "DAVIVIENDA"],
    "palic": ["PALIC"],
    "mapfre": ["MAPFRE SEGUROS"],
    "ficohsa": ["FICOHSA SEGUROS"],
    "continental": ["SEGUROS CONTINENTAL"],
    "atlantida": ["SEGUROS ATLANTIDA", "SEGUROS ATLÁNTIDA", "ATLANTIDA"],
    "crefisa": ["CREFISA"],
    "equidad": ["SEGUROS EQUIDAD, S.A.", "SEGUROS EQUIDAD", "EQUIDAD"],
    "del-pais": ["SEGUROS DEL PAIS", "SEGUROS DEL PAÍS", "SEGUROS DEL PAIS "],
    "lafise": ["SEGUROS LAFISE", "LAFISE"],
    "rural": ["ASRURAL HN", "ASEGURADORA RURAL", "BANRURAL"],
    "assa": ["ASSA", "ASSA CIA. DE SEGUROS"],
}

# Categories by parent in their order, with the sort number of the parent; a child's number follows.
CATEGORIES = {
    ("Accidentes y Enfermedades", 10): ["Accidentes Escolares", "Accidentes Personales", "Salud y Hospitalización"],
    ("Fianzas", 20): ["Fidelidad", "Garantía", "Otras Fianzas"],
    ("Otros Seguros Generales", 30): [
        "Agrícola", "Aviación", "Banqueros", "Calderas", "Casco Marítimo", "Dinero y Valores", "Equipo de Contratistas", "Equipo Electrónico", "Montaje", "Otros Ramos", "Responsabilidad Civil", "Riesgos Profesionales",
        "Robo y Hurto", "Rotura de Cristales", "Rotura de Maquinaria", "Transporte Aéreo", "Transporte Marítimo", "Transporte Terrestre", "Ganadero",
    ],
    ("Seguro de Vida", 50): ["Seguro de Sepelio", "Vida Colectivo", "Vida Individual"],
    ("Seguros Generales", 60): ["Incendio y Líneas Aliadas", "Vehículos Automotores"],
}

# Aliases of the categories.
CATEGORY_ALIASES = {
    "accidentes-y-enfermedades": ["ACCIDENTES Y ENFERMADADES", "ACCIDENTES Y ENFERMEDADES", "ACCIDENTES Y ENFERMADEDES"],
    "salud-y-hospitalizacion": ["SALUD Y HOSPITAL", "SALUD Y HOSPITALIZACION"],
    "otros-seguros-generales": ["OTROS SEGUROS GENERALES"],
    "incendio-y-lineas-aliadas": ["INCENDIO Y LINEA ALIADAS", "INCENDIO Y LÍNEA ALIADAS", "INCENDIO Y LINEAS ALIADAS"],
    "casco-maritimo": ["CASCO MARITÍMO"],
    "vehiculos-automotores": ["VEHICULOS AUTOMOTORES", "VEHÍCULOS AUTOMOTORES"],
    "otras-fianzas": ["OTRAS FINANZAS", "OTRAS FIANZAS"],
    "garantia": ["GARANTIA"],
    "aviacion": ["AVIACION"],
    "agricola": ["AGRICOLA"],
    "transporte-aereo": ["TRANSPORTE AEREO"],
    "transporte-maritimo": ["TRANSPORTE MARITIMO"],
    "ganadero": ["GANADERO", "OTROS SEGUROS GENERALES / GANADERO"],
    "seguro-de-vida": ["SEGURO DE VIDA"],
}

# Line number, id and name of the accounts, in their order.
ACCOUNTS = """
1; activos; ACTIVOS
2; disponibilidades; DISPONIBILIDADES
3; inversiones-financieras; INVERSIONES FINANCIERAS
4; prestamos; PRÉSTAMOS
5; primas-por-cobrar; PRIMAS POR COBRAR
6; deudas-reaseguradores; DEUDAS A CARGO DE REASEGURADORES Y REAFIANZADORES
7; activos-venta; ACTIVOS MANTENIDOS PARA LA VENTA Y GRUPO DE ACTIVOS PARA SU DISPOSICIÓN
8; propiedades-planta-equipo; PROPIEDADES, PLANTA Y EQUIPO
9; propiedades-inversion; PROPIEDADES DE INVERSIÓN
11; otros-activos; OTROS ACTIVOS
13; activos-contingentes; ACTIVOS CONTINGENTES
14; total-activos; TOTAL ACTIVOS
15; pasivos; PASIVOS
16; obligaciones-asegurados; OBLIGACIONES CON ASEGURADOS
17; reservas-siniestros; RESERVAS PARA SINIESTROS
18; obligaciones-intermediarios; OBLIGACIONES CON INTERMEDIARIOS
19; cuentas-por-pagar; CUENTAS POR PAGAR
20; obligaciones-financieras; OBLIGACIONES FINANCIERAS
21; obligaciones-reaseguradores; OBLIGACIONES CON REASEGURADORES Y REAFIANZADORES
22; reservas-tecnicas; RESERVAS TÉCNICAS Y MATEMÁTICAS
23; otros-pasivos; OTROS PASIVOS
24; creditos-diferidos; CRÉDITOS DIFERIDOS
25; pasivos-contingentes; PASIVOS CONTINGENTES
26; subtotal-pasivos-patrimonio; SUBTOTAL PASIVOS Y PATRIMONIO
27; patrimonio; PATRIMONIO
28; capital-social; CAPITAL SOCIAL
29; aportes-no-capitalizados; APORTES PATRIMONIALES NO CAPITALIZADOS
30; resultados-acumulados; RESULTADOS ACUMULADOS
31; resultado-neto; RESULTADO NETO DEL EJERCICIO
32; patrimonio-restringido; PATRIMONIO RESTRINGIDO NO DISTRIBUIBLE
33; total-pasivos-patrimonio; TOTAL PASIVOS Y PATRIMONIO
34; cuentas-orden; CUENTAS DE ORDEN Y REGISTRO
"""

# Aliases of the accounts, damaged ones included.
ACCOUNT_ALIASES = {
    "total-activos": ["TOTAL ACTIVOS", "ACTIVOS TOTALES"],
    "prestamos": ["PRESTAMOS", "PRÉSTAMOS", "PRÃ©STAMOS"],
    "activos-venta": ["ACTIVOS MANTENIDOS PARA LA VENTA Y GRUPO DE ACTIVOS PARA SU DISPOSICION", "ACTIVOS MANTENIDOS PARA LA VENTA Y GRUPO DE ACTIVOS PARA SU DISPOSICIÓN", "ACTIVOS MANTENIDOS PARA LA VENTA Y GRUPO DE ACTIVOS PARA SU DISPOSICIÃ“N"],
    "propiedades-inversion": ["PROPIEDADES DE INVERSION", "PROPIEDADES DE INVERSIÓN", "PROPIEDADES DE INVERSIÃ“N"],
    "reservas-tecnicas": ["RESERVAS TECNICAS Y MATEMATICAS", "RESERVAS TÉCNICAS Y MATEMÁTICAS", "RESERVAS TÃ‰CNICAS Y MATEMÃÁTICAS"],
    "creditos-diferidos": ["CREDITOS DIFERIDOS", "CRÉDITOS DIFERIDOS", "CRÃ©DITOS DIFERIDOS"],
    "patrimonio-restringido": ["PATRIMONIO RESTRINGIDO NO DISTRIBUIBLE"],
    "cuentas-orden": ["CUENTAS DE ORDEN Y REGISTRO"],
}

# Currencies (id, code, name, kind) and metrics (id, name, domain, unit, policy).
CURRENCIES = [("hnl", "1", "Nacional", "national"), ("usd", "2", "Extranjera", "foreign"), ("mixed", "MIXED", "Combinada", "mixed")]
METRICS = [("total-premiums", "Primas Totales", "premiums", "currency", "official"), ("total-assets", "Activos Totales", "financialPosition", "currency", "official"), ("institutions-covered", "Instituciones Cubiertas", "dataset", "count", "derived")]


def _rows(block: str, separator: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(separator)] for line in block.strip().splitlines()]


def entities(spark: SparkSession) -> DataFrame:
    """target, code, canonical, name, short_name."""
    rows = [(i, code, CANONICAL.get(i, name.upper()), name, short) for i, code, name, short in _rows(ENTITIES, ",")]
    return spark.createDataFrame(rows, "target string, code string, canonical string, name string, short_name string")


def categories(spark: SparkSession) -> DataFrame:
    """target, canonical, name, parent (null for a parent), sort_order; ids are the slugs of the names."""
    rows = [(name, parent if place else None, order + place) for (parent, order), children in CATEGORIES.items() for place, name in enumerate([parent, *children])]
    named = spark.createDataFrame(rows, "name string, parent_name string, sort_order int")
    return named.select(text.slug_key(F.col("name")).alias("target"), F.upper("name").alias("canonical"), "name", text.slug_key(F.col("parent_name")).alias("parent"), "sort_order")


def accounts(spark: SparkSession) -> DataFrame:
    """target, line, canonical, sort_order."""
    rows = [(i, int(line), name, place) for place, (line, i, name) in enumerate(_rows(ACCOUNTS, ";"), 1)]
    return spark.createDataFrame(rows, "target string, line int, canonical string, sort_order int")


def currencies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CURRENCIES, "target string, code string, name string, kind string")


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "target string, name string, domain string, unit string, policy string")


def aliases(spark: SparkSession, known: dict[str, list[str]]) -> DataFrame:
    """alias, target."""
    return spark.createDataFrame([(alias, target) for target, names in known.items() for alias in names], "alias string, target string")


def resolve_entities(values: DataFrame) -> DataFrame:
    """strategy, target and candidates of every distinct ``values.raw`` among the entities."""
    spark = values.sparkSession
    return resolve.resolve(values, aliases(spark, ENTITY_ALIASES), entities(spark), text.normalize_entity_alias)


def resolve_categories(values: DataFrame) -> DataFrame:
    spark = values.sparkSession
    return resolve.resolve(values, aliases(spark, CATEGORY_ALIASES), categories(spark), text.normalize_alias)


def resolve_accounts(values: DataFrame) -> DataFrame:
    spark = values.sparkSession
    return resolve.resolve(values, aliases(spark, ACCOUNT_ALIASES), accounts(spark), text.normalize_alias)


def resolve_account_rows(rows: DataFrame) -> DataFrame:
    """The rows (raw, line) with strategy, target and candidates: by text, then by line number; what is still unresolved is ambiguous if its text occurs in several names or several names in it."""
    spark = rows.sparkSession
    catalog = accounts(spark)
    by_text = rows.join(resolve_accounts(rows), "raw", "left").withColumns({"strategy": F.coalesce("strategy", F.lit("unresolved")), "candidates": F.coalesce("candidates", F.array().cast("array<string>"))})
    found = resolve.with_line_fallback(by_text, catalog)
    near = resolve.containment_candidates(found.filter("strategy = 'unresolved'"), catalog, text.normalize_alias).withColumnRenamed("candidates", "near")
    open_ = F.col("strategy") == "unresolved"
    candidates = F.when(open_, F.coalesce("near", "candidates")).otherwise(F.col("candidates"))
    joined = found.join(near, "raw", "left").withColumn("candidates", candidates).drop("near")
    return joined.withColumn("strategy", F.when(open_, resolve.verdict(F.col("candidates"))).otherwise(F.col("strategy")))
