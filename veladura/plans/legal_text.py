"""Legal-style text derived from orders and customers, by one expression that Spark and DuckDB both read.

The test tables hold almost none of the identifiers that the detectors look for, so that every query about
them reads this view: doc_id, client and text, one document an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import dealt, table


def _pad(expr: str, n: int) -> str:
    return f"lpad(cast({expr} AS STRING), {n}, '0')"


def _when(test: str, text: str, other: str = "''") -> str:
    return f"CASE WHEN {test} THEN {text} ELSE {other} END"


K, C = "o_orderkey", "o_custkey"
NL = "chr(10)"
PARTS = (
    f"'Expediente N° ' || {_pad(K, 5)} || '-2024-0-1801-JR-CI-01. '",
    f"'El demandante Juan Perez Soto identificado con DNI N° ' || {_pad(C, 8)} || ', con RUC 20' || {_pad(C, 9)}",
    f"', correo electronico: user' || cast({C} AS STRING) || '@mail' || cast({C} % 10 AS STRING) || '.gob.pe, celular 9' || {_pad(K, 8)} || '. '",
    _when(f"{K} % 2 = 0", f"'Casilla electronica N° ' || cast({K} AS STRING) || '. Acta de conciliacion N° ' || cast(100 + {K} % 900 AS STRING) || '-2023. '"),
    _when(f"{K} % 3 = 0", f"'Cuenta de ahorros N° 191' || {_pad(K, 11)} || '. CCI: 002' || {_pad(K, 17)} || '. '"),
    _when(f"{K} % 3 = 1", "'1° Juzgado de Familia de Lima. Tercera Sala Civil de Lima Norte. Tribunal Constitucional del Peru. '"),
    _when(f"{K} % 4 = 0", f"'Partida electronica N° 1' || {_pad(K, 7)} || '. Resolucion directoral N° ' || cast(10 + {K} % 90 AS STRING) || '-2024. CAL N° ' || cast(10000 + {K} % 90000 AS STRING) || '. '"),
    _when(f"{K} % 5 = 0", f"'HC-' || {_pad(K, 6)} || '. CLI-' || {_pad(K, 5)} || '. LIC-A' || {_pad(K, 5)} || '. POL-' || {_pad(K, 6)} || '. '"),
    _when(f"{K} % 6 = 0", f"'El vehiculo de placa ABC-' || {_pad(f'{K} % 1000', 3)} || ' fue retenido. '", _when(f"{K} % 6 = 1", f"'El bien XYZ-' || {_pad(f'{K} % 1000', 3)} || ' figura en el inventario de la sociedad anonima. '")),
    _when(f"{K} % 7 = 0", "'Se pago la suma de S/ 12345678 en la fecha. '", "'Queda anotado el numero 87654321 en el libro de la entidad. '"),
    _when(f"{K} % 8 = 0", f"{NL} || 'Firma: Maria Lopez' || {NL} || 'Sello: Notaria Paz' || {NL} || 'Huella digital: indice derecho' || {NL}"),
    _when(f"{K} % 11 = 0", f"'Oficio N° ' || cast(20 + {K} % 70 AS STRING) || '-2023 recibido. '"),
    f"'Domicilio real: Av. Arequipa ' || cast(100 + {K} % 900 AS STRING) || ', Lima; '",
    _when(f"{K} % 9 = 0", "'Consta el registro {{DNI_1}} ya aplicado. '"),
    _when(f"{K} % 4 = 1", "'Comparece el demandado Carlos Alberto Ruiz Diaz con el procurador publico Luis Torres Vega. '"),
    _when(f"{K} % 4 = 2", f"'Remitente: Ana Torres Ruiz' || {NL} || 'La menor de nombre Lucia Diaz Rojas, de apellidos Quispe Mamani. Demandante: Rosa Flores Diaz. Dr. Pedro Gomez Salas. '"),
    _when(f"{K} % 4 = 3", f"'EL ABOGADO PEDRO GOMEZ SALAS expuso.' || {NL} || 'JUAN CARLOS PEREZ' || {NL} || 'Abogado' || {NL} || 'ROSA MARIA DIAZ, CAL 4567. '"),
    _when(f"{K} % 10 = 0", f"'Reitera: DNI N° ' || {_pad(C, 8)} || ' y user' || cast({C} AS STRING) || '@mail' || cast({C} % 10 AS STRING) || '.gob.pe. '"),
)
SQL = f"SELECT {K} AS doc_id, {C} AS client, {' || '.join(PARTS)} AS text FROM orders"


TEXT = " || ".join(PARTS)


def legal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "orders").selectExpr(f"{K} AS doc_id", f"{C} AS client", f"{TEXT} AS text")


def legal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`legal_text` with the keys that `TEXT` is made from in place of the text, for steps that deal rows before there are texts."""
    return table(spark, sf_dir, "orders").selectExpr(f"{K} AS doc_id", f"{C} AS client", K, C)


def legal_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`legal_text` with copies, the number of its rows with the same doc_id, counted over the orders' keys before there are texts."""
    parts = 4 * spark.sparkContext.defaultParallelism
    rows = table(spark, sf_dir, "orders").select(K, C).repartition(parts, K).withColumn("copies", F.count("*").over(Window.partitionBy(K)))
    return rows.selectExpr(f"{K} AS doc_id", f"{C} AS client", f"{TEXT} AS text", "copies")
