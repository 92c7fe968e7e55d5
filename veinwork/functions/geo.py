"""Places, distances and proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, alias, department, latitude, longitude, search radius in km (15 where none is given).
PLACES = (
    ("Ciudad de la Costa", None, "Canelones", -34.8167, -55.9500, 18),
    ("Barra de Carrasco", None, "Canelones", -34.8792, -56.0315, None),
    ("San Jose de Carrasco", "San José de Carrasco", "Canelones", -34.8445, -55.9990, None),
    ("Shangrila", "Shangri La", "Canelones", -34.8505, -55.9860, None),
    ("Lagomar", None, "Canelones", -34.8320, -55.9630, None),
    ("Solymar", None, "Canelones", -34.8070, -55.9220, None),
    ("Lomas de Solymar", None, "Canelones", -34.7955, -55.9030, None),
    ("Medanos de Solymar", "Médanos de Solymar", "Canelones", -34.7910, -55.8880, None),
    ("El Pinar", None, "Canelones", -34.7950, -55.8730, None),
    ("Pando", None, "Canelones", -34.7172, -55.9584, 15),
    ("Las Piedras", None, "Canelones", -34.7264, -56.2192, 15),
    ("Canelones", None, "Canelones", -34.5228, -56.2778, 20),
    ("Montevideo", None, "Montevideo", -34.9011, -56.1645, 18),
    ("Pocitos", None, "Montevideo", -34.9098, -56.1506, 5),
    ("Punta Carretas", None, "Montevideo", -34.9235, -56.1595, 5),
    ("Parque Batlle", None, "Montevideo", -34.8955, -56.1530, 5),
    ("Buceo", None, "Montevideo", -34.8977, -56.1294, 5),
    ("Malvin", "Malvín", "Montevideo", -34.8932, -56.1002, 5),
    ("Carrasco", None, "Montevideo", -34.8859, -56.0584, 10),
    ("Centro", None, "Montevideo", -34.9055, -56.1910, 5),
    ("Cordon", "Cordón", "Montevideo", -34.9002, -56.1782, 5),
    ("Ciudad Vieja", None, "Montevideo", -34.9061, -56.2053, 5),
    ("Tres Cruces", None, "Montevideo", -34.8936, -56.1662, 5),
    ("La Blanqueada", None, "Montevideo", -34.8864, -56.1540, 5),
    ("Union", "Unión", "Montevideo", -34.8798, -56.1350, 5),
    ("Prado", None, "Montevideo", -34.8585, -56.2070, 5),
    ("Aguada", None, "Montevideo", -34.8890, -56.1940, 5),
    ("Goes", None, "Montevideo", -34.8790, -56.1780, 5),
    ("Colon", "Colón", "Montevideo", -34.8015, -56.2235, 7),
    ("Penarol", "Peñarol", "Montevideo", -34.8270, -56.2010, 6),
    ("Manga", None, "Montevideo", -34.8075, -56.1135, 7),
    ("Cerro", None, "Montevideo", -34.8895, -56.2520, 6),
    ("La Teja", None, "Montevideo", -34.8635, -56.2310, 5),
    ("Paso Molino", None, "Montevideo", -34.8575, -56.2200, 5),
    ("Maldonado", None, "Maldonado", -34.9000, -54.9500, 20),
    ("Punta del Este", None, "Maldonado", -34.9620, -54.9500, 15),
    ("San Carlos", None, "Maldonado", -34.7912, -54.9182, 15),
    ("San Jose", "San José", "San Jose", -34.3375, -56.7136, 20),
    ("Colonia del Sacramento", "Colonia", "Colonia", -34.4626, -57.8398, 20),
    ("Salto", None, "Salto", -31.3833, -57.9667, 20),
    ("Paysandu", "Paysandú", "Paysandu", -32.3214, -58.0756, 20),
    ("Rivera", None, "Rivera", -30.9053, -55.5508, 20),
    ("Rocha", None, "Rocha", -34.4833, -54.3333, 20),
)
DEFAULT_RADIUS_KM = 15


def places(spark: SparkSession) -> DataFrame:
    """(place_id, name, alias, department, lat, lon, radius): a fixed table of a few dozen rows."""
    return spark.createDataFrame([(k, *p) for k, p in enumerate(PLACES)], "place_id int, name string, alias string, department string, lat double, lon double, radius int")


def km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    half = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 6371 * 2 * F.atan2(F.sqrt(half), F.sqrt(1 - half))


def nearby(spark: SparkSession) -> DataFrame:
    """(place_id, near_id, km, matches): all pairs of the fixed table."""
    a = places(spark)
    b = a.select(*[F.col(c).alias(f"near_{c}") for c in ("lat", "lon")], F.col("place_id").alias("near_id"))
    d = km(F.col("lat"), F.col("lon"), F.col("near_lat"), F.col("near_lon"))
    return a.crossJoin(F.broadcast(b)).select("place_id", "near_id", d.alias("km"), (d <= F.coalesce("radius", F.lit(DEFAULT_RADIUS_KM))).alias("matches"))


def sql_places() -> str:
    rows = ", ".join(f"({k}, '{n}', {'NULL' if a is None else chr(39) + a + chr(39)}, '{d}', {lat}, {lon}, {'NULL' if r is None else r})" for k, (n, a, d, lat, lon, r) in enumerate(PLACES))
    return f"places(place_id, name, alias, department, lat, lon, radius) AS (VALUES {rows})"


SQL_KM = "(6371 * 2 * atan2(sqrt(h), sqrt(1 - h)))"
SQL_HALF = "pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)"
