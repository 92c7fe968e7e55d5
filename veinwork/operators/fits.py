"""How well a candidate's work fits three special kinds of work, from the folded current role and all folded text.

The survey describes each kind of work by degrees: what somebody of that degree does, and where it has to be
written. The degrees' numbers and the words below are fixed values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degree from which a fit counts as an aligned role, and points that degrees add to the score. Fixed values.
ALIGNED = 4
POINTS = {
    "mechanic": {7: 28, 6: 24, 5: 19, 4: 13, 3: 6},
    "refrigeration": {6: 24, 5: 20, 4: 16, 3: 10},
    "warehouse": {},
}

# Words, as plain lists. Fixed values.
MECHANIC_JOBS = ["mecanico industrial", "mecanico de autoelevador", "mecanico de autoelevadores", "mecanico de montacargas", "tecnico mecanico", "electromecanico", "tecnico electromecanico", "tecnico de mantenimiento"]
MECHANIC_TRADES = ["mecanico industrial", "mecanica industrial", "mecanico de autoelevador", "mecanico de autoelevadores", "mecanico de montacargas", "tecnico mecanico", "tecnico electromecanico", "tecnico de mantenimiento mecanico", "electromecanico"]
ANY_MECHANIC = ["mecanico", "mecanica", "mantenimiento mecanico"]
LIFTS = ["autoelevador", "autoelevadores", "montacargas", "forklift", "forklifts", "apilador electrico", "equipo de movimiento de materiales", "equipos de movimiento de materiales"]
PLANTS = ["equipos industriales", "equipo industrial", "maquinaria industrial", "maquina industrial", "maquinas industriales", "mantenimiento industrial", "planta industrial"]
HYDRAULICS = ["hidraulica", "hidraulico", "sistema hidraulicos", "sistemas hidraulicos", "neumatica", "neumatico"]
ELECTRICITY = ["electricidad industrial", "falla electricas", "fallas electricas", "motores electricos", "motor electrico", "electromecanica"]
DIAGNOSIS = ["diagnostico de falla", "diagnostico de fallas", "deteccion de falla", "deteccion de fallas", "resolucion de falla", "resolucion de fallas"]
MACHINE_CARE = ["mantenimiento preventivo", "mantenimiento correctivo", "mantenimiento industrial", "mantenimiento mecanico", "reparacion de equipos", "reparacion de maquinas", "reparacion de maquinaria", "reparacion de autoelevador", "reparacion de autoelevadores"]

REFRIGERATION_JOBS = ["maquinista de refrigeracion", "tecnico en refrigeracion", "tecnico de refrigeracion", "tecnico frigorista", "frigorista", "refrigerista"]
MAINTENANCE_JOBS = ["tecnico de mantenimiento", "mantenimiento"]
COLD_MACHINES = ["refrigeracion industrial", "sistema de refrigeracion", "sistemas de refrigeracion", "maquina de frio", "maquinas de frio", "equipo de frio", "equipos de frio", "generacion de frio", "camara frigorificas", "camaras frigorificas", "camara frigorifica", "camaras frigorifica"]
COOLANTS = ["freon", "nh3", "amoniaco", "gas refrigerante", "gases refrigerantes"]
SYSTEM_CARE = ["mantenimiento industrial", "mantenimiento preventivo", "mantenimiento correctivo", "reparacion de equipos", "reparacion de maquinas", "reparacion de sistemas"]

WAREHOUSE_OFFICES = ["administrativo de deposito", "administrativa de deposito", "administrativo en deposito", "administrativa en deposito", "administrativo de logistica", "administrativa de logistica", "administrativo en logistica", "administrativa en logistica"]
CHECKING_JOBS = ["apuntador", "verificador", "controlador de deposito", "controlador de stock", "controlador de mercaderia", "controlador de carga", "controlador de cargas", *WAREHOUSE_OFFICES, "auxiliar de deposito"]
CHECKING_WORK = ["apuntador", "verificador", "control de carga", "control de cargas", "control de contenedor", "control de contenedores", "pesaje de mercaderia", "pesaje de carga", "pesaje de cargas", "pesaje de contenedor", "pesaje de contenedores"]
PAPER_WORK = ["control documental", "control de documentacion", "control de remitos", *WAREHOUSE_OFFICES]
MANUAL_JOBS = ["auxiliar", "operario", "operaria", "peon", "recepcionista", "expedicion", "despacho", "deposito", "almacen", "stock", "inventario", "carga", "descarga"]
LEADING_JOBS = ["director", "directora", "gerente", "jefe", "supervisor", "supervisora", "coordinador", "coordinadora", "ingeniero", "ingeniera"]


def names(text: Column, words: list[str]) -> Column:
    """One of the words stands in the folded text, whole; any white space may part them."""
    return text.rlike(r"\b(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words) + r")\b")


def _mechanic(role: Column, text: Column) -> Column:
    """Industrial mechanics: best are those who know lifting machines and one of their techniques."""
    trained = names(role, MECHANIC_JOBS) | names(text, MECHANIC_TRADES)
    mechanic = trained | names(role, ANY_MECHANIC)
    lifts, plants, care = names(text, LIFTS), names(text, PLANTS), names(text, MACHINE_CARE)
    power = names(text, HYDRAULICS) | names(text, ELECTRICITY)
    return (
        F.when(trained & lifts & (power | names(text, DIAGNOSIS)), 7)
        .when(care & ((lifts & (mechanic | power)) | (trained & plants)), 6)
        .when(trained & (plants | power), 5)
        .when(mechanic & (plants | lifts | names(text, HYDRAULICS)), 4)
        .when(mechanic & care, 3)
        .otherwise(0)
    )


def _refrigeration(role: Column, text: Column) -> Column:
    """Keepers of cold stores: a trade of that name and care of its machines, or the machines alone."""
    trained, cold, care = names(role, REFRIGERATION_JOBS), names(text, COLD_MACHINES), names(text, SYSTEM_CARE)
    maintains = care & (trained | (cold & names(role, MAINTENANCE_JOBS)))
    return F.when(maintains & trained & cold, 6).when(maintains, 5).when(cold & care, 4).when(cold | (care & names(text, COOLANTS)), 3).otherwise(0)


def _warehouse(role: Column, text: Column) -> Column:
    """Checking of goods; those who lead others rank below everybody."""
    by_work = F.when(names(text, CHECKING_WORK), 6).when(names(role, CHECKING_JOBS), 5)
    below = F.when(names(role, LEADING_JOBS), -1).when(names(text, PAPER_WORK), 4).when(names(role, MANUAL_JOBS), 2).otherwise(1)
    return F.coalesce(by_work, below)


KINDS = {"mechanic": _mechanic, "refrigeration": _refrigeration, "warehouse": _warehouse}


def domain_fit(domain: str | None, role: Column, text: Column) -> Column:
    """The degree to which a candidate's folded role and text fit a special kind of work; 0 for none."""
    return KINDS[domain](role, text) if domain in KINDS else F.lit(0)
