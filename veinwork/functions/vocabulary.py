"""Words by which roles, skills, languages and employers are told. All tables here are fixed values: results depend on them.

Forms are folded (lower case, no diacritics); ``@`` stands for o or a, ``(x)``
for x or nothing, and a trailing ``*`` for any ending.
"""

from __future__ import annotations

import re
from functools import cache

#: Roles that a text may show, in the order that breaks ties.
ROLE_FORMS = {
    "chofer de ambulancia": "chofer de ambulancia|conductor(a) de ambulancia|ambulancier@",
    "abogado": "abogad@|asesor(a) legal|derecho laboral|derecho corporativo|derecho civil|derecho penal|juridic@",
    "auxiliar administrativo": "auxiliar administrativ@|asistente administrativ@|back office",
    "auxiliar contable": "auxiliar contable|asistente contable",
    "guardia de seguridad": "guardia de seguridad|vigilante|vigilancia|seguridad fisica",
    "operario de produccion": "operari@ de produccion|operari@ de fabrica|operari@ de planta|operador(a) de maquinaria|operador(a) de produccion|auxiliar de produccion|linea de produccion",
    "auxiliar de deposito": "auxiliar de deposito|operari@ de deposito|peon de deposito|picking|packing|preparacion de pedidos",
    "operario": "operari@",
    "repositor": "repositor(a)|reponedor(a)|reposicion de mercaderia|reposicion de gondolas",
    "cajero": "cajer@|manejo de caja|arqueo de caja",
    "limpieza": "auxiliar de servicio|operari@ de limpieza|limpiador(a)|tareas de limpieza",
    "recepcionista": "recepcionista|recepcion y atencion",
    "call center": "call center|contact center|telemarketer|telemarketing|operador(a) telefonic@",
    "electricista": "electricista|electricidad industrial|instalaciones electricas",
    "mecanico": "mecanic@|mecanica automotriz|mantenimiento mecanico",
    "soldador": "soldador(a)|soldadura|mig|mag|tig",
    "construccion": "albanil|construccion|obra civil|ayudante de obra",
    "enfermeria": "enfermer@|auxiliar de enfermeria|licenciad@ en enfermeria",
    "cuidados": "cuidador(a)|acompanante terapeutic@|cuidado de adultos|cuidado de pacientes",
    "psicologia": "psicolog@|licenciad@ en psicologia",
    "farmacia": "auxiliar de farmacia|idoneo en farmacia|farmaceutic@",
    "ventas": "venta(s)|vendedor(a)|ejecutiv@ comercial|asesor(a) comercial",
    "gastronomia": "gastronomia|restaurante|moz@|cociner@|ayudante de cocina|barista",
    "administracion": "administracion|administrativ@",
    "atencion al cliente": "atencion al cliente|servicio al cliente|customer service",
    "logistica": "logistica|deposito|almacen|warehouse|inventario",
    "contabilidad": "contabilidad|contador(a)|auxiliar contable|liquidacion de sueldos",
    "recursos humanos": "recursos humanos|reclutamiento|seleccion de personal|gestion humana",
    "marketing": "marketing|community manager|redes sociales|publicidad",
    "tecnologia": "desarrollador(a)|programador(a)|software|soporte tecnico|testing|qa automation",
    "ingenieria": "ingenier@|ingenieria",
    "produccion": "produccion|operari@|manufactura",
    "mantenimiento": "mantenimiento|electromecanic@|electricista",
    "chofer": "chofer|conductor(a)|repartidor(a)|cadete|delivery",
    "salud": "enfermer@|auxiliar de enfermeria|medic@|cuidador(a)",
}
SKILL_FORMS = {
    "excel": "excel",
    "power bi": "power bi|powerbi",
    "sap": "sap",
    "sql": "sql",
    "caja": "manejo de caja|cajer@",
    "facturacion": "facturacion",
    "compras": "compras",
    "inventario": "inventario|control de stock",
    "autoelevador": "autoelevador|montacargas|forklift",
    "picking": "picking|preparacion de pedidos",
    "packing": "packing|embalaje|empaque",
    "libreta profesional": "libreta profesional|" + "|".join(f"{p} categoria {c}|{p} {c}" for p in ("libreta", "licencia", "libreta de conducir", "licencia de conducir") for c in "abcdefh"),
    "cobranzas": "cobranza|gestion de morosos|recuperacion de deuda",
    "conciliaciones": "conciliacion bancaria|conciliaciones",
    "liquidacion de sueldos": "liquidacion de sueldos|nomina|payroll|bops",
    "memory": "memory",
    "tango": "tango gestion|sistema tango",
    "odoo": "odoo",
    "nodum": "nodum",
    "genexus": "genexus",
    "salesforce": "salesforce",
    "crm": "crm",
    "erp": "erp",
    "office": "microsoft office|paquete office|word|outlook",
    "liderazgo": "liderazgo|supervision de equipo|jefatura",
    "negociacion": "negociacion",
}
LANGUAGE_FORMS = {"ingles": "ingles|english", "portugues": "portugues|portuguese", "frances": "frances|french", "italiano": "italiano"}
LEVEL_FORMS = "nativo|bilingue|avanzado|intermedio|basico|first certificate|proficiency|b1|b2|c1|c2"
#: Employers whose name shows a kind of work: other names, and the terms it stands for.
EMPLOYERS = {"Casa Tres": (("casa tres", "casa 3", "casatres"), ("telemarketer", "telemarketing", "call center", "contact center", "operador telefonico", "operadora telefonica", "ventas telefonicas"))}
SALES_FORMS = "venta(s)|vendedor(a)|comercial|operador(a)|atencion al cliente"
#: Streets and roads that show a place.
LANDMARKS = {"Montevideo": "camino maldonado|avenida 8 de octubre|av italia|av. italia|propios|general flores|jose belloni|ruta 8", "Ciudad de la Costa": "giannattasio|interbalnearia"}

#: Fields of study: what asks for one, and the forms that show it.
STUDIES = {
    "contador": ("contador(a)|contador(a) public@|contabilidad|ciencias contables", ("contador", "contadora", "contador publico", "contadora publica", "ciencias contables")),
    "administracion de empresas": ("administracion de empresas|licenciatura en administracion|gestion de empresas", ("administracion de empresas", "licenciatura en administracion", "gestion de empresas")),
    "economista": ("economista|licenciatura en economia|economia", ("economista", "licenciatura en economia")),
}
EDUCATION_FORMS = "estudiante|estudiando|cursando|carrera|formacion|universidad|facultad|egresad@|recibid@"


@cache
def compiled(forms: str) -> re.Pattern[str]:
    """A pattern of whole words for folded text."""
    parts = [re.escape(f).replace("@", "[oa]").replace(r"\*", r"\w*").replace(r"\ ", r"\s+") for f in forms.split("|")]
    return re.compile(r"\b(?:" + "|".join(re.sub(r"\\\((\w+)\\\)", r"(?:\1)?", p) for p in parts) + r")\b")


@cache
def _beginnings(forms: str) -> tuple[str, ...]:
    """What each form begins with, up to its first mark or blank: a text without any of them has no form."""
    return tuple(dict.fromkeys(re.split(r"[@*( ]", f, maxsplit=1)[0] for f in forms.split("|")))


def search(forms: str, text: str) -> re.Match[str] | None:
    """The first form in a folded text; plain strings are looked for before the pattern."""
    return compiled(forms).search(text) if any(b in text for b in _beginnings(forms)) else None


def places(text: str, table: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, number of the label, label) of each label of the table that a folded text shows, in the table's order."""
    return [(m.start(), k, label) for k, (label, forms) in enumerate(table.items()) if (m := search(forms, text))]


def shown(text: str, table: dict[str, str]) -> list[str]:
    """Labels of the table that a folded text shows, in the table's order."""
    return [label for _, _, label in places(text, table)]


def first_shown(text: str, table: dict[str, str]) -> str | None:
    """The label that comes first in the text; the table's order breaks ties."""
    return min(places(text, table), default=(0, 0, None))[2]


def employer_terms(text: str) -> list[str]:
    """Terms that employers named in a folded text stand for."""
    padded = " " + re.sub(r"[^a-z0-9]+", " ", text) + " "
    return [t for names, terms in EMPLOYERS.values() if any(f" {n} " in padded for n in names) for t in terms]
