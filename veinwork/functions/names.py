"""Names of people: cleaning, checking, choosing between them, and finding them in files, headers and texts."""

from __future__ import annotations

import re
import unicodedata

#: Words around a name in file names and subjects, which aren't part of it.
WRAPPING = "cv curriculum curriculo currículum curiculum curriculun curriculm corriculun corriculum vitae resume candidato postulante pdf doc docx rtf txt extracted extracto imprimir compressed comprimido actual actualizado actualizada final nuevo nueva version versión".split()
#: What may stand before a name, and after one.
LEADING = "aux auxiliar enfermeria enfermería reponedor vendedor vendedora picker pickers administrativo administrativa operario operaria audiovisual lic licenciado licenciada sr sra dr dra uy gallito".split()
TRAILING = "chofer cadete imprimir foto photo imagen image y venta ventas marketing logistica logística gastronomia gastronomía administracion administración".split()
#: Labels of other personal data, which end a name.
FIELDS = "fecha de nacimiento|nacimiento|domicilio|direccion|dirección|address|cedula|cédula|documento|telefono|teléfono|celular|email|correo|uruguay"
#: Particles that stay in lower case.
SMALL_WORDS = frozenset("de del la las los y da do dos".split())
#: Words that no name holds, and words that name work: a name of nothing but these is none.
NOISE = re.compile(r"\b(?:sin titulo|sin nombre|preparacion|entrega|ordenes|experiencia|responsable|tareas|funciones|perfil|objetivo|curriculum|postulacion|vacantes|sitio|website|site|nombres?|apellidos?|datos|contacto|solicitud|busqueda)\b")
WORK = frozenset("administrativo administrativa auxiliar ayudante chofer conductor contable deposito encargado encargada fabrica general laboral operario operaria operador operadora practico practica profesional repositor repositora tecnico tecnica vendedor vendedora".split())
_WORD = re.compile(r"[^\W\d_][^\W\d_'’-]*\.?")


class _Marks(dict):
    """For ``str.translate``: combining characters go. Filled as characters come, so each is looked at once."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.combining(chr(c)) else c
        return self[c]


_MARKS = _Marks()


def plain(text: str | None) -> str:
    low = (text or "").lower()
    return low if low.isascii() else unicodedata.normalize("NFD", low).translate(_MARKS)


def squeezed(text: str | None) -> str:
    return " ".join((text or "").split())


def looks_real(name: str | None) -> bool:
    """Two to six words of letters that are no noise, place or kind of work."""
    words = squeezed(name).split()
    if not 2 <= len(words) <= 6 or len(" ".join(words)) > 80 or not all(_WORD.fullmatch(w) for w in words):
        return False
    low = plain(" ".join(words))
    return not NOISE.search(low) and not all(w in WORK for w in low.split())


_REPLY, _ENDING = re.compile(r"(?i)^(?:(?:re|fwd?)\s*:\s*|copia\s+de\s+)+"), re.compile(r"(?i)\.[a-z0-9]{2,6}$")
_KIND, _SIGNS = re.compile(r"(?i)\b(?:p ?d ?f|c ?\.? ?v)\b"), re.compile(r"[_\-().!¡?¿|,]+")
_VERSION, _FIELDS = re.compile(r"(?i)v\d+|(?:19|20)\d{2}|\d{1,5}"), re.compile(rf"(?i)\b(?:{FIELDS})\b")
_INITIAL = re.compile(r"[A-ZÁÉÍÓÚÜÑ]")
_WRAPPING, _LEADING, _TRAILING = map(frozenset, (WRAPPING, LEADING, TRAILING))


def clean_name(text: str | None) -> str:
    """A name without what file names, subjects and forms put around it."""
    s = unicodedata.normalize("NFC", squeezed(text))
    s = _ENDING.sub("", _REPLY.sub("", s))
    # Words are taken one at a time, so a rule can't hide what the next one looks for.
    words = _SIGNS.sub(" ", _KIND.sub(" ", s)).split()
    words = [w for w in words if w.lower() not in _WRAPPING and not _VERSION.fullmatch(w)]
    while words and (words[0].lower() in _LEADING or (len(words) > 2 and words[0] == "de")):
        words.pop(0)
    while words and (words[-1].lower() in _TRAILING):
        words.pop()
    s = _FIELDS.split(" ".join(words), maxsplit=1)[0].split()
    if len(s) >= 4 and _INITIAL.fullmatch(s[-1]):
        s.pop()
    return " ".join(s)


def name_case(name: str | None) -> str:
    """Capitals for a name that has none; particles stay small unless they come first."""
    s = squeezed(name)
    if any(c.isupper() for c in s):
        return s
    return " ".join(w if k and w in SMALL_WORDS else w[:1].upper() + w[1:] for k, w in enumerate(s.split()))


def normal(name: str | None) -> str:
    return squeezed(re.sub(r"[^a-z\s'-]", " ", plain(name)))


def canonical_name(stored: str | None, incoming: str | None) -> str:
    """Of two forms of one name the more complete; a different name never replaces the stored one."""
    stored, incoming = squeezed(stored), squeezed(incoming)
    if not stored or not incoming:
        return stored or incoming
    a, b = set(normal(stored).split()), set(normal(incoming).split())
    if not (a <= b or b <= a):
        return stored
    weight = lambda x: 10 * len(normal(x).split()) + min(20, len(x) / 4)
    return incoming if weight(incoming) > weight(stored) else stored


def once(name: str) -> str:
    """A name that is written twice in a row, once."""
    words = name.split()
    half = len(words) // 2
    return " ".join(words[:half]) if len(words) >= 4 and len(words) % 2 == 0 and normal(" ".join(words[:half])) == normal(" ".join(words[half:])) else name


_LABEL = re.compile(r"(?i)(?:nombre(?: completo)?|name|candidato|postulante)(?:\s*[:\-]\s*|\s+)(.+)")
_HEADING = re.compile(r"(?:curriculum(?: vitae)?|resume|perfil(?: profesional)?|datos personales|informacion personal|contacto|experiencia(?: laboral| profesional)?|formacion|educacion|estudios|habilidades|competencias|idiomas|referencias)\s*:?")
_FIELD = re.compile(r"(?:nombre|name|candidato|postulante|fecha de nacimiento|nacimiento|domicilio|direccion|address|cedula|documento|telefono|celular|email|correo|nacionalidad|estado civil)\s*[:\-]")
#: Lines at the top of a text that may name its person: in all, with a label, as a heading; and headings of full weight.
TOP, LABELLED, HEADINGS, FIRST = 35, 20, 15, 5


def name_evidence(text: str | None) -> tuple[str, str, int] | None:
    """(name, kind, confidence) of a labelled line near the top of a text, else of a line that is a name."""
    lines = [x for x in (squeezed(p) for p in re.split(r"[\r\n]+|\s*[|•]\s*", text or "")) if x][:TOP]
    for line in lines[:LABELLED]:
        if m := _LABEL.fullmatch(line):
            name = once(clean_name(m[1]))
            if looks_real(name):
                return name, "label", 100
    for k, line in enumerate(lines[:HEADINGS]):
        low = plain(line)
        if _HEADING.fullmatch(low) or _FIELD.match(low) or re.search(r"@|https?:|www\.|\+?\d{5,}", low) or line[-1] in ".!?;" or len(line) > 90:
            continue
        name = once(clean_name(line))
        if looks_real(name):
            return name, "heading", 95 if k < FIRST else 90
    return None


def supports(name: str | None, emails: list[str] | None) -> bool:
    """Whether a word of the name stands in an address's local part."""
    words = [w for w in normal(name).split() if len(w) >= 3 and w not in ("del", "las", "los")]
    return any(w in plain(e.partition("@")[0]) for e in emails or () for w in words)


def replaced_name(stored: str | None, text: str | None, emails: list[str] | None) -> str | None:
    """The name after looking at a document: evidence replaces one that is none, completes one, or wins if addresses support it alone."""
    found = name_evidence(text)
    if not found:
        return stored
    if not looks_real(stored):
        return found[0]
    best = canonical_name(stored, found[0])
    return found[0] if best == squeezed(stored) and supports(found[0], emails) and not supports(stored, emails) else best


def emails_by_name(name: str | None, emails: list[str] | None, sender: str | None = None) -> list[str]:
    """At most two addresses that fit the name (one point a word) or the sender (ten); if none does, the first."""
    words = [w for w in normal(name).split() if len(w) >= 3]
    score = lambda e: 10 * (bool(sender) and e.lower() == sender.lower()) + sum(w in plain(e.partition("@")[0]) for w in words)
    fitting = sorted((e for e in emails or () if score(e)), key=lambda e: -score(e))
    return fitting[:2] or list(emails or ())[:1]


#: Local parts and providers that are no person's.
OFFICE = frozenset("info rrhh recursos seleccion selección admin contacto noreply no-reply notification notifications support security billing".split())
OFFICE_PARTS = re.compile(r"seleccion|selección|rrhh|recursos|talento|talent|recruit")
PROVIDERS = re.compile(r"google|microsoft|linkedin")


def internal_address(address: str | None, own_domains: list[str] | None = None) -> bool:
    """Whether an address is an office's, the own house's, or a system's."""
    local, _, domain = squeezed(address).lower().partition("@")
    return local in OFFICE or bool(OFFICE_PARTS.search(local)) or domain in (own_domains or ()) or bool(PROVIDERS.search(domain))


def name_from_address(address: str | None) -> str:
    """The name that an address spells, if it is one."""
    if internal_address(address):
        return ""
    name = " ".join(w[:1].upper() + w[1:] for w in re.sub(r"[\d._+-]+", " ", squeezed(address).partition("@")[0]).split())
    return name if looks_real(name) else ""


def name_from_header(header: str | None) -> str:
    """The name in a sender's header: the display name, else the address's."""
    address = re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", header or "")
    if re.search(r"no-?reply|notification|support|security|billing|google|microsoft|linkedin", (header or "").lower()) or internal_address(address and address[0]):
        return ""
    shown = clean_name(re.sub(r"<[^>]*>|[\"']", " ", header or ""))
    return shown if looks_real(shown) else name_from_address(address and address[0])


def name_from_file(file_name: str | None) -> str:
    """The name in a file's name; one capitalised word will do, and so will the first two of many."""
    name = name_case(clean_name(file_name))
    words = name.split()
    if looks_real(name) or (len(words) == 1 and len(name) > 2 and name[0].isupper() and name.isalpha()):
        return name
    return " ".join(words[:2]) if len(words) > 2 and looks_real(" ".join(words[:2])) else ""


def clean_file_name(name: str | None) -> str | None:
    """A file's name with its extension mended, once, without marks of compression."""
    s = unicodedata.normalize("NFC", squeezed(name))
    for broken, mended in ((r"p\s*d\s*f", "pdf"), (r"d\s*o\s*c\s*x", "docx"), (r"d\s*o\s*c", "doc")):
        s = re.sub(rf"(?i)\b{broken}\b", mended, s)
    s = re.sub(r"(?i)[_ -]*compressed\b", "", s)
    s = re.sub(r"(?i)(\.(?:pdf|docx?|rtf|txt))(?:\1)+$", r"\1", s)
    s = re.sub(r"(?i)[_ -]+(\.(?:pdf|docx?|rtf|txt))$", r"\1", s)
    return squeezed(s).replace(" .", ".") or None


#: Labels that name a system or a file, and phrases of subjects and offers.
SYSTEM_LABELS = frozenset("postgres postgresql database supabase render gmail google cv curriculum currículo currículum curriculo vitae pdf doc docx rtf txt".split())
OFFER = re.compile(r"\b(?:postulacion(?: laboral)?|entrega de cv|adjunto (?:cv|curriculum)|futuras (?:oportunidades|vacantes)|solicitud (?:de empleo|laboral)|trabajo/empleo|datos personales|nombre completo|tareas realizadas|buscamos|se busca|ofrecemos)\b|\bref(?:erencia)?:")


def compact_label(value: str | None, fallback: str = "") -> str:
    """A label worth showing: short, and no system's, subject's or offer's."""
    s = squeezed(value)
    low = plain(s)
    bad = not s or len(s) > 70 or s.lower() in SYSTEM_LABELS or OFFER.search(low) or re.match(r"para\s|(?:cargo|puesto)\s*:", low)
    return fallback if bad else s


def safe_tags(source: str | None, labels: list[str] | None) -> list[str]:
    """The source, then the labels worth showing, each once, at most 14."""
    return list(dict.fromkeys(x for x in (source, *(compact_label(v) for v in labels or ())) if x))[:14]


def display_name(name: str | None) -> str:
    """A name to show: split where a capital follows a small letter, joined where scanning tore it after an ñ; no paragraphs."""
    s = squeezed(name)
    if len(s) > 120:
        return "Sin nombre"
    s = re.sub(r"([ñÑ][a-z]{1,3}) ([a-z]{1,3})\b", r"\1\2", s)
    return squeezed(re.sub(r"(?<=[a-záéíóúüñ])(?=[A-ZÁÉÍÓÚÜÑ])", " ", s))


def display_place(place: str | None, known: list[str]) -> str | None:
    """A place to show: a known one that the text names, else a short text; no addresses or contacts."""
    s = squeezed(place)
    low = plain(s)
    found = [k for k in known if re.search(rf"\b{re.escape(plain(k))}\b", low)]
    if found:
        return max(found, key=len)
    if not s or re.search(r"@|\d{3,}|https?:|\b(?:calle|avenida|av|ruta|apto|telefono|celular|email)\b", low) or len(s.split()) > 5:
        return None
    return s


def download_name(name: str | None) -> tuple[str, str]:
    """(ASCII form, percent-encoded form) of a file's name for a download header."""
    from urllib.parse import quote

    s = re.sub(r'[\x00-\x1f\x7f<>:"/\\|?*]+', "_", unicodedata.normalize("NFC", squeezed(name))) or "document"
    ascii_form = "".join(c for c in unicodedata.normalize("NFD", s) if c.isascii()).replace('"', "") or "document"
    return ascii_form, quote(s, safe="")


def readable_summary(summary: str | None, text: str | None) -> str | None:
    """The summary, or the first four sentences of the text that say something."""
    s = squeezed(summary)
    if s and not re.search(r"^(?:sin resumen|pendiente|no disponible)", plain(s)):
        return s
    found = [x for x in (squeezed(p) for p in re.split(r"(?<=[.!?])\s+|\n+", text or "")) if len(x) > 25 and "@" not in x]
    return " ".join(found[:4]) or None


#: Characters of a text in which its person's own numbers stand.
FRONT = 12_000
_PHONE = re.compile(r"(?<![\d@.])\+?(?:\d(?:[ -]?[()]?[ -]?|\.)){6,14}\d(?!\d)")


def phones_in(text: str | None) -> list[str]:
    """At most three numbers, digits and plus sign alone, from before the references."""
    own = re.split(r"(?i)\breferencias?\b", text or "", maxsplit=1)[0][:FRONT]
    found = (re.sub(r"[^\d+]", "", m[0]) for m in _PHONE.finditer(own))
    return list(dict.fromkeys(p for p in found if 7 <= len(p.lstrip("+")) <= 15 and len(set(p.lstrip("+"))) > 1))[:3]


_TAG, _SCRIPT = re.compile(r"<[^>]*>"), re.compile(r"(?is)<(script|style)\b.*?</\1\s*>")
_LINK = re.compile(r"(?is)<a\b[^>]*?href=[\"']?([^\"' >]+)[^>]*>(.*?)</a>")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ROW = re.compile(r"(?is)<tr\b[^>]*>\s*<td\b[^>]*>(.*?)</td>")


def people_in(markup: str | None) -> list[tuple[str, str | None]]:
    """(name, address or link) of people in HTML: links whose text is a name, names beside an address, rows that begin with one; each once."""
    from html import unescape

    out: dict[str, tuple[str, str | None]] = {}
    seen: dict[str, tuple[bool, str]] = {}  # of a page's parts: a name stands beside its address, and begins its row

    def name_in(part: str) -> tuple[bool, str]:
        """Whether a part is a name, and the name with capitals ('' if it is none then)."""
        if part not in seen:
            cleaned = clean_name(part)
            real, name = looks_real(cleaned), name_case(cleaned)
            seen[part] = real, name if (real if name == cleaned else looks_real(name)) else ""
        return seen[part]

    def add(shown: str, key: str | None) -> None:
        if name := name_in(unescape(_TAG.sub(" ", shown)))[1]:
            known = normal(name)
            if known not in out or out[known][1] is None:
                out[known] = (name, key)

    page = _SCRIPT.sub(" ", markup or "")
    for link, shown in _LINK.findall(page):
        add(shown, link.removeprefix("mailto:"))
    for m in _ADDRESS.finditer(page):
        around = _TAG.sub("\n", page[max(0, m.start() - 200) : m.start()])
        for part in reversed([p.strip(" :,;-\t") for p in around.split("\n") if p.strip()]):
            if name_in(part)[0]:
                add(part, m[0].lower())
                break
    for first in _ROW.findall(page):
        add(first, None)
    return list(out.values())
