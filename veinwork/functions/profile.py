"""What a document says about its person: roles, skills, languages with levels, residence, highlights; and records made from it.

Plain functions of whole texts; ``veinwork.functions.perrow`` runs them over columns.
"""

from __future__ import annotations

import json
import re
from functools import cache, lru_cache

from veinwork.functions import names
from veinwork.functions import vocabulary as words
from veinwork.functions.geo import PLACES
from veinwork.functions.names import plain, squeezed

#: Characters before the first professional heading, and after a personal marker, in which a residence is looked for.
FRONT, AFTER = 2_400, 1_400
#: Characters around a language in which its level stands.
BEFORE_LEVEL, AFTER_LEVEL = 45, 75
MOST_TAGS = 18

_PERSONAL = re.compile(r"\b(?:datos personales|informacion personal|contacto|domicilio|direccion|ubicacion|localidad|barrio|departamento|lugar de residencia|residencia\s*:|radicad[oa] en|vive en)\b")
_PROFESSIONAL = re.compile(r"\b(?:experiencia (?:laboral|profesional)|trayectoria(?: laboral| profesional)?|antecedentes laborales|historial laboral|empleos?|educacion|formacion|estudios)\b")
_DECLARED = re.compile(r"\b(?:domicilio|direccion|ubicacion|localidad|barrio|lugar de residencia|residencia|radicad[oa] en|vive en)\s*[:\-]?\s*")
_OTHER_FIELD = re.compile(r"\b(?:telefono|celular|movil|e?mail|correo|fecha de nacimiento|edad|nacionalidad|documento|cedula|experiencia|educacion|formacion|estudios)\b")
_REFERENCES = re.compile(r"\breferencias (?:laborales|personales)\b")
_CONTACT = re.compile(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|(?:\+?598\s?)?(?:0?9\d|2\d|4\d)[\s.-]?\d{3}[\s.-]?\d{3,4}")


class _Folds(dict):
    """For ``str.translate``: the plain form of a character if it is one, else the character itself."""

    def __missing__(self, c: int) -> str:
        p = plain(chr(c))
        self[c] = p if len(p) == 1 else chr(c)
        return self[c]


_FOLDS = _Folds()
#: The same for the characters of Latin-1, as a table of bytes.
_LATIN = "".join(map(chr, range(256))).translate(_FOLDS).encode("latin-1")


def folded(text: str | None) -> str:
    """As ``plain``, one character for each of the text, so that offsets agree."""
    t = (text or "").replace("\x00", " ")
    if t.isascii():
        return t.lower()
    try:
        return t.encode("latin-1").translate(_LATIN).decode("latin-1")
    except UnicodeEncodeError:
        return t.translate(_FOLDS)


def readable(text: str | None) -> bool:
    t = squeezed(text)
    letters = sum(map(str.isalpha, t))
    return len(t) >= 80 and letters / len(t) >= 0.55 and len(re.findall(r"%PDF-|endobj|xref|/FlateDecode|/XObject", t)) < 5


def references_at(text: str) -> int:
    """The characters before a section of references; 0 if none comes after others."""
    m = _REFERENCES.search(folded(text))
    return m.start() if m else 0


def before_references(text: str) -> str:
    at = references_at(text)
    return text[:at] if at else text


# Residence


@cache
def _place_pattern() -> re.Pattern[str]:
    shown = sorted({plain(n) for p in PLACES for n in p[:2] if n}, key=lambda n: (-len(n), n))
    return re.compile(r"\b(?:" + "|".join(n.replace(" ", r"\s+") for n in shown) + r")\b")


@cache
def _place_names() -> dict[str, str]:
    return {plain(n): p[0] for p in reversed(PLACES) for n in p[:2] if n}


def first_place(text: str) -> str | None:
    """The known place that comes first in a folded text, the longer of two; not as part of a street's name."""
    streets = re.compile(r"\b(?:camino|calle|avenida|av|ruta|bulevar|boulevard)\s+" + _place_pattern().pattern)
    m = _place_pattern().search(streets.sub(" ", text))
    return _place_names()[re.sub(r"\s+", " ", m[0])] if m else None


def declared_place(text: str, original: str) -> str | None:
    """What follows a word like ``domicilio``: a known place, one that a street shows, or the last part if it reads like a name."""
    m = _DECLARED.search(text)
    if not m:
        return None
    end = _OTHER_FIELD.search(text, m.end())
    stop = min(end.start() if end else len(text), m.end() + 140)
    part, shown = text[m.end() : stop].strip(" ,.;:/|_-"), original[m.end() : stop].strip(" ,.;:/|_-")
    if not 3 <= len(part) <= 100 or "@" in part or not re.search(r"[a-z]{3}", part):
        return None
    if found := first_place(part) or words.first_shown(part, words.LANDMARKS):
        return found
    last = squeezed(shown.rpartition(",")[2])
    return last if re.fullmatch(r"[^\W\d_][^\W\d_' -]*(?: [^\W\d_' -]+)*", last) and 3 <= len(last) <= 40 and len(last.split()) <= 5 else None


def residence(text: str | None) -> str | None:
    """Where the person lives: what the front matter declares or names, else what follows a personal heading; never a job's place."""
    original = re.sub(r"\s+", " ", (text or "").replace("\x00", " ")).strip()
    low = folded(original)
    heading, marker = _PROFESSIONAL.search(low), _PERSONAL.search(low)
    end = min(heading.start() if heading else FRONT, FRONT)
    if marker or _CONTACT.search(low, 0, end):
        found = declared_place(low[:end], original[:end]) or first_place(low[:end]) or words.first_shown(low[:end], words.LANDMARKS)
        if found:
            return found
    if not marker:
        return None
    a, b = marker.start(), marker.start() + AFTER
    if stop := re.compile(r"\b(?:web\s*&\s*redes|conocimientos|experiencia laboral|trayectoria|estudios basicos|educacion|formacion)\b").search(low, marker.end() + 20, b):
        b = stop.start()
    return first_place(low[a:b]) or words.first_shown(low[a:b], words.LANDMARKS) or declared_place(low[a:b], original[a:b])


def effective_residence(cv: str | None, city: str | None, country: str | None) -> str | None:
    """The document's residence, unless it is just the department of a more precise known city."""
    given = squeezed(f"{city or ''} {country or ''}") or None
    if not cv:
        return given
    place = lambda name: next((p for p in PLACES if name and plain(name) in (plain(p[0]), plain(p[1]))), None)
    there, here = place(cv), place(first_place(plain(given)) if given else None)
    broader = there and here and there[2] == here[2] and plain(there[0]) == plain(there[2]) and plain(here[0]) != plain(there[0])
    return given if broader else cv


# Lines and sections

_EXPERIENCE = re.compile(r"experiencia|trayectoria|antecedentes laborales")
_EDUCATION = re.compile(r"educacion|formacion|estudios")
_AFTER_EXPERIENCE = re.compile(r"educacion|formacion|estudios|idiomas|habilidades")
_AFTER_EDUCATION = re.compile(r"experiencia|idiomas|habilidades|referencias")
_SKIPPED = re.compile(r"referencias?|contacto|telefono|celular")
_TELLING = re.compile(r"\b(?:19|20)\d{2}\b|actualidad|presente|empresa|cargo|puesto|tareas|responsable|auxiliar|analista|vendedor|administrativ|operari")
_WORKED = re.compile(r"experiencia|trabaj[eoa]|desempen|responsable|cargo|puesto|empresa")
_STUDIED = tuple(re.compile(p) for p in (r"\b(?:egresad[oa]|graduad[oa]|estudiante) (?:de|en) [^.;\n]{3,110}", r"\b(?:licenciatura|tecnicatura|bachillerato|posgrado|maestria|curso) (?:de|en) [^.;\n]{3,110}", r"\b(?:universidad|facultad|instituto) [^.;\n]{3,110}"))
SECTION_LINES, HIGHLIGHTS, FALLBACKS = 12, 4, 3


def shown_line(line: str) -> str:
    """A line without contacts and bullets, if it is between 18 and 240 characters and half letters; else nothing."""
    s = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+?\d[\d\s().-]{6,}\d|[•·|]+|\x00", " ", line)
    s = squeezed(s)
    bad = not 18 <= len(s) <= 240 or sum(map(str.isalpha, s)) < 0.5 * len(s) or re.search(r"(?i)^%PDF-|endobj|xref|/FlateDecode|/XObject|google docs renderer", s)
    return "" if bad else s


@lru_cache(maxsize=1)
def shown_lines(text: str) -> tuple[str, ...]:
    """Kept for the last text: each of its sections looks at them."""
    return tuple(s for s in map(shown_line, re.split(r"[\r\n]+", text)) if s)


def section(text: str, heading: re.Pattern, stop: re.Pattern) -> list[str]:
    """Telling lines after the first line with the heading, up to the next section."""
    lines = shown_lines(text)
    at = next((k for k, s in enumerate(lines) if heading.search(plain(s))), None)
    out: list[str] = []
    for s in lines[at + 1 : at + 1 + SECTION_LINES] if at is not None else ():
        low = plain(s)
        if stop.search(low):
            break
        if not _SKIPPED.search(low) and _TELLING.search(low):
            out.append(s)
        if len(out) == HIGHLIGHTS:
            break
    return list(dict.fromkeys(out))


def experience_highlights(text: str) -> list[str]:
    found = section(text, _EXPERIENCE, _AFTER_EXPERIENCE)
    if found:
        return found
    parts = (shown_line(s) for s in re.split(r"(?<=[.;])\s+|[\r\n]+", before_references(text)))
    return list(dict.fromkeys(s for s in parts if s and _WORKED.search(plain(s)) and not re.search(r"referencias?|contacto", plain(s))))[:FALLBACKS]


def education_highlights(text: str) -> list[str]:
    """The section's lines, else what names a degree or a school; a shorter statement inside a longer one doesn't count."""
    found = section(text, _EDUCATION, _AFTER_EDUCATION)
    if found:
        return found
    own = before_references(text)
    low = folded(own)
    parts = {s for p in _STUDIED for m in p.finditer(low) if (s := shown_line(own[m.start() : m.end()]))}
    out: list[str] = []
    for s in sorted(parts, key=lambda x: (-len(x), x)):
        if not any(plain(s) in plain(longer) for longer in out):
            out.append(s)
    return out[:FALLBACKS]


# The whole


def years(text: str) -> int | None:
    """The most years of experience that a text states, from 1 to 59."""
    low = folded(text)
    found = [int(m[1]) for p in (r"(?:mas de|cuento con|con)\s*(\d{1,2})\s*anos?\s*(?:de\s*)?(?:experiencia|trayectoria)", r"(?:experiencia|trayectoria)[^.;\n]{0,55}?(\d{1,2})\s*anos?") for m in re.finditer(p, low)]
    return max((n for n in found if 0 < n < 60), default=None)


def languages(text: str) -> list[tuple[str, str | None]]:
    """(language, level that stands near it), in the order of the table."""
    low = folded(text)
    out = []
    for label, forms in words.LANGUAGE_FORMS.items():
        if m := words.search(forms, low):
            level = words.compiled(words.LEVEL_FORMS).search(low[max(0, m.start() - BEFORE_LEVEL) : m.end() + AFTER_LEVEL])
            out.append((label, level[0] if level else None))
    return out


def analyse(text: str | None) -> dict | None:
    """Everything above at once; None for a text that can't be read."""
    if not readable(text):
        return None
    original = text.replace("\x00", " ").replace("\r", "\n")
    own = squeezed(before_references(squeezed(original)))
    low = folded(own)
    at = words.places(low, words.ROLE_FORMS)
    roles, primary = [label for _, _, label in at], min(at, default=(0, 0, None))[2]
    # A known employer and words of selling show telephone sales, whatever the text calls them.
    if words.employer_terms(low) and words.compiled(words.SALES_FORMS).search(low):
        roles += ["call center"] if "call center" not in roles else []
        primary = "call center" if primary in (None, "ventas") else primary
    skills, spoken, city, least = words.shown(low, words.SKILL_FORMS), languages(own), residence(own), years(own)
    work, school = experience_highlights(original), education_highlights(original)
    evidence = len(roles) + len(skills) + len(spoken) + (least is not None) + (city is not None) + len(work) + len(school)
    facts = [f"Areas: {', '.join(roles)}." if roles else "", f"Years: {least}." if least else "", f"Languages: {', '.join(f'{n} ({v})' if v else n for n, v in spoken)}." if spoken else "", f"Lives in {city}." if city else "", f"Studies: {school[0]}" if school else ""]
    return {"primary": primary, "roles": roles, "skills": skills, "languages": spoken, "years": least, "city": city, "experience": work, "education": school, "confidence": "high" if evidence >= 7 else "medium" if evidence >= 3 else "low", "summary": "\n".join(f for f in facts if f) or None}


def quality(emails: list, phones: list, text: bool, found: dict | None) -> int:
    f = found or {}
    return min(100, 20 + 15 * bool(emails) + 15 * bool(phones) + 15 * text + 15 * bool(f.get("roles")) + 10 * bool(f.get("experience")) + 5 * bool(f.get("education")) + 5 * bool(f.get("languages")))


# Records

_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def emails_in(text: str | None) -> list[str]:
    return list(dict.fromkeys(m.lower() for m in _ADDRESS.findall(text or "")))


def human(value: str | None) -> str | None:
    """A value with a letter in it."""
    s = squeezed(value)
    return s if any(c.isalpha() for c in s) else None


def enriched(record: dict, text: str | None) -> dict:
    """A record with what its document says: the document's values win where it has any."""
    found = analyse(text)
    if not found:
        return record
    emails = list(dict.fromkeys([*emails_in(before_references(text)), *record.get("email", ())]))
    phones = list(dict.fromkeys([*names.phones_in(text), *record.get("phone", ())]))
    tags = [t for t in record.get("tags", ()) if human(t)] + found["roles"] + found["skills"] + [n for n, _ in found["languages"]]
    return record | {
        "email": emails,
        "phone": phones,
        "current_role": found["primary"] or human(record.get("current_role")),
        "city": found["city"] or human(record.get("city")),
        "country": ("Uruguay" if found["city"] else None) or human(record.get("country")),
        "years": found["years"] if found["years"] is not None else record.get("years"),
        "languages": found["languages"] or record.get("languages", []),
        "tags": list(dict.fromkeys(tags))[:MOST_TAGS],
        "summary": found["summary"] or record.get("summary"),
        "quality_score": quality(emails, phones, True, found),
    }


def from_text(text: str | None, source: str, file_name: str | None = None, sender: str | None = None) -> dict | None:
    """A record out of a free text, its file's name and its sender; None if nobody can be told.

    Names are taken from the document first, then from the file, the sender, and an address, with falling confidence.
    """
    content = (text or "").strip() or squeezed(file_name)
    if len(content) < 8:
        return None
    inbox = [e for e in dict.fromkeys([*emails_in(before_references(content)), *emails_in(sender)]) if not names.internal_address(e)]
    evidence = names.name_evidence(content)
    if not evidence:
        for found, kind, sure in ((names.name_from_file(file_name), "file", 65), (names.name_from_header(sender), "sender", 60), (names.name_from_address(inbox[0] if inbox else None), "email", 45)):
            if found:
                evidence = (found, kind, sure)
                break
    name, kind, sure = evidence or ("", None, None)
    if kind == "heading" and not names.supports(name, inbox):
        sure = 85
    own_sender = next((e for e in emails_in(sender) if not names.internal_address(e)), None)
    email, phone = names.emails_by_name(name, inbox, own_sender), names.phones_in(content)[:2]
    full_name = name or (email or phone or [None])[0]
    if not full_name or (source in ("mail", "drive") and not names.looks_real(name)):
        return None
    found = analyse(content)
    role = names.compact_label((found or {}).get("primary"), "imported")
    tags = names.safe_tags(source, [role, *(found or {}).get("roles", ()), *(found or {}).get("skills", ()), *(n for n, _ in (found or {}).get("languages", ()))])
    return {"full_name": full_name, "name_source": kind, "name_confidence": sure, "email": email, "phone": phone, "city": (found or {}).get("city"), "current_role": role, "years": (found or {}).get("years"), "tags": tags, "quality_score": quality(email, phone, bool(found), found)}


#: Keys under which sources give a field, at any depth: fixed values.
ALIASES = {
    "full_name": ("fullName", "full_name", "nombreCompleto", "name"),
    "first_name": ("firstName", "first_name", "nombre", "PrimerNombre"),
    "last_name": ("lastName", "last_name", "apellido", "apellidos", "PrimerApellido"),
    "email": ("email", "mail", "correo", "emails"),
    "phone": ("phone", "telefono", "celular", "mobile", "phones"),
    "city": ("city", "ciudad", "localidad"),
    "current_role": ("position", "cargo", "currentRole", "puesto", "CargoVacante"),
    "source_id": ("user_id", "userId", "IdPostulacion", "id"),
    "document_url": ("CVUrl", "cvUrl", "talent_cv", "url"),
}


def from_json(text: str | None) -> dict | None:
    """A record out of a source's object, by the known names of each field wherever they stand."""
    from veinwork.sources.readers import deep_fields

    try:
        parsed = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(parsed, dict):
        return None
    found = deep_fields(parsed, ALIASES)
    first = {k: next(iter(v), None) for k, v in found.items()}
    full = first["full_name"] if not first["first_name"] else squeezed(f"{first['first_name']} {first['last_name'] or ''}")
    if not full and not found["email"] and not found["phone"]:
        return None
    return {"full_name": full, "email": [e.lower() for e in found["email"] if _ADDRESS.fullmatch(e)], "phone": [re.sub(r"[^\d+]", "", p) for p in found["phone"]], **{k: first[k] for k in ("city", "current_role", "source_id", "document_url")}}


#: Sources that come without a person looking at them.
MAIL_SOURCES, FEEDS = frozenset({"mail", "drive"}), frozenset({"board", "partner", "talent"})


def usable(name: str | None, contact: bool, document: bool, offer: bool, source: str) -> bool:
    """Whether a record may be stored: automatic sources need a document, mail a name or a contact, boards a name, others a contact or a name that isn't an offer's."""
    real = names.looks_real(name)
    if source in MAIL_SOURCES | FEEDS and not document:
        return False
    if source in MAIL_SOURCES:
        return real or contact
    if source == "board":
        return real
    return contact or (real and not offer)


def sanitised(record: dict) -> dict:
    """A record with every field cleaned: name, contacts, labels; values without a letter go."""
    phones = [re.sub(r"[^\d+]", "", p) for p in record.get("phone") or ()]
    return {
        "full_name": names.name_case(names.clean_name(record.get("full_name"))),
        "email": list(dict.fromkeys(e.strip().lower() for e in record.get("email") or () if len(e) <= 254 and _ADDRESS.fullmatch(e.strip()))),
        "phone": list(dict.fromkeys(p for p in phones if 7 <= len(p.lstrip("+")) <= 15 and len(set(p.lstrip("+"))) > 1)),
        "city": human(record.get("city")),
        "country": human(record.get("country")),
        "current_role": names.compact_label(human(record.get("current_role"))) or None,
        "tags": names.safe_tags(None, record.get("tags")),
    }


_SYSTEM = re.compile(r"google (?:cloud|workspace|payments)|microsoft|linkedin notifications?|no-?reply|support|notifications?|security|alert|billing|facturacion|calendar|meet")
_SYSTEM_TEXT = re.compile(r"google (?:cloud|workspace)|security alert|work account access|billing|facturacion|password reset|verification code")
_INTENT = re.compile(r"\b(?:cv|curriculum|curriculo|resume|postulante|postulacion|candidato|busqueda laboral|entrevista|seleccion|adjunto|postularme|me postulo|mi experiencia)\b|linkedin\.com/in")
_SIGNAL = re.compile(r"\b(?:experiencia|educacion|formacion|habilidades|competencias|referencias|objetivo laboral|perfil profesional|datos personales|cedula|telefono|celular|mail|email|correo)\b|linkedin\.com/in")
_NAMED_FILE = re.compile(r"\b(?:cv|curriculum|curriculo|resume|candidato|postulante)\b")


def is_candidate_file(file_name: str | None, text: str | None) -> bool:
    """A file of a person: named after one and telling of contacts or a profile, or with contacts and an intent."""
    low = plain(f"{file_name or ''}\n{text or ''}")
    contact = bool(emails_in(low) or names.phones_in(low))
    named = bool(names.name_from_file(file_name))
    return (named and bool(_NAMED_FILE.search(re.sub(r"[_\-.]", " ", plain(file_name))) or contact or _SIGNAL.search(low))) or (contact and bool(_INTENT.search(low) or _SIGNAL.search(low)))


def mail_class(sender: str | None, subject: str | None, body: str | None, file_name: str | None, file_text: str | None) -> str:
    """candidate, system or other: what a message is."""
    if file_name and is_candidate_file(file_name, file_text):
        return "candidate"
    system = _SYSTEM.search(plain(sender)) or _SYSTEM_TEXT.search(plain(f"{sender or ''}\n{subject or ''}\n{body or ''}"))
    return "system" if system else "other"
