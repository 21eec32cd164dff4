"""Word lists, label texts and lookup tables that results depend on."""

from __future__ import annotations

# Labels of form fields, in the order in which they are tried.
ALIASES = {
    "student_name": (
        "student's name", "student name", "students name", "student name:", "student's name:", "student's name / nombre del estudiante", "nombre del estudiante",
        "name", "student:", "estudiante", "nombre", "nombre:", "estudiante:",
    ),
    "school_name": ("school", "school name", "school:", "school / escuela", "escuela", "escuela:", "nombre de la escuela"),
    "grade": ("grade", "grade level", "grade:", "grade / grado", "grado", "grado:"),
    "father_figure_name": (
        "father", "father's name", "father name", "father-figure", "father figure", "padre", "nombre del padre", "figura paterna", "father-figure name", "fatherlfather-figure name",
    ),
    "phone": ("phone", "telephone", "phone number", "telefono", "teléfono"),
    "email": ("email", "e-mail", "email address", "correo", "correo electronico", "correo electrónico"),
}
# Words of label lines.
LABEL_WORDS = (
    "name", "nombre", "school", "escuela", "grade", "grado", "teacher", "maestro", "phone", "telefono", "teléfono", "email", "correo", "deadline", "initiative",
    "contest", "concurso", "writing", "escribiendo", "father", "padre", "figure", "figura", "about", "sobre", "maximum", "maximo", "máximo", "character", "caracteres",
    "reaction", "reaccion", "reacción", "student's", "del", "de", "la", "el",
)
LABEL_PHRASES = ("deadline", "maximum", "contest", "initiative")
FATHER = ("father", "padre", "figura paterna", "grandfather", "stepdad", "abuelo")
# How lines of prose begin, and words that no name holds.
FRAGMENT_STARTS = (
    "and ", "at ", "if ", "the ", "to ", "she ", "he ", "my ", "because ", "when ", "that ", "so ", "but ", "or ", "in ", "on ", "for ", "with ", "is ", "was ", "has ", "have ",
    "it ", "we ", "they ", "this ", "what ", "and if ", "of ", "as ", "by ", "from ", "a ", "a father to", "fatherhood essay", "friend",
)
NAME_REJECTS = ("porque", "estar", "yo", "mi", "se")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
FILE_STOPS = ("ifi", "essay", "contest", "fatherhood", "form", "export", "pdf", "the", "and", "eng", "spanish")
FILE_TEMPLATES = ("26-ifi-essay-form", "26-if-essay-form")
LOW_SCHOOL = ("character", "maximo", "máximo", "deadline", "writing about", "escribiendo", "father", "grandfather", "stepdad", "father-figure")
SCHOOL_SIGNS = ("school", "academy", "elementary", "middle", "high", "institute", "carson", "ps ")
HEADER_SCHOOLS = ("elementary", "middle", "high", "school", "academy", "prep", "charter")
KINDER = ("K", "KINDER", "KINDERGARTEN", "PRE-K", "PRE-KINDERGARTEN")
KINDER_PATTERN = r"(?i)\b(?:pre[ \-]?k|kinder(?:garten|garden)?|kinder(?:garte)?n|[prk]inder(?:garten|garden)?|kindergard(?:en|an)|kindergar(?:den|dan)|kindergart(?:en|esi))\b"
# Typed forms by zone.
RULES_PAGE = ("contest details", "judging process", "official rules", "eligibility", "rules and regulations", "criteria for essay judging")
FOOTNOTE = ("a father-figure can be", "influential males in your life")
NAME_LABELS = ("student's name", "student name", "nombre del estudiante")
NAME_CUTS = (" grade/grado", " grade / grado", " grade", " grado", " 10th ", " 9th ", " 8th ")
PROSE_STARTS = ("my father", "my mother", "my dad", "my mom", "maria,", "he ", "she ", "what ", "the ")
ZONE_LABELS = (
    "student's name", "student name", "nombre del estudiante", "grade", "grado", "school", "escuela", "father", "padre", "figura paterna", "email", "phone", "teléfono",
    "deadline", "march", "writing about", "escribiendo sobre", "character maximum", "stepdad", "padrasto", "grandfather", "abuelo",
)
NOT_NAMES = ("father/father-figure name", "nombre del padre", "nombre deo padre", "figura paterna", "judging process")
NOT_SCHOOLS = ("escuela", "/ escuela", "school", "school name")
SWAP_SIGNS = ("carson", "elementary", "school", "academy", "rachel", "institute", "de la salle")
ADMIN_TEXTS = (
    "contest details", "criteria for essay judging", "judging process", "father", "father-figure", "padre", "figura paterna", "reaction to this essay",
    "phone", "teléfono", "telefono", "email", "correo", "deadline", "character maximum", "maximo de caracteres", "máximo de caracteres",
)
# Where contact lines end.
CONTACT_STRICT = ("student", "estudiante", "school", "escuela", "grade", "grado", "teacher", "maestro", "phone", "telefono", "email", "correo", "location", "ciudad", "deadline")
CONTACT_LOOSE = ("name", "nombre", "father", "padre", "figure", "figura", "writing", "escribiendo", "about", "sobre", "contest", "concurso", "city")
ESSAY_MARKS = (
    "character maximum", "maximo de caracteres", "reaction to this essay", "reaccion", "what my father", "what my dad", "lo que mi padre", "father means to me", "padre significa para mi",
)
PROMPT_MARKS = ("father / padre", "grandfather", "stepdad", "father-figure / figura paterna", "father / grandfather", "figura paterna")
# Schools by their spellings, corrections before the lookup, and what is shown.
SCHOOL_KEYS = {
    "rachel carson": "RACHEL_CARSON", "rachel carson school": "RACHEL_CARSON", "rachel carson elementary": "RACHEL_CARSON", "rachel carson elementary school": "RACHEL_CARSON",
    "carson": "RACHEL_CARSON", "carson elementary school": "RACHEL_CARSON", "carsonelementaryschool": "RACHEL_CARSON",
    "edwards": "EDWARDS", "edwards school": "EDWARDS", "escuela edwards": "EDWARDS",
    "ps 667 b": "PS_667_B", "667 b": "PS_667_B", "p s 667 b": "PS_667_B",
    "de la salle institute": "DE_LA_SALLE_INSTITUTE", "de la salle": "DE_LA_SALLE_INSTITUTE", "de la salle insitute": "DE_LA_SALLE_INSTITUTE",
    "de la salle instetute": "DE_LA_SALLE_INSTITUTE", "de la salle institue": "DE_LA_SALLE_INSTITUTE", "de la salle instutute": "DE_LA_SALLE_INSTITUTE",
    "st mary pontiac": "ST_MARY_PONTIAC", "st marys pontiac": "ST_MARY_PONTIAC", "st mary school": "ST_MARY_PONTIAC", "st marys school": "ST_MARY_PONTIAC",
    "st mary": "ST_MARY_PONTIAC", "st marys": "ST_MARY_PONTIAC", "saint mary school": "ST_MARY_PONTIAC", "saint marys school": "ST_MARY_PONTIAC",
    "saint mary pontiac": "ST_MARY_PONTIAC", "smarys": "ST_MARY_PONTIAC", "stmarys": "ST_MARY_PONTIAC", "stmarys pontiac": "ST_MARY_PONTIAC",
    "stmarys pontia": "ST_MARY_PONTIAC", "st marils": "ST_MARY_PONTIAC",
    "mundelein hs": "MUNDELEIN_HS", "mundelein": "MUNDELEIN_HS", "mundelein high school": "MUNDELEIN_HS",
    "delasalle": "DE_LA_SALLE_INSTITUTE", "delasalle institute": "DE_LA_SALLE_INSTITUTE",
    "rachel cavan": "RACHEL_CARSON", "reachel carson": "RACHEL_CARSON", "reachel carson elementary": "RACHEL_CARSON",
}
SCHOOL_TYPOS = {
    "dware": "edwards", "edward": "edwards", "edwards school": "edwards", "667 b": "ps 667 b", "667b": "ps 667 b", "ps667b": "ps 667 b", "p s 667 b": "ps 667 b",
    "de la salle insitute": "de la salle institute", "de la salle instetute": "de la salle institute", "de la salle institue": "de la salle institute",
    "de la salle instutute": "de la salle institute", "rachal carson": "rachel carson", "rachecl carson": "rachel carson", "carsonelementaryschool": "carson elementary school",
    "st manys school": "st marys school", "st many school": "st mary school", "st marys school": "st mary school", "st marys pontiac": "st mary pontiac",
    "smarys": "st marys", "stmarys": "st marys", "stmarys pontiac": "st marys pontiac", "stmarys pontia": "st marys pontiac", "st marils": "st marys",
    "delasalle": "de la salle", "delasalle institute": "de la salle institute", "rachel cavan": "rachel carson", "reachel carson": "rachel carson",
    "reachel carson elementary": "rachel carson elementary",
}
SCHOOL_NAMES = {
    "RACHEL_CARSON": "Rachel Carson Elementary School", "DE_LA_SALLE_INSTITUTE": "De La Salle Institute", "EDWARDS": "Edwards",
    "PS_667_B": "PS 667 B", "ST_MARY_PONTIAC": "St Mary Pontiac", "MUNDELEIN_HS": "Mundelein HS",
}
# Patterns of fields in a document's whole text, which records quote as evidence, and words for kindergarten there.
TEXT_GRADES = (
    r"(?im)\b(?:grade|grado)\s*[:\-]?\s*(pre[\s\-]?k|k|[0-9]{1,2})\b",
    r"(?im)\b([1-9]|1[0-2])(?:st|nd|rd|th)?\s*grade\b",
    r"(?im)(?:grade|grado)\s+([1-9]|1[0-2])\b",
    r"(?im)(?:^|[,/\-])\s*([1-9]|1[0-2])(?:st|nd|rd|th)?\s*grade\b",
)
TEXT_SCHOOLS = (r"(?im)\b(?:school(?:\s+name)?|campus|escuela)\s*[:\-]?\s*([^\n\r]{2,120})",)
TEXT_KINDER = ("K", "KINDER", "KINDERGARTEN", "PRE-K", "PREK")
TEXT_SOURCE = "final_text_ocr_aggregate"
