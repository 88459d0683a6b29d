"""Text expressions: stringr verbs and the business-registry features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regioscope.functions.rsem import present, r_in


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_all(c, pattern: str) -> Column:
    return F.regexp_replace(_c(c), pattern, "")


def extract(c, pattern: str) -> Column:
    """First match or NULL (``str_extract``); ``regexp_extract`` gives ''."""
    return F.regexp_substr(_c(c), F.lit(pattern))


def squish(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def replace_first(c, pattern: str, replacement: str) -> Column:
    """``str_replace``: only the leftmost match is replaced."""
    return F.regexp_replace(_c(c), "(?s)^(.*?)(?:" + pattern + ")",
                            "$1" + replacement)


def remove_first(c, pattern: str) -> Column:
    return replace_first(c, pattern, "")


def detect(c, pattern: str) -> Column:
    return _c(c).rlike(pattern)


# The legal-form pattern, the legal-form codes and the
# size classes below must equal the reference's for equal results.  The
# pattern is unanchored and leftmost-first, and is kept exactly as written
# (including its repeated alternatives and double spaces).
LEGAL_FORM_PATTERN = (
    "S DE CV| S A P I DE CV| SA$| S[AC] DE CV$| SC?$| SC? [DEN]{2} [RLCS]{2}$|"
    " SAPI$| SAPI DE CV$| SC? DE RL DE CV| AC| SPR DE RL|SOFOM| S DE PR DE RL|"
    "SA DE RL| AR$|SA DE CV SFC|INC SA DE CV SOFOM ENR|INC|SA DE RL|"
    "SAPI DE CV SOFOM ENR| SAB DE CV SOFOM ENR|Y ASOCIADOS|SA DE RL DE CV|SCL|"
    "SRL DE CV|SAS DE CV|SC DE R|SRL DE CV|A C|SAS DE CV|S A  DE  C V|"
    " SA DE CV SOFOM ENR|SAB DE CV|S DE RL MI|SA DE CV SFP|SA DE CV SOFOM ENR|"
    "IAP|API DE CV|SRL DE CV|SA DE CV SOFI|SA DE CV|SAS DE CV"
)
NO_LEGAL_FORM = "Sin Razón"
# Legal-form dummy columns and the substring each one tests, in order.
LEGAL_FORM_CODES = [
    ("razon_sa", "SA"), ("razon_cv", "CV"), ("razon_rl", "RL"),
    ("razon_ac", "AC"), ("razon_sapi", "API"), ("razon_sab", "SAB"),
    ("razon_pr", "PR"), ("razon_sofom", "SOFOM"), ("razon_sfp", "SFP"),
    ("razon_scl", "SCL"), ("razon_spr", "PR"), ("razon_sc", "SC"),
    ("razon_inc", "INC"), ("razon_sas", "SAS"), ("razon_sofi", "SOFI"),
]
# Size classes that count as "fewer than 30 employees".
SMALL_SIZE_CLASSES = ["0 a 5 personas", "6 a 10 personas", "11 a 30 personas"]
SIZE_LABELS = ["<30 employees", "30 or more employees"]


def legal_form(raz_social) -> Column:
    """Legal form of a business name (punctuation stripped, first match,
    squished, two spellings normalised, default ``Sin Razón``)."""
    cleaned = remove_all(raz_social, r"[\.,]+")
    r = squish(extract(cleaned, LEGAL_FORM_PATTERN))
    r = replace_first(r, "A C$", "AC")
    r = replace_first(r, "S A P I", "SAPI")
    return F.coalesce(r, F.lit(NO_LEGAL_FORM))


def legal_form_dummies(razon) -> dict[str, Column]:
    """0/1 double per legal-form code (NULL razon -> NULL)."""
    return {name: detect(razon, code).cast("double")
            for name, code in LEGAL_FORM_CODES}


def size_target(per_ocu) -> Column:
    """``employees_30_or_more`` label; a missing size class is positive."""
    return F.when(r_in(per_ocu, SMALL_SIZE_CLASSES), F.lit(SIZE_LABELS[0])) \
        .otherwise(F.lit(SIZE_LABELS[1]))
