"""Value shape labels, sensitive classes and masks."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: shape labels, their regular expressions, boolean tokens --------------
ISO_DATETIME = "ISO-DATETIME"
YMD_DASH = "YYYY-MM-DD"
YMD_SLASH = "YYYY/MM/DD"
DMY_SLASH = "DD/MM/YYYY"
MDY_SLASH = "MM/DD/YYYY"
SLASH_AMBIGUOUS = "??/??/YYYY"
YMD_COMPACT = "YYYYMMDD"
DIGITS = "digits"
DECIMAL = "decimal"
BOOLEAN = "boolean"
TEXT = "text"
MIXED = "mixed"

ISO_DATETIME_RX = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?$"
YMD_DASH_RX = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$"
YMD_SLASH_RX = r"^\d{4}/(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])$"
SLASH_RX = r"^\d{2}/\d{2}/\d{4}$"
YMD_COMPACT_RX = r"^(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])$"
DIGITS_RX = r"^[+-]?\d+$"
DECIMAL_RX = r"^[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?$"
TEXT_RX = r"^[\p{L}\p{M}\s]+$"
BOOLEAN_TOKENS = ("true", "false", "yes", "no", "y", "n", "t", "f", "是", "否")

DATE_LABELS = (YMD_DASH, YMD_SLASH, DMY_SLASH, MDY_SLASH, SLASH_AMBIGUOUS, YMD_COMPACT)
LABEL_FORMATS = {
    YMD_DASH: "%Y-%m-%d",
    YMD_SLASH: "%Y/%m/%d",
    DMY_SLASH: "%d/%m/%Y",
    MDY_SLASH: "%m/%d/%Y",
    YMD_COMPACT: "%Y%m%d",
}
TYPE_THRESHOLD = 0.98

# --- Fixed values: sensitive classes in order of precedence, with their masks -----------
SENSITIVE_RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "cn_id": r"(?:^|[^0-9A-Za-z])[0-9]{17}[0-9Xx](?:[^0-9A-Za-z]|$)",
    "cn_mobile": r"(?:^|[^0-9])1[3-9][0-9]{9}(?:[^0-9]|$)",
    "bank_card": r"(?:^|[^0-9])[0-9]{16,19}(?:[^0-9]|$)",
    "intl_phone": (
        r"(?:\+[0-9]{1,3}[ ().-]*[0-9](?:[ ().-]*[0-9]){6,13}(?:[^0-9]|$))"
        r"|(?:(?:^|[^0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?:[^0-9]|$))"
    ),
    "name_label": r"(?i:name|patient|姓名)\s*[:：]\s*\S+",
}
MASKS = {
    "email": "••••@••••",
    "cn_id": "••••••••••••••••••",
    "cn_mobile": "1••••••••••",
    "bank_card": "•••• •••• •••• ••••",
    "intl_phone": "+•• ••• ••• ••••",
    "name_label": "•••: ••••",
}
GENERIC_MASK = "••••"
SENSITIVE_NAME_TOKENS = (
    "email", "phone", "mobile", "tel", "note", "remark", "name", "id_card",
    "身份证", "电话", "手机", "姓名", "备注",
)
# ----------------------------------------------------------------------------------------

SENSITIVE_CLASSES = tuple(SENSITIVE_RX)
SLASH_UNDECIDED = "slash"


def whole(value: Column, regex: str) -> Column:
    """Anchored match with Unicode classes; ``\\z`` because Java's ``$`` allows a final newline."""
    return value.rlike("(?U)" + regex.removesuffix("$") + r"\z")


def is_boolean(value: Column) -> Column:
    """A token in any case. No letter but A-Z becomes one of a-z used here, so the spellings can be listed."""
    spellings = {"".join(letters) for token in BOOLEAN_TOKENS for letters in product(*[(c.lower(), c.upper()) for c in token])}
    return value.isin(*sorted(spellings))


def shape_label(value: Column) -> Column:
    """Shape of one value. Two-digit slash dates stay undecided until the column is known."""
    starts_numeric = value.rlike(r"(?U)^[+\-.\d]")
    numeric = (
        F.when(whole(value, ISO_DATETIME_RX), ISO_DATETIME)
        .when(whole(value, YMD_DASH_RX), YMD_DASH)
        .when(whole(value, YMD_SLASH_RX), YMD_SLASH)
        .when(whole(value, SLASH_RX), SLASH_UNDECIDED)
        .when(whole(value, YMD_COMPACT_RX), YMD_COMPACT)
        .when(whole(value, DIGITS_RX), DIGITS)
        .when(whole(value, DECIMAL_RX), DECIMAL)
        .otherwise(MIXED)
    )
    worded = (
        F.when(is_boolean(value), BOOLEAN).when(whole(value, TEXT_RX), TEXT).otherwise(MIXED)
    )
    return F.when(starts_numeric, numeric).otherwise(worded)


# Every class needs one of these marks, and no match is shorter than six bytes: characters found
# by plain search, or three digits that eight others or a separator and three others follow.
SENSITIVE_MARKS = {"email": "@", "intl_phone": "+", "name_label": ":："}
DIGIT_MARKS_RX = r"[0-9]{3}(?:[0-9]{8}|\)?[ .-][0-9]{3})"
LONG_NUMBERS = ("cn_id", "cn_mobile", "bank_card")


def sensitive_class(value: Column) -> Column:
    """First matching class or null. Cheap searches keep most cells away from the six patterns."""

    def marked(name: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(value, F.lit(mark)) for mark in SENSITIVE_MARKS[name]])

    def matched(*names: str) -> Column:
        return reduce(
            lambda chain, name: chain.when(value.rlike("(?U)" + SENSITIVE_RX[name]), name),
            names,
            F.when(F.lit(False), F.lit(None).cast("string")),
        )

    digits = (F.octet_length(value) >= 7) & value.rlike(DIGIT_MARKS_RX)
    suspicious = (F.octet_length(value) >= 6) & (marked("email") | marked("name_label") | marked("intl_phone") | digits)
    classes = F.coalesce(
        F.when(marked("email"), matched("email")),
        F.when(value.rlike("[0-9]{11}"), matched(*LONG_NUMBERS)),
        F.when(marked("intl_phone") | digits, matched("intl_phone")),
        F.when(marked("name_label"), matched("name_label")),
    )
    return F.when(suspicious, classes)


def looks_sensitive(value: Column) -> Column:
    return sensitive_class(value).isNotNull()


def mask_for(pattern_class: Column) -> Column:
    chain = reduce(
        lambda acc, name: acc.when(pattern_class == name, MASKS[name]),
        SENSITIVE_CLASSES,
        F.when(F.lit(False), GENERIC_MASK),
    )
    return chain.otherwise(GENERIC_MASK)


def mask_value(value: Column) -> Column:
    """A fixed mask chosen by class; the value itself never shapes the output."""
    return F.when(value.isNull() | (value == ""), "").otherwise(mask_for(sensitive_class(value)))


def is_sensitive_name(column: str) -> bool:
    return any(token in column.lower() for token in SENSITIVE_NAME_TOKENS)
