"""Safe conversions of one text value; malformed text gives null, never an error.

Expressions are SQL text. A wide input has thousands of them, and building each from Column
calls would cost a round trip to the JVM per operator; as text a whole projection is one call.
"""

from __future__ import annotations

from collections.abc import Sequence

SQL_TYPES = {"long": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "STRING"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parsed(text: str, kind: str) -> str:
    number = f"try_cast({text} AS {kind})"
    # Spark also reads 'inf', 'nan' and other spellings; only these two are numbers here.
    return (
        f"CASE WHEN ({number} IN (DOUBLE('NaN'), DOUBLE('Infinity'), DOUBLE('-Infinity')))"
        f" AND NOT ({text} RLIKE '[0-9]|NaN|Infinity') THEN NULL ELSE {number} END"
    )


def to_float(text: str) -> str:
    return _parsed(text, "FLOAT")


def to_double(text: str) -> str:
    return _parsed(text, "DOUBLE")


def to_long(text: str) -> str:
    return f"try_cast({text} AS BIGINT)"


def to_text(text: str) -> str:
    return f"nullif({text}, '')"


def radius_text(text: str) -> str:
    """Radius columns write a missing value as nothing or as the word null."""
    return f"nullif(nullif({text}, ''), 'null')"


CASTS = {"float": to_float, "double": to_double, "long": to_long, "string": to_text}


def marker_literals(markers: Sequence, kind: str) -> list[str]:
    """Null markers as literals of the column's own type, so numbers compare by value."""
    if kind == "string":
        return [literal(str(m)) for m in markers]
    number = int if kind == "long" else float
    return [f"CAST({literal(repr(number(str(m).strip())))} AS {SQL_TYPES[kind]})" for m in markers]


def is_marker(value: str, markers: Sequence, kind: str) -> str:
    return f"{value} IN ({', '.join(marker_literals(markers, kind))})" if markers else "false"
