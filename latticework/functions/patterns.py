"""Patterns of JSON values and string formats, and predicates on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IndexDfaError
from ..plans.regex_syntax import parse

# The patterns that compiled schemas are made of.
STRING_INNER = r'([^"\\\x00-\x1F\x7F-\x9F]|\\["\\/bfnrt])'
STRING = r'"([^"\\\x00-\x1F\x7F-\x9F]|\\["\\/bfnrt])*"'
INTEGER = r"(-)?(0|[1-9][0-9]*)"
NUMBER = r"((-)?(0|[1-9][0-9]*))(\.[0-9]+)?([eE][+-][0-9]+)?"
BOOLEAN = r"(true|false)"
NULL = r"null"
WHITESPACE = r"[ ]?"
DATE_TIME = r'"(-?(?:[1-9][0-9]*)?[0-9]{4})-(1[0-2]|0[1-9])-(3[01]|0[1-9]|[12][0-9])T(2[0-3]|[01][0-9]):([0-5][0-9]):([0-5][0-9])(\.[0-9]{3})?(Z)?"'
DATE = r'"(?:\d{4})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[1-2][0-9]|3[0-1])"'
TIME = r'"(2[0-3]|[01][0-9]):([0-5][0-9]):([0-5][0-9])(\\.[0-9]+)?(Z)?"'
UUID = r'"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"'
URI = r'"(?:(https?|ftp):\/\/([^\s:@]+(:[^\s:@]*)?@)?([a-zA-Z\d.-]+\.[a-zA-Z]{2,}|localhost)(:\d+)?(\/[^\s?#]*)?(\?[^\s#]*)?(#[^\s]*)?|urn:[a-zA-Z\d][a-zA-Z\d\-]{0,31}:[^\s]+)"'
EMAIL = r'''"(?:[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*|"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])*")@(?:(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?|\[(?:(?:(2(5[0-5]|[0-4][0-9])|1[0-9][0-9]|[1-9]?[0-9]))\.){3}(?:(2(5[0-5]|[0-4][0-9])|1[0-9][0-9]|[1-9]?[0-9])|[a-z0-9-]*[a-z0-9]:(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5a\x53-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])+)\])"'''

#: Scalar types and string formats by their names in a schema.
SCALARS = {"string": STRING, "integer": INTEGER, "number": NUMBER, "boolean": BOOLEAN, "null": NULL}
FORMATS = {"date-time": DATE_TIME, "date": DATE, "time": TIME, "uuid": UUID, "uri": URI, "email": EMAIL}

#: Characters that mean something in a pattern.
SPECIAL = frozenset(r"\.+*?()|[]{}^$#&-~")


def escape(text: str) -> str:
    """The pattern that matches ``text`` and nothing else."""
    return "".join(f"\\{c}" if c in SPECIAL else c for c in text)


def java_form(pattern: str) -> str:
    """The same language for Java's matcher. An alternation under a star recurses there once per character, which overflows the stack on long strings; the plain string pattern is made possessive, which
    changes nothing, as its branches start with different characters and none can take the closing quote."""
    return pattern.replace(STRING, r'"(?:[^"\\\x00-\x1F\x7F-\x9F]++|\\["\\/bfnrt])*+"')


def literal_prefix(pattern: str) -> str:
    """The characters that every match starts with, as far as they are plain to see."""
    try:
        node = parse(pattern)
    except (IndexDfaError, RecursionError):
        return ""
    out, todo = "", [node]
    while todo:
        node = todo.pop()
        if node[0] == "cat":
            todo += reversed(node[1])
        elif node[0] == "set" and len(node[1]) == 1 and node[1][0][0] == node[1][0][1]:
            out += chr(node[1][0][0])
        else:
            break
    return out


def fullmatch(column: Column | str, pattern: str) -> Column:
    """Whether the whole string matches; no line end is forgiven. A literal prefix is tested on its own first, which readers can use to skip row groups."""
    column = F.col(column) if isinstance(column, str) else column
    matches = column.rlike(rf"\A(?:{java_form(pattern)})\z")
    prefix = literal_prefix(pattern)
    return column.startswith(prefix) & matches if prefix else matches
