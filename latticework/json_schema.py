"""The patterns of JSON and of schemas under one name."""

from .functions.patterns import BOOLEAN, DATE, DATE_TIME, EMAIL, INTEGER, NULL, NUMBER, STRING, STRING_INNER, TIME, URI, UUID, WHITESPACE
from .plans.schema_regex import build_regex_from_schema, regex_from_str, regex_from_value

__all__ = ["BOOLEAN", "DATE", "DATE_TIME", "EMAIL", "INTEGER", "NULL", "NUMBER", "STRING", "STRING_INNER", "TIME", "URI", "UUID", "WHITESPACE", "build_regex_from_schema", "regex_from_str", "regex_from_value"]
