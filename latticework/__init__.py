"""Structured-text constraints over large tables: schemas to regular expressions, vocabularies, token automata, guides and masks."""

from .functions.masks import allocate_token_bitmask, apply_token_bitmask, apply_token_bitmask_inplace, fill_next_token_bitmask
from .functions.patterns import BOOLEAN, DATE, DATE_TIME, EMAIL, INTEGER, NULL, NUMBER, STRING, STRING_INNER, TIME, URI, UUID, WHITESPACE, fullmatch
from .operators.guide import Guide
from .operators.index import Index
from .operators.vocabulary import Vocabulary
from .plans.automaton import Automaton, compile_pattern
from .plans.schema_regex import build_regex_from_schema, regex_from_str, regex_from_value

__all__ = [
    "BOOLEAN", "DATE", "DATE_TIME", "EMAIL", "INTEGER", "NULL", "NUMBER", "STRING", "STRING_INNER", "TIME", "URI", "UUID", "WHITESPACE",
    "Automaton", "Guide", "Index", "Vocabulary",
    "allocate_token_bitmask", "apply_token_bitmask", "apply_token_bitmask_inplace", "build_regex_from_schema", "compile_pattern", "fill_next_token_bitmask", "fullmatch", "regex_from_str", "regex_from_value",
]
