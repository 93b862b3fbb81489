"""Queries over the test tables, one or more for each kind of operator, each with the SQL that gives the same rows.

The patterns are compiled once, so both sides read the same ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import masks as M
from .functions import patterns as P
from .functions import tokens as T
from .operators.guide import follow, follow_long, rolled_back
from .operators.index import Index, accepts, walk
from .operators.pattern_table import PatternTable, conforms
from .operators.vocabulary import Vocabulary
from .plans.automaton import START, compile_pattern
from .plans.schema_regex import regex_from_value

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# Schemas as predicates


def predicate(name: str, schema: dict | str, source: str, value: str, by: str, sql_value: str | None = None) -> None:
    """How many rows of each group match a schema. ``value`` is an expression that Spark and DuckDB read alike, else ``sql_value`` is DuckDB's."""
    pattern = schema if isinstance(schema, str) else regex_from_value(schema)
    whole = sql_value or value

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(F.expr(by).alias("grp"), F.expr(value).alias("value"))
        return rows.groupBy("grp").agg(F.count("*").alias("n_rows"), F.count_if(P.fullmatch("value", pattern)).alias("n_match"))

    QUERIES[name] = run
    SQL[name] = f"SELECT {by} AS grp, count(*) AS n_rows, count(*) FILTER (coalesce(regexp_full_match({whole}, {text(pattern)}), false)) AS n_match FROM {source} GROUP BY 1"


def key(schema: dict, name: str = "k", **more) -> dict:
    return {"type": "object", "properties": {name: schema}, "required": [name]} | more


PRIORITY = {"anyOf": [{"const": "1-URGENT"}, {"const": "5-LOW"}, {"const": "2-HIGH"}]}
NESTED = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "properties": {"v": {"type": "integer"}, "n": {"$ref": "#/$defs/node"}}, "required": ["v"]}}}

predicate("schema_validate_props", key({"type": "integer"}), "events", "props", "event_type")
predicate("schema_optional_props", {"type": "object", "properties": {"j": {"type": "null"}, "k": {"type": "integer", "minDigits": 2}, "l": {"type": "null"}}}, "events", "props", "event_type")
predicate("schema_digits_bounds", key({"type": "integer", "minDigits": 2, "maxDigits": 2}), "events", "props", "event_type")
predicate("schema_number_bounds", {"type": "number", "minDigitsInteger": 5, "maxDigitsInteger": 6, "minDigitsFraction": 2, "maxDigitsFraction": 2}, "orders", "cast(cast(o_totalprice as decimal(18,2)) as string)", "o_orderstatus", "cast(cast(o_totalprice as decimal(18,2)) as varchar)")
predicate("schema_free_object", {"type": "object"}, "events", "props", "event_type")
predicate("schema_object_values", {"type": "object", "additionalProperties": {"type": "integer", "maxDigits": 2}, "minProperties": 1}, "events", "props", "event_type")
predicate("schema_any_value", {}, "events", "props", "event_type")
predicate("schema_enum_event_type", {"enum": ["click", "view", 3, None, ["x"]]}, "events", "'\"' || event_type || '\"'", "event_type")
predicate("schema_const_status", {"const": "O"}, "orders", "'\"' || o_orderstatus || '\"'", "o_orderpriority")
predicate("schema_any_of_priority", PRIORITY, "orders", "'\"' || o_orderpriority || '\"'", "o_orderpriority")
predicate("schema_one_of_size", {"oneOf": [{"type": "integer", "minDigits": 2}, {"type": "string", "maxLength": 6}]}, "part", "case when p_size % 2 = 0 then cast(p_size as string) else '\"' || p_type || '\"' end", "p_type", "case when p_size % 2 = 0 then cast(p_size as varchar) else '\"' || p_type || '\"' end")
predicate("schema_type_array", {"type": ["integer", "boolean", "null"]}, "part", "case p_size % 4 when 0 then 'true' when 1 then 'null' when 2 then 'x' else cast(p_size as string) end", "p_type", "case p_size % 4 when 0 then 'true' when 1 then 'null' when 2 then 'x' else cast(p_size as varchar) end")
predicate("schema_all_of", {"allOf": [{"type": "string", "pattern": "^Brand#[0-9]$"}, {"type": "integer"}]}, "part", "'\"' || p_brand || '\"' || cast(p_size as string)", "p_type", "'\"' || p_brand || '\"' || cast(p_size as varchar)")
predicate("schema_prefix_items", {"prefixItems": [{"type": "string"}, {"type": "integer", "maxDigits": 2}]}, "part", "'[\"' || p_brand || '\", ' || cast(p_partkey as string) || ']'", "p_type", "'[\"' || p_brand || '\", ' || cast(p_partkey as varchar) || ']'")
predicate("schema_array_items", {"type": "array", "items": {"type": "integer"}, "minItems": 2, "maxItems": 3}, "lineitem", "'[' || cast(l_linenumber as string) || case when l_linenumber > 2 then ', 5' else '' end || case when l_linenumber > 4 then ', 6' else '' end || case when l_linenumber > 6 then ', 7' else '' end || ']'", "l_returnflag", "'[' || cast(l_linenumber as varchar) || case when l_linenumber > 2 then ', 5' else '' end || case when l_linenumber > 4 then ', 6' else '' end || case when l_linenumber > 6 then ', 7' else '' end || ']'")
predicate("schema_free_array", {"type": "array", "depth": 1}, "events", "'[' || props || ', [1, true], null]'", "event_type")
predicate("schema_string_length", {"type": "string", "minLength": 9, "maxLength": 10}, "part", "'\"' || p_name || '\"'", "p_type")
predicate("schema_string_pattern", {"type": "string", "pattern": "^(red|blue) [a-z]+$"}, "part", "'\"' || p_name || '\"'", "p_name")
predicate("schema_reference", NESTED, "part", "'{\"v\": ' || cast(p_size as string) || case when p_size % 3 = 0 then ', \"n\": {\"v\": 1, \"n\": {\"v\": 2}}' when p_size % 3 = 1 then ', \"n\": {\"w\": 1}' else '' end || '}'", "p_size", "'{\"v\": ' || cast(p_size as varchar) || case when p_size % 3 = 0 then ', \"n\": {\"v\": 1, \"n\": {\"v\": 2}}' when p_size % 3 = 1 then ', \"n\": {\"w\": 1}' else '' end || '}'")
predicate("schema_long_strings", {"type": "string"}, "documents", "'\"' || replace(replace(text, '\"', '?'), '\\n', ' ') || '\"'", "source", "'\"' || replace(replace(text, '\"', '?'), chr(10), ' ') || '\"'")
predicate("format_uri_pages", P.URI, "pages", "'\"' || url || '\"'", "substring(url, 1, 5)")
predicate("format_datetime_events", P.DATE_TIME, "events", "'\"' || date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || case when event_id % 3 = 0 then '.5' else 'Z' end || '\"'", "event_type", "'\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when event_id % 3 = 0 then '.5' else 'Z' end || '\"'")
predicate("format_date_orders", P.DATE, "orders", "'\"' || date_format(o_orderdate, case when o_orderkey % 2 = 0 then 'yyyy-MM-dd' else 'yyyy/MM/dd' end) || '\"'", "o_orderstatus", "'\"' || case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y/%m/%d') end || '\"'")
predicate("format_time_events", P.TIME, "events", "'\"' || date_format(ts, case when event_id % 2 = 0 then 'HH:mm:ss' else 'HH:mm' end) || '\"'", "event_type", "'\"' || case when event_id % 2 = 0 then strftime(ts, '%H:%M:%S') else strftime(ts, '%H:%M') end || '\"'")
HASHED = "'\"' || substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) || '\"'"
predicate("format_uuid_customers", P.UUID, "customer", HASHED.replace("h,", "md5(c_name),"), "c_mktsegment")
EMAILS = regex_from_value({"type": "string", "format": "email"})


@query(
    "format_email_words",
    f"""SELECT source AS grp, count(*) AS n_match FROM (SELECT source, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents)
        WHERE contains(w, '@') AND regexp_full_match('"' || w || '"', {text(EMAILS)}) GROUP BY 1""",
)
def format_email_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    return words.filter(F.col("w").contains("@")).filter(P.fullmatch(F.concat(F.lit('"'), "w", F.lit('"')), EMAILS)).groupBy("grp").agg(F.count("*").alias("n_match"))


# Vocabularies: the words of the documents, or of the part names, numbered

WORDS = "SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents"


def word_vocabulary(spark, sf_dir, asked: DataFrame | None = None) -> DataFrame:
    """(word, token_id): a word's number is a hash of it; hashes that collide are one id for several tokens, which vocabularies allow. Only the words ``asked`` for, where given."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    words = (words if asked is None else words.join(asked, "word", "left_semi")).distinct()
    return words.select("word", F.conv(F.substring(F.md5("word"), 1, 7), 16, 10).cast("long").alias("token_id"))


ID = "('0x' || substring(md5(word), 1, 7))::BIGINT"
NO_ID = 1 << 31


def vocabulary(spark, sf_dir, asked: DataFrame | None = None) -> Vocabulary:
    return Vocabulary(NO_ID, word_vocabulary(spark, sf_dir, asked).select(F.encode("word", "UTF-8").alias("token"), "token_id"), checked=True)  # ids have 28 bits


@query("vocab_build", f"SELECT word, {ID} AS token_id FROM ({WORDS})")
def vocab_build(spark, sf_dir):
    return vocabulary(spark, sf_dir).frame.select(F.decode("token", "UTF-8").alias("word"), "token_id")


@query("vocab_lookup", f"SELECT item_id, count(token_id) AS n_known, count(*) AS n_words FROM (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM benchmark)) LEFT JOIN (SELECT word, {ID} AS token_id FROM ({WORDS})) ON w = word GROUP BY 1")
def vocab_lookup(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).distinct()
    # The vocabulary's words that are asked for, before they are made distinct.
    asked = words.select(F.col("w").alias("word")).distinct()
    found = vocabulary(spark, sf_dir, asked).lookup(words, "w")
    return found.groupBy("item_id").agg(F.count("token_id").alias("n_known"), F.count("*").alias("n_words"))


PART_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part"


def part_vocabulary(spark, sf_dir) -> Vocabulary:
    """Words of part names, the blank, and each word with a blank before it; ids by order, each word twice."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    both = words.select(F.explode(F.array("word", F.concat(F.lit(" "), "word"))).alias("word"))
    numbered = both.select("word", F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("long").alias("token_id"))
    return Vocabulary(NO_ID, numbered.select(F.encode("word", "UTF-8").alias("token"), "token_id"), checked=True)


SHORT_ID = "('0x' || substring(md5(word), 1, 4))::BIGINT"
PART_TOKENS = f"(SELECT word, {SHORT_ID} AS token_id FROM (SELECT unnest([word, ' ' || word]) AS word FROM ({PART_WORDS})))"


@query("vocab_insert", f"SELECT word, token_id FROM {PART_TOKENS} UNION ALL SELECT DISTINCT p_type, 70000 + p_size FROM part")
def vocab_insert(spark, sf_dir):
    vocab = part_vocabulary(spark, sf_dir)
    vocab.insert_all(table(spark, sf_dir, "part").select(F.encode("p_type", "UTF-8").alias("token"), (F.col("p_size") + 70000).cast("long").alias("token_id")).distinct())
    return vocab.frame.select(F.decode("token", "UTF-8").alias("word"), "token_id")


@query("vocab_remove", f"SELECT word, token_id FROM {PART_TOKENS} WHERE word <> 'red' AND word NOT IN (SELECT string_split(p_name, ' ')[2] FROM part)")
def vocab_remove(spark, sf_dir):
    vocab = part_vocabulary(spark, sf_dir)
    vocab.remove("red")
    vocab.remove_all(table(spark, sf_dir, "part").select(F.encode(F.element_at(F.split("p_name", " "), 2), "UTF-8").alias("token")))
    return vocab.frame.select(F.decode("token", "UTF-8").alias("word"), "token_id")


@query("vocab_len", f"SELECT count(*) + 1 AS n, false AS is_empty FROM ({WORDS})")
def vocab_len(spark, sf_dir):
    vocab = vocabulary(spark, sf_dir)
    return vocab.frame.agg((F.count("*") + 1).alias("n"), (F.count("*") == 0).alias("is_empty"))


@query("vocab_group_ids", "SELECT p_type AS word, count(DISTINCT p_size) AS n_ids, min(p_size)::BIGINT AS first_id, max(p_size)::BIGINT AS last_id FROM part GROUP BY 1")
def vocab_group_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.encode("p_type", "UTF-8").alias("token"), F.col("p_size").cast("long").alias("token_id")).distinct()
    grouped = Vocabulary(NO_ID, rows).tokens()
    return grouped.select(F.decode("token", "UTF-8").alias("word"), F.size("ids").cast("long").alias("n_ids"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))




@query("decode_byte_level", "SELECT word, lower(hex(encode(word))) AS bytes FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)")
def decode_byte_level(spark, sf_dir):
    """Every word of the documents, line breaks among them, is spelled as a byte-level vocabulary spells it and read back."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", F.lower(F.hex(T.byte_level(T.spell_byte_level(F.col("word"))))).alias("bytes"))


@query("decode_byte_fallback", "SELECT word, lower(hex(encode(word))) AS bytes FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)")
def decode_byte_fallback(spark, sf_dir):
    """Every word of the documents as a byte-fallback vocabulary spells it, one token for each character or byte, and read back: the tokens' bytes in a row."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    tokens = words.select("word", F.posexplode_outer(T.spell_byte_fallback(F.col("word"), "▁")).alias("i", "token"))
    read = tokens.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", F.lower(F.hex(T.byte_fallback(F.coalesce("token", F.lit("")), "▁"))).alias("h")))).alias("all"))
    return read.select("word", F.array_join("all.h", "").alias("bytes"))


# Automata and indexes over the part names' words

NAMES = "(small|large|hot|cold|red|blue) [a-z]+"
NAME_AUTOMATON = compile_pattern(NAMES)


def sql_walk(automaton, word: str, start: str) -> str:
    """The fold over a word's bytes in DuckDB."""
    delta, classes = (f"[{','.join(map(str, x))}]" for x in (automaton.delta, automaton.classes))
    data = f"list_transform(range(1, length(hex(encode({word}))) // 2 + 1), lambda i: ('0x' || substring(hex(encode({word})), 2 * i - 1, 2))::INT)"
    return f"list_reduce({data}, lambda s, b: ({delta})[s * {automaton.n_classes} + ({classes})[b + 1] + 1], {start})"


def _flags(x) -> str:
    return f"[{','.join('true' if v else 'false' for v in x)}]"


_STEPS = f"""steps AS (
  SELECT s AS state, token_id, to_state AS next_state FROM (
    SELECT s, token_id, {sql_walk(NAME_AUTOMATON, "word", "s")} AS to_state FROM {PART_TOKENS}, range(1, {NAME_AUTOMATON.n_states}) t(s))
  WHERE ({_flags(NAME_AUTOMATON.useful)})[to_state + 1])"""
_REACHED = f"""reached AS (SELECT {START}::BIGINT AS state UNION SELECT next_state FROM reached JOIN steps USING (state))"""
_EDGES = f"""WITH RECURSIVE {_STEPS}, {_REACHED}, final AS (SELECT state FROM reached WHERE ({_flags(NAME_AUTOMATON.final)})[state + 1]),
edges AS (SELECT state, token_id, min(next_state) AS next_state FROM steps WHERE state IN (SELECT state FROM reached) GROUP BY 1, 2
          UNION ALL SELECT state, {NO_ID}, state FROM final)"""


def name_index(spark, sf_dir) -> Index:
    return Index(NAMES, part_vocabulary(spark, sf_dir))


@query("index_edges", f"{_EDGES} SELECT state::INT AS state, token_id::BIGINT AS token_id, next_state::INT AS next_state FROM edges")
def index_edges(spark, sf_dir):
    return name_index(spark, sf_dir).edges


@query("index_states", f"{_EDGES} SELECT state::INT AS state, state IN (SELECT state FROM final) AS is_final FROM reached")
def index_states(spark, sf_dir):
    return name_index(spark, sf_dir).states


@query("index_allowed_counts", f"{_EDGES} SELECT state::INT AS state, count(*) AS n_allowed, min(token_id)::BIGINT AS first_token FROM edges GROUP BY 1")
def index_allowed_counts(spark, sf_dir):
    index = name_index(spark, sf_dir)
    return index.allowed(index.states.select("state")).groupBy("state").agg(F.count("*").alias("n_allowed"), F.min("token_id").alias("first_token"))


FIRST_WORD = "('0x' || substring(md5(string_split(p_name, ' ')[1]), 1, 4))::BIGINT"


@query("index_next_state", f"{_EDGES} SELECT p_partkey, next_state::INT AS next_state FROM part LEFT JOIN edges ON edges.state = {START} AND edges.token_id = {FIRST_WORD} AND edges.token_id <> {NO_ID}")
def index_next_state(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(START).alias("state"), F.conv(F.substring(F.md5(F.element_at(F.split("p_name", " "), 1)), 1, 4), 16, 10).cast("long").alias("token_id"))
    return name_index(spark, sf_dir).next_states(rows).select("p_partkey", "next_state")


@query("index_final_rows", f"{_EDGES} SELECT p_size, count(*) AS n FROM part WHERE p_size IN (SELECT state FROM final) GROUP BY 1")
def index_final_rows(spark, sf_dir):
    return name_index(spark, sf_dir).with_finality(table(spark, sf_dir, "part"), "p_size").groupBy("p_size").agg(F.count("*").alias("n"))


@query("automaton_accepts", f"SELECT p_name, count(*) AS n, regexp_full_match(p_name, {text(NAMES)}) AS accepted FROM part GROUP BY p_name")
def automaton_accepts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")).withColumn("accepted", accepts(NAME_AUTOMATON, F.col("p_name")))


#: A match that comes first ends the text for what comes after it in the pattern.
FIRST = compile_pattern("1|12|2[0-9]")


@query("automaton_leftmost_first", "SELECT p_size, count(*) AS n, p_size <> 12 AND regexp_full_match(p_size::VARCHAR, '1|12|2[0-9]') AS accepted FROM part GROUP BY p_size")
def automaton_leftmost_first(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n")).withColumn("accepted", accepts(FIRST, F.col("p_size").cast("string")))


@query("automaton_state", f"SELECT p_name, {sql_walk(NAME_AUTOMATON, 'p_name', str(START))}::INT AS state FROM part GROUP BY p_name")
def automaton_state(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct().withColumn("state", walk(NAME_AUTOMATON, F.encode("p_name", "UTF-8"), F.lit(START)))


# A table of patterns: for each size of a part, words that begin with a letter of its own. State 2 has read the letter, 4 more of them; 3 is what a late match leaves, where nothing goes on

_PREFIXED = f"""tokens AS (SELECT word, token_id FROM {PART_TOKENS} WHERE regexp_full_match(word, '[a-z]+')),
patterns AS (SELECT DISTINCT p_size AS pattern_id, chr(97 + p_size % 26) AS c FROM part),
first AS (SELECT pattern_id, token_id, min(CASE WHEN length(word) = 1 THEN 2 ELSE 4 END) AS next_state FROM patterns JOIN tokens ON starts_with(word, c) GROUP BY 1, 2),
again AS (SELECT DISTINCT token_id FROM tokens),
reached AS (SELECT DISTINCT pattern_id, next_state AS state FROM first UNION SELECT pattern_id, 4 FROM first)"""


def prefixed(spark, sf_dir) -> PatternTable:
    patterns = table(spark, sf_dir, "part").select(F.col("p_size").alias("pattern_id"), F.concat(F.chr((97 + F.col("p_size") % 26).cast("long")), F.lit("[a-z]*")).alias("pattern"))
    return PatternTable(patterns, part_vocabulary(spark, sf_dir))


@query(
    "pattern_table_edges",
    f"""WITH {_PREFIXED} SELECT pattern_id, 1::INT AS state, token_id::BIGINT AS token_id, next_state::INT AS next_state FROM first
        UNION ALL SELECT pattern_id, state::INT, token_id::BIGINT, 4::INT FROM reached, again UNION ALL SELECT pattern_id, state::INT, {NO_ID}::BIGINT, state::INT FROM reached""",
)
def pattern_table_edges(spark, sf_dir):
    return prefixed(spark, sf_dir).edges


@query("pattern_table_missing", f"WITH {_PREFIXED} SELECT pattern_id, 1::INT AS state, ascii(c)::INT AS byte FROM patterns WHERE pattern_id NOT IN (SELECT pattern_id FROM first)")
def pattern_table_missing(spark, sf_dir):
    """Letters that no token of the vocabulary begins with, by pattern."""
    return prefixed(spark, sf_dir).missing


# A schema for each row

ROW_SCHEMAS = (
    {"type": "object", "properties": {"k": {"type": "integer", "minDigits": 2, "maxDigits": 2}}, "required": ["k"]},
    {"type": "object", "properties": {"k": {"enum": list(range(0, 100, 7))}}, "required": ["k"]},
    {"type": "object", "additionalProperties": {"type": "integer"}, "maxProperties": 3},
    {"type": "object", "properties": {"k": {"type": "string"}}, "required": ["k"]},
    {"unknown": 1},
)


@query(
    "schema_per_row",
    f"SELECT user_id % 5 AS kind, event_type, count(*) AS n_rows, count(*) FILTER (m) AS n_match, count(m) AS n_known FROM (SELECT *, CASE user_id % 5 {' '.join(f'WHEN {i} THEN regexp_full_match(props, {text(regex_from_value(s))})' for i, s in enumerate(ROW_SCHEMAS[:4]))} END AS m FROM events) GROUP BY 1, 2",
)
def schema_per_row(spark, sf_dir):
    """Each user's events are held against the schema that their row names; the last one has no pattern."""
    kind = F.col("user_id") % len(ROW_SCHEMAS)
    rows = table(spark, sf_dir, "events").select(kind.alias("kind"), "event_type", "props", F.element_at(F.array(*[F.lit(json.dumps(s)) for s in ROW_SCHEMAS]), (kind + 1).cast("int")).alias("schema"))
    return conforms(rows, "schema", "props").groupBy("kind", "event_type").agg(F.count("*").alias("n_rows"), F.count_if("matches").alias("n_match"), F.count("matches").alias("n_known"))


# Guides over conversations: a turn is a token

ROLES = {"system": (1, "s"), "user": (2, "u"), "assistant": (3, "a")}
ROLE_EOS = 4


def role_rows(spark, sf_dir) -> DataFrame:
    number = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for r, (i, _) in ROLES.items()], F.lit(99)).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", number.alias("token_id"))


def roles(spark) -> Vocabulary:
    return Vocabulary(ROLE_EOS, {c: [i] for i, c in ROLES.values()}, spark)


_SPELLED = "SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn) AS w, count(*) AS n FROM conversations GROUP BY 1"


def guide_query(name: str, pattern: str) -> None:
    automaton = compile_pattern(pattern)
    state = f"(SELECT CASE WHEN ({_flags(automaton.useful)})[s + 1] THEN s ELSE 0 END FROM (SELECT {sql_walk(automaton, 'w', str(START))} AS s))"

    def run(spark, sf_dir):
        vocab = roles(spark)
        return follow(role_rows(spark, sf_dir), Index(pattern, vocab), vocab, ["conv_id"], ["turn"]).select("conv_id", F.col("n_tokens").cast("long").alias("n_tokens"), "state", "accepted", "finished")

    QUERIES[name] = run
    SQL[name] = f"SELECT conv_id, n AS n_tokens, state::INT AS state, state <> 0 AS accepted, regexp_full_match(w, {text(pattern)}) AS finished FROM (SELECT conv_id, w, n, {state} AS state FROM ({_SPELLED}))"


guide_query("guide_accepts_roles", "s?(ua)*u?")
guide_query("guide_narrow_roles", "(ua)+")


def rollback_query(name: str, pattern: str, n: int) -> None:
    automaton = compile_pattern(pattern)
    at = lambda word: f"(SELECT CASE WHEN ({_flags(automaton.useful)})[s + 1] THEN s ELSE 0 END FROM (SELECT {sql_walk(automaton, word, str(START))} AS s))"

    def run(spark, sf_dir):
        vocab = roles(spark)
        return rolled_back(role_rows(spark, sf_dir), Index(pattern, vocab), vocab, ["conv_id"], ["turn"], n)

    QUERIES[name] = run
    SQL[name] = f"SELECT conv_id, CASE WHEN n >= {n} AND {at('w')} <> 0 THEN {at(f'substring(w, 1, (n - {n})::BIGINT)')} END::INT AS state FROM ({_SPELLED})"


rollback_query("guide_rollback", "s?(ua)*u?", 2)
rollback_query("guide_rollback_narrow", "(ua)+", 1)


KINDS = {"click": (1, "c"), "view": (2, "v"), "purchase": (3, "p"), "error": (4, "e"), "signup": (5, "s")}
SESSIONS = "([^p]|p[^e])*p?"
SESSION_AUTOMATON = compile_pattern(SESSIONS)
_LETTER = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, (_, c) in KINDS.items()) + " ELSE 'x' END"


@query("guide_long_sequences", f"SELECT user_id, n AS n_tokens, CASE WHEN ({_flags(SESSION_AUTOMATON.useful)})[s + 1] THEN s ELSE 0 END::INT AS state, s <> 0 AND ({_flags(SESSION_AUTOMATON.useful)})[s + 1] AS accepted, ({_flags(SESSION_AUTOMATON.final)})[s + 1] AND ({_flags(SESSION_AUTOMATON.useful)})[s + 1] AS finished FROM (SELECT user_id, n, {sql_walk(SESSION_AUTOMATON, 'w', str(START))} AS s FROM (SELECT user_id, count(*) AS n, string_agg({_LETTER}, '' ORDER BY event_id) AS w FROM events GROUP BY 1))")
def guide_long_sequences(spark, sf_dir):
    vocab = Vocabulary(9, {c: [i] for i, c in KINDS.values()} | {"x": [99]}, spark)
    number = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(i)) for k, (i, _) in KINDS.items()], F.lit(99)).cast("long")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", number.alias("token_id"))
    return follow_long(rows, Index(SESSIONS, vocab), vocab, "user_id", "event_id")


# Masks


@query("mask_words", "SELECT p_type, (p_partkey // 32)::INT AS word_idx, (CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END)::INT AS word FROM (SELECT p_type, p_partkey // 32 AS p, any_value(p_partkey) AS p_partkey, bit_or(1::BIGINT << (p_partkey % 32)) AS w FROM part GROUP BY 1, 2)")
def mask_words(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = part.agg(F.coalesce(F.max("p_partkey"), F.lit(0)) + 1).first()[0]
    return M.mask_words(part, size, ["p_type"], "p_partkey").select("p_type", "word_idx", "word")


@query("mask_arrays", "WITH words AS (SELECT p_type, p_size // 32 AS i, bit_or(1::BIGINT << (p_size % 32)) AS w FROM part WHERE p_size < 64 GROUP BY 1, 2) SELECT p_type, i::INT AS word_idx, coalesce((SELECT any_value(CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END) FROM words WHERE words.p_type = t.p_type AND words.i = r.i), 0)::INT AS word FROM (SELECT DISTINCT p_type FROM words) t, range(2) r(i)")
def mask_arrays(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_type", F.col("p_size").cast("long").alias("p_size"))
    return M.masks(rows, 50, ["p_type"], "p_size").select("p_type", F.posexplode("mask").alias("word_idx", "word"))


ODD = 0b01010101_00110011_00001111_11110001


@query("mask_apply", f"SELECT vec_id, pos::INT AS pos, CASE WHEN pos < 32 AND ({ODD}::BIGINT >> pos) & 1 = 1 OR pos >= 32 AND pos < 48 THEN value::DOUBLE END AS value FROM (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def mask_apply(spark, sf_dir):
    # The second word allows its lower half; -inf comes back as null.
    masked = M.apply(F.col("embedding"), F.array(F.lit(ODD), F.lit(0xFFFF)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(masked).alias("pos", "x"))
    return rows.select("vec_id", "pos", F.when(F.col("x") != F.lit(M.BLOCKED), F.col("x").cast("double")).alias("value"))


@query("mask_allocate", "SELECT n_nationkey, ((n_nationkey * 100 + 31) // 32)::INT AS n_words, -1 AS word FROM nation WHERE n_nationkey > 0")
def mask_allocate(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").filter("n_nationkey > 0").select("n_nationkey")
    sized = rows.select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), M.allocate(100 * i).alias("mask")) for i in range(1, 25)])).alias("m")).filter("m.i = n_nationkey")
    return sized.select("n_nationkey", F.size("m.mask").alias("n_words"), F.array_min("m.mask").alias("word"))


@query("guide_masks", f"{_EDGES} SELECT state::INT AS state, (token_id // 32)::INT AS word_idx, (CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END)::INT AS word FROM (SELECT state, token_id // 32 AS p, any_value(token_id) AS token_id, bit_or(1::BIGINT << (token_id % 32)::INT) AS w FROM edges WHERE token_id < 65536 GROUP BY 1, 2)")
def guide_masks(spark, sf_dir):
    return M.mask_words(name_index(spark, sf_dir).edges, 1 << 16, ["state"])


@query("mask_bitmaps", f"""{_EDGES}, w AS (SELECT state, (token_id // 32)::INT AS i, bit_or(1::BIGINT << (token_id % 32)::INT) AS w FROM edges WHERE token_id < 65536 GROUP BY 1, 2)
  SELECT s.state::INT AS state, r.i::INT AS word_idx, coalesce((SELECT any_value(CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END) FROM w WHERE w.state = s.state AND w.i = r.i), 0)::INT AS word FROM (SELECT DISTINCT state FROM w) s, range(0, 2048, 64) r(i)""")
def mask_bitmaps(spark, sf_dir):
    """Whole masks of an index's states; every 64th word of each."""
    whole = M.bitmaps(name_index(spark, sf_dir).edges, 1 << 16, ["state"])
    return whole.select("state", F.explode(F.array(*[F.struct(F.lit(i).alias("word_idx"), M.word_of(F.col("mask"), i).alias("word")) for i in range(0, 2048, 64)])).alias("w")).select("state", "w.word_idx", "w.word")


@query("mask_kernel", "SELECT vec_id, pos::INT AS pos, CASE WHEN (pos * 7 + vec_id) % 3 = 0 AND pos < 40 THEN value::DOUBLE END AS value FROM (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def mask_kernel(spark, sf_dir):
    """Each vector with a mask of its own, whose bits come from rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    ids = vectors.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("token_id")).filter("(token_id * 7 + vec_id) % 3 = 0 and token_id < 40")
    masked = M.apply_batches(vectors.join(M.bitmaps(ids, 64, ["vec_id"]), "vec_id", "left"), "embedding", "mask")
    rows = masked.select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("vec_id", "pos", F.when(F.col("x") != F.lit(M.BLOCKED), F.col("x").cast("double")).alias("value"))


# Streams


STREAM_KINDS = ("click", "view", "purchase", "error", "signup")
STREAM_TOKENS = {k[0] + str(i): i for i, k in enumerate(STREAM_KINDS)}
STREAM_PATTERN = f"({'|'.join(list(STREAM_TOKENS)[:3])})*"
STREAM_AUTOMATON = compile_pattern(STREAM_PATTERN)
#: Where each accepted token leads; the same from every state, which lets a window find the state in SQL.
_LEADS = {i: STREAM_AUTOMATON.walk(t.encode(), START) for t, i in list(STREAM_TOKENS.items())[:3]}
_NUMBER = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(STREAM_KINDS)) + " ELSE 99 END"
_TO = "CASE event_type " + " ".join(f"WHEN '{STREAM_KINDS[i]}' THEN {s}" for i, s in _LEADS.items()) + " END"


@query("stream_guide", f"SELECT user_id, event_id, {_NUMBER}::BIGINT AS token_id, state, lead IS NOT NULL AS accepted, ({_flags(STREAM_AUTOMATON.final)})[state + 1] AS finished, least(32, n)::INT AS stored FROM (SELECT *, coalesce(last_value(lead IGNORE NULLS) OVER w, {START})::INT AS state, count(lead) OVER w AS n FROM (SELECT user_id, event_id, event_type, {_TO} AS lead FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))")
def stream_guide(spark, sf_dir):
    """Events of each user as a stream of tokens; the result is the table of files that the stream has written."""
    import uuid

    from .sources.scratch import scratch_root
    from .streaming.guide_stream import guide_stream

    vocab = Vocabulary(90, {t: [i] for t, i in STREAM_TOKENS.items()}, spark)
    index = Index(STREAM_PATTERN, vocab)
    path = f"{sf_dir}/events.parquet"
    number = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(i)) for i, k in enumerate(STREAM_KINDS)], F.lit(99)).cast("long")
    parts = path.rsplit("/", 1)
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", parts[1]).parquet(parts[0])
    followed = guide_stream(events.select("user_id", "event_id", number.alias("token_id")), index, vocab, "user_id", "event_id")
    where = f"{scratch_root(spark)}/latticework/guides-{uuid.uuid4().hex}"
    running = followed.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(followed.schema).parquet(f"{where}/rows").select(F.col("key").alias("user_id"), F.col("at").alias("event_id"), "token_id", "state", "accepted", "finished", "stored")


#: Errors roll back, sign-ups reset, what else users do advances; so many states can be rolled back to.
COMMAND_RING = 4
_BACK = "1 + event_id % 3"


@query(
    "stream_commands",
    f"""WITH RECURSIVE told AS (SELECT user_id, event_id, event_type, {_TO} AS lead, {_BACK} AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    run AS (
      SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS command, NULL::BIGINT AS argument, {START} AS state, true AS accepted, []::INT[] AS before FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL
      SELECT r.user_id, t.i, t.event_id, CASE t.event_type WHEN 'error' THEN 'back' WHEN 'signup' THEN 'reset' ELSE 'advance' END, CASE t.event_type WHEN 'error' THEN t.n WHEN 'signup' THEN NULL ELSE {_NUMBER.replace("event_type", "t.event_type")} END,
        CASE WHEN t.event_type = 'signup' THEN {START} WHEN t.event_type = 'error' THEN CASE WHEN len(r.before) >= t.n THEN r.before[len(r.before) - t.n + 1] ELSE r.state END ELSE coalesce(t.lead, r.state) END::INT,
        CASE WHEN t.event_type = 'error' THEN len(r.before) >= t.n ELSE t.event_type = 'signup' OR t.lead IS NOT NULL END,
        CASE WHEN t.event_type = 'error' THEN CASE WHEN len(r.before) >= t.n THEN r.before[1:len(r.before) - t.n] ELSE r.before END WHEN t.lead IS NOT NULL THEN list_append(r.before, r.state)[-{COMMAND_RING}:] ELSE r.before END
      FROM run r JOIN told t ON t.user_id = r.user_id AND t.i = r.i + 1)
    SELECT user_id, event_id, command, argument::BIGINT AS argument, state::INT AS state, accepted, ({_flags(STREAM_AUTOMATON.final)})[state + 1] AS finished, len(before)::INT AS stored FROM run WHERE i > 0""",
)
def stream_commands(spark, sf_dir):
    """Events of each user as commands to a guide; the result is the table of files that the stream has written."""
    from .sources.scratch import new_folder
    from .streaming.guide_stream import ADVANCE, BACK, RESET, STORE, command_stream

    vocab = Vocabulary(90, {t: [i] for t, i in STREAM_TOKENS.items()}, spark)
    index = Index(STREAM_PATTERN, vocab)
    path = f"{sf_dir}/events.parquet"
    number = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(i)) for i, k in enumerate(STREAM_KINDS)], F.lit(99)).cast("long")
    command = F.when(F.col("event_type") == "error", BACK).when(F.col("event_type") == "signup", RESET).otherwise(ADVANCE)
    argument = F.when(F.col("event_type") == "error", F.expr(_BACK)).when(F.col("event_type") != "signup", number)
    parts = path.rsplit("/", 1)
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", parts[1]).parquet(parts[0])
    commands = command_stream(events.select("user_id", "event_id", command.alias("command"), argument.alias("argument")), index, vocab, "user_id", "event_id", "command", "argument", COMMAND_RING)
    where = new_folder(spark, "commands")
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        commands.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(commands.schema).parquet(f"{where}/rows").withColumnsRenamed({"key": "user_id", "at": "event_id"})


PROPS = regex_from_value(key({"type": "integer"}))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose properties fit a schema, by type."""
    rows = table(spark, folder, "events").filter(P.fullmatch("props", PROPS))
    return rows.groupBy("event_type").agg(F.count("*").alias("n_match"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("sum_k"))


QUERIES["schema_flagship"] = lambda spark, sf_dir: flagship(spark, sf_dir)
SQL["schema_flagship"] = f"SELECT event_type, count(*) AS n_match, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS sum_k FROM events WHERE regexp_full_match(props, {text(PROPS)}) GROUP BY 1"
